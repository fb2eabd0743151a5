"""Report, prediction and split writers (SNK-01/02/03/06).

Reports are small DataFrames (one row or one row per feature / class); they
are written with the DataFrame writer to the location the caller gives (on a
cluster: a shared path), never collected and re-serialised on the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> str:
    """SNK-02: JSON lines report."""
    df.write.mode("overwrite").json(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """SNK-03: CSV with a header (predictions, comparison tables)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_tables(tables: dict[str, DataFrame], base: str, fmt: str = "parquet") -> dict[str, str]:
    """SNK-06: several named report tables under one folder."""
    out = {}
    for name, df in tables.items():
        p = f"{base.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(p)
        out[name] = p
    return out


def write_splits(df: DataFrame, base: str, label: str = "label", split: str = "split") -> dict[str, str]:
    """SNK-01 / SPL-04: rows partitioned by split (parquet), the sorted class
    list and per-split per-class counts as JSON metadata."""
    data = f"{base.rstrip('/')}/data"
    df.write.mode("overwrite").partitionBy(split).parquet(data)
    classes = df.select(label).distinct().agg(F.sort_array(F.collect_list(label)).alias("classes"))
    write_json(classes, f"{base.rstrip('/')}/classes")
    write_json(df.groupBy(split, label).count(), f"{base.rstrip('/')}/meta")
    return {"data": data, "classes": f"{base.rstrip('/')}/classes", "meta": f"{base.rstrip('/')}/meta"}
