"""Wafer-table scan and data-quality checks.

The wafer table (D1) is ``(wafer_id, lot_name, wafer_index, rows, cols,
cells array<tinyint>, failure_raw array<array<string>>, ...)`` in parquet or
JSON. Maps may also arrive nested (``array<array<int>>``) and are flattened
at the edge.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import h32, h60

# The expected columns of the wafer table and the row floor.
EXPECTED_COLUMNS = ("wafer_id", "lot_name", "wafer_index", "rows", "cols", "cells", "failure_raw")
REQUIRED_COLUMNS = ("cells",)
ROW_FLOOR = 800_000

WAFER_SCHEMA = T.StructType([
    T.StructField("wafer_id", T.LongType()), T.StructField("lot_name", T.StringType()),
    T.StructField("wafer_index", T.IntegerType()), T.StructField("die_size", T.DoubleType()),
    T.StructField("split_raw", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("failure_raw", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("rows", T.IntegerType()), T.StructField("cols", T.IntegerType()),
    T.StructField("cells", T.ArrayType(T.ByteType())),
])


def read_wafers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC-01: read a wafer table; a missing path or a file that is not a
    table fails with a clear error before any job runs."""
    try:
        if fmt == "json":
            df = spark.read.schema(WAFER_SCHEMA).json(path)
        else:
            df = spark.read.format(fmt).load(path)
    except Exception as exc:  # noqa: BLE001
        raise FileNotFoundError(f"cannot read wafer table at {path!r}: {exc}") from exc
    require_columns(df, REQUIRED_COLUMNS)
    return df


def flatten_nested_maps(df: DataFrame, col: str = "wafer_map") -> DataFrame:
    """``array<array<int>>`` maps -> flat ``cells`` + ``rows``/``cols``."""
    return (df.withColumn("rows", F.size(col))
            .withColumn("cols", F.coalesce(F.size(F.get(F.col(col), 0)), F.lit(0)))
            .withColumn("cells", F.transform(F.flatten(col), lambda v: v.cast("tinyint"))))


def require_columns(df: DataFrame, required) -> None:
    """DQ-02: raise before any job when a required column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def verify(df: DataFrame, expected=EXPECTED_COLUMNS, min_rows: int = ROW_FLOOR) -> DataFrame:
    """DQ-01: one-row report: missing columns (schema set difference), row
    count, ok flag and message. The count is one aggregation."""
    missing = sorted(set(expected) - set(df.columns))
    n = F.count("*")
    ok = (F.lit(len(missing) == 0) & (n >= min_rows))
    msg = F.when(ok, F.lit("ok")).otherwise(F.concat_ws(
        "; ", F.when(F.lit(bool(missing)), F.lit("missing columns: " + ", ".join(missing))),
        F.when(n < min_rows, F.format_string("only %d rows (< %d)", n, F.lit(min_rows)))))
    return df.agg(n.alias("n_rows"), F.lit(len(missing)).alias("n_missing"),
                  F.lit(",".join(missing)).alias("missing_columns"), ok.alias("ok"), msg.alias("message"))


def preview(df: DataFrame, n: int = 5, order_col: str = "wafer_id", max_cells: int = 20) -> DataFrame:
    """DQ-05: first ``n`` rows (explicit order), arrays longer than
    ``max_cells`` shown as ``<array RxC tinyint>``."""
    cell = F.when(F.size("cells") > max_cells,
                  F.format_string("<array %dx%d tinyint>", F.col("rows"), F.col("cols"))
                  ).otherwise(F.array_join(F.col("cells").cast("array<string>"), ","))
    return df.orderBy(order_col).limit(n).withColumn("cells", cell)


def canonical_row(df: DataFrame) -> F.Column:
    """Canonical text of a row: columns in name order, arrays comma-joined."""
    parts = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",", "null")
        parts.append(F.coalesce(c.cast("string"), F.lit("null")))
    return F.concat_ws("|", *parts)


def fingerprint(df: DataFrame) -> DataFrame:
    """DQ-07 (re-aimed from file bytes to table content): order-insensitive
    fingerprint = (row count, bit_xor of 60-bit row hashes, sum of 32-bit row
    hashes). Equal tables give equal fingerprints whatever the partitioning."""
    row = canonical_row(df)
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(h60(row)).alias("xor60"),
                  F.sum(h32(row)).alias("sum32"))
