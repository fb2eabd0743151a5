"""Reading the driver's parquet tables.

Column lists are passed through ``select`` right after the scan so Catalyst
prunes the parquet ``ReadSchema``; filters applied later are pushed into the
scan by the optimizer.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; expected one of {TABLES}")
    configure(spark)
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df
