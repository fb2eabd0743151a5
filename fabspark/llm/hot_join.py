"""Equi-joins of rows with a one-row-a-key table where some keys may be hot."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MOST_HOT = 1000                      # fewer keys than this can have over 1/1000 of all rows each


def hot_keys(counts: DataFrame, key: str, rows: str) -> DataFrame | None:
    """Keys with over 1/``MOST_HOT`` of all rows (``counts``: one row a key, column ``rows`` how many
    rows it has). Fewer than ``MOST_HOT`` by arithmetic, whatever the data. None if there are none."""
    total = counts.agg(F.sum(rows)).first()[0] or 0
    edge = max(32, total // MOST_HOT)
    found = counts.where((F.col(rows) > edge) & F.col(key).isNotNull()).select(key).collect()
    return counts.sparkSession.createDataFrame(found, counts.select(key).schema) if found else None


def attach(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) on ``key``. Rows of hot keys meet their few table
    rows in place (a broadcast of at most ``MOST_HOT`` rows); only the others are shuffled. With
    ``how='left'`` rows without a match, and those with a null key, stay with nulls."""
    cold, out = rows.where(F.col(key).isNotNull()), None
    if hot is not None:
        few = F.broadcast(hot)
        out = cold.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, how)
        cold = cold.join(few, key, "left_anti")
    out = cold.join(table, key, how) if out is None else out.unionByName(cold.join(table, key, how))
    if how == "left":
        out = out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
    return out
