"""Seeded, exact, stratified splitting and ranking.

Every row gets a seeded 60-bit hash key; its 1-based rank inside its class
(hash order, id tie-break) comes from ``running_sums`` (range-bucketed, so
the majority class never sits in one task). Splits, folds, undersampling and
seeded caps are then simple filters on that rank. Per-class sizes are
allocated like scikit-learn's stratified splitter (``approximate_mode``),
with ties in the fractional parts broken by class order instead of an RNG.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import h60
from .cumulative import TARGET_ROWS, running_sums

SEED = 42


def seeded_rank(df: DataFrame, id_col: str, group_cols=(), seed: int = SEED,
                target_rows: int = TARGET_ROWS) -> DataFrame:
    """Adds ``rank`` (1-based, per group) in the order of h60(id || ':' || seed)."""
    group_cols = list(group_cols)
    keyed = (df.withColumn("_key", h60(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))))
             .withColumn("_one", F.lit(1).cast("long")))
    r = running_sums(keyed, "_key", ["_one"], group_cols, descending=False, target_rows=target_rows,
                     tie_cols=[id_col])
    return r.withColumnRenamed("cum__one", "rank").drop("_key", "_one")


def class_counts(df: DataFrame, y: str, max_classes: int = 10_000) -> dict:
    """Per-class row counts (one row per class; size-checked before collecting)."""
    rows = df.groupBy(y).count().limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes; not a classification target")
    return {r[y]: r["count"] for r in rows}


def grouped_counts(df: DataFrame, y: str, group: str | None, max_classes: int = 10_000) -> dict:
    """``class_counts`` by the value of ``group`` (None: one group, None)."""
    if group is None:
        return {None: class_counts(df, y, max_classes)}
    rows = df.groupBy(group, y).count().limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes; not a classification target")
    out: dict = {}
    for r in rows:
        out.setdefault(r[group], {})[r[y]] = r["count"]
    return out


def by_group(group: str | None, mapping: dict):
    """The constant of a row's group."""
    return F.lit(mapping[None]) if group is None else _per_class(group, mapping)


def approximate_mode(counts: dict, n_draws: int) -> dict:
    """Per-class draws summing to ``n_draws``, proportional to ``counts``:
    floors first, the remainder to the largest fractional parts (class order on ties)."""
    total = sum(counts.values())
    keys = sorted(counts, key=lambda k: (str(type(k)), k))
    cont = {k: counts[k] / total * n_draws for k in keys}
    out = {k: math.floor(cont[k]) for k in keys}
    need = n_draws - sum(out.values())
    for k in sorted(keys, key=lambda k: -(cont[k] - out[k])):
        if need <= 0:
            break
        if cont[k] - out[k] > 0:
            out[k] += 1
            need -= 1
    return out


def _per_class(col: str, mapping: dict):
    expr = None
    for k, v in mapping.items():
        cond = F.col(col) == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(0))


def test_sizes(counts: dict, test_size: float) -> dict:
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    train = approximate_mode(counts, n - n_test)
    return {k: counts[k] - train[k] for k in counts}


def stratified_split(df: DataFrame, y: str = "y", id_col: str = "unit_id", test_size: float = 0.2,
                     seed: int = SEED) -> DataFrame:
    """SPL-01: adds ``split`` in {train, test} with exact per-class test counts."""
    sizes = test_sizes(class_counts(df, y), test_size)
    r = seeded_rank(df, id_col, [y], seed)
    return r.withColumn("split", F.when(F.col("rank") <= _per_class(y, sizes), "test").otherwise("train")).drop("rank")


def stratified_three_way(df: DataFrame, y: str = "label", id_col: str = "wafer_id", val_size: float = 0.15,
                         test_size: float = 0.15, seed: int = SEED) -> DataFrame:
    """SPL-02: test first (``test_size`` of all), then validation =
    val_size / (1 - test_size) of the rest; remaining rows are train."""
    counts = class_counts(df, y)
    t = test_sizes(counts, test_size)
    rest = {k: counts[k] - t[k] for k in counts}
    v = test_sizes(rest, val_size / (1.0 - test_size))
    r = seeded_rank(df, id_col, [y], seed)
    tc, vc = _per_class(y, t), _per_class(y, v)
    return r.withColumn("split", F.when(F.col("rank") <= tc, "test")
                        .when(F.col("rank") <= tc + vc, "val").otherwise("train")).drop("rank")


def stratified_folds(df: DataFrame, k: int = 5, y: str = "y", id_col: str = "unit_id", seed: int = SEED) -> DataFrame:
    """SPL-03: ``fold`` in 0..k-1; per-class fold sizes follow the class's
    offset in the class-sorted order, as in scikit-learn's stratified k-fold."""
    counts = class_counts(df, y)
    start, acc = {}, 0
    for c in sorted(counts, key=lambda c: (str(type(c)), c)):
        start[c] = acc
        acc += counts[c]
    r = seeded_rank(df, id_col, [y], seed)
    return r.withColumn("fold", ((F.col("rank") - 1 + _per_class(y, start)) % k).cast("int")).drop("rank")


def smallest_k(df: DataFrame, id_col: str, k: int, seed: int = SEED, group_cols=()) -> DataFrame:
    """Exact seeded sample of ``k`` rows (per group): lowest hash ranks."""
    return seeded_rank(df, id_col, group_cols, seed).filter(F.col("rank") <= k).drop("rank")
