"""Class-imbalance strategies as ``DataFrame -> DataFrame`` functions.

Strategy names (fixed): none, class_weight, random_over, random_under,
smote, borderline_smote, adasyn, smote_enn, smote_tomek.

All draws are hash-seeded, so results are deterministic and independent of
partitioning. Oversampling draws are generated with ``spark.range`` (spread
over all tasks) and matched to minority rows by an equi-join on their rank;
undersampling keeps the majority rows of lowest seeded rank. The k-NN based
strategies live in ``smote.py``.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import h60
from .split import SEED, class_counts, seeded_rank

# The nine strategy names, in the reference's order.
STRATEGIES = ("none", "class_weight", "random_over", "random_under", "smote",
              "borderline_smote", "adasyn", "smote_enn", "smote_tomek")

# Strategies that resample every group of rows by itself in the same jobs (``group``).
GROUPED = ("none", "smote", "smote_enn", "smote_tomek")

DESCRIPTIONS = {
    "none": "train on the data as is",
    "class_weight": "weight each class by n / (k * count)",
    "random_over": "redraw minority rows with replacement up to the majority count",
    "random_under": "keep a seeded sample of majority rows equal to the minority count",
    "smote": "synthesise minority rows between neighbours (k=5)",
    "borderline_smote": "SMOTE seeded only from minority rows near the class border",
    "adasyn": "SMOTE with more samples where neighbours are mostly majority",
    "smote_enn": "SMOTE, then remove rows whose 3 neighbours disagree",
    "smote_tomek": "SMOTE, then remove both ends of Tomek links",
}


def minority_majority(counts: dict):
    lo = min(counts, key=lambda k: (counts[k], str(k)))
    hi = max(counts, key=lambda k: (counts[k], str(k)))
    return lo, hi


def with_class_weights(df: DataFrame, y: str = "y", out: str = "weight") -> DataFrame:
    """RES-02: per-row weight n / (k * count_class) (k = number of classes)."""
    counts = class_counts(df, y)
    n, k = sum(counts.values()), len(counts)
    expr = None
    for c, cnt in counts.items():
        w = F.lit(n / (k * cnt))
        expr = F.when(F.col(y) == F.lit(c), w) if expr is None else expr.when(F.col(y) == F.lit(c), w)
    return df.withColumn(out, expr)


def random_over(df: DataFrame, y: str = "y", id_col: str = "unit_id", seed: int = SEED) -> DataFrame:
    """RES-03: keep all rows, add n_maj - n_min minority rows drawn with
    replacement (draw j -> minority rank h(j, seed) % n_min + 1)."""
    counts = class_counts(df, y)
    lo, hi = minority_majority(counts)
    n_draw = counts[hi] - counts[lo]
    if n_draw <= 0:
        return df.withColumn("synthetic", F.lit(False))
    spark = df.sparkSession
    minority = seeded_rank(df.filter(F.col(y) == F.lit(lo)), id_col, (), seed)
    draws = (spark.range(n_draw)
             .select((h60(F.concat(F.col("id").cast("string"), F.lit(f":draw:{seed}"))) % counts[lo] + 1)
                     .alias("rank"), F.col("id").alias("draw")))
    extra = draws.join(minority, "rank").drop("rank", "draw")
    return (df.withColumn("synthetic", F.lit(False))
            .unionByName(extra.withColumn("synthetic", F.lit(True))))


def random_under(df: DataFrame, y: str = "y", id_col: str = "unit_id", seed: int = SEED) -> DataFrame:
    """RES-04: every class cut to the minority count by lowest seeded rank."""
    counts = class_counts(df, y)
    lo, _ = minority_majority(counts)
    return seeded_rank(df, id_col, [y], seed).filter(F.col("rank") <= counts[lo]).drop("rank")


@dataclass
class BalancingPlan:
    """D12: a strategy = an optional resampler + optional class weights."""
    strategy: str
    sampler: Callable[[DataFrame], DataFrame] | None
    class_weight: bool = False
    scale_pos_weight: float | None = None


def build_plan(strategy: str, y: str = "y", id_col: str = "unit_id", x: str = "x", seed: int = SEED,
               **kw) -> BalancingPlan:
    """RES plan builder; unknown names raise."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    from . import smote as S
    samplers = {
        "none": None,
        "class_weight": None,
        "random_over": lambda d: random_over(d, y, id_col, seed),
        "random_under": lambda d: random_under(d, y, id_col, seed),
        "smote": lambda d: S.smote(d, y=y, id_col=id_col, x=x, seed=seed, **kw),
        "borderline_smote": lambda d: S.borderline_smote(d, y=y, id_col=id_col, x=x, seed=seed, **kw),
        "adasyn": lambda d: S.adasyn(d, y=y, id_col=id_col, x=x, seed=seed, **kw),
        "smote_enn": lambda d: S.smote_enn(d, y=y, id_col=id_col, x=x, seed=seed, group=kw.get("group")),
        "smote_tomek": lambda d: S.smote_tomek(d, y=y, id_col=id_col, x=x, seed=seed, group=kw.get("group")),
    }
    return BalancingPlan(strategy, samplers[strategy], class_weight=(strategy == "class_weight"))


def apply(df: DataFrame, strategy: str, **kw) -> DataFrame:
    plan = build_plan(strategy, **kw)
    out = df if plan.sampler is None else plan.sampler(df)
    return with_class_weights(out, kw.get("y", "y")) if plan.class_weight else out


def strategy_comparison(df: DataFrame, strategies=("none", "class_weight", "random_over", "random_under"),
                        y: str = "y", **kw) -> DataFrame:
    """RES-10: class counts after each strategy, with its description."""
    out = None
    for s in strategies:
        counts = (apply(df, s, y=y, **kw).groupBy(y).agg(F.count("*").alias("count"))
                  .select(F.lit(s).alias("strategy"), F.lit(DESCRIPTIONS[s]).alias("description"), y, "count"))
        out = counts if out is None else out.unionByName(counts)
    return out
