"""Mutual information of each feature with a class, estimated from nearest neighbours (AGG-05, FIT-06).

Ross's estimator for a continuous feature and a discrete target: for a row of a class with n_c rows, r is the
distance to its k-th nearest row of the class (k_c = min(k, n_c - 1) of them) and m the number of rows of any
class nearer than r, itself included; MI = psi(n) + mean psi(k_c) - mean psi(n_c) - mean psi(m), not below zero,
in nats. In one dimension the neighbours stand beside each other in sorted order:

* tables of a row a feature (or a feature and class) are broadcast: joined by key, all rows of a feature would be
  sorted in one task;
* rows are first counted by (feature, class, value), so that a value which many rows share (a filled-in median)
  is one row with a count and no hot spot;
* positions in each (feature, class) come from ``running_sums``; blocks of positions, with ``k`` rows of either
  neighbour block copied in, find the k-th distance by lag and lead;
* m is the difference of two running sums: the open window's ends are sorted in among the values of the feature.

No noise is added to break ties (the usual library adds 1e-10 of it): where r is zero, m counts the equal rows.

Missing values (null or NaN) take the feature's median; features without any value give no row. Rows without a
class and classes of a single row are left out. An empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cumulative import running_sums
from .quantiles import exact_median

NEIGHBOURS = 3
TARGET_ROWS = 100_000        # rows of a feature, or of a class in it, in one running sum
BLOCK_ROWS = 20_000          # distinct values of a (feature, class) in one window: each row holds 2 k neighbours


def digamma(n: Column) -> Column:
    """psi(n) for n >= 1 to double precision: the asymptotic series at n + 10, carried back by psi(n) = psi(n+1) - 1/n."""
    x = n.cast("double") + 10
    s = 1 / (x * x)
    series = F.log(x) - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))
    back = F.lit(0.0)
    for j in range(10):
        back = back + 1 / (n.cast("double") + j)
    return series - back


def _kth_in_class(values: DataFrame, y: str, k: int, target_rows: int, block_rows: int) -> DataFrame:
    """``values`` (i, y, v, c) with the class size ``n_c`` and ``near``, the k-th nearest row as (distance, value)."""
    sized = values.join(F.broadcast(values.groupBy("i", y).agg(F.sum("c").alias("n_c"))), ["i", y]).filter(F.col("n_c") > 1)
    at = running_sums(sized.withColumn("_one", F.lit(1).cast("long")), "v", ["_one"], ["i", y], descending=False,
                      target_rows=target_rows).drop("_one")
    pos = F.col("cum__one") - 1
    block, inside = F.floor(pos / block_rows), pos % block_rows
    blocks = F.filter(F.array(block, F.when((inside < k) & (block > 0), block - 1),
                              F.when(inside >= block_rows - k, block + 1)), lambda b: b.isNotNull())
    copied = at.withColumn("_own", block).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy("i", y, "_block").orderBy("v")
    row = F.struct("v", "c")
    sides = [f(row, j).over(w) for f in (F.lag, F.lead) for j in range(1, k + 1)]
    beside = copied.withColumn("_beside", F.array(*sides)).filter(F.col("_own") == F.col("_block"))
    here = F.col("v")
    ranked = F.array_sort(F.concat(
        F.array(F.struct(F.lit(0.0).alias("d"), here.alias("x"), (F.col("c") - 1).alias("c"))),
        F.transform(F.filter("_beside", lambda s: s.isNotNull()),
                    lambda s: F.struct(F.abs(s["v"] - here).alias("d"), s["v"].alias("x"), s["c"].alias("c")))))
    single = F.flatten(F.transform(ranked, lambda s: F.array_repeat(s, F.least(s["c"], F.lit(k)).cast("int"))))
    k_c = F.least(F.lit(k).cast("long"), F.col("n_c") - 1)
    return (beside.withColumn("k_c", k_c).withColumn("near", F.element_at(single, F.col("k_c").cast("int")))
            .select("i", y, "v", "c", "n_c", "k_c", "near"))


def neighbour_mutual_information(df: DataFrame, x: str = "x", y: str = "y", k: int = NEIGHBOURS,
                                 target_rows: int = TARGET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(i, mutual_info)`` of every slot of the array ``x`` with the class ``y``."""
    long = (df.filter(F.col(y).isNotNull()).select(F.col(y).alias("_y"), F.posexplode(x).alias("i", "v"))
            .withColumn("v", F.when(~F.isnan("v"), F.col("v").cast("double") + 0.0)))
    med = exact_median(long, ["i"], "v")
    counted = long.groupBy("i", "_y", "v").agg(F.count("*").alias("c"))
    values = (counted.join(F.broadcast(med), "i").withColumn("v", F.coalesce("v", "median"))
              .groupBy("i", "_y", "v").agg(F.sum("c").alias("c")).filter(F.col("v").isNotNull()))
    rows = _kth_in_class(values, "_y", k, target_rows, block_rows)
    v, d, other = F.col("v"), F.col("near.d"), F.col("near.x")
    # the neighbour itself bounds its side: v + (x - v) may miss x by rounding
    upper = F.when(other >= v, other).otherwise(v + d)
    lower = F.when(other <= v, other).otherwise(v - d)

    def event(at, kind, weight, sign):
        return F.struct(at.alias("at"), kind.cast("int").alias("kind"), weight.cast("long").alias("w"), F.lit(sign).alias("sign"))
    touching = d == 0
    events = rows.withColumn("e", F.explode(F.array(
        event(v, F.lit(1), F.col("c"), 0),
        event(upper, F.when(touching, 2).otherwise(0), F.lit(0), 1),
        event(lower, F.when(touching, 0).otherwise(2), F.lit(0), -1)))).select("i", "_y", "v", "c", "n_c", "k_c", "e.*")
    summed = running_sums(events, "at", ["w"], ["i"], descending=False, target_rows=target_rows, tie_cols=["kind"])
    m = (summed.filter(F.col("sign") != 0).groupBy("i", "_y", "v", "c", "n_c", "k_c")
         .agg(F.sum(F.col("sign") * F.col("cum_w")).alias("m")))
    n = F.sum("c")

    def mean(col):
        return F.sum(F.col("c") * digamma(F.col(col))) / n
    return m.groupBy("i").agg(F.greatest(F.lit(0.0), digamma(n) + mean("k_c") - mean("n_c") - mean("m")).alias("mutual_info"))
