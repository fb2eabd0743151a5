"""Exact quantiles (linear interpolation, as numpy/pandas) without holding a
whole group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer; with a billion values per feature that is one task's
memory. Here each wanted order statistic (rank r of n, 0-based) is found by
narrowing a value bracket:

1. per group: n, min, max -> bracket [lo, hi] holding ranks [below, below+cnt)
2. while a bracket holds more than ``max_collect`` values: one aggregation
   pass histograms the values inside every open bracket into ``buckets``
   equal-width buckets (count, min, max per bucket); the bucket containing
   rank r becomes the new bracket, its exact min/max the new bounds.
   Bucketing is monotone, so a bucket's [min, max] holds exactly its values.
3. the final brackets hold at most ``max_collect`` values (or one repeated
   value): those are collected, sorted and indexed.

Every pass is a grouped aggregation with map-side partial aggregation; the
driver only counts open brackets; the bracket table (one row per wanted
order statistic) is checkpointed each pass and, up to ``BROADCAST_BRACKETS``
rows, broadcast: joined by key, all values of a group would be sorted in one task. Passes needed ~
log_buckets(n / max_collect).
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_COLLECT = 50_000
BROADCAST_BRACKETS = 100_000          # brackets sent to every task; the rows of a group then need no task of their own
BUCKETS = 4096
LARGEST = 1.7976931348623157e308      # infinities count as this, halved so that widths stay finite


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    max_collect: int = MAX_COLLECT, buckets: int = BUCKETS) -> DataFrame:
    """``(keys..., p, q)``: the p-quantile of non-null, non-NaN ``value`` per
    group with linear interpolation between the two bracketing order statistics.
    Groups without values are absent."""
    keys = list(keys)
    x = (df.select(*keys, F.col(value).cast("double").alias("_v"))
         .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
         .persist(StorageLevel.MEMORY_AND_DISK))
    stats = x.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    want = (stats.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
            .withColumn("h", (F.col("n") - 1) * F.col("p")))
    ranks = (want.select(*keys, "n", "lo", "hi",
                         F.explode(F.array(F.floor("h").cast("long"), F.ceil("h").cast("long"))).alias("rank"))
             .distinct())
    br = ranks.select(*keys, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"),
                      F.col("n").alias("cnt")).cache()
    first = br
    few = 2 * len(probs) * stats.count() <= BROADCAST_BRACKETS
    sent = F.broadcast if few else (lambda d: d)
    done = (F.col("cnt") <= max_collect) | (F.col("lo") == F.col("hi"))
    # lo falls into the first bucket and hi into the last, so every pass narrows each open
    # bracket. Brackets over many magnitudes are cut on a signed log scale, others evenly:
    # a few passes reach one value whatever the spread, and the loop ends by itself
    while br.filter(~done).limit(1).count():
        open_ = br.filter(~done)
        lo, hi, v = (F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.col(c))) for c in ("lo", "hi", "_v"))
        magnitude = lambda c: F.when(c == 0, 0.0).otherwise(F.signum(c) * (F.log2(F.abs(c)) + 1100))
        wide = (lo < hi) & (((lo <= 0) & (hi >= 0)) | (F.abs(lo) / 4 > F.abs(hi)) | (F.abs(hi) / 4 > F.abs(lo)))
        share = (F.when(wide, (magnitude(v) - magnitude(lo)) / (magnitude(hi) - magnitude(lo)))
                 .when(lo < hi, (v / 2 - lo / 2) / (hi / 2 - lo / 2))
                 .otherwise((F.col("_v") > F.col("lo")).cast("double")))
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
        hist = (x.join(sent(open_), keys)
                .filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
                .withColumn("b", bucket)
                .groupBy(*keys, "rank", "below", "b")
                .agg(F.count("*").alias("c"), F.min("_v").alias("mn"), F.max("_v").alias("mx")))
        w = Window.partitionBy(*keys, "rank").orderBy("b")
        hist = hist.withColumn("cum", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        pick = (hist.filter((F.col("below") + F.col("cum") - F.col("c") <= F.col("rank"))
                            & (F.col("rank") < F.col("below") + F.col("cum")))
                .select(*keys, "rank", F.col("mn").alias("lo"), F.col("mx").alias("hi"),
                        (F.col("below") + F.col("cum") - F.col("c")).alias("below"), F.col("c").alias("cnt")))
        # iterative: cut the lineage of the (small) bracket table at every pass
        # with a reliable checkpoint in the shared checkpoint folder
        br = cut_lineage(br.filter(done).unionByName(pick))
    final = (x.join(sent(br), keys)
             .filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
             .groupBy(*keys, "rank", "below", "lo", "hi")
             .agg(F.sort_array(F.collect_list(F.when(F.col("lo") < F.col("hi"), F.col("_v")))).alias("vals")))
    val = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(
        F.get(F.col("vals"), (F.col("rank") - F.col("below")).cast("int")))
    order_stats = final.select(*keys, "rank", val.alias("v"))
    lo_ = order_stats.select(*keys, F.col("rank").alias("r0"), F.col("v").alias("v0"))
    hi_ = order_stats.select(*keys, F.col("rank").alias("r1"), F.col("v").alias("v1"))
    out = (want.select(*keys, "p", "h", F.floor("h").cast("long").alias("r0"), F.ceil("h").cast("long").alias("r1"))
           .join(lo_, keys + ["r0"]).join(hi_, keys + ["r1"])
           .select(*keys, "p", (F.col("v0") + (F.col("h") - F.col("r0")) * (F.col("v1") - F.col("v0"))).alias("q")))
    out = cut_lineage(out)               # one row a group and probability: the held values can go
    x.unpersist()
    first.unpersist()
    return out


def exact_median(df: DataFrame, keys: list[str], value: str, **kw) -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5], **kw).select(*keys, F.col("q").alias("median"))
