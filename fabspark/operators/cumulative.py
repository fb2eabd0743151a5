"""Running sums in a global order without a single-partition window.

``Window.orderBy(x)`` with no partition moves every row into one task. For
curves over distinct scores that is fine at 100 rows and fatal at 10^9.
``running_sums``:

* where no group holds more than ``target_rows`` rows: one window partition per group (bounded by construction);
* a longer sequence without groups: approximate-quantile cut points split it into ranges of ~``target_rows``
  rows; rows find their range by binary search (``Bucketizer``, JVM);
* with groups, each one above ``target_rows`` gets cut points of its own, all from one aggregation; the others
  stay one range. The number of jobs does not depend on the number of groups.

Per-range totals (one row per range) become exclusive prefix offsets; the running sum runs inside each range
(window partitioned by range) and adds its offset. Rows with a null group key are a group like any other.

``next_cols`` also returns the value of the following row in the same order
(``lead``), stitched across range boundaries through the small range table.
The ordering column should be unique within a group; otherwise pass
``tie_cols`` — equal values always fall in the same range, so ordering by
(order_col, tie_cols) inside a range gives a deterministic total order.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TARGET_ROWS = 2_000_000


MAX_RANGES = 50_000          # cut points kept on the driver (one double each)
CUTS_BROADCAST = 64 << 20    # bytes of cut points that are sent to every task; beyond, Spark chooses the join


def running_sums(df: DataFrame, order_col: str, sum_cols: list[str], group_cols=(), descending: bool = True,
                 target_rows: int = TARGET_ROWS, next_cols: list[str] | None = None,
                 tie_cols: list[str] | None = None) -> DataFrame:
    group_cols = list(group_cols)
    next_cols = list(next_cols or [])
    tie_cols = list(tie_cols or [])
    if not group_cols:
        return _ranged(df, order_col, sum_cols, df.count(), descending, target_rows, next_cols, tie_cols)
    counts = df.groupBy(*group_cols).agg(F.count("*").alias("_n"))
    n_big, n_max = counts.agg(F.count_if(F.col("_n") > target_rows), F.max("_n")).first()
    if not n_big:
        return _single_range(df, order_col, sum_cols, group_cols, descending, next_cols, tie_cols)
    big = counts.filter(F.col("_n") > target_rows)
    return _ranged_grouped(df, order_col, sum_cols, group_cols, descending, target_rows, next_cols, tie_cols, big, n_big, n_max)


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which nulls are equal, with the columns of ``left`` and the others of ``right``."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = left.join(named, cond, how)
    return out if how == "left_semi" else out.drop(*[f"_r_{k}" for k in keys])


def _ordering(order_col, descending, tie_cols):
    o = F.col(order_col)
    return [o.desc() if descending else o.asc()] + [F.col(c).asc() for c in tie_cols]


def _single_range(df, order_col, sum_cols, group_cols, descending, next_cols, tie_cols):
    wl = Window.partitionBy(*group_cols).orderBy(*_ordering(order_col, descending, tie_cols))
    out = df
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(wl.rowsBetween(Window.unboundedPreceding, 0)))
    for c in next_cols:
        out = out.withColumn(f"next_{c}", F.lead(c).over(wl))
    return out


def _ranged(df, order_col, sum_cols, n, descending, target_rows, next_cols, tie_cols):
    """One ordered sequence: ranges from approximate-quantile cut points,
    assigned per row by binary search (``Bucketizer``)."""
    nb = max(1, min(MAX_RANGES, math.ceil(n / target_rows)))
    if nb == 1:
        return _single_range(df, order_col, sum_cols, [], descending, next_cols, tie_cols)
    from pyspark.ml.feature import Bucketizer
    probs = [i / nb for i in range(1, nb)]
    cuts = sorted(set(float(v) for v in df.agg(F.percentile_approx(order_col, probs, 10_000)).first()[0] or []))
    splits = [-float("inf")] + cuts + [float("inf")]
    # Bucketizer puts v in [s_i, s_i+1): bucket of v = number of cuts <= v
    d = Bucketizer(splits=splits, inputCol="_ov", outputCol="_rbd", handleInvalid="keep").transform(
        df.withColumn("_ov", F.col(order_col).cast("double")))
    d = d.withColumn("_rb", F.when(F.col(order_col).isNull(), 0).otherwise(F.col("_rbd")).cast("int")).drop("_ov", "_rbd")
    return _stitch(d, order_col, sum_cols, [], descending, len(splits) - 1, next_cols, tie_cols)


def _ranged_grouped(df, order_col, sum_cols, group_cols, descending, target_rows, next_cols, tie_cols, big, n_big, n_max):
    """Cut arrays of the groups in ``big``, range = count of cuts <= v; the other groups are one range each."""
    nb = max(1, min(MAX_RANGES, math.ceil(n_max / target_rows)))
    probs = [i / nb for i in range(1, nb)]
    cuts = (_join(df, big.select(*group_cols), group_cols, "left_semi").groupBy(*group_cols)
            .agg(F.percentile_approx(order_col, probs, 10_000).alias("_cuts")))
    if n_big * nb * 8 <= CUTS_BROADCAST:
        cuts = F.broadcast(cuts)
    o = F.col(order_col)
    # a null value sorts before all others, so it lies in the lowest range; a group of nulls has no cuts
    below = F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c <= o)
    d = _join(df, cuts, group_cols, "left").withColumn("_rb", F.coalesce(F.size(below), F.lit(0))).drop("_cuts")
    return _stitch(d, order_col, sum_cols, group_cols, descending, nb, next_cols, tie_cols)


def _stitch(d, order_col, sum_cols, group_cols, descending, nb, next_cols, tie_cols):
    """Per-range totals -> exclusive prefix offsets -> window inside each range."""
    o = F.col(order_col)
    if descending:
        d = d.withColumn("_rb", F.lit(nb - 1) - F.col("_rb"))          # range 0 = highest values
    first_row = F.min_by(F.struct(*[F.col(c) for c in next_cols] or [F.lit(0)]), -o if descending else o) \
        if next_cols else F.lit(None)
    tot = d.groupBy(*group_cols, "_rb").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols],
                                            first_row.alias("_first"))
    wr = Window.partitionBy(*group_cols).orderBy("_rb")       # one row per (group, range): small
    offs = tot.select(*group_cols, "_rb",
                      *[F.coalesce(F.sum(f"_t_{c}").over(wr.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                        .alias(f"_o_{c}") for c in sum_cols],
                      F.lead("_first").over(wr).alias("_next_first"))
    d = _join(d, offs, group_cols + ["_rb"])
    wl = Window.partitionBy(*group_cols, "_rb").orderBy(*_ordering(order_col, descending, tie_cols))
    out = d
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(wl.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"_o_{c}"))
    for c in next_cols:
        out = out.withColumn(f"next_{c}", F.coalesce(F.lead(c).over(wl), F.col("_next_first")[c]))
    return out.drop("_rb", "_next_first", *[f"_o_{c}" for c in sum_cols])
