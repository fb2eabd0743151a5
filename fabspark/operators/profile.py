"""Profiling: class balance, missingness, variance, target association,
mutual information, temporal failure rate, wafer statistics, label mixes,
histograms and class weights.

Sensor data uses the canonical form ``(unit_id, y, ts, x array<double>)``.
Per-feature statistics go through the long form ``(unit_id, y, i, v)``
(``posexplode``): one grouped aggregation over ``i`` with map-side partial
aggregation, instead of hundreds of named aggregate columns.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_median, exact_quantiles

# Profiling defaults.
VAR_THRESHOLD = 1e-8
HIGH_MISSING = 0.5


def feature_name(i) -> F.Column:
    return F.format_string("feature_%03d", i)


def long_form(sensors: DataFrame, keep=("unit_id", "y")) -> DataFrame:
    """``(keep..., i, v)`` — one row per (unit, feature)."""
    return sensors.select(*keep, F.posexplode("x").alias("i", "v"))


def n_features(sensors: DataFrame) -> F.Column:
    return F.max(F.size("x"))


# ---------------------------------------------------------------- AGG-01
def class_balance(df: DataFrame, y: str = "y", group_cols=()) -> DataFrame:
    """n_pass, n_fail, fail_rate (NULL on empty), imbalance_ratio (NULL without fails)."""
    n = F.count("*")
    fails = F.count_if(F.col(y) == 1)
    return (df.groupBy(*group_cols)
            .agg((n - fails).alias("n_pass"), fails.alias("n_fail"), n.alias("n"))
            .select(*group_cols, "n_pass", "n_fail",
                    F.try_divide(F.col("n_fail").cast("double"), F.col("n")).alias("fail_rate"),
                    F.try_divide(F.col("n_pass").cast("double"), F.nullif(F.col("n_fail"), F.lit(0)))
                    .alias("imbalance_ratio")))


# ---------------------------------------------------------------- AGG-02
def missingness(sensors: DataFrame) -> DataFrame:
    """Per feature: missing_count, missing_rate (sorted by rate desc, then feature)."""
    lf = long_form(sensors, ())
    return (lf.groupBy("i")
            .agg(F.count_if(F.col("v").isNull()).alias("missing_count"), F.count("*").alias("n"))
            .select("i", feature_name(F.col("i")).alias("feature"), "missing_count",
                    (F.col("missing_count") / F.col("n")).alias("missing_rate")))


# ---------------------------------------------------------------- AGG-03
def variance_report(sensors: DataFrame, threshold: float = VAR_THRESHOLD) -> DataFrame:
    """Sample variance (ddof=1), distinct non-null count, ``is_dead``."""
    lf = long_form(sensors, ())
    agg = lf.groupBy("i").agg(F.var_samp("v").alias("variance"), F.count_distinct("v").alias("n_unique"))
    dead = F.coalesce(F.col("variance") <= threshold, F.lit(False)) | (F.col("n_unique") <= 1)
    return agg.select("i", feature_name(F.col("i")).alias("feature"), "variance", "n_unique", dead.alias("is_dead"))


# ---------------------------------------------------------------- AGG-04
def point_biserial(sensors: DataFrame, y: str = "y") -> DataFrame:
    """Pearson correlation of each feature with the 0/1 target over complete
    pairs; NULL for constant features (never ``corr()``: it raises under ANSI
    on a zero standard deviation)."""
    lf = long_form(sensors, ("unit_id", y)).filter(F.col("v").isNotNull())
    yd = F.col(y).cast("double")
    agg = lf.groupBy("i").agg(F.covar_samp("v", yd).alias("cov"), F.stddev_samp("v").alias("sv"),
                              F.stddev_samp(yd).alias("sy"))
    r = F.try_divide(F.col("cov"), F.nullif(F.col("sv") * F.col("sy"), F.lit(0.0)))
    return agg.select("i", feature_name(F.col("i")).alias("feature"), r.alias("point_biserial"),
                      F.abs(r).alias("abs_corr"))


def top_associated(assoc: DataFrame, n: int = 20) -> DataFrame:
    """SRT-01: top-n by |r| (NULLs last, feature as tie-break)."""
    return assoc.orderBy(F.col("abs_corr").desc_nulls_last(), F.col("i")).limit(n)


def high_missing_features(miss: DataFrame, threshold: float = HIGH_MISSING) -> DataFrame:
    """FLT-05: strictly above the threshold."""
    return miss.filter(F.col("missing_rate") > threshold)


def dead_features(var: DataFrame) -> DataFrame:
    return var.filter(F.col("is_dead"))


# ---------------------------------------------------------------- AGG-05
def feature_medians(sensors: DataFrame) -> DataFrame:
    """``(i, median)`` exact per feature (see ``quantiles``)."""
    return exact_median(long_form(sensors, ()), ["i"], "v")


def mutual_information(sensors: DataFrame, y: str = "y", bins: int = 10) -> DataFrame:
    """Binned mutual information (nats) of each feature with the binary target.

    The reference uses a k-NN estimator; this is the documented
    SQL-checkable variant: median-fill missing values, cut each feature into
    ``bins`` equal-width bins between its min and max (last bin closed), then
    MI = sum p(b,y) ln(p(b,y) / (p(b) p(y))). All-missing features are dropped.
    """
    lf = long_form(sensors, ("unit_id", y))
    med = feature_medians(sensors)
    filled = lf.join(med, "i").withColumn("v", F.coalesce("v", "median"))
    rng = filled.groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
               ).otherwise(F.lit(0))
    cells = (filled.join(rng, "i").withColumn("b", b)
             .groupBy("i", "b", y).agg(F.count("*").alias("c"), F.first("n").alias("n")))
    wb = Window.partitionBy("i", "b")
    wy = Window.partitionBy("i", y)
    p = F.col("c") / F.col("n")
    pb = F.sum("c").over(wb) / F.col("n")
    py = F.sum("c").over(wy) / F.col("n")
    terms = cells.withColumn("t", p * F.log(p / (pb * py)))
    return terms.groupBy("i").agg(F.sum("t").alias("mutual_info")).select(
        "i", feature_name(F.col("i")).alias("feature"), "mutual_info")


# ---------------------------------------------------------------- AGG-06
def temporal_failure_rate(df: DataFrame, ts: str = "ts", fail: str = "fail", unit: str = "day") -> DataFrame:
    """Per time bin: n, fails, fail_rate; empty bins between the first and last
    bin are kept with n = 0, fails = 0, fail_rate NULL. Rows without a
    timestamp are dropped (FLT-04)."""
    d = df.filter(F.col(ts).isNotNull()).withColumn("bin", F.date_trunc(unit, F.col(ts)))
    counts = d.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.col(fail)).cast("long").alias("fails"))
    span = d.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    # the bin list is bounded by the time span (one row per bin), not by the data
    bins = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL 1 {unit.upper()}"))).alias("bin"))
    return (bins.join(counts, "bin", "left")
            .select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("fails", F.lit(0)).cast("long").alias("fails"))
            .withColumn("fail_rate", F.try_divide(F.col("fails").cast("double"), F.nullif(F.col("n"), F.lit(0)))))


# ---------------------------------------------------------------- AGG-07
def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """pandas ``describe()``: count, mean, std (ddof=1), min, 25/50/75 % (exact,
    linear interpolation), max per column, as rows ``(column, stat, value)``."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                         for c in cols])).alias("s")).select("s.column", "s.v")
    long = long.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    basic = long.groupBy("column").agg(F.count("v").cast("double").alias("count"), F.avg("v").alias("mean"),
                                       F.stddev_samp("v").alias("std"), F.min("v").alias("min"),
                                       F.max("v").alias("max"))
    basic_l = basic.select("column", F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in ("count", "mean", "std", "min", "max")
    ])).alias("s")).select("column", "s.stat", "s.value")
    q = exact_quantiles(long, ["column"], "v", [0.25, 0.5, 0.75])
    q_l = q.select("column", F.concat((F.col("p") * 100).cast("int").cast("string"), F.lit("%")).alias("stat"),
                   F.col("q").alias("value"))
    return basic_l.unionByName(q_l)


# ------------------------------------------------------------ AGG-08/10
def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """AGG-10/SRT-04: count per label, majority first (ties by label)."""
    return df.groupBy(label).agg(F.count("*").alias("count"))


def failure_mix(df: DataFrame, label: str = "label") -> DataFrame:
    """AGG-08/WIN-04: count and share of the total per label.
    The share divides by a one-row total (global aggregate), not a
    single-partition window."""
    c = label_counts(df, label)
    total = c.agg(F.sum("count")).scalar()
    return c.select(label, "count", (F.col("count") / total).alias("share"))


# ---------------------------------------------------------------- AGG-09
def overdispersion(df: DataFrame, col: str = "n_bad", group_cols=()) -> DataFrame:
    """Mean, sample variance and variance-to-mean ratio (NULL when mean <= 0)."""
    return (df.groupBy(*group_cols)
            .agg(F.avg(col).alias("mean"), F.var_samp(col).alias("var"))
            .withColumn("vmr", F.when(F.col("mean") > 0, F.col("var") / F.when(F.col("mean") > 0, F.col("mean")))))


# ---------------------------------------------------------------- AGG-11
def summary_stats(wafers: DataFrame, label: str = "label", unlabeled: str = "Unlabeled") -> DataFrame:
    """One row: totals, labelled fraction, classes, distinct dims, min/max dims
    (lexicographic on (rows, cols)), imbalance ratio max/min labelled class
    count (NULL with fewer than two classes)."""
    base = wafers.agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col(label) != unlabeled).alias("n_labeled"),
        F.count_if(F.col(label) == unlabeled).alias("n_unlabeled"),
        F.count_distinct(F.struct("rows", "cols")).alias("n_unique_dims"),
        F.min(F.struct("rows", "cols")).alias("min_dim"),
        F.max(F.struct("rows", "cols")).alias("max_dim"))
    per = wafers.filter(F.col(label) != unlabeled).groupBy(label).agg(F.count("*").alias("c"))
    base = base.select("*", per.agg(F.count("*")).scalar().alias("n_classes"),
                       per.agg(F.max("c")).scalar().alias("cmax"), per.agg(F.min("c")).scalar().alias("cmin"))
    return base.select(
        "n_total", "n_labeled", "n_unlabeled",
        F.bround(F.try_divide(F.col("n_labeled").cast("double"), F.col("n_total")), 4).alias("labeled_fraction"),
        "n_classes", "n_unique_dims",
        F.col("min_dim.rows").alias("min_rows"), F.col("min_dim.cols").alias("min_cols"),
        F.col("max_dim.rows").alias("max_rows"), F.col("max_dim.cols").alias("max_cols"),
        F.when(F.col("n_classes") >= 2, F.bround(F.col("cmax") / F.col("cmin"), 1)).alias("imbalance_ratio"))


# ---------------------------------------------------------------- AGG-13
def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins between the global min and max; the last bin is closed.
    Empty bins are listed with count 0 (bins come from a bounded sequence)."""
    rng = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    v = F.col(col)
    lo, hi = df.agg(F.min(col)).scalar(), df.agg(F.max(col)).scalar()
    b = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = (df.filter(v.isNotNull()).withColumn("bin", b)
              .groupBy("bin").agg(F.count("*").alias("count")))
    all_bins = rng.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    width = (F.col("hi") - F.col("lo")) / bins
    return (all_bins.join(counts, "bin", "left")
            .select("bin", (F.col("lo") + F.col("bin") * width).alias("left"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("right"),
                    F.coalesce("count", F.lit(0)).alias("count")))


def area_bins(df: DataFrame, col: str) -> int:
    """As many bins as distinct values, from 5 to 50."""
    return min(50, max(5, df.agg(F.countDistinct(col)).first()[0]))


# ------------------------------------------------------------ AGG-14..16
def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """AGG-14 ("balanced"): n / (k * count_c) per class."""
    c = df.groupBy(y).agg(F.count("*").alias("count"))
    n, k = c.agg(F.sum("count")).scalar(), c.agg(F.count("*")).scalar()
    return c.select(y, "count", (n / (k * F.col("count"))).alias("weight"))


def scale_pos_weight(df: DataFrame, y: str = "y") -> DataFrame:
    """AGG-15: n_neg / n_pos, 1.0 without positives."""
    pos = F.count_if(F.col(y) == 1)
    neg = F.count_if(F.col(y) != 1)
    return df.agg(F.coalesce(F.try_divide(neg.cast("double"), F.nullif(pos, F.lit(0))), F.lit(1.0))
                  .alias("scale_pos_weight"))


def inverse_frequency_weights(df: DataFrame, classes: list, y: str = "y") -> DataFrame:
    """AGG-16: w_c = n / count_c over the fixed class list, zero counts -> 1,
    then normalised to mean 1 over the class list."""
    cls = df.sparkSession.createDataFrame([(c,) for c in classes], f"{y} {_ddl_type(classes)}")
    c = df.groupBy(y).agg(F.count("*").alias("count"))
    n = df.agg(F.count("*")).scalar()
    w = (cls.join(c, y, "left")
         .withColumn("count", F.coalesce("count", F.lit(0)))
         .withColumn("raw", F.when(F.col("count") > 0, n / F.when(F.col("count") > 0, F.col("count")))
                     .otherwise(F.lit(1.0))))
    mean = w.agg(F.avg("raw")).scalar()
    return w.select(y, "count", (F.col("raw") / mean).alias("weight"))


def _ddl_type(values) -> str:
    if all(isinstance(v, bool) for v in values):
        return "boolean"
    if all(isinstance(v, int) for v in values):
        return "int"
    if all(isinstance(v, (int, float)) for v in values):
        return "double"
    return "string"


def dataset_summary(sensors: DataFrame) -> DataFrame:
    """DQ-06: n, features, pass, fail, pass:fail ratio, mean missing % per cell."""
    lf = long_form(sensors, ("unit_id", "y"))
    cells = lf.agg(F.count("*")).scalar()
    missing = lf.agg(F.count_if(F.col("v").isNull())).scalar()
    units = sensors.agg(F.count("*").alias("n_samples"), F.max(F.size("x")).alias("n_features"),
                        F.count_if(F.col("y") == 0).alias("n_pass"), F.count_if(F.col("y") == 1).alias("n_fail"))
    return units.select(
        "n_samples", "n_features", "n_pass", "n_fail",
        F.try_divide(F.col("n_pass").cast("double"), F.nullif(F.col("n_fail"), F.lit(0))).alias("pass_fail_ratio"),
        (missing * 100.0 / cells).alias("missing_pct"))
