"""Queries over profiling operators (sensor matrix F2, wafers F1/F1b, labels F6, timeline F5)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import wafer as W
from ..operators.mutual_info import neighbour_mutual_information
from ..operators.quantiles import exact_quantiles
from ..sources import fixtures as FX
from .catalog import register
from .common import round_doubles, rsql
from .oracle_fixtures import neighbour_mi_sql, with_ctes


def _sensors(spark, sf):
    return FX.sensors(spark, sf)


# ------------------------------------------------------------ sensor stats
@register("agg_01_class_balance", rsql(with_ctes(["units"], """
  SELECT count(*) FILTER (WHERE y = 0) AS n_pass, count(*) FILTER (WHERE y = 1) AS n_fail,
         CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) / count(*) AS fail_rate,
         CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE y = 1), 0) AS imbalance_ratio
  FROM units"""), ["fail_rate", "imbalance_ratio"]))
def _agg01(spark, sf):
    return round_doubles(P.class_balance(_sensors(spark, sf)))


@register("agg_18_class_balance_by_day", rsql(with_ctes(["units"], """
  SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day,
         count(*) FILTER (WHERE y = 0) AS n_pass, count(*) FILTER (WHERE y = 1) AS n_fail,
         CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) / count(*) AS fail_rate,
         CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE y = 1), 0) AS imbalance_ratio
  FROM units GROUP BY 1"""), ["fail_rate", "imbalance_ratio"]))
def _agg18(spark, sf):
    s = _sensors(spark, sf).withColumn("day", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd"))
    return round_doubles(P.class_balance(s, group_cols=["day"]))


_MISS = """
  SELECT i, printf('feature_%03d', i) AS feature, count(*) FILTER (WHERE v IS NULL) AS missing_count,
         CAST(count(*) FILTER (WHERE v IS NULL) AS DOUBLE) / count(*) AS missing_rate
  FROM slong GROUP BY i"""


@register("agg_02_missingness", rsql(with_ctes(["slong"], _MISS), ["missing_rate"]))
def _agg02(spark, sf):
    return round_doubles(P.missingness(_sensors(spark, sf)))


@register("srt_02_top_missing", rsql(with_ctes(["slong"], f"""
  SELECT * FROM ({_MISS}) ORDER BY missing_rate DESC, i LIMIT 20"""), ["missing_rate"]))
def _srt02(spark, sf):
    m = P.missingness(_sensors(spark, sf))
    return round_doubles(m.orderBy(F.col("missing_rate").desc(), "i").limit(20))


@register("flt_05_high_missing", rsql(with_ctes(["slong"], f"SELECT * FROM ({_MISS}) WHERE missing_rate > 0.5"),
                                      ["missing_rate"]))
def _flt05(spark, sf):
    return round_doubles(P.high_missing_features(P.missingness(_sensors(spark, sf)), 0.5))


_VAR = """
  SELECT i, printf('feature_%03d', i) AS feature, var_samp(v) AS variance, count(DISTINCT v) AS n_unique,
         coalesce(var_samp(v) <= 1e-8, false) OR count(DISTINCT v) <= 1 AS is_dead
  FROM slong GROUP BY i"""


@register("agg_03_variance", rsql(with_ctes(["slong"], _VAR), ["variance"]))
def _agg03(spark, sf):
    return round_doubles(P.variance_report(_sensors(spark, sf)))


@register("flt_05_dead_features", with_ctes(["slong"], f"SELECT i, feature FROM ({_VAR}) WHERE is_dead"))
def _flt05d(spark, sf):
    return P.dead_features(P.variance_report(_sensors(spark, sf))).select("i", "feature")


_PB = """
  SELECT i, printf('feature_%03d', i) AS feature, r AS point_biserial, abs(r) AS abs_corr FROM (
    SELECT i, CASE WHEN stddev_samp(v) * stddev_samp(y) = 0 THEN NULL
                   ELSE covar_samp(v, y) / (stddev_samp(v) * stddev_samp(y)) END AS r
    FROM slong WHERE v IS NOT NULL GROUP BY i)"""


@register("agg_04_point_biserial", rsql(with_ctes(["slong"], _PB), ["point_biserial", "abs_corr"]))
def _agg04(spark, sf):
    return round_doubles(P.point_biserial(_sensors(spark, sf)))


@register("srt_01_top_associated", rsql(with_ctes(["slong"], f"""
  SELECT * FROM ({_PB}) ORDER BY abs_corr DESC NULLS LAST, i LIMIT 20"""), ["point_biserial", "abs_corr"]))
def _srt01(spark, sf):
    return round_doubles(P.top_associated(P.point_biserial(_sensors(spark, sf)), 20))


_MED = "SELECT i, quantile_cont(v, 0.5) AS median FROM slong WHERE v IS NOT NULL GROUP BY i"


@register("fit_03_feature_medians", rsql(with_ctes(["slong"], _MED), ["median"]))
def _fit03(spark, sf):
    return round_doubles(P.feature_medians(_sensors(spark, sf)))


@register("agg_05_mutual_info_binned", rsql(with_ctes(["slong"], """
  SELECT i, printf('feature_%03d', i) AS feature, sum(t) AS mutual_info FROM (
    SELECT i, c * 1.0 / n * ln((c * 1.0 / n) / ((sum(c) OVER (PARTITION BY i, b) * 1.0 / n)
                                             * (sum(c) OVER (PARTITION BY i, y) * 1.0 / n))) AS t
    FROM (SELECT i, b, y, count(*) AS c, any_value(n) AS n FROM (
            SELECT f.i, f.y, r.n,
                   CASE WHEN r.hi > r.lo THEN least(floor((f.v - r.lo) / (r.hi - r.lo) * 10), 9) ELSE 0 END AS b
            FROM filled f JOIN (SELECT i, min(v) AS lo, max(v) AS hi, count(*) AS n FROM filled GROUP BY i) r USING (i))
          GROUP BY i, b, y))
  GROUP BY i""", [("med", _MED),
                  ("filled", "SELECT s.i, s.y, coalesce(s.v, m.median) AS v FROM slong s JOIN med m USING (i)")]),
    ["mutual_info"]))
def _agg05(spark, sf):
    return round_doubles(P.mutual_information(_sensors(spark, sf)))


@register("agg_05_mutual_info_neighbours", rsql(with_ctes(["units", "slong"], """
  SELECT i, printf('feature_%03d', i) AS feature, mutual_info FROM mi""", [("med", _MED),
    ("filled", "SELECT s.i, s.y, s.unit_id, coalesce(s.v, m.median) AS v FROM slong s JOIN med m USING (i)")]
    + neighbour_mi_sql("filled", "unit_id")), ["mutual_info"]))
def _agg05n(spark, sf):
    mi = neighbour_mutual_information(_sensors(spark, sf))
    return round_doubles(mi.select("i", P.feature_name(F.col("i")).alias("feature"), "mutual_info"))


@register("dq_06_dataset_summary", rsql(with_ctes(["slong"], """
  SELECT (SELECT count(*) FROM units) AS n_samples, (SELECT CAST(max(i) + 1 AS INTEGER) FROM slong) AS n_features,
         (SELECT count(*) FROM units WHERE y = 0) AS n_pass, (SELECT count(*) FROM units WHERE y = 1) AS n_fail,
         (SELECT CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE y = 1), 0) FROM units)
           AS pass_fail_ratio,
         (SELECT count(*) FILTER (WHERE v IS NULL) * 100.0 / count(*) FROM slong) AS missing_pct""",
    [("units", "SELECT DISTINCT unit_id, y FROM slong")]), ["pass_fail_ratio", "missing_pct"]))
def _dq06(spark, sf):
    return round_doubles(P.dataset_summary(_sensors(spark, sf)))


@register("agg_14_class_weights", rsql(with_ctes(["units"], """
  SELECT y, count(*) AS count, (SELECT count(*) FROM units) * 1.0 / ((SELECT count(DISTINCT y) FROM units) * count(*)) AS weight
  FROM units GROUP BY y"""), ["weight"]))
def _agg14(spark, sf):
    return round_doubles(P.class_weights(_sensors(spark, sf)))


@register("agg_15_scale_pos_weight", rsql(with_ctes(["units"], """
  SELECT coalesce(CAST(count(*) FILTER (WHERE y <> 1) AS DOUBLE) / nullif(count(*) FILTER (WHERE y = 1), 0), 1.0)
         AS scale_pos_weight FROM units"""), ["scale_pos_weight"]))
def _agg15(spark, sf):
    return round_doubles(P.scale_pos_weight(_sensors(spark, sf)))


@register("agg_16_inverse_frequency_weights", rsql(with_ctes(["mc_long"], """
  SELECT c.y, coalesce(n.cnt, 0) AS count,
         (CASE WHEN coalesce(n.cnt, 0) > 0 THEN (SELECT count(DISTINCT id) FROM mc_long) * 1.0 / n.cnt ELSE 1.0 END)
         / avg(CASE WHEN coalesce(n.cnt, 0) > 0 THEN (SELECT count(DISTINCT id) FROM mc_long) * 1.0 / n.cnt ELSE 1.0 END)
           OVER () AS weight
  FROM (SELECT CAST(range AS INTEGER) AS y FROM range(12)) c
  LEFT JOIN (SELECT y, count(DISTINCT id) AS cnt FROM mc_long GROUP BY y) n USING (y)"""), ["weight"]))
def _agg16(spark, sf):
    # class list 0..11: two classes never occur, their weight stays 1 before normalising
    return round_doubles(P.inverse_frequency_weights(FX.multiclass(spark, sf), list(range(12))))


@register("agg_13_missing_rate_histogram", rsql(with_ctes(["slong"], f"""
  SELECT b.bin, r.lo + b.bin * (r.hi - r.lo) / 30 AS "left", r.lo + (b.bin + 1) * (r.hi - r.lo) / 30 AS "right",
         coalesce(c.count, 0) AS count
  FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) b
  CROSS JOIN (SELECT min(missing_rate) AS lo, max(missing_rate) AS hi FROM m) r
  LEFT JOIN (SELECT CAST(CASE WHEN x.hi > x.lo THEN least(floor((m.missing_rate - x.lo) / (x.hi - x.lo) * 30), 29)
                              ELSE 0 END AS INTEGER) AS bin, count(*) AS count
             FROM m, (SELECT min(missing_rate) AS lo, max(missing_rate) AS hi FROM m) x GROUP BY 1) c USING (bin)""",
    [("m", _MISS)]), ["left", "right"]))
def _agg13(spark, sf):
    return round_doubles(P.histogram(P.missingness(_sensors(spark, sf)), "missing_rate", 30))


def _hist_sql(source: str, col: str, bins: str) -> str:
    """Equal-width bins of ``col``, the last one closed; empty bins are listed."""
    return f"""
  SELECT b.bin, r.lo + b.bin * (r.hi - r.lo) / r.n AS "left", r.lo + (b.bin + 1) * (r.hi - r.lo) / r.n AS "right",
         coalesce(c.count, 0) AS count
  FROM (SELECT min({col}) AS lo, max({col}) AS hi, {bins} AS n FROM {source}) r
  JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(50)) b ON b.bin < r.n
  LEFT JOIN (SELECT CAST(CASE WHEN x.hi > x.lo THEN least(floor((m.{col} - x.lo) / (x.hi - x.lo) * x.n), x.n - 1)
                              ELSE 0 END AS INTEGER) AS bin, count(*) AS count
             FROM {source} m, (SELECT min({col}) AS lo, max({col}) AS hi, {bins} AS n FROM {source}) x
             WHERE m.{col} IS NOT NULL GROUP BY 1) c USING (bin)"""


@register("agg_13_defect_rate_histogram", rsql(with_ctes(["rwafers"], _hist_sql("dr", "defect_rate", "40"), [("dr", """
  SELECT CASE WHEN n_die > 0 THEN CAST(n_bad AS DOUBLE) / n_die END AS defect_rate FROM rwafers""")]), ["left", "right"]))
def _agg13_defects(spark, sf):
    return round_doubles(P.histogram(W.with_summary(FX.ragged_wafers(spark, sf)), "defect_rate", 40))


@register("agg_13_map_area_histogram", rsql(with_ctes(["rwafers"],
          _hist_sql("ma", "area", "least(50, greatest(5, count(DISTINCT area)))"),
          [("ma", 'SELECT CAST("rows" * cols AS DOUBLE) AS area FROM rwafers')]), ["left", "right"]))
def _agg13_area(spark, sf):
    w = FX.ragged_wafers(spark, sf).select((F.col("rows") * F.col("cols")).cast("double").alias("area"))
    return round_doubles(P.histogram(w, "area", P.area_bins(w, "area")))


# ------------------------------------------------------------ wafer stats
_DESC_COLS = ["n_die", "n_bad", "defect_rate"]


def _desc_sql() -> str:
    parts = []
    for stat, expr in [("count", "CAST(count(v) AS DOUBLE)"), ("mean", "avg(v)"), ("std", "stddev_samp(v)"),
                       ("min", "min(v)"), ("max", "max(v)"), ("25%", "quantile_cont(v, 0.25)"),
                       ("50%", "quantile_cont(v, 0.5)"), ("75%", "quantile_cont(v, 0.75)")]:
        parts.append(f"SELECT \"column\", '{stat}' AS stat, {expr} AS value FROM dl GROUP BY \"column\"")
    return " UNION ALL ".join(parts)


@register("agg_07_wafer_describe", rsql(with_ctes(["rwafers"], _desc_sql(), [("dl", """
  SELECT 'n_die' AS "column", CAST(n_die AS DOUBLE) AS v FROM rwafers
  UNION ALL SELECT 'n_bad', CAST(n_bad AS DOUBLE) FROM rwafers
  UNION ALL SELECT 'defect_rate', CAST(n_bad AS DOUBLE) / n_die FROM rwafers WHERE n_die > 0""")]), ["value"]))
def _agg07(spark, sf):
    s = W.with_summary(FX.ragged_wafers(spark, sf))
    return round_doubles(P.describe(s, _DESC_COLS))


@register("agg_09_overdispersion", rsql(with_ctes(["rwafers"], """
  SELECT avg(n_bad) AS mean, var_samp(n_bad) AS var,
         CASE WHEN avg(n_bad) > 0 THEN var_samp(n_bad) / avg(n_bad) END AS vmr FROM rwafers"""),
    ["mean", "var", "vmr"]))
def _agg09(spark, sf):
    return round_doubles(P.overdispersion(W.with_summary(FX.ragged_wafers(spark, sf))))


@register("agg_09_overdispersion_by_lot", rsql(with_ctes(["rwafers"], """
  SELECT 'lot' || CAST(wafer_id % 10 AS VARCHAR) AS lot_name, avg(n_bad) AS mean, var_samp(n_bad) AS var,
         CASE WHEN avg(n_bad) > 0 THEN var_samp(n_bad) / avg(n_bad) END AS vmr FROM rwafers GROUP BY 1"""),
    ["mean", "var", "vmr"]))
def _agg09l(spark, sf):
    return round_doubles(P.overdispersion(W.with_summary(FX.ragged_wafers(spark, sf)), group_cols=["lot_name"]))


@register("agg_13_n_die_histogram", rsql(with_ctes(["rwafers"], """
  SELECT b.bin, r.lo + b.bin * (r.hi - r.lo) / 40 AS "left", r.lo + (b.bin + 1) * (r.hi - r.lo) / 40 AS "right",
         coalesce(c.count, 0) AS count
  FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(40)) b
  CROSS JOIN (SELECT CAST(min(n_die) AS DOUBLE) AS lo, CAST(max(n_die) AS DOUBLE) AS hi FROM rwafers) r
  LEFT JOIN (SELECT CAST(CASE WHEN x.hi > x.lo THEN least(floor((w.n_die - x.lo) / (x.hi - x.lo) * 40), 39)
                              ELSE 0 END AS INTEGER) AS bin, count(*) AS count
             FROM rwafers w, (SELECT CAST(min(n_die) AS DOUBLE) AS lo, CAST(max(n_die) AS DOUBLE) AS hi FROM rwafers) x
             GROUP BY 1) c USING (bin)"""), ["left", "right"]))
def _agg13w(spark, sf):
    s = W.with_summary(FX.ragged_wafers(spark, sf)).withColumn("n_die", F.col("n_die").cast("double"))
    return round_doubles(P.histogram(s, "n_die", 40))


# ------------------------------------------------------------------ labels
@register("agg_10_class_distribution", with_ctes(["labels6"], "SELECT label, count(*) AS count FROM labels6 GROUP BY label"))
def _agg10(spark, sf):
    return P.label_counts(W.with_labels(FX.raw_labels(spark, sf)))


@register("srt_04_majority_order", with_ctes(["labels6"], """
  SELECT label, count, row_number() OVER (ORDER BY count DESC, label) AS position
  FROM (SELECT label, count(*) AS count FROM labels6 GROUP BY label)"""))
def _srt04(spark, sf):
    c = P.label_counts(W.with_labels(FX.raw_labels(spark, sf)))
    # one row per class: the global window runs over a handful of rows
    return c.withColumn("position", F.row_number().over(Window.orderBy(F.col("count").desc(), "label")).cast("bigint"))


@register("agg_08_failure_mix", rsql(with_ctes(["labels6"], """
  SELECT label, count, count * 1.0 / sum(count) OVER () AS share
  FROM (SELECT CASE WHEN label = 'Unlabeled' THEN 'unlabeled' ELSE label END AS label, count(*) AS count
        FROM labels6 GROUP BY 1)"""), ["share"]))
def _agg08(spark, sf):
    return round_doubles(P.failure_mix(W.with_labels(FX.raw_labels(spark, sf), token="unlabeled")))


@register("win_03_first_k_per_class", with_ctes(["labels6"], """
  SELECT wafer_id, label FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY wafer_id) AS rn FROM labels6) WHERE rn <= 3"""))
def _win03(spark, sf):
    l = W.with_labels(FX.raw_labels(spark, sf))
    w = Window.partitionBy("label").orderBy("wafer_id")
    return l.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 3).select("wafer_id", "label")


@register("agg_11_summary_stats", rsql(with_ctes(["rwafers", "labels6"], """
  SELECT count(*) AS n_total, count(*) FILTER (WHERE label <> 'Unlabeled') AS n_labeled,
         count(*) FILTER (WHERE label = 'Unlabeled') AS n_unlabeled,
         round_even(CAST(count(*) FILTER (WHERE label <> 'Unlabeled') AS DOUBLE) / count(*), 4) AS labeled_fraction,
         (SELECT count(DISTINCT label) FROM lw WHERE label <> 'Unlabeled') AS n_classes,
         count(DISTINCT ("rows", cols)) AS n_unique_dims,
         (SELECT "rows" FROM lw ORDER BY "rows", cols LIMIT 1) AS min_rows,
         (SELECT cols FROM lw ORDER BY "rows", cols LIMIT 1) AS min_cols,
         (SELECT "rows" FROM lw ORDER BY "rows" DESC, cols DESC LIMIT 1) AS max_rows,
         (SELECT cols FROM lw ORDER BY "rows" DESC, cols DESC LIMIT 1) AS max_cols,
         (SELECT CASE WHEN count(*) >= 2 THEN round_even(max(c) * 1.0 / min(c), 1) END
          FROM (SELECT label, count(*) AS c FROM lw WHERE label <> 'Unlabeled' GROUP BY label)) AS imbalance_ratio
  FROM lw""", [("lw", """SELECT w.wafer_id, w."rows", w.cols, coalesce(l.label, 'Unlabeled') AS label
                         FROM rwafers w LEFT JOIN labels6 l USING (wafer_id)""")]),
    ["labeled_fraction", "imbalance_ratio"]))
def _agg11(spark, sf):
    w = W.with_labels(FX.ragged_wafers(spark, sf).join(FX.raw_labels(spark, sf), "wafer_id", "left"))
    return round_doubles(P.summary_stats(w))


# ---------------------------------------------------------------- timeline
@register("agg_06_temporal_failure_rate", rsql(with_ctes(["timeline_b"], """
  SELECT strftime(d.bin, '%Y-%m-%d') AS bin, coalesce(c.n, 0) AS n, CAST(coalesce(c.fails, 0) AS BIGINT) AS fails,
         CAST(c.fails AS DOUBLE) / nullif(c.n, 0) AS fail_rate
  FROM (SELECT unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), INTERVAL 1 DAY)) AS bin
        FROM timeline_b) d
  LEFT JOIN (SELECT date_trunc('day', ts) AS bin, count(*) AS n, sum(fail) AS fails FROM timeline_b GROUP BY 1) c
  ON c.bin = d.bin"""), ["fail_rate"]))
def _agg06(spark, sf):
    t = P.temporal_failure_rate(FX.timeline(spark, sf, drop_days=True))
    return round_doubles(t.withColumn("bin", F.date_format("bin", "yyyy-MM-dd")))


@register("agg_07_exact_quantiles_lineitem", rsql(" UNION ALL ".join(
    f"SELECT l_returnflag, {p} AS p, quantile_cont(l_extendedprice, {p}) AS q FROM lineitem GROUP BY l_returnflag"
    for p in ("0.1", "0.5", "0.9")), ["p", "q"]))
def _quant(spark, sf):
    from ..sources.tables import read_table
    li = read_table(spark, sf, "lineitem", ["l_returnflag", "l_extendedprice"])
    return round_doubles(exact_quantiles(li, ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9], max_collect=1000))
