"""Remaining inventory items: small operators with their own queries, and
named entries for items whose computation IS an existing query (the same
function and oracle registered under the item's id)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import yieldmodels as YM
from ..operators import evaluate as E
from ..operators import prep as PR
from ..operators import profile as P
from ..operators import score as S
from ..operators import smote as SM
from ..operators import wafer as W
from ..session import cut_computed, shared_dir
from ..sinks import reports as R
from ..sources import fixtures as FX
from ..sources import sensor_text as ST
from ..sources import tables as TB
from ..sources import wafer_table as WT
from .catalog import ORACLE, QUERIES, register
from .common import round_doubles, rsql
from .oracle_fixtures import with_ctes
from .sensor_queries import SMOTE_ENN


def _same(new: str, existing: str) -> None:
    register(new, ORACLE.get(existing))(QUERIES[existing])


_same("evl_10_threshold_sweep", "evl_03_pr_curve")
_same("jon_01_positional_join", "src_02_05_sensor_text_roundtrip")
_same("jon_07_area_model_product", "mdl_01_03_forward_yield")
_same("set_01_missing_columns", "dq_01_verify")
_same("set_03_union_synthetic", "res_05_smote_class_counts")
_same("snk_04_model_bundle_json", "mdl_16_bundle_roundtrip")
_same("spl_04_split_files", "snk_01_split_files")
_same("srt_03_configs_by_pr_auc", "trn_06_compare_configs")
_same("waf_05_curve_frame", "waf_03_yield_curve")
_same("win_02_leaderboard_rank", "mdl_10_leaderboard")
_same("win_04_share_of_total", "agg_08_failure_mix")


@register("dq_02_required_columns", with_ctes(["wafers"], "SELECT wafer_id, n_die FROM wafers"))
def _dq02(spark, sf):
    w = FX.wafers(spark, sf)
    WT.require_columns(w, WT.REQUIRED_COLUMNS)
    return W.with_summary(w).select("wafer_id", "n_die")


@register("prj_07_normalize_cells", rsql(with_ctes(["cells"], """
  SELECT wafer_id, sum(CAST(cell AS DOUBLE) / 2.0 * (r * 24 + c + 1)) AS checksum FROM cells GROUP BY wafer_id"""),
    ["checksum"]))
def _prj07(spark, sf):
    from ..functions.arrays import normalize_cells
    w = FX.wafers(spark, sf).select("wafer_id", normalize_cells("cells").alias("x"))
    return round_doubles(w.select("wafer_id", F.aggregate(F.transform("x", lambda v, i: v.cast("double") * (i + 1)),
                                                          F.lit(0.0), lambda a, b: a + b).alias("checksum")))


@register("prj_08_label_index", with_ctes(["labels6"], """
  SELECT wafer_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS y
  FROM labels6 WHERE label <> 'Unlabeled'"""))
def _prj08(spark, sf):
    lab = W.filter_labeled(W.with_labels(FX.raw_labels(spark, sf)), drop_none=False)
    # the class list: one row per class, size-checked, persisted with the model
    classes = [r[0] for r in lab.select("label").distinct().orderBy("label").limit(10_001).collect()]
    if len(classes) > 10_000:
        raise ValueError("too many classes")
    idx = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    return lab.select("wafer_id", "label", idx.cast("int").alias("y"))


@register("jon_04_class_lookup", rsql(with_ctes(["labels6"], """
  SELECT wafer_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS y,
         count(*) OVER () * 1.0 / (count(DISTINCT label) OVER () * count(*) OVER (PARTITION BY label)) AS weight
  FROM (SELECT * FROM labels6 WHERE label <> 'Unlabeled')""").replace(
    "count(DISTINCT label) OVER ()", "(SELECT count(DISTINCT label) FROM labels6 WHERE label <> 'Unlabeled')"),
    ["weight"]))
def _jon04(spark, sf):
    from ..operators.resample import with_class_weights
    lab = _prj08(spark, sf)
    return round_doubles(with_class_weights(lab, "label").select("wafer_id", "label", "y", "weight"))


@register("jon_05_knn_minority", with_ctes(["dense"], """
  SELECT qid, slot, nid FROM (
    SELECT a.unit_id AS qid, b.unit_id AS nid,
           CAST(row_number() OVER (PARTITION BY a.unit_id ORDER BY list_sum(list_transform(list_zip(a.x, b.x),
                lambda t: (t[1] - t[2]) * (t[1] - t[2]))), b.unit_id) - 1 AS INTEGER) AS slot
    FROM dense a JOIN dense b ON a.y = 1 AND b.y = 1 AND a.unit_id <> b.unit_id) WHERE slot < 5"""))
def _jon05(spark, sf):
    d = FX.dense_sensors(spark, sf)
    m = d.filter("y = 1")
    return SM.knn(m, m, 5).select("qid", "slot", "nid")


@register("jon_03_model_registry_lookup", with_ctes(["areas"], """
  SELECT r.model, r.n_params, count(*) AS n_rows
  FROM areas a, (VALUES ('poisson', 1), ('murphy', 1), ('negative_binomial', 2)) r(model, n_params)
  GROUP BY r.model, r.n_params"""))
def _jon03(spark, sf):
    reg = spark.createDataFrame([(m.name, m.n_params) for m in YM.MODELS.values()], "model string, n_params int")
    a = FX.areas(spark, sf).withColumn("model", F.explode(F.array(*[F.lit(m) for m in YM.MODEL_ORDER])))
    j = a.join(F.broadcast(reg), "model", "left")         # registry: one row per registered model
    bad = j.filter(F.col("n_params").isNull())
    if bad.limit(1).count():
        raise KeyError("unknown yield model in request")
    return j.groupBy("model", "n_params").agg(F.count("*").alias("n_rows"))


@register("mdl_04_model_interface", rsql(with_ctes(["areas"], """
  SELECT 'poisson' AS model, 1 AS n_params, sum(exp(-0.05 * area)) AS sum_yield_at_init FROM areas
  UNION ALL SELECT 'murphy', 1, sum(CASE WHEN 0.05 * area > 1e-12 THEN ((1 - exp(-0.05 * area)) / (0.05 * area))
                                           * ((1 - exp(-0.05 * area)) / (0.05 * area)) ELSE 1.0 END) FROM areas
  UNION ALL SELECT 'negative_binomial', 2, sum(pow(1 + 0.05 * area / 2.0, -2.0)) FROM areas"""),
    ["sum_yield_at_init"]))
def _mdl04(spark, sf):
    a = FX.areas(spark, sf)
    out = None
    for name in YM.MODEL_ORDER:
        m = YM.get_model(name)
        init = m.initial if m.n_params == 2 else (YM.D0_INIT,)
        y = m.predict(F.col("area"), F.lit(init[0]), F.lit(init[1]) if m.n_params == 2 else None)
        r = a.agg(F.sum(y).alias("sum_yield_at_init")).select(F.lit(name).alias("model"),
                                                              F.lit(m.n_params).alias("n_params"), "sum_yield_at_init")
        out = r if out is None else out.unionByName(r)
    return round_doubles(out)


@register("prj_15_missing_flags", with_ctes(["slong"], """
  SELECT s.unit_id, CAST(count(*) FILTER (WHERE s.v IS NULL) AS INTEGER) AS n_flags
  FROM slong s JOIN (SELECT i FROM slong GROUP BY i
                     HAVING avg(CAST(v IS NULL AS DOUBLE)) > 0.05 AND avg(CAST(v IS NULL AS DOUBLE)) < 1) f USING (i)
  GROUP BY s.unit_id"""))
def _prj15(spark, sf):
    s = FX.sensors(spark, sf)
    m = PR.fit(s)
    flags = F.slice(m.with_indicators(F.col("x")), 65, len(m.indicator_idx))
    return s.select("unit_id", F.size(F.filter(flags, lambda v: v == 1.0)).alias("n_flags"))


@register("prj_10_input_alignment", rsql(with_ctes(["slong"], """
  SELECT sum(coalesce(v, 0) * (i + 1)) AS checksum FROM slong GROUP BY unit_id"""), ["checksum"]))
def _prj10(spark, sf):
    names = FX.sensor_names()
    s = FX.sensors(spark, sf)
    wide = s.select(*[F.get("x", i).alias(n) for i, n in enumerate(names)])
    shuffled = wide.select(*sorted(names, key=lambda n: (int(n[-3:]) * 37) % 64))   # column order scrambled
    x = S.align_columns(shuffled, names)
    return round_doubles(x.select(F.aggregate(F.transform("x", lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1)),
                                              F.lit(0.0), lambda a, b: a + b).alias("checksum")))


@register("prj_03_target_remap", with_ctes(["slong"], """
  SELECT CASE WHEN y = 1 THEN 1 ELSE -1 END AS label_raw, y, count(*) AS count FROM units GROUP BY y""",
    [("units", "SELECT DISTINCT unit_id, y FROM slong")]))
def _prj03(spark, sf):
    from .ingest_queries import _write_f9
    _, l_ = _write_f9(spark, sf)
    lab = ST.read_sensor_labels(spark, l_)
    return (lab.select("label_raw", ST.remap_target(F.col("label_raw"), strict=True).alias("y"))
            .groupBy("label_raw", "y").agg(F.count("*").alias("count")))


@register("src_07_normalised_text", with_ctes(["slong"], """
  SELECT CAST(row_number() OVER (ORDER BY unit_id) - 1 AS BIGINT) AS line_idx, n_tokens, n_nan FROM (
    SELECT unit_id, count(*) AS n_tokens, count(*) FILTER (WHERE v IS NULL) AS n_nan FROM slong GROUP BY unit_id)"""))
def _src07(spark, sf):
    from .ingest_queries import _write_f9
    d, _ = _write_f9(spark, sf)
    toks = F.split(F.trim("value"), r"\s+")
    return ST.read_lines(spark, d).select("line_idx", F.size(toks).cast("long").alias("n_tokens"),
                                          F.size(F.filter(toks, lambda t: t == ST.MISSING_TOKEN)).cast("long")
                                          .alias("n_nan"))


@register("src_06_pick_column", with_ctes([], "SELECT o_orderkey AS order_id FROM orders"))
def _src06(spark, sf):
    o = TB.read_table(spark, sf, "orders")
    c = ST.pick_column(o.columns, ["ORDER_KEY", "O_ORDERKEY"])
    return o.select(F.col(c).alias("order_id"))


@register("set_02_distinct_values", with_ctes(["labels6", "rwafers"], """
  SELECT 'label' AS kind, label AS value FROM labels6 GROUP BY label
  UNION ALL SELECT 'dims', CAST("rows" AS VARCHAR) || 'x' || CAST(cols AS VARCHAR) FROM rwafers GROUP BY 2"""))
def _set02(spark, sf):
    lab = W.with_labels(FX.raw_labels(spark, sf)).select(F.lit("label").alias("kind"), F.col("label").alias("value"))
    dims = FX.ragged_wafers(spark, sf).select(F.lit("dims").alias("kind"),
                                              F.format_string("%dx%d", "rows", "cols").alias("value"))
    return lab.distinct().unionByName(dims.distinct())


@register("set_04_removed_by_enn", with_ctes(["dense"],
    "SELECT unit_id, y FROM sm WHERE unit_id IN (SELECT qid FROM nn3 WHERE nlabel <> qlabel)", SMOTE_ENN))
def _set04(spark, sf):
    base = cut_computed(SM.smote(FX.dense_sensors(spark, sf)))
    kept = SM.enn_filter(base)
    return base.join(kept.select("unit_id"), "unit_id", "left_anti").select("unit_id", "y")


@register("snk_06_report_tables", f"""
  SELECT i, feature, missing_count, missing_rate FROM ({ORACLE["srt_02_top_missing"]})
  UNION ALL SELECT i, feature, NULL, NULL FROM ({ORACLE["srt_01_top_associated"]})""")
def _snk06(spark, sf):
    s = FX.sensors(spark, sf)
    paths = R.write_tables({"top_missing": P.missingness(s).orderBy(F.col("missing_rate").desc(), "i").limit(20),
                            "top_associated": P.top_associated(P.point_biserial(s), 20)},
                           shared_dir(spark, "report-tables"))
    return round_doubles(spark.read.parquet(paths["top_missing"]).unionByName(
        spark.read.parquet(paths["top_associated"]).select("i", "feature", F.lit(None).cast("long").alias("missing_count"),
                                                           F.lit(None).cast("double").alias("missing_rate"))))


@register("snk_06_operating_points", " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, default_{m} AS "default", tuned_{m} AS tuned FROM ({ORACLE["evl_17_evaluation_report"]})"""
    for m in ("recall", "precision", "f1", "g_mean")))
def _snk06_points(spark, sf):
    points = E.operating_points(E.evaluation_report(FX.scored(spark, sf)))
    path = R.write_tables({"points": points}, shared_dir(spark, "operating-points"))["points"]
    return round_doubles(spark.read.parquet(path))


@register("set_01_missing_features", with_ctes(["slong"], """
  SELECT unit_id AS request_id, CAST(0 AS INTEGER) AS row_idx, CAST(count(*) AS INTEGER) AS n_missing,
         array_to_string(list(printf('feature_%03d', i) ORDER BY i)[1:5], ',') AS first_missing
  FROM slong WHERE v IS NULL GROUP BY unit_id"""))
def _set01_features(spark, sf):
    found = S.missing_features(FX.sparse_records(spark, sf), FX.sensor_names())
    return found.withColumn("first_missing", F.array_join("first_missing", ","))
