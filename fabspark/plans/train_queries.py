"""Training / selection / scoring queries. Fitted models are rows-only; what they are fitted from (fold members
and statistics, balanced draws, gains of the first split, permutations) is compared with SQL.

All run with the operators' defaults: ``train.DEFAULT_PARAMS``, 5 folds, 25 draws (or
the whole grid, if smaller), the five ``DEFAULT_CONFIGS``, 100 trees on maps of the
reference's default size (64x64)."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import prep as PR
from ..operators import score as S
from ..operators import split as SP
from ..operators import train as TR
from ..operators import trees as T
from ..operators import wafer as W
from ..session import ROWS_A_PART, cut_computed, cut_lineage, shared_dir
from ..sinks import model_store as MS
from ..sources import fixtures as FX
from . import sensor_plan as SPL
from .catalog import register
from .common import round_doubles, rsql
from .oracle_fixtures import h60, with_ctes
from .sensor_queries import _SPLIT1, _rank


def _split(spark, sf):
    s = SP.stratified_split(FX.sensors(spark, sf)).cache()
    return s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")


def _fit_predict(spark, sf, est, strat):
    train, test = _split(spark, sf)
    m = TR.fit_sensor_model(train, est, strat)
    return round_doubles(m.predict_frame(test).select("unit_id", "y", "fail_proba", "decision", "label"))


register("trn_01_logreg")(lambda spark, sf: _fit_predict(spark, sf, "logreg", "class_weight"))
register("trn_02_balanced_rf")(lambda spark, sf: _fit_predict(spark, sf, "balanced_rf", "none"))
register("trn_03_hist_gb")(lambda spark, sf: _fit_predict(spark, sf, "hist_gb", "class_weight"))
register("trn_04_xgboost")(lambda spark, sf: _fit_predict(spark, sf, "xgboost", "none"))


@register("trn_05_cross_validate")
def _trn05(spark, sf):
    train, _ = _split(spark, sf)
    met, _ = TR.cross_validate(train, "logreg", "class_weight")
    return round_doubles(TR.cv_summary(met, "logreg", "class_weight"))


# Rows of the training split with their fold, by seeded rank inside the class.
_TRAIN_FOLDS = _SPLIT1 + [
    ("tu", "SELECT unit_id, y FROM split1 WHERE split = 'train'"),
    ("tc", "SELECT y, count(*) AS n_c FROM tu GROUP BY y"),
    ("tr_rank", f"SELECT unit_id, y, {_rank('unit_id', 'y')} AS rk FROM tu"),
    ("folds", """SELECT u.unit_id, u.y, CAST((u.rk - 1 + coalesce((SELECT sum(c.n_c) FROM tc c WHERE c.y < u.y), 0)) % 5 AS INTEGER) AS fold
                 FROM tr_rank u"""),
]
# The steps of the preparation for the rows outside each fold ``f``.
_FOLD_FIT = _TRAIN_FOLDS + [
    ("ft", "SELECT o.f, s.unit_id, s.i, s.v FROM slong s JOIN folds d USING (unit_id), (SELECT CAST(range AS INTEGER) AS f FROM range(5)) o WHERE d.fold <> o.f"),
    ("rates", "SELECT f, i, CAST(count(*) FILTER (WHERE v IS NULL) AS DOUBLE) / count(*) AS rate FROM ft GROUP BY f, i"),
    ("med", "SELECT f, i, quantile_cont(v, 0.5) AS median FROM ft WHERE v IS NOT NULL GROUP BY f, i"),
    ("cols", """SELECT t.f, printf('feature_%03d', t.i) AS feature, coalesce(t.v, m.median) AS v
                FROM ft t JOIN rates r USING (f, i) JOIN med m USING (f, i) WHERE r.rate <= 0.5
                UNION ALL
                SELECT t.f, printf('feature_%03d__missing', t.i), CASE WHEN t.v IS NULL THEN 1.0 ELSE 0.0 END
                FROM ft t JOIN rates r USING (f, i) WHERE r.rate > 0.05 AND r.rate < 1"""),
]


@register("trn_05_fold_members", with_ctes(["units", "slong"], "SELECT unit_id, y, fold FROM folds", _TRAIN_FOLDS))
def _trn05_members(spark, sf):
    train, _ = _split(spark, sf)
    return SP.stratified_folds(train, 5).select("unit_id", "y", "fold")


@register("trn_05_fold_statistics", rsql(with_ctes(["units", "slong"], """
  SELECT f AS fold, feature, median(v) AS median, avg(v) AS mean, stddev_pop(v) AS std
  FROM cols GROUP BY f, feature HAVING var_pop(v) > 1e-8""", _FOLD_FIT), ["median", "mean", "std"]))
def _trn05_statistics(spark, sf):
    train, _ = _split(spark, sf)
    preps = PR.fit_folds(SP.stratified_folds(train, 5), 5)
    rows = [(f, name, m.medians[p], mean, std) for f, m in enumerate(preps)              # one row a fold and feature
            for name, p, mean, std in zip(m.feature_names, m.keep_var, m.means, m.stds)]
    return round_doubles(spark.createDataFrame(rows, "fold int, feature string, median double, mean double, std double"))


@register("trn_02_balanced_draws", with_ctes(["units", "slong"], f"""
  SELECT CAST(d.tree AS INTEGER) AS tree, d.y, count(*) AS rows_drawn, count(DISTINCT u.unit_id) AS distinct_rows, CAST(sum(u.unit_id) AS BIGINT) AS id_sum
  FROM (SELECT t.tree, c.y, {h60("CAST(t.tree AS VARCHAR) || ':' || CAST(c.y AS VARCHAR) || ':' || CAST(j.j AS VARCHAR) || ':42'")} % c.n_c + 1 AS rk
        FROM tc c, (SELECT range AS tree FROM range(300)) t, (SELECT unnest(range(1, (SELECT min(n_c) FROM tc) + 1)) AS j) j) d
  JOIN tr_rank u USING (y, rk) GROUP BY d.tree, d.y""", _TRAIN_FOLDS))
def _trn02_draws(spark, sf):
    train, _ = _split(spark, sf)
    rows = train.select(F.lit(0).alias("frame"), "unit_id", "y")
    draws = T.balanced_draws(rows, TR.DEFAULT_PARAMS["balanced_rf"]["n_estimators"])
    return draws.groupBy("tree", "y").agg(F.sum("copies").alias("rows_drawn"), F.count(F.lit(1)).alias("distinct_rows"),
                                          F.sum(F.col("copies") * F.col("unit_id")).alias("id_sum"))


_GAINS = _TRAIN_FOLDS + [
    ("t", "SELECT s.* FROM slong s JOIN tu USING (unit_id)"),
    ("p", "SELECT avg(y) AS p FROM tu"),
    ("span", "SELECT i, min(v) AS lo, max(v) AS hi FROM t WHERE v IS NOT NULL GROUP BY i"),
    ("b", """SELECT t.i, t.y, CASE WHEN hi > lo THEN least(floor((t.v - lo) / (hi - lo) * 32), 31) ELSE 0 END AS bin
             FROM t JOIN span USING (i) WHERE t.v IS NOT NULL"""),
    ("g", "SELECT i, bin, sum(y - p) AS g, sum(p * (1 - p)) AS h FROM b, p GROUP BY i, bin"),
    ("c", """SELECT i, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY i) AS gt, sum(h) OVER (PARTITION BY i) AS ht
             FROM g WINDOW w AS (PARTITION BY i ORDER BY bin)"""),
]


@register("trn_03_root_gains", rsql(with_ctes(["units", "slong"], """
  SELECT CAST(i AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin,
         CASE WHEN hl >= 1e-3 AND ht - hl >= 1e-3 THEN gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1) END AS gain
  FROM c""", _GAINS), ["gain"]))
def _trn03_gains(spark, sf):
    train, _ = _split(spark, sf)
    return round_doubles(T.root_gains(train, x="x"))


@register("trn_06_compare_configs")
def _trn06(spark, sf):
    train, _ = _split(spark, sf)
    return round_doubles(TR.compare_configs(train))


@register("trn_07_tune")
def _trn07(spark, sf):
    train, _ = _split(spark, sf)
    _, best, score, table = TR.tune(train, "logreg", "class_weight")
    return round_doubles(table)


@register("trn_08_oof_threshold")
def _trn08(spark, sf):
    train, _ = _split(spark, sf)
    _, oof = TR.cross_validate(train, "logreg", "class_weight")
    return round_doubles(E.tune_f1(E.curve_points(oof)))


@register("trn_09_fit_threshold_evaluate")
def _trn09(spark, sf):
    train, test = _split(spark, sf)
    _, report, _ = TR.fit_select_threshold_evaluate(train, test, "logreg", "class_weight")
    return round_doubles(report)


@register("trn_10_holdout_comparison")
def _trn10(spark, sf):
    train, test = _split(spark, sf)
    return TR.holdout_comparison(train, test)


@register("trn_11_sensor_run")
def _trn11(spark, sf):
    r = SPL.run(spark, FX.sensors(spark, sf), "logreg", "smote_enn")
    return round_doubles(r.predictions)


@register("evl_11_feature_importance")
def _evl11(spark, sf):
    train, _ = _split(spark, sf)
    return round_doubles(TR.feature_importance(TR.fit_sensor_model(train, "logreg", "class_weight")))


# A fixed linear score stands for the model: drop of its average precision when one slot is permuted.
_PERMUTED = _SPLIT1 + [
    ("tt", "SELECT unit_id, y FROM split1 WHERE split = 'test'"),
    ("wide", "SELECT s.unit_id, t.y, s.i, s.v FROM slong s JOIN tt t USING (unit_id) WHERE s.i < 4"),
    ("base", f"SELECT unit_id, y, {_rank('unit_id', None)} AS rk FROM tt"),
    ("pairs", "SELECT CAST(a.range AS INTEGER) AS feature, CAST(b.range AS INTEGER) AS repeat FROM range(4) a, range(10) b"),
    ("donor", f"""SELECT feature, repeat, unit_id, row_number() OVER (PARTITION BY feature, repeat ORDER BY {h60("nm || ':43'")}, nm) AS rk
                  FROM (SELECT p.feature, p.repeat, t.unit_id, CAST(t.unit_id AS VARCHAR) || ':' || CAST(p.feature AS VARCHAR) || ':' || CAST(p.repeat AS VARCHAR) AS nm
                        FROM tt t, pairs p)"""),
    ("given", """SELECT d.feature, d.repeat, b.unit_id, b.y, w.i, CASE WHEN w.i = d.feature THEN x.v ELSE w.v END AS v
                 FROM donor d JOIN base b USING (rk) JOIN wide w ON w.unit_id = b.unit_id JOIN wide x ON x.unit_id = d.unit_id AND x.i = w.i
                 UNION ALL SELECT -1, 0, unit_id, y, i, v FROM wide"""),
    ("scores", "SELECT feature, repeat, unit_id, y, round(sum((i + 1) * coalesce(v, 0)), 4) AS s FROM given GROUP BY ALL"),
    ("per", "SELECT feature, repeat, s, sum(y) AS tp, count(*) AS n FROM scores GROUP BY ALL"),
    ("cum", "SELECT *, sum(tp) OVER w AS tps, sum(n) OVER w AS ns FROM per WINDOW w AS (PARTITION BY feature, repeat ORDER BY s DESC)"),
    ("ap", "SELECT feature, repeat, sum(CAST(tp AS DOUBLE) * tps / ns) / sum(tp) AS ap FROM cum GROUP BY ALL"),
]


@dataclass
class _FixedScore:
    prep: PR.PrepModel

    def score(self, df):
        terms = [F.coalesce(F.get("x", i), F.lit(0.0)) * (i + 1) for i in range(4)]
        return df.withColumn("score", F.round(sum(terms[1:], terms[0]), 4))


@register("evl_11_permutation_importance", rsql(with_ctes(["units", "slong"], """
  SELECT printf('feature_%03d', a.feature) AS feature, avg(b.ap - a.ap) AS importance, stddev_pop(b.ap - a.ap) AS std, 'permutation' AS method
  FROM ap a, (SELECT ap FROM ap WHERE feature = -1) b WHERE a.feature >= 0 GROUP BY a.feature""", _PERMUTED), ["importance", "std"]))
def _evl11_permutation(spark, sf):
    _, test = _split(spark, sf)
    names = [f"feature_{i:03d}" for i in range(64)]
    fixed = _FixedScore(PR.PrepModel(names, [], [], [], [], [], []))
    return round_doubles(TR.permutation_importance(fixed, test, features=[0, 1, 2, 3]))


@register("snk_05_model_bundle_roundtrip")
def _snk05(spark, sf):
    train, test = _split(spark, sf)
    m = TR.fit_sensor_model(train, "logreg", "class_weight")
    path = MS.save_sensor_model(spark, m, shared_dir(spark, "sensor-model"))
    back = MS.load_sensor_model(spark, path)
    return round_doubles(back.predict_frame(test).select("unit_id", "fail_proba", "decision"))


@register("rte_05_sensor_batch_scoring")
def _rte05(spark, sf):
    train, _ = _split(spark, sf)
    m = TR.fit_sensor_model(train, "logreg", "class_weight")
    requests = FX.requests(spark, sf).unionByName(FX.sensor_requests(spark, sf))
    rows = S.sensor_rows(S.route(requests), len(m.prep.names_in), trained=m.prep.names_in)
    ok = rows.filter(F.col("error").isNull())
    scored = m.predict_frame(ok).select("request_id", "row_idx", "fail_proba", "decision", F.lit(None).cast("string").alias("error"))
    bad = rows.filter(F.col("error").isNotNull()).select("request_id", "row_idx", F.lit(None).cast("double").alias("fail_proba"),
                                                         F.lit(None).cast("boolean").alias("decision"), "error")
    return scored.unionByName(bad)


MAP_SIZE = 64


def _wafer_training(spark, sf, size=MAP_SIZE):
    from .wafer_queries import labelled_wafers
    lab = cut_computed(W.filter_labeled(labelled_wafers(spark, sf), drop_none=False).select("wafer_id", "label", "cells", "rows", "cols"))
    classes = [r[0] for r in lab.select("label").distinct().orderBy("label").limit(TR.MAX_CLASSES + 1).collect()]
    s = SP.stratified_three_way(lab, "label", "wafer_id")
    parts = max(1, -(-lab.count() * size * size // (ROWS_A_PART * TR.VALUES_A_ROW)))       # the maps grow here: dealt out before
    s = W.resized(s.repartition(parts, "wafer_id"), size).select("wafer_id", "label", "x", "split").cache()
    model = TR.fit_wafer_classifier(s.filter(F.col("split") != "test"), classes)
    return model, classes, s


@register("trn_12_wafer_classifier")
def _trn12(spark, sf):
    model, classes, s = _wafer_training(spark, sf)
    out = TR.classify_wafers(model, s.filter(F.col("split") == "test"), classes)
    idx = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    dec = out.withColumn("y", idx.cast("int"))
    return round_doubles(E.per_class_metrics(dec, len(classes)))


@register("rte_06_wafer_batch_scoring")
def _rte06(spark, sf):
    model, classes, _ = _wafer_training(spark, sf)
    maps = S.wafer_rows(S.route(FX.requests(spark, sf).unionByName(FX.wafer_requests(spark, sf))))
    x = W.resized(S.dealt(maps.where("error IS NULL")), MAP_SIZE, "img_size")
    scored = TR.classify_wafers(model, x, classes).select("request_id", "map_idx", "pattern", "confidence",
                                                          F.lit(None).cast("string").alias("error"))
    bad = maps.where("error IS NOT NULL").select("request_id", "map_idx", F.lit(None).cast("string").alias("pattern"),
                                                 F.lit(None).cast("double").alias("confidence"), "error")
    return scored.unionByName(bad)


def _all_requests(spark, sf):
    """All requests of F8, all sensor rows and all maps, and a scoring branch for each domain."""
    from .route_queries import _bundle_params
    train, _ = _split(spark, sf)
    sensor = TR.fit_sensor_model(train, "logreg", "class_weight")
    wafer, classes, _ = _wafer_training(spark, sf)
    requests = FX.requests(spark, sf).unionByName(FX.sensor_requests(spark, sf)).unionByName(FX.wafer_requests(spark, sf).select(
        (F.col("request_id") - 1_000_000_000).alias("request_id"), "payload"))
    return requests, {"yield_curve": S.yield_branch(_bundle_params(spark, sf)), "secom": S.sensor_branch(sensor),
                      "wafer_cnn": S.wafer_branch(lambda maps: TR.classify_wafers(wafer, maps, classes), MAP_SIZE)}


@register("rte_04_route_and_predict")
def _rte04_all(spark, sf):
    requests, branches = _all_requests(spark, sf)
    return S.answer(cut_lineage(S.route(requests)), branches)      # every branch reads the routed rows


@register("str_01_streaming_answers")
def _str01_answers(spark, sf):
    """The same requests as a stream of files, answered in all three branches."""
    from ..streaming import scoring as STR
    requests, branches = _all_requests(spark, sf)
    base = shared_dir(spark, "stream-answers")
    requests.repartition(4, "request_id").write.parquet(f"{base}/source")
    STR.stream_answers(spark, f"{base}/source", requests.schema, f"{base}/sink", f"{base}/ckpt", branches, max_files_per_trigger=2)
    return STR.read_answers(spark, f"{base}/sink")
