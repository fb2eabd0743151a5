"""Queries over evaluation operators: binary curves and tuning on F3,
multiclass metrics on F4."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..sources import fixtures as FX
from .catalog import register
from .common import round_doubles, rsql
from .oracle_fixtures import with_ctes

TUNED = 0.6


def _pts(spark, sf, target_rows=E.TARGET_ROWS):
    return E.curve_points(FX.scored(spark, sf), target_rows=target_rows)


_AT = ("pat", """SELECT score AS threshold, CAST(sum(y) AS BIGINT) AS tp_at,
                       CAST(count(*) - sum(y) AS BIGINT) AS fp_at FROM scored GROUP BY score""")
_CUM = ("cum", """
  SELECT *, CAST(sum(tp_at) OVER w AS BIGINT) AS tps, CAST(sum(fp_at) OVER w AS BIGINT) AS fps,
         lead(tp_at) OVER (ORDER BY threshold DESC) AS next_tp_at,
         lead(fp_at) OVER (ORDER BY threshold DESC) AS next_fp_at,
         CAST(sum(tp_at) OVER () AS BIGINT) AS n_pos, CAST(sum(fp_at) OVER () AS BIGINT) AS n_neg
  FROM pat WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
_PR = ("pr", """
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM (SELECT *, CAST(tps AS DOUBLE) / (tps + fps) AS precision,
               CASE WHEN n_pos > 0 THEN CAST(tps AS DOUBLE) / n_pos ELSE 1.0 END AS recall FROM cum)""")
_CURVE = [_AT, _CUM, _PR]


def _q(select, doubles, extra=()):
    return rsql(with_ctes(["scored"], select, _CURVE + list(extra)), doubles)


@register("evl_03_pr_curve", _q("SELECT threshold, precision, recall, f1 FROM pr",
                                ["threshold", "precision", "recall", "f1"]))
def _evl03(spark, sf):
    return round_doubles(E.pr_curve(_pts(spark, sf)).select("threshold", "precision", "recall", "f1"))


@register("win_01_cumulative_counts", with_ctes(["scored"], "SELECT threshold, tps, fps FROM cum", _CURVE))
def _win01(spark, sf):
    return _pts(spark, sf).select("threshold", "tps", "fps")


@register("win_01_cumulative_counts_ranged", with_ctes(["scored"],
          "SELECT threshold, tps, fps, next_tp_at, next_fp_at FROM cum", _CURVE))
def _win01r(spark, sf):
    # 7 rows per range: the multi-range path (cut points, offsets, stitched lead)
    return _pts(spark, sf, target_rows=7).select("threshold", "tps", "fps", "next_tp_at", "next_fp_at")


@register("evl_04_roc_curve", _q("""
  SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
  UNION ALL
  SELECT threshold, CAST(fps AS DOUBLE) / n_neg AS fpr, CAST(tps AS DOUBLE) / n_pos AS tpr FROM cum
  WHERE (tps = tp_at AND fps = fp_at) OR next_tp_at IS NULL OR next_tp_at <> tp_at OR next_fp_at <> fp_at""",
    ["threshold", "fpr", "tpr"]))
def _evl04(spark, sf):
    return round_doubles(E.roc_points(_pts(spark, sf)))


@register("evl_05_average_precision", _q("SELECT sum(tp_at * precision) / any_value(n_pos) AS average_precision FROM pr",
                                         ["average_precision"]))
def _evl05(spark, sf):
    return round_doubles(E.average_precision(_pts(spark, sf)))


@register("evl_06_roc_auc", _q("""
  SELECT CAST(sum(fp_at * (2 * tps - tp_at)) AS DOUBLE) / (2 * any_value(n_pos) * any_value(n_neg)) AS roc_auc FROM cum""",
    ["roc_auc"]))
def _evl06(spark, sf):
    return round_doubles(E.roc_auc(_pts(spark, sf)))


@register("evl_07_tune_f1", _q("""
  SELECT threshold, f1 FROM pr ORDER BY f1 DESC, threshold ASC LIMIT 1""", ["threshold", "f1"]))
def _evl07(spark, sf):
    return round_doubles(E.tune_f1(_pts(spark, sf)))


@register("evl_08_tune_gmean", _q("""
  SELECT threshold, sqrt(tpr * (1 - fpr)) AS g_mean FROM (
    SELECT threshold, CAST(fps AS DOUBLE) / n_neg AS fpr, CAST(tps AS DOUBLE) / n_pos AS tpr FROM cum
    WHERE (tps = tp_at AND fps = fp_at) OR next_tp_at IS NULL OR next_tp_at <> tp_at OR next_fp_at <> fp_at)
  ORDER BY g_mean DESC, threshold DESC LIMIT 1""", ["threshold", "g_mean"]))
def _evl08(spark, sf):
    return round_doubles(E.tune_gmean(_pts(spark, sf)))


def _recall_sql(target):
    return _q(f"""
  SELECT coalesce((SELECT threshold FROM pr WHERE recall >= {target} ORDER BY precision DESC, threshold ASC LIMIT 1),
                  (SELECT min(threshold) FROM pr)) AS threshold,
         EXISTS (SELECT 1 FROM pr WHERE recall >= {target}) AS feasible""", ["threshold"])


@register("evl_09_tune_recall_80", _recall_sql(0.8))
def _evl09(spark, sf):
    return round_doubles(E.tune_recall(_pts(spark, sf), 0.8))


@register("evl_09_tune_recall_infeasible", _recall_sql(1.5))
def _evl09b(spark, sf):
    return round_doubles(E.tune_recall(_pts(spark, sf), 1.5))


@register("jon_06_nearest_point", _q("""
  SELECT threshold, precision, recall FROM pr ORDER BY abs(threshold - 0.5), threshold LIMIT 1""",
    ["threshold", "precision", "recall"]))
def _jon06(spark, sf):
    return round_doubles(E.nearest_point(_pts(spark, sf), 0.5))


_COUNTS = """
  SELECT count(*) FILTER (WHERE score >= {t} AND y = 1) AS tp, count(*) FILTER (WHERE score >= {t} AND y <> 1) AS fp,
         count(*) FILTER (WHERE score < {t} AND y = 1) AS fn, count(*) FILTER (WHERE score < {t} AND y <> 1) AS tn
  FROM scored"""
_METRICS = """
  SELECT tp, fp, fn, tn, precision, recall,
         CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
         sqrt(recall * tnr) AS g_mean, (recall + tnr) / 2 AS balanced_accuracy,
         CASE WHEN den > 0 THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / den ELSE 0.0 END AS mcc
  FROM (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
               CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
               CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0.0 END AS tnr,
               sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) AS den FROM c)"""
_MCOLS = ["precision", "recall", "f1", "g_mean", "balanced_accuracy", "mcc"]


@register("evl_01_metrics_at_default", rsql(with_ctes(["scored"], _METRICS, [("c", _COUNTS.format(t=0.5))]), _MCOLS))
def _evl01(spark, sf):
    return round_doubles(E.metrics_at_threshold(FX.scored(spark, sf), 0.5))


@register("evl_12_metrics_at_tuned", rsql(with_ctes(["scored"], _METRICS, [("c", _COUNTS.format(t=TUNED))]), _MCOLS))
def _evl12(spark, sf):
    return round_doubles(E.metrics_at_threshold(FX.scored(spark, sf), TUNED))


@register("evl_02_confusion_2x2", with_ctes(["scored"], """
  SELECT g.y, g.pred, coalesce(c.count, 0) AS count
  FROM (SELECT CAST(a.range AS INTEGER) AS y, CAST(b.range AS INTEGER) AS pred FROM range(2) a, range(2) b) g
  LEFT JOIN (SELECT y, CAST(score >= 0.5 AS INTEGER) AS pred, count(*) AS count FROM scored GROUP BY 1, 2) c
  ON c.y = g.y AND c.pred = g.pred"""))
def _evl02(spark, sf):
    return E.confusion_2x2(FX.scored(spark, sf), 0.5)


@register("evl_18_no_skill", rsql(with_ctes(["scored"], "SELECT avg(CAST(y AS DOUBLE)) AS no_skill FROM scored"),
                                  ["no_skill"]))
def _evl18(spark, sf):
    return round_doubles(E.no_skill(FX.scored(spark, sf)))


@register("agg_17_score_summary", with_ctes(["scored"], """
  SELECT count(*) AS n_units, count(*) FILTER (WHERE score >= 0.5) AS n_predicted_fail, 0.5 AS threshold FROM scored"""))
def _agg17(spark, sf):
    return E.score_summary(FX.scored(spark, sf), 0.5)


@register("evl_17_evaluation_report", _q("""
  SELECT (SELECT sum(tp_at * precision) / any_value(n_pos) FROM pr) AS average_precision,
         (SELECT CAST(sum(fp_at * (2 * tps - tp_at)) AS DOUBLE) / (2 * any_value(n_pos) * any_value(n_neg)) FROM cum) AS roc_auc,
         (SELECT avg(CAST(y AS DOUBLE)) FROM scored) AS no_skill, 0.5 AS default_threshold,
         d.precision AS default_precision, d.recall AS default_recall, d.f1 AS default_f1, d.g_mean AS default_g_mean,
         d.tp AS default_tp, d.fp AS default_fp, d.fn AS default_fn, d.tn AS default_tn,
         (SELECT threshold FROM pr ORDER BY f1 DESC, threshold ASC LIMIT 1) AS tuned_threshold,
         t.precision AS tuned_precision, t.recall AS tuned_recall, t.f1 AS tuned_f1, t.g_mean AS tuned_g_mean,
         t.tp AS tuned_tp, t.fp AS tuned_fp, t.fn AS tuned_fn, t.tn AS tuned_tn
  FROM md d, mt t""", ["average_precision", "roc_auc", "no_skill", "default_threshold", "default_precision",
                     "default_recall", "default_f1", "default_g_mean", "tuned_threshold", "tuned_precision",
                     "tuned_recall", "tuned_f1", "tuned_g_mean"],
    [("c", _COUNTS.format(t=0.5)), ("md", _METRICS),
     ("c2", _COUNTS.format(t="(SELECT threshold FROM pr ORDER BY f1 DESC, threshold ASC LIMIT 1)")),
     ("mt", _METRICS.replace("FROM c)", "FROM c2)"))]))
def _evl17(spark, sf):
    return round_doubles(E.evaluation_report(FX.scored(spark, sf)))


@register("prj_11_margin_squash", rsql(with_ctes(["scored"], """
  SELECT id, 1.0 / (1.0 + exp(-(score * 10 - 5))) AS fail_proba FROM scored"""), ["fail_proba"]))
def _prj11(spark, sf):
    s = FX.scored(spark, sf)
    return round_doubles(s.select("id", E.proba_from_margin(F.col("score") * 10 - 5).alias("fail_proba")))


@register("prj_12_predict_frame", with_ctes(["scored"], """
  SELECT id, CAST(round_even(score, 4) AS DOUBLE) AS fail_proba, score >= 0.55 AS decision,
         CASE WHEN score >= 0.55 THEN 'fail' ELSE 'pass' END AS label FROM scored"""))
def _prj12(spark, sf):
    return E.predict_frame(FX.scored(spark, sf), 0.55).select("id", "fail_proba", "decision", "label")


# ------------------------------------------------------------- multiclass
NC = FX.N_CLASSES
CLASS_NAMES = FX.PATTERN_NAMES          # 8 names: classes 8 and 9 become class_8, class_9


def _decoded(spark, sf):
    return E.decode(FX.multiclass(spark, sf), CLASS_NAMES)


_PRED = ("pred", """
  SELECT id, y, min(k) FILTER (WHERE p = mp) AS pred, max(p) AS confidence
  FROM (SELECT *, max(p) OVER (PARTITION BY id) AS mp FROM mc_prob) GROUP BY id, y""")


@register("prj_13_decode", rsql(with_ctes(["mc_prob"], f"""
  SELECT id, CAST(pred AS INTEGER) AS pred,
         CASE WHEN pred < 8 THEN ({CLASS_NAMES})[pred + 1]
              ELSE 'class_' || CAST(pred AS VARCHAR) END AS label,
         round_even(confidence, 4) AS confidence FROM pred""", [_PRED]), ["confidence"]))
def _prj13(spark, sf):
    return round_doubles(_decoded(spark, sf).select("id", "pred", "label", "confidence"))


@register("prj_14_softmax", rsql(with_ctes(["mc_prob"], "SELECT id, k, p FROM mc_prob"), ["p"]))
def _prj14(spark, sf):
    d = _decoded(spark, sf)
    return round_doubles(d.select("id", F.posexplode("probs").alias("k", "p"))
                         .select("id", F.col("k").cast("int").alias("k"), "p"))


_PC = ("pc", """
  SELECT k, support, tp, predicted, precision, recall,
         CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM (SELECT c.k, coalesce(s.support, 0) AS support, coalesce(s.tp, 0) AS tp, coalesce(q.predicted, 0) AS predicted,
               CASE WHEN coalesce(q.predicted, 0) > 0 THEN CAST(s.tp AS DOUBLE) / q.predicted ELSE 0.0 END AS precision,
               CASE WHEN coalesce(s.support, 0) > 0 THEN CAST(s.tp AS DOUBLE) / s.support ELSE 0.0 END AS recall
        FROM (SELECT CAST(range AS INTEGER) AS k FROM range(10)) c
        LEFT JOIN (SELECT y AS k, count(*) AS support, count(*) FILTER (WHERE pred = y) AS tp FROM pred GROUP BY y) s USING (k)
        LEFT JOIN (SELECT pred AS k, count(*) AS predicted FROM pred GROUP BY pred) q USING (k))""")


@register("evl_13_per_class", rsql(with_ctes(["mc_prob"], """
  SELECT k, support, round_even(precision, 4) AS precision, round_even(recall, 4) AS recall, round_even(f1, 4) AS f1
  FROM pc""", [_PRED, _PC]), ["precision", "recall", "f1"]))
def _evl13(spark, sf):
    pc = E.per_class_metrics(_decoded(spark, sf), NC)
    return round_doubles(pc.select(F.col("k").cast("int").alias("k"), "support",
                                   *[F.bround(c, 4).alias(c) for c in ("precision", "recall", "f1")]))


@register("evl_13_multiclass_summary", rsql(with_ctes(["mc_prob"], """
  SELECT round_even((SELECT avg(CAST(pred = y AS DOUBLE)) FROM pred), 4) AS accuracy,
         round_even(avg(f1), 4) AS macro_f1, round_even(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM pc""",
    [_PRED, _PC]), ["accuracy", "macro_f1", "weighted_f1"]))
def _evl13s(spark, sf):
    return round_doubles(E.multiclass_summary(_decoded(spark, sf), NC))


@register("evl_14_one_vs_rest_ap", rsql(with_ctes(["mc_prob"], """
  SELECT c.k, round_even(a.ap, 4) AS pr_auc FROM (SELECT CAST(range AS INTEGER) AS k FROM range(10)) c LEFT JOIN (
    SELECT k, sum(tp_at * precision) / any_value(n_pos) AS ap FROM (
      SELECT *, CAST(sum(tp_at) OVER w AS DOUBLE) / (sum(tp_at) OVER w + sum(fp_at) OVER w) AS precision,
             sum(tp_at) OVER (PARTITION BY k) AS n_pos
      FROM (SELECT k, p, sum(CAST(y = k AS INTEGER)) AS tp_at, count(*) - sum(CAST(y = k AS INTEGER)) AS fp_at
            FROM mc_prob GROUP BY k, p)
      WINDOW w AS (PARTITION BY k ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    GROUP BY k HAVING any_value(n_pos) > 0) a USING (k)"""), ["pr_auc"]))
def _evl14(spark, sf):
    ap = E.one_vs_rest_ap(_decoded(spark, sf), NC)
    return round_doubles(ap.select(F.col("k").cast("int").alias("k"), F.bround("average_precision", 4).alias("pr_auc")))


@register("evl_15_confusion_matrix", rsql(with_ctes(["mc_prob"], """
  SELECT g.t AS "true", g.p AS pred, coalesce(c.count, 0) AS count,
         coalesce(CAST(c.count AS DOUBLE) / r.row_total, 0.0) AS normalized
  FROM (SELECT CAST(a.range AS INTEGER) AS t, CAST(b.range AS INTEGER) AS p FROM range(10) a, range(10) b) g
  LEFT JOIN (SELECT y AS t, pred AS p, count(*) AS count FROM pred GROUP BY 1, 2) c ON c.t = g.t AND c.p = g.p
  LEFT JOIN (SELECT y AS t, count(*) AS row_total FROM pred GROUP BY 1) r ON r.t = g.t""", [_PRED]), ["normalized"]))
def _evl15(spark, sf):
    return round_doubles(E.confusion_matrix(_decoded(spark, sf), NC))


@register("evl_16_weakest_class", rsql(with_ctes(["mc_prob"], """
  SELECT k, f1 FROM pc ORDER BY f1, k LIMIT 1""", [_PRED, _PC]), ["f1"]))
def _evl16(spark, sf):
    return round_doubles(E.weakest_class(E.per_class_metrics(_decoded(spark, sf), NC)))
