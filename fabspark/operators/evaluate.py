"""Binary and multiclass evaluation on ``(y, score)`` DataFrames.

Curves are built from one pre-aggregation per distinct score (tp_at, fp_at)
followed by scale-safe running sums (``cumulative.running_sums``), so ties
are handled exactly and no step needs all rows in one task.

Definitions follow the reference's libraries:

* PR curve: one point per distinct score, thresholds ascending, the final
  (precision 1, recall 0) point not included; precision = tps / (tps + fps),
  recall = tps / P.
* Average precision: sum over thresholds (descending) of (R_k - R_{k-1}) P_k
  = sum(tp_at_k * precision_k) / P.
* ROC curve: collinear intermediate points dropped (a point is kept when the
  per-threshold increments change after it), plus a leading (0, 0) point at
  threshold +inf. AUC by trapezoids over all distinct thresholds.
* Threshold tuning: max F1 (ties -> lowest threshold); max g-mean over ROC
  points without +inf (ties -> highest threshold); recall >= target with the
  best precision (ties -> lowest threshold), else the max-recall point.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import argmax_first, bround_all, softmax
from .cumulative import TARGET_ROWS, running_sums

# Fixed values
DEFAULT_THRESHOLD = 0.5


def _zdiv(a, b):
    """a / b, 0 when b == 0 (zero_division=0)."""
    return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))


def curve_points(scored: DataFrame, y: str = "y", score: str = "score", group_cols=(),
                 target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per (group, distinct score): threshold, tp_at, fp_at, tps, fps,
    next_tp_at, next_fp_at (following lower threshold), n_pos, n_neg."""
    group_cols = list(group_cols)
    yy = F.col(y).cast("long")
    at = scored.groupBy(*group_cols, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(yy).alias("tp_at"), (F.count("*") - F.sum(yy)).alias("fp_at"))
    cum = running_sums(at, "threshold", ["tp_at", "fp_at"], group_cols, descending=True,
                       target_rows=target_rows, next_cols=["tp_at", "fp_at"])
    cum = cum.withColumnRenamed("cum_tp_at", "tps").withColumnRenamed("cum_fp_at", "fps")
    if group_cols:
        tot = at.groupBy(*group_cols).agg(F.sum("tp_at").alias("n_pos"), F.sum("fp_at").alias("n_neg"))
        return cum.join(tot, group_cols)
    return cum.select("*", at.agg(F.sum("tp_at")).scalar().alias("n_pos"), at.agg(F.sum("fp_at")).scalar().alias("n_neg"))


def pr_curve(points: DataFrame) -> DataFrame:
    """EVL-03/EVL-10: precision, recall and F1 per threshold (the sweep table)."""
    p = F.col("tps") / (F.col("tps") + F.col("fps"))
    r = F.when(F.col("n_pos") > 0, F.col("tps") / F.when(F.col("n_pos") > 0, F.col("n_pos"))).otherwise(F.lit(1.0))
    out = points.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", _zdiv(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def roc_points(points: DataFrame, group_cols=(), drop_intermediate: bool = True) -> DataFrame:
    """EVL-04: (threshold, fpr, tpr) with collinear points dropped and a
    leading (+inf, 0, 0) point."""
    group_cols = list(group_cols)
    fpr = F.try_divide(F.col("fps").cast("double"), F.nullif(F.col("n_neg"), F.lit(0)))
    tpr = F.try_divide(F.col("tps").cast("double"), F.nullif(F.col("n_pos"), F.lit(0)))
    first = (F.col("tps") == F.col("tp_at")) & (F.col("fps") == F.col("fp_at"))
    last = F.col("next_tp_at").isNull()
    bend = (F.col("next_tp_at") != F.col("tp_at")) | (F.col("next_fp_at") != F.col("fp_at"))
    keep = first | last | bend if drop_intermediate else F.lit(True)
    pts = points.filter(keep).select(*group_cols, "threshold", fpr.alias("fpr"), tpr.alias("tpr"))
    start = points.select(*group_cols).distinct() if group_cols else points.limit(1).select()
    start = start.select(*group_cols, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                         F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def average_precision(points: DataFrame, group_cols=()) -> DataFrame:
    """EVL-05 / EVL-14: NULL when the group has no positives."""
    pr = pr_curve(points)
    return (pr.groupBy(*group_cols)
            .agg(F.sum(F.col("tp_at") * F.col("precision")).alias("s"), F.first("n_pos").alias("n_pos"))
            .select(*group_cols, F.try_divide(F.col("s"), F.nullif(F.col("n_pos"), F.lit(0))).alias("average_precision")))


def roc_auc(points: DataFrame, group_cols=()) -> DataFrame:
    """EVL-06: trapezoidal area under the ROC curve (ties give diagonal steps)."""
    term = F.col("fp_at") * (2 * F.col("tps") - F.col("tp_at"))
    return (points.groupBy(*group_cols)
            .agg(F.sum(term).alias("s"), F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
            .select(*group_cols, F.try_divide(F.col("s").cast("double"),
                                              F.nullif(2 * F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("roc_auc")))


def tune_f1(points: DataFrame, group_cols=()) -> DataFrame:
    """EVL-07: threshold of maximal F1, lowest threshold on ties."""
    pr = pr_curve(points)
    best = F.min(F.struct((-F.col("f1")).alias("nf1"), F.col("threshold")))
    return pr.groupBy(*group_cols).agg(best.alias("b")).select(
        *group_cols, F.col("b.threshold").alias("threshold"), (-F.col("b.nf1")).alias("f1"))


def tune_gmean(points: DataFrame, group_cols=()) -> DataFrame:
    """EVL-08: threshold of maximal sqrt(TPR (1 - FPR)) over ROC points
    (without +inf), highest threshold on ties."""
    roc = roc_points(points, group_cols).filter(F.col("threshold") < float("inf"))
    g = F.sqrt(F.col("tpr") * (1 - F.col("fpr")))
    best = F.max(F.struct(g.alias("g"), F.col("threshold")))
    return roc.groupBy(*group_cols).agg(best.alias("b")).select(
        *group_cols, F.col("b.threshold").alias("threshold"), F.col("b.g").alias("g_mean"))


def tune_recall(points: DataFrame, target: float, group_cols=()) -> DataFrame:
    """EVL-09: among thresholds with recall >= target the best precision
    (lowest threshold on ties); if none qualifies, the max-recall point
    (the lowest threshold)."""
    pr = pr_curve(points)
    feas = F.max(F.when(F.col("recall") >= target,
                        F.struct(F.col("precision"), (-F.col("threshold")).alias("nt"))))
    return (pr.groupBy(*group_cols).agg(feas.alias("b"), F.min("threshold").alias("lowest"))
            .select(*group_cols, F.coalesce(-F.col("b.nt"), F.col("lowest")).alias("threshold"),
                    F.col("b").isNotNull().alias("feasible")))


def nearest_point(points: DataFrame, t, group_cols=()) -> DataFrame:
    """JON-06: the PR point whose threshold is nearest to ``t`` (lowest on ties)."""
    pr = pr_curve(points)
    tc = F.lit(t) if not hasattr(t, "_jc") else t
    best = F.min(F.struct(F.abs(F.col("threshold") - tc).alias("d"), F.col("threshold"),
                          F.col("precision"), F.col("recall")))
    return pr.groupBy(*group_cols).agg(best.alias("b")).select(
        *group_cols, F.col("b.threshold").alias("threshold"), F.col("b.precision").alias("precision"),
        F.col("b.recall").alias("recall"))


def confusion_counts(scored: DataFrame, threshold, y: str = "y", score: str = "score", group_cols=()) -> DataFrame:
    """tp, fp, fn, tn at ``score >= threshold`` (one aggregation)."""
    t = F.lit(threshold) if not hasattr(threshold, "_jc") else threshold
    pred = F.col(score) >= t
    pos = F.col(y) == 1
    return scored.groupBy(*group_cols).agg(
        F.count_if(pred & pos).alias("tp"), F.count_if(pred & ~pos).alias("fp"),
        F.count_if(~pred & pos).alias("fn"), F.count_if(~pred & ~pos).alias("tn"))


def metrics_from_counts(c: DataFrame) -> DataFrame:
    """EVL-01/EVL-12: precision, recall, f1 (0 on zero division), g_mean,
    balanced accuracy, MCC (0 when its denominator is 0)."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    prec = _zdiv(tp, tp + fp)
    rec = _zdiv(tp, tp + fn)
    tnr = _zdiv(tn, tn + fp)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return (c.withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", _zdiv(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
            .withColumn("g_mean", F.sqrt(F.col("recall") * tnr))
            .withColumn("balanced_accuracy", (F.col("recall") + tnr) / 2)
            .withColumn("mcc", _zdiv(tp * tn - fp * fn, den)))


def metrics_at_threshold(scored: DataFrame, threshold, y="y", score="score", group_cols=()) -> DataFrame:
    return metrics_from_counts(confusion_counts(scored, threshold, y, score, group_cols))


def confusion_2x2(scored: DataFrame, threshold, y="y", score="score") -> DataFrame:
    """EVL-02: counts on the complete (y, pred) grid — the four cells always exist."""
    t = F.lit(threshold) if not hasattr(threshold, "_jc") else threshold
    counts = scored.groupBy(F.col(y).cast("int").alias("y"), (F.col(score) >= t).cast("int").alias("pred")).count()
    grid = scored.sparkSession.range(4).select((F.col("id") / 2).cast("int").alias("y"),
                                               (F.col("id") % 2).cast("int").alias("pred"))
    return grid.join(counts, ["y", "pred"], "left").select("y", "pred", F.coalesce("count", F.lit(0)).alias("count"))


def no_skill(scored: DataFrame, y: str = "y") -> DataFrame:
    """EVL-18: precision of a constant classifier = mean(y)."""
    return scored.agg(F.avg(F.col(y).cast("double")).alias("no_skill"))


def score_summary(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """AGG-17: n_units, n_predicted_fail, threshold."""
    return scored.agg(F.count("*").alias("n_units"), F.count_if(F.col(score) >= threshold).alias("n_predicted_fail"),
                      F.lit(float(threshold)).alias("threshold"))


def evaluation_report(scored: DataFrame, tuned_threshold=None, objective: str = "f1",
                      recall_target: float | None = None, y="y", score="score") -> DataFrame:
    """EVL-17: one row with AP, AUC, no-skill, and metrics and confusion counts at 0.5
    and at the tuned threshold (tuned on this data unless a threshold is given)."""
    pts = curve_points(scored, y, score).cache()
    if tuned_threshold is None:
        if recall_target is not None:
            tuned_threshold = tune_recall(pts, recall_target).first()["threshold"]
        elif objective == "g_mean":
            tuned_threshold = tune_gmean(pts).first()["threshold"]
        else:
            tuned_threshold = tune_f1(pts).first()["threshold"]
    d = metrics_at_threshold(scored, DEFAULT_THRESHOLD, y, score)
    t = metrics_at_threshold(scored, float(tuned_threshold), y, score)
    cols = ["precision", "recall", "f1", "g_mean", "tp", "fp", "fn", "tn"]
    return (average_precision(pts)
            .select("average_precision", roc_auc(pts).select("roc_auc").scalar().alias("roc_auc"),
                    no_skill(scored, y).scalar().alias("no_skill"),
                    F.lit(DEFAULT_THRESHOLD).alias("default_threshold"),
                    *[d.select(c).scalar().alias(f"default_{c}") for c in cols],
                    F.lit(float(tuned_threshold)).alias("tuned_threshold"),
                    *[t.select(c).scalar().alias(f"tuned_{c}") for c in cols]))


def operating_points(report: DataFrame) -> DataFrame:
    """SNK-06: the report's metrics side by side at the default and the tuned threshold."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"default_{m}").alias("default"), F.col(f"tuned_{m}").alias("tuned"))
            for m in ("recall", "precision", "f1", "g_mean")]
    return report.select(F.inline(F.array(*rows)))


# ------------------------------------------------------------- scoring
def proba_from_margin(margin) -> F.Column:
    """PRJ-11: logistic squash of a decision margin."""
    m = F.col(margin) if isinstance(margin, str) else margin
    return 1.0 / (1.0 + F.exp(-m))


def predict_frame(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """PRJ-12: fail_proba rounded half-even to 4 places; the decision uses the
    unrounded score."""
    return scored.select("*", F.bround(F.col(score), 4).alias("fail_proba"),
                         (F.col(score) >= threshold).alias("decision"),
                         F.when(F.col(score) >= threshold, "fail").otherwise("pass").alias("label"))


# ----------------------------------------------------------- multiclass
def decode(logits: DataFrame, classes: list[str] | None = None, z: str = "z") -> DataFrame:
    """PRJ-13/14: softmax probabilities, first argmax, label by class list
    (``class_<i>`` beyond it), confidence and probabilities rounded to 4."""
    d = logits.withColumn("probs", softmax(z)).withColumn("pred", argmax_first("probs"))
    names = F.array(*[F.lit(c) for c in (classes or [])]) if classes else None
    label = (F.coalesce(F.get(names, F.col("pred")), F.concat(F.lit("class_"), F.col("pred").cast("string")))
             if names is not None else F.concat(F.lit("class_"), F.col("pred").cast("string")))
    return (d.withColumn("label", label)
            .withColumn("confidence", F.bround(F.array_max("probs"), 4))
            .withColumn("probs_rounded", bround_all("probs", 4)))


def per_class_metrics(decoded: DataFrame, n_classes: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """EVL-13: per class precision / recall / f1 / support over the complete
    class list (absent classes get zeros), unrounded."""
    agg = decoded.groupBy(F.col(y).alias("k")).agg(F.count("*").alias("support"),
                                                   F.count_if(F.col(pred) == F.col(y)).alias("tp"))
    predicted = decoded.groupBy(F.col(pred).alias("k")).agg(F.count("*").alias("predicted"))
    classes = decoded.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("k"))
    m = (classes.join(agg, "k", "left").join(predicted, "k", "left")
         .select("k", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "tp", "predicted")]))
    return (m.withColumn("precision", _zdiv(F.col("tp").cast("double"), F.col("predicted")))
            .withColumn("recall", _zdiv(F.col("tp").cast("double"), F.col("support")))
            .withColumn("f1", _zdiv(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def multiclass_summary(decoded: DataFrame, n_classes: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """EVL-13: accuracy, macro F1, weighted F1 (rounded half-even to 4)."""
    pc = per_class_metrics(decoded, n_classes, y, pred)
    acc = decoded.agg(F.avg((F.col(y) == F.col(pred)).cast("double"))).scalar()
    return pc.agg(F.bround(acc, 4).alias("accuracy"),
                  F.bround(F.avg("f1"), 4).alias("macro_f1"),
                  F.bround(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"))


def one_vs_rest_ap(decoded: DataFrame, n_classes: int, y: str = "y", probs: str = "probs",
                   target_rows: int = TARGET_ROWS) -> DataFrame:
    """EVL-14: average precision of class k's probability for (y == k); NULL
    when class k never occurs. Long form (id, k, score, is_k) grouped by k."""
    long = decoded.select(F.col(y), F.posexplode(probs).alias("k", "score")).filter(F.col("k") < n_classes)
    long = long.withColumn("is_k", (F.col(y) == F.col("k")).cast("int"))
    pts = curve_points(long, "is_k", "score", ["k"], target_rows)
    ap = average_precision(pts, ["k"])
    classes = decoded.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("k"))
    return classes.join(ap, "k", "left")


def confusion_matrix(decoded: DataFrame, n_classes: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """EVL-15: k x k counts on the complete class grid, row-normalised (rows
    without samples stay 0). The grid is generated (n_classes^2 rows)."""
    counts = decoded.groupBy(F.col(y).alias("true"), F.col(pred).alias("pred")).count()
    grid = (decoded.sparkSession.range(n_classes * n_classes)
            .select((F.col("id") / n_classes).cast("int").alias("true"),
                    (F.col("id") % n_classes).cast("int").alias("pred")))
    rows = counts.groupBy("true").agg(F.sum("count").alias("row_total"))
    return (grid.join(counts, ["true", "pred"], "left").join(rows, "true", "left")
            .select("true", "pred", F.coalesce("count", F.lit(0)).alias("count"),
                    F.coalesce(F.try_divide(F.col("count").cast("double"), F.col("row_total")), F.lit(0.0))
                    .alias("normalized")))


def weakest_class(per_class: DataFrame) -> DataFrame:
    """EVL-16: class with the lowest F1 (lowest index on ties)."""
    return per_class.agg(F.min(F.struct("f1", "k")).alias("b")).select(
        F.col("b.k").alias("k"), F.col("b.f1").alias("f1"))
