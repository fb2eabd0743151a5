import numpy as np
import pandas as pd
import pytest

from conftest import SF01
from fabspark.operators import evaluate as E
from fabspark.sources import fixtures as FX


def _ref_curves(y, s):
    """Brute-force reference of the curve definitions (descending distinct thresholds)."""
    thr = np.sort(np.unique(s))[::-1]
    tps = np.array([((s >= t) & (y == 1)).sum() for t in thr])
    fps = np.array([((s >= t) & (y == 0)).sum() for t in thr])
    P, N = y.sum(), (1 - y).sum()
    prec, rec = tps / (tps + fps), tps / P
    ap = np.sum(np.diff(np.r_[0, rec]) * prec)
    fpr, tpr = fps / N, tps / P
    auc = np.trapezoid(np.r_[0, tpr], np.r_[0, fpr])
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    f1 = np.where(prec + rec > 0, 2 * prec * rec / (prec + rec), 0)
    asc = np.argsort(thr)
    best_f1_thr = thr[asc][np.argmax(f1[asc])]
    g = np.sqrt(tpr * (1 - fpr))[keep]
    best_g_thr = thr[keep][np.argmax(g)]
    return dict(thr=thr, prec=prec, rec=rec, ap=ap, auc=auc, roc_thr=thr[keep], f1_thr=best_f1_thr, g_thr=best_g_thr)


@pytest.mark.parametrize("seed", [0, 1])
def test_curves_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300) * 0.6 + 0.3 * y, 1)            # heavy ties
    df = spark.createDataFrame(pd.DataFrame({"y": y, "score": s}))
    pts = E.curve_points(df, target_rows=3).cache()               # multi-range path
    ref = _ref_curves(y, s)
    assert abs(E.average_precision(pts).first()[0] - ref["ap"]) < 1e-12
    assert abs(E.roc_auc(pts).first()[0] - ref["auc"]) < 1e-12
    roc = sorted(r["threshold"] for r in E.roc_points(pts).collect() if r["threshold"] != float("inf"))
    assert roc == sorted(ref["roc_thr"].tolist())
    assert E.tune_f1(pts).first()["threshold"] == ref["f1_thr"]
    assert E.tune_gmean(pts).first()["threshold"] == ref["g_thr"]


def test_average_precision_fixture_check(spark):
    pts = E.curve_points(FX.scored(spark, SF01)).cache()
    assert pts.count() == 100
    assert abs(E.average_precision(pts).first()[0] - 0.652698) < 1e-6


def test_recall_target_rules(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.5)], "y int, score double")
    pts = E.curve_points(df)
    r = E.tune_recall(pts, 0.6).first()
    assert r["feasible"] and r["threshold"] == 0.8           # recall 2/3, precision 1.0
    r = E.tune_recall(pts, 2.0).first()
    assert not r["feasible"] and r["threshold"] == 0.5       # max-recall point


def _decoded(spark, probs, y):
    rows = [(i, int(t), [float(v) for v in p]) for i, (t, p) in enumerate(zip(y, probs))]
    df = spark.createDataFrame(rows, "id long, y int, probs array<double>")
    from pyspark.sql import functions as F
    return df.withColumn("pred", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))


def test_multiclass_perfect_and_one_error(spark):
    y = np.array([0, 0, 1, 1, 2, 2])
    perfect = np.eye(3)[y] * 0.8 + 0.1
    s = E.multiclass_summary(_decoded(spark, perfect, y), 3).first()
    assert (s["accuracy"], s["macro_f1"], s["weighted_f1"]) == (1.0, 1.0, 1.0)
    one = perfect.copy()
    one[0] = [0.1, 0.8, 0.1]                                   # A predicted as B
    d = _decoded(spark, one, y)
    pc = {r["k"]: r for r in E.per_class_metrics(d, 3).collect()}
    assert pc[0]["recall"] == 0.5
    cm = {(r["true"], r["pred"]): r["count"] for r in E.confusion_matrix(d, 3).collect()}
    assert cm[(0, 1)] == 1 and len(cm) == 9


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, score double")
    m = E.metrics_at_threshold(df, 0.5).first()
    assert (m["precision"], m["recall"], m["f1"], m["mcc"]) == (0.0, 0.0, 0.0, 0.0)
