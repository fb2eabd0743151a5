"""TRN-12: wafer-pattern classes on resized maps, against patterns whose class is known."""
import random

import pytest

from fabspark.operators import train as TR
from fabspark.operators import wafer as W

CLASSES = ["centre", "edge", "none"]


def _maps(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind, side = CLASSES[i % 3], rng.choice([12, 16, 20])
        mid = (side - 1) / 2
        cells = []
        for r in range(side):
            for c in range(side):
                far = max(abs(r - mid), abs(c - mid)) / mid
                bad = kind == "centre" and far < 0.4 or kind == "edge" and far > 0.8
                cells.append(2 if rng.random() < (0.9 if bad else 0.05) else 1)
        rows.append((i, kind, side, side, cells))
    return rows


SCHEMA = "wafer_id long, label string, rows int, cols int, cells array<int>"


def _resized(spark, rows):
    return W.resized(spark.createDataFrame(rows, SCHEMA), 16).select("wafer_id", "label", "x")


@pytest.mark.parametrize("method", ["rf", "mlp"])
def test_known_patterns_are_found(spark, method):
    train = _resized(spark, _maps(90, 1))
    model = TR.fit_wafer_classifier(train, CLASSES, method=method, n_trees=20)
    got = TR.classify_wafers(model, _resized(spark, _maps(45, 2)), CLASSES).collect()
    assert len(got) == 45
    assert sum(r["pattern"] == r["label"] for r in got) >= 43
    for r in got:
        assert abs(sum(r["probs"]) - 1) < 1e-9 and r["pattern"] == CLASSES[r["pred"]]
        assert r["confidence"] == pytest.approx(max(r["probs"]), abs=5e-5)


def test_rows_without_a_known_class_or_a_map_do_not_train(spark):
    rows = _maps(60, 3)
    extra = [(1000 + i, label, 12, 12, [1] * 144) for i, label in enumerate([None, "unheard", None])]
    plain = _resized(spark, rows)
    more = plain.unionByName(_resized(spark, extra)).unionByName(
        spark.createDataFrame([(2000, "edge", None)], "wafer_id long, label string, x array<double>"))
    test = _resized(spark, _maps(15, 4))
    models = [TR.fit_wafer_classifier(d.coalesce(1).orderBy("wafer_id"), CLASSES, n_trees=5) for d in (plain, more)]
    assert models[0].numClasses == models[1].numClasses == 3
    for m in models:
        assert TR.classify_wafers(m, test, CLASSES).where("pattern IS NULL").count() == 0


def test_rare_class_weighs_as_much_as_a_common_one(spark):
    rows = [r for r in _maps(120, 5) if r[1] != "edge"] + [r for r in _maps(120, 6) if r[1] == "edge"][:4]
    train = _resized(spark, rows)
    got = TR.classify_wafers(TR.fit_wafer_classifier(train, CLASSES, n_trees=30), _resized(spark, _maps(30, 7)), CLASSES).collect()
    assert sum(r["pattern"] == "edge" for r in got if r["label"] == "edge") >= 8


def test_limits(spark):
    train = _resized(spark, _maps(6, 8))
    with pytest.raises(ValueError, match="classes"):
        TR.fit_wafer_classifier(train, [str(i) for i in range(TR.MAX_CLASSES + 1)])
    with pytest.raises(ValueError, match="no row"):
        TR.fit_wafer_classifier(train.limit(0), CLASSES)
