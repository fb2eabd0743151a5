"""Trees, folds and permutations: against brute force, numpy and planted structure."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabspark.operators import prep as PR
from fabspark.operators import train as TR
from fabspark.operators import trees as T
from fabspark.session import shared_dir
from fabspark.sinks import model_store as MS


def planted(n=240, width=6, seed=0):
    """The label follows columns 1 and 4; some values are missing."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    y = (x[:, 1] + x[:, 4] + 0.3 * rng.normal(size=n) > 1).astype(int)
    gaps = rng.random((n, width)) < [0.1, 0, 0.3, 0.02, 0, 0.7]
    return x, y, gaps


@pytest.fixture(scope="module")
def units(spark):
    x, y, gaps = planted()
    rows = [(i, int(c), [None if g else float(v) for v, g in zip(r, miss)]) for i, (r, c, miss) in enumerate(zip(x, y, gaps))]
    return spark.createDataFrame(rows, "unit_id bigint, y int, x array<double>").cache()


def test_first_split_is_the_best_of_all():
    x, y, _ = planted(80)
    w = np.where(y == 1, 3.0, 1.0)
    _, (tree,) = T.boost(x, y.astype(float), w, {"n_trees": 1, "learning_rate": 1.0, "max_depth": 1, "l2_regularization": 2.0}, 0)
    p = (w * y).sum() / w.sum()
    g, h = w * (y - p), w * p * (1 - p)
    best = max(((g[m].sum() ** 2 / (h[m].sum() + 2) + g[~m].sum() ** 2 / (h[~m].sum() + 2) - g.sum() ** 2 / (h.sum() + 2)), f, c)
               for f in range(6) for c in x[:, f] for m in [x[:, f] <= c] if m.any() and not m.all())
    assert tree["feature"][0] == best[1] and tree["gain"][0] == pytest.approx(best[0])
    near = x[:, best[1]] <= tree["edge"][0]
    assert (near == (x[:, best[1]] <= best[2])).all()
    assert tree["value"][1] == pytest.approx(g[near].sum() / (h[near].sum() + 2))


def test_every_parameter_changes_the_trees():
    x, y, _ = planted(300)
    base = {"n_trees": 5, "learning_rate": 0.1, "max_leaf_nodes": 31, "max_depth": 6, "min_samples_leaf": 5, "l2_regularization": 1.0,
            "min_child_weight": 0.5, "subsample": 1.0, "colsample_bytree": 1.0}
    grown = lambda **k: json.dumps(T.boost(x, y.astype(float), np.ones(len(y)), {**base, **k}, 1))
    first = grown()
    assert first == grown()
    for change in ({"learning_rate": 0.2}, {"max_leaf_nodes": 4}, {"max_depth": 2}, {"min_samples_leaf": 30}, {"l2_regularization": 20.0},
                   {"min_child_weight": 8}, {"subsample": 0.7}, {"colsample_bytree": 0.5}, {"n_trees": 6}):
        assert grown(**change) != first, change
    _, trees = T.boost(x, y.astype(float), np.ones(len(y)), {**base, "max_leaf_nodes": 4, "min_samples_leaf": 12}, 1)
    for t in trees:
        leaves = [i for i, f in enumerate(t["feature"]) if f < 0]
        assert len(leaves) <= 4


def test_boosting_and_forest_learn_the_planted_columns():
    x, y, _ = planted(400)
    far, truth, _ = planted(1000, seed=9)
    base, trees = T.boost(x, y.astype(float), np.ones(len(y)), {"n_trees": 60, "learning_rate": 0.1, "max_depth": 3}, 0)
    boosted = T.TreeEnsemble(True, base)
    bagged = T.TreeEnsemble(False, 0.0)
    rng = np.random.default_rng(3)
    draws = [dict() for _ in y]
    for t in range(40):
        for c in (0, 1):
            of = np.flatnonzero(y == c)
            for r in rng.choice(of, (y == 1).sum()):
                draws[r][t] = draws[r].get(t, 0) + 1
    for e, grown in ((boosted, trees), (bagged, T.forest(x, y.astype(float), np.ones(len(y)), draws, range(40), {"max_features": "sqrt"}, 0))):
        for t in grown:
            e.add(t)
        assert np.mean((e.probability(far) > 0.5) == truth) > 0.88
        assert set(np.argsort(e.importances(6))[-2:]) == {1, 4}
        assert np.allclose(T.TreeEnsemble.from_json(e.to_json()).probability(far), e.probability(far))


def test_leaves_of_a_whole_forest_tree_are_pure():
    x, y, _ = planted(120)
    tree = T.forest(x, y.astype(float), np.ones(len(y)), [{0: 1}] * len(y), range(1), {"max_features": 1.0}, 0)[0]
    assert {v for v, f in zip(tree["value"], tree["feature"]) if f < 0} == {0.0, 1.0}


def test_preparations_of_all_folds_equal_numpy(spark, units):
    x, _, gaps = planted()
    folded = units.withColumn("fold", (F.col("unit_id") % 4).cast("int"))
    for f, m in enumerate(PR.fit_folds(folded, 4)):
        rows = np.arange(len(x)) % 4 != f
        v, g = x[rows], gaps[rows]
        assert m.indicator_idx == [i for i in range(6) if 0.05 < g[:, i].mean() < 1]
        keep = [i for i in range(6) if g[:, i].mean() <= 0.5]
        names = [f"feature_{i:03d}" for i in keep] + [f"feature_{i:03d}__missing" for i in m.indicator_idx]
        assert m.feature_names == names
        filled = np.stack([np.where(g[:, i], np.median(v[~g[:, i], i]), v[:, i]) for i in keep] + [g[:, i].astype(float) for i in m.indicator_idx], axis=1)
        assert np.allclose(m.means, filled.mean(axis=0)) and np.allclose(m.stds, filled.std(axis=0))
        out = m.transform(folded.where(F.col("fold") != f)).orderBy("unit_id").select("features").collect()
        assert np.allclose(np.array([r[0] for r in out]), (filled - filled.mean(axis=0)) / filled.std(axis=0))
        alone = PR.fit(folded.where(F.col("fold") != f))
        assert alone.feature_names == m.feature_names and np.allclose(alone.medians, m.medians)


SMALL = {"balanced_rf": {"n_estimators": 30}, "hist_gb": {"max_iter": 30}, "xgboost": {"n_estimators": 30}, "logreg": {}}


def test_comparison_shares_its_folds(spark, units, monkeypatch):
    fits = []
    real = PR.fit_folds
    monkeypatch.setattr(PR, "fit_folds", lambda *a, **k: (fits.append(1), real(*a, **k))[1])
    monkeypatch.setattr(PR, "fit", lambda *a, **k: pytest.fail("one preparation per fold is enough"))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = TR.compare_configs(units, k=3, params=SMALL).collect()
    assert len(fits) == 1 and len(out) == 5
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before + 4          # the samplers' own
    assert [r["pr_auc_mean"] for r in out] == sorted((r["pr_auc_mean"] for r in out), reverse=True)
    assert all(r["roc_auc_mean"] > 0.9 for r in out)


def test_search_scores_every_draw_in_one_run(spark, units):
    model, best, score, table = TR.tune(units, "xgboost", "none", n_iter=3, k=3, base_params={})
    rows = {r["params"]: r["pr_auc"] for r in table.collect()}
    assert len(rows) == 3 and score == max(rows.values()) and model.estimator == "xgboost"
    assert all(v > 0.8 for v in rows.values())


@pytest.mark.parametrize("estimator", ["balanced_rf", "hist_gb"])
def test_saved_trees_score_alike(spark, units, estimator):
    m = TR.fit_sensor_model(units, estimator, "none", SMALL[estimator])
    back = MS.load_sensor_model(spark, MS.save_sensor_model(spark, m, shared_dir(spark, "trees")))
    a, b = ({r["unit_id"]: r["score"] for r in x.score(units).collect()} for x in (m, back))
    assert a == b and len(a) == units.count()
    again = TR.fit_sensor_model(units.repartition(7), estimator, "none", SMALL[estimator])
    assert {r["unit_id"]: round(r["score"], 12) for r in again.score(units).collect()} == {i: round(s, 12) for i, s in a.items()}


def test_balanced_draws_and_samples(spark, units):
    rows = units.select(F.lit(0).alias("frame"), "unit_id", "y")
    n = {r["y"]: r["count"] for r in units.groupBy("y").count().collect()}
    got = T.balanced_draws(rows, 8).groupBy("tree", "y").agg(F.sum("copies").alias("n")).collect()
    assert len(got) == 16 and {r["n"] for r in got} == {min(n.values())}
    assert 60 <= T.bounded_sample(rows, 100).count() <= 140 and T.bounded_sample(rows, 10_000).count() == units.count()


def test_balanced_forest_warns_beside_a_strategy(spark, units, caplog):
    TR._spec(0, "balanced_rf", "smote", None, {})
    assert "balanced twice" in caplog.text


def test_permutation_importance_finds_the_planted_columns(spark, units):
    m = TR.fit_sensor_model(units, "hist_gb", "none", SMALL["hist_gb"])
    out = {r["feature"]: r for r in TR.feature_importance(m, units, 3).collect()}
    assert set(out) == set(m.prep.names_in) and {r["method"] for r in out.values()} == {"permutation"}
    top = sorted(out, key=lambda f: -out[f]["importance"])[:2]
    assert set(top) == {"feature_001", "feature_004"}
    moved = TR.permuted(units, [1], 2).collect()
    assert len(moved) == 2 * units.count()
    for rep in (0, 1):
        mine = sorted(r["x"][1] for r in moved if r["repeat"] == rep)
        assert mine == sorted(r["x"][1] for r in units.collect())
