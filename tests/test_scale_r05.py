"""Trees count every row of a frame, whatever its size."""
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabspark.operators import spread_trees as ST
from fabspark.operators import train as TR
from fabspark.operators import trees as T


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(400, 4)), rng.integers(0, 2, (400, 1))], axis=1)
    y = (x[:, 1] + x[:, 3] + 0.5 * rng.normal(size=400) > 1).astype(int)
    rows = [(0, i, int(c), r.tolist()) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "frame int, unit_id long, y int, features array<double>").repartition(3).cache(), x, y


def _model(estimator, **params):
    return {"frame": 0, "estimator": estimator, "params": TR._params(estimator, params), "weights": {0: 1.0, 1: 3.0}}


@pytest.mark.parametrize("params", [{"max_iter": 10, "max_leaf_nodes": 6}, {"max_iter": 9, "max_leaf_nodes": 31, "max_depth": 4}])
def test_boosted_trees_of_a_large_frame_are_those_of_all_rows(frame, params, monkeypatch):
    rows, x, _ = frame
    rows = rows.withColumn("features", F.transform("features", lambda v: F.round(v, 1)))        # few values: the same bins
    models = [_model("hist_gb", **params)]
    (near,), (spread,) = T.fit_trees(rows, models), T.fit_trees(rows, models, max_rows=50)
    assert spread.feature == near.feature and spread.left == near.left and spread.roots == near.roots
    assert np.allclose(spread.edge, near.edge) and np.allclose(spread.value, near.value) and np.allclose(spread.gain, near.gain)
    assert spread.base == pytest.approx(near.base)


def test_boosting_and_forests_of_large_frames_learn(frame):
    rows, x, y = frame
    models = [_model("xgboost", n_estimators=20), _model("balanced_rf", n_estimators=30, max_features=0.5)]
    for fitted in T.fit_trees(rows, models, max_rows=60):
        assert np.mean((fitted.probability(x) > 0.5) == y) > 0.85
        assert set(np.argsort(fitted.importances(5))[-2:]) == {1, 3}


def test_forests_of_large_frames_use_every_draw(spark, frame):
    rows, x, y = frame
    draws = T.balanced_draws(rows, 4).groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct("tree", "copies"))).alias("c"))
    drawn = {r["unit_id"]: dict(r["c"]) for r in draws.collect()}
    fitted, = T.fit_trees(rows, [{**_model("balanced_rf", n_estimators=4, max_features=1.0), "weights": {}}], max_rows=60)
    assert len(fitted.roots) == 4 and all(fitted.value[r] == 0.5 for r in fitted.roots)
    leaves = {fitted.value[i] for i, f in enumerate(fitted.feature) if f < 0}
    assert leaves == {0.0, 1.0}
    for t, root in enumerate(fitted.roots):                       # a tree alone tells every row that it drew
        one = T.TreeEnsemble(False, 0.0, [root], fitted.feature, fitted.edge, fitted.left, fitted.right, fitted.value, fitted.gain)
        mine = [i for i, c in drawn.items() if t in c]
        assert (one.probability(x[mine]) == y[mine]).all()


def test_cuts_come_from_all_rows(spark):
    rows = spark.range(0, 3000, 1, 5).select(F.lit(2).alias("frame"), F.array(F.col("id").cast("double"), (F.col("id") % 3).cast("double")).alias("features"))
    edges = ST.frame_edges(rows)[2]
    assert len(edges[0]) == T.MAX_BINS and np.abs(edges[0] - np.linspace(0, 2999, 256)[:-1] - 2999 / 510).max() < 3
    assert edges[1].tolist() == [0.5, 1.5]


def test_join_keeps_no_keys_and_frees_its_shuffles(spark, monkeypatch, tmp_path):
    """The Jaccard join's list keys and n-grams are neither checkpointed nor gathered; shuffle files go as soon as they are read."""
    from fabspark.llm import components, jaccard_join
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept, freed = spark.conf.get(key, None), [], []
    for module in (jaccard_join, components):
        real = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, real=real: (kept.append(df.columns), freed.append(spark.conf.get(key, None)), real(df))[-1])
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words here at all")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_components(docs, 4, 85).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert kept and not any({"keys", "grams", "text"} & set(c) for c in kept)
    assert set(freed) == {"true"} and spark.conf.get(key, None) == before


def test_draws_are_never_broadcast(spark, frame):
    rows, _, _ = frame
    draws = T.balanced_draws(rows, 300)._jdf.queryExecution()
    assert draws.toRdd().count() > 0
    plan = draws.executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in plan.split("\n") if "Join [" in line and "rank#" in line]
    assert joins and not any("Broadcast" in line for line in joins)


def test_trees_of_all_models_are_scored_in_one_pass(spark, frame):
    rows, x, _ = frame
    some = T.fit_trees(rows, [_model("xgboost", n_estimators=3), _model("hist_gb", max_iter=3)])
    folded = rows.select((F.col("unit_id") % 2).cast("int").alias("fold"), "unit_id", "y", "features")
    got = T.scored_together(folded, {0: [(4, some[0])], 1: [(4, some[1]), (5, some[0])]}).collect()
    assert len(got) == 600 and {(r["fold"], r["config"]) for r in got} == {(0, 4), (1, 4), (1, 5)}
    want = [m.probability(x) for m in some]
    assert all(r["score"] == want[int(r["fold"] == 1 and r["config"] == 4)][r["unit_id"]] for r in got)
    assert len(pickle.dumps(some[0])) < 40 * len(some[0].feature) + 2000
