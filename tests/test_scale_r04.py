"""Samplers of all folds share their jobs; forests count only the features that a node draws."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from fabspark.operators import smote as SM
from fabspark.operators import train as TR
from fabspark.operators import trees as T


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(i % 4 == 0), (rng.normal(size=3) + 1.5 * (i % 4 == 0)).tolist()) for i in range(120)]
    return spark.createDataFrame(rows, "unit_id long, y int, x array<double>").cache()


@pytest.mark.parametrize("sampler", [SM.smote, SM.smote_enn, SM.smote_tomek])
def test_groups_are_resampled_as_each_alone(spark, units, sampler):
    wide = units.where("unit_id < 90").withColumn("x", F.concat("x", F.array(F.lit(0.5))))       # vectors of another length
    both = units.withColumn("out", F.lit(0)).unionByName(wide.withColumn("out", F.lit(3)))
    got = {g: set() for g in (0, 3)}
    for r in sampler(both, seed=3, group="out").collect():
        got[r["out"]].add((r["unit_id"], r["y"], tuple(r["x"])))
    for g, alone in ((0, units), (3, wide)):
        assert got[g] == {(r["unit_id"], r["y"], tuple(r["x"])) for r in sampler(alone, seed=3).collect()}


def test_searches_do_not_grow_with_the_folds(spark, units, monkeypatch):
    calls = []
    real = SM.knn
    monkeypatch.setattr(SM, "knn", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    with TR.Folds(units, 4) as folds:
        rows = [folds.training(i, "smote_enn").count() for i in range(4)]
    assert len(calls) == 2 and all(n > 60 for n in rows)


@pytest.mark.parametrize("share", ["sqrt", "log2", 0.3])
def test_forest_counts_only_what_nodes_draw(share, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 14)).round(1), rng.integers(0, 2, (300, 6))], axis=1)
    y = (x[:, 1] + rng.normal(size=300) > 0).astype(float)
    copies = [{t: 1 + (i + t) % 3 for t in range(3) if (i * 7 + t) % 4} for i in range(300)]
    counted = []
    real = np.bincount
    monkeypatch.setattr(T.np, "bincount", lambda v, *a: (counted.append(len(v)), real(v, *a))[1])
    some = T.forest(x, y, np.ones(300), copies, range(3), {"max_features": share}, 0)
    few, counted[:] = sum(counted), []
    whole = T.forest(x, y, np.full(300, 0.5), copies, range(3), {"max_features": share}, 0)      # halves: all features are counted
    assert few < sum(counted)
    for a, b in zip(some, whole):
        assert {k: v for k, v in a.items() if k != "gain"} == {k: v for k, v in b.items() if k != "gain"}
        assert a["gain"] == [2 * v for v in b["gain"]]
