import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF01
from fabspark.operators import prep as PR
from fabspark.operators import resample as RS
from fabspark.operators import smote as SM
from fabspark.operators import split as SP
from fabspark.sources import fixtures as FX


def test_stratified_split_exact_disjoint_deterministic(spark):
    s = FX.sensors(spark, SF01).select("unit_id", "y")
    a = SP.stratified_split(s).cache()
    b = SP.stratified_split(s).cache()
    counts = {(r["y"], r["split"]): r["count"] for r in a.groupBy("y", "split").count().collect()}
    assert counts == {(0, "test"): 90, (1, "test"): 10, (0, "train"): 360, (1, "train"): 40}
    assert a.count() == 500 and a.select("unit_id").distinct().count() == 500
    assert a.exceptAll(b).count() == 0


def test_three_way_and_folds(spark):
    df = spark.createDataFrame([(i, "A" if i % 3 else "B") for i in range(200)], "wafer_id long, label string")
    s = SP.stratified_three_way(df, "label", "wafer_id")
    sizes = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 200 and sizes["test"] == 30
    f = SP.stratified_folds(df.withColumnRenamed("wafer_id", "unit_id").withColumnRenamed("label", "y"), 5)
    per = f.groupBy("y", "fold").count().toPandas()
    for _, g in per.groupby("y"):
        assert g["count"].max() - g["count"].min() <= 1
    assert f.count() == 200


def test_approximate_mode_sums():
    got = SP.approximate_mode({"a": 7, "b": 3, "c": 1}, 5)
    assert sum(got.values()) == 5 and got["a"] >= got["b"] >= got["c"]


def test_prep_is_fitted_on_train_only(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 5 == 0), [float(v) if rng.random() > 0.1 else None for v in rng.normal(size=6)])
            for i in range(200)]
    train = spark.createDataFrame(rows, "unit_id long, y int, x array<double>")
    poison = spark.createDataFrame([(999, 1, [1e9] * 6)], "unit_id long, y int, x array<double>")
    m1 = PR.fit(train)
    m2 = PR.fit(train)
    out = m1.transform(poison).first()["features"]
    assert m1.medians == m2.medians and m1.means == m2.means
    assert all(abs(v) > 1e6 for v in out[:6])          # the 6 original columns come first
    # indicators exist for columns with 5 % < missing rate < 100 %
    assert all(n.endswith("__missing") for n in m1.names_with_indicators[6:])


def test_random_over_and_under_balance(spark):
    s = FX.sensors(spark, SF01).select("unit_id", "y")
    over = {r["y"]: r["count"] for r in RS.random_over(s).groupBy("y").count().collect()}
    under = {r["y"]: r["count"] for r in RS.random_under(s).groupBy("y").count().collect()}
    assert over == {0: 450, 1: 450} and under == {0: 50, 1: 50}


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, int(i % 4 == 0), x[i].tolist()) for i in range(60)],
                               "unit_id long, y int, x array<double>")
    nn = SM.knn(df, df, 3, block_rows=16).toPandas()       # several blocks per side
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for i in range(60):
        exp = sorted(range(60), key=lambda j: (d[i, j], j))[:3]
        got = nn[nn.qid == i].sort_values("slot")["nid"].tolist()
        assert got == exp


def test_smote_points_on_segments(spark):
    df = FX.dense_sensors(spark, SF01)
    out = SM.smote(df).cache()
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 450
    mino = np.array([r["x"] for r in df.filter("y = 1").collect()])
    syn = np.array([r["x"] for r in out.filter("synthetic").limit(20).collect()])
    for p in syn:   # each synthetic point lies between some minority pair
        dists = np.linalg.norm(mino - p, axis=1)
        assert dists.min() < np.linalg.norm(mino[:, None] - mino[None], axis=2).max()


def test_unknown_strategy_rejected():
    import pytest
    with pytest.raises(ValueError):
        RS.build_plan("undersample")
