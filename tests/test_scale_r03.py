"""Plans that stay small, bounded memory, same results: the findings of round 3."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fabspark.operators import knn as K
from fabspark.operators import quantiles as Q
from fabspark.operators import smote as SM
from fabspark.operators import train as TR
from fabspark.operators import trees as T
from fabspark.session import cut_computed


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 4))
    rows = [(i, int(v[0] > 0.5), [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "unit_id bigint, y int, x array<double>").cache()
    assert df.count() == 120
    return df


def persisted(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_union_of_computed_vectors_is_cut(spark, units):
    at = F.array(F.lit(0), F.lit(2))
    part = units.withColumn("v", F.transform(at, lambda i: F.coalesce(F.get("x", i), F.lit(0.0))))
    both = part.select("unit_id", F.get("v", 0).alias("s")).unionByName(part.select("unit_id", F.get("v", 1).alias("s")))
    before = persisted(spark)
    out = cut_computed(both)
    assert out.count() == 240 and persisted(spark) == before
    assert "LogicalRDD" in out._jdf.queryExecution().logical().toString().replace("Scan ExistingRDD", "LogicalRDD")


def test_search_leaves_no_caches_and_neighbours_travel_by_pack(spark, units):
    before, stats = persisted(spark), {}
    got = K.knn(units, units, 3, cell_rows=6, block_rows=20, stats=stats).collect()
    assert persisted(spark) == before and len(got) == 360 and stats["cells"] > 3
    cells = K._packed(pd.DataFrame({"cell": [0, 1, 2, 5], "n": [4, 5, 30, 1]}), 10)
    assert cells["pack"].tolist() == [0, 0, 1, 2] and cells["parts"].tolist() == [1, 1, 3, 1]


def test_products_with_large_offsets_give_the_sums_of_squares(spark):
    rng = np.random.default_rng(2)
    x = 1e6 + rng.normal(size=(150, 5)).round(2)
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "unit_id long, y int, x array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for r in K.knn(df, df, 2, cell_rows=30).collect():
        order = np.lexsort((np.arange(150), d[r["qid"]]))
        assert order[r["slot"]] == r["nid"] and r["dist"] == d[r["qid"], r["nid"]]


def test_one_id_on_many_rows_keeps_its_other_neighbours(spark):
    rows = [(1, 0, [0.0]), (1, 0, [0.1]), (1, 0, [0.2]), (2, 1, [5.0]), (3, 1, [9.0])]
    df = spark.createDataFrame(rows, "unit_id long, y int, x array<double>")
    got = {(r["qid"], r["slot"]): r["nid"] for r in K.knn(df, df, 1).collect()}
    assert got == {(1, 0): 2, (2, 0): 3, (3, 0): 2}


def test_edited_smote_has_a_short_plan(spark, units):
    plan = SM.smote_enn(units, seed=3)._jdf.queryExecution().logical().toString()
    assert len(plan) < 20_000


def test_draws_of_logistic_models_are_scored_in_one_run(spark, units):
    with TR.Folds(units, 3) as folds:
        metrics, oof = TR.cross_validate_many(folds, [("logreg", "class_weight", {"C": c}) for c in (0.1, 1.0, 10.0)])
    assert metrics.count() == 9 and oof.count() == 360


def test_brackets_are_broadcast(spark, monkeypatch):
    sent = []
    real = Q.F.broadcast
    monkeypatch.setattr(Q.F, "broadcast", lambda d: (sent.append(1), real(d))[1])
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 1.0).alias("v"))
    got = {r["g"]: r["median"] for r in Q.exact_median(df, ["g"], "v", max_collect=50, buckets=8).collect()}
    assert got == {0: 1499.0, 1: 1500.0} and len(sent) >= 2


def test_trees_hold_a_bounded_number_of_histograms(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5))
    y = (rng.random(400) < 0.5).astype(float)
    copies = [{0: 1 + i % 3} for i in range(400)]
    whole = T.forest(x, y, np.ones(400), copies, range(1), {"max_features": "sqrt"}, 0)
    monkeypatch.setattr(T, "HELD_HISTOGRAMS", 2)
    monkeypatch.setattr(T, "SUM_ENTRIES", 1000)
    assert T.forest(x, y, np.ones(400), copies, range(1), {"max_features": "sqrt"}, 0) == whole


def test_wafer_trees_read_few_parts(spark, monkeypatch):
    seen = []
    real = TR.RandomForestClassifier.fit
    monkeypatch.setattr(TR.RandomForestClassifier, "fit", lambda self, d: (seen.append(d.rdd.getNumPartitions()), real(self, d))[1])
    maps = spark.range(60).repartition(30).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"),
                                                  F.array((F.col("id") % 2).cast("double"), F.lit(1.0)).alias("x"))
    TR.fit_wafer_classifier(maps, ["a", "b"], n_trees=2)
    assert seen == [1]


def test_maps_to_score_are_dealt_over_all_tasks(spark):
    from fabspark.operators import score as S
    maps = spark.range(50).coalesce(1).select(F.col("id").alias("request_id"), F.lit(0).alias("map_idx"))
    assert S.dealt(maps).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert S.dealt(maps).count() == 50
