"""Exact k nearest neighbours over pivot cells: brute force, pruned pairs, copies, nulls."""
import numpy as np
import pytest

from fabspark.operators import smote as SM
from fabspark.operators.knn import knn

SCHEMA = "unit_id long, y int, x array<double>"


def _brute(q, r, k, exclude_self=True):
    out = {}
    for i, (qid, qx) in enumerate(q):
        d = sorted((float(((np.array(qx) - np.array(rx)) ** 2).sum()), rid) for rid, rx in r if not (exclude_self and rid == qid))
        out[qid] = [rid for _, rid in d[:k]]
    return out


def _lists(df):
    got = {}
    for r in df.orderBy("qid", "slot").collect():
        got.setdefault(r["qid"], []).append(r["nid"])
    return got


@pytest.mark.parametrize("seed,dims,exclude_self", [(1, 3, True), (2, 8, False)])
def test_clustered_rows_compare_few_pairs(spark, seed, dims, exclude_self):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dims)) * 20
    x = np.vstack([c + rng.normal(size=(20, dims)) for c in centres])
    rows = [(i, i % 3, x[i].tolist()) for i in range(len(x))]
    df = spark.createDataFrame(rows, SCHEMA)
    stats = {}
    got = _lists(knn(df, df, 4, exclude_self=exclude_self, cell_rows=15, block_rows=16, stats=stats))
    assert got == _brute([(i, v) for i, _, v in rows], [(i, v) for i, _, v in rows], 4, exclude_self)
    assert stats["pairs"] < 0.3 * len(rows) ** 2


def test_ties_on_a_grid_and_other_reference(spark):
    rows = [(i, 0, [float(i % 9), float(i // 9)]) for i in range(81)]
    q = spark.createDataFrame([(1000 + i, 1, [v / 2 for v in r[2]]) for i, r in enumerate(rows)], SCHEMA)
    got = _lists(knn(q, spark.createDataFrame(rows, SCHEMA), 5, cell_rows=6))
    assert got == _brute([(1000 + i, [v / 2 for v in r[2]]) for i, r in enumerate(rows)], [(i, v) for i, _, v in rows], 5)


def test_a_point_that_holds_a_third_of_the_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [1.0, 1.0] if i % 3 == 0 else rng.normal(size=2).round(1).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    stats = {}
    got = _lists(knn(df, df, 3, cell_rows=20, block_rows=50, stats=stats))
    assert got == _brute([(i, v) for i, _, v in rows], [(i, v) for i, _, v in rows], 3)
    assert stats["points"] <= 400 + 4                                      # k + 1 copies of the hot point stay


def test_nulls_repeats_small_and_empty_tables(spark):
    rows = [(1, 0, [0.0, 0.0]), (2, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 1, None), (4, 1, [None, 1.0]),
            (5, 1, [float("nan"), 1.0]), (6, 1, [float("inf"), 1.0]), (None, 1, [3.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = _lists(knn(df.filter("unit_id is not null"), df.filter("unit_id is not null"), 3))
    assert got == {1: [2, 2], 2: [1]}
    empty = df.limit(0)
    assert knn(empty, df, 2).count() == 0 and knn(df, empty, 2).count() == 0
    with pytest.raises(ValueError, match="lengths"):
        ragged = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [1.0, 2.0])], SCHEMA)
        knn(ragged, ragged, 1)


def test_string_ids(spark):
    rows = [(f"u{i:02d}", i % 2, [float(i), float(i % 4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "unit_id string, y int, x array<double>")
    got = _lists(knn(df, df, 2, cell_rows=5))
    assert got == _brute([(i, v) for i, _, v in rows], [(i, v) for i, _, v in rows], 2)


def test_resamplers_use_the_pruned_search(spark):
    assert SM.knn is knn
