import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fabspark.operators import profile as P
from fabspark.operators import wafer as W
from fabspark.sources import fixtures as FX


def _maps_df(spark, maps, labels=None):
    rows = []
    for i, m in enumerate(maps):
        a = np.asarray(m, dtype=np.int8)
        rows.append((i, int(a.shape[0]), int(a.shape[1]), [int(v) for v in a.ravel()],
                     None if labels is None else labels[i]))
    return spark.createDataFrame(rows, "wafer_id long, rows int, cols int, cells array<tinyint>, "
                                       "failure_raw array<array<string>>")


def _brute(a, w, stride):
    h, wd = a.shape
    v = y = 0
    if h < w or wd < w:
        return 0, 0
    for i in range(0, h - w + 1, stride):
        for j in range(0, wd - w + 1, stride):
            b = a[i:i + w, j:j + w]
            if (b == 0).any():
                continue
            v += 1
            y += int(not (b == 2).any())
    return v, y


def test_curve_matches_fixture_check(spark):
    c = {r["window"]: (r["n_valid"], r["n_yield"]) for r in
         W.yield_curve(W.filter_wafers(FX.wafers(spark, SF01)), min_windows=0).collect()}
    expected = {1: (44800, 43289), 2: (9600, 8355), 3: (4000, 2919), 4: (1600, 908), 5: (1100, 448),
                6: (400, 105), 7: (300, 57), 8: (100, 9)}
    assert c == expected


@pytest.mark.parametrize("stride", [None, 1, 2, 3])
def test_kernel_and_cells_forms_equal_brute_force(spark, stride):
    rng = np.random.default_rng(7)
    maps = [rng.choice([0, 1, 1, 1, 2], size=(h, w)) for h, w in [(5, 7), (9, 9), (3, 2), (12, 10), (9, 9)]]
    df = _maps_df(spark, maps)
    sizes = (1, 2, 3, 4, 11)
    k = {r["window"]: (r["n_valid"], r["n_yield"]) for r in W.count_windows(df, sizes, stride).collect()}
    c = {r["window"]: (r["n_valid"], r["n_yield"]) for r in
         W.count_windows(df, sizes, stride, method="cells").collect()}
    for w in sizes:
        tot = [0, 0]
        for m in maps:
            v, y = _brute(np.asarray(m), w, stride or w)
            tot[0] += v
            tot[1] += y
        assert k[w] == tuple(tot)
        assert c.get(w, (0, 0)) == tuple(tot)


def test_min_windows_filter_and_error(spark):
    df = _maps_df(spark, [np.ones((4, 4))])
    assert W.yield_curve(df, (1, 2), min_windows=1000).count() == 0
    with pytest.raises(ValueError):
        W.require_points(W.yield_curve(df, (1, 2), min_windows=1000))


def test_resize_nearest_and_normalise(spark):
    df = _maps_df(spark, [[[0, 1], [2, 1]]])
    x = W.resized(df, 4).first()["x"]
    assert x == [0.0, 0.0, 0.5, 0.5, 0.0, 0.0, 0.5, 0.5, 1.0, 1.0, 0.5, 0.5, 1.0, 1.0, 0.5, 0.5]


def test_dihedral_variants_match_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(0, 3, size=(6, 6))
    df = _maps_df(spark, [m])
    out = {r["variant"]: r["cells"] for r in W.augment(df, 6, all_variants=True).collect()}
    for v in range(8):
        exp = np.rot90(m, v % 4)
        if v >= 4:
            exp = np.fliplr(exp)
        assert out[v] == [int(t) for t in exp.ravel()]


def test_label_flattening(spark):
    rows = [(1, []), (2, None), (3, [[""]]), (4, [[" Center"]]), (5, [["none"]])]
    df = spark.createDataFrame(rows, "wafer_id long, failure_raw array<array<string>>")
    got = {r["wafer_id"]: r["label"] for r in W.with_labels(df).collect()}
    assert got == {1: "Unlabeled", 2: "Unlabeled", 3: "Unlabeled", 4: "Center", 5: "none"}
    got2 = {r["wafer_id"]: r["label"] for r in W.with_labels(df, token="unlabeled").collect()}
    assert got2[1] == "unlabeled"


def test_eda_self_test_counts(spark):
    # Center x5 (26x26), Scratch x2 (40x35), none x4, empty x3 (26x26)
    maps, labels = [], []
    for _ in range(5):
        maps.append(np.ones((26, 26))); labels.append([["Center"]])
    for _ in range(2):
        maps.append(np.ones((40, 35))); labels.append([["Scratch"]])
    for _ in range(4):
        maps.append(np.ones((26, 26))); labels.append([["none"]])
    for _ in range(3):
        maps.append(np.ones((26, 26))); labels.append([])
    df = W.with_labels(_maps_df(spark, maps, labels))
    counts = {r["label"]: r["count"] for r in P.label_counts(df).collect()}
    assert counts == {"Center": 5, "Scratch": 2, "none": 4, "Unlabeled": 3}
    s = P.summary_stats(df).first()
    assert s["imbalance_ratio"] == 2.5 and s["n_unique_dims"] == 2 and s["n_classes"] == 3


def test_preprocess_self_test_filters(spark):
    maps, labels = [], []
    for name, n in [("Center", 40), ("Scratch", 24), ("none", 32)]:
        for _ in range(n):
            maps.append(np.ones((40, 35)) if name == "Scratch" else np.ones((26, 26)))
            labels.append([[name]])
    for _ in range(10):
        maps.append(np.ones((26, 26))); labels.append([])
    df = W.with_labels(_maps_df(spark, maps, labels))
    assert df.count() == 106
    assert W.filter_labeled(df, drop_none=False).count() == 96
    assert W.filter_labeled(df, drop_none=True).count() == 64


def test_label_counts_fixture_check(spark):
    counts = {r["label"]: r["count"] for r in P.label_counts(W.with_labels(FX.raw_labels(spark, SF01))).collect()}
    assert counts == {"Center": 85, "Donut": 85, "Edge-Loc": 83, "Edge-Ring": 96, "Loc": 95, "Near-full": 106,
                      "Random": 99, "Scratch": 89, "none": 351, "Unlabeled": 411}
