"""Neighbour-based mutual information against a plain version; digamma; ranges, blocks, ties, nulls."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabspark.operators import prep as PR
from fabspark.operators.mutual_info import digamma, neighbour_mutual_information

SCHEMA = "unit_id long, y int, x array<double>"


def _psi(n):
    return -0.57721566490153286 + sum(1 / j for j in range(1, n))


def _plain(v, y, k=3):
    rows = [(a, c) for a, c in zip(v, y) if list(y).count(c) > 1]
    if not rows:
        return None
    total = 0.0
    for at, (a, c) in enumerate(rows):
        same = sorted(abs(b - a) for j, (b, e) in enumerate(rows) if e == c and j != at)
        k_c = min(k, len(same))
        r = same[k_c - 1]
        m = sum(abs(b - a) < r or b == a for b, _ in rows)
        total += _psi(k_c) - _psi(len(same) + 1) - _psi(m)
    return max(0.0, _psi(len(rows)) + total / len(rows))


def test_digamma(spark):
    got = spark.range(1, 200).select("id", digamma(F.col("id")).alias("p")).collect()
    assert all(abs(r["p"] - _psi(r["id"])) < 1e-13 * max(1, abs(r["p"])) for r in got)


@pytest.mark.parametrize("target_rows,block_rows", [(2_000_000, 100_000), (25, 7)])
def test_equals_plain_version(spark, target_rows, block_rows):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 150)
    cols = [np.round((rng.normal(size=150) + y) * 64) / 64,            # related, some ties
            rng.integers(0, 4, 150).astype(float),                     # few values: zero radii
            np.ones(150),                                              # constant
            rng.integers(0, 2 ** 20, 150) / 1024.0]                    # unrelated, exact differences
    df = spark.createDataFrame([(i, int(y[i]), [float(c[i]) for c in cols]) for i in range(150)], SCHEMA)
    got = {r["i"]: r["mutual_info"] for r in
           neighbour_mutual_information(df, target_rows=target_rows, block_rows=block_rows).collect()}
    for i, c in enumerate(cols):
        assert abs(got[i] - _plain(c, y)) < 1e-10, i
    assert got[0] > got[3]


def test_missing_values_single_rows_and_empty(spark):
    rows = [(i, i % 2, [float(i), None if i % 3 else float(i % 5), None, float("nan") if i == 4 else 1.0 * (i % 2)])
            for i in range(20)] + [(90, 7, [1.0, 1.0, None, 1.0]), (91, None, [99.0, 99.0, 99.0, 99.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["i"]: r["mutual_info"] for r in neighbour_mutual_information(df).collect()}
    kept = [r for r in rows if r[1] is not None]
    for i in (0, 1, 3):
        known = [r[2][i] for r in kept if r[2][i] is not None and not math.isnan(r[2][i])]
        fill = float(np.median(known))
        v = [fill if r[2][i] is None or math.isnan(r[2][i]) else r[2][i] for r in kept]
        assert abs(got[i] - _plain(v, [r[1] for r in kept])) < 1e-10, i
    assert set(got) == {0, 1, 3}                                       # no value in slot 2
    assert neighbour_mutual_information(df.limit(0)).count() == 0


def test_selection_by_mutual_information(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, [float(rng.normal()), float(rng.normal() + 3 * (i % 2)), float(rng.normal())]) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    m = PR.fit(df, k_features=1, score="mutual_info")
    assert m.feature_names == ["feature_001"] and m.scores[1] > 0.3
    with pytest.raises(ValueError, match="score"):
        PR.fit(df, k_features=1, score="other")
