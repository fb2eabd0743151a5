import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fabspark.operators import profile as P
from fabspark.operators.cumulative import running_sums
from fabspark.operators.quantiles import exact_quantiles
from fabspark.sources import fixtures as FX


def test_sensor_fixture_checks(spark):
    s = FX.sensors(spark, SF01).cache()
    assert s.count() == 500
    assert s.filter("y = 1").count() == 50
    miss = P.missingness(s).cache()
    assert miss.agg(F.sum("missing_count")).first()[0] == 3015
    assert P.high_missing_features(miss).count() == 4
    # two features sit exactly at 5 %: 17 strictly inside (0.05, 1) (the indicator rule), 19 with >= 0.05
    assert miss.filter((F.col("missing_rate") > 0.05) & (F.col("missing_rate") < 1)).count() == 17
    assert miss.filter((F.col("missing_rate") >= 0.05) & (F.col("missing_rate") < 1)).count() == 19
    assert P.dead_features(P.variance_report(s)).count() == 2
    top = P.top_associated(P.point_biserial(s), 1).first()
    assert abs(top["abs_corr"] - 0.110277) < 1e-6


@pytest.mark.parametrize("max_collect", [5, 50_000])
def test_exact_quantiles_match_numpy(spark, max_collect):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=700), np.full(300, 0.25), [np.nan] * 5])
    g = np.repeat(["a", "b"], [600, 405])
    pdf = pd.DataFrame({"g": g, "v": vals})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in exact_quantiles(df, ["g"], "v", probs, max_collect=max_collect,
                                                             buckets=8).collect()}
    for key, grp in pdf.groupby("g"):
        x = grp["v"].dropna().to_numpy()
        for p in probs:
            assert abs(got[(key, p)] - np.percentile(x, p * 100)) < 1e-12


def test_running_sums_multi_range_matches_cumsum(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "o": rng.permutation(400).astype(float),
                        "v": rng.integers(0, 5, 400)})
    out = running_sums(spark.createDataFrame(pdf), "o", ["v"], ["g"], descending=True, target_rows=17,
                       next_cols=["v"]).toPandas()
    for key, grp in pdf.groupby("g"):
        e = grp.sort_values("o", ascending=False)
        got = out[out.g == key].set_index("o").loc[e["o"]]
        assert (got["cum_v"].to_numpy() == e["v"].cumsum().to_numpy()).all()
        assert (got["next_v"].to_numpy()[:-1] == e["v"].to_numpy()[1:]).all()
        assert np.isnan(got["next_v"].to_numpy()[-1])


def test_running_sums_many_oversized_groups(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": np.repeat(np.arange(300), 5), "o": rng.permutation(1500).astype(float),
                        "v": rng.integers(0, 5, 1500)})
    out = running_sums(spark.createDataFrame(pdf), "o", ["v"], ["g"], descending=False, target_rows=2).toPandas()
    exp = pdf.sort_values("o").assign(cum=lambda d: d.groupby("g")["v"].cumsum())
    got = out.set_index("o").loc[exp["o"]]
    assert (got["cum_v"].to_numpy() == exp["cum"].to_numpy()).all()


def test_temporal_fixture_check(spark):
    t = P.temporal_failure_rate(FX.timeline(spark, SF01, drop_days=True)).cache()
    assert t.count() == 30
    assert t.filter("n > 0").count() == 26
    agg = t.agg(F.sum("n"), F.sum("fails")).first()
    assert (agg[0], agg[1]) == (8683, 1763)
    assert t.filter("n = 0 AND fail_rate IS NULL").count() == 4


def test_class_weights_and_scale_pos_weight(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)], "y int")
    w = {r["y"]: r["weight"] for r in P.class_weights(df).collect()}
    assert w == {0: 10 / 18, 1: 5.0}
    assert P.scale_pos_weight(df).first()[0] == 9.0
    assert P.scale_pos_weight(spark.createDataFrame([(0,)], "y int")).first()[0] == 1.0


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4]], "v double")
    h = {r["bin"]: r["count"] for r in P.histogram(df, "v", 4).collect()}
    assert h == {0: 1, 1: 1, 2: 1, 3: 2}
