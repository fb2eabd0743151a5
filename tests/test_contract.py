import __spark_entry__ as E
from fabspark.plans import catalog
from conftest import SF001


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3
    assert {"model", "rank", "aic", "weighted_rmse", "d0"} <= set(df.columns)


def test_catalog_consistency():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) > 100
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())
    for name in catalog.QUERIES:
        assert not name.startswith("op") and "pipeline" not in name


def test_some_queries_run_on_smoke_data(spark):
    q = E.queries()
    for name in ("waf_03_yield_curve", "evl_05_average_precision", "rte_02_route", "agg_02_missingness"):
        assert q[name](spark, SF001).count() >= 0
