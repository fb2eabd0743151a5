"""The registered training queries run the whole job: the operators' own defaults."""
import inspect

import pytest

from conftest import SF001
from fabspark.operators import train as TR
from fabspark.operators import wafer as W
from fabspark.plans import catalog
from fabspark.plans import sensor_plan as SPL

CASES = [("trn_02_balanced_rf", TR, "fit_sensor_model"), ("trn_03_hist_gb", TR, "fit_sensor_model"),
         ("trn_04_xgboost", TR, "fit_sensor_model"), ("trn_06_compare_configs", TR, "compare_configs"),
         ("trn_07_tune", TR, "tune"), ("trn_10_holdout_comparison", TR, "holdout_comparison"),
         ("trn_11_sensor_run", SPL, "run"), ("trn_12_wafer_classifier", TR, "fit_wafer_classifier"),
         ("rte_06_wafer_batch_scoring", TR, "fit_wafer_classifier")]
SIZES = {"params", "base_params", "configs", "k", "n_iter", "n_trees", "k_features"}


class Called(Exception):
    pass


@pytest.mark.parametrize("query,module,name", CASES)
def test_defaults(spark, monkeypatch, query, module, name):
    signature, seen, widths, resized = inspect.signature(getattr(module, name)), {}, [], W.resized

    def record(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Called

    monkeypatch.setattr(module, name, record)
    monkeypatch.setattr(W, "resized", lambda maps, size: (widths.append(size), resized(maps, size))[1])
    catalog.load_all()
    with pytest.raises(Called):
        catalog.QUERIES[query](spark, SF001)
    for key in SIZES & set(seen):
        assert seen[key] == signature.parameters[key].default, key
    assert set(widths) <= {64}
