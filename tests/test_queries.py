"""Every registered query with a SQL check, compared on the smallest tables."""

import pytest
from check import compare, connection

import __spark_entry__ as entry_points

CHECKS = entry_points.oracle_sql()
JOBS = entry_points.queries()
# Minutes of fitting each; `python tools/check.py` runs them, the operators have tests of their own.
LONG_FITS = {
    "fs4_forest_importance", "fs7_full_selection", "a22_feature_set_comparison", "m01_model_factory",
    "m02_algorithm_registry", "m08_algorithm_scan", "m16_top_importances",
    "m18_model_benchmark", "m19_learning_curves", "s09_tuning_results_csv",
}


def test_registry_is_complete():
    assert set(CHECKS) <= set(JOBS)
    assert entry_points.entry is not None


@pytest.mark.parametrize("name", sorted(set(CHECKS) - LONG_FITS))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(JOBS[name](spark, sf_dir), connection(sf_dir), CHECKS[name]) == ""


def test_flagship(spark):
    rows = entry_points.entry(spark).collect()
    assert sum(r.customers for r in rows) == 1500
