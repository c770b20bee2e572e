"""Registered queries: the contract, and a selection beside its SQL.

All queries are compared by ``python tests/oracle_check.py``.
"""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

DATA = "/root/testdata/sf0.001"
SELECTION = ["b01_null_report", "c12_cleaning_audit", "c12_position_audit", "d08_cumulative_distance", "d15_scheduled_speed", "e03_label_rejections",
             "f09_rolling_previous", "g06_provenance", "l03_stratified_errors", "m08_combined_disruption", "n06_snapshot_quantiles", "n13_trailing_residuals",
             "o07_categorical_psi", "o13_performance_windows", "p06_trigger_decisions", "q01_transition_check", "stream_n02_resolution"]


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_contract():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 150


def test_flagship(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", SELECTION)
def test_query_equals_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, DATA), duck, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["e01_time_to_next_record", "f09_rolling_previous", "l01_regression_metrics", "n06_snapshot_quantiles", "o03_ks_test"])
def test_query_equals_sql_in_many_blocks(spark, duck, small_blocks, name):
    assert compare(entry.queries()[name](spark, DATA), duck, entry.oracle_sql()[name]) is None
