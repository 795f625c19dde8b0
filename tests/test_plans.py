"""Plan-shape checks: the properties that matter at scale stay true."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

from tablelens.plans.registry import QUERIES

# training and flows run as many jobs; what is left of them in a plan is the reading of a result
SKIP = {n for n in QUERIES if n.startswith(("regression_metrics_lineitem", "model_", "analyze_", "run_"))}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_driver_window_reaches_parquet_scan(spark):
    plan = _plan(entry.queries()["top_drivers_orders"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan


def test_column_pruning(spark):
    plan = _plan(entry.queries()["weekly_series_orders"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
    assert plan.count("FileScan parquet") == 1  # gap filling does not re-scan


def test_top_k_limited_before_exchange(spark):
    df = entry.queries()["top_drivers_orders"](spark, SF_SMALL)
    df.collect()
    plan = _plan(df)
    assert "WindowGroupLimit" in plan


def _jobs(spark, name, run) -> int:
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    run()
    return len(sc.statusTracker().getJobIdsForGroup(name))


def test_statistics_passes_are_shared(spark):
    """Jobs (one per query stage): a pass that is no longer shared shows up here."""
    from tablelens.operators import cleaning, stats
    from tablelens.plans.fixtures import dirty_events, table

    d = dirty_events(spark, SF_SMALL)
    assert _jobs(spark, "clean", lambda: cleaning.clean(d, id_col="user_id", ts_col="ts")) <= 17
    li = table(spark, SF_SMALL, "lineitem")
    probs = {c: [0.5, 0.99] for c in ("l_quantity", "l_extendedprice", "l_tax", "l_discount")}
    assert _jobs(spark, "quantiles", lambda: stats.exact_quantiles(li, probs)) <= 8


def test_exact_duplicates_take_one_scan_and_no_join(spark):
    from tablelens.operators.profile import exact_row_counts
    from tablelens.plans.fixtures import table

    plan = _plan(exact_row_counts(table(spark, SF_SMALL, "documents")))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 2 and "Join" not in plan
