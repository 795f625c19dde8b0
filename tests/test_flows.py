from hypothesis import given, settings
from hypothesis import strategies as st

from tablelens.operators import quality
from tablelens.plans import flows
from tablelens.plans.fixtures import dirty_events, sales

from conftest import SF_SMALL


def test_analyze_sales(spark, tmp_path):
    res = flows.analyze(sales(spark, SF_SMALL), out=str(tmp_path))
    assert res["mapping"]["event_ts"] == "event_ts" and res["mapping"]["value"] == "value"
    cleaned = res["cleaned"]
    assert cleaned.count() > 0
    assert res["drivers"].count() > 0
    assert {r["stage"] for r in res["quality_diff"].collect()} == {"raw", "cleaned"}
    assert 1 <= res["takeaways"].count() <= 3
    assert set(res["charts"]) >= {"missingness", "histogram", "timeseries"}
    assert set(res["paths"]) == {"clean_csv", "clean_parquet", "drivers", "schema"}
    assert spark.read.parquet(res["paths"]["clean_parquet"]).count() == cleaned.count()


def test_gated_run_stops_on_fail(spark):
    res = flows.run_gated(dirty_events(spark, SF_SMALL))
    assert res["passed"] is False and res["status"] == "stopped by quality gate"
    assert "analysis" not in res


def test_gated_run_forced(spark):
    res = flows.run_gated(dirty_events(spark, SF_SMALL), force=True)
    assert res["status"] == "completed" and res["analysis"]["cleaned"].count() > 0


def test_validate(spark):
    res = flows.validate(dirty_events(spark, SF_SMALL))
    assert res["roles"] == {"id": "user_id", "ts": "ts", "value": "value"}
    codes = {r["code"] for r in res["actions"].collect()}
    assert "drop_exact_duplicates" in codes


def test_run_flow(spark):
    res = flows.run_flow(sales(spark, SF_SMALL))
    assert res["summary"].first()["rows"] > 0
    assert res["gate"].count() == 1
    assert {r["column"] for r in res["columns"].collect()} == set(sales(spark, SF_SMALL).columns)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=8), st.integers(min_value=0, max_value=6))
def test_mask_keeps_length(spark, texts, k):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    out = [r["s"] for r in quality.mask_column(df, "s", k).collect()]
    assert [len(o) for o in out] == [len(t) for t in texts]
    assert all(o[-k:] == t[-k:] if k and len(t) > k else o == t or k == 0 for o, t in zip(out, texts))


@settings(max_examples=10, deadline=None)
@given(
    st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e9, max_value=1e9), min_size=1, max_size=60),
    st.floats(min_value=0, max_value=1),
)
def test_quantile_property(spark, values, p):
    import numpy as np

    from tablelens.operators.stats import exact_quantiles

    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, {"x": [p]}, max_candidates=3, buckets=3)["x"][0]
    want = float(np.quantile(np.array(values), p))
    assert abs(got - want) <= 1e-9 * max(1.0, abs(want))
