import pytest

from tablelens.operators import cleaning
from tablelens.plans.fixtures import dirty_events

from conftest import SF_SMALL


def test_trim_unicode_whitespace_keeps_null(spark):
    df = spark.createDataFrame([(" a ",), ("\tb ",), (None,)], "s string")
    assert [r["s"] for r in cleaning.trim_strings(df).collect()] == ["a", "b", None]


def test_keep_first_by_order(spark):
    df = spark.createDataFrame(
        [(1, "t", "b", 2.0), (1, "t", "a", 9.0), (1, "t", None, 5.0), (2, "t", "z", 1.0)],
        "id int, ts string, s string, v double",
    )
    out = {r["id"]: r for r in cleaning.drop_duplicates(df, ["id", "ts"]).collect()}
    assert out[1]["s"] is None and out[1]["v"] == 5.0  # nulls first
    out = {r["id"]: r for r in cleaning.drop_duplicates(df, ["id", "ts"], order_by=["v"]).collect()}
    assert out[1]["v"] == 2.0
    assert cleaning.drop_duplicates(df, ["id", "ts"]).columns == df.columns


def test_winsorize_bounds_and_nulls(spark):
    rows = [(float(i),) for i in range(100)] + [(None,)]
    df = spark.createDataFrame(rows, "x double")
    out, report = cleaning.winsorize(df)
    vals = [r["x"] for r in out.collect()]
    assert None in vals
    hi = max(v for v in vals if v is not None)
    assert hi == pytest.approx(98.01)
    assert report.first()["affected"] == 1


def test_impute_numeric_median_and_categorical_mode(spark):
    df = spark.createDataFrame(
        [(1.0, "b"), (None, "a"), (3.0, None), (10.0, "b"), (None, "a")], "x double, s string"
    )
    num, _ = cleaning.impute_numeric(df)
    assert sorted(r["x"] for r in num.collect()) == [1.0, 3.0, 3.0, 3.0, 10.0]
    cat, _ = cleaning.impute_categorical(df)
    assert sorted(r["s"] for r in cat.collect()) == ["a", "a", "a", "b", "b"]


def test_all_null_text_gets_unknown(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    out, _ = cleaning.impute_categorical(df)
    assert {r["s"] for r in out.collect()} == {"UNKNOWN"}


def test_clean_properties_on_dirty_events(spark):
    raw = dirty_events(spark, SF_SMALL)
    out, report = cleaning.clean(raw, id_col="user_id", ts_col="ts")
    rows = out.collect()
    assert all(v is not None for r in rows for v in r)  # nothing missing
    assert all(r["event_type"] == r["event_type"].strip() for r in rows)
    # a second de-duplication removes nothing
    assert cleaning.drop_duplicates(out, ["user_id", "ts"]).count() == len(rows)
    steps = {r["step"] for r in report.collect()}
    assert {"trim", "drop_exact_duplicates", "drop_pair_duplicates", "winsorize", "rows"} <= steps


def test_fallback_cleaner_caps_above_only(spark):
    df = spark.createDataFrame([(1, "t", float(i)) for i in range(100)], "id int, ts string, v double")
    out = cleaning.clean_fallback(df)
    vals = sorted(r["v"] for r in out.collect())
    assert vals[0] == 0.0 and vals[-1] == pytest.approx(98.01)


def test_business_casts(spark):
    df = spark.createDataFrame([("7", 2.5), ("inf", 3.5), ("x", None)], "order_id string, review_score double")
    rows = cleaning.business_casts(df).collect()
    assert [r["order_id"] for r in rows] == [7, None, None]
    assert [r["review_score"] for r in rows] == [2, 4, None]  # half-even
