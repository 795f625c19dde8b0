"""The two smoke cases of the original project, on Spark."""

from tablelens.operators import profile, roles


def test_infer_columns_basic(spark):
    df = spark.createDataFrame(
        [(1, "2025-01-01", 10.5, "A"), (2, "2025-01-02", 9.0, "B"), (3, "2025-01-03", 11.2, "A")],
        "id bigint, event_ts string, value double, category string",
    )
    info = {r["column"]: r for r in roles.infer_columns(df).collect()}
    assert info["value"]["is_numeric"]
    assert info["category"]["is_categorical"]
    assert info["event_ts"]["is_datetime"]


def test_profile_reports_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "a bigint")
    assert profile.table_summary(df).first()["rows"] == 3
