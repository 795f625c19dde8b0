import datetime as dt

from tablelens.operators import timeseries


def _week_edges(spark):
    rows = [
        (dt.datetime(2025, 1, 5, 10, 0), 1.0),    # Sunday 10:00 -> its own week (label 01-05)
        (dt.datetime(2025, 1, 6, 0, 0), 2.0),     # Monday -> next label (01-12)
        (dt.datetime(2025, 1, 26, 23, 59), 4.0),  # Sunday 23:59 -> label 01-26
        (dt.datetime(2025, 1, 20, 8, 0), None),   # null value, same week 01-26
    ]
    return spark.createDataFrame(rows, "ts timestamp_ntz, v double")


def test_week_labels_and_gaps(spark):
    out = timeseries.weekly_series(_week_edges(spark), "ts", "v").collect()
    assert [str(r["week"]) for r in out] == ["2025-01-05", "2025-01-12", "2025-01-19", "2025-01-26"]
    assert [r["n"] for r in out] == [1, 1, 0, 2]
    assert [r["value"] for r in out] == [1.0, 2.0, 0.0, 4.0]


def test_series_spine_has_no_gaps_and_keeps_total(spark):
    df = _week_edges(spark)
    out = timeseries.timeseries(df, "ts", "v", None, "sum", "D").collect()
    days = [r["period"] for r in out]
    assert all((b - a).days == 1 for a, b in zip(days, days[1:]))
    assert sum(r["value"] for r in out) == 7.0


def test_month_end_labels_and_avg_gaps(spark):
    rows = [(dt.datetime(2025, 1, 31), 2.0), (dt.datetime(2025, 3, 1), 4.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    out = timeseries.timeseries(df, "ts", "v", None, "avg", "M").collect()
    assert [str(r["period"]) for r in out] == ["2025-01-31", "2025-02-28", "2025-03-31"]
    assert [r["value"] for r in out] == [2.0, None, 4.0]


def test_ratio_with_quantity(spark):
    rows = [(dt.datetime(2025, 1, 1), 10.0, 2.0), (dt.datetime(2025, 1, 2), 5.0, 0.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double, q double")
    out = timeseries.timeseries(df, "ts", "v", "q", "avg", "D").collect()
    assert [r["value"] for r in out] == [5.0, None]


def _weekly(spark, values):
    start = dt.date(2025, 1, 5)
    rows = [(start + dt.timedelta(weeks=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "week date, value double")


def test_change_needs_eight_weeks(spark):
    assert timeseries.period_change(_weekly(spark, range(7)), "count").count() == 0
    row = timeseries.period_change(_weekly(spark, range(8)), "count").first()
    assert (row["recent_4w"], row["prior_4w"], row["abs_change"]) == (22.0, 6.0, 16.0)


def test_change_prior_zero_gives_null_pct(spark):
    row = timeseries.period_change(_weekly(spark, [0, 0, 0, 0, 1, 1, 1, 1]), "count").first()
    assert row["pct_change"] is None


def test_anomalies_need_twelve_weeks_and_spread(spark):
    assert timeseries.anomalies(_weekly(spark, [1] * 10 + [100]), "count").count() == 0
    assert timeseries.anomalies(_weekly(spark, [5] * 12), "count").count() == 0
    rows = timeseries.anomalies(_weekly(spark, [1] * 11 + [100]), "count").collect()
    assert len(rows) == 1 and rows[0]["value"] == 100.0


def test_unparseable_ts_dropped(spark):
    df = spark.createDataFrame([("2025-01-01",), ("garbage",), (None,)], "ts string")
    out = timeseries.weekly_series(df, "ts").collect()
    assert [r["n"] for r in out] == [1]


def test_empty_input_gives_empty_series(spark):
    from tablelens.operators import insight

    df = spark.createDataFrame([], "ts timestamp_ntz, v double")
    assert timeseries.weekly_series(df, "ts", "v").count() == 0
    assert timeseries.timeseries(df, "ts", "v", None, "sum", "M").count() == 0
    k = insight.kpis(df, "ts", "v")
    assert k["period_change"].count() == 0 and k["anomalies"].count() == 0
    assert insight.top_drivers(df.withColumn("category", df.v.cast("string")), "ts", "v").count() == 0
