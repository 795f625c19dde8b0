"""A key holding a third of the rows: results stay exact and the plans
aggregate partially before the shuffle (no hot group lands whole in one task)."""

import datetime as dt

from tablelens.operators import cleaning, insight, profile


def _skewed(spark, n=3000):
    t0 = dt.datetime(2025, 3, 1)
    rows = []
    for i in range(n):
        if i % 3 == 0:  # one hot (id, ts) key
            rows.append((-1, t0, "hot", float(i)))
        else:
            rows.append((i, t0 + dt.timedelta(hours=i), f"m{i % 11}", float(i)))
    return spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, category string, value double")


def _executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_first_on_hot_key(spark):
    df = _skewed(spark)
    out = cleaning.drop_duplicates(df, ["id", "ts"])
    assert out.count() == 2001
    hot = out.where("id = -1").collect()
    assert len(hot) == 1 and hot[0]["value"] == 0.0  # smallest by (category, value)
    assert "partial_min" in _executed(out)


def test_pair_duplicate_count_on_hot_key(spark):
    rows = {r["check"]: r for r in profile.duplicate_counts(_skewed(spark), "id", "ts").collect()}
    assert rows["pair"]["duplicates"] == 999
    assert rows["exact"]["duplicates"] == 0


def test_drivers_with_hot_member(spark):
    df = _skewed(spark)
    out = insight.top_drivers(df, "ts", "value", dimensions=["category"], top=3, days=1000)
    top = out.orderBy("value", ascending=False).first()
    assert top["member"] == "hot"
    assert top["value"] == sum(float(i) for i in range(0, 3000, 3))
