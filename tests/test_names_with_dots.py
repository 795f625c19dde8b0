"""Column names with dots, blanks and backticks in every operator that takes columns."""

import pytest

from tablelens.operators import cleaning, columns, insight, profile, quality, roles, timeseries
from tablelens.plans import flows
from tablelens.plans.fixtures import dirty_events

NAMES = {"user_id": "user.id", "ts": "event.ts (utc)", "event_type": "event`type", "value": "value, net"}


@pytest.fixture(scope="module")
def both(spark):
    plain = dirty_events(spark, "/root/testdata/sf0.001")
    plain = spark.createDataFrame(plain.collect(), plain.schema)
    return plain, plain.toDF(*[NAMES[c] for c in plain.columns])


def rows(df):
    names = {new: old for old, new in NAMES.items()}
    return sorted(tuple(names.get(str(x), str(x).replace("user.id", "user_id").replace("event.ts (utc)", "ts")) for x in r) for r in df.collect())


@pytest.mark.parametrize(
    "run",
    [
        lambda d, n: profile.missingness(d),
        lambda d, n: profile.column_profile(d),
        lambda d, n: profile.column_profile(d, exact=False),
        lambda d, n: profile.duplicate_counts(d, n["user_id"], n["ts"]),
        lambda d, n: profile.numeric_outliers(d),
        lambda d, n: profile.top_categories(d, n["event_type"], 5),
        lambda d, n: profile.histogram(d, n["value"], 7),
        lambda d, n: profile.totals(d, n["value"]),
        lambda d, n: quality.quality_checks(d, id_col=n["user_id"], ts_col=n["ts"]),
        lambda d, n: quality.pii_scan(d),
        lambda d, n: quality.mask_column(d, n["event_type"], 2),
        lambda d, n: cleaning.clean(d, id_col=n["user_id"], ts_col=n["ts"])[0],
        lambda d, n: cleaning.clean_fallback(d, id_col=n["user_id"], ts_col=n["ts"]),
        lambda d, n: columns.parse_report(d, n["ts"]),
        lambda d, n: columns.coerce_numeric(d, [n["value"]]),
        lambda d, n: roles.apply_roles(d, {"event_ts": n["ts"], "value": n["value"]}),
        lambda d, n: roles.infer_columns(d, order_by=n["ts"]).select("is_numeric", "is_categorical"),
        lambda d, n: timeseries.weekly_series(d, n["ts"], n["value"]),
        lambda d, n: timeseries.timeseries(d, n["ts"], n["value"], None, "avg", "D"),
        lambda d, n: insight.top_drivers(d.withColumnRenamed(n["event_type"], "category"), n["ts"], n["value"]),
        lambda d, n: flows.validate(d, n["user_id"], n["ts"], n["value"])["actions"],
    ],
)
def test_same_result_under_any_name(both, run):
    plain, renamed = both
    assert rows(run(renamed, NAMES)) == rows(run(plain, {c: c for c in NAMES}))
