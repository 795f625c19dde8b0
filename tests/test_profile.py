import math
import random

import pytest

from tablelens.operators import profile
from tablelens.operators.stats import exact_quantiles, modes


def test_nan_and_null_both_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,)], "x double")
    row = profile.missingness(df).first()
    assert (row["column"], row["missing"], row["missing_pct"]) == ("x", 2, 50.0)


def test_identical_rows_with_nulls_are_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "b"), (None, None), (None, None)], "a int, b string")
    row = profile.duplicate_counts(df).first()
    assert (row["rows"], row["duplicates"]) == (5, 2)
    assert row["ratio"] == pytest.approx(0.4)


def test_pair_duplicates_parse_ts(spark):
    df = spark.createDataFrame(
        [(1, "2025-01-01"), (1, "2025-01-01 00:00:00"), (1, "junk"), (1, "other junk")],
        "id int, ts string",
    )
    rows = {r["check"]: r for r in profile.duplicate_counts(df, "id", "ts").collect()}
    assert rows["exact"]["duplicates"] == 0
    assert rows["pair"]["duplicates"] == 2  # same instant twice; both bad ts equal


def test_empty_ratios_are_null(spark):
    df = spark.createDataFrame([], "a int")
    assert profile.duplicate_counts(df).first()["ratio"] is None
    assert profile.missingness(df).first()["missing_pct"] is None


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_quantiles_match_linear_interpolation(spark, n):
    import numpy as np

    rnd = random.Random(n)
    vals = [rnd.choice([rnd.gauss(0, 10), 3.0, 1e6]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    probs = [0.0, 0.01, 0.5, 0.99, 1.0]
    # tiny candidate limit and bucket count force several narrowing rounds
    got = exact_quantiles(df, {"x": probs}, max_candidates=5, buckets=4)["x"]
    want = [float(np.quantile(np.array(vals), p)) for p in probs]
    for g, w in zip(got, want):
        assert math.isclose(g, w, rel_tol=1e-12, abs_tol=1e-9)


def test_mode_ties_smallest_and_all_null(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None)], "s string, t string")
    assert modes(df, ["s", "t"]) == {"s": "a", "t": None}


def test_outliers_population_std(spark):
    vals = [0.0] * 99 + [1000.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    row = profile.numeric_outliers(df).first()
    assert row["outlier_count"] == 1 and row["max"] == 1000.0


def test_constant_column_has_no_outliers(spark):
    df = spark.createDataFrame([(5,)] * 10, "x int")
    assert profile.numeric_outliers(df).first()["outlier_count"] == 0


def test_histogram_max_in_last_bin_and_empty_bins_kept(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.0,)], "x double")
    rows = profile.histogram(df, "x", 5).collect()
    assert [r["n"] for r in rows] == [1, 0, 0, 0, 2]
    assert rows[-1]["hi"] == 10.0


def test_top_categories_counts_null_member(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("b",), ("a",), ("a",)], "c string")
    rows = [(r["member"], r["n"]) for r in profile.top_categories(df, "c", 2).collect()]
    assert rows == [("a", 3), (None, 2)]


def test_totals(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    row = profile.totals(df, "v").first()
    assert (row["rows"], row["total_value"], row["avg_value"]) == (3, 4.0, 2.0)
    empty = profile.totals(spark.createDataFrame([], "v double"), "v").first()
    assert empty["total_value"] == 0.0 and empty["avg_value"] is None


def test_column_profile_samples(spark):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "a"), (1, "b")], "x int, s string")
    rows = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert rows["x"]["unique"] == 3 and rows["x"]["sample_values"] == ["1", "2", "3"]
    assert rows["s"]["missing"] == 1 and rows["s"]["sample_values"] == ["a", "b", "c"]


def test_exact_quantiles_with_infinities(spark):
    vals = [float("-inf"), 1.0, 2.0, 3.0, 4.0, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, {"x": [0.25, 0.5, 0.75]}, max_candidates=2, buckets=4)["x"]
    assert got == [1.5, 3.0, float("inf")]


def test_exact_row_counts_of_wide_rows(spark):
    rows = [(i % 7, None if i % 5 == 0 else f"t{i % 3}", [f"{i % 2}:", None], bytes([i % 2]), (i % 2, None)) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string, c array<string>, d binary, e struct<x:int,y:string>")
    got = profile.exact_row_counts(df).first()
    assert (got["rows"], got["distinct_rows"]) == (400, df.distinct().count())
    # cells whose texts run together must stay apart
    near = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("", None), (None, ""), ("n", "1:a"), ("n1:a", "")], "x string, y string")
    assert profile.exact_row_counts(near).first()["distinct_rows"] == 6
    lists = spark.createDataFrame([(["a", "b"], "x"), (["a, b"], "x"), (["a", None], "x"), (["a"], "x"), ([], "x"), (None, "x")], "l array<string>, s string")
    assert profile.exact_row_counts(lists).first()["distinct_rows"] == 6
    plan = profile.exact_row_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") + plan.count("Scan ExistingRDD") <= 1 and "Join" not in plan


def test_negative_zero_and_nan_rows_are_duplicates(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (1.0,)], "x double")
    row = profile.exact_row_counts(df).first()
    assert (row["rows"], row["distinct_rows"]) == (5, 3)


def test_exact_row_counts_narrow_and_wide_agree(spark):
    rows = [(i % 4, float(i % 3), f"s{i % 2}") for i in range(50)]
    wide = spark.createDataFrame(rows, "a int, b double, c string")
    narrow = wide.drop("c")
    assert profile._narrow_rows(narrow) and not profile._narrow_rows(wide)
    assert tuple(profile.exact_row_counts(narrow).first()) == (50, 12)
    assert tuple(profile.exact_row_counts(wide).first()) == (50, 12)


def test_exact_quantiles_on_values_over_many_magnitudes(spark):
    import numpy as np

    vals = [float(2.0 ** (k % 600 - 300)) * (1 + (k % 7)) for k in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.1, 0.5, 0.9]
    got = exact_quantiles(df, {"x": probs}, max_candidates=50, buckets=8)["x"]
    want = [float(np.quantile(np.array(vals), p)) for p in probs]
    assert all(math.isclose(g, w, rel_tol=1e-12) for g, w in zip(got, want))


def test_approximate_paths(spark):
    from tablelens.operators.stats import quantiles

    df = spark.createDataFrame([(i % 50, float(i)) for i in range(1000)], "k int, x double")
    rows = {r["column"]: r for r in profile.column_profile(df, exact=False).collect()}
    assert abs(rows["k"]["unique"] - 50) <= 5 and abs(rows["x"]["unique"] - 1000) <= 150
    assert rows["k"]["sample_values"] == []
    q = quantiles(df, {"x": [0.5]}, accuracy=10_000)["x"][0]
    assert abs(q - 499.5) <= 1.0


def test_wide_tables_are_exact_by_default(spark):
    wide = spark.createDataFrame([tuple(range(25))], ", ".join(f"c{i} int" for i in range(25)))
    rows = profile.column_profile(wide).collect()
    assert len(rows) == 25 and all(r["unique"] == 1 for r in rows)
    assert all(r["sample_values"] == [str(i)] for i, r in enumerate(sorted(rows, key=lambda r: int(r["column"][1:]))))
    approximate = profile.column_profile(wide, exact=False).collect()
    assert all(r["sample_values"] == [] for r in approximate)  # HyperLogLog++ mode gives no samples


def test_quantiles_over_range_partitions_and_both_scales(spark):
    import random

    rnd = random.Random(1)
    vals = [rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-300, 300) for _ in range(2000)] + [0.0] * 300 + [5e-324, -1e308, 1e308, 1.7e308]
    df = spark.createDataFrame([(v, float(i % 3)) for i, v in enumerate(vals)], "x double, y double")
    probs = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    s = sorted(vals)
    want = []
    for p in probs:
        at = (len(s) - 1) * p
        a, b = s[math.floor(at)], s[math.ceil(at)]
        want.append(a if a == b else a + (b - a) * (at - math.floor(at)))
    for limit in (0, 50, 10**6):  # range partitions always, sometimes, never
        got = exact_quantiles(df, {"x": probs, "y": [0.5]}, max_candidates=limit, buckets=16)
        assert got["y"] == [1.0]
        assert all(g == w or math.isclose(g, w, rel_tol=1e-12) for g, w in zip(got["x"], want)), limit


def test_histogram_beyond_the_largest_double(spark):
    df = spark.createDataFrame([(-1.7e308,), (0.0,), (1.0,), (1.7e308,)], "x double")
    rows = profile.histogram(df, "x", 4).collect()
    assert [r["n"] for r in rows] == [1, 0, 2, 1] and all(math.isfinite(r["lo"]) and math.isfinite(r["hi"]) for r in rows)


def test_counts_of_very_wide_tables(spark):
    from tablelens.operators.stats import per_column_counts

    row = [i if i % 3 else f"s{i}" for i in range(70)]
    schema = ", ".join(f"c{i} {'int' if i % 3 else 'string'}" for i in range(70))
    df = spark.createDataFrame([tuple(row), tuple([None] * 70), tuple(row)], schema)
    got = {r["g"]: r for r in per_column_counts(df, df.columns).collect()}
    assert len(got) == 70 and all(got[i][f"v{i}"] == row[i] and got[i]["n"] == 2 for i in range(70))
