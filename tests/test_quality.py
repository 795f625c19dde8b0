import datetime as dt

from tablelens.operators import quality


def test_gate_fails_on_heavy_missing(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "a int, b string")
    checks = quality.quality_checks(df)
    failed = [(r["check"], r["column"]) for r in checks.where("NOT passed").collect()]
    assert failed == [("missing", "b")]
    assert quality.quality_gate(checks).first()["passed"] is False


def test_gate_passes_clean_table(spark):
    df = spark.createDataFrame([(i, f"2025-01-{i:02d}") for i in range(1, 20)], "id int, ts string")
    checks = quality.quality_checks(df, id_col="id", ts_col="ts")
    assert quality.quality_gate(checks).first()["passed"] is True


def test_empty_table_fails(spark):
    df = spark.createDataFrame([], "a int")
    assert quality.quality_gate(quality.quality_checks(df)).first()["passed"] is False


def test_staleness(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1, 12),)], "ts timestamp_ntz")
    checks = quality.quality_checks(
        df, ts_col="ts", max_staleness_days=5, as_of=dt.datetime(2025, 1, 10, 0)
    )
    row = checks.where("check = 'staleness'").first()
    assert row["observed"] == 8.0 and row["passed"] is False


def test_pii_scan(spark):
    df = spark.createDataFrame(
        [("mail me at a.b@example.com", "x", 1.0), ("call +1 (555) 123-4567", "y", 2.0),
         ("card 4111 1111 1111 1111", "z", 3.0), ("nothing here", "w", 4.0)],
        "t string, u string, n double",
    )
    rows = [(r["column"], r["hits"], r["rows_scanned"]) for r in quality.pii_scan(df).collect()]
    assert rows == [("t", 3, 4)]
    big = spark.createDataFrame([(1234567890.0,)], "n double")
    assert quality.pii_scan(big, all_columns=True).first()["hits"] == 1


def test_mask(spark):
    df = spark.createDataFrame([("abcdefgh",), ("abcd",), ("ab",), (None,)], "s string")
    out = [r["s"] for r in quality.mask_column(df, "s", 4).collect()]
    assert out == ["****efgh", "abcd", "ab", None]
    assert quality.mask_column(df, "missing").columns == ["s"]


def test_card_match_implies_phone_match(spark):
    from pyspark.sql import functions as F

    from tablelens.functions.expressions import card_hit, pii_hit

    texts = ["4111 1111 1111 1111", "4111-1111-1111-1111", "x 5500000000000004 y", "card: 3782 822463 10005",
             "1234567890123", "12 34 56 78 90 12 34", "no digits", "+1 (555) 123-4567", "2025-01-01"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select(card_hit(F.col("s")).alias("c"), pii_hit(F.col("s")).alias("p")).collect()
    assert all(r["p"] for r in rows if r["c"])
    assert sum(r["c"] for r in rows) >= 5
