from tablelens.functions.names import normalize_name, safe_table_name
from tablelens.operators import columns, roles


def _sample(spark):
    rows = [
        (i, f"CUST{10000 + i * 7}", f"2024-0{1 + i % 9}-1{i % 9}", ["A", "B", "C"][i % 3],
         ["card", "cash"][i % 2], "X", "S", 1 + i % 5, 10.0 + i, None if i % 10 == 0 else 3.0, None, "ok")
        for i in range(60)
    ]
    schema = ("order_id bigint, customer_id string, event_ts string, category string, payment_type string, "
              "city string, state string, quantity bigint, amount double, review_score double, "
              "optional_code string, notes string")
    return spark.createDataFrame(rows, schema)


def test_suggested_top_roles(spark):
    top = {r["role"]: r["column"] for r in roles.suggest_roles(_sample(spark), top_k=1).collect()}
    assert top["entity_id"] == "customer_id"
    assert top["event_ts"] == "event_ts"
    assert top["value"] == "amount"
    assert top["quantity"] == "quantity"
    assert top["category"] == "payment_type"


def test_auto_map_second_category_becomes_payment_method(spark):
    mapped, mapping = roles.auto_map(_sample(spark))
    assert "payment_method" in mapped.columns and mapping["category"] == "category"
    assert dict(mapped.dtypes)["event_ts"] == "timestamp_ntz"
    assert dict(mapped.dtypes)["value"] == "double"


def test_apply_roles_dedupes_before_casting(spark):
    df = spark.createDataFrame([("2025-01-01", "2025-02-01")], "event_ts string, created string")
    out = roles.apply_roles(df, {"event_ts": "created"})
    assert out.columns == ["event_ts", "event_ts_1"]


def test_guess_roles_names_only():
    g = roles.guess_roles(["Customer_ID", "order_date", "total_amount"])
    assert g == {"id": "Customer_ID", "ts": "order_date", "value": "total_amount"}


def test_names():
    assert normalize_name("  Order ID (EUR) ") == "order_id_eur"
    assert safe_table_name("Clean.My Table!") == "clean.my_table"
    assert safe_table_name("***") == "uploaded"


def test_bad_text_numbers(spark):
    df = spark.createDataFrame([(s,) for s in [" 2 ", "x", "1e3", "inf", "1d", "NA", "", "2025"]], "s string")
    out = [r["s"] for r in columns.coerce_numeric(df, ["s"]).collect()]
    assert out == [2.0, None, 1000.0, float("inf"), None, None, None, 2025.0]


def test_bad_dates(spark):
    df = spark.createDataFrame([("2025-01-02",), ("01/03/2025",), ("garbage",), (None,), ("2025",)], "s string")
    out = [r["s"] for r in columns.parse_dates(df, ["s"]).collect()]
    assert [d.day if d else None for d in out] == [2, 3, None, None, None]


def test_infer_id_like_and_monotonic(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 7)) for i in range(100)], "seq bigint, k bigint, v double")
    info = {r["column"]: r for r in roles.infer_columns(df).collect()}
    assert info["seq"]["is_id_like"] and not info["k"]["is_id_like"]
    assert set(roles.monotonic_columns(df, ["seq", "k"], order_by="seq")) == {"seq"}


def test_dedupe_columns_and_nan_to_null(spark):
    import math

    from tablelens.functions.expressions import nan_to_null

    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("c", "c", "c")
    assert columns.dedupe_columns(df).columns == ["c", "c_1", "c_2"]
    nan = spark.createDataFrame([(float("nan"), 1.0)], "x double, y double")
    row = nan_to_null(nan).first()
    assert row["x"] is None and row["y"] == 1.0 and not math.isnan(row["y"])


def test_roles_on_a_wide_table(spark):
    names = [f"metric_{i}" for i in range(22)] + ["customer_id", "order_date", "amount"]
    rows = [tuple([float(i + j) for j in range(22)] + [f"C{i}", f"2025-01-{1 + i % 28:02d}", float(i)]) for i in range(40)]
    schema = ", ".join(f"{n} double" for n in names[:22]) + ", customer_id string, order_date string, amount double"
    df = spark.createDataFrame(rows, schema)
    top = {r["role"]: r["column"] for r in roles.suggest_roles(df, top_k=1).collect()}
    assert top["entity_id"] == "customer_id" and top["event_ts"] == "order_date" and top["value"] == "amount"


def test_monotonic_by_an_explicit_order_whatever_the_layout(spark):
    rows = [(i, i // 2, 99 - i, 7, None if i == 50 else i) for i in range(100)]
    df = spark.createDataFrame(rows, "k bigint, up bigint, down bigint, same bigint, gap bigint")
    cols = ["k", "up", "down", "same", "gap"]
    for layout in (df.coalesce(1), df.repartition(7), df.orderBy("down").repartition(3, "up")):
        assert roles.monotonic_columns(layout, cols, order_by="k") == {"k", "up", "same"}
        assert roles.monotonic_columns(layout, cols, order_by=["same", "down"]) == {"down", "same"}
        assert roles.monotonic_columns(layout, cols) == {"same"}
    assert roles.monotonic_columns(df.limit(0), cols, order_by="k") == set()
    assert roles.monotonic_columns(df.limit(0), cols) == set()
    # equal order values: unordered among themselves
    ties = spark.createDataFrame([(1, 2), (1, 1), (2, 2), (None, 0)], "o bigint, `x.y` bigint")
    assert roles.monotonic_columns(ties, ["x.y"], order_by="o") == {"x.y"}


def test_order_test_with_and_without_grouping(spark):
    rows = [(i * 37 % 1000, i * 37 % 1000 // 3, -(i * 37 % 1000), None if i == 5 else i * 37 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, up int, down int, gap int").repartition(5)
    for unique in (True, False):
        assert roles.monotonic_columns(df, ["k", "up", "down", "gap"], "k", unique=unique) == {"k", "up"}
