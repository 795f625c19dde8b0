import os

import pytest

from tablelens.sources import readers, writers


def test_csv_typing_and_na(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,c,d\n1,1.5,True,NA\n2,,False,x\n3,2e3,true,\n")
    df = readers.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string"}
    assert [r["d"] for r in df.collect()] == [None, "x", None]


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.load(spark, path=str(tmp_path / "nope.csv"))
    with pytest.raises(ValueError):
        readers.load(spark)


def test_roundtrip_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    writers.write_csv(df, str(tmp_path / "csv"))
    writers.write_parquet(df, str(tmp_path / "pq"))
    assert readers.load(spark, path=str(tmp_path / "pq")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    empty = spark.createDataFrame([], "dimension string, member string, value double")
    writers.write_drivers(empty, str(tmp_path / "drv"))
    assert any(f.endswith(".csv") for f in os.listdir(tmp_path / "drv"))


def test_ingest_and_save_table(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text("Order Date,Amount\n2025-01-01,3\n")
    name, n = readers.ingest_csv(spark, str(p), "tl_test.Upload Table")
    assert (name, n) == ("tl_test.upload_table", 1)
    assert dict(spark.table("tl_test.upload_table").dtypes)["order_date"] == "timestamp_ntz"


def _csv(tmp_path, text, name="t.csv"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_csv_is_split_unless_a_field_holds_a_line_break(spark, tmp_path):
    plain = _csv(tmp_path, "a,b\n" + "".join(f'{i},"x ""{i}"", y"\n' for i in range(4000)))
    assert readers.open_quotes(spark, plain) == 0
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = readers.read_csv(spark, plain)
        assert df.rdd.getNumPartitions() > 2
        rows = df.orderBy("a").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in rows] == [(i, f'x "{i}", y') for i in range(4000)]


def test_csv_with_line_breaks_in_fields(spark, tmp_path):
    broken = _csv(tmp_path, 'a,b\n1,"two\nlines, ""q"""\n2,\n3,"x"\n')
    assert readers.open_quotes(spark, broken) == 2
    want = [(1, 'two\nlines, "q"'), (2, None), (3, "x")]
    assert [tuple(r) for r in readers.read_csv(spark, broken).orderBy("a").collect()] == want
    assert [tuple(r) for r in readers.read_csv(spark, broken, multi_line=True).orderBy("a").collect()] == want
    with pytest.raises(ValueError, match="2 lines"):
        readers.read_csv(spark, broken, multi_line=False)


def test_csv_with_malformed_lines(spark, tmp_path):
    path = _csv(tmp_path, "a,b\n1,2\n3\n4,5,6\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, path).collect()
    kept = readers.read_csv(spark, path, malformed="keep").orderBy("a").collect()
    assert [(r["a"], r["b"], r["_corrupt_record"]) for r in kept] == [(1, 2, None), (3, None, "3"), (4, 5, "4,5,6")]
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))


def test_table_at_a_location_is_replaced_and_read_by_name(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    name, rows = writers.save_table(df, "My Stage.T-1!", location=str(tmp_path / "t"))
    assert (name, rows) == ("my_stage.t_1", 2)
    name, rows = writers.save_table(df.where("id = 2"), "My Stage.T-1!", location=str(tmp_path / "t"))
    assert rows == 1 and [tuple(r) for r in readers.read_table(spark, name).collect()] == [(2, "b")]
    assert writers.save_table(df, "My Stage.T-1!", mode="append", location=str(tmp_path / "t"))[1] == 3


def test_preview_and_json(spark, tmp_path):
    df = spark.range(30).repartition(3)
    seen = readers.preview(df, 4)
    assert (seen["rows"], seen["columns"], seen["head"].count()) == (30, ["id"], 4)
    assert readers.load(spark, path=writers.write_json(df, str(tmp_path / "a.json"))).count() == 30
