"""Sources: CSV with pandas-like typing, catalog tables, dispatch, preview,
CSV ingest into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tablelens.functions.constants import NA_STRINGS
from tablelens.functions.names import quote, safe_table_name

_INT_TEXT = r"^\s*[+-]?\d{1,38}\s*$"
_FLOAT_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"
_BOOL_TEXT = r"^(True|False|TRUE|FALSE|true|false)$"


def open_quotes(spark: SparkSession, path: str) -> int:
    """Lines of text files with an odd number of quote characters: where a quoted field
    runs over a line break its first line has one (and so may stray quotes)."""
    odd = F.octet_length(F.regexp_replace("value", '[^"]++', "")) % 2 == 1
    return _found(path, lambda: spark.read.text(path).agg(F.count_if(F.col("value").contains('"') & odd)).first()[0])


def _found(path: str, read):
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(path) from e
        raise


def read_csv(
    spark: SparkSession,
    path: str,
    na_values: list[str] | None = None,
    sep: str = ",",
    multi_line: bool | None = None,
    malformed: str = "raise",
) -> DataFrame:
    """Header row, `sep`-separated, quotes doubled inside quoted fields.

    Files are split at line breaks and read by many tasks, unless a quoted field holds a
    line break; then a file must be read by one task (many files still in parallel). By
    default a scan for open quotes decides; `multi_line=True` skips it, and with
    `multi_line=False` an open quote raises, as splitting there would cut a field.
    `malformed`: `raise` on a line of the wrong number of fields, or `keep` it in a column
    `_corrupt_record` (null for good lines; missing fields are null).

    Text in the NA set becomes null; then each
    column becomes bigint / double / boolean when every remaining value
    reads as one, else stays string. Dates stay text (see `parse_dates`).

    Typing costs one aggregate over the string columns (three pattern counts
    per column); the typed frame is a narrow projection on top of the scan.
    """
    if malformed not in ("raise", "keep"):
        raise ValueError("malformed: raise or keep")
    if not multi_line:
        n = open_quotes(spark, path)
        if n and multi_line is False:
            raise ValueError(f"{n} lines of {path} have an open quote; read it with multi_line=True")
        multi_line = n > 0
    reader = (
        spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
        .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    )
    raw = _found(path, lambda: reader.option("mode", "FAILFAST").csv(path))
    kept: list[str] = []
    if malformed == "keep":
        kept = ["_corrupt_record"]
        schema = raw.schema.add("_corrupt_record", "string")
        raw = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)
    na = list(NA_STRINGS if na_values is None else na_values)
    cleaned = raw.select(
        *[F.when(F.col(quote(c)).isin(na), F.lit(None)).otherwise(F.col(quote(c))).alias(c) for c in raw.columns if c not in kept],
        *kept,
    )
    counts = cleaned.agg(
        *[
            agg
            for i, c in enumerate(cleaned.columns)
            if c not in kept
            for agg in (
                F.count(F.col(quote(c))).alias(f"n{i}"),
                F.count_if(F.col(quote(c)).rlike(_INT_TEXT)).alias(f"i{i}"),
                F.count(F.trim(quote(c)).try_cast("bigint")).alias(f"l{i}"),
                F.count_if(F.col(quote(c)).rlike(_FLOAT_TEXT)).alias(f"f{i}"),
                F.count_if(F.col(quote(c)).rlike(_BOOL_TEXT)).alias(f"b{i}"),
            )
        ]
    ).first()
    cols = []
    for i, c in enumerate(cleaned.columns):
        x = F.col(quote(c))
        if c in kept:
            cols.append(x)
            continue
        n = counts[f"n{i}"]
        if n and counts[f"i{i}"] == n:
            # integers beyond 64 bits stay exact as decimals
            cols.append(F.trim(x).cast("bigint" if counts[f"l{i}"] == n else "decimal(38,0)").alias(c))
        elif n and counts[f"f{i}"] == n:
            cols.append(F.trim(x).try_cast("double").alias(c))
        elif n and counts[f"b{i}"] == n:
            cols.append(F.lower(x).cast("boolean").alias(c))
        elif not n:
            cols.append(x.cast("double").alias(c))  # an all-missing column reads as float NaN
        else:
            cols.append(x.alias(c))
    return cleaned.select(*cols)


def read_table(spark: SparkSession, name: str, limit: int | None = None) -> DataFrame:
    """Catalog table; `limit` is optional (no cap by default)."""
    df = spark.table(name)
    return df.limit(limit) if limit else df


def load(
    spark: SparkSession,
    path: str | None = None,
    table: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """A table wins over a file; files by suffix (csv, parquet, json, orc —
    a directory without suffix is read as parquet); neither -> ValueError."""
    if table:
        return read_table(spark, table, limit)
    if not path:
        raise ValueError("provide a file path or a table name")
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        df = read_csv(spark, path)
    else:
        fmt = "json" if low.endswith(".json") else "orc" if low.endswith(".orc") else "parquet"
        df = _found(path, lambda: spark.read.format(fmt).load(path))
    return df.limit(limit) if limit else df


def preview(df: DataFrame, n: int = 5) -> dict:
    """{'head': first n rows (DataFrame), 'rows': row count, 'columns': names}."""
    return {"head": df.limit(n), "rows": df.count(), "columns": list(df.columns)}


def ingest_csv(
    spark: SparkSession, path: str, table: str, mode: str = "overwrite", location: str | None = None
) -> tuple[str, int]:
    """CSV -> normalised column names -> date parsing by name hint -> table."""
    from tablelens.operators.columns import normalize_columns, parse_dates
    from tablelens.sources.writers import save_table

    df = parse_dates(normalize_columns(read_csv(spark, path)))
    name = safe_table_name(table)
    if "." in name:
        db, tbl = name.split(".", 1)
        return save_table(df, tbl, database=db, mode=mode, location=location)
    return save_table(df, name, database=None, mode=mode, location=location)
