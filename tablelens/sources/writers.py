"""Sinks: catalog tables, CSV, Parquet, drivers CSV, schema report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.names import quote, safe_table_name


def save_table(
    df: DataFrame, table: str, database: str | None = "staging", mode: str = "overwrite", location: str | None = None
) -> tuple[str, int]:
    """Write `df` as a catalog table, creating the database when missing.
    A dotted `table` overrides `database`. Modes: overwrite, append, error,
    ignore. With `location` the table's files lie in that folder (an external
    table), else in the warehouse. Returns (qualified name, rows in the table)."""
    spark = df.sparkSession
    name = table.strip()
    if "." in name:
        database, name = name.split(".", 1)
    name = safe_table_name(name)
    if database:
        database = safe_table_name(database)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote(database)}")
        qualified = f"{database}.{name}"
        target = f"{quote(database)}.{quote(name)}"
    else:
        qualified = name
        target = quote(name)
    writer = df.write.mode(mode)
    (writer.option("path", location) if location else writer).saveAsTable(target)
    rows = spark.table(target).count()
    return qualified, rows


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header row, quotes doubled (in parallel, one file per partition)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def write_drivers(drivers: DataFrame, path: str) -> str:
    """Drivers as CSV; an empty result still gets its header (one partition)."""
    drivers.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def schema_report(
    cleaned: DataFrame, mapping: dict[str, str | None], examples: int = 5
) -> DataFrame:
    """(column, dtype, role, examples): type after cleaning, the role a column
    plays, and up to `examples` distinct example values as text (the smallest
    ones, from one (column, value) shuffle)."""
    from tablelens.operators.profile import column_profile

    prof = column_profile(cleaned, samples=examples).select("column", "dtype", "sample_values")
    roles = cleaned.sparkSession.createDataFrame(
        [(col, role) for role, col in mapping.items() if col], "column string, role string"
    )
    return prof.join(F.broadcast(roles), "column", "left").select(
        "column", "dtype", "role", F.col("sample_values").alias("examples")
    )


def write_json(df: DataFrame, path: str, one_file: bool = False) -> str:
    """JSON lines, one file per partition; `one_file` only for small frames (one task)."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)
    return path
