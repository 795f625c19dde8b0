"""Column-level operators: name normalisation and de-duplication, date and
number coercion, masking. All are narrow projections (no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.constants import DATE_NAME_HINTS
from tablelens.functions.expressions import to_number, to_timestamp
from tablelens.functions.names import dedupe_names, normalize_name, quote


# -------------------------------------------------------------------- P1 --

def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename every column with `normalize_name`; clashes get `_1`, `_2` …"""
    names = dedupe_names([normalize_name(c) or "column" for c in df.columns])
    return df.toDF(*names)


# -------------------------------------------------------------------- P2 --

def dedupe_columns(df: DataFrame) -> DataFrame:
    """Second column named `c` becomes `c_1`, the third `c_2` (positional)."""
    names = dedupe_names(list(df.columns))
    return df if names == list(df.columns) else df.toDF(*names)


# ---------------------------------------------------------------- P3 / P4 --

def date_hint_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(h in c for h in DATE_NAME_HINTS)]


def parse_dates(
    df: DataFrame, columns: list[str] | None = None, numeric_as_epoch: bool = False
) -> DataFrame:
    """Parse the given columns (default: names holding a date hint) to
    timestamp; text that is not a date becomes null. Numbers are left alone
    unless `numeric_as_epoch`."""
    targets = set(columns if columns is not None else date_hint_columns(df))
    fields = {f.name: f.dataType for f in df.schema.fields}
    from pyspark.sql import types as T

    out = []
    for c in df.columns:
        dt = fields[c]
        if c in targets and (numeric_as_epoch or not isinstance(dt, T.NumericType)):
            out.append(to_timestamp(F.col(quote(c)), dt, numeric_as_epoch).alias(c))
        else:
            out.append(F.col(quote(c)))
    return df.select(*out)


def parse_report(df: DataFrame, column: str) -> DataFrame:
    """(column, from_type, to_type, missing_after) for parsing one column."""
    dt = df.schema[column].dataType
    parsed = to_timestamp(F.col(quote(column)), dt)
    return df.agg(F.count_if(parsed.isNull()).alias("missing_after")).select(
        F.lit(column).alias("column"),
        F.lit(dt.simpleString()).alias("from_type"),
        F.lit("timestamp_ntz").alias("to_type"),
        "missing_after",
    )


# -------------------------------------------------------------------- P5 --

def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn the given columns into double; anything not a plain number -> null."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[to_number(F.col(quote(c)), fields[c]).alias(c) if c in columns else F.col(quote(c)) for c in df.columns]
    )
