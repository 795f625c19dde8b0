"""Quality gate, before/after quality comparison, personal-data scan."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.constants import (
    GATE_MAX_DUP_EXACT,
    GATE_MAX_DUP_PAIR,
    GATE_MAX_MISSING,
)
from tablelens.functions.expressions import as_text, is_missing, pii_hit, to_timestamp
from tablelens.functions.names import quote
from tablelens.operators.profile import duplicate_counts

def _missing_ratios(df: DataFrame, extra: list = ()) -> DataFrame:
    fields = df.schema.fields
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(is_missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)],
        *extra,
    )


# -------------------------------------------------------------------- A9 --

def quality_checks(
    df: DataFrame,
    *,
    id_col: str | None = None,
    ts_col: str | None = None,
    max_missing: float = GATE_MAX_MISSING,
    max_dup_exact: float = GATE_MAX_DUP_EXACT,
    max_dup_pair: float = GATE_MAX_DUP_PAIR,
    max_staleness_days: int | None = None,
    as_of: _dt.datetime | None = None,
) -> DataFrame:
    """(check, column, observed, threshold, passed).

    * dup_exact — share of rows repeating an earlier identical row (≤ limit);
      undefined on an empty table, which fails.
    * dup_pair — same on (id, parsed ts), only when both columns exist.
    * missing — one row per column: missing share must not exceed the limit.
    * staleness — whole days from the latest ts to `as_of` (default now),
      only when a limit is given.
    """
    fields = df.schema.fields
    pair = bool(id_col and ts_col and id_col in df.columns and ts_col in df.columns)
    dups = duplicate_counts(df, id_col if pair else None, ts_col if pair else None)
    dup_rows = dups.select(
        F.concat(F.lit("dup_"), F.col("check")).alias("check"),
        F.lit(None).cast("string").alias("column"),
        F.col("ratio").alias("observed"),
        F.when(F.col("check") == "exact", F.lit(max_dup_exact)).otherwise(F.lit(max_dup_pair)).alias("threshold"),
    ).withColumn("passed", F.coalesce(F.col("observed") <= F.col("threshold"), F.lit(False)))

    extra = []
    stale = bool(ts_col and ts_col in df.columns and max_staleness_days is not None)
    if stale:
        extra.append(F.max(to_timestamp(F.col(quote(ts_col)), df.schema[ts_col].dataType)).alias("latest"))
    stats = _missing_ratios(df, extra)
    miss_rows = stats.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("missing").alias("check"),
                        F.lit(f.name).alias("column"),
                        F.try_divide(F.col(f"m{i}").cast("double"), F.col("n")).alias("observed"),
                        F.lit(float(max_missing)).alias("threshold"),
                    )
                    for i, f in enumerate(fields)
                ]
            )
        )
    ).withColumn("passed", F.coalesce(~(F.col("observed") > F.col("threshold")), F.lit(True)))
    out = dup_rows.unionByName(miss_rows)
    if stale:
        now = F.lit(as_of or _dt.datetime.now()).cast("timestamp_ntz")
        days = F.floor(
            (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp")))
            / F.lit(86_400_000_000)
        )
        out = out.unionByName(
            stats.select(
                F.lit("staleness").alias("check"),
                F.lit(ts_col).alias("column"),
                days.cast("double").alias("observed"),
                F.lit(float(max_staleness_days)).alias("threshold"),
            ).withColumn("passed", F.coalesce(F.col("observed") <= F.col("threshold"), F.lit(True)))
        )
    return out.select("check", "column", "observed", "threshold", "passed")


def quality_gate(checks: DataFrame) -> DataFrame:
    """(passed, failed_checks): PASS iff every check passed."""
    return checks.agg(
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
    )


# ------------------------------------------------------------------- A10 --

def quality_diff(
    raw: DataFrame, cleaned: DataFrame, id_col: str | None = None, ts_col: str | None = None
) -> DataFrame:
    """(stage, metric, column, value, detail) for `raw` and `cleaned`:
    rows, missing ratio per column (4 dp, dtype in detail), exact and pair
    duplicate ratios."""
    parts = []
    for stage, df in (("raw", raw), ("cleaned", cleaned)):
        fields = df.schema.fields
        stats = _missing_ratios(df)
        rows = stats.select(
            F.inline(
                F.array(
                    F.struct(
                        F.lit("rows").alias("metric"),
                        F.lit(None).cast("string").alias("column"),
                        F.col("n").cast("double").alias("value"),
                        F.lit(None).cast("string").alias("detail"),
                    ),
                    *[
                        F.struct(
                            F.lit("missing_ratio").alias("metric"),
                            F.lit(f.name).alias("column"),
                            F.bround(F.try_divide(F.col(f"m{i}").cast("double"), F.col("n")), 4).alias("value"),
                            F.lit(f.dataType.simpleString()).alias("detail"),
                        )
                        for i, f in enumerate(fields)
                    ],
                )
            )
        )
        pair = bool(id_col and ts_col and id_col in df.columns and ts_col in df.columns)
        dups = duplicate_counts(df, id_col if pair else None, ts_col if pair else None).select(
            F.concat(F.lit("dup_"), F.col("check"), F.lit("_ratio")).alias("metric"),
            F.lit(None).cast("string").alias("column"),
            F.col("ratio").alias("value"),
            F.lit(None).cast("string").alias("detail"),
        )
        parts.append(rows.unionByName(dups).select(F.lit(stage).alias("stage"), "*"))
    return parts[0].unionByName(parts[1])


# ------------------------------------------------------------------- A11 --

def pii_scan(
    df: DataFrame,
    sample_rows: int | None = None,
    all_columns: bool = True,
) -> DataFrame:
    """(column, hits, rows_scanned): rows whose text holds an email, phone or
    card pattern, for columns with at least one hit.

    Scans every row by default (`sample_rows` caps it) and every plain column as text
    (doubles in digits); `all_columns=False` scans string columns only.
    One aggregate evaluates all patterns of all columns in a single pass.
    """
    from pyspark.sql import types as T

    src = df.limit(sample_rows) if sample_rows else df
    fields = [
        f for f in src.schema.fields
        if isinstance(f.dataType, T.StringType)
        or (all_columns and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)))
    ]
    spark = df.sparkSession
    if not fields:
        return spark.createDataFrame([], "column string, hits bigint, rows_scanned bigint")
    stats = src.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.count_if(F.coalesce(pii_hit(as_text(F.col(quote(f.name)), f.dataType)), F.lit(False))).alias(f"h{i}")
            for i, f in enumerate(fields)
        ],
    )
    return (
        stats.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(f.name).alias("column"),
                            F.lit(i).alias("pos"),
                            F.col(f"h{i}").alias("hits"),
                            F.col("n").alias("rows_scanned"),
                        )
                        for i, f in enumerate(fields)
                    ]
                )
            )
        )
        .where(F.col("hits") > 0)
        .orderBy("pos")
        .drop("pos")
    )


def mask_column(df: DataFrame, column: str, keep_last: int = 4) -> DataFrame:
    """Replace all but the last `keep_last` characters of `column` by `*`
    (text shorter than that unchanged, null kept); absent column: no-op."""
    from tablelens.functions.expressions import mask

    if column not in df.columns:
        return df
    return df.withColumn(column, mask(F.col(quote(column)).cast("string"), keep_last))
