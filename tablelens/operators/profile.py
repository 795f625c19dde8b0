"""Profiling operators: missingness, column profile, duplicates, outliers,
totals, top categories, histogram.

Every operator scans its input once per statistic *family* (one fused
aggregate over all columns), unpivots the single result row, and returns a
small typed DataFrame. Scalars needed as inputs of a second pass (means,
standard deviations, quantiles) are brought to the driver and used as
literals — no cross join, no broadcast of data-sized state.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.constants import HEAVY_MISSING_PCT, OUTLIER_Z
from tablelens.functions.expressions import (
    is_floating,
    is_missing,
    numeric_columns,
    row_digest,
    to_number,
    to_timestamp,
)
from tablelens.functions.names import quote
from tablelens.operators.stats import per_column_counts, quantiles, stats_columns


def _rows(df: DataFrame, specs: list[Column]) -> DataFrame:
    """One row per struct in `specs` (an `inline` over a literal-sized array)."""
    return df.select(F.inline(F.array(*specs)))


def _pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.bround(F.try_divide(part.cast("double"), whole) * 100.0, digits)


# ---------------------------------------------------------------- A1 / A2 --

def missingness(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct) for every column, most missing first."""
    return _missingness(df).orderBy(F.desc("missing_pct"), "pos").drop("pos")


def _missingness(df: DataFrame) -> DataFrame:
    fields = df.schema.fields
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(is_missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)],
    )
    out = _rows(
        stats,
        [
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(i).alias("pos"),
                F.col(f"m{i}").alias("missing"),
                F.col("n").alias("n"),
            )
            for i, f in enumerate(fields)
        ],
    )
    return out.select(
        "column",
        "missing",
        _pct(F.col("missing"), F.col("n")).alias("missing_pct"),
        "pos",
    )


def missingness_series(df: DataFrame, top: int = 50) -> DataFrame:
    """Chart data: (column, missing_pct) of columns with any missing value,
    most missing first, at most `top`; if none has any, the first `top`."""
    m = _missingness(df)
    any_missing = F.max(F.col("missing") > 0).over(_whole())
    return (
        m.withColumn("keep", any_missing)
        .where(~F.col("keep") | (F.col("missing") > 0))
        .orderBy(F.desc("missing_pct"), "pos")
        .limit(top)
        .select("column", "missing_pct")
    )


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


# ---------------------------------------------------------------- A3 / A4 --

def table_summary(df: DataFrame) -> DataFrame:
    """(rows, cols)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("cols")
    )


# HyperLogLog++ relative error for the approximate path. Each sketch is a
# fixed buffer of about 50 longs at 5 % (Spark's default); at 1 % it is ~1600,
# which in a many-column aggregate makes an unwieldy aggregation buffer.
APPROX_DISTINCT_RSD = 0.05


def column_profile(df: DataFrame, samples: int = 3, exact: bool = True) -> DataFrame:
    """(column, dtype, unique, missing, missing_pct, sample_values).

    Exact mode (default) is one shuffle of (column, value) pairs — nulls
    included — with map-side partial counting; distinct values, missing
    counts and the `samples` smallest values (as text) are all read from
    that one aggregate, and the per-column top-k is limited inside each
    partition before its exchange. `exact=False` uses one HyperLogLog++ pass
    (fixed memory per column) and gives no samples.
    """
    from pyspark.sql import Window

    fields = df.schema.fields
    cols = [f.name for f in fields]
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(f.name, i, f.dataType.simpleString()) for i, f in enumerate(fields)],
        "column string, pos int, dtype string",
    )
    if exact:
        counts = per_column_counts(df, cols, include_nulls=True)
        vnames = [f"v{j}" for j in range(len(cols))]
        nullish = F.lit(False)
        for i, f in enumerate(fields):
            nullish = F.when(F.col("g") == i, is_missing(vnames[i], f.dataType)).otherwise(nullish)
        counts = counts.withColumn("nullish", nullish)
        per = counts.groupBy("g").agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("nullish"), F.col("n"))), F.lit(0)).alias("missing"),
            F.count_if(~F.col("nullish")).alias("unique"),
        )
        text = F.coalesce(*[F.col(v).cast("string") for v in vnames])
        # Missing values sort last and are dropped after ranking: a filter
        # before the window would be pushed under the shared aggregate, and a
        # branch that never reads `n` would get a pruned copy of it; either
        # way Spark could not reuse the aggregate's exchange for this branch.
        w = Window.partitionBy("g").orderBy("nullish", *[F.col(v).asc_nulls_last() for v in vnames])
        sample = (
            counts.withColumn("rn", F.row_number().over(w))
            .where((F.col("rn") <= samples) & ~F.col("nullish") & (F.col("n") > 0))
            .groupBy("g")
            .agg(F.sort_array(F.collect_list(F.struct("rn", text.alias("t")))).alias("s"))
            .select("g", F.transform("s", lambda x: x["t"]).alias("sample_values"))
        )
        per = per.join(sample, "g", "left").withColumnRenamed("g", "pos")
        rows = F.col("rows")
    else:
        row = df.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.approx_count_distinct(quote(c), APPROX_DISTINCT_RSD).alias(f"u{i}") for i, c in enumerate(cols)],
            *[F.count_if(is_missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)],
        )
        per = _rows(
            row,
            [
                F.struct(
                    F.lit(i).alias("pos"), F.col(f"u{i}").alias("unique"), F.col(f"m{i}").alias("missing"),
                    F.col("n").alias("rows"), F.lit(None).cast("array<string>").alias("sample_values"),
                )
                for i in range(len(cols))
            ],
        )
        rows = F.col("rows")
    return (
        meta.join(per, "pos", "left")
        .select(
            "column",
            "dtype",
            F.coalesce(F.col("unique"), F.lit(0)).cast("bigint").alias("unique"),
            F.coalesce(F.col("missing"), F.lit(0)).cast("bigint").alias("missing"),
            _pct(F.col("missing"), rows).alias("missing_pct"),
            F.coalesce(F.col("sample_values"), F.array().cast("array<string>")).alias("sample_values"),
            "pos",
        )
        .orderBy("pos")
        .drop("pos")
    )


# ------------------------------------------------------------ A5 / A6 / A7 --

# bytes per value of the fixed-width types
_FIXED_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def _narrow_rows(df: DataFrame, limit: int = 64) -> bool:
    sizes = [_FIXED_WIDTH.get(type(f.dataType)) for f in df.schema.fields]
    return all(s is not None for s in sizes) and sum(sizes) <= limit


def _whole_row_counts(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(*[F.col(quote(c)) for c in df.columns])
        .agg(F.count(F.lit(1)).alias("k"))
        .agg(
            F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("rows"),
            F.count(F.lit(1)).cast("bigint").alias("distinct_rows"),
        )
    )


def exact_row_counts(df: DataFrame) -> DataFrame:
    """One row (rows, distinct_rows) with exact counts (nulls compare equal).

    Rows of at most 64 bytes of fixed-width columns are grouped whole. Of wider rows (text,
    nested values) the 32-byte digest is grouped: one pass, one shuffle of at most 32 bytes a
    row after map-side counting, whatever the share of duplicates or the width of the rows.
    """
    if _narrow_rows(df) or any(isinstance(f.dataType, T.MapType) for f in df.schema.fields):
        return _whole_row_counts(df)
    return _whole_row_counts(df.select(row_digest(df).alias("row")))


def duplicate_counts(
    df: DataFrame, id_col: str | None = None, ts_col: str | None = None
) -> DataFrame:
    """(check, rows, duplicates, ratio) for `exact` rows and, when both columns
    exist, the `pair` (id, parsed ts). Nulls compare equal; ratio null on 0 rows.

    Exact rows go through `exact_row_counts` (hash first, whole rows only for
    candidates). The pair check is one hash aggregate on its two-column key
    with map-side partial aggregation, so a key holding a large share of the
    rows collapses in the map tasks before the shuffle.
    """
    exact = exact_row_counts(df).select(
        F.lit("exact").alias("check"),
        "rows",
        (F.col("rows") - F.col("distinct_rows")).alias("duplicates"),
    )
    parts = [exact]
    if id_col and ts_col and id_col in df.columns and ts_col in df.columns:
        ts_type = df.schema[ts_col].dataType
        pair = (
            df.select(F.col(quote(id_col)).alias("i"), to_timestamp(F.col(quote(ts_col)), ts_type).alias("t"))
            .groupBy("i", "t")
            .agg(F.count(F.lit(1)).alias("k"))
            .agg(
                F.lit("pair").alias("check"),
                F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("rows"),
                F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
            )
        )
        parts.append(pair)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ratio", F.try_divide(F.col("duplicates").cast("double"), F.col("rows")))


# --------------------------------------------------------------------- A8 --

def numeric_outliers(
    df: DataFrame, z: float = OUTLIER_Z, accuracy: int | None = None
) -> DataFrame:
    """(column, outlier_count, p99, max) per numeric column, most outliers first.

    Outlier: |x − mean| / std_pop > z. A zero or undefined std gives 0.
    """
    cols = numeric_columns(df)
    spark = df.sparkSession
    schema = "column string, outlier_count bigint, p99 double, max double"
    if not cols:
        return spark.createDataFrame([], schema)
    x = {c: F.nanvl(F.col(quote(c)).cast("double"), F.lit(None).cast("double")) for c in cols}
    first = df.agg(
        *[F.avg(x[c]).alias(f"mu{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(x[c]).alias(f"sd{i}") for i, c in enumerate(cols)],
        *[F.max(x[c]).alias(f"mx{i}") for i, c in enumerate(cols)],
        *stats_columns(cols),
    ).first()
    known = {c: (first[f"n{i}"], first[f"a{i}"], first[f"b{i}"]) for i, c in enumerate(cols)}
    q = quantiles(df, {c: [0.99] for c in cols}, accuracy, stats=known)
    counts = []
    for i, c in enumerate(cols):
        mu, sd = first[f"mu{i}"], first[f"sd{i}"]
        if sd is None or sd == 0 or sd != sd:
            counts.append(F.lit(0).cast("bigint").alias(f"o{i}"))
        else:
            counts.append(F.count_if(F.abs((x[c] - F.lit(mu)) / F.lit(sd)) > z).alias(f"o{i}"))
    second = df.agg(*counts)
    return _rows(
        second,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(i).alias("pos"),
                F.col(f"o{i}").cast("bigint").alias("outlier_count"),
                F.lit(q[c][0]).cast("double").alias("p99"),
                F.lit(first[f"mx{i}"]).cast("double").alias("max"),
            )
            for i, c in enumerate(cols)
        ],
    ).orderBy(F.desc("outlier_count"), "pos").drop("pos")


# -------------------------------------------------------------------- A12 --

def totals(df: DataFrame, value_col: str | None = None) -> DataFrame:
    """(rows, total_value, avg_value); sum of nothing is 0, mean of nothing null."""
    if value_col and value_col in df.columns:
        from tablelens.operators.timeseries import _value

        v = _value(df, value_col)
        total = F.sum(v).cast("double")
        return df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(total, F.lit(0.0)).alias("total_value"),
            (total / F.count(v)).alias("avg_value"),
        )
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(None).cast("double").alias("total_value"),
        F.lit(None).cast("double").alias("avg_value"),
    )


# ------------------------------------------------------------ A13 / A14 --

def top_categories(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """(member, n): rows per member, most frequent first; null is a member.

    The ranking runs on the aggregated counts (`TakeOrderedAndProject`), so
    only `n` rows per task reach the final merge.
    """
    return (
        df.groupBy(F.col(quote(column)).cast("string").alias("member"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_first("member"))
        .limit(n)
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, n): equal-width bins over [min, max]; the max value falls
    in the last bin; empty bins are kept. Finite numbers only; nulls skipped."""
    v = to_number(F.col(quote(column)), df.schema[column].dataType)
    v = F.nanvl(v, F.lit(None).cast("double"))
    # ±inf has no bin on a finite axis (and NaN sorts above every number in
    # Spark), so only finite values are binned
    vals = df.select(v.alias("x")).where(F.col("x").isNotNull() & (F.abs(F.col("x")) != float("inf")))
    bounds = vals.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    spark = df.sparkSession
    if bounds["a"] is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n bigint")
    a, b = float(bounds["a"]), float(bounds["b"])
    endless = math.isinf(b - a)  # the span is beyond the largest double: halves have a finite one

    def edge(k: Column) -> Column:
        if endless:
            return F.lit(a) * (1 - k / bins) + F.lit(b) * (k / bins)
        return F.lit(a) + k * F.lit((b - a) / bins)

    if endless:
        idx = F.least(F.floor((F.col("x") / 2 - F.lit(a / 2)) / F.lit(b / 2 - a / 2) * F.lit(bins)), F.lit(bins - 1))
    elif b > a:
        idx = F.least(F.floor((F.col("x") - F.lit(a)) / F.lit(b - a) * F.lit(bins)), F.lit(bins - 1))
    else:
        idx = F.lit(0)
    counts = vals.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        spine.join(F.broadcast(counts), "bin", "left")
        .select(
            "bin",
            edge(F.col("bin")).alias("lo"),
            edge(F.col("bin") + 1).alias("hi"),
            F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
        )
        .orderBy("bin")
    )


# -------------------------------------------------------------------- A16 --

def validation_actions(
    missing: DataFrame,
    duplicates: DataFrame,
    outliers: DataFrame,
    id_col: str | None,
    ts_col: str | None,
    heavy_missing_pct: float = HEAVY_MISSING_PCT,
) -> DataFrame:
    """(code, detail): suggested next steps from the profile results."""
    spark = missing.sparkSession
    parts = [
        duplicates.where((F.col("check") == "exact") & (F.col("duplicates") > 0)).select(
            F.lit("drop_exact_duplicates").alias("code"),
            F.concat(F.lit("exact duplicate rows: "), F.col("duplicates").cast("string")).alias("detail"),
        ),
        outliers.where(F.col("outlier_count") > 0).agg(F.count(F.lit(1)).alias("k")).where("k > 0").select(
            F.lit("winsorize_outliers").alias("code"),
            F.concat(F.lit("columns with outliers: "), F.col("k").cast("string")).alias("detail"),
        ),
        missing.agg(F.max("missing_pct").alias("m")).where(F.col("m") > heavy_missing_pct).select(
            F.lit("impute_heavy_missing").alias("code"),
            F.concat(F.lit("max missing pct: "), F.col("m").cast("string")).alias("detail"),
        ),
    ]
    fixed = []
    if ts_col is None:
        fixed.append(("map_timestamp", "no timestamp column found"))
    else:
        fixed.append(("confirm_timestamp", f"check zone and granularity of {ts_col}"))
    if id_col is None:
        fixed.append(("map_id", "no id column found"))
    out = spark.createDataFrame(fixed, "code string, detail string")
    for p in parts:
        out = out.unionByName(p)
    return out


__all__ = [
    "missingness",
    "missingness_series",
    "table_summary",
    "column_profile",
    "duplicate_counts",
    "numeric_outliers",
    "totals",
    "top_categories",
    "histogram",
    "validation_actions",
]
