"""Time-series operators: period series with gap filling, last-4 vs prior-4
change, z-score anomalies.

The raw table is touched once: one hash aggregate by period label. The gap
filling spine is built from that aggregate's own min/max (a calendar-bounded
frame, at most a few thousand rows) and both frames are tiny, so the global
windows of W1/W2 only ever see one row per period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.constants import (
    ANOMALY_MIN_WEEKS,
    ANOMALY_Z,
    CHANGE_MIN_WEEKS,
    CHANGE_WINDOW_WEEKS,
)
from tablelens.functions.expressions import period_label, to_number, to_timestamp
from tablelens.functions.names import quote

METRICS = ("count", "sum", "avg")


def _value(df: DataFrame, column: str) -> Column:
    """Numeric view of a column; decimals stay decimal so sums are exact."""
    dt = df.schema[column].dataType
    if isinstance(dt, T.DecimalType):
        return F.col(quote(column))
    v = to_number(F.col(quote(column)), dt)
    return F.nanvl(v, F.lit(None).cast("double"))


def _fill_gaps(agg: DataFrame, freq: str) -> DataFrame:
    """Insert the empty periods between consecutive aggregated periods.

    One ordered pass over the aggregated frame (one row per period, bounded
    by the calendar span): each row emits the missing periods since its
    predecessor (`lag`) followed by itself. No second reference to the
    aggregate, so the source is scanned once.
    """
    f = freq.upper()
    prev = F.lag("period").over(Window.orderBy("period"))
    if f == "M":
        start = F.add_months(F.trunc(F.col("prev"), "month"), 1)
        stop = F.add_months(F.trunc(F.col("period"), "month"), -1)
        gaps = F.transform(
            F.sequence(start, stop, F.expr("interval 1 month")), lambda d: F.last_day(d)
        )
        has_gap = F.months_between(F.trunc(F.col("period"), "month"), F.trunc(F.col("prev"), "month")) > 1
    else:
        step = 1 if f == "D" else 7
        gaps = F.sequence(
            F.date_add(F.col("prev"), step), F.date_sub(F.col("period"), step), F.expr(f"interval {step} day")
        )
        has_gap = F.datediff(F.col("period"), F.col("prev")) > step
    empty = F.transform(
        F.when(F.col("prev").isNotNull() & has_gap, gaps).otherwise(F.array().cast("array<date>")),
        lambda d: F.struct(
            d.alias("period"),
            F.lit(None).cast("bigint").alias("n"),
            F.lit(None).cast("double").alias("total"),
            F.lit(None).cast("double").alias("mean"),
            F.lit(None).cast("double").alias("qty"),
        ),
    )
    own = F.array(F.struct("period", "n", "total", "mean", "qty"))
    return (
        agg.withColumn("prev", prev)
        .select(F.inline(F.concat(empty, own)))
    )


def period_aggregate(
    df: DataFrame,
    ts_col: str,
    value_col: str | None = None,
    quantity_col: str | None = None,
    freq: str = "W",
) -> DataFrame:
    """(period, n, total, mean, qty): gap-filled per-period aggregates.

    Rows whose timestamp does not parse are dropped first. Empty periods get
    n = 0, total = 0, mean = null, qty = 0.
    """
    ts = to_timestamp(F.col(quote(ts_col)), df.schema[ts_col].dataType)
    cols = [period_label(ts, freq).alias("period")]
    if value_col and value_col in df.columns:
        cols.append(_value(df, value_col).alias("v"))
    else:
        cols.append(F.lit(None).cast("double").alias("v"))
    if quantity_col and quantity_col in df.columns:
        cols.append(_value(df, quantity_col).alias("q"))
    else:
        cols.append(F.lit(None).cast("double").alias("q"))
    base = df.select(*cols).where(F.col("period").isNotNull())
    # mean = Σv / count(v) in double from the (exact, for decimals) sum
    agg = base.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("v").cast("double").alias("total"),
        (F.sum("v").cast("double") / F.count("v")).alias("mean"),
        F.sum("q").cast("double").alias("qty"),
    )
    return (
        _fill_gaps(agg, freq)
        .select(
            "period",
            F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
            F.coalesce(F.col("total"), F.lit(0.0)).alias("total"),
            F.col("mean"),
            F.coalesce(F.col("qty"), F.lit(0.0)).alias("qty"),
        )
    )


def weekly_series(df: DataFrame, ts_col: str, value_col: str | None = None) -> DataFrame:
    """(week, n, value): Monday–Sunday weeks labelled by their Sunday, gaps
    filled; `value` is the weekly sum of `value_col` (0 when nothing), or the
    row count when no value column is given."""
    p = period_aggregate(df, ts_col, value_col, None, "W")
    has_value = bool(value_col and value_col in df.columns)
    value = F.col("total") if has_value else F.col("n").cast("double")
    return p.select(F.col("period").alias("week"), "n", value.alias("value")).orderBy("week")


def timeseries(
    df: DataFrame,
    ts_col: str,
    value_col: str | None = None,
    quantity_col: str | None = None,
    metric: str = "count",
    freq: str = "W",
) -> DataFrame:
    """(period, value) for metric count / sum / avg at frequency D / W / M.

    `avg` with a quantity column is Σvalue / Σquantity (null when Σquantity
    is 0). Gaps: count and sum 0, averages null. Without a value column every
    metric falls back to count.
    """
    m = metric.lower()
    if m not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    has_value = bool(value_col and value_col in df.columns)
    has_qty = bool(quantity_col and quantity_col in df.columns)
    p = period_aggregate(df, ts_col, value_col, quantity_col if has_qty else None, freq)
    if m == "count" or not has_value:
        value = F.col("n").cast("double")
    elif m == "sum":
        value = F.col("total")
    elif has_qty:
        value = F.try_divide(F.col("total"), F.when(F.col("qty") != 0, F.col("qty")))
    else:
        value = F.col("mean")
    return p.select("period", value.alias("value")).orderBy("period")


def period_change(series: DataFrame, metric: str, value_col: str = "value",
                  order_col: str = "week", window: int = CHANGE_WINDOW_WEEKS,
                  min_periods: int = CHANGE_MIN_WEEKS) -> DataFrame:
    """(metric, recent_4w, prior_4w, abs_change, pct_change) over a gap-filled
    series; no row when the series has fewer than `min_periods` periods.
    `pct_change` is null when the prior sum is 0."""
    rn = F.row_number().over(Window.orderBy(F.desc(order_col)))
    ranked = series.select(F.col(quote(value_col)).alias("v"), rn.alias("rn"))
    agg = ranked.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(F.when(F.col("rn") <= window, F.col("v"))).alias("recent"),
        F.sum(F.when((F.col("rn") > window) & (F.col("rn") <= 2 * window), F.col("v"))).alias("prior"),
    )
    change = F.col("recent") - F.col("prior")
    return agg.where(F.col("k") >= min_periods).select(
        F.lit(metric).alias("metric"),
        F.col("recent").cast("double").alias("recent_4w"),
        F.col("prior").cast("double").alias("prior_4w"),
        change.cast("double").alias("abs_change"),
        F.when(F.col("prior") != 0, change / F.col("prior") * 100.0).cast("double").alias("pct_change"),
    )


def anomalies(series: DataFrame, metric: str, value_col: str = "value",
              order_col: str = "week", z: float = ANOMALY_Z,
              min_periods: int = ANOMALY_MIN_WEEKS) -> DataFrame:
    """(metric, week, value, zscore) for periods with |z| >= 2 (sample std),
    only when the series has at least 12 periods and a non-zero spread."""
    whole = Window.partitionBy(F.lit(0))
    v = F.col(quote(value_col)).cast("double")
    s = series.select(
        F.col(quote(order_col)).alias("week"),
        v.alias("value"),
        F.avg(v).over(whole).alias("mu"),
        F.stddev_samp(v).over(whole).alias("sd"),
        F.count(F.lit(1)).over(whole).alias("k"),
    )
    zs = (F.col("value") - F.col("mu")) / F.col("sd")
    return (
        s.where((F.col("k") >= min_periods) & (F.col("sd") > 0) & ~F.isnan("sd"))
        .select(F.lit(metric).alias("metric"), "week", "value", zs.alias("zscore"))
        .where(F.abs(F.col("zscore")) >= z)
        .orderBy("week")
    )
