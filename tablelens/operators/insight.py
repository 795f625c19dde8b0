"""Insight operators: KPI bundle, recent top drivers, takeaways."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.constants import (
    DRIVER_DIMENSIONS,
    DRIVER_TOP_N,
    DRIVER_WINDOW_DAYS,
)
from tablelens.functions.expressions import to_timestamp
from tablelens.functions.names import quote
from tablelens.operators.profile import totals
from tablelens.operators.timeseries import _value, anomalies, period_change, weekly_series


# -------------------------------------------------------------------- I1 --

def kpis(df: DataFrame, ts_col: str | None, value_col: str | None) -> dict[str, DataFrame]:
    """totals; weekly series; last-4 vs prior-4 change and z anomalies of the
    weekly count and the weekly value (the count again without a value column).

    The weekly aggregate is computed once and shared (Spark reuses the
    exchange), so the raw table is scanned one time for all four results.
    """
    out = {"totals": totals(df, value_col)}
    if ts_col and ts_col in df.columns:
        weekly = weekly_series(df, ts_col, value_col if value_col in df.columns else None)
        count = weekly.select("week", F.col("n").cast("double").alias("value"))
        value = weekly.select("week", "value")
        out["weekly"] = weekly
        out["period_change"] = period_change(count, "count").unionByName(period_change(value, "value"))
        out["anomalies"] = anomalies(count, "count").unionByName(anomalies(value, "value"))
    return out


# -------------------------------------------------------------------- I2 --

def top_drivers(
    df: DataFrame,
    ts_col: str | None,
    value_col: str | None = None,
    dimensions: list[str] | None = None,
    top: int = DRIVER_TOP_N,
    days: int = DRIVER_WINDOW_DAYS,
) -> DataFrame:
    """(dimension, member, value): per present dimension, the `top` members
    by summed value (rows when no value column) over the last `days` days up
    to the latest timestamp, both ends included. Missing members are dropped.

    The latest timestamp is one scalar job; the window then enters the plan
    as literal bounds, so Parquet can skip row groups. The per-dimension top-k
    runs on the aggregated frame and Spark applies the limit per partition
    before the final exchange (`WindowGroupLimit`).
    """
    spark = df.sparkSession
    empty = spark.createDataFrame([], "dimension string, member string, value double")
    dims = [d for d in (dimensions or DRIVER_DIMENSIONS) if d in df.columns]
    if not ts_col or ts_col not in df.columns or not dims:
        return empty
    ts = to_timestamp(F.col(quote(ts_col)), df.schema[ts_col].dataType)
    latest = df.agg(F.max(ts).alias("m")).first()["m"]
    if latest is None:
        return empty
    start = latest - _dt.timedelta(days=days)
    has_value = bool(value_col and value_col in df.columns)
    v = F.coalesce(_value(df, value_col), F.lit(0)) if has_value else F.lit(1.0)
    recent = df.where(ts.between(F.lit(start), F.lit(latest)))
    members = recent.select(
        v.alias("v"),
        F.inline(
            F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("member")) for d in dims])
        ),
    ).where(F.col("member").isNotNull())
    summed = members.groupBy("dimension", "member").agg(F.sum("v").cast("double").alias("value"))
    w = Window.partitionBy("dimension").orderBy(F.desc("value"), F.asc("member"))
    return (
        summed.withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= top)
        .drop("rn")
    )


# -------------------------------------------------------------------- I3 --

def takeaways(change: DataFrame, drivers: DataFrame, limit: int = 3) -> DataFrame:
    """(rank, kind, direction, pct, dimension, member): value move, count move,
    single top driver, in that order; a generic line when none applies."""
    spark = change.sparkSession
    moves = change.where(F.col("pct_change").isNotNull()).select(
        F.when(F.col("metric") == "value", 1).otherwise(2).alias("o"),
        F.concat(F.col("metric"), F.lit("_move")).alias("kind"),
        F.when(F.col("pct_change") >= 0, "up").otherwise("down").alias("direction"),
        F.abs("pct_change").alias("pct"),
        F.lit(None).cast("string").alias("dimension"),
        F.lit(None).cast("string").alias("member"),
    )
    best = drivers.agg(
        F.max_by(F.struct("dimension", "member"), F.struct("value", F.col("dimension"), F.col("member"))).alias("b")
    ).where(F.col("b").isNotNull()).select(
        F.lit(3).alias("o"),
        F.lit("top_driver").alias("kind"),
        F.lit(None).cast("string").alias("direction"),
        F.lit(None).cast("double").alias("pct"),
        F.col("b.dimension").alias("dimension"),
        F.col("b.member").alias("member"),
    )
    found = moves.unionByName(best)
    generic = spark.createDataFrame(
        [(4, "generic", None, None, None, None)],
        "o int, kind string, direction string, pct double, dimension string, member string",
    )
    allrows = found.unionByName(generic)
    w = Window.orderBy("o")
    ranked = allrows.withColumn("rank", F.row_number().over(w))
    keep = ranked.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return (
        keep.where((F.col("kind") != "generic") | (F.col("k") == 1))
        .where(F.col("rank") <= limit)
        .select("rank", "kind", "direction", "pct", "dimension", "member")
    )
