"""Inputs derived from the provided tables, built identically in Spark and in
the oracle SQL.

`dirty_events` is the deterministic "dirty" copy of `events` used to
exercise missingness, trimming, duplicates, outliers and imputation (the
provided tables have no nulls and no duplicates). Every row of `events` is
kept; the rules only alter values or add copies:

* event_id % 7 = 0   -> value null
* event_id % 11 = 0  -> event_type null
* event_id % 13 = 0  -> event_type padded with two blanks on each side
* event_id % 101 = 0 -> value x 50
* event_id % 20 = 0  -> the row appears twice (exact duplicate)
* event_id % 17 = 0  -> one more row, same user and ts, value + 1
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, event_type, value) — one scan of `events`, copies made by
    a per-row `explode` (narrow; no union of re-scans)."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    event_type = (
        F.when(eid % 11 == 0, F.lit(None).cast("string"))
        .when(eid % 13 == 0, F.concat(F.lit("  "), F.col("event_type"), F.lit("  ")))
        .otherwise(F.col("event_type"))
    )
    value = (
        F.when(eid % 7 == 0, F.lit(None).cast("double"))
        .when(eid % 101 == 0, F.col("value") * 50)
        .otherwise(F.col("value"))
    )
    base = e.select("event_id", "user_id", "ts", event_type.alias("event_type"), value.alias("value"))
    copies = F.array(
        F.lit(0),
        F.when(eid % 20 == 0, F.lit(1)),
        F.when(eid % 17 == 0, F.lit(2)),
    )
    return (
        base.select("*", F.explode(copies).alias("copy"))
        .where(F.col("copy").isNotNull())
        .select(
            "user_id",
            "ts",
            "event_type",
            F.when(F.col("copy") == 2, F.col("value") + 1).otherwise(F.col("value")).alias("value"),
        )
    )


DIRTY_EVENTS_SQL = """
dirty_base AS (
  SELECT event_id, user_id, ts,
         CASE WHEN event_id % 11 = 0 THEN NULL
              WHEN event_id % 13 = 0 THEN '  ' || event_type || '  '
              ELSE event_type END AS event_type,
         CASE WHEN event_id % 7 = 0 THEN NULL
              WHEN event_id % 101 = 0 THEN value * 50
              ELSE value END AS value
  FROM events),
d AS (
  SELECT user_id, ts, event_type, value FROM dirty_base
  UNION ALL SELECT user_id, ts, event_type, value FROM dirty_base WHERE event_id % 20 = 0
  UNION ALL SELECT user_id, ts, event_type, value + 1 FROM dirty_base WHERE event_id % 17 = 0)
"""


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation as a business table: (order_id, entity_id,
    event_ts, value, category, state). Money as decimal(18,2) so sums are
    exact. Join strategy is left to Catalyst/AQE: the dimension sides are
    broadcast only when their measured size is under the broadcast threshold."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("entity_id"),
            F.col("o_orderdate").alias("event_ts"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("value"),
            F.col("c_mktsegment").alias("category"),
            F.col("n_name").alias("state"),
        )
    )


SALES_SQL = """
sales AS (
  SELECT o.o_orderkey AS order_id, o.o_custkey AS entity_id, o.o_orderdate AS event_ts,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS value, c.c_mktsegment AS category, n.n_name AS state
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                JOIN nation n ON c.c_nationkey = n.n_nationkey)
"""
