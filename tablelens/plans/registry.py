"""Registered queries: each name maps to a Spark callable (spark, sf_dir) ->
DataFrame and, where the result is expressible in SQL, the equivalent query
over the same tables for an independent engine.

Doubles that come out of floating sums or interpolation are rounded on both
sides (6 places, 2 for money) so that summation order cannot change the
comparison; money is summed as decimal(18,2), which is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.constants import CARD_PATTERN, EMAIL_PATTERN, PHONE_PATTERN
from tablelens.functions.names import quote
from tablelens.operators import cleaning, insight, profile, quality, timeseries
from tablelens.plans.fixtures import (
    DIRTY_EVENTS_SQL,
    SALES_SQL,
    dirty_events,
    sales,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _portable(fn(spark, sf_dir))

        run.__name__ = run.__qualname__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = _decimal_rounding(sql.strip())
        return fn

    return wrap


def _portable(df: DataFrame) -> DataFrame:
    """Result types every client reads the same way: dates as timestamps,
    decimals as doubles, string lists joined by `|` (the SQL twins cast the
    same way). Applied to registered results only; operators keep their types."""
    from pyspark.sql import types as T

    cols = []
    for f in df.schema.fields:
        c = F.col(quote(f.name))
        if isinstance(f.dataType, T.DateType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _round(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round through decimal(38,12) so ties break the same way in both engines."""
    return df.select(
        *[
            F.round(F.col(c).cast("decimal(38,12)"), digits[c]).cast("double").alias(c)
            if c in digits else F.col(c)
            for c in df.columns
        ]
    )


def _decimal_rounding(sql: str) -> str:
    """Rewrite `round(x, d)` / `round_even(x, d)` in oracle SQL to round the
    decimal value of x read from its shortest text (as Spark casts a double to
    decimal), matching `_round` and `bround` on the Spark side."""
    out, i = [], 0
    while True:
        j = sql.find("round", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        even = sql.startswith("round_even(", j)
        plain = sql.startswith("round(", j) and (j == 0 or not (sql[j - 1].isalnum() or sql[j - 1] == "_"))
        if not (even or plain):
            out.append(sql[i:j + 5])
            i = j + 5
            continue
        start = j + (11 if even else 6)
        depth, k, comma = 1, start, None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = _decimal_rounding(sql[start:comma])
        digits = sql[comma + 1:k - 1].strip()
        fn = "round_even" if even else "round"
        out.append(sql[i:j])
        out.append(f"CAST({fn}(CAST(CAST(({inner}) AS VARCHAR) AS DECIMAL(38,12)), {digits}) AS DOUBLE)")
        i = k


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


# column lists of the inputs (for the generated per-column SQL)
DIRTY_COLS = [("user_id", "bigint"), ("ts", "timestamp_ntz"), ("event_type", "string"), ("value", "double")]
CUSTOMER_COLS = [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
    ("c_acctbal", "double"), ("c_mktsegment", "string"),
]
LINEITEM_NUMERIC = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


def _q(name: str) -> str:
    return '"' + name + '"'


def _missing_expr(col: str, dtype: str) -> str:
    if dtype in ("double", "float"):
        return f"count(*) FILTER (WHERE {col} IS NULL OR isnan({col}))"
    return f"count(*) FILTER (WHERE {col} IS NULL)"


def _missingness_sql(source: str, cols: list[tuple[str, str]]) -> str:
    parts = [
        f"SELECT '{c}' AS {_q('column')}, {_missing_expr(c, t)} AS missing, "
        f"round_even(CAST({_missing_expr(c, t)} AS DOUBLE) / count(*) * 100.0, 2) AS missing_pct FROM {source}"
        for c, t in cols
    ]
    return "\nUNION ALL ".join(parts)


# ------------------------------------------------------------ profile ---

@register("missingness_dirty_events", _with(DIRTY_EVENTS_SQL) + _missingness_sql("d", DIRTY_COLS))
def q_missingness(spark, sf):
    return profile.missingness(dirty_events(spark, sf))


@register(
    "missingness_series_dirty_events",
    _with(DIRTY_EVENTS_SQL, "m AS (" + _missingness_sql("d", DIRTY_COLS) + ")")
    + 'SELECT "column", missing_pct FROM m WHERE missing > 0 ORDER BY missing_pct DESC LIMIT 50',
)
def q_missingness_series(spark, sf):
    return profile.missingness_series(dirty_events(spark, sf))


@register(
    "missingness_customer", _missingness_sql("customer", CUSTOMER_COLS)
)
def q_missingness_customer(spark, sf):
    return profile.missingness(table(spark, sf, "customer"))


def _profile_sql(source: str, cols: list[tuple[str, str]], unsampled: tuple[str, ...] = ()) -> str:
    """One row per column: counts, and the three smallest distinct values as text."""
    def samples(c: str, t: str) -> str:
        if c in unsampled:
            return "CAST(NULL AS VARCHAR)"
        own = f"{c} IS NOT NULL" + (f" AND NOT isnan({c})" if t in ("double", "float") else "")
        return (
            f"array_to_string(coalesce((SELECT list(CAST(v AS VARCHAR) ORDER BY v) FROM "
            f"(SELECT DISTINCT {c} AS v FROM {source} WHERE {own} ORDER BY v LIMIT 3)), []), '|')"
        )

    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS {_q('column')}, '{t}' AS dtype, (SELECT count(DISTINCT {c}) FROM {source}) AS {_q('unique')}, "
        f"(SELECT {_missing_expr(c, t)} FROM {source}) AS missing, "
        f"(SELECT round_even(CAST({_missing_expr(c, t)} AS DOUBLE) / count(*) * 100.0, 2) FROM {source}) AS missing_pct, "
        f"{samples(c, t)} AS sample_values"
        for c, t in cols
    )


@register("column_profile_customer", _profile_sql("customer", CUSTOMER_COLS))
def q_column_profile(spark, sf):
    return profile.column_profile(table(spark, sf, "customer"))


@register("column_profile_dirty_events", _with(DIRTY_EVENTS_SQL) + _profile_sql("d", DIRTY_COLS))
def q_column_profile_dirty(spark, sf):
    return profile.column_profile(dirty_events(spark, sf))


@register("table_summary_customer", "SELECT count(*) AS rows, 5 AS cols FROM customer")
def q_table_summary(spark, sf):
    return profile.table_summary(table(spark, sf, "customer"))


_DUPS_SQL = _with(
    DIRTY_EVENTS_SQL,
    "ex AS (SELECT count(*) AS k FROM (SELECT DISTINCT user_id, ts, event_type, value FROM d))",
    "pr AS (SELECT count(*) AS k FROM (SELECT DISTINCT user_id, ts FROM d))",
    "n AS (SELECT count(*) AS n FROM d)",
) + """SELECT 'exact' AS "check", n.n AS rows, n.n - ex.k AS duplicates, CAST(n.n - ex.k AS DOUBLE) / n.n AS ratio FROM n, ex
UNION ALL SELECT 'pair', n.n, n.n - pr.k, CAST(n.n - pr.k AS DOUBLE) / n.n FROM n, pr"""


@register("duplicate_counts_dirty_events", _DUPS_SQL)
def q_duplicates(spark, sf):
    return profile.duplicate_counts(dirty_events(spark, sf), "user_id", "ts")


def _outliers_sql(source: str, cols: list[str], prefix: str = "") -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS {_q('column')}, "
            f"(SELECT count(*) FROM {source}, s_{c} WHERE s_{c}.sd > 0 AND abs(({x} - s_{c}.mu) / s_{c}.sd) > 4) AS outlier_count, "
            f"round(s_{c}.p99, 6) AS p99, round(s_{c}.mx, 6) AS max FROM s_{c}"
        )
    ctes = [
        f"s_{c} AS (SELECT avg(CAST({c} AS DOUBLE)) AS mu, stddev_pop(CAST({c} AS DOUBLE)) AS sd, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.99) AS p99, max(CAST({c} AS DOUBLE)) AS mx FROM {source})"
        for c in cols
    ]
    return _with(*([prefix] if prefix else []), *ctes) + "\nUNION ALL ".join(parts)


@register("numeric_outliers_lineitem", _outliers_sql("lineitem", LINEITEM_NUMERIC))
def q_outliers_lineitem(spark, sf):
    return _round(profile.numeric_outliers(table(spark, sf, "lineitem")), {"p99": 6, "max": 6})


@register("numeric_outliers_dirty_events", _outliers_sql("d", ["user_id", "value"], DIRTY_EVENTS_SQL))
def q_outliers_dirty(spark, sf):
    return _round(profile.numeric_outliers(dirty_events(spark, sf)), {"p99": 6, "max": 6})


@register(
    "totals_orders",
    "SELECT count(*) AS rows, coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS total_value, "
    "round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice), 6) AS avg_value FROM orders",
)
def q_totals(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    return _round(profile.totals(o, "o_totalprice"), {"avg_value": 6})


@register(
    "top_categories_orders",
    "SELECT CAST(o_orderpriority AS VARCHAR) AS member, count(*) AS n FROM orders "
    "GROUP BY 1 ORDER BY n DESC, member NULLS FIRST LIMIT 20",
)
def q_top_categories(spark, sf):
    return profile.top_categories(table(spark, sf, "orders"), "o_orderpriority", 20)


@register(
    "top_categories_part_brand",
    "SELECT CAST(p_brand AS VARCHAR) AS member, count(*) AS n FROM part "
    "GROUP BY 1 ORDER BY n DESC, member NULLS FIRST LIMIT 20",
)
def q_top_categories_brand(spark, sf):
    return profile.top_categories(table(spark, sf, "part"), "p_brand", 20)


@register(
    "histogram_lineitem",
    """WITH x AS (SELECT l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL),
b AS (SELECT min(x) AS a, max(x) AS b FROM x),
c AS (SELECT CAST(least(floor((x.x - b.a) / (b.b - b.a) * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM x, b GROUP BY 1),
s AS (SELECT CAST(range AS INTEGER) AS bin FROM range(50))
SELECT s.bin, round(b.a + s.bin * ((b.b - b.a) / 50), 6) AS lo, round(b.a + (s.bin + 1) * ((b.b - b.a) / 50), 6) AS hi,
       coalesce(c.n, 0) AS n
FROM s CROSS JOIN b LEFT JOIN c ON s.bin = c.bin""",
)
def q_histogram(spark, sf):
    return _round(profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50), {"lo": 6, "hi": 6})


# ------------------------------------------------------------ quality ---

_CHECKS_SQL = _with(
    DIRTY_EVENTS_SQL,
    "ex AS (SELECT count(*) AS k FROM (SELECT DISTINCT user_id, ts, event_type, value FROM d))",
    "pr AS (SELECT count(*) AS k FROM (SELECT DISTINCT user_id, ts FROM d))",
    "n AS (SELECT count(*) AS n FROM d)",
) + (
    """SELECT 'dup_exact' AS "check", CAST(NULL AS VARCHAR) AS "column", CAST(n.n - ex.k AS DOUBLE) / n.n AS observed,
       CAST(0.05 AS DOUBLE) AS threshold, coalesce(CAST(n.n - ex.k AS DOUBLE) / n.n <= 0.05, false) AS passed FROM n, ex
UNION ALL SELECT 'dup_pair', NULL, CAST(n.n - pr.k AS DOUBLE) / n.n, 0.02, coalesce(CAST(n.n - pr.k AS DOUBLE) / n.n <= 0.02, false) FROM n, pr
UNION ALL """
    + "\nUNION ALL ".join(
        f"SELECT 'missing', '{c}', CAST({_missing_expr(c, t)} AS DOUBLE) / count(*), 0.2, "
        f"coalesce(NOT (CAST({_missing_expr(c, t)} AS DOUBLE) / count(*) > 0.2), true) FROM d"
        for c, t in DIRTY_COLS
    )
)


@register("quality_checks_dirty_events", _CHECKS_SQL)
def q_quality_checks(spark, sf):
    return quality.quality_checks(dirty_events(spark, sf), id_col="user_id", ts_col="ts")


@register(
    "quality_gate_dirty_events",
    "WITH c AS (" + _CHECKS_SQL.replace("\n", "\n  ") + ")\nSELECT coalesce(bool_and(passed), false) AS passed, "
    "count(*) FILTER (WHERE NOT passed) AS failed_checks FROM c",
)
def q_quality_gate(spark, sf):
    return quality.quality_gate(
        quality.quality_checks(dirty_events(spark, sf), id_col="user_id", ts_col="ts")
    )


def _pii_sql(source: str, cols: list[str]) -> str:
    hit = " OR ".join(f"regexp_matches(CAST({{c}} AS VARCHAR), '{p}')" for p in (EMAIL_PATTERN, PHONE_PATTERN, CARD_PATTERN))
    parts = [
        f"SELECT '{c}' AS {_q('column')}, {i} AS pos, count(*) FILTER (WHERE {hit.replace("{c}", c)}) AS hits, "
        f"count(*) AS rows_scanned FROM {source}"
        for i, c in enumerate(cols)
    ]
    return "SELECT \"column\", hits, rows_scanned FROM (" + "\nUNION ALL ".join(parts) + ") WHERE hits > 0"


@register("pii_scan_documents", _pii_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def q_pii_documents(spark, sf):
    return quality.pii_scan(table(spark, sf, "documents"))


@register("pii_scan_pages", _pii_sql("pages", ["page_id", "url", "html"]))
def q_pii_pages(spark, sf):
    return quality.pii_scan(table(spark, sf, "pages"))


@register("pii_scan_conversations", _pii_sql("conversations", ["conv_id", "turn", "role", "text"]))
def q_pii_conversations(spark, sf):
    return quality.pii_scan(table(spark, sf, "conversations"))


@register("pii_scan_customer", _pii_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def q_pii_customer(spark, sf):
    return quality.pii_scan(table(spark, sf, "customer"))


@register(
    "mask_column_customer",
    "SELECT * REPLACE (CASE WHEN length(c_name) <= 4 THEN c_name "
    "ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END AS c_name) FROM customer",
)
def q_mask(spark, sf):
    return quality.mask_column(table(spark, sf, "customer"), "c_name", 4)


# -------------------------------------------------------- time series ---

def _period_sql(label: str, step: str, value: str, source: str = "orders", ts: str = "o_orderdate",
                qty: str | None = None, month: bool = False) -> str:
    q = f", sum({qty}) AS qty" if qty else ", CAST(NULL AS DOUBLE) AS qty"
    agg = (
        f"a AS (SELECT {label} AS period, count(*) AS n, CAST(sum({value}) AS DOUBLE) AS total, "
        f"CAST(sum({value}) AS DOUBLE) / count({value}) AS mean{q} FROM {source} WHERE {ts} IS NOT NULL GROUP BY 1)"
    )
    bounds = "b AS (SELECT min(period) AS lo, max(period) AS hi FROM a)"
    if month:
        spine = (
            "s AS (SELECT CAST(last_day(CAST(unnest(generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP), "
            "CAST(date_trunc('month', hi) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE)) AS DATE) AS period FROM b)"
        )
    else:
        spine = (
            "s AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), "
            f"INTERVAL {step})) AS DATE) AS period FROM b)"
        )
    full = (
        "p AS (SELECT s.period, coalesce(a.n, 0) AS n, coalesce(a.total, 0.0) AS total, a.mean, "
        "coalesce(a.qty, 0.0) AS qty FROM s LEFT JOIN a ON s.period = a.period)"
    )
    return ",\n".join([agg, bounds, spine, full])


_WEEK = "CAST(date_trunc('week', o_orderdate) AS DATE) + 6"
_DAY = "CAST(o_orderdate AS DATE)"
_MONTH = "last_day(CAST(o_orderdate AS DATE))"
_MONEY = "CAST(o_totalprice AS DECIMAL(18,2))"
_LABELS = {"d": (_DAY, "1 DAY", False), "w": (_WEEK, "7 DAY", False), "m": (_MONTH, "1 MONTH", True)}


def _orders_money(spark, sf):
    return table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))


@register(
    "weekly_series_orders",
    "WITH " + _period_sql(_WEEK, "7 DAY", _MONEY) + "\nSELECT CAST(period AS TIMESTAMP) AS week, n, total AS value FROM p",
)
def q_weekly(spark, sf):
    return timeseries.weekly_series(_orders_money(spark, sf), "o_orderdate", "o_totalprice")


@register(
    "weekly_count_series_events",
    "WITH " + _period_sql(
        "CAST(date_trunc('week', ts) AS DATE) + 6", "7 DAY", "CAST(NULL AS DOUBLE)", "events", "ts"
    ) + "\nSELECT CAST(period AS TIMESTAMP) AS week, n, CAST(n AS DOUBLE) AS value FROM p",
)
def q_weekly_events(spark, sf):
    return timeseries.weekly_series(table(spark, sf, "events"), "ts", None)


def _register_series(metric: str, freq: str):
    label, step, month = _LABELS[freq]
    value = {"count": "CAST(n AS DOUBLE)", "sum": "total", "avg": "round(mean, 6)"}[metric]
    sql = "WITH " + _period_sql(label, step, _MONEY, month=month) + f"\nSELECT CAST(period AS TIMESTAMP) AS period, {value} AS value FROM p"

    def fn(spark, sf):
        out = timeseries.timeseries(_orders_money(spark, sf), "o_orderdate", "o_totalprice", None, metric, freq)
        return _round(out, {"value": 6}) if metric == "avg" else out

    register(f"timeseries_{metric}_{freq}_orders", sql)(fn)


for _m in ("count", "sum", "avg"):
    for _f in ("d", "w", "m"):
        _register_series(_m, _f)


_RATIO_LABEL = "CAST(date_trunc('week', l_shipdate) AS DATE) + 6"


@register(
    "timeseries_ratio_w_lineitem",
    "WITH " + _period_sql(
        _RATIO_LABEL, "7 DAY", "CAST(l_extendedprice AS DECIMAL(18,2))", "lineitem", "l_shipdate", qty="l_quantity"
    ) + "\nSELECT CAST(period AS TIMESTAMP) AS period, round(CASE WHEN qty <> 0 THEN total / qty END, 6) AS value FROM p",
)
def q_ratio(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice").cast("decimal(18,2)"))
    out = timeseries.timeseries(li, "l_shipdate", "l_extendedprice", "l_quantity", "avg", "W")
    return _round(out, {"value": 6})


_WEEKLY_RANKED = (
    "WITH " + _period_sql(_WEEK, "7 DAY", _MONEY)
    + ",\nr AS (SELECT period AS week, CAST(n AS DOUBLE) AS cnt, total AS val, "
    "row_number() OVER (ORDER BY period DESC) AS rn, count(*) OVER () AS k FROM p)"
)


def _change_sql(metric: str, col: str) -> str:
    rec = f"sum({col}) FILTER (WHERE rn <= 4)"
    pri = f"sum({col}) FILTER (WHERE rn > 4 AND rn <= 8)"
    return (
        f"SELECT '{metric}' AS metric, round({rec}, 2) AS recent_4w, round({pri}, 2) AS prior_4w, "
        f"round({rec} - {pri}, 2) AS abs_change, "
        f"round(CASE WHEN {pri} <> 0 THEN ({rec} - {pri}) / {pri} * 100.0 END, 6) AS pct_change "
        f"FROM r HAVING count(*) >= 8"
    )


@register("period_change_orders", _WEEKLY_RANKED + "\n" + _change_sql("count", "cnt") + "\nUNION ALL " + _change_sql("value", "val"))
def q_change(spark, sf):
    k = insight.kpis(_orders_money(spark, sf), "o_orderdate", "o_totalprice")
    return _round(
        k["period_change"], {"recent_4w": 2, "prior_4w": 2, "abs_change": 2, "pct_change": 6}
    )


def _anomaly_sql(metric: str, col: str) -> str:
    return (
        f"SELECT '{metric}' AS metric, week, round({col}, 2) AS value, "
        f"round(({col} - avg({col}) OVER ()) / stddev_samp({col}) OVER (), 6) AS zscore, "
        f"({col} - avg({col}) OVER ()) / stddev_samp({col}) OVER () AS z, "
        f"stddev_samp({col}) OVER () AS sd, k FROM r"
    )


@register(
    "anomalies_orders",
    _WEEKLY_RANKED
    + ",\nz AS (" + _anomaly_sql("count", "cnt") + "\nUNION ALL " + _anomaly_sql("value", "val") + ")"
    + "\nSELECT metric, CAST(week AS TIMESTAMP) AS week, value, zscore FROM z WHERE k >= 12 AND sd > 0 AND abs(z) >= 2",
)
def q_anomalies(spark, sf):
    k = insight.kpis(_orders_money(spark, sf), "o_orderdate", "o_totalprice")
    return _round(k["anomalies"], {"value": 2, "zscore": 6})


@register(
    "top_drivers_orders",
    _with(SALES_SQL)
    + """, m AS (SELECT max(event_ts) AS hi FROM sales),
r AS (SELECT sales.* FROM sales, m WHERE sales.event_ts BETWEEN m.hi - INTERVAL 28 DAY AND m.hi),
u AS (SELECT 'category' AS dimension, CAST(category AS VARCHAR) AS member, value AS v FROM r
      UNION ALL SELECT 'state', CAST(state AS VARCHAR), value FROM r),
g AS (SELECT dimension, member, CAST(sum(coalesce(v, 0)) AS DOUBLE) AS value FROM u WHERE member IS NOT NULL GROUP BY 1, 2)
SELECT dimension, member, value FROM (
  SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY value DESC, member) AS rn FROM g) WHERE rn <= 10""",
)
def q_drivers(spark, sf):
    return insight.top_drivers(sales(spark, sf), "event_ts", "value")


# ------------------------------------------------------------ cleaning ---

_TRIM = "regexp_replace(event_type, '^\\s+|\\s+$', '', 'g')"


@register(
    "trim_strings_dirty_events",
    _with(DIRTY_EVENTS_SQL) + f"SELECT user_id, ts, {_TRIM} AS event_type, value FROM d",
)
def q_trim(spark, sf):
    return cleaning.trim_strings(dirty_events(spark, sf))


@register("drop_duplicates_dirty_events", _with(DIRTY_EVENTS_SQL) + "SELECT DISTINCT user_id, ts, event_type, value FROM d")
def q_dedupe(spark, sf):
    return cleaning.drop_duplicates(dirty_events(spark, sf))


_PAIR_SQL = (
    "SELECT user_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts "
    "ORDER BY event_type ASC NULLS FIRST, value ASC NULLS FIRST) AS rn FROM {src}) WHERE rn = 1"
)


@register("drop_pair_duplicates_dirty_events", _with(DIRTY_EVENTS_SQL) + _PAIR_SQL.format(src="d"))
def q_pair_dedupe(spark, sf):
    return cleaning.drop_duplicates(dirty_events(spark, sf), ["user_id", "ts"])


def _winsor_ctes(src: str) -> list[str]:
    return [
        f"q AS (SELECT quantile_cont(user_id, 0.0) AS ul, quantile_cont(user_id, 0.99) AS uh, "
        f"quantile_cont(value, 0.0) AS vl, quantile_cont(value, 0.99) AS vh FROM {src})",
        f"w AS (SELECT CASE WHEN user_id > uh THEN uh WHEN user_id < ul THEN ul ELSE CAST(user_id AS DOUBLE) END AS user_id, "
        f"ts, event_type, CASE WHEN value > vh THEN vh WHEN value < vl THEN vl ELSE value END AS value FROM {src}, q)",
    ]


@register(
    "winsorize_dirty_events",
    _with(DIRTY_EVENTS_SQL, *_winsor_ctes("d"))
    + "SELECT round(user_id, 6) AS user_id, ts, event_type, round(value, 6) AS value FROM w",
)
def q_winsorize(spark, sf):
    out, _ = cleaning.winsorize(dirty_events(spark, sf))
    return _round(out, {"user_id": 6, "value": 6})


@register(
    "impute_numeric_dirty_events",
    _with(DIRTY_EVENTS_SQL)
    + "SELECT user_id, ts, event_type, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM d)), 6) AS value FROM d",
)
def q_impute_numeric(spark, sf):
    out, _ = cleaning.impute_numeric(dirty_events(spark, sf))
    return _round(out, {"value": 6})


_MODE = (
    "mo AS (SELECT event_type FROM {src} WHERE event_type IS NOT NULL GROUP BY 1 "
    "ORDER BY count(*) DESC, event_type LIMIT 1)"
)


@register(
    "impute_categorical_dirty_events",
    _with(DIRTY_EVENTS_SQL, _MODE.format(src="d"))
    + "SELECT user_id, ts, coalesce(event_type, (SELECT event_type FROM mo)) AS event_type, value FROM d",
)
def q_impute_categorical(spark, sf):
    out, _ = cleaning.impute_categorical(dirty_events(spark, sf))
    return out


_CLEAN_CTES = [
    f"t AS (SELECT user_id, ts, {_TRIM} AS event_type, value FROM d)",
    "p AS (" + _PAIR_SQL.format(src="t") + ")",
    *_winsor_ctes("p"),
    "med AS (SELECT quantile_cont(user_id, 0.5) AS um, quantile_cont(value, 0.5) AS vm FROM w)",
    _MODE.format(src="w"),
    "c AS (SELECT coalesce(user_id, um) AS user_id, ts, coalesce(event_type, (SELECT event_type FROM mo)) AS event_type, "
    "coalesce(value, vm) AS value FROM w, med)",
]


@register(
    "clean_dirty_events",
    _with(DIRTY_EVENTS_SQL, *_CLEAN_CTES)
    + "SELECT round(user_id, 6) AS user_id, ts, event_type, round(value, 6) AS value FROM c",
)
def q_clean(spark, sf):
    out, _ = cleaning.clean(dirty_events(spark, sf), id_col="user_id", ts_col="ts")
    return _round(out, {"user_id": 6, "value": 6})


@register(
    "clean_report_dirty_events",
    _with(DIRTY_EVENTS_SQL, *_CLEAN_CTES)
    + """SELECT * FROM (SELECT 'trim' AS step, CAST(NULL AS VARCHAR) AS "column", CAST(1 AS BIGINT) AS affected
UNION ALL SELECT 'drop_exact_duplicates', NULL, (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))
UNION ALL SELECT 'drop_pair_duplicates', 'user_id,ts', (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) - (SELECT count(*) FROM p)
UNION ALL SELECT 'winsorize', 'user_id', (SELECT count(*) FROM p, q WHERE user_id < ul OR user_id > uh)
UNION ALL SELECT 'winsorize', 'value', (SELECT count(*) FROM p, q WHERE value < vl OR value > vh)
UNION ALL SELECT 'impute_numeric', 'value', (SELECT count(*) FROM w WHERE value IS NULL)
UNION ALL SELECT 'impute_categorical', 'event_type', (SELECT count(*) FROM w WHERE event_type IS NULL)
UNION ALL SELECT 'rows', NULL, (SELECT count(*) FROM c))
WHERE step NOT IN ('winsorize', 'impute_numeric', 'impute_categorical') OR affected > 0""",
)
def q_clean_report(spark, sf):
    _, report = cleaning.clean(dirty_events(spark, sf), id_col="user_id", ts_col="ts")
    return report.select("step", "column", "affected")


# --------------------------------------------------------------- roles ---

ORDERS_COLS = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
    ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]
_NUMERIC = {"bigint", "int", "double"}


def _facts_sql(source: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, t) in enumerate(cols):
        if t in _NUMERIC:
            dp = "0"
        elif t.startswith("timestamp"):
            dp = f"count({c})"
        else:
            dp = f"count(TRY_CAST({c} AS TIMESTAMP))"
        parts.append(
            f"SELECT '{c}' AS {_q('column')}, {i} AS pos, {str(t in _NUMERIC).lower()} AS is_numeric, "
            f"{str(t == 'string').lower()} AS is_string, count(*) AS rows, count(DISTINCT {c}) AS dist, "
            f"{dp} AS date_parses FROM {source}"
        )
    return "f AS (" + "\nUNION ALL ".join(parts) + ")"


def _suggest_sql(source: str, cols: list[tuple[str, str]]) -> str:
    from tablelens.functions.constants import ROLE_SYNONYMS, ROLES

    synonyms = ", ".join(f"('{r}', {k}, '{x}')" for k, r in enumerate(ROLES) for x in ROLE_SYNONYMS.get(r, []))
    names = ", ".join(f"('{c}')" for c, _ in cols)
    return _with(
        _facts_sql(source, cols),
        f"syn(role, role_pos, synonym) AS (VALUES {synonyms})",
        f"nm({_q('column')}) AS (VALUES {names})",
        """lex AS (SELECT role, role_pos, "column", sum(CASE WHEN lower("column") = synonym THEN 3
            WHEN contains(lower("column"), synonym) THEN 2
            WHEN len(list_intersect(regexp_extract_all(lower("column"), '[0-9a-z]+'), regexp_extract_all(lower(synonym), '[0-9a-z]+'))) > 0 THEN 1
            ELSE 0 END) AS lex FROM syn CROSS JOIN nm GROUP BY 1, 2, 3)""",
        """s AS (SELECT lex.role, lex."column", f.pos, lex.lex + CASE
            WHEN lex.role = 'event_ts' THEN CASE WHEN CAST(date_parses AS DOUBLE) / rows >= 0.7 THEN 2
                                                WHEN CAST(date_parses AS DOUBLE) / rows >= 0.3 THEN 1 ELSE 0 END
            WHEN lex.role IN ('value', 'quantity') THEN CAST(is_numeric AS INTEGER)
            WHEN lex.role = 'entity_id' THEN CASE WHEN CAST(dist AS DOUBLE) / rows >= 0.9 THEN 2
                                                 WHEN CAST(dist AS DOUBLE) / rows >= 0.2 THEN 1 ELSE 0 END
            ELSE 0 END AS score
          FROM lex JOIN f ON lex."column" = f."column")""",
    ) + """SELECT role, "column", CAST(score AS INTEGER) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY role ORDER BY score DESC, pos) AS rank FROM s WHERE score > 0)
WHERE rank <= 3"""


@register("suggest_roles_orders", _suggest_sql("orders", ORDERS_COLS))
def q_suggest_orders(spark, sf):
    from tablelens.operators import roles

    return roles.suggest_roles(table(spark, sf, "orders"))


@register("suggest_roles_dirty_events", _with(DIRTY_EVENTS_SQL).rstrip() + ",\n" + _suggest_sql("d", DIRTY_COLS)[5:])
def q_suggest_dirty(spark, sf):
    from tablelens.operators import roles

    return roles.suggest_roles(dirty_events(spark, sf))


def _infer_sql(source: str, cols: list[tuple[str, str]]) -> str:
    from tablelens.functions.constants import DATETIME_NAME_KEYS, ID_NAME_KEYS

    mono = []
    for c, t in cols:
        if t in ("bigint", "int"):
            # rows in the order of the table's key, its first column
            mono.append(
                f"SELECT '{c}' AS {_q('column')}, coalesce(bool_and(x >= px), true) AND count(*) = count(x) AS monotonic "
                f"FROM (SELECT {c} AS x, lag({c}) OVER (ORDER BY {cols[0][0]}) AS px FROM {source})"
            )
        else:
            mono.append(f"SELECT '{c}', false")
    names = ", ".join(
        f"('{c}', {str(any(k in c.lower() for k in DATETIME_NAME_KEYS)).lower()}, "
        f"{str(any(k in c.lower() for k in ID_NAME_KEYS)).lower()})"
        for c, _ in cols
    )
    return _with(
        _facts_sql(source, cols),
        "m AS (" + "\nUNION ALL ".join(mono) + ")",
        f"nm({_q('column')}, dt_name, id_name) AS (VALUES {names})",
    ) + """SELECT f."column", f.is_numeric,
       NOT f.is_numeric AND (f.dist <= greatest(50, floor(f.rows * 0.05)) OR f.is_string) AS is_categorical,
       nm.dt_name AND f.date_parses > 0 AS is_datetime,
       nm.id_name OR CAST(f.dist AS DOUBLE) / greatest(f.rows, 1) > 0.9 OR m.monotonic AS is_id_like
FROM f JOIN nm ON f."column" = nm."column" JOIN m ON f."column" = m."column\""""


@register("infer_columns_orders", _infer_sql("orders", ORDERS_COLS))
def q_infer_orders(spark, sf):
    from tablelens.operators import roles

    return roles.infer_columns(table(spark, sf, "orders"), order_by=ORDERS_COLS[0][0])


def _defaults_sql(source: str, cols: list[tuple[str, str]]) -> str:
    from tablelens.functions.constants import CATEGORY_PREFERENCE, TIMESTAMP_PREFERENCE

    numeric = [c for c, t in cols if t in _NUMERIC]
    var = "\nUNION ALL ".join(
        f"SELECT '{c}' AS {_q('column')}, var_pop(CAST({c} AS DOUBLE)) AS vp FROM {source}" for c in numeric
    ) or f"SELECT CAST(NULL AS VARCHAR) AS {_q('column')}, CAST(NULL AS DOUBLE) AS vp"
    pos = ", ".join(f"('{c}', {i})" for i, (c, _) in enumerate(cols))

    def pref(names):
        return "CASE " + " ".join(f"WHEN i.\"column\" = '{n}' THEN {k}" for k, n in enumerate(names)) + " ELSE 99 END"

    return _with(
        "info AS (" + _infer_sql(source, cols) + ")",
        "v AS (" + var + ")",
        f"pos({_q('column')}, pos) AS (VALUES {pos})",
        "i AS (SELECT info.*, v.vp, pos.pos FROM info JOIN pos ON info.\"column\" = pos.\"column\" "
        "LEFT JOIN v ON info.\"column\" = v.\"column\")",
    ) + f"""SELECT 'numeric' AS kind, coalesce(
    (SELECT "column" FROM i WHERE is_numeric AND "column" = 'value'),
    (SELECT "column" FROM i WHERE is_numeric AND NOT is_id_like AND vp IS NOT NULL ORDER BY vp DESC, pos LIMIT 1),
    (SELECT "column" FROM i WHERE is_numeric ORDER BY pos LIMIT 1)) AS "column"
UNION ALL SELECT 'category', (SELECT "column" FROM i WHERE is_categorical ORDER BY {pref(CATEGORY_PREFERENCE)}, pos LIMIT 1)
UNION ALL SELECT 'timestamp', (SELECT "column" FROM i WHERE is_datetime ORDER BY {pref(TIMESTAMP_PREFERENCE)}, pos LIMIT 1)"""


@register("default_columns_orders", _defaults_sql("orders", ORDERS_COLS))
def q_defaults_orders(spark, sf):
    from tablelens.operators import roles

    return roles.default_columns(table(spark, sf, "orders"), order_by=ORDERS_COLS[0][0])


# --------------------------------------------------- more profile/quality ---

@register(
    "top_categories_dirty_events",
    _with(DIRTY_EVENTS_SQL)
    + "SELECT CAST(event_type AS VARCHAR) AS member, count(*) AS n FROM d "
    "GROUP BY 1 ORDER BY n DESC, member NULLS FIRST LIMIT 20",
)
def q_top_categories_dirty(spark, sf):
    return profile.top_categories(dirty_events(spark, sf), "event_type", 20)


@register(
    "histogram_dirty_events",
    _with(DIRTY_EVENTS_SQL)
    + """, x AS (SELECT value AS x FROM d WHERE value IS NOT NULL AND NOT isnan(value)),
b AS (SELECT min(x) AS a, max(x) AS b FROM x),
c AS (SELECT CAST(least(floor((x.x - b.a) / (b.b - b.a) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM x, b GROUP BY 1),
s AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20))
SELECT s.bin, round(b.a + s.bin * ((b.b - b.a) / 20), 6) AS lo, round(b.a + (s.bin + 1) * ((b.b - b.a) / 20), 6) AS hi,
       coalesce(c.n, 0) AS n
FROM s CROSS JOIN b LEFT JOIN c ON s.bin = c.bin""",
)
def q_histogram_dirty(spark, sf):
    return _round(profile.histogram(dirty_events(spark, sf), "value", 20), {"lo": 6, "hi": 6})


@register(
    "timeseries_count_d_dirty_events",
    _with(DIRTY_EVENTS_SQL).rstrip() + ",\n"
    + _period_sql("CAST(ts AS DATE)", "1 DAY", "value", "d", "ts")
    + "\nSELECT CAST(period AS TIMESTAMP) AS period, CAST(n AS DOUBLE) AS value FROM p",
)
def q_series_dirty(spark, sf):
    return timeseries.timeseries(dirty_events(spark, sf), "ts", "value", None, "count", "D")


@register(
    "timeseries_avg_d_dirty_events",
    _with(DIRTY_EVENTS_SQL).rstrip() + ",\n"
    + _period_sql("CAST(ts AS DATE)", "1 DAY", "value", "d", "ts")
    + "\nSELECT CAST(period AS TIMESTAMP) AS period, round(mean, 6) AS value FROM p",
)
def q_series_avg_dirty(spark, sf):
    return _round(timeseries.timeseries(dirty_events(spark, sf), "ts", "value", None, "avg", "D"), {"value": 6})


@register(
    "validation_actions_dirty_events",
    _with(
        DIRTY_EVENTS_SQL,
        "ex AS (SELECT count(*) AS k FROM (SELECT DISTINCT user_id, ts, event_type, value FROM d))",
        "n AS (SELECT count(*) AS n FROM d)",
        "s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd, avg(CAST(user_id AS DOUBLE)) AS umu, "
        "stddev_pop(CAST(user_id AS DOUBLE)) AS usd FROM d)",
        "o AS (SELECT (SELECT count(*) FROM d, s WHERE sd > 0 AND abs((value - mu) / sd) > 4) AS vo, "
        "(SELECT count(*) FROM d, s WHERE usd > 0 AND abs((user_id - umu) / usd) > 4) AS uo)",
        "m AS (" + _missingness_sql("d", DIRTY_COLS) + ")",
    )
    + """SELECT 'confirm_timestamp' AS code, 'check zone and granularity of ts' AS detail
UNION ALL SELECT 'drop_exact_duplicates', 'exact duplicate rows: ' || CAST(n.n - ex.k AS VARCHAR) FROM n, ex WHERE n.n - ex.k > 0
UNION ALL SELECT 'winsorize_outliers', 'columns with outliers: ' || CAST(CAST(vo > 0 AS INTEGER) + CAST(uo > 0 AS INTEGER) AS VARCHAR)
  FROM o WHERE vo > 0 OR uo > 0
UNION ALL SELECT 'impute_heavy_missing', 'max missing pct: ' || CAST(max(missing_pct) AS VARCHAR) FROM m HAVING max(missing_pct) > 20""",
)
def q_actions(spark, sf):
    from tablelens.plans.flows import validate

    return validate(dirty_events(spark, sf))["actions"]


@register(
    "parse_report_events",
    "SELECT 'ts' AS \"column\", 'timestamp_ntz' AS from_type, 'timestamp_ntz' AS to_type, "
    "count(*) FILTER (WHERE ts IS NULL) AS missing_after FROM events",
)
def q_parse_report(spark, sf):
    from tablelens.operators import columns

    return columns.parse_report(table(spark, sf, "events"), "ts")


@register(
    "business_casts_sales",
    _with(SALES_SQL) + "SELECT CAST(order_id AS BIGINT) AS order_id, entity_id, event_ts, CAST(value AS DOUBLE) AS value, category, state FROM sales",
)
def q_business_casts(spark, sf):
    return cleaning.business_casts(sales(spark, sf))


@register("normalize_columns_customer", "SELECT * FROM customer")
def q_normalize(spark, sf):
    from tablelens.operators import columns

    return columns.normalize_columns(table(spark, sf, "customer"))


def _diff_stage(stage: str, src: str, types: dict[str, str]) -> str:
    miss = "\nUNION ALL ".join(
        f"SELECT '{stage}', 'missing_ratio', '{c}', round_even(CAST({_missing_expr(c, types[c])} AS DOUBLE) / count(*), 4), "
        f"'{types[c]}' FROM {src}"
        for c, _ in DIRTY_COLS
    )
    return (
        f"SELECT '{stage}' AS stage, 'rows' AS metric, CAST(NULL AS VARCHAR) AS \"column\", CAST(count(*) AS DOUBLE) AS value, "
        f"CAST(NULL AS VARCHAR) AS detail FROM {src}\nUNION ALL {miss}\n"
        f"UNION ALL SELECT '{stage}', 'dup_exact_ratio', NULL, "
        f"CAST((SELECT count(*) FROM {src}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS DOUBLE) / (SELECT count(*) FROM {src}), NULL\n"
        f"UNION ALL SELECT '{stage}', 'dup_pair_ratio', NULL, "
        f"CAST((SELECT count(*) FROM {src}) - (SELECT count(*) FROM (SELECT DISTINCT user_id, ts FROM {src})) AS DOUBLE) / (SELECT count(*) FROM {src}), NULL"
    )


@register(
    "quality_diff_dirty_events",
    _with(DIRTY_EVENTS_SQL, *_CLEAN_CTES)
    + _diff_stage("raw", "d", dict(DIRTY_COLS))
    + "\nUNION ALL "
    + _diff_stage("cleaned", "c", {"user_id": "double", "ts": "timestamp_ntz", "event_type": "string", "value": "double"}),
)
def q_quality_diff(spark, sf):
    raw = dirty_events(spark, sf)
    cleaned, _ = cleaning.clean(raw, id_col="user_id", ts_col="ts")
    return quality.quality_diff(raw, cleaned, "user_id", "ts")


# ----------------------------------------------------- end to end, ML ---

_SALES_WEEKLY_RANKED = (
    _with(SALES_SQL).rstrip() + ",\n"
    + _period_sql("CAST(date_trunc('week', event_ts) AS DATE) + 6", "7 DAY", "value", "sales", "event_ts")
    + ",\nr AS (SELECT period AS week, CAST(n AS DOUBLE) AS cnt, total AS val, "
    "row_number() OVER (ORDER BY period DESC) AS rn, count(*) OVER () AS k FROM p)"
)
_TAKEAWAYS_SQL = (
    _SALES_WEEKLY_RANKED
    + ",\nch AS (" + "\nUNION ALL ".join(
        f"SELECT '{m}' AS metric, CASE WHEN sum({c}) FILTER (WHERE rn > 4 AND rn <= 8) <> 0 THEN "
        f"(sum({c}) FILTER (WHERE rn <= 4) - sum({c}) FILTER (WHERE rn > 4 AND rn <= 8)) "
        f"/ sum({c}) FILTER (WHERE rn > 4 AND rn <= 8) * 100.0 END AS pct_change FROM r HAVING count(*) >= 8"
        for m, c in (("count", "cnt"), ("value", "val"))
    ) + ")"
    + """,
m AS (SELECT max(event_ts) AS hi FROM sales),
rs AS (SELECT sales.* FROM sales, m WHERE sales.event_ts BETWEEN m.hi - INTERVAL 28 DAY AND m.hi),
u AS (SELECT 'category' AS dimension, CAST(category AS VARCHAR) AS member, value AS v FROM rs
      UNION ALL SELECT 'state', CAST(state AS VARCHAR), value FROM rs),
g AS (SELECT dimension, member, CAST(sum(coalesce(v, 0)) AS DOUBLE) AS value FROM u WHERE member IS NOT NULL GROUP BY 1, 2),
drv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY value DESC, member) AS rn FROM g) WHERE rn <= 10),
mv AS (SELECT CASE WHEN metric = 'value' THEN 1 ELSE 2 END AS o, metric || '_move' AS kind,
              CASE WHEN pct_change >= 0 THEN 'up' ELSE 'down' END AS direction, abs(pct_change) AS pct,
              CAST(NULL AS VARCHAR) AS dimension, CAST(NULL AS VARCHAR) AS member FROM ch WHERE pct_change IS NOT NULL),
td AS (SELECT 3 AS o, 'top_driver' AS kind, CAST(NULL AS VARCHAR) AS direction, CAST(NULL AS DOUBLE) AS pct, dimension, member
       FROM drv ORDER BY value DESC, dimension DESC, member DESC LIMIT 1),
found AS (SELECT * FROM mv UNION ALL SELECT * FROM td),
allr AS (SELECT * FROM found
         UNION ALL SELECT 4, 'generic', NULL, NULL, NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM found))
SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS rank, kind, direction, round(pct, 6) AS pct, dimension, member
FROM allr QUALIFY rank <= 3"""
)


@register("takeaways_sales", _TAKEAWAYS_SQL)
def q_takeaways(spark, sf):
    s = sales(spark, sf)
    k = insight.kpis(s, "event_ts", "value")
    return _round(insight.takeaways(k["period_change"], insight.top_drivers(s, "event_ts", "value")), {"pct": 6})


@register("regression_metrics_lineitem")
def q_regression(spark, sf):
    from tablelens.operators import ml

    return ml.train_value_regressor(table(spark, sf, "lineitem"))["metrics"]


# ------------------------------------------------ other provided tables ---

EMBEDDINGS_COLS = [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")]
LABELS_COLS = [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")]


@register("missingness_embeddings", _missingness_sql("embeddings", EMBEDDINGS_COLS))
def q_missingness_embeddings(spark, sf):
    return profile.missingness(table(spark, sf, "embeddings"))


@register("column_profile_embeddings", _profile_sql("embeddings", EMBEDDINGS_COLS, ("embedding",)))
def q_profile_embeddings(spark, sf):
    """The vectors' samples are left out: engines write floats differently."""
    found = profile.column_profile(table(spark, sf, "embeddings"))
    return found.withColumn("sample_values", F.when(F.col("column") != "embedding", F.col("sample_values")))


@register("column_profile_labels", _profile_sql("labels", LABELS_COLS))
def q_profile_labels(spark, sf):
    return profile.column_profile(table(spark, sf, "labels"))


@register(
    "duplicate_counts_documents",
    "SELECT 'exact' AS \"check\", count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) "
    "AS duplicates, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) AS DOUBLE) / count(*) "
    "AS ratio FROM documents",
)
def q_duplicates_documents(spark, sf):
    return profile.duplicate_counts(table(spark, sf, "documents"))


@register("pii_scan_benchmark", _pii_sql("benchmark", ["item_id", "text"]))
def q_pii_benchmark(spark, sf):
    return quality.pii_scan(table(spark, sf, "benchmark"))


SALES_COLS = [
    ("order_id", "bigint"), ("entity_id", "bigint"), ("event_ts", "timestamp_ntz"),
    ("value", "decimal(18,2)"), ("category", "string"), ("state", "string"),
]
SALES_ROLES = {"entity_id": "entity_id", "event_ts": "event_ts", "value": "value", "category": "category",
               "state": "state", "order_id": "order_id"}


@register(
    "schema_report_sales",
    _with(SALES_SQL)
    + "\nUNION ALL ".join(
        f"SELECT '{c}' AS {_q('column')}, '{t}' AS dtype, '{SALES_ROLES[c]}' AS role, "
        f"array_to_string((SELECT list(CAST(v AS VARCHAR) ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM sales "
        f"WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)), '|') AS examples"
        for c, t in SALES_COLS
    ),
)
def q_schema_report(spark, sf):
    from tablelens.sources.writers import schema_report

    return schema_report(sales(spark, sf), SALES_ROLES)


@register(
    "column_profile_sales",
    _with(SALES_SQL) + _profile_sql("sales", SALES_COLS),
)
def q_column_profile_sales(spark, sf):
    return profile.column_profile(sales(spark, sf))


_ORDERS_AS_OF = "2001-09-01 00:00:00"


@register(
    "quality_checks_staleness_orders",
    _with(
        "ex AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM orders))",
        "pr AS (SELECT count(*) AS k FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders))",
        "n AS (SELECT count(*) AS n, max(o_orderdate) AS latest FROM orders)",
    )
    + f"""SELECT 'dup_exact' AS "check", CAST(NULL AS VARCHAR) AS "column", CAST(n.n - ex.k AS DOUBLE) / n.n AS observed,
       CAST(0.05 AS DOUBLE) AS threshold, coalesce(CAST(n.n - ex.k AS DOUBLE) / n.n <= 0.05, false) AS passed FROM n, ex
UNION ALL SELECT 'dup_pair', NULL, CAST(n.n - pr.k AS DOUBLE) / n.n, 0.02, coalesce(CAST(n.n - pr.k AS DOUBLE) / n.n <= 0.02, false) FROM n, pr
UNION ALL """
    + "\nUNION ALL ".join(
        f"SELECT 'missing', '{c}', CAST({_missing_expr(c, t)} AS DOUBLE) / count(*), 0.2, "
        f"coalesce(NOT (CAST({_missing_expr(c, t)} AS DOUBLE) / count(*) > 0.2), true) FROM orders"
        for c, t in ORDERS_COLS
    )
    + f"""
UNION ALL SELECT 'staleness', 'o_orderdate',
       CAST(floor((epoch_us(TIMESTAMP '{_ORDERS_AS_OF}') - epoch_us(latest)) / 86400000000.0) AS DOUBLE), 30.0,
       floor((epoch_us(TIMESTAMP '{_ORDERS_AS_OF}') - epoch_us(latest)) / 86400000000.0) <= 30 FROM n""",
)
def q_quality_staleness(spark, sf):
    import datetime as _dt

    return quality.quality_checks(
        table(spark, sf, "orders"), id_col="o_custkey", ts_col="o_orderdate",
        max_staleness_days=30, as_of=_dt.datetime.fromisoformat(_ORDERS_AS_OF),
    )
