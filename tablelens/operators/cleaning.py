"""Cleaning operators: trimming, de-duplication, winsorizing, imputation and
the composed `clean` step.

Scale notes
* De-duplication is a hash aggregate (exact) or a `min(struct)` aggregate per
  (id, ts) key (keep-first). Both have map-side partial aggregation, so one key
  holding a third of the table collapses inside the map tasks; no window ever
  sorts a whole hot group in one task.
* Bounds, medians and modes are computed once on a checkpointed copy of the
  de-duplicated frame (lineage cut in the shared checkpoint folder), then
  applied as literals in one narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.constants import FILL_TEXT, WINSOR_LOWER_Q, WINSOR_UPPER_Q
from tablelens.functions.expressions import (
    INTEGRAL_TYPES,
    is_numeric_type,
    to_number,
    trim_ws,
)
from tablelens.functions.names import quote
from tablelens.operators.stats import interpolate, modes, order_statistics, quantiles, stats_columns
from tablelens.session import materialize

REPORT_SCHEMA = "step string, column string, affected bigint, detail string"


def _report(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def _plain(dt: T.DataType) -> bool:
    return not isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


# -------------------------------------------------------------------- P9 --

def trim_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Strip Unicode whitespace at both ends of string columns; null stays null."""
    targets = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
    }
    return df.select(
        *[trim_ws(F.col(quote(c))).alias(c) if c in targets else F.col(quote(c)) for c in df.columns]
    )


# -------------------------------------------------------------------- W3 --

def drop_duplicates(
    df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None
) -> DataFrame:
    """Keep one row per identical row (no `subset`) or per `subset` key.

    With a key, the row kept is the first by `order_by` (default: the other
    columns in their order), ascending with nulls first. Nulls in the key
    compare equal. The result keeps the input column order.
    """
    if not subset:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c not in subset]
    order = [c for c in (order_by or rest) if c in rest]
    tail = [c for c in rest if c not in order]
    if not rest:
        return df.dropDuplicates(subset)
    names = {c: f"_o{i}" for i, c in enumerate(order)}
    names.update({c: f"_t{i}" for i, c in enumerate(tail)})
    packed = F.struct(*[F.col(quote(c)).alias(names[c]) for c in order + tail])
    kept = df.groupBy(*[F.col(quote(c)) for c in subset]).agg(F.min(packed).alias("_kept"))
    return kept.select(
        *[F.col(quote(c)) if c in subset else F.col(f"_kept.{names[c]}").alias(c) for c in df.columns]
    )


# -------------------------------------------------------------------- C1 --

#: Integers beyond this are not all doubles; such columns are clipped as decimals.
_EXACT_DOUBLE = 1 << 53
_WIDE = "decimal(38,6)"


def _clip(c: Column, lo, hi, wide: bool = False) -> Column:
    x = c.cast("double")
    kind = _WIDE if wide else "double"
    out = c.cast(kind)
    if lo is not None:
        out = F.when(x < F.lit(lo), F.lit(lo).cast(kind)).otherwise(out)
    if hi is not None:
        out = F.when(x > F.lit(hi), F.lit(hi).cast(kind)).otherwise(out)
    return out


def winsorize_bounds(
    df: DataFrame,
    columns: list[str],
    lower_q: float | None = WINSOR_LOWER_Q,
    upper_q: float | None = WINSOR_UPPER_Q,
    accuracy: int | None = None,
) -> dict[str, tuple[float | None, float | None]]:
    probs = {}
    for c in columns:
        probs[c] = [q for q in (lower_q, upper_q) if q is not None]
    q = quantiles(df, probs, accuracy)
    out = {}
    for c in columns:
        vals = list(q.get(c, []))
        lo = vals.pop(0) if lower_q is not None and vals else None
        hi = vals.pop(0) if upper_q is not None and vals else None
        out[c] = (lo, hi)
    return out


def winsorize(
    df: DataFrame,
    columns: list[str] | None = None,
    lower_q: float | None = WINSOR_LOWER_Q,
    upper_q: float | None = WINSOR_UPPER_Q,
    exclude: list[str] | tuple = (),
    accuracy: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Clip numeric columns (ids too, unless excluded) to [q_lower, q_upper].

    Returns (frame, report) where report rows are
    ('winsorize', column, values outside the bounds, 'lo=…, hi=…') for
    columns with at least one capped value. Clipped columns become double, or decimal when
    they hold integers that doubles would merge (beyond 2^53); values inside the bounds
    stay exact.
    """
    cols = columns if columns is not None else [
        f.name for f in df.schema.fields if is_numeric_type(f.dataType)
    ]
    cols = [c for c in cols if c not in set(exclude)]
    spark = df.sparkSession
    if not cols:
        return df, _report(spark, [])
    return _winsorized(df, winsorize_bounds(df, cols, lower_q, upper_q, accuracy))


def _winsorized(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> tuple[DataFrame, DataFrame]:
    """The clipped frame and its report, from known bounds: one aggregate."""
    outside = []
    for i, (c, (lo, hi)) in enumerate(bounds.items()):
        x = F.col(quote(c)).cast("double")
        cond = F.lit(False)
        if lo is not None:
            cond = cond | (x < F.lit(lo))
        if hi is not None:
            cond = cond | (x > F.lit(hi))
        outside.append(F.count_if(cond).alias(f"k{i}"))
        if isinstance(df.schema[c].dataType, INTEGRAL_TYPES):
            # no abs(): the smallest bigint has none
            outside.append(F.greatest(F.max(quote(c)), -1 - F.min(quote(c))).alias(f"w{i}"))
    counts = df.agg(*outside).first()
    rows, wide = [], set()
    for i, (c, (lo, hi)) in enumerate(bounds.items()):
        if f"w{i}" in counts and (counts[f"w{i}"] or 0) > _EXACT_DOUBLE:
            wide.add(c)
        if counts[f"k{i}"]:
            rows.append(("winsorize", c, int(counts[f"k{i}"]), f"lo={lo!r}, hi={hi!r}"))
    out = df.select(
        *[_clip(F.col(quote(c)), *bounds[c], wide=c in wide).alias(c) if c in bounds else F.col(quote(c)) for c in df.columns]
    )
    return out, _report(df.sparkSession, rows)


# ---------------------------------------------------------------- C2 / C3 --

def impute_numeric(
    df: DataFrame, columns: list[str] | None = None, accuracy: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fill missing numeric values with the column median (exact by default)."""
    cols = columns if columns is not None else [
        f.name for f in df.schema.fields if is_numeric_type(f.dataType)
    ]
    spark = df.sparkSession
    if not cols:
        return df, _report(spark, [])
    # one pass: row count plus count / min / max per column; the missing
    # counts and the first step of the exact medians both come from it
    head = df.agg(F.count(F.lit(1)).alias("rows"), *stats_columns(cols)).first()
    missing = {f"m{i}": head["rows"] - head[f"n{i}"] for i in range(len(cols))}
    need = [c for i, c in enumerate(cols) if missing[f"m{i}"]]
    known = {c: (head[f"n{i}"], head[f"a{i}"], head[f"b{i}"]) for i, c in enumerate(cols)}
    med = quantiles(df, {c: [0.5] for c in need}, accuracy, stats=known)
    fills = {c: med[c][0] for c in need if med[c][0] is not None}
    return _filled_numeric(df, fills, {c: int(missing[f"m{cols.index(c)}"]) for c in fills})


def _filled_numeric(df: DataFrame, fills: dict[str, float], missing: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    rows = [("impute_numeric", c, missing[c], f"median {value!r}") for c, value in fills.items()]
    out = df.select(*[_fill_numeric(df, c, fills[c]) if c in fills else F.col(quote(c)) for c in df.columns])
    return out, _report(df.sparkSession, rows)


def _fill_numeric(df: DataFrame, c: str, value: float) -> Column:
    dt = df.schema[c].dataType
    col = F.col(quote(c))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        col = F.nanvl(col, F.lit(None).cast(dt))
        return F.coalesce(col, F.lit(value).cast(dt)).alias(c)
    if isinstance(dt, INTEGRAL_TYPES) and float(value) != int(value):
        # a fractional median turns the column into double, as a float fill would
        return F.coalesce(col.cast("double"), F.lit(value)).alias(c)
    return F.coalesce(col, F.lit(value).cast(dt)).alias(c)


def impute_categorical(
    df: DataFrame, columns: list[str] | None = None, fill_text: str = FILL_TEXT
) -> tuple[DataFrame, DataFrame]:
    """Fill missing values of non-numeric columns with the column mode (ties:
    smallest value); a string column with no value at all gets `fill_text`."""
    cols = columns if columns is not None else [
        f.name for f in df.schema.fields
        if not is_numeric_type(f.dataType) and _plain(f.dataType)
    ]
    spark = df.sparkSession
    if not cols:
        return df, _report(spark, [])
    found = df.agg(*[F.count_if(F.col(quote(c)).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return _filled_categorical(df, {c: found[f"m{i}"] for i, c in enumerate(cols) if found[f"m{i}"]}, fill_text)


def _filled_categorical(df: DataFrame, missing: dict[str, int], fill_text: str) -> tuple[DataFrame, DataFrame]:
    need = list(missing)
    mode = modes(df, need)
    fills = {}
    for c in need:
        value = mode.get(c)
        if value is None and isinstance(df.schema[c].dataType, T.StringType):
            value = fill_text
        if value is not None:
            fills[c] = value
    rows = [("impute_categorical", c, int(missing[c]), f"fill {fills[c]!s}") for c in need if c in fills]
    out = df.select(
        *[
            F.coalesce(F.col(quote(c)), F.lit(fills[c]).cast(df.schema[c].dataType)).alias(c)
            if c in fills else F.col(quote(c))
            for c in df.columns
        ]
    )
    return out, _report(df.sparkSession, rows)


# -------------------------------------------------------------------- C4 --

def clean(
    df: DataFrame,
    *,
    id_col: str | None = None,
    ts_col: str | None = None,
    drop_exact_dups: bool = True,
    drop_pair_dups: bool = True,
    trim: bool = True,
    winsorize_numeric: bool = True,
    upper_q: float = WINSOR_UPPER_Q,
    lower_q: float | None = WINSOR_LOWER_Q,
    exclude: list[str] | tuple = (),
    impute_num: bool = True,
    impute_cat: bool = True,
    fill_text: str = FILL_TEXT,
    order_by: list[str] | None = None,
    accuracy: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """trim → exact duplicates → (id, ts) duplicates → winsorize → numeric
    median → categorical mode. Returns (clean frame, report(step, column,
    affected, detail))."""
    spark = df.sparkSession
    rows: list[tuple] = []
    work = df
    if trim:
        strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        work = trim_strings(work)
        rows.append(("trim", None, len(strings), "string columns trimmed"))
    pair = bool(drop_pair_dups and id_col and ts_col and id_col in work.columns and ts_col in work.columns)
    if drop_exact_dups and pair:
        # The keep-first pair step also removes every exact copy, so the exact
        # count is only measured (rows and distinct rows in one aggregate),
        # and the frame is de-duplicated once.
        from tablelens.operators.profile import exact_row_counts

        sizes = exact_row_counts(work).first()
        n0, n1 = int(sizes["rows"]), int(sizes["distinct_rows"])
        rows.append(("drop_exact_duplicates", None, n0 - n1, "exact duplicate rows dropped"))
    elif drop_exact_dups:
        n0 = df.count()
        work = materialize(drop_duplicates(work))
        n1 = work.count()
        rows.append(("drop_exact_duplicates", None, n0 - n1, "exact duplicate rows dropped"))
    else:
        n0 = n1 = df.count()
    if pair:
        work = materialize(drop_duplicates(work, [id_col, ts_col], order_by))
    elif not drop_exact_dups:
        work = materialize(work)
    numeric = [f.name for f in work.schema.fields if is_numeric_type(f.dataType)]
    plain = [f.name for f in work.schema.fields if not is_numeric_type(f.dataType) and _plain(f.dataType)]
    # one pass over the de-duplicated rows: their number, count / min / max of every number,
    # and the gaps of the other columns; clipping changes none of the gaps
    head = work.agg(
        F.count(F.lit(1)).alias("rows"),
        *stats_columns(numeric),
        *[F.count_if(F.col(quote(c)).isNull()).alias(f"m{i}") for i, c in enumerate(plain)],
    ).first()
    if pair:
        rows.append(("drop_pair_duplicates", f"{id_col},{ts_col}", n1 - head["rows"], "keep first per (id, ts)"))
    elif drop_pair_dups:
        rows.append(("drop_pair_duplicates", None, 0, "skipped: id or ts column not given"))
    reports = [_report(spark, rows)]
    known = {c: (head[f"n{i}"], head[f"a{i}"], head[f"b{i}"]) for i, c in enumerate(numeric)}
    clipped = [c for c in numeric if c not in set(exclude)] if winsorize_numeric else []
    gaps = {c: head["rows"] - known[c][0] for c in numeric if known[c][0] < head["rows"]} if impute_num else {}
    # the clipping bounds and the medians come from one set of quantile passes: clipping
    # keeps the order, so the median of the clipped values follows from the same two values
    asked = [q for q in (lower_q, upper_q) if q is not None]
    probs = {c: (asked if c in clipped else []) + ([0.5] if c in gaps else []) for c in numeric}
    ends = _ends(work, {c: p for c, p in probs.items() if p}, known, accuracy)
    bounds: dict[str, tuple[float | None, float | None]] = {}
    for c in clipped:
        values = [None if e is None else interpolate(*e) for e in ends.get(c, [None, None])]
        bounds[c] = (values[0] if lower_q is not None else None, values[len(asked) - 1] if upper_q is not None else None)
    medians = {}
    for c in gaps:
        if ends[c][-1] is not None:
            a, b, share = ends[c][-1]
            lo, hi = bounds.get(c, (None, None))
            medians[c] = interpolate(_within(a, lo, hi), _within(b, lo, hi), share)
    if bounds:
        work, rep = _winsorized(work, bounds)
        reports.append(rep)
    if impute_num:
        work, rep = _filled_numeric(work, medians, {c: int(n) for c, n in gaps.items()})
        reports.append(rep)
    if impute_cat:
        work, rep = _filled_categorical(work, {c: head[f"m{i}"] for i, c in enumerate(plain) if head[f"m{i}"]}, fill_text)
        reports.append(rep)
    reports.append(_report(spark, [("rows", None, head["rows"], f"rows before {n0}, after {head['rows']}")]))
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    return work, report


def _within(x: float, lo: float | None, hi: float | None) -> float:
    x = lo if lo is not None and x < lo else x
    return hi if hi is not None and x > hi else x


def _ends(df: DataFrame, probs: dict[str, list[float]], known: dict[str, tuple], accuracy: int | None) -> dict[str, list]:
    """The values beside each quantile; a sketch (`accuracy`) gives one value for both."""
    if not accuracy:
        return order_statistics(df, probs, stats=known)
    return {c: [None if v is None else (v, v, 0.0) for v in found] for c, found in quantiles(df, probs, accuracy).items()}


# -------------------------------------------------------------------- C5 --

def clean_fallback(
    df: DataFrame,
    *,
    id_col: str | None = None,
    ts_col: str | None = None,
    upper_q: float = WINSOR_UPPER_Q,
    fill_text: str = FILL_TEXT,
    order_by: list[str] | None = None,
) -> DataFrame:
    """Simpler order: trim → (id, ts) or exact de-dup → median / mode fill →
    cap above the upper quantile only."""
    work = trim_strings(df)
    if id_col and ts_col and id_col in work.columns and ts_col in work.columns:
        from tablelens.functions.expressions import to_timestamp

        work = work.withColumn(ts_col, to_timestamp(F.col(quote(ts_col)), work.schema[ts_col].dataType))
        work = drop_duplicates(work, [id_col, ts_col], order_by)
    else:
        work = drop_duplicates(work)
    work = materialize(work)
    work, _ = impute_numeric(work)
    work, _ = impute_categorical(work, fill_text=fill_text)
    work, _ = winsorize(work, lower_q=None, upper_q=upper_q)
    return work


# -------------------------------------------------------------------- P8 --

def business_casts(df: DataFrame) -> DataFrame:
    """`order_id` -> bigint (±inf and non-numbers null); integral columns stay as they are,
    numbers with a fraction stay numbers; of texts, when some carry a fraction, the digits
    are kept. `review_score` -> rounded (half-even) bigint; integral columns keep their value."""
    out = df
    if "order_id" in df.columns and not isinstance(df.schema["order_id"].dataType, INTEGRAL_TYPES):
        dt = df.schema["order_id"].dataType
        c = F.col("order_id")
        x = to_number(c, dt)
        x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        fractional = df.agg(F.max((x != F.floor(x)).cast("int")).alias("f")).first()["f"]
        if isinstance(dt, T.StringType):
            # integer texts are read as such: a double would merge large ids
            whole = F.coalesce(F.trim(c).try_cast("bigint"), x.cast("bigint"))
            digits = F.regexp_replace(F.trim(c), r"\D+", "")
            out = out.withColumn("order_id", F.when(digits != "", digits) if fractional else F.when(x.isNotNull(), whole))
        elif not fractional:
            out = out.withColumn("order_id", F.when(x.isNotNull(), c.cast("decimal(38,0)")).cast("bigint") if isinstance(dt, T.DecimalType) else x.cast("bigint"))
    if "review_score" in df.columns:
        dt = df.schema["review_score"].dataType
        x = to_number(F.col("review_score"), dt)
        x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        rounded = F.col("review_score") if isinstance(dt, INTEGRAL_TYPES) else F.bround(x, 0)
        out = out.withColumn("review_score", rounded.cast("bigint"))
    return out
