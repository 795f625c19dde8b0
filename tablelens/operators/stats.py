"""Distributed statistics with bounded memory.

* `exact_quantiles` — exact linear-interpolated quantiles without ever holding
  a column's distinct values in one task or on the driver. Each round is one
  aggregate that histograms the values inside the current bracket of every
  wanted rank; the bracket then shrinks to the (exact) min/max of the bucket
  holding the rank. Buckets have equal widths first; a bracket that shrinks too
  little (values over many orders of magnitude) gets buckets of equal ratios.
  What is left is decided in Spark: values inside the brackets are counted,
  range-partitioned and cumulated, and only the values at the wanted ranks come
  back. The driver sees at most `_DRIVER_ROWS` bucket counts a round, for all
  columns together, and one value per wanted rank.
* `per_column_counts` — one shuffle that counts every (column, value) pair for
  many columns at once, i.e. the `Expand` Catalyst would build for several
  DISTINCT aggregates, with map-side partial aggregation so a hot value
  collapses before the shuffle.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.session import materialize
from tablelens.functions.names import quote

_BUCKETS = 4096
# bucket counts of all brackets that one round may bring to the driver
_DRIVER_ROWS = 1 << 16
# values in all brackets together that are ranked without range partitions
_MAX_CANDIDATES = 100_000
_MIN_SHRINK = 64
_MAX_ROUNDS = 6
_MAX_GROUPING_SET_COLUMNS = 60
_SHORT_TYPES = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                T.DateType, T.TimestampType, T.TimestampNTZType)
_WIDTH, _RATIO, _STUCK = range(3)


def _num(name: str) -> Column:
    v = F.col(quote(name)).cast("double")
    return F.nanvl(v, F.lit(None).cast("double"))


class _Bracket:
    """The values [lo, hi] that hold a wanted rank: `below` smaller ones, `inside` in it."""

    def __init__(self, lo: float, hi: float, inside: int):
        self.lo, self.hi, self.below, self.inside, self.scale = lo, hi, 0, inside, _WIDTH

    @property
    def done(self) -> bool:
        return self.lo == self.hi

    def interval(self, column: str) -> tuple:
        return column, self.lo, self.hi, self.scale


def exact_quantiles(
    df: DataFrame,
    probs: dict[str, list[float]],
    *,
    max_candidates: int = _MAX_CANDIDATES,
    buckets: int = _BUCKETS,
    stats: dict[str, tuple] | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation between order statistics).

    `probs` maps column -> probabilities. Nulls and NaN are ignored. Returns
    column -> list of values aligned with `probs[column]` (None when empty).
    `stats` may carry (count, min, max) per column from a pass the caller
    already ran, which saves the first scan.
    """
    found = order_statistics(df, probs, max_candidates=max_candidates, buckets=buckets, stats=stats)
    return {c: [None if e is None else interpolate(*e) for e in ends] for c, ends in found.items()}


def interpolate(a: float, b: float, share: float) -> float:
    return a if a == b else a + (b - a) * share


def order_statistics(
    df: DataFrame,
    probs: dict[str, list[float]],
    *,
    max_candidates: int = _MAX_CANDIDATES,
    buckets: int = _BUCKETS,
    stats: dict[str, tuple] | None = None,
) -> dict[str, list[tuple[float, float, float] | None]]:
    """For every probability the two neighbouring values and the share between them, of which
    `interpolate` makes the quantile (so that a caller may clip the values first)."""
    cols = [c for c in probs if probs[c]]
    if not cols:
        return {}
    if stats is None or any(c not in stats for c in cols):
        row = df.agg(*stats_columns(cols)).first()
        stats = {c: (row[f"n{i}"], row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols)}

    plan: dict[str, list[tuple[int, int, float] | None]] = {c: [] for c in cols}
    ranks: dict[tuple[str, int], _Bracket] = {}
    for c in cols:
        n, least, most = stats[c]
        for p in probs[c]:
            if n == 0:
                plan[c].append(None)
                continue
            at = (n - 1) * float(p)
            plan[c].append((math.floor(at), math.ceil(at), at - math.floor(at)))
            for r in (math.floor(at), math.ceil(at)):
                ranks.setdefault((c, r), _Bracket(least, most, n))

    for _ in range(_MAX_ROUNDS):
        left = {k: b for k, b in ranks.items() if not b.done}
        sizes = {b.interval(k[0]): b.inside for k, b in left.items()}
        if sum(sizes.values()) <= max_candidates:
            break
        left = {k: b for k, b in left.items() if b.scale != _STUCK and b.inside * len(sizes) > max_candidates}
        if not left:
            break
        _narrow(df, left, buckets)

    _select(df, {k: b for k, b in ranks.items() if not b.done}, max_candidates)
    return {c: [p and (ranks[c, p[0]].lo, ranks[c, p[1]].lo, p[2]) for p in plan[c]] for c in cols}


def _narrow(df: DataFrame, left: dict[tuple[str, int], _Bracket], buckets: int) -> None:
    """One histogram round: every bracket shrinks to the bucket that holds its rank."""
    intervals = sorted({b.interval(c) for (c, _), b in left.items()}, key=repr)
    buckets = max(2, min(buckets, _DRIVER_ROWS // len(intervals)))
    index = {interval: j for j, interval in enumerate(intervals)}
    parts = []
    for j, (c, lo, hi, scale) in enumerate(intervals):
        v = _num(c)
        inside = F.struct(F.lit(j).alias("j"), _bucket(v, lo, hi, scale, buckets).alias("b"), v.alias("v"))
        parts.append(F.when(v.between(lo, hi), inside))
    hist: dict[int, list] = defaultdict(list)
    for row in (
        df.select(F.explode(F.array(*parts)).alias("s"))
        .where(F.col("s").isNotNull())
        .select("s.*")
        .groupBy("j", "b")
        .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .orderBy("j", "b")
        .collect()
    ):
        hist[row["j"]].append(row)
    for (c, r), bracket in left.items():
        endless = math.isinf(bracket.lo) or math.isinf(bracket.hi)
        before = bracket.inside
        for row in hist[index[bracket.interval(c)]]:
            if bracket.below + row["n"] > r:
                bracket.lo, bracket.hi, bracket.inside = row["lo"], row["hi"], row["n"]
                break
            bracket.below += row["n"]
        if not endless and bracket.inside * min(_MIN_SHRINK, buckets // 2) > before:
            bracket.scale += 1


def _bucket(v: Column, lo: float, hi: float, scale: int, buckets: int) -> Column:
    """A bucket number that never falls as v rises from lo to hi."""
    if math.isinf(lo) or math.isinf(hi):
        # infinite ends get buckets of their own; the finite middle bucket reports its
        # exact min/max, so the next round has a finite width
        return F.when(v == F.lit(lo), F.lit(0)).when(v == F.lit(hi), F.lit(2)).otherwise(F.lit(1))
    if scale == _RATIO:
        # signed binary logarithm, shifted beyond the smallest positive double
        def log(x):
            size = F.log2(F.abs(x)) + F.lit(1100.0)
            return F.when(x == 0, F.lit(0.0)).when(x > 0, size).otherwise(-size)

        x, a, b = log(v), _log(lo), _log(hi)
    else:  # halves, as hi - lo can be beyond the largest double
        x, a, b = v / 2, lo / 2, hi / 2
    if not b > a:
        return F.lit(0)
    place = F.floor((x - F.lit(a)) / F.lit(b - a) * F.lit(float(buckets)))
    return F.greatest(F.lit(0), F.least(place, F.lit(buckets - 1))).cast("int")


def _log(x: float) -> float:
    return 0.0 if x == 0 else math.copysign(math.log2(abs(x)) + 1100.0, x)


def _select(df: DataFrame, left: dict[tuple[str, int], _Bracket], max_candidates: int) -> None:
    """Finish in Spark: the values at the wanted ranks of the remaining brackets.

    Up to `max_candidates` values are ranked bracket by bracket. More are dealt over range
    partitions of (bracket, value): the counts per partition tell which partition holds a
    rank, and only those partitions are cumulated."""
    if not left:
        return
    intervals = sorted({(c, b.lo, b.hi) for (c, _), b in left.items()}, key=repr)
    index = {interval: j for j, interval in enumerate(intervals)}
    parts = []
    for j, (c, lo, hi) in enumerate(intervals):
        v = _num(c)
        parts.append(F.when(v.between(lo, hi), F.struct(F.lit(j).alias("j"), v.alias("v"))))
    values = (
        df.select(F.explode(F.array(*parts)).alias("s"))
        .where(F.col("s").isNotNull())
        .select("s.*")
        .groupBy("j", "v")
        .agg(F.count("*").alias("n"))
    )
    asked = [(index[c, b.lo, b.hi], r - b.below) for (c, r), b in left.items()]
    wanted = df.sparkSession.createDataFrame(asked, "j int, rank bigint")
    sizes = {(c, b.lo, b.hi): b.inside for (c, _), b in left.items()}
    key = ["j"]
    if sum(sizes.values()) > max_candidates:
        key = ["j", "part"]
        values = materialize(values.repartitionByRange("j", "v").withColumn("part", F.spark_partition_id()))
        earlier = Window.partitionBy("j").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = values.groupBy(*key).agg(F.sum("n").alias("m"))
        places = counts.withColumn("start", F.coalesce(F.sum("m").over(earlier), F.lit(0))).join(F.broadcast(wanted), "j")
        # one row per wanted rank: the partition that holds it
        wanted = places.where((F.col("start") <= F.col("rank")) & (F.col("rank") < F.col("start") + F.col("m"))).drop("m")
        values = values.join(F.broadcast(wanted.select(*key).distinct()), key, "left_semi")
    else:
        wanted = wanted.withColumn("start", F.lit(0))
    upto = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.col("rank") - F.col("start")
    found = (
        values.withColumn("upto", F.sum("n").over(upto))
        .join(F.broadcast(wanted), key)
        .where((at < F.col("upto")) & (at >= F.col("upto") - F.col("n")))
        .select("j", "rank", "v")
    )
    value = {(row["j"], row["rank"]): row["v"] for row in found.collect()}
    for (c, r), b in left.items():
        b.lo = b.hi = value[index[c, b.lo, b.hi], r - b.below]


def stats_columns(cols: list[str]) -> list:
    """count / min / max aggregates of the numeric reading of `cols`, named
    n{i} / a{i} / b{i} (the first pass of `exact_quantiles`)."""
    aggs = []
    for i, c in enumerate(cols):
        v = _num(c)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}")]
    return aggs


def approx_quantiles(
    df: DataFrame, probs: dict[str, list[float]], accuracy: int = 10_000
) -> dict[str, list[float | None]]:
    """Sketch-based quantiles (`percentile_approx`), one pass, fixed memory."""
    cols = [c for c in probs if probs[c]]
    if not cols:
        return {}
    row = df.agg(
        *[
            F.percentile_approx(_num(c), list(map(float, probs[c])), accuracy).alias(f"q{i}")
            for i, c in enumerate(cols)
        ]
    ).first()
    return {c: list(row[f"q{i}"]) if row[f"q{i}"] else [None] * len(probs[c]) for i, c in enumerate(cols)}


def quantiles(
    df: DataFrame, probs: dict[str, list[float]], accuracy: int | None = None,
    stats: dict[str, tuple] | None = None,
) -> dict[str, list[float | None]]:
    """Exact by default; `accuracy=` switches to the one-pass sketch."""
    if accuracy:
        return approx_quantiles(df, probs, accuracy)
    return exact_quantiles(df, probs, stats=stats)


def quantile_table(df: DataFrame, columns: list[str], probs: list[float], accuracy: int | None = None) -> DataFrame:
    """(column, prob, value): quantiles of each column, null without any value."""
    found = quantiles(df, {c: list(probs) for c in columns}, accuracy)
    rows = [(c, float(p), v) for c in columns for p, v in zip(probs, found[c])]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def per_column_counts(df: DataFrame, cols: list[str], include_nulls: bool = False) -> DataFrame:
    """(g, v0..vk-1, n): occurrences of each value of each column (non-null
    values only unless `include_nulls`, then null is one more group).

    Row g carries the value of column g in `v{g}` and nulls elsewhere, so every
    column keeps its own type (and its own ordering). Built as GROUPING SETS
    ((c0), (c1), …): Catalyst's `Expand` feeds one partially aggregated
    shuffle for all columns.
    """
    k = len(cols)
    vnames = [f"v{j}" for j in range(k)]
    if k > _MAX_GROUPING_SET_COLUMNS:
        return _per_column_counts_generate(df, cols, include_nulls)
    base = df.select(*[F.col(quote(c)).alias(v) for c, v in zip(cols, vnames)])
    full = (1 << k) - 1
    counted = base.groupingSets([[F.col(v)] for v in vnames], *[F.col(v) for v in vnames]).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid")
    )
    # grouping_id has a 0 bit for the one grouped column (first column = highest bit)
    g = (F.lit(k - 1) - F.round(F.log2(F.lit(full) - F.col("_gid")))).cast("int")
    out = counted.select(g.alias("g"), *vnames, "n")
    if not include_nulls:
        present = F.lit(False)
        for i, v in enumerate(vnames):
            present = F.when(F.col("g") == i, F.col(v).isNotNull()).otherwise(present)
        out = out.where(present)
    return out


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(g, u): the number of distinct non-null values of column g, exact, in one scan.

    All columns share one narrow key: of a type of at most eight bytes the xxhash64, which
    maps different values of one such type to different numbers (and 0.0 and -0.0, or all
    NaN, to one), of any other type the text. Columns without values have no row."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    args = []
    for g, name in enumerate(cols):
        c, kind = F.col(quote(name)), kinds[name]
        short = isinstance(kind, _SHORT_TYPES) or (isinstance(kind, T.DecimalType) and kind.precision <= 18)
        number = F.when(c.isNotNull(), F.xxhash64(c)) if short else F.lit(None).cast("bigint")
        args += [F.lit(g), number, F.lit(None).cast("string") if short else c.cast("string")]
    keys = df.select(F.stack(F.lit(len(cols)), *args).alias("g", "number", "text"))
    found = keys.where("number is not null or text is not null").distinct()
    return found.groupBy("g").agg(F.count(F.lit(1)).alias("u"))


def _per_column_counts_generate(df: DataFrame, cols: list[str], include_nulls: bool) -> DataFrame:
    # same result for very wide tables (grouping ids are limited to 64 bits): one slot per
    # data type, so a row grows with the number of columns, not with its square
    fields = {f.name: f.dataType for f in df.schema.fields}
    kinds = list({fields[c].simpleString(): fields[c] for c in cols}.items())
    slot = {name: f"s{t}" for t, (name, _) in enumerate(kinds)}
    structs = []
    for i, c in enumerate(cols):
        own = fields[c].simpleString()
        slots = [(F.col(quote(c)) if name == own else F.lit(None).cast(kind)).alias(slot[name]) for name, kind in kinds]
        one = F.struct(F.lit(i).alias("g"), *slots)
        structs.append(one if include_nulls else F.when(F.col(quote(c)).isNotNull(), one))
    counted = (
        df.select(F.explode(F.array(*structs)).alias("s"))
        .where(F.col("s").isNotNull())
        .select("s.*")
        .groupBy("g", *slot.values())
        .agg(F.count("*").alias("n"))
    )
    values = [F.when(F.col("g") == j, F.col(slot[fields[c].simpleString()])).alias(f"v{j}") for j, c in enumerate(cols)]
    return counted.select("g", *values, "n")


def modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column; ties -> smallest; none -> None."""
    if not cols:
        return {}
    vnames = [f"v{j}" for j in range(len(cols))]
    counts = per_column_counts(df, cols)
    best = (
        counts.groupBy("g")
        .agg(F.min(F.struct((-F.col("n")).alias("k"), *vnames)).alias("m"))
        .collect()
    )
    out: dict[str, object] = {c: None for c in cols}
    for row in best:
        g = row["g"]
        out[cols[g]] = row["m"][vnames[g]]
    return out
