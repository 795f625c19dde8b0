"""Value regressor: target guess, feature split, encoding, gradient-boosted
trees, metrics, persistence.

Scale notes: a fitted category map keeps indicator columns only for members
holding at least 1 % of the training rows (at most 100 per column, the only
names that reach the driver); the rarer members stay a distributed table. The
split is a hash of the row, so it does not depend on partitioning. Features are
binned once, and the stored bins are what the boosting iterations read
(`operators.boosting`).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.constants import RARE_CATEGORY_SHARE, TARGET_CANDIDATES
from tablelens.functions.expressions import to_number
from tablelens.functions.names import quote
from tablelens.operators import boosting
from tablelens.operators.roles import auto_map, column_facts, infer_columns, mapped_facts
from tablelens.operators.stats import exact_quantiles, per_column_counts, stats_columns
from tablelens.session import materialize


# -------------------------------------------------------------------- M1 --

def target_ranking(df: DataFrame, mapped_value: str | None = None, facts: DataFrame | None = None) -> DataFrame:
    """(column, tier, place): how each column with numeric values ranks as a target, best
    first. Tier 0 is the mapped value column, tier 1 a target name (place: its order among
    the names; of two columns of one lowered name the later), tier 2 a column that is not
    id-like (place: by falling population variance, equal ones in column order)."""
    facts = facts if facts is not None else column_facts(df)
    ids = infer_columns(df, facts, ml=True).select("column", "is_id_like")
    name = F.lower("column")
    known = F.array_position(F.array(*map(F.lit, TARGET_CANDIDATES)), name)
    tier = (
        F.when(F.col("column") == F.lit(mapped_value), 0)
        .when(known > 0, 1)
        .when(~F.col("is_id_like") & F.col("var_pop").isNotNull(), 2)
    )
    place = F.when(F.col("tier") == 1, F.struct(known.cast("double").alias("a"), (-F.col("pos")).alias("b"))).otherwise(
        F.struct((-F.col("var_pop")).alias("a"), F.col("pos").alias("b"))
    )
    return (
        facts.where("number_parses > 0")
        .join(F.broadcast(ids), "column")
        .withColumn("tier", tier)
        .where("tier is not null")
        .select("column", "tier", place.alias("place"))
        .orderBy("tier", "place")
    )


def guess_target(df: DataFrame, mapped_value: str | None = None, facts: DataFrame | None = None) -> str | None:
    """The best column of `target_ranking`, or None."""
    best = target_ranking(df, mapped_value, facts).first()
    return best["column"] if best else None


# -------------------------------------------------------------------- M2 --

def feature_kinds(facts: DataFrame) -> DataFrame:
    """(column, kind): numeric when more than half of all rows read as a number, else categorical."""
    share = F.try_divide(F.col("number_parses").cast("double"), F.col("rows"))
    kind = F.when(share > 0.5, "numeric").otherwise("categorical")
    return facts.orderBy("pos").select("column", kind.alias("kind"))


def split_features(columns: list[str], facts: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) of `columns` by `feature_kinds`, in their order."""
    kind = {r["column"]: r["kind"] for r in feature_kinds(facts).collect()}
    return [c for c in columns if kind[c] == "numeric"], [c for c in columns if kind[c] == "categorical"]


# -------------------------------------------------------------------- M3 --

@dataclass
class CategoryMap:
    """What each categorical column's members become.

    `frequent`: column -> members with an indicator of their own (null is a member like any
    other), sorted, null first. `rare`: (column, member) of the members met in training that
    share the pooled indicator; a distributed table, as a column may have any number of them."""

    frequent: dict[str, list[str | None]]
    pooled: list[str]
    rare: DataFrame = field(repr=False)

    def indicators(self) -> list[tuple[str, str, str | None]]:
        """(column, kind, member) of every indicator in order; a column's pooled one comes last."""
        out: list[tuple[str, str, str | None]] = []
        for c, own in self.frequent.items():
            out += [(c, "own", m) for m in own]
            if c in self.pooled:
                out.append((c, "pooled", None))
        return out


def fit_categories(
    train: DataFrame, columns: list[str], share: float = RARE_CATEGORY_SHARE, rows: int | None = None
) -> CategoryMap:
    """The category map of the training rows (their number, if known, saves a count): a member
    in fewer than `share` of all rows is rare."""
    if not columns:
        return CategoryMap({}, [], train.sparkSession.createDataFrame([], "column string, member string"))
    text = train.select(*[F.col(quote(c)).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    counts = materialize(
        per_column_counts(text, text.columns, include_nulls=True).select(
            F.element_at(F.array(*map(F.lit, columns)), F.col("g") + 1).alias("column"),
            F.coalesce(*[F.col(f"v{i}") for i in range(len(columns))]).alias("member"),
            "n",
        )
    )
    least = F.lit(share) * F.lit(train.count() if rows is None else rows)
    rare = counts.where(F.col("n") < least).select("column", "member")
    frequent: dict[str, list[str | None]] = {c: [] for c in columns}
    for r in counts.where(F.col("n") >= least).collect():  # at most 1 / share members a column
        frequent[r["column"]].append(r["member"])
    for own in frequent.values():
        own.sort(key=lambda m: (m is not None, m or ""))
    some = {r["column"] for r in rare.select("column").distinct().collect()}
    return CategoryMap(frequent, [c for c in columns if c in some], rare)


def category_codes(df: DataFrame, fitted: CategoryMap, met: bool = False) -> DataFrame:
    """`df` with `<column>__kind` for each mapped column: `own` (a member with an indicator),
    `pooled` (rare in training) or null (never met in training).

    With `met` every member is known to come from the training rows, so nothing is looked
    up. Else members without an indicator are looked up in the table of rare ones; rows that
    need no look-up get a dealt-out key, so they do not meet in one task of the join."""
    rows = df
    for c, own in fitted.frequent.items():
        value = F.col(quote(c)).cast("string")
        named = [m for m in own if m is not None]
        is_own = (value.isin(named) if named else F.lit(False)) & value.isNotNull()
        is_own = F.coalesce(is_own | value.isNull() if None in own else is_own, F.lit(False))
        if met or c not in fitted.pooled:
            rest = F.lit("pooled" if met else None).cast("string")
            rows = rows.withColumn(f"{c}__kind", F.when(is_own, F.lit("own")).otherwise(rest))
            continue
        dealt = F.concat(F.lit("d"), F.pmod(F.xxhash64(*[F.col(quote(x)) for x in df.columns]), F.lit(1009)).cast("string"))
        key = F.when(is_own, dealt).when(value.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), value))
        known = fitted.rare.where(F.col("column") == c).select(
            F.when(F.col("member").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("member"))).alias("__key"),
            F.lit("pooled").alias("__met"),
        )
        rows = (
            rows.withColumn("__key", key)
            .withColumn("__own", is_own)
            .join(known, "__key", "left")
            .withColumn(f"{c}__kind", F.when(F.col("__own"), F.lit("own")).otherwise(F.col("__met")))
            .drop("__key", "__own", "__met")
        )
    return rows


def indicator_columns(fitted: CategoryMap) -> list[Column]:
    """0 / 1 indicators over a frame with `category_codes`, named ind0, ind1, … in the order
    of `CategoryMap.indicators`; a member never met in training has none set."""
    out = []
    for i, (c, kind, m) in enumerate(fitted.indicators()):
        hit = F.col(quote(f"{c}__kind")).eqNullSafe(kind)
        if kind == "own":
            hit &= F.col(quote(c)).cast("string").eqNullSafe(F.lit(m).cast("string"))
        out.append(hit.cast("double").alias(f"ind{i}"))
    return out


# --------------------------------------------------------------- M4 / M5 --

@dataclass
class ValueModel:
    """Boosted trees with everything needed to score raw rows."""

    target: str
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    categories: CategoryMap
    trees: boosting.BoostedTrees

    def feature_names(self) -> list[str]:
        return [f"num{i}" for i in range(len(self.numeric))] + [f"ind{i}" for i in range(len(self.categories.indicators()))]

    def features(self, df: DataFrame, keep: list[str], met: bool = False) -> DataFrame:
        """`keep` and the columns `feature_names` of prepared rows."""
        coded = category_codes(df, self.categories, met)
        values = [F.coalesce(F.col(quote(c)), F.lit(self.medians.get(c, 0.0))).alias(f"num{i}") for i, c in enumerate(self.numeric)]
        return coded.select(*[F.col(quote(k)) for k in keep], *values, *indicator_columns(self.categories))

    def scored(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """`keep` and `prediction` of prepared rows."""
        rows = self.features(df, keep)
        found = self.trees.prediction([F.col(f) for f in self.feature_names()])
        return rows.select(*[F.col(quote(k)) for k in keep], found.alias("prediction"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows of the feature columns (others are kept) with a column `prediction`."""
        fields = {f.name: f.dataType for f in df.schema.fields}
        return self.scored(df.withColumns({c: _number(c, fields) for c in self.numeric}), df.columns)

    def save(self, path: str) -> None:
        spec = {
            "target": self.target, "numeric": self.numeric, "categorical": self.categorical, "medians": self.medians,
            "frequent": self.categories.frequent, "pooled": self.categories.pooled,
        }
        spark = self.categories.rare.sparkSession
        self.trees.save(f"{path}/trees")
        self.categories.rare.write.mode("overwrite").parquet(f"{path}/rare")
        spark.createDataFrame([(json.dumps(spec),)], "spec string").write.mode("overwrite").parquet(f"{path}/spec")

    @staticmethod
    def load(path: str) -> ValueModel:
        spark = SparkSession.active()
        spec = json.loads(spark.read.parquet(f"{path}/spec").first()["spec"])
        fitted = CategoryMap(spec["frequent"], spec["pooled"], spark.read.parquet(f"{path}/rare"))
        trees = boosting.BoostedTrees.load(f"{path}/trees")
        return ValueModel(spec["target"], spec["numeric"], spec["categorical"], spec["medians"], fitted, trees)


def _number(c: str, fields: dict) -> Column:
    return F.nanvl(to_number(F.col(quote(c)), fields[c]), F.lit(None).cast("double"))


def in_train(cols: list[str], test_fraction: float, seed: int) -> Column:
    """A hash of the row decides, so the split depends on neither partitions nor order."""
    h = F.xxhash64(F.lit(seed), *[F.col(quote(c)) for c in cols])
    u = (h.bitwiseAND(F.lit(0x7FFFFFFF))).cast("double") / float(0x7FFFFFFF)
    return u >= test_fraction


def train_value_regressor(
    df: DataFrame,
    out: str | None = None,
    *,
    seed: int = 42,
    max_iter: int = 100,
    max_depth: int = 3,
    step_size: float = 0.1,
    test_fraction: float = 0.2,
) -> dict:
    """Auto-map, guess the target, fit GBT (100 trees, depth 3, rate 0.1) on
    an 80/20 hash split and report MAE, R² and MAPE on the held-out part.
    With `out`, saves the fitted model and the test predictions there."""
    # every step below re-reads the table, boosting once per tree level and iteration: an input
    # of fewer splits than task slots is dealt out once; a larger one is left alone
    slots = df.sparkSession.sparkContext.defaultParallelism
    if (df.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1 < slots:
        df = materialize(df.repartition(slots))
    raw = column_facts(df)
    mapped, mapping = auto_map(df, facts=raw)
    facts = mapped_facts(raw, df, mapped)
    target = guess_target(mapped, mapping.get("value"), facts)
    if not target:
        raise ValueError("could not infer a numeric target (value, amount, revenue …)")
    num, cat = split_features([c for c in mapped.columns if c != target], facts)
    fields = {f.name: f.dataType for f in mapped.schema.fields}
    prepared = mapped.select(
        _number(target, fields).alias("label"),
        *[_number(c, fields).alias(c) for c in num],
        *[F.col(quote(c)).cast("string").alias(c) for c in cat],
    ).where(F.col("label").isNotNull())
    flag = in_train(["label", *num, *cat], test_fraction, seed)
    train = prepared.where(flag)
    # one pass: rows on both sides, and count, min and max of the training numbers
    seen = prepared.select(flag.alias("t"), *[F.when(flag, F.col(quote(c))).alias(f"x{i}") for i, c in enumerate(num)])
    head = seen.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("t").alias("train"), *stats_columns([f"x{i}" for i in range(len(num))])
    ).first()
    if head["rows"] < 10:
        raise ValueError(f"not enough known targets in {target!r} to train (found {head['rows']})")
    known = {c: (head[f"n{i}"], head[f"a{i}"], head[f"b{i}"]) for i, c in enumerate(num)}
    gaps = [c for c in num if known[c][0] < head["train"]]
    medians = {c: q[0] for c, q in exact_quantiles(train, {c: [0.5] for c in gaps}, stats=known).items() if q[0] is not None}
    fitted = fit_categories(train, cat, rows=head["train"])
    model = ValueModel(target, num, cat, medians, fitted, None)

    distinct = {r["column"]: r["distinct"] + 1 for r in facts.collect()}  # one more: the median
    rows = model.features(train, ["label"], met=True)
    names = model.feature_names()
    edges = boosting.feature_edges(rows, names[: len(num)], {f"num{i}": distinct[c] for i, c in enumerate(num)})
    edges += [[0.5]] * (len(names) - len(num))
    model.trees = boosting.fit(
        rows, "label", names, edges, head["train"], max_iter=max_iter, max_depth=max_depth, step_size=step_size
    )
    scored = model.scored(prepared.where(~flag), ["label", *num, *cat]).select(
        *[F.col(quote(c)) for c in [*num, *cat]], F.col("label").alias("actual_value"), F.col("prediction").alias("predicted_value")
    )
    result = {"target": target, "features": {"numeric": num, "categorical": cat},
              "metrics": regression_metrics(scored), "predictions": scored, "model": model}
    if out:
        model.save(f"{out}/model")
        scored.write.mode("overwrite").option("header", True).csv(f"{out}/predictions")
        result["paths"] = {"model": f"{out}/model", "predictions": f"{out}/predictions"}
    return result


def regression_metrics(scored: DataFrame, actual: str = "actual_value", predicted: str = "predicted_value") -> DataFrame:
    """(metric, value): mae, r2, mape (%, denominator max(1e-8, |y|)), rows.
    One pass; R² from Σ(y−p)² and the variance of y (stable on large means)."""
    y, p = F.col(actual), F.col(predicted)
    s = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sum((y - p) * (y - p)).alias("sse"),
        (F.var_pop(y) * F.count(y)).alias("sst"),
        (F.avg(F.abs((y - p) / F.greatest(F.lit(1e-8), F.abs(y)))) * 100.0).alias("mape"),
    )
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst"))
    return s.select(
        F.inline(
            F.array(
                F.struct(F.lit("mae").alias("metric"), F.col("mae").alias("value")),
                F.struct(F.lit("r2").alias("metric"), r2.alias("value")),
                F.struct(F.lit("mape").alias("metric"), F.col("mape").alias("value")),
                F.struct(F.lit("rows").alias("metric"), F.col("n").cast("double").alias("value")),
            )
        )
    )


def load_model(path: str) -> ValueModel:
    return ValueModel.load(path)
