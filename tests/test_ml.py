import random

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tablelens.operators import boosting, ml, stats
from tablelens.session import materialize


def _planted(spark, n=600):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        x = rnd.uniform(0, 100)
        c = rnd.choice(["a", "b", "c"])
        amount = 3.0 * x + (40.0 if c == "a" else 0.0) + rnd.gauss(0, 2)
        rows.append((i * 7919 % 1000003, x, c, amount))
    return spark.createDataFrame(rows, "ref bigint, x double, segment string, amount double")


def _metrics(res):
    return {r["metric"]: r["value"] for r in res["metrics"].collect()}


def test_target_guess_and_feature_split(spark):
    df = _planted(spark)
    from tablelens.operators.roles import column_facts

    facts = column_facts(df)
    assert ml.guess_target(df, None, facts) == "amount"
    num, cat = ml.split_features(["ref", "x", "segment"], facts)
    assert num == ["ref", "x"] and cat == ["segment"]


def test_beats_mean_and_is_deterministic(spark, tmp_path):
    df = _planted(spark)
    a = ml.train_value_regressor(df, out=str(tmp_path), max_iter=20)
    b = ml.train_value_regressor(df, max_iter=20)
    ma, mb = _metrics(a), _metrics(b)
    assert a["target"] == "value"  # `amount` is mapped to the value role first
    assert ma["r2"] > 0.9
    assert ma == mb
    model = ml.load_model(a["paths"]["model"])
    rows = a["predictions"].select("quantity", "x", "category", F.col("predicted_value").alias("before"))
    again = model.transform(rows)
    assert again.count() == rows.count() > 0
    assert again.where("not (prediction <=> before)").count() == 0


def test_category_map_pools_rare_members_and_ignores_unseen_ones(spark):
    seen = ["a"] * 50 + ["b"] * 40 + [None] * 6 + ["c", "d", "(pooled)", "n"]
    train = spark.createDataFrame([(m,) for m in seen], "seg string")
    fitted = ml.fit_categories(train, ["seg"], share=0.05)
    assert fitted.frequent == {"seg": [None, "a", "b"]} and fitted.pooled == ["seg"]
    test = spark.createDataFrame([("a", 1), ("c", 2), ("unseen", 3), (None, 4), ("(pooled)", 5), ("", 6), ("n", 7), ("d1", 8)], "seg string, k int")
    marks = ml.indicator_columns(fitted)
    rows = ml.category_codes(test, fitted).select("k", *marks).orderBy("k").collect()
    assert [tuple(int(x) for x in r[1:]) for r in rows] == [
        (0, 1, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0),
    ]
    own = ml.category_codes(train, fitted, met=True).groupBy("seg__kind").count().collect()
    assert {r["seg__kind"]: r["count"] for r in own} == {"own": 96, "pooled": 4}
    none = ml.fit_categories(train.limit(0), ["seg"])
    assert none.indicators() == [] and ml.fit_categories(train, []).indicators() == []


def test_target_tiers(spark):
    df = spark.createDataFrame([(1.0, 5, "3", 100.0), (2.0, 9, "x", 500.0), (2.0, 9, "4", 900.0)], "w double, n int, Amount string, big double")
    from tablelens.operators.roles import column_facts

    facts = column_facts(df)
    ranked = ml.target_ranking(df, "w", facts).collect()
    assert [(r["column"], r["tier"]) for r in ranked] == [("w", 0), ("Amount", 1), ("n", 2)]  # big: all values differ
    assert ml.guess_target(df.select("big"), None, column_facts(df.select("big"))) is None


def _numbers(spark, n=2000):
    rnd = random.Random(11)
    rows = []
    for _ in range(n):
        x, k, m = rnd.uniform(0, 100), float(rnd.randrange(50)), float(rnd.randrange(5))
        rows.append((x, k, m, float(rnd.random() < 0.3), 1.0, 3 * x + k * k + (40 if m == 2 else 0) + rnd.gauss(0, 5)))
    return spark.createDataFrame(rows, "x double, k double, m double, i double, one double, label double")


_FEATURES = ["x", "k", "m", "i", "one"]


def _fit(df, n, features=_FEATURES, **options):
    edges = boosting.feature_edges(df, features, {"x": n, "k": 50, "m": 5, "i": 2, "one": 1})
    trees = boosting.fit(df, "label", features, edges, n, **{"max_iter": 12, "max_depth": 3, "step_size": 0.1, **options})
    return trees, [r[0] for r in df.select(trees.prediction([F.col(c) for c in features])).collect()]


def test_boosted_trees_are_those_of_spark_ml(spark):
    df = _numbers(spark)
    vectors = VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(df)
    for depth, trees in ((3, 12), (2, 1), (4, 7)):
        theirs = GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=0.1).fit(vectors).transform(vectors)
        _, ours = _fit(df, 2000, max_iter=trees, max_depth=depth)
        assert all(abs(r["prediction"] - p) < 1e-6 for r, p in zip(theirs.collect(), ours, strict=True))


def test_boosted_trees_of_a_sketch_of_all_values(spark, monkeypatch):
    df = _numbers(spark)
    exact = boosting.feature_edges(df, ["x"], {"x": 2000})
    monkeypatch.setattr(boosting, "MAX_COUNTED_VALUES", 100)
    (edges,) = boosting.feature_edges(df, ["x"], {"x": 2000})
    assert len(edges) == 31 and max(abs(a - b) for a, b in zip(edges, exact[0])) < 1
    _, ours = _fit(df, 2000)
    error = sum(abs(r["label"] - p) for r, p in zip(df.collect(), ours)) / 2000
    assert error < 250


def test_boosting_without_anything_to_split(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0)] * 9, "one double, label double, two double")
    trees, found = _fit(df, 9, ["one"])
    assert found == [5.0] * 9
    none = boosting.fit(df, "label", [], [], 9, max_iter=2, max_depth=3, step_size=0.1)
    assert df.select(none.prediction([])).first()[0] == 5.0


def test_a_boosting_task_reads_a_bounded_number_of_rows(spark, monkeypatch):
    """More rows make more tasks, not larger ones, and the trees stay the same."""
    df = _numbers(spark)
    whole, _ = _fit(df, 2000)
    seen = []
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 16)
    monkeypatch.setattr(boosting, "TASK_ROWS", 64)
    monkeypatch.setattr(boosting, "materialize", lambda d: seen.append(materialize(d)) or seen[-1])
    parts, found = _fit(df, 2000)
    assert [t.feature for t in parts.trees] == [t.feature for t in whole.trees]
    tasks = seen[0].groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 2000 and max(r["n"] for r in tasks) <= 4 * 64


def test_distinct_counts_of_every_type(spark):
    rows = [
        (0, 0.0, 1.5, True, "a", "2024-01-01", "1.10", "1"),
        (-1, -0.0, float("nan"), False, "", "2024-01-02", "1.1", None),
        (2**63 - 1, float("nan"), float("nan"), True, None, "2024-01-01", None, "12345678901234567890123"),
        (-(2**63), float("inf"), None, None, "a", None, "2.00", "12345678901234567890124"),
        (None, None, 1.5, True, "A", "2024-01-03", "0", None),
    ]
    df = spark.createDataFrame(rows, "l bigint, d double, f float, b boolean, s string, day string, e string, w string").select(
        "l", "d", "f", "b", "s", F.col("day").cast("date").alias("day"), F.col("day").cast("timestamp").alias("ts"),
        F.col("day").cast("timestamp_ntz").alias("tn"), F.col("e").cast("decimal(10,2)").alias("e"), F.col("w").cast("decimal(38,0)").alias("w"),
        (F.col("l") % 7).cast("int").alias("i"), F.lit(None).cast("string").alias("none"),
    )
    found = {r["g"]: r["u"] for r in stats.distinct_counts(df, df.columns).collect()}
    wanted = df.agg(*[F.countDistinct(c).alias(c) for c in df.columns]).first()
    assert [found.get(g, 0) for g in range(len(df.columns))] == list(wanted)
    plan = stats.distinct_counts(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
