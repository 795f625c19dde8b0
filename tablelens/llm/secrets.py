"""Secret scanning: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 or more token characters, or a value of any length and any
characters that is assigned (=, : or =>) to a name for a secret: in quotes up to the closing
one, else up to white space or the next name of a query string, without punctuation behind
it. A leading name= is no part of a candidate. Runs inside a quoted value with white space
are candidates as well. Its features: length; shares of
digits, upper and lower case; transitions between character classes and between repeated
classes; entropy of its characters; the share of it that dictionary words cover (words
that many documents of the corpus hold); signs of a path or address; and the neighbouring
words before it, hashed. A forest is trained on labelled findings.

Labelled findings: a table (doc_id, start, label) may be given. Without one, findings are
labelled by what is certain: an assignment to a name for a secret, in quotes and with
digits, is one; a candidate that dictionary words or letters alone (no digit, no sign other
than those of tokens) make up is none; all others are left to the forest. Training uses all labelled findings up to `SAMPLE_ROWS`,
else about that many, chosen by a hash.

Only DataFrame and Spark ML (JVM) functions run. Defined results: null and empty texts
have no candidates; with labels of one kind only, that kind holds for all; equal ids are
scanned row by row."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .native import let, matches

#: Labelled findings used for training, at most (in expectation).
SAMPLE_ROWS = 20_000
#: Documents that must hold a word for it to be in the dictionary.
DICTIONARY = 20
#: Hashed neighbouring words.
NEIGHBOURS = 64
_TOKEN = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{_TOKEN}])[{_TOKEN}]{{16,}}+"
# Names of secrets in assignments that count as labelled findings.
NAMES = "token|secret|password|passwd|pwd|api_key|apikey|access_key|auth"
# The name's end and the sign of an assignment, and the values (no group is repeated with
# backtracking, so long ones need no stack).
_GIVEN = rf"(?i:{NAMES})[\"'`]?\s*+(?:=>|[=:]{{1,2}}+)"
_QUOTED = "|".join(rf"{q}(?:[^{q}\\\n]++|\\.)++{q}" for q in "\"'`")
ASSIGNED = rf"(?<![{_TOKEN}])[{_TOKEN}]*?{_GIVEN}(?:\s*+(?:{_QUOTED})|[\x20\t]*+[\"'`]?[^\s\"'`](?:(?!&[A-Za-z0-9_]++=)\S)*+)"
#: What stands before the value in a match.
_HEAD = rf"^(?:[{_TOKEN}]*?{_GIVEN}\s*+[\"'`]?|-*+[A-Za-z_][A-Za-z0-9_-]*+=++(?=[^=]))"
_NUMERIC = ["length", "digits", "upper", "lower", "changes", "entropy", "covered", "slashes", "dots", "quoted", "assigned"]


def _value(m: Column) -> Column:
    """struct<start, value> of a match, without name, quotes and punctuation around it."""

    def inner(head: Column) -> Column:
        body = F.substring(m["value"], F.char_length(head) + 1, F.char_length(m["value"]))
        quote = F.regexp_extract(head, "[\"'`]$", 0)
        closed = (quote != "") & F.endswith(body, quote) & (F.char_length(body) > 1)
        return F.struct(
            (m["start"] + F.char_length(head)).alias("start"),
            F.when(closed, F.substring(body, F.lit(1), F.char_length(body) - 1)).otherwise(F.rtrim(body, F.lit("\"'`,;.)]}>"))).alias("value"),
        )

    return let(F.regexp_extract(m["value"], _HEAD, 0), inner)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: id, start, end, value, before (40 characters), after (8)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    text = F.col("text")
    # most texts assign nothing and need the plain pattern only
    found = F.when(text.rlike(_GIVEN), matches(text, f"{ASSIGNED}|{CANDIDATE}", "secret", 0)).otherwise(matches(text, CANDIDATE, "secret", 0))
    values = texts.select("id", "text", F.explode(F.transform(found, _value)).alias("m"))
    # a quoted sentence may hold runs of its own
    runs = F.transform(
        matches(F.col("m.value"), CANDIDATE, "secret", 0, F.col("m.value").rlike(r"\s")),
        lambda g: _value(F.struct((g["start"] + F.col("m.start")).alias("start"), g["value"].alias("value"))),
    )
    rows = values.select("id", "text", F.explode(F.concat(F.array("m"), runs)).alias("m")).where("m.value != ''")
    rows = rows.select("id", "text", F.struct("m.start", (F.col("m.start") + F.char_length("m.value")).alias("end"), "m.value").alias("m"))
    return rows.select(
        "id",
        F.col("m.start").alias("start"),
        F.col("m.end").alias("end"),
        F.col("m.value").alias("value"),
        F.substring("text", F.greatest(F.col("m.start") - 39, F.lit(1)), F.least(F.col("m.start"), F.lit(40))).alias("before"),
        F.substring("text", F.col("m.end") + 1, F.lit(8)).alias("after"),
    )


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Lower-case words of 3 or more letters that at least DICTIONARY documents hold."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit("[a-z]{3,}+"), F.lit(0)))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= DICTIONARY).select("word")


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the numeric features and the neighbouring words."""
    v, size = F.col("value"), F.char_length("value")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / size
    letters = F.array_distinct(F.split(v, ""))
    entropy = F.aggregate(
        F.transform(letters, lambda c: (size - F.char_length(F.replace(v, c, F.lit("")))) / size),
        F.lit(0.0),
        lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0),
    )
    rows = found.withColumn("key", F.monotonically_increasing_id())
    rows = cut(
        rows.withColumns(
            {
                "length": F.least(size, F.lit(512)).cast("double"),
                "digits": share("[0-9]"),
                "upper": share("[A-Z]"),
                "lower": share("[a-z]"),
                "changes": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"),
                "entropy": entropy,
                "slashes": share("/"),
                "dots": F.regexp_count(F.concat("before", "after"), F.lit(r"[./]")).cast("double"),
                "quoted": (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double"),
                "assigned": F.col("before").rlike("[=:]\\s*[\"'`]?$").cast("double"),
                "near": F.slice(F.reverse(F.regexp_extract_all(F.lower("before"), F.lit(r"\p{L}+"), F.lit(0))), 1, 3),
            }
        )
    )
    parts = rows.select("key", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}+"), F.lit(0))).alias("word"))
    covered = parts.join(words, "word", "left_semi").groupBy("key").agg(F.sum(F.char_length("word")).alias("c"))
    return cut(rows.join(covered, "key", "left").withColumn("covered", F.coalesce(F.col("c") / size, F.lit(0.0))).drop("c"))


def certain_labels(rows: DataFrame) -> DataFrame:
    """The rows whose kind is certain, with `label`."""
    secret = (
        F.lower("before").rlike(rf"(?:{NAMES})\s*[=:]\s*[\"'`]$") & (F.col("quoted") == 1) & (F.col("digits") > 0) & (F.col("entropy") >= 3)
    )
    none = (F.col("covered") >= 0.5) | ((F.col("digits") == 0) & ~F.col("value").rlike(rf"[^\p{{L}}\s{_TOKEN}]"))
    return rows.withColumn("label", F.when(secret, 1.0).when(none, 0.0)).where("label is not null")


def scan(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    cutoff: float = 0.5,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Findings that the forest lets pass: id, start, end (code points), value, probability."""
    rows = featured(candidates(docs, id_col, text_col), dictionary(docs, text_col))
    if labelled is None:
        train = certain_labels(rows)
    else:
        known = labelled.select(F.col(id_col).alias("id"), "start", F.col("label").cast("double").alias("label")).groupBy("id", "start").agg(F.max("label").alias("label"))
        train = rows.join(known, ["id", "start"]).where("label is not null")
    train = cut(train)
    sizes = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    out = lambda df, p: df.select(F.col("id").alias(id_col), "start", "end", "value", p.alias("probability")).where(F.col("probability") >= cutoff)
    if len(sizes) < 2:
        return out(rows, F.lit(max(sizes, default=0.0)))
    total = sum(sizes.values())
    if total > sample_rows:
        # rare labels are kept whole as far as the bound allows
        each = {k: min(1.0, sample_rows / 2 / n) for k, n in sizes.items()}
        share = F.when(F.col("label") == 1.0, each[1.0]).otherwise(each[0.0])
        train = train.where(F.pmod(F.xxhash64("id", "start", "value"), F.lit(1_000_000)) < share * 1_000_000)
    hashed = HashingTF(inputCol="near", outputCol="hashed", numFeatures=NEIGHBOURS, binary=True)
    together = VectorAssembler(inputCols=[*_NUMERIC, "hashed"], outputCol="features")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=30, maxDepth=6, seed=7)
    model = forest.fit(together.transform(hashed.transform(train.select("label", "near", *_NUMERIC))))
    scored = model.transform(together.transform(hashed.transform(rows)))
    return out(scored, F.get(vector_to_array("probability"), F.lit(1)))
