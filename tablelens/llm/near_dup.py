"""MinHash near-duplicate removal with bottom-k sketches of one hash function.

1. Every text's set of distinct word shingles is hashed (64 bits). Texts with equal sets
   form one class (a 128-bit signature of the sorted set), so groups of copies, however
   large, become one row before anything else happens. A class keeps the k smallest
   hashes: its bottom-k sketch.
2. Inverted lists of retained values give the candidates. Two sets with Jaccard >= 0.8
   share at least `overlap` of their k retained values (for a set of at most k values the
   worst case over the sizes of its partners, of which a larger one retains k only; for
   larger sets the bound fails with a probability below 1e-9), and must therefore meet in a
   list of the k - overlap + 1 values of either that are rarest in the corpus. Only those
   lists are kept: a frequent line or passage does not put all its documents into one list,
   unless they agree in most of their values.
3. Each list is first reduced to a star: every member is compared with the list's most
   central class only (the one whose values are the most frequent: the original among its
   near copies), so that a dense group of n near copies costs n comparisons, not n * n.
   The links found give first components. Members of one list in different components are
   then compared as well, so no link between components is lost: in lists of up to `SMALL`
   members by pairs (a bounded number per row), in larger ones by blocks of about `BLOCK`
   classes, whose full sets are intersected by a matrix product; a pair of blocks returns a
   spanning forest of its links, never the pairs.
4. The union sketch of a pair (the k smallest of both sketches) estimates its similarity;
   pairs far below the threshold are dropped (`slack` standard errors), and the rest is
   verified on the full sets.

Defined results: null and empty texts and texts without words have no shingles, link with
nothing and are kept; texts with fewer words than a shingle form one shingle of all words;
rows with equal doc_id are joined through their texts only, and the component of a class is
the smallest non-null doc_id in it; rows of a component without any non-null doc_id get null.
The document kept of a component is the one of that doc_id (of several texts under it, one);
without any non-null doc_id it is one row."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, byte_table, chunks, components, cut, list_column, mix, runs, slice_hashes

#: Retained hashes of a set.
K = 32
#: Members up to which a list's remaining pairs are written out.
SMALL = 32
#: Classes in a block of larger lists.
BLOCK = 256
_WORD = byte_table(lambda b: b != 32 and not 9 <= b <= 13)


def least_overlap(k: int, similarity: float, risk: float = 1e-9) -> int:
    """Retained values that two sets of this similarity share, but for the given risk.

    The k smallest hashes of the union are a random sample of it; each lies in both sets
    with a probability of at least `similarity`, and is then retained by both."""
    below = 0.0
    for shared in range(k + 1):
        below += math.comb(k, shared) * similarity**shared * (1 - similarity) ** (k - shared)
        if below > risk:
            return max(1, shared)
    return k


def small_overlap(n: int, k: int, similarity: float) -> int:
    """Retained values that a set of n <= k shares with any set of this similarity.

    Of a partner of b values at least similarity * (n + b) / (1 + similarity) are common; a
    partner of more than k loses b - k of its values, which may all be common ones."""
    least, any_large = k, least_overlap(k, similarity)
    for b in range(math.ceil(n * similarity - 1e-9), math.floor(n / similarity + 1e-9) + 1):
        common = math.ceil(similarity * (n + b) / (1 + similarity) - 1e-9)
        least = min(least, common if b <= k else max(common - (b - k), any_large))
    return max(1, least)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text of a buffer."""
    data = LOWER[data]
    starts, ends, row = runs(_WORD[data], offsets)
    words = slice_hashes(data, starts, ends)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    end = np.cumsum(count)
    m = max(0, len(words) - width + 1)
    rolled = np.full(m, width, np.uint64)
    for j in range(width):
        rolled = mix(rolled ^ words[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
    rolled = mix(rolled)
    for r in range(n):
        a, b = end[r] - count[r], end[r]
        if count[r] >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif count[r]:
            short = np.uint64(count[r])
            for w in words[a:b]:
                short = mix(np.array([short ^ w])) * np.uint64(0x9E3779B97F4A7C15)
                short = short[0]
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _with_sets(df: DataFrame, text_col: str, width: int, k: int | None) -> DataFrame:
    """Adds n_shingles, sig (16 bytes; null for an empty set) and sketch (k smallest hashes)
    or, with k None, shingles (all of them); text goes."""
    rest = [f for f in df.schema.fields if f.name != text_col]
    name = "shingles" if k is None else "sketch"
    schema = T.StructType(
        [
            *rest,
            T.StructField("n_shingles", T.LongType()),
            T.StructField("sig", T.BinaryType()),
            T.StructField(name, T.ArrayType(T.LongType(), False)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(batch.schema.get_field_index(text_col))):
                sizes, sigs, kept = [], [], []
                for s in shingle_sets(data, offsets, width):
                    sizes.append(len(s))
                    sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    kept.append(s if k is None else s[:k])
                part = batch.slice(lo, hi - lo)
                flat = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(part.schema.get_field_index(f.name)) for f in rest],
                        pa.array(sizes, pa.int64()),
                        pa.array(sigs, pa.binary()),
                        list_column(flat, np.array([len(x) for x in kept]), pa.int64()),
                    ],
                    names=[*[f.name for f in rest], "n_shingles", "sig", name],
                )

    return df.mapInArrow(run, schema)


def _lists(classes: DataFrame, k: int, similarity: float) -> DataFrame:
    """(value, id, n, central): the lists in which a class can meet a similar one."""
    flat = classes.select("id", "n", F.explode("sketch").alias("value"))
    # values of one class only lead nowhere; a value's frequency orders the others
    often = flat.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    overlap = least_overlap(k, similarity)
    kept = F.least("n", F.lit(k))
    small = F.array(*[F.lit(small_overlap(n, k, similarity)) for n in range(1, k + 1)])
    need = F.when(F.col("n") <= k, F.get(small, (F.col("n") - 1).cast("int"))).otherwise(F.lit(overlap))
    ranked = (
        flat.join(often, "value")
        .groupBy("id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"))
        # values seen once come first in the order of rarity and fill the prefix
        .withColumn("take", (kept - need + 1 - (kept - F.size("v"))).cast("int"))
        .where("take > 0")
    )
    central = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x["df"]).alias("central")
    return ranked.select("id", "n", central, F.explode(F.slice("v", F.lit(1), F.col("take"))).alias("e")).select("id", "n", "central", "e.value")


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, k: int, percent: int, slack: float) -> DataFrame:
    """The pairs (a, b) of class ids whose full sets reach the threshold."""
    share = percent / 100
    sketches = classes.select("id", "n", "sketch")
    both = pairs.join(sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(
        sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b"
    )
    shared = F.array_intersect("sa", "sb")
    # the k smallest hashes of the union, in the unsigned order of the sketches
    joint = F.slice(F.array_sort(F.transform(F.array_union("sa", "sb"), lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))), 1, k)
    agreed = F.size(F.array_intersect(joint, F.transform(shared, lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))))
    least = F.size(joint) * share - F.lit(slack) * F.sqrt(F.size(joint) * share * (1 - share))
    likely = both.where(
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (agreed >= least)
    ).select("a", "b", "na", "nb")
    full = likely.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("fa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("fb")), "b"
    )
    common = F.size(F.array_intersect("fa", "fb"))
    return full.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _dense(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components inside large lists, enough to join what they join.

    A class's home is the smallest head of its lists, so the near copies of one text share
    it; a home's classes are dealt into blocks, and two blocks are compared when a list has
    members in both."""
    home = apart.groupBy("id").agg(F.min("head").alias("home"), F.first("root").alias("root"), F.first("n").alias("n"))
    sizes = home.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    home = cut(
        home.join(sizes, "home").select(
            "id", "root", "n", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block")
        )
    )
    seen = apart.select("value", "id").join(home.select("id", "block"), "id").select("value", "block").distinct()
    left, right = seen.alias("l"), seen.alias("r")
    block_pairs = cut(
        left.join(right, F.col("l.value") == F.col("r.value"))
        .where("l.block <= r.block")
        .select(F.col("l.block").alias("i"), F.col("r.block").alias("j"))
        .distinct()
    )
    full = home.join(sets, "id")
    sides = block_pairs.select("i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).union(
        block_pairs.where("i != j").select("i", "j", F.col("j").alias("block"), F.lit(1).alias("side"))
    )

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        side, ids, roots, size = (part[c].to_numpy() for c in ("side", "id", "root", "n"))
        x = np.flatnonzero(side == 0)
        y = np.flatnonzero(side == 1) if (side == 1).any() else x
        shingles = part["shingles"].to_numpy()
        own = np.repeat(np.arange(len(part)), [len(s) for s in shingles])
        values, column = np.unique(np.concatenate(shingles), return_inverse=True)
        often = np.bincount(column, minlength=len(values)) > 1
        place = np.cumsum(often) - 1
        common = np.zeros((len(x), len(y)), np.float32)
        width, kept = 4096, often[column]
        own, column = own[kept], place[column[kept]]
        for lo in range(0, int(often.sum()), width):
            here = (column >= lo) & (column < lo + width)
            bits = np.zeros((len(part), width), np.float32)
            bits[own[here], column[here] - lo] = 1
            common += bits[x] @ bits[y].T
        common = common.astype(np.int64)
        linked = 100 * common >= percent * (size[x][:, None] + size[y][None, :] - common)
        linked &= roots[x][:, None] != roots[y][None, :]
        # join trees of components; a link inside a tree adds nothing
        trees, tree = np.unique(roots, return_inverse=True)
        edges = []
        for a in np.flatnonzero(linked.any(axis=1)):
            near = y[np.flatnonzero(linked[a])]
            others, at = np.unique(tree[near], return_index=True)
            for other, b in zip(others, near[at], strict=True):
                mine = tree[x[a]]
                if other != mine:
                    edges.append((ids[x[a]], ids[b]))
                    tree[tree == other] = mine
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return sides.join(full, "block").groupBy("i", "j").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    k: int = K,
    slack: float = 6.5,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    `width` words make a shingle; sets with 100 * intersection >= percent * union link."""
    return _decided(docs, id_col, text_col, width, percent, k, slack).drop("__text")


def _decided(docs: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80, k: int = K, slack: float = 6.5) -> DataFrame:
    """The same with `__text`, a hash of the text."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id0"), F.xxhash64(text_col).alias("__text"), F.col(text_col).alias("text"))
    rows = cut(_with_sets(texts.withColumn("__row", F.monotonically_increasing_id()), "text", width, k))
    # the survivor of some rows is the smallest of these
    rank = F.struct(F.col("id0").isNull().alias("nameless"), F.col("id0").alias("id"), F.col("__text").alias("text"), F.col("__row").alias("row"))
    # one class per distinct set; the id is a number that fits the joins below
    classes = cut(
        rows.where("sig is not null")
        .groupBy("sig")
        .agg(F.min(rank).alias("low"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    lists = cut(_lists(classes, k, percent / 100))
    head = lists.groupBy("value").agg(F.max(F.struct("central", "id")).alias("h"), F.count("*").alias("members")).where("members > 1")
    head = cut(head.select("value", F.col("h.id").alias("head"), "members"))
    star = lists.join(head, "value").where("head != id").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct()
    pairs = cut(star)
    # full sets only of classes that are in any pair; their texts are read once more
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    # a list's members are all in the star of its head, so later pairs need no other sets
    reps = classes.join(wanted, "id", "left_semi").select("id", "sig", "low")
    sets = cut(
        _with_sets(texts.select("text"), "text", width, None)
        .select("sig", "shingles")
        .join(reps.select("id", "sig"), "sig")
        .dropDuplicates(["id"])
        .select("id", "shingles")
    )
    links = cut(_verified(pairs, classes, sets, k, percent, slack))
    found = cut(components(links)) if not links.isEmpty() else spark.createDataFrame([], "node bigint, root bigint")
    # members of one list that are still apart
    placed = lists.join(found.select(F.col("node").alias("id"), "root"), "id", "left").select(
        "value", "id", "n", F.coalesce("root", "id").alias("root")
    )
    mixed = placed.groupBy("value").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("value")
    apart = cut(placed.join(mixed, "value", "left_semi").join(head, "value"))
    few = apart.where(F.col("members") <= SMALL)
    left, right = few.alias("l"), few.alias("r")
    more = (
        left.join(right, F.col("l.value") == F.col("r.value"))
        .where("l.id < r.id and l.root != r.root")
        .where(f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n)")
        .select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
        .distinct()
        .join(pairs, ["a", "b"], "left_anti")
    )
    late = cut(_verified(more, classes, sets, k, percent, slack).union(_dense(apart.where(F.col("members") > SMALL), sets, percent)))
    if not late.isEmpty():
        found = cut(components(links.union(late)))
    # smallest document of each class, then of each component
    lows = classes.join(found.select(F.col("node").alias("id"), "root"), "id", "left").select(
        "sig", "low", F.coalesce("root", "id").alias("root")
    )
    smallest = lows.groupBy("root").agg(F.min("low").alias("best"))
    named = lows.join(smallest, "root").select(F.col("sig").alias("s"), "best")
    out = rows.select("id0", "__text", "__row", "n_shingles", "sig").join(named, F.col("sig") == F.col("s"), "left")
    component = F.when(F.col("sig").isNull(), F.col("id0")).otherwise(F.col("best.id"))
    kept = (
        F.when(F.col("sig").isNull(), F.lit(True))
        .when(F.col("best.nameless"), F.col("__row") == F.col("best.row"))
        .otherwise(F.col("id0").eqNullSafe(F.col("best.id")) & (F.col("__text") == F.col("best.text")))
    )
    return out.select(
        F.col("id0").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        kept.alias("kept"),
        "__text",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of `docs` with one document per group of near duplicates: the one of the
    smallest id stays. Rows that repeat a document's id and text are that document; rows
    without an id are documents of their own."""
    found = _decided(docs, id_col, text_col, **options).where("kept")
    found = cut(found.select(F.col(id_col).alias("__id"), F.col("__text").alias("__kept"), (F.col("n_shingles") == 0).alias("__wordless")).distinct())
    same = F.xxhash64(docs[text_col]) == F.col("__kept")
    named = docs.where(docs[id_col].isNotNull()).join(found.where("__id is not null"), (docs[id_col] == F.col("__id")) & same, "left_semi")
    nameless = docs.where(docs[id_col].isNull()).join(found.where("__id is null"), same).drop("__id")
    # texts without words are no copies of each other
    single = nameless.where("not __wordless").dropDuplicates(["__kept"])
    return named.union(nameless.where("__wordless").union(single).drop("__kept", "__wordless"))
