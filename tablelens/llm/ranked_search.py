"""Ranked lexical search over bit-sliced Bloom signatures, exact to the last rank.

Index (`build_index`, independent of queries): documents of similar size are put into blocks
of at most `DOCS` documents and about `BYTES` bytes. A document's signature holds its terms
and, as elements of their own, the terms that occur at least 2, 3, 5 or 9 times (`LEVELS`).
The signatures of a block are stored by bit position: row r is a bitmap of the documents
that have bit r set. The width grows with the block's largest document, so long documents do
not fill their signature.

Search: (1) one pass counts N, L and the df of the query terms. (2) For every block, the AND
of a term's rows is a bitmap of the documents that may hold it (never too few); the weights
of these bitmaps, by level and document length, add up to an upper bound of each document's
score. The pass reads the signatures only and keeps each item's best bounds. (3) The exact
scores of these documents give a threshold: a k-th best score that is reached. (4) A second
pass over the signatures lists every document whose bound is not below the threshold, and
all of these are rescored exactly from their texts. A document is left out only if its bound
proves that it is not among the k best.

Query items come in blocks of about `ITEM_BYTES` bytes of text, one after another; only one
block's terms are in memory, and all terms of a block meet a signature in runs of `RUN`.

Defined results: a null text has no terms, is not counted and never found; an item without
terms has no results; equal scores go by ascending doc_id, null first; repeated documents are
ranked each by itself; so are repeated items; an empty table gives no rows. Other columns are
not read."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, mix

#: Documents and text bytes of a block, rows per element, bits per element of the fullest signature.
DOCS, BYTES, ROWS, BITS = 512, 1 << 21, 4, 12
#: Term frequencies that have an element of their own.
LEVELS = (1, 2, 3, 5, 9)
#: Text bytes of the items searched at once; terms that meet a signature at once.
ITEM_BYTES, RUN = 1 << 20, 4096
#: Constants of the score.
K_BASE, B_PERCENT, SCALE = 100, 50, 10**9
#: Bytes of terms whose hashes a worker keeps.
_CACHED = 1 << 22
# separators become blanks, A-Z become a-z; all bytes of other code points belong to terms
_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


class _Hashes(dict):
    """64-bit hash of a term, kept up to a number of bytes."""

    held = 0

    def __missing__(self, term: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(term)
        if self.held > _CACHED:
            self.clear()
            self.held = 0
        if len(term) < 64:
            self[term] = value
            self.held += len(term)
        return value


def _rows(hashes: np.ndarray, level: int, width: int) -> list[np.ndarray]:
    """The signature rows of elements (term, level)."""
    with np.errstate(over="ignore"):
        h = mix(hashes + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(i) * step) & np.uint64(width - 1)).astype(np.int64) for i in range(ROWS)]


def _block(ids: list, texts: list[bytes], hashes: _Hashes) -> tuple:
    """(ids, n, width, slices, texts) of one block."""
    counts, places, elements = [], [], []
    for d, text in enumerate(texts):
        words = terms(text)
        found = Counter(words)
        h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
        tf = np.fromiter(found.values(), np.int64, len(found))
        counts.append(len(words))
        size = 0
        for level in LEVELS:
            own = h[tf >= level]
            size += len(own)
            places.append((d, level, own))
        elements.append(size)
    width = 1 << max(6, math.ceil(math.log2(max(1, BITS * max(elements)))))
    bits = np.zeros((width, len(texts)), bool)
    for d, level, own in places:
        for rows in _rows(own, level, width):
            bits[rows, d] = True
    return ids, counts, width, np.packbits(bits, axis=1, bitorder="little").tobytes(), texts


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """block, ids, n (terms with repeats), width, slices, texts: written to the shared folder."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType
    schema = f"ids array<{kind.simpleString()}>, n array<bigint>, width bigint, slices binary, texts array<binary>"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            size = np.array([len(t.as_buffer()) for t in texts], np.int64)
            order = np.argsort(size, kind="stable")
            lo = 0
            while lo < len(order):
                # one block: documents of about one size, within both bounds
                most = size[order[lo : lo + DOCS]]
                fits = (most <= 2 * most[0] + 4096) & (np.cumsum(most) <= BYTES)
                n = max(1, len(most) if fits.all() else int(np.argmin(fits)))
                own = [int(i) for i in order[lo : lo + n]]
                lo += n
                one = _block([ids[i].as_py() for i in own], [texts[i].as_py() for i in own], hashes)
                yield pa.record_batch(
                    [pa.array([one[0]], batch_type), pa.array([one[1]], pa.list_(pa.int64())), pa.array([one[2]], pa.int64()), pa.array([one[3]], pa.binary()), pa.array([one[4]], pa.list_(pa.binary()))],
                    ["ids", "n", "width", "slices", "texts"],
                )

    batch_type = pa.list_(to_arrow_type(kind))
    return cut(rows.mapInArrow(blocks, schema).withColumn("block", F.monotonically_increasing_id()))


class Queries:
    """The terms of some items with their weights, as arrays."""

    def __init__(self, items: list[tuple[int, bytes]], df: dict[bytes, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.numbers, self.weights = [], []
        for number, text in items:
            own = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if t in df}
            if own:
                self.numbers.append(number)
                self.weights.append(own)

    def runs(self) -> list[tuple]:
        """(hashes of distinct terms, place of each reference, its weight, item starts, items)
        of runs of RUN references."""
        flat = [(i, t, w) for i, own in enumerate(self.weights) for t, w in own.items()]
        out = []
        for lo in range(0, len(flat), RUN):
            part = flat[lo : lo + RUN]
            distinct = {t: j for j, t in enumerate(dict.fromkeys(t for _, t, _ in part))}
            item = np.array([i for i, _, _ in part])
            starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
            out.append((
                np.array([xxhash.xxh3_64_intdigest(t) for t in distinct], np.uint64),
                np.array([distinct[t] for _, t, _ in part]), np.array([w for _, _, w in part], np.int64), starts, item[starts],
            ))
        return out

    def lengths(self, n: list[int]) -> list[int]:
        """m of documents of n terms."""
        return [K_BASE - B_PERCENT + (B_PERCENT * x * self.n_docs) // max(1, self.n_terms) for x in n]

    def score(self, text: bytes, wanted: list[int]) -> list[int]:
        """Exact scores of one document for the items at the places `wanted`."""
        words = terms(text)
        tf, m = Counter(words), self.lengths([len(words)])[0]
        part = {t: (SCALE * f) // (1000 * f + 20 * m) for t, f in tf.items()}
        return [sum(w * part[t] for t, w in self.weights[i].items() if t in part) for i in wanted]


def bounds(runs: list[tuple], items: int, lengths: list[int], width: int, slices: bytes) -> np.ndarray:
    """Upper bounds of the scores, items x documents of a block."""
    n = len(lengths)
    table = np.frombuffer(slices, np.uint8).reshape(width, -1)
    m = np.array(lengths, np.int64)
    # a term found at one level and not at the next occurs less often than the next level says
    most = [*[level - 1 for level in LEVELS[1:]], None]
    value = [np.full(n, SCALE // 1000, np.int64) if f is None else (SCALE * f) // (1000 * f + 20 * m) for f in most]
    gain = [value[0], *[b - a for a, b in zip(value, value[1:])]]
    out = np.zeros((items, n), np.int64)
    for hashes, place, weight, starts, item in runs:
        each = np.zeros((len(hashes), n), np.int64)
        alive, here = np.arange(len(hashes)), None
        for level, more in zip(LEVELS, gain):
            rows = _rows(hashes[alive], level, width)
            found = table[rows[0]]
            for r in rows[1:]:
                found = found & table[r]
            found = found if here is None else found & here
            some = found.any(axis=1)
            alive, here = alive[some], found[some]
            if not len(alive):
                break
            each[alive] += np.unpackbits(here, axis=1, count=n, bitorder="little") * more
        out[item] += np.add.reduceat(each[place] * weight[:, None], starts, axis=0)
    return out


def _count(index: DataFrame, items: list[tuple[int, bytes]]) -> dict[bytes, int]:
    """df of the items' terms that any document holds."""
    vocabulary = {t for _, text in items for t in terms(text)}
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, df = shared.value, Counter()
        for batch in batches:
            for texts in batch.column(0):
                for text in texts:
                    df.update(wanted.intersection(terms(text.as_py())))
        yield pa.record_batch([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], ["term", "df"])

    found = index.select("texts").mapInArrow(count, "term binary, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in found.collect()}  # at most the vocabulary of ITEM_BYTES


def _candidates(index: DataFrame, shared, least, k: int) -> DataFrame:
    """item, block, slot of the documents whose bound is at least least[item]; without `least`,
    the k best bounds of each item and task with the bound."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        runs, items = queries.runs(), len(queries.weights)
        best = np.zeros((items, 0), np.int64)
        where = np.zeros((items, 0), np.int64)
        blocks: list[int] = []
        floor = None if least is None else np.array(least.value, np.int64)[:, None]
        for batch in batches:
            for block, n, width, slices in zip(*[c.to_pylist() for c in batch.columns]):
                top = bounds(runs, items, queries.lengths(n), width, slices)
                if floor is not None:
                    item, slot = np.nonzero(top >= floor)
                    yield _found(item, np.full(len(item), block), slot, top[item, slot])
                    continue
                code = (len(blocks) << 32) | np.arange(len(n), dtype=np.int64)
                blocks.append(block)
                best = np.hstack([best, top])
                where = np.hstack([where, np.broadcast_to(code, top.shape)])
                if best.shape[1] > k:
                    keep = np.argpartition(-best, k - 1, axis=1)[:, :k]
                    best, where = np.take_along_axis(best, keep, 1), np.take_along_axis(where, keep, 1)
        if floor is None and blocks:
            item, at = np.nonzero(best > 0)
            code = where[item, at]
            yield _found(item, np.array(blocks, np.int64)[code >> 32], code & 0xFFFFFFFF, best[item, at])

    return index.select("block", "n", "width", "slices").mapInArrow(search, "item int, block bigint, slot int, bound bigint")


def _found(item, block, slot, bound) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(item.astype(np.int32)), pa.array(block.astype(np.int64)), pa.array(slot.astype(np.int32)), pa.array(bound)],
        ["item", "block", "slot", "bound"],
    )


def _rescored(index: DataFrame, candidates: DataFrame, shared) -> DataFrame:
    """item, doc_id, score (exact, above 0) of candidates; their texts come by a join on the block."""
    wanted = candidates.groupBy("block").agg(F.collect_list("item").alias("items"), F.collect_list("slot").alias("slots"))
    rows = index.select("block", "ids", "texts").join(wanted, "block").select("ids", "texts", "items", "slots")
    kind = index.schema["ids"].dataType.elementType

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts = batch.column(0)[i].values, batch.column(1)[i].values
                item = batch.column(2)[i].values.to_numpy()
                slot = batch.column(3)[i].values.to_numpy()
                order = np.argsort(slot, kind="stable")
                item, slot = item[order], slot[order]
                first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                score: list[int] = []
                for lo, hi in zip(first, [*first[1:], len(slot)]):
                    score += queries.score(texts[int(slot[lo])].as_py(), item[lo:hi].tolist())
                yield pa.record_batch(
                    [pa.array(item, pa.int32()), ids.take(pa.array(slot)), pa.array(score, pa.int64())], ["item", "doc_id", "score"]
                )

    schema = f"item int, doc_id {kind.simpleString()}, score bigint"
    return rows.mapInArrow(rescore, schema).where("score > 0")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of the index for each item."""
    spark = index.sparkSession
    sizes = index.select(F.explode("n").alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    numbered = cut(
        items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
        .withColumn("number", F.monotonically_increasing_id())
    )
    size = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    deal = F.pmod(F.xxhash64("number"), F.lit(max(1, blocks)))
    kind = index.schema["ids"].dataType.elementType
    out = None
    for b in range(blocks if sizes["docs"] else 0):
        own = [(r["number"], bytes(r["text"])) for r in numbered.where(deal == b).select("number", "text").collect()]
        queries = Queries(own, _count(index, own), sizes["docs"], sizes["terms"])
        if not queries.numbers:
            continue
        shared = spark.sparkContext.broadcast(queries)
        best = _candidates(index, shared, None, k)
        top = Window.partitionBy("item").orderBy(F.col("bound").desc(), "block", "slot")
        tried = cut(best.withColumn("nr", F.row_number().over(top)).where(F.col("nr") <= k))
        reached = _ranked(_rescored(index, tried, shared), k).where(F.col("rank") == k).select("item", "score").collect()
        least = [1] * len(queries.numbers)
        for r in reached:
            least[r["item"]] = r["score"]
        left = cut(_candidates(index, shared, spark.sparkContext.broadcast(least), k))
        names = spark.createDataFrame(list(enumerate(queries.numbers)), "item int, number bigint")
        found = _ranked(_rescored(index, left, shared), k).join(names, "item").select("number", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"number bigint, rank int, doc_id {kind.simpleString()}, score bigint")
    return numbered.select("number", "item_id").join(out, "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
