"""Removal of exact repeats of 200 bytes and more across a collection of texts, by the
Burrows-Wheeler transform and common prefixes of many short documents, built column-wise.

1. Dealing out. In every window of `LENGTH` bytes the k-mer with the smallest hash is its
   anchor; equal windows have equal anchors at equal offsets. The windows of one anchor
   are consecutive, so a text falls into segments, each aligned at its anchor, and every
   window lies in exactly one. Only counts per anchor decide what goes on: an anchor met
   once holds no repeat; if all segments of an anchor are equal (one digest), all their
   windows are repeats.
2. Building. The distinct segments of the other anchors are brought together in buckets of
   about `BUCKET` segments and form the documents of a collection: the last LENGTH bytes of
   each, sorted, are its end mark; then one symbol per document is inserted each round,
   right to left. A round moves sequentially over the transform and the common prefixes of
   the round before: a stable sort of the transform's symbols gives the places of the new
   suffixes, and one plus the smallest common prefix between two of them gives theirs.
   Neighbours with a common prefix of LENGTH bytes or more start with the same window.
   A bucket's two arrays are bounded by the bucket, so they stay in memory instead of files.
3. An anchor with more distinct segments than `HOT` is not gathered in a bucket: its windows
   are counted by a 128-bit digest each, in a grouped count.

Removed are all bytes that some repeated window covers. Defined results: null texts count as
empty and keep nothing; texts shorter than LENGTH have no window; equal texts of LENGTH bytes
or more remove each other whole, whatever their ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, cut, list_column, text_buffer

#: Bytes of a repeat.
LENGTH = 200
#: Bytes of an anchor (a power of two).
ANCHOR = 64
#: Segments in a bucket (on average), and distinct segments of one anchor in any bucket.
BUCKET, HOT = 2000, 2000
#: Tables up to this size are sent to all tasks; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position (k a power of two), by doubling."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        step = 1
        while step < k:
            h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
            h ^= h >> np.uint64(32)
            step *= 2
        return h * np.uint64(0x94D049BB133111EB)


def anchors(data: np.ndarray, length: int, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, first window) of the k-mers that are the leftmost smallest of a
    window of `length` bytes, in order; an anchor's windows reach to those of the next."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none
    h = kmer_hashes(data, k)
    key = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width, size = length - k + 1, 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if width > size:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], h[at[first]], first


def collection(heads: list[bytes], tails: np.ndarray, width: int = LENGTH) -> list[np.ndarray]:
    """For documents head + tail (tails: a matrix of `width` bytes each), the class of the
    window of `width` bytes that starts at each byte of the head, and at the tail: equal
    windows at equal distances from the end have equal classes.

    The transform holds the symbol before each suffix inserted so far (0: none)."""
    m = len(heads)
    rows = np.ascontiguousarray(tails).view(f"V{width}").ravel()
    order = np.argsort(rows, kind="stable") if m > 1 else np.zeros(m, np.int64)
    ranked = tails[order]
    unequal = ranked[1:] != ranked[:-1]
    shared = np.where(unequal.any(axis=1), unequal.argmax(axis=1), width)
    lengths = np.array([len(h) for h in heads], np.int64)
    symbols = np.frombuffer(b"".join(heads), np.uint8).astype(np.int64) + 1
    begin = np.cumsum(lengths) - lengths
    at = np.empty(m, np.int64)  # row of each document's latest suffix
    at[order] = np.arange(m)
    bwt = np.zeros(m, np.uint16)
    has = np.flatnonzero(lengths > 0)
    bwt[at[has]] = symbols[begin[has] + lengths[has] - 1]
    lcp = np.zeros(m, np.int16)
    lcp[1:] = shared
    for done in range(1, int(lengths.max(initial=0)) + 1):
        active = np.flatnonzero(lengths >= done)
        slots = at[active]
        by_slot = np.argsort(slots)
        fresh = np.zeros(len(bwt), bool)
        fresh[slots] = True
        # rows that start with a byte, in order: the slots of the transform by symbol
        source = np.argsort(bwt, kind="stable")[int((bwt == 0).sum()) :]
        is_new = np.concatenate([np.zeros(m, bool), fresh[source]])
        where = np.flatnonzero(is_new)
        owner = active[by_slot[np.searchsorted(slots[by_slot], source[where - m])]]
        n = m + len(source)
        new_bwt, new_lcp = np.empty(n, np.uint16), np.empty(n, np.int16)
        new_bwt[~is_new], new_lcp[~is_new] = bwt, lcp
        before = begin[owner] + lengths[owner] - done - 1
        new_bwt[where] = np.where(lengths[owner] > done, symbols[np.maximum(before, 0)], 0)
        # common prefixes of the new rows and of the rows behind them
        touched = np.unique(np.concatenate([where, where + 1]))
        touched = touched[touched < n]
        new_lcp[touched] = 0
        inner = touched[touched > m]
        low, high = source[inner - 1 - m], source[inner - m]
        same = bwt[low] == bwt[high]
        inner, low, high = inner[same], low[same], high[same]
        if len(inner):
            bounds = np.empty(2 * len(inner), np.int64)
            bounds[::2], bounds[1::2] = low + 1, high + 1
            least = np.minimum.reduceat(np.concatenate([lcp, [0]]), bounds)[::2]
            new_lcp[inner] = np.minimum(least + 1, width + 1)
        bwt, lcp = new_bwt, new_lcp
        at[owner] = where
    # classes in the order of rows, then back to documents by the same steps as in building
    group = np.cumsum(lcp < width) - 1
    out = [np.empty(len(h) + 1, np.int64) for h in heads]
    row = np.empty(m, np.int64)
    row[order] = np.arange(m)
    # the end marks stand first among the final rows, in their order; a row's predecessor is
    # the row that its symbol leads to
    leads = np.full(len(bwt), -1, np.int64)
    zeros = int((bwt == 0).sum())
    leads[np.argsort(bwt, kind="stable")[zeros:]] = np.arange(m, len(bwt))
    live = np.arange(m)
    step = 0
    while len(live):
        for d, g in zip(live.tolist(), group[row[live]].tolist(), strict=True):
            out[d][lengths[d] - step] = g
        live = live[lengths[live] > step]
        row[live] = leads[row[live]]
        step += 1
    return out


def _segments(spark_rows: DataFrame, length: int) -> DataFrame:
    """(k1, k2, lo, hi, p, h, seg): the segments of every text; windows start at lo .. hi."""
    schema = T.StructType(
        [
            T.StructField("k1", T.LongType()),
            T.StructField("k2", T.LongType()),
            *[T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in ("lo", "hi", "p")],
            *[T.StructField(c, T.ArrayType(T.LongType(), False)) for c in ("h", "seg")],
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            found: dict[str, list] = {c: [] for c in ("lo", "hi", "p", "h", "seg")}
            counts, lo_row, held = [], 0, 0
            for r in range(len(batch)):
                text = data[offsets[r] : offsets[r + 1]]
                p, h, first = anchors(text, length)
                last = np.concatenate([first[1:] - 1, [len(text) - length]]) if len(first) else first
                raw = text.tobytes()
                found["lo"].append(first.astype(np.int32))
                found["hi"].append(last.astype(np.int32))
                found["p"].append(p.astype(np.int32))
                found["h"].append(h.view(np.int64))
                # equal digests: equal bytes, aligned alike
                found["seg"].append(
                    np.array(
                        [hash_bytes(raw[a : b + length], a - q) for a, b, q in zip(first.tolist(), last.tolist(), p.tolist(), strict=True)],
                        np.int64,
                    )
                )
                counts.append(len(p))
                held += len(text)
                if held >= CHUNK_BYTES or r == len(batch) - 1:
                    n = np.array(counts)
                    part = batch.slice(lo_row, r + 1 - lo_row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0),
                            part.column(1),
                            *[list_column(np.concatenate(found[c]), n, pa.int32()) for c in ("lo", "hi", "p")],
                            *[list_column(np.concatenate(found[c]), n, pa.int64()) for c in ("h", "seg")],
                        ],
                        names=["k1", "k2", "lo", "hi", "p", "h", "seg"],
                    )
                    found, counts, lo_row, held = {c: [] for c in found}, [], r + 1, 0

    return spark_rows.mapInArrow(run, schema)


def hash_bytes(raw: bytes, salt: int) -> int:
    """A 64-bit digest of bytes and their alignment, as a signed integer."""
    return xxhash.xxh3_64_intdigest(raw, seed=salt & 0xFFFFFFFF) - (1 << 63)


def _sized(df: DataFrame, row_bytes) -> DataFrame:
    """The frame marked for broadcast if it is small, as it is otherwise."""
    size = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _bucket_spans(wanted: DataFrame, texts: DataFrame, total: int, length: int) -> DataFrame:
    """(k1, k2, start, end): repeats among the distinct segments `wanted` (h, seg, c, k1, k2,
    lo, hi, p), found by the collections' transforms."""
    per_text = cut(
        wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "seg", "c", "lo", "hi", "p")).alias("w"))
    )
    given = texts.join(per_text, ["k1", "k2"]).select("k1", "k2", "text", "w")
    buckets = max(1, -(-total // BUCKET))
    schema = "bucket int, h bigint, seg bigint, c bigint, k1 bigint, k2 bigint, lo int, hi int, p int, raw binary"

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            out: list[tuple] = []
            for r, (k1, k2, ws) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = data[offsets[r] : offsets[r + 1]].tobytes()
                # whole up to the common end LENGTH bytes behind the anchor, so tails align
                out += [
                    (w["h"] % buckets, w["h"], w["seg"], w["c"], k1, k2, w["lo"], w["hi"], w["p"], raw[w["lo"] : w["p"] + length])
                    for w in ws
                ]
            columns = list(zip(*out, strict=True)) or [()] * 10
            kinds = [pa.int32(), *[pa.int64()] * 5, *[pa.int32()] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["bucket", "h", "seg", "c", "k1", "k2", "lo", "hi", "p", "raw"],
            )

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["h", "seg"])
        heads, tails = [], np.zeros((len(part), length), np.uint8)
        for k, (raw, lo, p) in enumerate(zip(part["raw"], part["lo"], part["p"], strict=True)):
            heads.append(raw[: p - lo])
            tail = raw[p - lo :]
            tails[k, : len(tail)] = np.frombuffer(tail, np.uint8)
        classes = collection(heads, tails, length)
        # windows of different anchors differ, so classes are counted over the bucket
        size = np.bincount(np.concatenate([c[: hi - lo + 1] for c, lo, hi in zip(classes, part["lo"], part["hi"], strict=True)]))
        out = []
        for c, k1, k2, lo, hi, copies in zip(classes, part["k1"], part["k2"], part["lo"], part["hi"], part["c"], strict=True):
            if copies > 1:
                continue  # met more than once as a whole: all its windows are known repeats
            again = size[c[: hi - lo + 1]] > 1
            edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                out.append((k1, k2, lo + a, lo + b - 1 + length))
        return pd.DataFrame(out, columns=["k1", "k2", "start", "end"]).astype({"k1": "int64", "k2": "int64", "start": "int32", "end": "int32"})

    return given.mapInArrow(bring, schema).groupBy("bucket").applyInPandas(build, "k1 bigint, k2 bigint, start int, end int")


def _hot_spans(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The same for segments of anchors with very many distinct segments: every window is
    counted by its digest."""
    per_text = cut(wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("w")))
    given = texts.join(per_text, ["k1", "k2"]).select("k1", "k2", "text", "w")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for r, (k1, k2, ws) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = data[offsets[r] : offsets[r + 1]].tobytes()
                starts = [s for w in ws for s in range(w["lo"], w["hi"] + 1)]
                digests = [xxhash.xxh3_128_digest(raw[s : s + length]) for s in starts]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array(starts, pa.int32())],
                    names=["window", "k1", "k2", "start"],
                )

    every = cut(given.mapInArrow(windows, "window binary, k1 bigint, k2 bigint, start int").distinct())
    again = every.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    return every.join(again, "window").select("k1", "k2", "start", (F.col("start") + length).alias("end"))


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, spans): merged byte spans [start, end, start, end ...] of every text that has
    a repeat; texts comes with two hashes k1, k2 that stand for the text."""
    segments = cut(_segments(texts.where(F.octet_length("text") >= length).select("k1", "k2", "text"), length))
    zipped = F.explode(F.arrays_zip("lo", "hi", "p", "h", "seg")).alias("s")
    flat = segments.select("k1", "k2", zipped).select("k1", "k2", "s.*")
    met = flat.groupBy("h").agg(F.count("*").alias("n"), F.min("seg").alias("s0"), F.max("seg").alias("s1")).where("n > 1")
    met = met.select("h", (F.col("s0") == F.col("s1")).alias("alike"))
    again = cut(flat.join(met, "h"))
    mixed = again.where("not alike")
    kinds = cut(
        mixed.groupBy("h", "seg").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "lo", "hi", "p")).alias("one")).select("h", "seg", "c", "one.*")
    )
    size = kinds.groupBy("h").agg(F.count("*").alias("distinct"))
    kinds = cut(kinds.join(size, "h"))
    whole = again.where("alike").select("k1", "k2", "lo", "hi").union(
        mixed.join(kinds.where("c > 1").select("h", "seg"), ["h", "seg"], "left_semi").select("k1", "k2", "lo", "hi")
    )
    whole = whole.distinct().select("k1", "k2", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    normal = kinds.where(F.col("distinct") <= HOT).drop("distinct")
    hot = kinds.where(F.col("distinct") > HOT)
    spans = whole.union(_bucket_spans(normal, texts, normal.count(), length))
    if not hot.isEmpty():
        spans = spans.union(_hot_spans(hot, texts, length))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pairs in batch.column(2).to_pylist():
                merged: list[int] = []
                for a, b in sorted((x["start"], x["end"]) for x in pairs):
                    if merged and a <= merged[-1]:
                        merged[-1] = max(merged[-1], b)
                    else:
                        merged += [a, b]
                out.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["k1", "k2", "spans"])

    grouped = spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("pairs"))
    return cut(grouped.mapInArrow(merge, "k1 bigint, k2 bigint, spans array<int>"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: id, spans (array of int: removed bytes), n_bytes, kept (binary:
    the remaining bytes)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("k1", F.xxhash64("text", F.lit(1))).withColumn("k2", F.xxhash64(F.lit(2), "text"))
    spans = repeated_spans(texts.select("k1", "k2", "text"), length)
    joined = texts.join(_sized(spans, F.size("spans") * 4 + 32), ["k1", "k2"], "left").select("id", "text", "spans")
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("spans", T.ArrayType(T.IntegerType())),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("kept", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            spans = [x or [] for x in batch.column(2).to_pylist()]
            kept = []
            for r, cuts in enumerate(spans):
                raw = data[offsets[r] : offsets[r + 1]].tobytes()
                edges = [0, *cuts, len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.int32())), pa.array(np.diff(offsets)), pa.array(kept, pa.binary())],
                names=[id_col, "spans", "n_bytes", "kept"],
            )

    return joined.mapInArrow(run, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    return found.select(
        id_col,
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
