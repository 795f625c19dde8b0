"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of rows inside one task (about `common.CHUNK_BYTES` of text). Its words
become symbols: the number of the word in the benchmark's vocabulary, or 0. A window can
only occur where symbols are not 0, so the index is built over the maximal runs of known
words that are long enough, separated by 0; nothing that could match is left out. The
suffix array of these symbols gives the Burrows-Wheeler transform, a wavelet matrix answers
its rank queries, all windows are searched backwards together, and occurrences are located
by walking to sampled suffix positions. The words of each occurrence are compared once more.

The benchmark is the stated query set: it is brought to the tasks in blocks of at most
`BLOCK_BYTES` of text, one pass over the documents per block (one for any usual benchmark).

Defined results: null or empty texts have no words and no hits; items without words match
nothing; items with a null id mark words but are not listed; repeated item ids are listed
once; rows with equal doc_id are judged one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, byte_table, chunks, cut, list_column, runs, slice_hashes

#: Consecutive words of a window.
WINDOW = 10
#: Benchmark text brought to the tasks at once.
BLOCK_BYTES = 16 << 20
#: One suffix position in so many is kept.
SAMPLE = 8

_WORD = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
_ADDED = ["n_words", "n_hit", "hit_spans", "hit_items"]


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of one text."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = runs(_WORD[data], np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


class Queries:
    """The distinct windows of some items, over a vocabulary numbered from 1."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owned = owners.setdefault(tuple(words[i : i + window]), set())
                if item is not None:
                    owned.add(item)
        self.windows = sorted(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        vocabulary = sorted({w for win in self.windows for w in win})
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.size = len(vocabulary) + 1
        self.symbols = [np.array([number[w] for w in win], np.int64) for win in self.windows]
        self.shortest = min((len(w) for w in self.windows), default=0)
        raw = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum([len(w) for w in vocabulary]).astype(np.int64) if vocabulary else np.zeros(0, np.int64)
        starts = ends - np.array([len(w) for w in vocabulary], np.int64)
        hashes = slice_hashes(raw, starts, ends)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order + 1
        self.seen = np.zeros(1 << 16, bool)  # by the first 16 bits: most words end here
        self.seen[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def number(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        known = self.hashes[at] == hashes[maybe]
        out[maybe[known]] = self.numbers[at[known]]
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; the end of the text sorts first."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        key = rank * (n + 2)
        key[:-step or None] += np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])[: n - step] if step < n else 0
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.ones(n, np.int64)
        fresh[1:] = ranked[1:] != ranked[:-1]
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n or step >= n:
            return order
        step *= 2


class FMIndex:
    """Counts and locates patterns in a sequence of symbols 0 .. size-1."""

    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE):
        text = np.concatenate([text, [-1]]) + 1  # the end is smaller than all
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.levels = max(1, int(size).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size + 1))])
        # wavelet matrix: one bit per level, zeros before ones at the next level
        self.ones, self.zeros = [], []
        column = self.bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (column >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            column = column[np.argsort(bit, kind="stable")]
        self.marked = np.concatenate([[0], np.cumsum(order % sample == 0)]).astype(np.int32)
        self.sampled = order[order % sample == 0]

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first `end` symbols of the transform."""
        lo, hi = np.zeros(len(end), np.int64), end.astype(np.int64)
        for ones, zeros, level in zip(self.ones, self.zeros, range(self.levels - 1, -1, -1), strict=True):
            bit = (symbol >> level) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns of one length (a matrix), searched backwards together."""
        k, width = patterns.shape
        lo, hi = np.zeros(k, np.int64), np.full(k, len(self.bwt), np.int64)
        live = np.arange(k)
        for j in range(width - 1, -1, -1):
            c = patterns[live, j] + 1
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps backwards to a sampled suffix."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, todo = rows.astype(np.int64).copy(), np.arange(len(rows))
        while len(todo):
            here = at[todo]
            found = self.marked[here + 1] > self.marked[here]
            done = todo[found]
            out[done] = self.sampled[self.marked[at[done]]] + steps[done]
            todo = todo[~found]
            here = at[todo]
            c = self.bwt[here]
            at[todo] = self.first[c] + self.rank(c, here)
            steps[todo] += 1
        return out


def _known_runs(symbols: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of the long enough runs, each followed by 0; the word behind each symbol)."""
    known = symbols > 0
    edge = np.ones(len(symbols), bool)
    edge[1:] = (row[1:] != row[:-1]) | ~known[:-1]
    starts = np.flatnonzero(known & edge)
    stop = np.ones(len(symbols), bool)
    stop[:-1] = (row[1:] != row[:-1]) | ~known[1:]
    ends = np.flatnonzero(known & stop) + 1
    size = ends - starts
    keep = size >= least
    starts, size = starts[keep], size[keep]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = size + 1
    end = np.cumsum(width)
    word = np.repeat(starts - (end - width), width) + np.arange(end[-1])
    text = symbols[np.minimum(word, len(symbols) - 1)]
    text[end - 1] = 0
    return text, word


def find(data: np.ndarray, offsets: np.ndarray, queries: Queries) -> tuple:
    """For the texts of one buffer: words per text, hit words, byte spans (row, start, end)
    of merged hits, and (row, window) of occurrences."""
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, row = runs(_WORD[data], offsets)
    n_words = np.bincount(row, minlength=n)
    none = np.zeros(0, np.int64)
    empty = n_words, np.zeros(n, np.int64), (none, none, none), (none, none)
    if not len(starts) or not queries.windows:
        return empty
    text, word = _known_runs(queries.number(slice_hashes(data, starts, ends)), row, queries.shortest)
    if not len(text):
        return empty
    index = FMIndex(text, queries.size)
    at_word, at_window = [], []
    by_width: dict[int, list[int]] = {}
    for k, w in enumerate(queries.symbols):
        by_width.setdefault(len(w), []).append(k)
    raw = data.tobytes()
    for members in by_width.values():
        lo, hi = index.search(np.stack([queries.symbols[k] for k in members]))
        count = hi - lo
        total = int(count.sum())
        if total:
            end = np.cumsum(count)
            rows = np.repeat(lo - (end - count), count) + np.arange(total)
            at_word.append(word[index.locate(rows)])
            at_window.append(np.repeat(np.array(members), count))
    if not at_word:
        return empty
    first, window = np.concatenate(at_word), np.concatenate(at_window)
    width = np.array([len(w) for w in queries.windows])[window]
    same = np.fromiter(
        (
            all(raw[starts[f + j] : ends[f + j]] == w for j, w in enumerate(queries.windows[k]))
            for f, k in zip(first.tolist(), window.tolist(), strict=True)
        ),
        bool,
        len(first),
    )
    first, window, width = first[same], window[same], width[same]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + width, -1)
    hit = np.cumsum(cover[:-1]) > 0
    n_hit = np.bincount(row[hit], minlength=n)
    # merge neighbouring hit words of a text into spans from first to last byte
    after = np.zeros(len(hit), bool)
    after[1:] = hit[:-1] & (row[1:] == row[:-1])
    before = np.zeros(len(hit), bool)
    before[:-1] = hit[1:] & (row[1:] == row[:-1])
    s, e = np.flatnonzero(hit & ~after), np.flatnonzero(hit & ~before)
    base = offsets[row[s]]
    return n_words, n_hit, (row[s], starts[s] - base, ends[e] - base), (row[first], window)


def _lists(column, n: int) -> list[list]:
    return [x or [] for x in column.to_pylist()] if column is not None else [[] for _ in range(n)]


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """Adds n_words, n_hit, hit_spans (array of int: start, end, start, end ... in bytes of
    the UTF-8 text, merged) and hit_items (item ids as strings, sorted). Columns of these
    names in the input are overwritten; others are passed through."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    docs = docs.drop(*_ADDED)
    if blocks > 1:
        items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    for block in range(blocks):
        part = items.where(F.col("block") == block) if blocks > 1 else items
        docs = _pass(docs, [(r.item, r.text) for r in part.select("item", "text").collect()], window, text_col)
        if block + 1 < blocks:  # this block is done before the next one comes to the driver
            docs = cut(docs)
    return docs


def _pass(docs: DataFrame, items: list, window: int, text_col: str) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name not in _ADDED]
    again = "n_hit" in docs.columns
    schema = T.StructType(
        [
            *kept,
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("hit_spans", T.ArrayType(T.IntegerType())),
            T.StructField("hit_items", T.ArrayType(T.StringType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(items, window)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(batch.schema.get_field_index(text_col))):
                part, n = batch.slice(lo, hi - lo), hi - lo
                n_words, n_hit, (srow, sa, sb), (orow, owin) = find(data, offsets, queries)
                if again:  # hits of earlier blocks
                    old_spans = _lists(part.column(part.schema.get_field_index("hit_spans")), n)
                    old_items = _lists(part.column(part.schema.get_field_index("hit_items")), n)
                else:
                    old_spans, old_items = [[]] * n, [[]] * n
                names: dict[int, set] = {}
                for r, k in {*zip(orow.tolist(), owin.tolist(), strict=True)}:
                    names.setdefault(r, set()).update(queries.owners[k])
                new: dict[int, list] = {}
                for r, a, b in zip(srow.tolist(), sa.tolist(), sb.tolist(), strict=True):
                    new.setdefault(r, []).append((a, b))
                spans, found = [], []
                for r in range(n):
                    if not old_spans[r] and r not in new:
                        spans.append([])
                    else:
                        old = old_spans[r]
                        spans.append(_merged([*zip(old[::2], old[1::2], strict=True), *new.get(r, [])]))
                        if old and r in new:
                            n_hit[r] = _words_within(LOWER[data[offsets[r] : offsets[r + 1]]], spans[r])
                        elif old:
                            n_hit[r] = part.column(part.schema.get_field_index("n_hit"))[r].as_py()
                    found.append(sorted(names.get(r, set()) | set(old_items[r])))
                counts = np.array([len(x) for x in spans])
                own = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays(
                    [
                        *own,
                        pa.array(n_words.astype(np.int64)),
                        pa.array(n_hit.astype(np.int64)),
                        list_column(np.array([v for x in spans for v in x], np.int32), counts, pa.int32()),
                        pa.array(found, pa.list_(pa.string())),
                    ],
                    names=[*[f.name for f in kept], *_ADDED],
                )

    return docs.mapInArrow(run, schema)


def _words_within(data: np.ndarray, spans: list[int]) -> int:
    starts, _, _ = runs(_WORD[data], np.array([0, len(data)]))
    return int(sum(np.searchsorted(starts, b) - np.searchsorted(starts, a) for a, b in zip(spans[::2], spans[1::2], strict=True)))


def digest(annotated: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return annotated.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_spans(annotated: DataFrame, text_col: str = "text") -> DataFrame:
    """The text without its hit spans (a line break marks each cut); added columns go."""
    spans = F.col("hit_spans")
    size = F.octet_length(text_col)
    points = F.concat(F.array(F.lit(0)), spans, F.array(size))
    raw = F.col(text_col).cast("binary")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(spans), F.lit(2)),
        lambda i: F.decode(F.substring(raw, F.get(points, i) + 1, F.get(points, i + 1) - F.get(points, i)), "UTF-8"),
    )
    text = F.when(F.size(spans) > 0, F.array_join(pieces, "\n")).otherwise(F.col(text_col))
    return annotated.withColumn(text_col, text).drop(*_ADDED)


