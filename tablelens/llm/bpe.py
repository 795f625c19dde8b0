"""Byte-level BPE encoding and decoding with a given rank file.

Pre-tokenisation runs without a regular expression: every code point gets a class from an
array, each class is a transition function on eight states, and an associative scan of
these functions (rows of a matrix first, then over the rows, then inside the rows again)
yields the state before every code point, from which the boundaries follow. The slices
go through a cache of merged pieces; pieces met for the first time are merged together,
one numpy round per merge. Token ends (byte offsets) are kept for decoding.

Defined results: a null or empty text has no tokens; other columns are passed through."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, list_column, slice_hashes

# classes of code points
_L, _N, _O, _W, _SP, _WS, _A1, _A2 = range(8)
# states: piece ended, in letters, numbers, others, white space, after a joining space,
# one and two more characters of a contraction
_E, _SL, _SN, _SO, _SW, _SJ, _C1, _C2 = range(8)

# Code points with the property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def class_table() -> np.ndarray:
    """Class of every code point by its general category."""
    table = np.full(0x110000, _O, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = _L
        elif kind == "N":
            table[cp] = _N
    table[WHITE_SPACE] = _W
    return table


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a piece) by state and class; classes 8 to 15 are those of a
    text's first code point, whose incoming state is always `ended`."""
    target = {_L: _SL, _N: _SN, _O: _SO, _W: _SW, _SP: _SJ, _WS: _E}
    nxt, start = np.zeros((8, 16), np.uint8), np.zeros((8, 16), bool)
    for s in range(8):
        for c in range(8):
            if s in (_C1, _C2):
                nxt[s, c] = _C1 if s == _C2 else _E
            elif c in (_A1, _A2):
                inside = s in (_SO, _SJ)
                nxt[s, c] = _SO if inside else (_C1 if c == _A1 else _C2)
                start[s, c] = s != _SO and s != _SJ
            else:
                nxt[s, c] = target[c]
                joins = {_L: (_SL, _SJ), _N: (_SN, _SJ), _O: (_SO, _SJ), _W: (_SW,)}.get(c, ())
                start[s, c] = s not in joins
    nxt[:, 8:] = nxt[_E, :8]
    start[:, 8:] = True
    return nxt, start


_NEXT, _START = _machine()
_CLASSES: np.ndarray | None = None


def scan(classes: np.ndarray, width: int = 128) -> np.ndarray:
    """Whether a piece starts at each position: blocked associative scan of transitions."""
    n = len(classes)
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat = _NEXT.ravel()
    # 1. each row's composed function: state at its start -> state at its end
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        whole = flat[(whole << 4) | column[:, None]]
    # 2. inclusive scan of these functions by doubling (composition is associative)
    step = 1
    while step < rows:
        later = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), axis=1)
        whole = np.concatenate([whole[:step], later])
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = whole[:-1, _E]
    # 3. states and boundaries inside the rows
    out = np.empty((width, rows), bool)
    starts = _START.ravel()
    for j, column in enumerate(grid):
        at = (state << 4) | column
        out[j] = starts[at]
        state = flat[at]
    return out.T.reshape(-1)[:n]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces of texts in one UTF-8 buffer; none crosses texts."""
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = class_table()
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cps = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])
    cls = _CLASSES[cps]
    n = len(cls)
    is_first = np.zeros(n + 2, bool)
    is_first[first] = True
    is_first[n:] = True
    # white space followed by something else in the same text: its last code point stands apart
    space = cls == _W
    follows = np.zeros(n, bool)
    follows[:-1] = ~space[1:]
    last = space & follows & ~is_first[1 : n + 1]
    cls[last & (cps == 32)] = _SP
    cls[last & (cps != 32)] = _WS
    # apostrophes that may begin a contraction
    at = np.flatnonzero(cps == 39)
    if len(at):
        padded = np.concatenate([cps, [0, 0]])
        one = np.where(is_first[at + 1], 0, padded[at + 1])
        two = np.where(is_first[at + 1] | is_first[at + 2], 0, padded[np.minimum(at + 2, n + 1)])
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        cls[at[short]] = _A1
        cls[at[long & ~short]] = _A2
    starts = lead[scan(cls | (is_first[:n].astype(np.uint8) << 3))]
    return starts, np.concatenate([starts[1:], [len(data)]])


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each kind of slice, kind of each slice). Slices are put
    together by a 64-bit hash, and their bytes are compared; if a hash should ever join
    unequal slices, every slice is its own kind."""
    hashes = slice_hashes(data, starts, ends)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    first = order[new]
    size = ends - starts
    model = first[kind]
    same = size[model] == size
    if same.all():
        shift = np.repeat(starts[model] - starts, size)
        own = np.arange(len(data)) if starts[0] == 0 and size.sum() == len(data) else np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
        if np.array_equal(data[own + shift], data[own]):
            return first, kind
    return np.arange(len(starts)), np.arange(len(starts))


class Ranks:
    """A rank file with its pair table and a bounded cache of merged pieces."""

    #: Bytes of cached pieces and ids; beyond this the cache starts anew (results do not depend on it).
    CACHE = 24 << 20
    #: Pieces up to this length are merged together; longer ones one by one with a heap.
    WIDTH = 48

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        by_id: list[bytes] = [b""] * size
        for token, i in self.ranks.items():
            by_id[i] = token
            self.length[i] = len(token)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(i)
        self.pairs = pd.Index(np.array(keys, np.int64))
        self.pair_rank = np.array([*values, np.iinfo(np.int64).max], np.int64)  # the last is `no such pair`
        self.pair_dict = dict(zip(keys, values, strict=True))
        self.clear()

    def clear(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.held = 0
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pair_rank[self.pairs.get_indexer(left << 20 | right)]

    def _merge_long(self, piece: bytes) -> list[int]:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n, none = len(ids), -1
        nxt, prv, alive = [*range(1, n), none], [none, *range(n - 1)], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair_dict.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j == none or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = r, False
            nxt[i] = nxt[j]
            if nxt[j] != none:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x != none and y != none and (q := self.pair_dict.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def _merge_short(self, group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in turn, ids per piece). Pieces are merged together: in each
        round every piece merges its leftmost pair of lowest rank, and only the ranks beside
        it are looked up again."""
        lengths = np.array([len(p) for p in group])
        width = int(lengths.max())
        buf = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in group), np.uint8).reshape(-1, width)
        ids = self.single[buf]
        none = np.iinfo(np.int64).max
        rank = np.full((len(group), max(1, width - 1)), none)
        if width > 1:
            inside = np.arange(width - 1) < (lengths - 1)[:, None]
            rank[inside] = self._rank(ids[:, :-1][inside], ids[:, 1:][inside])
        final, final_lengths = np.zeros((len(group), width), np.int32), np.zeros(len(group), np.int64)
        rows, cols, rcols = np.arange(len(group)), np.arange(width), np.arange(rank.shape[1])
        while len(rows):
            j = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), j]
            done = best == none
            if done.any():
                final[rows[done]], final_lengths[rows[done]] = ids[done], lengths[done]
                keep = ~done
                rows, ids, rank, lengths, j, best = rows[keep], ids[keep], rank[keep], lengths[keep], j[keep], best[keep]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            shifted = np.concatenate([ids[:, 1:], ids[:, -1:]], axis=1)
            ids = np.where(cols > j[:, None], shifted, ids)
            ids[at, j] = best
            shifted = np.concatenate([rank[:, 1:], np.full((len(rows), 1), none)], axis=1)
            rank = np.where(rcols >= j[:, None], shifted, rank)
            lengths = lengths - 1
            left = j > 0
            if left.any():
                rank[at[left], j[left] - 1] = self._rank(ids[at[left], j[left] - 1], ids[at[left], j[left]])
            right = j < lengths - 1
            if right.any():
                rank[at[right], j[right]] = self._rank(ids[at[right], j[right]], ids[at[right], j[right] + 1])
        return final[cols < final_lengths[:, None]], final_lengths

    def _learn(self, new: list[bytes]) -> None:
        groups: dict[int, list[bytes]] = {}
        for p in new:  # 0: known as a whole; -1: long; others by length
            groups.setdefault(0 if p in self.ranks else -1 if len(p) > self.WIDTH else (len(p) + 3) // 4, []).append(p)
        for key, members in groups.items():
            if key == 0:
                flat = np.fromiter(map(self.ranks.__getitem__, members), np.int32, len(members))
                count = np.ones(len(members), np.int64)
            elif key == -1:
                merged = [self._merge_long(p) for p in members]
                flat, count = np.concatenate(merged).astype(np.int32), np.array([len(m) for m in merged], np.int64)
            else:
                flat, count = self._merge_short(members)
            base = len(self.start)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])
            self.cache.update(zip(members, range(base, base + len(members)), strict=True))
            self.held += sum(map(len, members)) + 100 * len(members) + 4 * len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a buffer, and the number of ids of each text."""
        starts, ends = pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        first, which = distinct_slices(data, starts, ends)
        slices = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if self.held > self.CACHE:
            self.clear()
        if new := list(dict.fromkeys(p for p in slices if p not in self.cache)):
            self._learn(new)
        codes = np.fromiter(map(self.cache.__getitem__, slices), np.int64, len(slices))[which]
        count = self.count[codes]
        end = np.cumsum(count)
        ids = self.flat[np.repeat(self.start[codes] - (end - count), count) + np.arange(end[-1])]
        row = np.searchsorted(offsets, starts, side="right") - 1
        return ids, np.bincount(row, count, len(offsets) - 1).astype(np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        size = self.length[ids]
        end = np.cumsum(size)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.bytes[np.repeat(self.offset[ids] - (end - size), size) + np.arange(end[-1])]


_LOADED: dict[str, Ranks] = {}


def load_ranks(path: str) -> Ranks:
    """The rank file, read once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Ranks(path)
    return _LOADED[path]


def default_path() -> str:
    """The rank file installed with the tokenizers' package on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(df: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """Replaces nothing and adds `token_ids` (array of int) and `token_ends` (array of int:
    the byte offset behind each token). Clashing columns of those names are overwritten."""
    path = path or default_path()
    df = df.drop("token_ids", "token_ends")
    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*df.schema.fields, T.StructField("token_ids", ints), T.StructField("token_ends", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_ranks(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi, data, offsets in chunks(column):
                ids, count = bpe.encode(data, offsets)
                ends = np.cumsum(bpe.length[ids])
                ends = ends - np.repeat(offsets[:-1], count)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, list_column(ids, count, pa.int32()), list_column(ends.astype(np.int32), count, pa.int32())],
                    names=[*part.schema.names, "token_ids", "token_ends"],
                )

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """Adds `decoded` (binary) from `token_ids`; a null list decodes to no bytes."""
    path = path or default_path()
    df = df.drop("decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_ranks(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("token_ids"))
            out = [bpe.decode(_ids(column, k)).tobytes() for k in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, schema)


def _ids(column, k: int) -> np.ndarray:
    if not column.is_valid()[k].as_py():
        return np.zeros(0, np.int32)
    a, b = column.offsets[k].as_py(), column.offsets[k + 1].as_py()
    return column.values.to_numpy(zero_copy_only=False)[a:b]


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of an encoded frame: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_ranks(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("token_ids"))
            offsets = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False)
            ids_hex, text_hex = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                ids = values[a:b]
                ids_hex.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(ids).tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(np.diff(offsets).astype(np.int64)), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    doc = df.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", doc), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select("doc_id", "token_ids").mapInArrow(run, schema)
