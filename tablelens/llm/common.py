"""Helpers shared by the operators: Arrow batches as byte buffers, word hashes,
lineage cuts in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task (one longer text is handled alone).
CHUNK_BYTES = 1 << 19
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. A local
    session that leaves it unset gets a temporary folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tablelens-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes a frame as Parquet into the shared folder and reads it again: later jobs
    start from these files, so a lost executor costs no recomputation of the lineage."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which null keys match; the key columns come from the left side."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = one if cond is None else cond & one
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows holding about `limit` bytes."""
    data, offsets = text_buffer(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of true bytes; no run crosses rows."""
    n = len(flag)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = offsets[:-1][offsets[:-1] < n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flag[:-1]
    before[first] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flag[1:]
    after[first[first > 0] - 1] = False
    starts = np.flatnonzero(flag & ~before)
    ends = np.flatnonzero(flag & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


#: Powers kept in a worker; longer buffers (one long text) get their own for the time being.
_KEPT = 1 << 20
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _made(n: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = np.full(n, _MULT, np.uint64), np.full(n, pow(_MULT, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(power, out=power), np.cumprod(inverse, out=inverse)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if n > _KEPT:
        return _made(n)
    if len(_POW) < n:
        _POW, _INV = _made(_KEPT)
    return _POW[:n], _INV[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte slice, from prefix sums of a polynomial."""
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def byte_table(keep) -> np.ndarray:
    """Boolean table over byte values."""
    return np.array([bool(keep(b)) for b in range(256)])


#: Lower-cases A-Z only.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def list_column(values: np.ndarray, counts: np.ndarray, kind) -> pa.ListArray:
    """A list column from flat values and the length of each row's list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, root), root being the smallest
    node reachable. Nodes without an edge do not appear.

    Each round replaces an edge (x, y) by edges from x's neighbourhood to its smallest
    member (large and small stars), so long chains halve and hubs stay fixed points. A
    neighbourhood is only ever reduced by `min` (a partial aggregate) and joined; it is
    never collected. The driver sees one count per round."""
    edges = cut(
        edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x != y").distinct()
    )
    while True:
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = (
            both.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        )
        # small star: a node and its smaller neighbours point to the smallest of them
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = (
            large.join(least, "x")
            .select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
            .select("e.x", "e.y")
            .where("x != y")
            .distinct()
        )
        after = cut(small)
        # stable when every node has one parent and no parent has a parent
        parents = after.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n"))
        chained = after.join(after.select(F.col("x").alias("y")).distinct(), "y", "left_semi").limit(1).count()
        many = parents.where("n > 1").limit(1).count()
        edges = after
        if not chained and not many:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).union(
                edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
            )
