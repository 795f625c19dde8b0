"""A trie of conversation prefixes by ROLLUP over positional turn-id columns.

1. A turn's id is a 128-bit digest of (role, text); texts are read once and not shuffled.
   Turns are numbered inside their conversation through range partitions of (conv_id,
   turn, id): a number is the row's place in its partition plus the rows of that
   conversation in earlier partitions, so one very long conversation is dealt over many
   tasks.
2. Every conversation is laid out in column blocks of `BLOCK` turns: one row per block with
   the columns t0, t1, ... A block is keyed by the node that the blocks before it lead to.
   That key is an exclusive-or of 120-bit digests of (block number, turn ids), a running
   aggregate inside slices of `SLICE` blocks plus the slices before, so that no block waits
   for another one.
3. One `GROUP BY block, key, ROLLUP (t0, t1, ...)` with `grouping_id()` aggregates all
   prefixes of all conversations at once: members and the smallest member of every node.
4. The sums over subtrees need no walk of the tree. The smallest member of a node stays the
   smallest below it on its own path, so every node is owned by one conversation and each
   conversation owns the end of its path. The words that a subtree saves are, summed over
   its members, the words of the member's turns from that depth on that it does not own;
   its leaves are the members that own a leaf. A second ROLLUP sums both.

Parents with very many children (a system prompt) are joined apart: those with more than a
thousandth of all nodes, so at most a thousand rows, are broadcast.

Defined results: rows without conv_id belong to no conversation; a null role or text is
empty; turns are ordered with null first, equal turns by their ids; repeated rows are turns
of their own; an empty table has no nodes, not even a root. Other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Turns in one column block.
BLOCK = 4
#: Blocks of one conversation in a slice of running aggregates.
SLICE = 4096
#: Conversations whose numbers share all but the last digit pair of `% GROUP` share their head.
GROUP, HEADS = 20, 4
_T = [f"t{i}" for i in range(BLOCK)]
_W = [f"w{i}" for i in range(BLOCK)]


def _digest(value: Column) -> Column:
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def _sixty_bits(hexadecimal: Column, part: int) -> Column:
    return F.conv(F.substring(hexadecimal, 1 + 15 * part, 15), 16, 10).cast("long")


def _block_digest(part: int) -> Column:
    ids = [F.coalesce(F.hex(t), F.lit("-")) for t in _T]
    return _sixty_bits(F.sha2(F.concat_ws(".", F.col("block").cast("string"), *ids), 256), part)


def _start_key(k1: Column, k2: Column) -> Column:
    """Key of the node at which a block starts."""
    return _digest(F.concat_ws(".", F.lit("block"), k1.cast("string"), k2.cast("string")))


def _node_key(level: int) -> Column:
    """Key of the node after the first `level` turns of a block."""
    if level == 0:
        return _start_key(F.col("k1"), F.col("k2"))
    if level == BLOCK:
        return _start_key(F.col("k1").bitwiseXOR(_block_digest(0)), F.col("k2").bitwiseXOR(_block_digest(1)))
    return _digest(F.concat_ws(".", F.lit("inside"), F.col("k1").cast("string"), F.col("k2").cast("string"), *[F.hex(t) for t in _T[:level]]))


def _by_level(level: Column, values: list[Column]) -> Column:
    out = F.when(level == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(level == i, v)
    return out


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, part, pos (from 0), id, words of every turn; `part` is its range partition."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = cut(
        turns.where("conv_id is not null").select(
            F.col("conv_id").cast("long"),
            "turn",
            _digest(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
            F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")).cast("long").alias("words"),
        )
    )
    parts = cut(rows.repartitionByRange("conv_id", "turn", "id").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select(
        "conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "id")
    return parts.withColumn("nr", F.row_number().over(inside)).join(offsets, ["conv_id", "part"]).select(
        "conv_id", "part", (F.col("before") + F.col("nr") - 1).alias("pos"), "id", "words"
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, pos, id, words: the first h turns of conversation c - c % 20 followed by c's
    own turns after its first h, h = crc32(c) % 4. A row of pos null stands for each
    conversation, so that one without any turn is kept."""
    rows = cut(numbered(turns))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = cut(
        sizes.select("conv_id", "n", base.alias("base"), heads.alias("h"))
        .join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
        .select("conv_id", "base", "h", "taken")
    )
    # a conversation's values reach its rows by (conv_id, part): no long one meets in a task
    places = rows.select("conv_id", "part").distinct().join(convs, "conv_id")
    own = rows.join(places, ["conv_id", "part"]).where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "words"
    )
    first = rows.where((F.col("pos") < HEADS - 1) & (F.col("conv_id") % GROUP == 0))
    copied = (
        convs.where("taken > 0")
        .join(first.select(F.col("conv_id").alias("base"), "pos", "id", "words"), "base")
        .where("pos < taken")
        .select("conv_id", "pos", "id", "words")
    )
    mark = convs.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(copied).unionByName(mark)


def _blocks(turns: DataFrame) -> DataFrame:
    """One row per conversation and block: k1, k2 (the node before it), t0.., w0.., `before`
    (words of the blocks before) and n_turns of the block."""
    slot = F.col("pos") % BLOCK
    rows = (
        rebuilt(turns)
        .withColumn("block", F.coalesce(F.floor(F.col("pos") / BLOCK), F.lit(0)).cast("long"))
        .groupBy("conv_id", "block")
        .agg(
            *[F.max(F.when(slot == i, F.col("id"))).alias(t) for i, t in enumerate(_T)],
            *[F.sum(F.when(slot == i, F.col("words")).otherwise(0)).alias(w) for i, w in enumerate(_W)],
            F.count("pos").alias("n_turns"),
        )
        .withColumn("slice", F.floor(F.col("block") / SLICE))
        .withColumn("d1", _block_digest(0))
        .withColumn("d2", _block_digest(1))
        .withColumn("w", sum((F.col(w) for w in _W), F.lit(0)))
    )
    rows = cut(rows)
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "slice").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        rows.groupBy("conv_id", "slice")
        .agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum("w").alias("w"))
        .select(
            "conv_id", "slice",
            *[F.coalesce(F.bit_xor(d).over(earlier), F.lit(0)).alias(f"s{d}") for d in ("d1", "d2")],
            F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("sw"),
        )
    )
    xor = lambda d: F.col(f"s{d}").bitwiseXOR(F.coalesce(F.bit_xor(d).over(inside), F.lit(0)))
    return cut(
        rows.join(slices, ["conv_id", "slice"]).select(
            "conv_id", "block", "slice", *_T, *_W, "n_turns",
            xor("d1").alias("k1"), xor("d2").alias("k2"),
            (F.col("sw") + F.coalesce(F.sum("w").over(inside), F.lit(0))).alias("before"),
        )
    )


def _rollup(blocks: DataFrame, measures: str) -> DataFrame:
    """Every prefix of every block with its measures: node, parent, depth and `level`."""
    view = "__prefix_blocks"
    blocks.createOrReplaceTempView(view)
    names = ", ".join(_T)
    found = blocks.sparkSession.sql(
        f"SELECT block, k1, k2, {names}, {BLOCK} - bit_count(grouping_id()) AS level, {measures}"
        f" FROM {view} GROUP BY block, k1, k2, ROLLUP ({names})"
    )
    level = F.col("level")
    real = F.when(level == 0, F.col("block") == 0)
    for i, t in enumerate(_T, 1):  # a null that ROLLUP did not make: the conversation ended before
        real = real.when(level == i, F.col(t).isNotNull())
    keys = [_node_key(i) for i in range(BLOCK + 1)]
    return (
        found.where(real)
        .withColumn("node", _by_level(level, keys))
        .withColumn("parent", _by_level(level, [F.lit(None).cast("binary"), *keys[:-1]]))
        .withColumn("depth", (F.col("block") * BLOCK + level).cast("long"))
        .drop("block", "k1", "k2", *_T)
    )


def build(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the conversations' trie.

    nodes: node, parent (128-bit keys), depth, conv_id (smallest member), parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens. ends: node, conv_id of every conversation
    at the node where it ends."""
    blocks = _blocks(turns)
    words = ", ".join(f"max({w}) AS {w}" for w in _W)
    first = cut(
        _rollup(blocks, f"min(conv_id) AS conv_id, {words}").select(
            "node", "parent", "depth", "conv_id",
            _by_level(F.col("level"), [F.lit(0), *[F.col(w) for w in _W]]).cast("long").alias("words"),
        )
    )
    children = cut(first.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")))
    counted = cut(first.join(children, "node", "left").fillna(0, ["n_children"]))
    owned = counted.groupBy("conv_id").agg(F.sum("words").alias("owned"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    # what each conversation does not own, and its leaf, brought to its blocks by slices
    members = (
        blocks.groupBy("conv_id")
        .agg(F.sum(sum((F.col(w) for w in _W), F.lit(0))).alias("total"), F.sum("n_turns").alias("length"))
        .join(owned, "conv_id", "left")
        .select("conv_id", "length", (F.col("total") - F.coalesce("owned", F.lit(0))).alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    )
    at = blocks.select("conv_id", "slice").distinct().join(members, "conv_id")
    full = cut(blocks.join(at, ["conv_id", "slice"]))
    passed = [F.lit(0), *[sum((F.col(w) for w in _W[:i]), F.col("before")) for i in range(BLOCK)]]
    saved = full.select("*", *[F.greatest(F.lit(0), F.col("shared") - p).cast("long").alias(f"v{i}") for i, p in enumerate(passed)])
    sums = ", ".join(f"sum(v{i}) AS v{i}" for i in range(BLOCK + 1))
    second = _rollup(saved, f"count(*) AS n_convs, sum(leaf) AS n_leaves, {sums}").select(
        "node", "n_convs", F.col("n_leaves").cast("long"),
        _by_level(F.col("level"), [F.col(f"v{i}") for i in range(BLOCK + 1)]).alias("saved_tokens"),
    )
    nodes = _with_parents(counted).join(second, "node")
    last = (F.col("length") <= (F.col("block") + 1) * BLOCK) & ((F.col("length") > F.col("block") * BLOCK) | (F.col("length") == 0))
    ends = full.where(last).select(
        _by_level(F.col("length") - F.col("block") * BLOCK, [_node_key(i) for i in range(BLOCK + 1)]).alias("node"), "conv_id"
    )
    return nodes.drop("words"), ends


def _with_parents(nodes: DataFrame) -> DataFrame:
    """parent_conv_id of every node. Parents of more than a thousandth of all nodes (so at
    most a thousand) are broadcast, the others joined by a shuffle."""
    busy = nodes.agg(F.count("*").alias("n")).first()["n"] / 1000
    names = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    large = F.broadcast(names.where(F.col("n_children") > busy).drop("n_children"))
    small = names.where(F.col("n_children").between(1, busy)).drop("n_children")
    below = nodes.where("parent is not null")
    root = nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    light = below.join(large, "parent", "left_anti").join(small, "parent")
    return root.unionByName(light).unionByName(below.join(large, "parent"))


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: lowercase SHA-256 of the decimal conv_ids that end at each node,
    ascending, comma-joined. Ids are first joined in ranges of 512 numbers; the ranges of a
    node then pass through the digest as a stream, never as one value."""
    ranges = (
        ends.groupBy("node", F.shiftright("conv_id", 9).alias("range"))
        .agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
        .repartition("node")
        .sortWithinPartitions("node", "range")
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield _pairs(done)
        if node is not None:
            yield _pairs([(node, state.hexdigest())])

    return ranges.select("node", "ids").mapInArrow(digests, "node binary, ends_sha256 string")


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"]
    )
