"""Embedding near-duplicates by iterative quantisation (ITQ) and multi-index Hamming tables.

A rotation is learned on a bounded sample (`SAMPLE_ROWS` vectors, chosen by a hash of their
content): principal axes, then alternating sign codes and the orthogonal Procrustes
rotation, which balances the bits. Every vector gets a binary code. `TABLES` tables hold
substrings of the code (each bit serves in two tables, in two arrangements); vectors with
an equal substring and label meet in a bucket, where pairs are reranked by the cosine of
the original vectors in double precision.

Equal vectors of a label become one class before anything else. A bucket is dealt out in
blocks of about `BLOCK` classes, each pair of blocks being one task's group, so a bucket of
any size is compared whole without being gathered; a pair that meets in several tables is
counted in the first one only. A group returns counts per class and a spanning forest of
the links it found, never the pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
and rows without a label, link with nothing; vectors of different lengths never link; rows
with equal vec_id are counted one by one; a component is named by its smallest non-null
vec_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

#: Vectors the rotation is learned on, at most (in expectation).
SAMPLE_ROWS = 20_000
#: Tables, and bits of a table's substring.
TABLES, BITS = 16, 8
#: Classes of a bucket compared in one group of a task.
BLOCK = 2048


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 50, seed: int = 7) -> np.ndarray:
    """A projection (dimension x bits) whose signs are the code."""
    dim = sample.shape[1]
    rng = np.random.default_rng(seed)
    cov = sample.T @ sample / max(1, len(sample))
    values, axes = np.linalg.eigh(cov)
    axes = axes[:, np.argsort(-values)[: min(bits, dim)]]
    width = axes.shape[1]
    projected = sample @ axes
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    for _ in range(rounds):
        code = np.where(projected @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(code.T @ projected)
        rotation = (u @ vt).T
    out = axes @ rotation
    if width < bits:  # fewer dimensions than bits: further bits from random directions
        out = np.concatenate([out, rng.standard_normal((dim, bits - width))], axis=1)
    return out


def _arrangements(bits: int) -> np.ndarray:
    """Bit positions of each table: the bits in order, then dealt out in turn."""
    half = TABLES // 2
    plain = np.arange(half * BITS) % bits
    return np.concatenate([plain.reshape(half, BITS), plain.reshape(BITS, half).T])


def _substrings(vectors: np.ndarray, projection: np.ndarray, tables: np.ndarray) -> np.ndarray:
    code = (vectors @ projection >= 0).astype(np.int64)
    return (code[:, tables] << np.arange(BITS)).sum(axis=2)


def _matrix(column: pd.Series) -> np.ndarray:
    out = np.stack(column.to_numpy()).astype(np.float64)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    spark = df.sparkSession
    base = df.select(F.col(id_col).alias("id0"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    sound = (
        F.col("v").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    # -0.0 is 0.0, so that equal vectors are equal bytes
    clean = F.transform("v", lambda x: x + F.lit(0.0))
    rows = cut(base.withColumn("v", F.when(sound, clean)))
    classes = cut(
        rows.where("v is not null")
        .groupBy("label", "v")
        .agg(F.min("id0").alias("low"), F.count("*").alias("copies"))
        .withColumn("id", F.monotonically_increasing_id())
        .withColumn("dim", F.size("v"))
    )
    sizes = classes.groupBy("dim").count().collect()
    edges, counts = [], []
    for dim, total in [(r.dim, r["count"]) for r in sizes]:
        own = classes.where(F.col("dim") == dim)
        e, c = _search(own, dim, total, least)
        edges.append(e)
        counts.append(c)
    if not edges:
        links = spark.createDataFrame([], "a bigint, b bigint")
        per_class = spark.createDataFrame([], "id bigint, n bigint")
    else:
        links, per_class = edges[0], counts[0]
        for e, c in zip(edges[1:], counts[1:], strict=True):
            links, per_class = links.union(e), per_class.union(c)
    found = components(links) if not links.isEmpty() else spark.createDataFrame([], "node bigint, root bigint")
    named = (
        classes.select("id", "label", "v", "low", "copies")
        .join(per_class.groupBy("id").agg(F.sum("n").alias("n")), "id", "left")
        .join(found.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    named = cut(named.select("label", "v", "low", "root", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    named = named.join(lows, "root").select("label", "v", "n_links", "component")
    out = rows.join(named, ["label", "v"], "left")
    component = F.when(F.col("v").isNull(), F.col("id0")).otherwise(F.col("component"))
    return out.select(
        F.col("id0").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id0") == component, F.col("v").isNull()).alias("kept"),
    )


def _search(classes: DataFrame, dim: int, total: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(links (a, b): a spanning forest per group; (id, n): linked rows in other classes)."""
    sample = classes.select("v")
    if total > SAMPLE_ROWS:
        sample = sample.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE_ROWS / total))
    taken = sample.toPandas()["v"]
    bits = TABLES * BITS // 2
    vectors = _matrix(taken) if len(taken) else np.eye(dim)
    projection = learn_rotation(vectors, bits)
    tables = _arrangements(bits)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            sub = _substrings(_matrix(part["v"]), projection, tables)
            yield pd.DataFrame(
                {
                    "id": np.repeat(part["id"].to_numpy(), TABLES),
                    "label": np.repeat(part["label"].to_numpy(), TABLES),
                    "t": np.tile(np.arange(TABLES), len(part)),
                    "sub": sub.ravel(),
                }
            )

    kind = classes.schema["label"].dataType.simpleString()
    coded = cut(classes.select("id", "label", "v").mapInPandas(code, f"id bigint, label {kind}, t int, sub bigint"))
    # small buckets of a table share groups of about BLOCK classes, large ones are cut into
    # blocks; a class asks in the groups (own, j) and answers in the groups (i, own)
    buckets = coded.groupBy("label", "t", "sub").agg(F.count("*").alias("size"))
    packs = buckets.groupBy("label", "t").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("packs"))
    plan = (
        buckets.where("size > 1")
        .join(packs, ["label", "t"])
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("pack", F.when(F.col("blocks") > 1, -1 - F.col("sub")).otherwise(F.pmod(F.xxhash64("sub"), F.col("packs"))).cast("int"))
        .drop("size", "packs")
    )
    placed = coded.join(plan, ["label", "t", "sub"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    columns = ["id", "label", "t", "sub", "pack", "i", "j", "role"]
    asks = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", own)
    answers = placed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", own)
    roles = (
        asks.where("i != j").withColumn("role", F.lit(0)).select(*columns)
        .union(answers.withColumn("role", F.when(F.col("i") == F.col("j"), 2).otherwise(1)).select(*columns))
    )
    groups = roles.join(classes.select("id", "v", "copies"), "id")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        t = int(part["t"].iat[0])
        every = _matrix(part["v"])
        subs = _substrings(every, projection, tables)
        all_ids, all_copies, all_roles = (part[c].to_numpy() for c in ("id", "copies", "role"))
        order = np.argsort(subs[:, t], kind="stable")
        cuts = np.flatnonzero(np.diff(subs[order, t])) + 1
        edges, met = [], []
        for members in np.split(order, cuts):
            ids, copies, role, sub, vectors = all_ids[members], all_copies[members], all_roles[members], subs[members], every[members]
            q, s = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
            tree = np.arange(len(members))
            for lo in range(0, len(q), 256):
                mine = q[lo : lo + 256]
                linked = (vectors[mine] @ vectors[s].T >= least) & (ids[mine][:, None] != ids[s][None, :])
                x, y = np.nonzero(linked)
                if t and len(x):  # met in an earlier table: counted there
                    early = (sub[mine[x], :t] == sub[s[y], :t]).any(axis=1)
                    x, y = x[~early], y[~early]
                if not len(x):
                    continue
                per = np.bincount(x, copies[s[y]], len(mine)).astype(np.int64)
                met += [(ids[mine[k]], -1, per[k]) for k in np.flatnonzero(per)]
                ends = np.searchsorted(x, np.arange(len(mine)), side="right")
                for k, end in enumerate(ends):
                    begin = ends[k - 1] if k else 0
                    if end == begin:
                        continue
                    a, near = mine[k], s[y[begin:end]]
                    # the links that join trees: one for each tree not yet joined
                    trees, at = np.unique(tree[near], return_index=True)
                    for other, b in zip(trees, near[at], strict=True):
                        if other != tree[a]:
                            edges.append((ids[a], ids[b], 0))
                            tree[tree == other] = tree[a]
        return pd.DataFrame([*edges, *met], columns=["a", "b", "n"]).astype("int64")

    result = cut(groups.groupBy("label", "t", "pack", "i", "j").applyInPandas(compare, "a bigint, b bigint, n bigint"))
    return result.where("b >= 0").select("a", "b"), result.where("b < 0").select(F.col("a").alias("id"), "n")


