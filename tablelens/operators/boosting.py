"""Gradient-boosted regression trees on binned features, over all rows of a frame.

The method is that of Spark ML's GBTRegressor with squared error: at most 32 bins a
feature, best-variance splits level by level, a first tree of weight 1 on the label and
then trees of weight `step_size` on twice the residual. What differs is what a pass
costs: rows are kept as blocks of one byte a feature plus the residual, tasks sum them
into histograms with numpy, and only those (nodes x features x bins, whatever the number
of rows) reach the driver, which chooses the splits of the next level. Bin edges are taken
from all rows, where GBTRegressor draws 10 000.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.names import quote
from tablelens.operators.stats import approx_quantiles, per_column_counts
from tablelens.session import materialize

MAX_BINS = 32
MAX_COUNTED_VALUES = 10_000  # a feature of more distinct values gets its edges from a sketch of all rows
BLOCK_ROWS = 1 << 16
TASK_ROWS = 1 << 21
TREES_A_STATE = 5  # so many trees are applied anew in each pass before the residuals are stored again
JOINT_CELLS = 1 << 12


@dataclass
class Tree:
    """A complete binary tree, node i before 2i+1 (feature <= threshold) and 2i+2. A node
    that is not split has the threshold infinity, and the leaves on its left its value."""

    weight: float
    feature: list[int]
    threshold: list[float]
    leaves: list[float]

    def leaf(self, columns: list[np.ndarray] | np.ndarray, n: int) -> np.ndarray:
        """The leaf (from 0, left to right) of each of the `n` rows."""
        at = np.zeros(n, np.min_scalar_type(len(self.feature) + 1))
        node = 0
        while node < len(self.feature):
            right = np.zeros(n, bool)
            for k in range(node + 1):  # level of nodes node .. 2 * node
                f, t = self.feature[node + k], self.threshold[node + k]
                if t < math.inf:
                    right |= (columns[f] > columns[f].dtype.type(t)) & (at == k)
            at = at * at.dtype.type(2) + right
            node = 2 * node + 1
        return at

    def predict(self, columns: list[np.ndarray] | np.ndarray, n: int) -> np.ndarray:
        return np.asarray(self.leaves)[self.leaf(columns, n)]


@dataclass
class BoostedTrees:
    trees: list[Tree]

    def predict(self, columns: list[np.ndarray] | np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(n)
        for t in self.trees:
            total += t.weight * t.predict(columns, n)
        return total

    def prediction(self, features: list[Column]) -> Column:
        """The prediction of a row whose features, in the order of training, are these."""

        @F.arrow_udf("double")
        def predict(*columns: pa.Array) -> pa.Array:
            values = [c.to_numpy(zero_copy_only=False) for c in columns]
            return pa.array(self.predict(values, len(values[0])))

        return predict(*features) if features else F.lit(float(self.predict([], 1)[0]))

    def save(self, path: str) -> None:
        rows = [(i, t.weight, t.feature, t.threshold, t.leaves) for i, t in enumerate(self.trees)]
        kinds = "i int, weight double, feature array<int>, threshold array<double>, leaves array<double>"
        SparkSession.active().createDataFrame(rows, kinds).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str) -> BoostedTrees:
        rows = SparkSession.active().read.parquet(path).orderBy("i").collect()
        return BoostedTrees([Tree(r["weight"], r["feature"], r["threshold"], r["leaves"]) for r in rows])


# ------------------------------------------------------------------ bins --

def edges_of_counts(values: list[float], counts: list[int], bins: int = MAX_BINS) -> list[float]:
    """Thresholds between the sorted distinct values: all midpoints, or with more than `bins`
    values those closest to equal numbers of rows."""
    between = [(a + b) / 2.0 for a, b in zip(values, values[1:])]
    if len(between) < bins:
        return between
    stride = sum(counts) / bins
    edges, seen, aim = [], counts[0], stride
    for k, n in enumerate(counts[1:]):
        if abs(seen - aim) < abs(seen + n - aim):
            edges.append(between[k])
            aim += stride
        seen += n
    return edges


def feature_edges(rows: DataFrame, columns: list[str], distinct: dict[str, int], bins: int = MAX_BINS) -> list[list[float]]:
    """Thresholds of each numeric column (at most about `distinct` values) from all rows."""
    few = [c for c in columns if distinct[c] < MAX_COUNTED_VALUES]
    many = [c for c in columns if c not in few]
    found: dict[str, list[float]] = {}
    if few:
        counted: list[dict] = [{} for _ in few]
        for r in per_column_counts(rows, few).collect():
            counted[r["g"]][r[f"v{r['g']}"]] = r["n"]
        for c, n in zip(few, counted):
            values = sorted(n)
            found[c] = edges_of_counts(values, [n[v] for v in values], bins)
    for c, cuts in approx_quantiles(rows, {c: [k / bins for k in range(1, bins)] for c in many}).items():
        found[c] = sorted({v for v in cuts if v is not None})
    return [found[c] for c in columns]


def _pack(rows: DataFrame, edges: list[list[float]]) -> DataFrame:
    """(n, codes, label): blocks of rows, a byte for each feature's bin."""
    cuts = [np.asarray(e, np.float64) for e in edges]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, labels, n = [], [], 0

        def block():
            c, y = np.concatenate(codes, axis=1), np.concatenate(labels)
            return pa.RecordBatch.from_pydict({
                "n": pa.array([n], pa.int32()), "codes": pa.array([c.tobytes()], pa.binary()), "label": pa.array([y.tobytes()], pa.binary()),
            })

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(start, BLOCK_ROWS)
                label, *values = [c.to_numpy(zero_copy_only=False) for c in some.columns]
                if n and n + len(label) > BLOCK_ROWS:
                    yield block()
                    codes, labels, n = [], [], 0
                coded = np.empty((len(cuts), len(label)), np.uint8)
                for k, (cut, v) in enumerate(zip(cuts, values)):
                    coded[k] = np.searchsorted(cut, v) if len(cut) != 1 else v > cut[0]
                codes.append(coded)
                labels.append(label)
                n += len(label)
        if n:
            yield block()

    return rows.mapInArrow(pack, "n int, codes binary, label binary")


# -------------------------------------------------------------- boosting --

def _joint(bins: list[int]) -> list[list[int]]:
    """Features counted together, as long as their bins make few cells."""
    groups: list[tuple[list[int], int]] = []
    for f in sorted((f for f, b in enumerate(bins) if b > 1), key=lambda f: -bins[f]):
        for i, (group, cells) in enumerate(groups):
            if cells * bins[f] <= JOINT_CELLS:
                groups[i] = ([*group, f], cells * bins[f])
                break
        else:
            groups.append(([f], bins[f]))
    return [group for group, _ in groups]


def _residual(codes: np.ndarray, left: np.ndarray, pending: list[Tree]) -> np.ndarray:
    return left - BoostedTrees(pending).predict(codes, len(left)) if pending else left


def _histograms(state: RDD, bins: list[int], pending: list[Tree], grown: Tree, nodes: int, scale: float) -> tuple[list, np.ndarray]:
    """Per node of the next level: for every feature the rows and the sum of the target by
    bin, an array (2, nodes, bins) each; and the node's own rows and sum, (2, nodes)."""
    groups = _joint(bins)

    def task(blocks: Iterator) -> Iterator:
        cells = [math.prod(bins[f] for f in g) for g in groups]
        sums = [np.zeros((2, nodes * k)) for k in cells]
        total = np.zeros((2, nodes))
        for codes, left in blocks:
            target = scale * _residual(codes, left, pending)
            at = grown.leaf(codes, len(left))
            if not groups:
                total += np.bincount(at, minlength=nodes), np.bincount(at, target, nodes)
            for g, k, s in zip(groups, cells, sums):
                kind = np.uint16 if nodes * k <= 1 << 16 else np.intp
                cell = at.astype(kind)
                for f in g:
                    cell *= kind(bins[f])
                    cell += codes[f]
                cell = cell.astype(np.intp, copy=False)
                s[0] += np.bincount(cell, minlength=nodes * k)
                s[1] += np.bincount(cell, target, nodes * k)
        own = {}
        for g, s in zip(groups, sums):
            shaped = s.reshape(2, nodes, *[bins[f] for f in g])
            for i, f in enumerate(g):
                own[f] = shaped.sum(axis=tuple(2 + j for j in range(len(g)) if j != i))
        yield own, own[groups[0][0]].sum(axis=2) if groups else total

    parts = state.mapPartitions(task).collect()
    return [sum(p[0][f] for p in parts) if b > 1 else None for f, b in enumerate(bins)], sum(p[1] for p in parts)


def _grow(state: RDD, bins: list[int], pending: list[Tree], depth: int, weight: float, scale: float) -> Tree:
    """The next tree, its thresholds as bin numbers."""
    tree = Tree(weight, [], [], [])
    means = [0.0]
    for level in range(depth):
        nodes = 1 << level
        hists, total = _histograms(state, bins, pending, tree, nodes, scale)
        features, thresholds, below = [], [], []
        for k in range(nodes):
            n, s = total[:, k]
            mean = s / n if n else means[k]
            best = (0.0, 0, math.inf, mean, mean)
            for f, h in enumerate(hists):
                if h is None:
                    continue
                nl, sl = np.cumsum(h[:, k, :-1], axis=1)
                nr, sr = n - nl, s - sl
                with np.errstate(all="ignore"):
                    gap = sl / nl - sr / nr
                    gain = np.where((nl > 0) & (nr > 0), nl * nr / (n * n) * gap * gap, -1.0)
                b = int(np.argmax(gain))
                if gain[b] > best[0]:
                    best = (float(gain[b]), f, float(b), float(sl[b] / nl[b]), float(sr[b] / nr[b]))
            features.append(best[1])
            thresholds.append(best[2])
            below += best[3:]
        tree = replace(tree, feature=tree.feature + features, threshold=tree.threshold + thresholds)
        means = below
    return replace(tree, leaves=[float(m) for m in means])


def fit(
    rows: DataFrame, label: str, features: list[str], edges: list[list[float]], n: int, *, max_iter: int, max_depth: int, step_size: float
) -> BoostedTrees:
    """Trees of the `n` rows; `edges` are the thresholds of each feature. The residuals stay
    in executor memory (disk, if it is short); a pass is one task per two million rows."""
    sc = rows.sparkSession.sparkContext
    slots = sc.defaultParallelism
    tasks = slots * math.ceil(n / (TASK_ROWS * slots)) if n > BLOCK_ROWS * slots else math.ceil(n / BLOCK_ROWS)
    plain = rows.select(F.col(quote(label)).cast("double"), *[F.col(quote(f)).cast("double") for f in features])
    blocks = materialize(_pack(plain, edges).repartition(max(1, tasks)))
    width = len(features)

    def unpack(r) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(r["codes"], np.uint8).reshape(width, r["n"]), np.frombuffer(r["label"], np.float64)

    bins = [len(e) + 1 for e in edges]
    state = blocks.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)
    held = [state]
    trees: list[Tree] = []
    pending: list[Tree] = []
    while len(trees) < max_iter:
        first = not trees
        tree = _grow(state, bins, pending, max_depth, 1.0 if first else step_size, 1.0 if first else 2.0)
        for old in held[:-1]:  # the first pass over a new state has stored it
            old.unpersist()
        held = held[-1:]
        trees.append(tree)
        pending = [*pending, tree]
        if len(pending) == TREES_A_STATE and len(trees) < max_iter:
            state = _applied(state, pending)
            held.append(state)
            pending = []
    for old in held:
        old.unpersist()
    return BoostedTrees([
        replace(t, threshold=[edges[f][int(b)] if b < math.inf else b for f, b in zip(t.feature, t.threshold)]) for t in trees
    ])


def _applied(state: RDD, pending: list[Tree]) -> RDD:
    def apply(block: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return block[0], _residual(*block, pending)

    return state.map(apply).persist(StorageLevel.MEMORY_AND_DISK)
