"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > j) = sigmoid(w.x - theta_j) with theta_0 < theta_1 < ...: one weight vector is
shared by all thresholds. The expected severity is the sum of these probabilities, and a
document is toxic when P(grade > 0) reaches the cutoff. Features are the presence of words
and of their beginnings (4 to 8 bytes), lower-cased; the `FEATURES` with the largest
chi-square over the training documents are kept, and a row counts the same whatever its
length because weights are only learned for present features.

Training uses labelled documents: all of them up to `SAMPLE_ROWS`, else a sample of about
that many chosen by a hash of the id (the bound of what reaches the driver).

Defined results: null and empty texts have no features, hence the severity of the
intercepts; without labelled rows, or with one grade only, severity is 0 for all; null
labels are left out; rows with repeated ids are scored one by one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, byte_table, chunks, cut, list_column, runs, slice_hashes

#: Labelled documents used for training, at most (in expectation).
SAMPLE_ROWS = 20_000
#: Features kept.
FEATURES = 4096
#: Documents in which a feature must occur to be kept.
SUPPORT = 4
#: Bytes of the word beginnings.
PREFIXES = (4, 5, 6, 7, 8)
_LETTER = byte_table(lambda b: 97 <= b <= 122 or b >= 128)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the two-byte letters U+00C0 to U+00DE."""
    data = LOWER[data]
    if len(data) > 1:
        second = np.zeros(len(data), bool)
        second[1:] = data[:-1] == 0xC3
        data[second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return data



def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature hash) arrays of a buffer, one pair for whole words and one for each
    length of beginnings."""
    data = lower_bytes(data)
    starts, ends, row = runs(_LETTER[data], offsets)
    yield row, slice_hashes(data, starts, ends)
    size = ends - starts
    for width in PREFIXES:
        long = size >= width
        h = slice_hashes(data, starts[long], starts[long] + width)
        yield row[long], h ^ np.uint64(0x5851F42D4C957F2D)


@dataclass
class Model:
    """Hashes of the kept features in order, their weights, and the thresholds."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected severity, P(grade > 0)) of margins w.x."""
        if not len(self.thresholds):
            return np.zeros(len(margin)), np.zeros(len(margin))
        p = _sigmoid(margin[:, None] - self.thresholds)
        return p.sum(axis=1), p[:, 0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, width: int, penalty: float = 0.1, rounds: int = 400
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) for a 0/1 matrix given by its (row, column) entries and grades
    0 .. m. Minimises the cumulative-link likelihood with an L2 penalty by Adam; thresholds
    stay ordered because all but the first are sums of positive steps."""
    grades = int(grade.max())
    n = len(grade)
    above = np.stack([(grade > j).mean() for j in range(grades)])
    cutoffs = -np.log(np.clip(above, 1e-6, 1 - 1e-6) / np.clip(1 - above, 1e-6, 1))
    steps = np.log(np.maximum(np.diff(cutoffs), 1e-3))
    theta = np.concatenate([np.zeros(width), cutoffs[:1], steps])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    at = np.arange(n)
    for r in range(1, rounds + 1):
        weights = theta[:width]
        cutoffs = theta[width] + np.concatenate([[0], np.cumsum(np.exp(theta[width + 1 :]))])
        margin = np.bincount(rows, weights[cols], n)
        cdf = np.concatenate([np.ones((n, 1)), _sigmoid(margin[:, None] - cutoffs), np.zeros((n, 1))], axis=1)
        prob = np.maximum(cdf[at, grade] - cdf[at, grade + 1], 1e-12)
        slope = cdf * (1 - cdf)
        d_hi, d_lo = slope[at, grade] / prob, slope[at, grade + 1] / prob
        d_margin = -(d_hi - d_lo)
        d_cut = np.zeros((n, grades + 2))
        d_cut[at, grade] += d_hi
        d_cut[at, grade + 1] -= d_lo
        d_cut = d_cut[:, 1:-1].sum(axis=0)
        back = np.cumsum(d_cut[::-1])[::-1]
        gradient = np.concatenate(
            [np.bincount(cols, d_margin[rows], width) + penalty * weights, back[:1], back[1:] * np.exp(theta[width + 1 :])]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta = theta - 0.05 * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.999**r)) + 1e-9)
    return theta[:width], theta[width] + np.concatenate([[0], np.cumsum(np.exp(theta[width + 1 :]))])


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of a buffer, by row and feature."""
    got = [*features(data, offsets)]
    row, h = np.concatenate([r for r, _ in got]), np.concatenate([h for _, h in got])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _kept(hashes: np.ndarray):
    """A function giving, for feature hashes, (positions of kept ones, their columns)."""
    seen = np.zeros(1 << 16, bool)
    seen[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def look(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(hashes, h[maybe]), max(0, len(hashes) - 1))
        known = hashes[at] == h[maybe] if len(hashes) else np.zeros(0, bool)
        return maybe[known], at[known]

    return look


def _present(data: np.ndarray, offsets: np.ndarray, look, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, column) of the kept features of a buffer."""
    codes = []
    for row, h in features(data, offsets):
        where, column = look(h)
        codes.append(row[where] * width + column)
    code = np.unique(np.concatenate(codes))
    return code // width, code % width


def train(
    docs: DataFrame,
    labels: DataFrame,
    grade_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    n_features: int = FEATURES,
) -> Model:
    """Fits the model on labelled documents (grades 0, 1, 2, ...; the largest grade of a
    repeated id counts)."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    labels = (
        labels.select(F.col(id_col).alias("__id"), F.col(grade_col).cast("int").alias("grade"))
        .where("__id is not null and grade is not null and grade >= 0")
        .groupBy("__id")
        .agg(F.max("grade").alias("grade"))
    )
    total = labels.count()
    if total > sample_rows:
        labels = labels.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / total))
    sample = cut(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(labels, "__id").select("grade", "text"))
    sizes = {r.grade: r["count"] for r in sample.groupBy("grade").count().collect()}
    if len(sizes) < 2:
        return none

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grade = np.array(batch.column(0).to_pylist(), np.int64) > 0
            for lo, hi, data, offsets in chunks(batch.column(1)):
                row, h = _distinct(data, offsets)
                kind, which = np.unique(h, return_inverse=True)
                high = np.bincount(which, grade[lo:hi][row], len(kind)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind.view(np.int64)), pa.array(np.bincount(which, minlength=len(kind)).astype(np.int64)), pa.array(high)],
                    names=["feature", "n", "high"],
                )

    n, high = float(sum(sizes.values())), float(sum(v for g, v in sizes.items() if g > 0))
    a, b = F.col("high"), F.col("n") - F.col("high")
    expected = F.col("n") * (high / n)
    chosen = (
        sample.mapInArrow(counts, "feature long, n long, high long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("high").alias("high"))
        .where((F.col("n") >= SUPPORT) & (a + b < n))
        .withColumn("chi", (a - expected) ** 2 * n * n / (F.col("n") * (n - F.col("n")) * max(high, 1) * max(n - high, 1) / n))
        .orderBy(F.desc("chi"), "feature")
        .limit(n_features)
        .collect()
    )
    hashes = np.sort(np.array([r.feature for r in chosen], np.int64).view(np.uint64))
    width = max(1, len(hashes))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _kept(hashes)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                row, column = _present(data, offsets, look, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), list_column(column.astype(np.int32), np.bincount(row, minlength=hi - lo), pa.int32())],
                    names=["grade", "columns"],
                )

    got = sample.mapInArrow(entries, "grade int, columns array<int>").toArrow()
    grade = got.column("grade").to_numpy().astype(np.int64)
    per_row = got.column("columns").combine_chunks()
    size = np.array([len(x) for x in per_row.to_pylist()]) if len(per_row) else np.zeros(0, int)
    order = np.unique(grade)  # grades that occur, in order
    cols = per_row.flatten().to_numpy().astype(np.int64)
    weights, cutoffs = fit_ordinal(np.repeat(np.arange(len(grade)), size), cols, np.searchsorted(order, grade), width)
    return Model(hashes, weights, cutoffs)


def score(df: DataFrame, model: Model, cutoff: float = 0.4, text_col: str = "text") -> DataFrame:
    """Adds severity (expected grade), p_toxic and toxic; clashing columns are overwritten."""
    df = df.drop("severity", "p_toxic", "toxic")
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("severity", T.DoubleType()),
            T.StructField("p_toxic", T.DoubleType()),
            T.StructField("toxic", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, width = _kept(model.hashes), max(1, len(model.hashes))
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(batch.schema.get_field_index(text_col))):
                margin = np.zeros(hi - lo)
                if len(model.hashes):
                    row, column = _present(data, offsets, look, width)
                    margin = np.bincount(row, model.weights[column], hi - lo)
                severity, p = model.severity(margin)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(severity), pa.array(p), pa.array(p >= cutoff)],
                    names=[*part.schema.names, "severity", "p_toxic", "toxic"],
                )

    return df.mapInArrow(run, schema)
