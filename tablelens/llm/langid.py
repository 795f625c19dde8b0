"""Language identification by rank-order profiles of n-grams.

A text's n-grams (1 to 3 characters, words padded with blanks) are counted; a profile is
the list of the most frequent ones. The out-of-place distance adds, over the text's
profile, how far each n-gram's rank is from its rank in the language's profile (a fixed
penalty where it is missing). The nearest language wins. Language profiles come from the
counts of all training texts, added up by one grouped sum.

Defined results: a text that is null or has no letter is `und` with score 0; without any
training text every text is `und`. Ties go to the language first in order. Only letters
count, lower-cased; every other character ends a word."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks

#: N-grams in a profile.
PROFILE = 400
#: Characters of the longest n-gram.
LONGEST = 3
_BITS = np.uint64(21)
_FOLD: np.ndarray | None = None
_MARK: np.ndarray | None = None


def fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letter of every code point (marks are themselves; 0 for what is neither),
    and whether it is a mark."""
    table, mark = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for cp in range(0x110000):
        c = chr(cp)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
            mark[cp] = kind == "M"
    return table, mark


def _without_bare_marks(c: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Marks belong to words that have a letter; words of marks only become blank."""
    inside = c > 0
    word = np.cumsum(inside & ~np.concatenate([[False], inside[:-1]]))
    letters = np.bincount(word, inside & ~mark, int(word[-1]) + 1)
    return np.where(inside & (letters[word] > 0), c, 0)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of all texts of a buffer, unordered; n-grams packed 21 bits a character.

    A blank is code 1 here: every word is preceded and followed by one."""
    global _FOLD, _MARK
    if _FOLD is None:
        _FOLD, _MARK = fold_tables()
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    row = np.searchsorted(offsets, lead, side="right") - 1
    c = _FOLD[cps].astype(np.uint64)
    # put a blank before each text, so that no word crosses texts
    first = np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])
    mark = _MARK[cps]
    c = np.insert(c, first, 0)
    if mark.any():
        c = _without_bare_marks(c, np.insert(mark, first, False))
    c = np.concatenate([c, np.zeros(1, np.uint64)])
    row = np.concatenate([np.insert(row, first, row[first]), row[-1:]])
    letter = c > 0
    c = np.where(letter, c, np.uint64(1))
    out_rows, out = [row[letter]], [c[letter]]
    pair = letter[:-1] | letter[1:]
    out_rows.append(row[:-1][pair])
    out.append((c[:-1][pair] << _BITS) | c[1:][pair])
    # the middle one is a letter: " ab", "abc", "bc ", and " a " for one-letter words
    mid = letter[1:-1]
    out_rows.append(row[1:-1][mid])
    out.append((((c[:-2][mid] << _BITS) | c[1:-1][mid]) << _BITS) | c[2:][mid])
    return np.concatenate(out_rows), np.concatenate(out)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ranked = np.sort(values)
    edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return ranked[edge], np.diff(np.concatenate([edge, [len(ranked)]]))


def _by_row(row: np.ndarray, gram: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, distinct n-grams, counts) of each row that has any."""
    order = np.argsort(row, kind="stable")
    gram = gram[order]
    end = np.cumsum(np.bincount(row, minlength=n))
    for r in range(n):
        a = end[r - 1] if r else 0
        if end[r] > a:
            yield (r, *_counted(gram[a : end[r]]))


def top(gram: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams; ties by the n-gram itself (`gram` comes sorted)."""
    return gram[np.argsort(-count, kind="stable")[:size]]


def learn(texts: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language, most frequent first. Every text counts whole; the driver gets
    `size` n-grams per language, chosen by a grouped sum and a rank inside Spark."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, data, offsets in chunks(batch.column(1)):
                row, gram = grams(data, offsets)
                part = langs[lo:hi]
                for lang in sorted(set(part)):
                    kind, count = _counted(gram[(part == lang)[row]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(kind), pa.string()), pa.array(kind.astype(np.int64)), pa.array(count.astype(np.int64))],
                        names=["lang", "gram", "n"],
                    )

    counted = (
        texts.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
        .where("lang is not null and text is not null")
        .mapInArrow(run, schema)
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size)
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", F.desc("n"), "gram").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return out


def predict(df: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """Adds lang_pred and score (0 to 1: how much nearer the best language is than the
    largest possible distance); clashing columns are overwritten."""
    df = df.drop("lang_pred", "score")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    langs = sorted(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        place = np.full((len(langs), len(every) + 1), -1, np.int64)
        for k, lang in enumerate(langs):
            place[k, np.searchsorted(every, np.array(profiles[lang], np.uint64))] = np.arange(len(profiles[lang]))
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(batch.schema.get_field_index(text_col))):
                row, gram = grams(data, offsets)
                n = hi - lo
                pred, score = ["und"] * n, np.zeros(n)
                if langs:
                    for r, kind, count in _by_row(row, gram, n):
                        own = top(kind, count, size)
                        at = np.minimum(np.searchsorted(every, own), len(every) - 1)
                        at = np.where(every[at] == own, at, len(every))
                        there = place[:, at]
                        far = np.where(there < 0, size, np.abs(there - np.arange(len(own)))).sum(axis=1)
                        best = int(far.argmin())
                        pred[r], score[r] = langs[best], 1 - far[best] / (size * len(own))
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*part.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, schema)
