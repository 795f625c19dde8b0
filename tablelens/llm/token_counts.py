"""Token counts of whole texts by a map-side two-tier lookup of pre-token lengths.

Tier 1 is a compact table of frequent pre-tokens and the number of tokens each encodes to.
It is learned from at most `SAMPLE` documents (a bound on time, not on results): `LEARNERS`
tasks count the pre-tokens of their share and report at most `REPORTED` each, and the
`FREQUENT` most frequent ones of up to `LONGEST` characters are broadcast, so the table has
a fixed bound of a few MB. Tier 2 is a cache in every worker, bounded in characters: a
pre-token that misses both is encoded by the library's model once. No pre-token is shuffled;
a text's count is a sum over its pre-tokens inside its task.

Pre-tokens come from the tokenizer's own normaliser and splitter. For the word tokenizer's
rules (NFC, lower case, contractions, runs of letters, single digits, runs of others) texts
of the scripts below `FAST` are split by a compiled pattern with the same result; other
texts go through the library. Strings of added tokens inside a text count as one token, as
the library takes them.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows repeat as they are;
other columns, also ones named like the results, are not read."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SAMPLE, LEARNERS, REPORTED, FREQUENT, LONGEST = 4000, 16, 1 << 14, 1 << 15, 64
#: Characters of pre-tokens that a worker's cache holds before it starts anew.
CACHED = 1 << 23
#: First code point that always goes through the library (after the Latin, Greek and Cyrillic blocks).
FAST = 0x530
#: Characters of a text that are split at once; a text is only cut at white space.
PART = 1 << 20

# The splitting rule and normalisers that the fast path reproduces.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]


def _class(kinds: str, limit: int) -> str:
    """Body of a character class of the code points below limit whose category is in kinds."""
    runs: list[list[int]] = []
    for cp in range(limit):
        if unicodedata.category(chr(cp))[0] in kinds:
            if runs and runs[-1][1] == cp - 1:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def _pattern(limit: int) -> re.Pattern[str]:
    letters, numbers = _class("L", limit), _class("N", limit)
    space = r"\x09-\x0d\x20\x85\xa0 "
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


class Lengths(dict):
    """Tokens of a pre-token: the worker's cache over the broadcast table over the model."""

    def __init__(self, tokenizer: Tokenizer, frequent: dict[str, int]):
        super().__init__()
        self.model, self.frequent, self.held = tokenizer.model, frequent, 0
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.symbols = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, piece: str) -> int:
        n = self.frequent.get(piece)
        if n is None:
            n = len(self.model.tokenize("".join(map(self.symbols.__getitem__, piece.encode()))))
        if len(piece) <= 4 * LONGEST:
            if self.held > CACHED:
                self.clear()
                self.held = 0
            self[piece] = n
            self.held += len(piece) + 16
        return n


@lru_cache(maxsize=2)
def splitter_of(path: str) -> Splitter:
    """The splitter of a tokenizer file, loaded once in each worker."""
    return Splitter(path)


class Splitter:
    """Pre-tokens of texts; added tokens inside a text are counted apart."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.fast = (
            split.get("pattern", {}).get("Regex") == RULE
            and [n["type"] for n in spec["normalizer"].get("normalizers", [])] == NORMALISERS
        )
        for token in spec["added_tokens"]:
            if token["normalized"] or token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError("added tokens must match raw text, without conditions")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        # NFC and lower case take code points below FAST to ones below 0x2d00
        self.ascii, self.wide = _pattern(0x80), _pattern(0x2D00)

    def _own(self, text: str) -> list[str]:
        return [p for p, _ in self.tokenizer.pre_tokenizer[0].pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def split(self, text: str) -> list[str]:
        if self.fast and text.isascii():
            return self.ascii.findall(text.lower())
        if self.fast and max(text) < chr(FAST):
            # the library lowers each character by itself, so there is no final sigma
            return self.wide.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return self._own(text)

    def parts(self, text: str) -> Iterator[str]:
        """The text between added tokens, cut at white space into parts of about PART."""
        for segment in self.added.split(text) if self.added else [text]:
            lo = 0
            while len(segment) - lo > PART:
                gap = re.compile(r"[ \t\n\r]").search(segment, lo + PART)
                if gap is None:
                    break
                yield segment[lo : gap.start()]
                lo = gap.start()
            yield segment[lo:]

    def count(self, text: str, lengths: Lengths) -> int:
        special = len(self.added.findall(text)) if self.added and "<" in text else 0
        return special + sum(sum(map(lengths.__getitem__, self.split(p))) for p in self.parts(text))


def frequent(docs: DataFrame, path: str, text: str = "text") -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of at most SAMPLE documents."""
    total = docs.count()
    sample = docs.select(F.col(text).alias("text"))
    if total > SAMPLE:
        sample = sample.sample(SAMPLE / total, 7)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, seen = splitter_of(path), Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for part in splitter.parts(value or ""):
                    seen.update(p for p in splitter.split(part) if len(p) <= LONGEST)
                    if len(seen) > 16 * REPORTED:  # rare ones go; this costs speed later, nothing else
                        seen = Counter(dict(seen.most_common(REPORTED)))
        top = seen.most_common(REPORTED)
        yield pa.record_batch([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    together: Counter[str] = Counter()
    for row in sample.repartition(LEARNERS).mapInArrow(learn, "piece string, n bigint").collect():
        together[row["piece"]] += row["n"]
    lengths = Lengths(splitter_of(path).tokenizer, {})
    return {piece: lengths[piece] for piece, _ in together.most_common(FREQUENT)}


def count_tokens(docs: DataFrame, path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every whole text by
    the tokenizer file at `path`, which every executor must have (as the library itself)."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = splitter_of(path)
        lengths = Lengths(splitter.tokenizer, table.value)
        for batch in batches:
            texts = batch.column(1)
            n = [splitter.count(texts[i].as_py() or "", lengths) for i in range(len(texts))]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(counts, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
