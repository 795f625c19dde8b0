"""A corpus pipeline of five operators; each stage takes what its predecessor kept.

The stages, in order: documents that the toxicity model rejects go; one document of each
group of near duplicates stays; passages of the benchmark are cut out of the texts (a
document left without any word goes); personal data and the terms that disclose it are
replaced; and the texts are encoded as byte-level BPE ids."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import bpe, decontaminate, near_dup, pii, toxicity
from tablelens.llm.common import shared_dir
from tablelens.session import configure


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression, trained on `labels`, does not reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = docs.withColumnRenamed("toxic", "__toxic") if "toxic" in docs.columns else docs
    return toxicity.score(own, model).where("not toxic").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return near_dup.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the merged spans of benchmark windows; emptied documents go."""
    found = decontaminate.annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    emptied = (F.col("n_hit") > 0) & (F.col("n_hit") == F.col("n_words"))
    return _counted(decontaminate.remove_spans(found.where(~emptied)), docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced."""
    return _counted(pii.sanitise(docs), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids, token_ends of the remaining texts."""
    return bpe.encode(docs).select("doc_id", "lang", "source", "token_ids", "token_ends")


def _counted(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def _stage(function):
    """The stage in a session with the library's defaults (Arrow batches are bounded by bytes)."""

    @functools.wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark)
        return function(spark, docs, sf_dir)

    return stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("near_duplicates", _stage(drop_near_duplicates)),
    ("decontamination", _stage(cut_benchmark)),
    ("pii", _stage(sanitise)),
    ("byte_bpe", _stage(tokenize)),
]

#: Model scores and merges of byte pairs have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each stage's rows are written to the shared folder and
    read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
