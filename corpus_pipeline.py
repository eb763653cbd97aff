"""From documents to a clean, tokenised corpus: the stages in order, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from granary.llm import bpe, decontam, exact_dedup, ngram_join, quality
from granary.llm.common import drop
from granary.llm.queries import _ranks
from granary.session import load, shared_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, *_ranks(), with_ids=True)


STAGES = [
    ("quality", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the language model or the tokenizer; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written as Parquet in the shared folder and read again.

    A stage's table goes once the next one is written; the last is the result, in a folder of its own
    (what Spark reads lazily can't be removed here).
    """
    out = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = load(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{out}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
    return docs
