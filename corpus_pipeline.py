"""A training corpus from documents: five stages, each an operator of the llm subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from symloom.llm import decontaminate, langid, ngram_join, piece_bpe, secret_scan
from symloom.llm.queries import table, tokenizer_path
from symloom.plans.lineage import shared_folder

#: SQL cannot express the stages (learned scores, edit distances, merges); tests hold them against plain versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined go."""
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id."""
    return ngram_join.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks; n_chars follows."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return piece_bpe.encode(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("decontaminate", benchmark_free),
    ("secret_scan", secrets),
    ("piece_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written to the shared folder and read by the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
