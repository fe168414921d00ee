"""A training corpus from raw documents: five stages, each an operator of ``quillspark.llm``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, language, line_dedup, similar
from quillspark.llm.common import documents, limit_batches, materialize
from quillspark.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters, or unlike every language, go."""
    ship(spark)
    model = language.learn(docs)
    return docs.where(~language.identify(model, docs)["rejected"]).select(docs.columns)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are deleted; documents of which nothing is left go."""
    ship(spark)
    found = line_dedup.dedupe_lines(docs)
    left = found.where((F.col("removed_lines") == 0) | (F.trim(F.col("text")) != ""))
    n_chars = F.when(F.col("removed_lines") == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return left.withColumn("n_chars", n_chars).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of least doc_id.  Documents are linked by
    their SimHash fingerprints, as in op8, and also where their shingles are 0.8 similar."""
    ship(spark)
    return similar.keep_one_of_each(docs, words_in_shingle=3).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    ship(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    ship(spark)
    limit_batches(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), decode=False).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("line_dedup", dedupe_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("encoding", encode),
]

#: Learned models and pairwise alignment have no SQL form; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
