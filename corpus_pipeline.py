"""Corpus pipeline: five stages over ``documents``, each one operator of ``kestrel.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet to the shared folder and read back as the next
stage's docs. All stages but the last return the columns of ``documents``.

Defined results are those of the operators; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import common, language_id, line_dedup, mixing, sentencepiece_codec, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without a letter or without a clear language go."""
    return language_id.known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across documents stay in the largest doc_id only; n_chars follows the text."""
    out = line_dedup.line_dedup(docs, counts=False)
    return common.with_n_chars(out).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, 3 bits)."""
    return simhash.keep_one(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that meet the target token shares."""
    return mixing.select_mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, SentencePiece ids, their number, and whether they decode to the text."""
    return sentencepiece_codec.encode_checked(docs, sentencepiece_codec.production_vocabulary())


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("target_mix", target_mix),
    ("sentencepiece", encode),
]
ORACLE_SQL = None   # language scores, SimHash and Viterbi are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
