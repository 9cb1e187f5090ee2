"""Training-corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next.

Quality rules drop what they reject; line dedup takes repeated lines out of texts (a document that loses all its lines
stays, empty); near copies leave one document of each component, the one with the smallest id; mixing repeats or leaves
out documents so that each source meets its token target; encoding adds token ids. All stages but the last return the
columns of `documents`, with n_chars as the text's length. Null texts and texts without words fail the quality rules; null
ids and sources are values; rows that repeat count as copies, of which one stays; other columns pass untouched, whatever
their names; empty tables give empty tables. Not expressible in SQL: tests compare with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.llm import line_dedup, mixing, ngram_join, pieces, quality_rules
from captionloom.llm.common import cut, scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_quality),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote on its way goes when its result is written
            docs = cut(stage(spark, docs, sf_dir), lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
