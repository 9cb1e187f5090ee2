"""The registered queries of this subpackage, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from captionloom.llm import flac, hard_negatives, html_extract, importance, lexical_search, line_dedup, mixing, ngram_join, pieces, pivot_search, quality_rules, suffix_dedup, url_filter
from captionloom.plans.derived import spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_report(_documents(spark, sf_dir))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.pages_report(_pages(spark, sf_dir))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged_report(_pages(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_report(_documents(spark, sf_dir))


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_report(_documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(_documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces_report(_documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.negatives_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.search_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_importance_resampling, op3_html_extract, op4_url_filter, op5_suffix_dedup, op6_flac_media, op7_quality_rules, op8_line_dedup, op9_mixing, op10_sentencepiece, op11_hard_negatives, op12_lexical_search, op13_pivot_search)}
ORACLES = {"op1_ngram_join": ngram_join.ORACLE, "op4_url_filter": url_filter.ORACLE, "op5_suffix_dedup": suffix_dedup.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_lexical_search": lexical_search.ORACLE, "op13_pivot_search": pivot_search.ORACLE}
