"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import exact_dedup, hard_negatives, jaccard_join, language, lm_scoring, manifest, mixing, near_dedup, packing, personal_data, quality, token_counts, url_filter
from quarry.llm.common import bounded_batches, read


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(read(spark, sf_dir, name))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all ``documents``."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``."""
    return language.predicted(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mix of all sources takes each document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every url of ``pages``."""
    return url_filter.judged(_table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the five-word shingles of all ``documents``."""
    return jaccard_join.similar(_table(spark, sf_dir, "documents")).drop("set_id", "class_key")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and perplexity bands on all ``documents``."""
    return quality.judged(_table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a model of the training part."""
    return lm_scoring.scored(_table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    return personal_data.personal_data(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of ``documents`` in sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and check of every document."""
    return manifest.manifest(read(spark, sf_dir, "documents"))


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of similar documents."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor among ``embeddings``."""
    return hard_negatives.mined(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_language": op3_language,
    "op4_mixing": op4_mixing,
    "op5_url_filter": op5_url_filter,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality": op7_quality,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_personal_data": op9_personal_data,
    "op10_packing": op10_packing,
    "op11_manifest": op11_manifest,
    "op12_near_dedup": op12_near_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_mixing": mixing.SQL,
    "op11_manifest": manifest.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
