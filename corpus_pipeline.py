"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry import storage
from quarry.llm import exact_dedup, jaccard_join, language, mixing, packing
from quarry.llm.common import bounded_batches, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of a recognised language stay; the filters learn from the labelled rows.

    Null and empty texts and texts without letters have no language and go. Repeated rows stay or go alike. Other columns, null or not, and
    of any further name, are kept as they are. No rows give no rows.
    """
    return language.keep_known(bounded_batches(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: that of most code points, then of the smallest id; a null id comes last.

    Null and empty texts are one group. Of repeated rows one stays. Other columns and further ones are kept. No rows give no rows.
    """
    return exact_dedup.keep_one(bounded_batches(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, that of the smallest id.

    Null and empty texts are similar to nothing and stay. Of repeated rows one stays. Very long texts are whole sets. Other columns
    and further ones are kept. No rows give no rows.
    """
    return jaccard_join.keep_one(bounded_batches(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, from none to three times.

    A null source is a source of its own, the last. Null and empty texts have size 0 and aren't taken. Repeated rows are documents of their
    own. Other columns and further ones are repeated with their row. No rows give no rows.
    """
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of a document in sequences of 2048 tokens.

    Null and empty texts are one token, the closing one. Very long texts are cut to pieces. Rows of one id, as the mix repeats
    them, are packed each alone. Of other columns the id alone is kept. No rows give no rows.
    """
    return packing.pack(bounded_batches(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL has neither the language model, the similarity join nor the packing. Tests compare what each stage keeps with brute
#: force on the smallest tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = storage.shared_folder(spark)
        with storage.scope(spark):  # the stage's own tables go when it is written, and so does its input
            docs = storage.materialise(stage(spark, docs, sf_dir), f"{path}/{name}")
        if before:
            storage.remove(spark, before)
        before = path
    return docs
