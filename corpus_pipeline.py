"""A training corpus from raw documents: quality rules, near and substring duplicates, secrets, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All
but the last return the columns of ``documents``. Texts that a stage changes have their ``n_chars`` counted again.

For every stage: an empty table gives an empty result, extra columns pass whatever their names (the last stage leaves them out),
rows that repeat an id or a whole row are rows of their own unless a stage says otherwise, and texts of any length are processed whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import packing, quality, secrets, simhash, suffix_tree
from spanloom.tables import Scratch, released, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from the labels. A null text has no words and goes."""
    return quality.only_kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (shingles of five words, similarity 0.8).

    Rows without an id stay, rows that repeat an id stay or go together, and a null text is a copy of an empty one."""
    return simhash.drop_copies(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that a document with a smaller id has too; no id counts as the largest.

    Rows of one id leave each other's text alone. A null text stays null."""
    return _counted(suffix_tree.strip_repeats(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every finding replaced by a mark. A null text stays null."""
    return _counted(secrets.redact(docs, secrets.fit(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens. A null text has the closing id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: Learned rules, fingerprints and a network have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline", lasting=True)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with released():  # what a stage wrote for itself goes once its result is written, and that once the next one's is
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
