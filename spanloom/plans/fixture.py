"""Pairs of a source and a target from the driver's documents: a paragraph and a phrase of its own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import spans, text
from spanloom.tables import table


def paragraphs(docs: DataFrame) -> DataFrame:
    """(pair_id, doc_id, source, w): lines of 8 words and more, which a target needs, with single spaces, and their words."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("par", "line"))
    out = lines.select((F.col("doc_id") * 10000000 + F.col("par")).alias("pair_id"), "doc_id", text.squash("line").alias("source"))
    out = out.withColumn("w", F.array_remove(F.split("source", " "), ""))
    # a filter would be pushed below the words and make them a second time
    return out.select("pair_id", "doc_id", "source", F.explode(F.filter(F.array("w"), lambda w: F.size(w) >= 8)).alias("w"))


def pairs(spark: SparkSession, sf_dir: str, ablated: bool = False) -> DataFrame:
    """(pair_id, source, target): the target is words 3 to 8, or those without one inner word."""
    out = paragraphs(table(spark, sf_dir, "documents")).withColumn("t", F.slice("w", 3, 6))
    if ablated:
        out = out.withColumn("gap", 1 + text.bucket_of(F.col("pair_id"), F.lit(4)))
        out = out.withColumn("t", F.filter("t", lambda x, i: i != F.col("gap")))
    return out.select("pair_id", "source", F.array_join("t", " ").alias("target"))


def prepared(df: DataFrame) -> DataFrame:
    """Pairs with normalised texts ``ns``, tokens ``src``, steps ``q``, their candidates, and the first and last embedding."""
    out = df.withColumn("ns", text.norm_text("source"))
    out = out.withColumn("src", F.array_remove(F.split("ns", " "), "")).withColumn("_t", F.array_remove(F.split(text.norm_text("target"), " "), ""))
    out = out.withColumn("q", spans.steps(F.col("src"), F.col("_t")))
    out = out.withColumn("cand", spans.candidates(F.col("src"), F.col("q")))
    return out.withColumn("first", spans.first_alignment(F.col("cand"))).withColumn("last", spans.last_alignment(F.col("cand"))).drop("_t")


def lead():
    return F.startswith("ns", F.lit(" ")).cast("int")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, kind, source, target, idx_start): three answers for each paragraph with the place they were taken from."""
    p = paragraphs(table(spark, sf_dir, "documents"))
    offset = lambda k: F.startswith("source", F.lit(" ")).cast("int") + F.aggregate(F.slice("w", 1, k), F.lit(0), lambda a, x: a + F.length(x) + 1)
    answers = [(0, 3, 6), (1, 5, 1), (2, 2, 4)]
    structs = [F.struct(F.lit(kind).alias("kind"), F.array_join(F.slice("w", at, n), " ").alias("target"), offset(at - 1).cast("int").alias("idx_start")) for kind, at, n in answers]
    return p.select("pair_id", "source", F.explode(F.array(*structs)).alias("a")).select("pair_id", F.col("a.kind").alias("kind"), "source", F.col("a.target").alias("target"), F.col("a.idx_start").alias("idx_start"))
