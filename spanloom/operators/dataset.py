"""Making an evaluation set: flattening, filters, de-duplication, shifting, ablation, checks."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import text
from spanloom.tables import Scratch

ANSWER = T.StructType([T.StructField("text", T.StringType()), T.StructField("answer_start", T.IntegerType())])
QA = T.StructType([T.StructField("id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("is_impossible", T.BooleanType()), T.StructField("answers", T.ArrayType(ANSWER))])
PARAGRAPH = T.StructType([T.StructField("context", T.StringType()), T.StructField("qas", T.ArrayType(QA))])
ARTICLE = T.StructType([T.StructField("title", T.StringType()), T.StructField("paragraphs", T.ArrayType(PARAGRAPH))])
SQUAD = T.StructType([T.StructField("data", T.ArrayType(ARTICLE))])


def flatten_squad(squad: DataFrame) -> DataFrame:
    """A record for each answer of each answerable question."""
    a = squad.select(F.explode("data").alias("a")).select(F.coalesce("a.title", F.lit("")).alias("title"), F.explode("a.paragraphs").alias("p"))
    q = a.select("title", F.col("p.context").alias("source"), F.explode("p.qas").alias("q")).where("not coalesce(q.is_impossible, false)")
    r = q.select("title", "source", F.coalesce("q.question", F.lit("")).alias("question"), F.coalesce("q.id", F.lit("")).alias("question_id"), F.explode("q.answers").alias("answer"))
    return r.select("title", "source", F.col("answer.text").alias("target"), F.col("answer.answer_start").alias("idx_start"), "question", "question_id", F.lit(False).alias("is_impossible"), F.lit("answer").alias("answer_type"))


def keep_naive(records: DataFrame) -> DataFrame:
    """Records whose place is the first occurrence of the target."""
    return records.where("source is not null and target is not null and idx_start >= 0").where(text.find("source", "target") == F.col("idx_start"))


def dedupe(records: DataFrame, order: list[str]) -> DataFrame:
    """The first record of each (source, target, idx_start) in a given order."""
    first = F.min_by(F.struct(*records.columns), F.struct(*order)).alias("r")
    return records.groupBy("source", "target", "idx_start").agg(first).select("r.*")


def min_words(records: DataFrame, more_than: int = 2) -> DataFrame:
    return records.where(text.word_count("target") > more_than)


def len_preserved(records: DataFrame) -> DataFrame:
    """Records whose texts keep their length when normalised, so that places stay comparable."""
    return records.where(text.len_preserved("source", "target"))


def shift(records: DataFrame) -> DataFrame:
    """The target takes the space before it, if there is one; the originals stay in ``_orig`` columns."""
    before = (F.col("idx_start") > 0) & (F.substring("source", F.col("idx_start"), F.lit(1)) == " ")
    out = records.withColumn("idx_start_orig", F.col("idx_start")).withColumn("target_orig", F.col("target"))
    return out.withColumn("target", F.when(before, F.concat(F.lit(" "), F.col("target_orig"))).otherwise(F.col("target_orig"))).withColumn("idx_start", (F.col("idx_start_orig") - F.coalesce(before, F.lit(False)).cast("int")).cast("int"))


def add_row_id(records: DataFrame, order: list[str]) -> DataFrame:
    """Dense numbers from 0 in a given order: ranks within ranges, moved by the sizes of the ranges before.

    The ranges are written first: both branches below read the same ones, whatever is lost and sampled again."""
    ranged = records.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = Scratch(records.sparkSession, "row-ids").keep(ranged, "ranges")
    local = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = local.groupBy("_part").count()
    # one row for each range
    before = sizes.withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).drop("count")
    return local.join(before, "_part").withColumn("row_id", F.col("_rank") + F.col("_before") - 1).drop("_part", "_rank", "_before")


def semi_keep(records: DataFrame, keep: DataFrame, on: list[str]) -> DataFrame:
    return records.join(keep.select(*on), on, "left_semi")


def group_starts(records: DataFrame) -> DataFrame:
    """(source, target, idx_start array): the places of each pair, ascending."""
    return records.groupBy("source", "target").agg(F.sort_array(F.collect_set("idx_start")).alias("idx_start"))


def aligned_lookup(tdf: DataFrame, wdf: DataFrame, strict: bool = False) -> DataFrame:
    """Shifted pairs with the clean pair of the same source and stripped target; duplicates expand, misses are left out.

    ``strict`` fails on a miss, as soon as a task meets one: every shifted pair is expected to have its clean one."""
    a = tdf.withColumn("_key", F.trim("target"))
    b = wdf.select("source", F.col("target").alias("_key"), F.col("idx_start").alias("clean_starts"))
    if not strict:
        return a.join(b, ["source", "_key"]).drop("_key")
    found = a.join(b.withColumn("_hit", F.lit(True)), ["source", "_key"], "left")
    checked = F.when(F.col("_hit"), F.col("clean_starts")).otherwise(F.raise_error(F.concat(F.lit("no clean pair for: "), F.col("target"))))
    return found.withColumn("clean_starts", checked).drop("_key", "_hit")


def span_mismatches(records: DataFrame) -> DataFrame:
    return records.where(F.substring("source", F.col("idx_start") + 1, F.length("target")) != F.col("target"))


def shift_rule() -> Column:
    """Whether all moved records moved by one, over a space that the target took; true if none moved."""
    o = F.col("idx_start_orig")
    ok = (o > 0) & (F.substring("source", o, F.lit(1)) == " ") & (F.col("idx_start") == o - 1) & (F.col("target") == F.concat(F.lit(" "), F.col("target_orig")))
    return F.coalesce(F.bool_and(F.when(F.col("idx_start") != o, F.coalesce(ok, F.lit(False)))), F.lit(True))


def funnel(records: DataFrame, order: list[str]) -> DataFrame:
    """How many records each step leaves, in one row."""
    naive = keep_naive(records)
    distinct = dedupe(naive, order)
    clean = len_preserved(distinct)
    moved = shift(clean)
    bad = F.substring("source", F.col("idx_start") + 1, F.length("target")) != F.col("target")
    n = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.lit(None).cast("bigint").alias("moved"), F.lit(None).cast("bigint").alias("bad"), F.lit(None).cast("boolean").alias("rule"))
    last = moved.agg(F.lit("n_len_ok").alias("name"), F.count("*").alias("n"), F.count_if(F.col("idx_start") != F.col("idx_start_orig")).alias("moved"), F.count_if(bad).alias("bad"), shift_rule().alias("rule"))
    rows = n(records, "n_raw").unionByName(n(naive, "n_naive")).unionByName(n(distinct, "n_dedup")).unionByName(last)
    counts = [F.max(F.when(F.col("name") == x, F.col("n"))).alias(x) for x in ("n_raw", "n_naive", "n_dedup", "n_len_ok")]
    return rows.agg(*counts, F.max("moved").alias("n_shifted"), F.max("bad").alias("n_span_bad"), F.bool_and("rule").alias("shift_rule_ok"))


def ablate_word(target: Column, pair_id: Column) -> tuple[Column, Column]:
    """The target without one inner word, and the word's number; a hash of the pair picks it, so the order of rows does not
    matter. A leading space stays. Fewer than three words: null."""
    words = text.words(target)
    at = 1 + text.bucket_of(pair_id, F.greatest(F.size(words) - 2, F.lit(1)))
    left = F.array_join(F.filter(words, lambda x, i: i != at), " ")
    ok = F.size(words) >= 3
    return F.when(ok, F.when(F.startswith(target, F.lit(" ")), F.concat(F.lit(" "), left)).otherwise(left)), F.when(ok, at)


def ablate_subword(tokenizer, seed: int = 3):
    """A function of (normalised target, pair key in hex) to the target without one inner subword and the subword's number,
    by the generator of the standard library seeded with the key. Fewer than three subwords: null."""
    tokens_of = tokenizer.tokens_of

    @F.pandas_udf(T.StructType([T.StructField("target", T.StringType()), T.StructField("idx", T.IntegerType())]))
    def run(target: pd.Series, key: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k in zip(target, key):
            tokens = tokens_of(t) if t is not None and k is not None else []
            if len(tokens) < 3:
                rows.append((None, None))
                continue
            at = random.Random(seed ^ int(k, 16)).randint(1, len(tokens) - 2)
            rows.append(("".join(x["token"] for i, x in enumerate(tokens) if i != at), at))
        return pd.DataFrame(rows, columns=["target", "idx"]).astype({"idx": "Int32"})

    return run


def zero_pairs(pairs: DataFrame, alignments: DataFrame, key: str = "pair_id") -> DataFrame:
    """Pairs that no alignment has, with all their columns: those of an ablation (``ablate_target``, ``ablate_idx``) too."""
    return pairs.join(alignments.select(key).distinct(), key, "left_anti")


def by_split(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits together with the name of each."""
    out = None
    for name, df in splits.items():
        named = df.withColumn("split", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out
