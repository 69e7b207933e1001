"""Accuracy, multiplicity, coverage and scaling of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text


def set_operations(df: DataFrame, real: str, predicted: str, name: str) -> DataFrame:
    """What is only in the real set, in both, only in the predicted set, the sizes of these, and whether all real ones are found."""
    left, both, right = F.array_except(real, predicted), F.array_intersect(real, predicted), F.array_except(predicted, real)
    return df.withColumns({f"{name}_lv": F.sort_array(left), f"{name}_xv": F.sort_array(both), f"{name}_rv": F.sort_array(right), f"{name}_l": F.size(left), f"{name}_x": F.size(both), f"{name}_r": F.size(right), f"{name}_found": F.size(left) == 0})


def percent(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double")) * 100


def micro(df: DataFrame, flags: list[str]) -> DataFrame:
    return df.agg(*[percent(f).alias(f) for f in flags])


def by_bucket(df: DataFrame, bucket: str, flags: list[str]) -> DataFrame:
    return df.groupBy(bucket).agg(F.count("*").alias("n"), *[percent(f).alias(f) for f in flags])


def macro(df: DataFrame, bucket: str, flags: list[str]) -> DataFrame:
    """Means over buckets of means over rows."""
    return by_bucket(df, bucket, flags).agg(*[F.avg(f).alias(f) for f in flags])


def bucket_lookup(df: DataFrame, bucket: str, flags: list[str]) -> DataFrame:
    """Each row with the accuracy of its bucket."""
    own = by_bucket(df, bucket, flags).select(bucket, *[F.col(f).alias(f"{f}_bucket") for f in flags])
    return df.join(own, bucket, "left")


def least_below(df: DataFrame, bucket: str, flags: list[str], limit: int) -> DataFrame:
    return by_bucket(df, bucket, flags).where(F.col(bucket) <= limit).agg(*[F.min(f).alias(f) for f in flags])


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of both flags with all totals (null stands for a total), and percentages of all rows."""
    cells = df.cube(a, b).agg(F.count("*").alias("n"))
    # nine rows at most, of which the grand total is the largest
    return cells.withColumn("percent", F.col("n") * 100.0 / F.max("n").over(Window.partitionBy(F.lit(1))))


def multimap(df: DataFrame, n: str) -> DataFrame:
    c = F.col(n)
    return df.agg(
        F.count("*").alias("n_pairs"), F.count_if(c > 1).alias("n_multimap"), F.avg((c > 1).cast("double")).alias("frac_multimap"), F.max(c).cast("bigint").alias("max_alignments"),
        F.avg(c.cast("double")).alias("mean_alignments"), F.percentile(c.cast("double"), 0.5).alias("median_alignments"), F.count_if(c == 0).alias("n_zero"), F.avg((c == 0).cast("double")).alias("frac_zero"),
    )


def describe(df: DataFrame, n: str) -> DataFrame:
    c = F.col(n).cast("double")
    return df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *[F.percentile(c, q / 100).alias(f"p{q}") for q in (25, 50, 75)], F.max(c).alias("max"))


def pair_summary(df: DataFrame, n: str, source: str = "source", target: str = "target") -> DataFrame:
    c = F.col(n)
    return df.agg(
        F.count("*").alias("n_pairs"), F.count_if(c == 0).alias("n_zero"), F.avg(F.when(c > 0, c.cast("double"))).alias("mean_align"),
        F.avg(F.length(source)).alias("mean_source_chars"), F.avg(text.word_count(source)).alias("mean_source_ws"), F.avg(F.length(target)).alias("mean_target_chars"), F.avg(text.word_count(target)).alias("mean_target_ws"),
    )


def text_statistics(df: DataFrame, column: str) -> DataFrame:
    """Means over the distinct texts of a column, and how many there are."""
    return df.select(column).distinct().agg(F.count("*").alias("n_samples"), F.avg(F.length(column)).alias("chars"), F.avg(text.word_count(column)).alias("words"))


def mean_word_length(df: DataFrame, column: str) -> DataFrame:
    """Over the pieces between single spaces, empty ones too."""
    return df.select(F.explode(F.split(column, " ")).alias("w")).agg(F.avg(F.length("w")).alias("mean_word_length"))


def mean_and_error(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("sem"))


def power_law(df: DataFrame, x: str, y: str) -> DataFrame:
    """a and b of y = a x ** b, by least squares of the logarithms."""
    lx, ly = F.log10(x), F.log10(y)
    return df.where((F.col(x) > 0) & (F.col(y) > 0)).agg(F.pow(F.lit(10.0), F.regr_intercept(ly, lx)).alias("a"), F.regr_slope(ly, lx).alias("b"), F.min(x).cast("double").alias("x_min"), F.max(x).cast("double").alias("x_max"))


def power_grid(fit: DataFrame, points: int = 1000) -> DataFrame:
    """Points of a fitted law, even on the logarithm of x."""
    k = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    out = fit.select("*", k.alias("k")).withColumn("x", F.pow(F.lit(10.0), F.log10("x_min") + F.col("k") * (F.log10("x_max") - F.log10("x_min")) / (points - 1)))
    return out.select("k", "x", (F.col("a") * F.pow("x", F.col("b"))).alias("y"))


def coverage(first_tokens: Column, n_target: Column) -> Column:
    """Distinct tokens of the first alignment over the target's tokens; 0 without one, null for an empty target."""
    return F.when(first_tokens.isNull(), 0.0).otherwise(F.size(F.array_distinct(first_tokens))) / F.nullif(n_target, F.lit(0))


def reverse_cdf(df: DataFrame, n: str, key: str, span: int = 1 << 16) -> DataFrame:
    """(rank, n): values in falling order. Equal values are one row of the count table, so ranks are running sums of counts.

    Only the count table, one row for each different value, passes one task; its runs of ranks are cut into ranges of ``span``
    and dealt out before any rank is made."""
    counts = df.groupBy(n).agg(F.count("*").alias("count"))
    upto = counts.withColumn("_upto", F.sum("count").over(Window.orderBy(F.desc(n))))
    begins = upto.select(n, "_upto", F.explode(F.sequence(F.col("_upto") - F.col("count") + 1, F.col("_upto"), F.lit(span))).alias("_from"))
    dealt = begins.repartition("_from")
    return dealt.select(F.explode(F.sequence("_from", F.least("_upto", F.col("_from") + span - 1))).alias("rank"), n)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): equal widths from the least to the largest value, the last bin closed; bins from 1."""
    ends = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    lo, hi = (F.lit(x).cast("double") for x in ends)
    at = F.when(lo == hi, 1).otherwise(F.least(F.floor((F.col(value).cast("double") - lo) * bins / F.nullif(hi - lo, F.lit(0.0))) + 1, F.lit(bins)))
    return df.where(F.col(value).isNotNull()).groupBy(at.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def containment(docs: DataFrame, items: DataFrame, inner: int = 4) -> DataFrame:
    """(doc_id, item_id, start_idx): where each passage of (item_id, passage) first occurs in each of (doc_id, text).

    A text that contains a passage has the passage's inner words, all but its first and last, which may be parts of words there.
    The first ``inner`` of these are the passage's key, of as many words as there are; a text's runs of words are looked up by
    an equi-join on the hash of such a key, then the texts decide. Only runs that some passage has are kept before the shuffle if the
    keys are few enough to be broadcast, which Spark decides by their size. A passage without inner words has its pieces in any text:
    it is compared with all of them, in as many tasks as there are texts."""
    w = text.words("passage")
    keyed = items.where("passage is not null").select("item_id", "passage", F.slice(w, 2, F.greatest(F.least(F.size(w) - 2, F.lit(inner)), F.lit(0))).alias("_key"))
    keyed = keyed.withColumn("_n", F.size("_key")).withColumn("_hash", F.xxhash64("_key"))
    words = docs.select("doc_id", "text", text.words("text").alias("_w"))
    hits = None
    run_of = lambda n: lambda i: F.xxhash64(F.slice("_w", i, n))
    for n in range(1, inner + 1):
        places = F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1)))
        grams = words.select("doc_id", F.explode(F.array_distinct(F.transform(places, run_of(n)))).alias("_hash"))
        own = keyed.where(F.col("_n") == n).select("item_id", "_hash")
        part = grams.join(own, "_hash").select("doc_id", "item_id")
        hits = part if hits is None else hits.unionByName(part)
    found = hits.join(keyed.select("item_id", "passage"), "item_id").join(docs, "doc_id")
    bare = keyed.where("_n = 0").select("item_id", "passage")
    every = found.select("doc_id", "item_id", "text", "passage").unionByName(docs.join(bare, F.contains("text", F.col("passage"))).select("doc_id", "item_id", "text", "passage"))
    return every.where(F.contains("text", F.col("passage"))).select("doc_id", "item_id", text.find("text", "passage").alias("start_idx")).distinct()
