"""Quality rules as a learned decision list, in DataFrame expressions throughout.

Statistics of a text are built-in expressions over its array of words, in one narrow projection: no shuffle, no explode, so
a text of any length costs its own row only. Sequential covering learns an ordered list of threshold conjunctions for the
reject class: a rule is grown condition by condition on FOIL gain over two thirds of the labelled rows, pruned from its end
on the other third, kept while its precision there holds, and the rows that it covers are set aside. The list becomes one
ordered ``CASE`` expression. Fitting collects the statistics (numbers only) of at most ``max_labels`` labelled rows, those
with the smallest hash of their id; every document is judged.

A null or blank text has no words: it fails the base rule. A text is judged by itself, so repeated rows get the same result.
Null labels are skipped; with no labels of either class the list is empty and the base rule alone decides. Two 5-word
windows are taken as equal if a 64-bit hash of theirs is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Statistics that a rule may test, as expressions over the columns that ``statistics`` adds.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "line_length": "n_words / greatest(n_lines, 1)",
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and those that rules test.

    Columns of these names are replaced; any other passes, also one that is called like a step in between."""
    steps = {"_t", "_w", "_n", "_lines", "_h", "_g", "_s", "_d"}
    aside = {c: f"_aside{c}" for c in docs.columns if c.lower() in steps}
    docs, text = docs.withColumnsRenamed(aside), aside.get(text, text)
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_t", t).withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    out = out.withColumn("_n", F.size("_w"))
    out = out.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    # hash of the window that starts at each word; the last four start none
    out = out.withColumn("_g", F.when(F.col("_n") >= WINDOW, F.transform(F.slice("_h", 1, F.greatest(F.col("_n") - WINDOW + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get("_h", i + k) for k in range(1, WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("_g")) < F.size("_g")
    out = out.withColumn("_s", F.when(again, F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("k"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("_s", j)["k"] == x["k"], F.lit(False))
    out = out.withColumn("_d", F.sort_array(F.filter(F.transform("_s", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda i: i.isNotNull())))
    reach = F.transform("_d", lambda i, j: F.least(F.coalesce(F.get("_d", j + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    count = lambda p: F.regexp_count("_t", F.lit(p)).cast("long")
    out = out.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.aggregate("_w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(total(reach), F.lit(0)).cast("long"),
        "n_capitals": count("[A-Z]"),
        "n_marks": count("[!?]"),
        "n_digits": count("[0-9]"),
        "n_lines": F.size("_lines").cast("long"),
        "n_distinct": F.size(F.array_distinct("_h")).cast("long"),
    })
    return out.drop(*steps).withColumnsRenamed({v: k for k, v in aside.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)


def learn(rows: list[tuple[list[float], bool]], min_precision: float = 0.95, max_rules: int = 12, max_conditions: int = 4, cuts: int = 48) -> list[Rule]:
    """Sequential covering over (features, rejected) rows; sets of rows are bits of integers."""
    n = len(rows)
    if not n or len({bad for _, bad in rows}) < 2:
        return []
    bits = lambda keep: sum(1 << i for i in range(n) if keep(i))
    bad = bits(lambda i: rows[i][1])
    prune_set = bits(lambda i: i % 3 == 2)
    grow_set = ((1 << n) - 1) ^ prune_set
    tests: list[tuple[Condition, int]] = []
    for f, name in enumerate(FEATURES):
        values = sorted({r[0][f] for r in rows})
        # quantiles over all rows and over the reject class, so that a rare class has cuts of its own
        own = sorted({r[0][f] for r in rows if r[1]})
        picks = {v[min(len(v) - 1, len(v) * q // cuts)] for v in (values, own) if v for q in range(cuts)}
        for x in sorted(picks):
            over = bits(lambda i: rows[i][0][f] > x)
            tests += [(Condition(name, True, x), over), (Condition(name, False, x), ((1 << n) - 1) ^ over)]
    rules: list[Rule] = []
    left = (1 << n) - 1
    while len(rules) < max_rules:
        inside, chosen = left & grow_set, []
        p0, n0 = (inside & bad).bit_count(), (inside & ~bad).bit_count()
        while n0 and p0 and len(chosen) < max_conditions:
            best = (0.0, None, 0)
            base = math.log2(p0 / (p0 + n0))
            for c, rows_in in tests:
                x = inside & rows_in
                p = (x & bad).bit_count()
                if p and (gain := p * (math.log2(p / x.bit_count()) - base)) > best[0] + 1e-9:
                    best = (gain, c, rows_in)
            if best[1] is None:
                break
            chosen.append((best[1], best[2]))
            inside &= best[2]
            p0, n0 = (inside & bad).bit_count(), (inside & ~bad).bit_count()
        if not chosen:
            break

        def worth(conditions) -> tuple[float, int, int]:
            x = left & prune_set
            for _, rows_in in conditions:
                x &= rows_in
            p, q = (x & bad).bit_count(), (x & ~bad).bit_count()
            return ((p - q) / (p + q) if p + q else -1.0, p, q)

        kept = max((chosen[:k] for k in range(1, len(chosen) + 1)), key=lambda c: (worth(c)[0], worth(c)[1]))
        _, p, q = worth(kept)
        covered = left
        for _, rows_in in kept:
            covered &= rows_in
        all_p, all_q = (covered & bad).bit_count(), (covered & ~bad).bit_count()
        if not p or p / (p + q) < min_precision or all_p / (all_p + all_q) < min_precision:
            break
        rules.append(Rule(tuple(c for c, _ in kept), all_p / (all_p + all_q)))
        left &= ~covered
        if not left & bad & grow_set:
            break
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 4000) -> list[Rule]:
    """A decision list from ``labels`` (doc_id, quality: 0 is the reject class) over the texts of ``docs``."""
    named = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    known = statistics(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")).withColumn("base_failed", base_failed())
    # a filter here would be pushed below the statistics, which would then be computed again for it
    rows = known.select("doc_id", "quality", "base_failed", *[F.expr(e).alias(f) for f, e in FEATURES.items()]).collect()
    rows = [r for r in rows if not r["base_failed"]]
    rows.sort(key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 & (1 << 64) - 1, r["doc_id"]))
    return learn([([float(r[f]) for f in FEATURES], r["quality"] == 0) for r in rows])


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects, from 1; 0 if none does."""
    out = None
    for k, r in enumerate(rules, 1):
        out = F.when(r.column(), k) if out is None else out.when(r.column(), k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with the statistics, base_failed, rule (0: none) and kept."""
    out = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def only_kept(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that pass. The verdict is exploded rather than filtered on: a filter would be pushed below the
    statistics and compute them twice."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")  # columns of docs may have the names of statistics
    return judge(rows, rules).select("_row", F.explode(F.when(F.col("kept"), F.array(F.lit(1))))).select("_row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
