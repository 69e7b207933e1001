"""What large tables ask of the plans: texts normalised once, no shuffle where a row has all, one pair listed by many tasks."""

import pytest
from pyspark.sql import functions as F

from spanloom import catalog
from spanloom.functions import text
from spanloom.operators import align, render
from spanloom.plans.fixture import lead, prepared
from spanloom.functions import spans

SF = "/root/testdata/sf0.001"
ROWS = ["ngram_dictionary", "ngram_postings", "ngram_graph_k2", "ngram_graph_k1", "token_occurrence_map", "target_candidates", "highlight_all", "method_sweep", "method_sweep_subwords", "ws_tokens"]
ALL = [*ROWS, "align_all", "align_all_ablated", "align_all_tokens", "alignments_json", "kgram_alignment_tokens", "align_all_joins", "zero_alignment_pairs", "bucket_lookup", "coverage_by_length"]


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


@pytest.mark.parametrize("name", ALL)
def test_a_node_normalises_each_text_once(spark, name):
    """At most a source and a target; a text's transliteration stood four times for each, and more below a filter."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan()
    for node in nodes(plan):
        assert node.simpleString(1 << 20).count("translate(") <= 2


@pytest.mark.parametrize("name", ROWS)
def test_what_a_row_has_is_not_shuffled(spark, name):
    assert "Exchange" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_a_normalised_text_is_written_once(spark):
    df = spark.createDataFrame([("x",)], "t string").select(text.norm_text("t").alias("n"))
    assert sum(n.simpleString(1 << 20).count("translate(") for n in nodes(df._jdf.queryExecution().analyzed())) == 1


def test_one_pair_is_listed_by_many_tasks(spark):
    """All chains of "a b a" among 40 times "a b" in ranges of 100 numbers, none of them twice."""
    df = prepared(spark.createDataFrame([(7, " ".join("ab" * 40), "a b a")], "pair_id long, source string, target string"))
    out = align.alignments(df, at_most=100)
    got = [(r.alignment_id, tuple(r.path)) for r in out.orderBy("alignment_id").collect()]
    want = [(i, j, k) for i in range(0, 80, 2) for j in range(i + 1, 80, 2) for k in range(j + 1, 80, 2)]
    assert got == list(enumerate(want)) and len(got) > 5000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_numbers_beyond_machine_words():
    n = align.Numbered([list(range(k, 400 + k)) for k in range(30)])
    assert int(n.total) > 2**64
    first = [int(n.at[k][j[0]]) for k, j in enumerate(n.chains(0, 1))]
    assert first == list(range(30))


def test_starts_of_many_tokens(spark):
    """Tokens beyond a block begin where they do in the text."""
    words = [("w" * (i % 7 + 1)) for i in range(1000)]
    df = spark.createDataFrame([(" " + " ".join(words),)], "ns string").withColumn("src", text.words("ns"))
    got = df.select(spans.token_starts(F.col("src"), lead()).alias("a")).first().a
    at, want = 1, []
    for w in words:
        want.append(at)
        at += len(w) + 1
    assert got == want


def test_a_text_too_long_is_an_error(spark):
    df = prepared(spark.createDataFrame([(7, " ".join("abc" * 400), "a b c a b c")], "pair_id long, source string, target string"))
    df = df.withColumn("starts_at", spans.token_starts(F.col("src"), lead()))
    with pytest.raises(Exception, match="2 GB"):
        render.highlighted_all(df, "pair_id").collect()
