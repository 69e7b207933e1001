"""Queries that SQL cannot say, and plans, against plain Python on small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanloom import catalog, tables
from spanloom.functions import spans, text
from spanloom.operators import align, baselines, dataset, evaluate
from spanloom.plans import fixture


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with short lines, long ones, and lines of few different words."""
    r = random.Random(3)
    line = lambda n, k: " ".join("".join(r.choices("abcdeé", k=r.randint(1, k))) for _ in range(n))
    rows = [(i, "\n".join(line(r.choice((3, 8, 9, 15, 40)), r.choice((1, 2, 5))) for _ in range(4))) for i in range(20)]
    rows += [(20, line(700, 6)), (21, None), (22, ""), (23, " \n  lead " + line(9, 2))]
    base = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{base}/documents.parquet")
    return base


def test_long_lines_are_pairs_too(spark, small):
    assert fixture.pairs(spark, small).where(F.size(F.split("source", " ")) == 700).count() == 1


def test_single_words_are_all_linked(spark, small):
    got = {tuple(r) for r in catalog.QUERIES["ngram_graph_k1"](spark, small).collect()}
    want = set()
    for p in fixture.pairs(spark, small).withColumn("w", text.words(text.norm_text("source"))).collect():
        ids = list(range(len(dict.fromkeys(p.w))))
        want |= {(p.pair_id, a, b) for a, b in itertools.permutations(ids, 2)}
    assert got == want and len(want) > 10000


def lcs(a, b):
    """Length of a longest common subsequence, by the table."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for j, y in enumerate(b):
            rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
    return rows[-1][-1]


@pytest.mark.parametrize("query,make,separator", [("method_sweep", "_word_pairs", " "), ("method_sweep_subwords", "_subword_pairs", "")])
def test_methods_against_plain_python(spark, small, query, make, separator):
    pairs = {p.pair_id: p for p in getattr(catalog, make)(spark, small, True).collect()}
    rows = catalog.QUERIES[query](spark, small).collect()
    assert {(r.pair_id, r.method) for r in rows} == {(i, m) for i in pairs for m in ("naive", "custom", "lcs", "difflib")}
    for r in rows:
        p = pairs[r.pair_id]
        if r.method == "naive":
            at, shown, starts = p.source.find(p.target), p.target if p.target in p.source else "", None
        else:
            path = {"custom": lambda: p.first or [], "lcs": lambda: baselines.lcs_positions(p.src, p.tgt), "difflib": lambda: baselines.block_positions(p.src, p.tgt)}[r.method]()
            at, shown = p.starts_at[path[0]] if path else -1, separator.join(p.shown[i] for i in path)
            if r.method == "lcs":
                assert len(path) == lcs(p.src, p.tgt)
            starts = [p.starts_at[i] for i in (p.cand[0] if p.cand else []) if p.last and i <= p.last[0]] if r.method == "custom" else None
        assert (r.start_idx, r.text) == (at, shown), r
        assert r.found == (p.gold in starts if starts is not None else at == p.gold) and r.same == (shown.strip(" ") == p.target.strip(" "))


def test_subword_alignments_against_brute_force(spark, small):
    pairs = catalog._subword_pairs(spark, small).where(F.size("src") < 60).collect()
    got = {}
    prepared = catalog._subword_pairs(spark, small).where(F.size("src") < 60)
    for r in align.alignments(prepared).collect():
        got.setdefault(r.pair_id, []).append(",".join(map(str, r.path)))
    answers = {r.pair_id: r for r in prepared.select("pair_id", spans.count_alignments(F.col("cand")).alias("n"), "first", spans.start_positions(F.col("cand"), F.col("last")).alias("starts")).collect()}
    for p in pairs:
        steps = [x for x in p.tgt if x in p.src]
        steps = [x for k, x in enumerate(steps) if not k or x != steps[k - 1]]
        paths = [[]] if steps else []
        for x in steps:
            paths = [[*q, i] for q in paths for i, y in enumerate(p.src) if y == x and (not q or i > q[-1])]
        want = [",".join(map(str, q)) for q in sorted(paths)]
        assert sorted(got.get(p.pair_id, [])) == sorted(want)
        a = answers[p.pair_id]
        assert a.n == len(want) and a.first == (sorted(paths)[0] if want else None)
        assert a.starts == sorted({q[0] for q in paths})


def test_texts_of_other_scripts(spark):
    """Every script keeps its words apart, and composed and decomposed letters are one."""
    rows = {"Größe": "Grosse", "Ελληνική θάλασσα": "Ellenike thalassa", "Жизнь ёлка щука": "Zhizn' iolka shchuka", "서울 한국": "seoul hangug", "かな カナ": "kana kana", "½ € ﬁn １２": "1/2 EUR fin 12", "中文": "u4e2d u6587 ", "😀 ok": " ok", "ë ё": "e io"}
    df = spark.createDataFrame(list(rows.items()), "t string, want string").select("t", "want", text.norm_text("t").alias("got"))
    for r in df.collect():
        assert r.got == r.want and r.got.isascii(), r


def test_ranks_are_made_in_many_tasks(spark):
    df = spark.range(0, 5000, 1, 4).selectExpr("id", "id % 3 as n")
    out = evaluate.reverse_cdf(df, "n", "id", span=100)
    got = sorted(map(tuple, out.collect()))
    assert got == list(enumerate(sorted((i % 3 for i in range(5000)), reverse=True), 1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = evaluate.reverse_cdf(df, "n", "id", span=100).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) > 3


def test_a_missing_clean_pair_is_an_error(spark):
    a = spark.createDataFrame([("s", " t", [1])], "source string, target string, idx_start array<int>")
    b = spark.createDataFrame([("s", "t", [2]), ("s", "u", [3])], "source string, target string, idx_start array<int>")
    assert dataset.aligned_lookup(a, b, strict=True).first().clean_starts == [2]
    assert dataset.aligned_lookup(a, b.where("target = 'u'")).count() == 0
    with pytest.raises(Exception, match="no clean pair"):
        dataset.aligned_lookup(a, b.where("target = 'u'"), strict=True).collect()


def test_zero_pairs_keep_their_columns(spark):
    pairs = spark.createDataFrame([(1, "s", "t", "u", 2), (2, "s", "t", "v", 3)], "pair_id long, source string, target string, ablate_target string, ablate_idx int")
    found = spark.createDataFrame([(1, 0)], "pair_id long, alignment_id int")
    assert [tuple(r) for r in dataset.zero_pairs(pairs, found).collect()] == [(2, "s", "t", "v", 3)]


def test_scratch_tables_go(spark, tmp_path):
    """Tables of a block are deleted when it ends, but for lasting ones; a cluster needs a shared folder."""
    import os

    with tables.released():
        kept = tables.Scratch(spark, "out", lasting=True)
        gone = tables.Scratch(spark, "in")
        df = kept.keep(gone.keep(spark.range(5), "a"), "b")
        paths = [x.removeprefix("file:") for x in (gone.paths["a"], kept.paths["b"])]
        assert all(map(os.path.isdir, paths))
    assert not os.path.isdir(paths[0]) and df.count() == 5

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://x:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(Cluster)
