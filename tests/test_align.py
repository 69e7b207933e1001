"""The row form, the join form and an independent enumerator agree; worked examples and odd texts."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import spans, text
from spanloom.operators import align, baselines, evaluate, render, tokens
from spanloom.plans.fixture import lead, prepared

EXAMPLES = [
    ("A B A B A B A B", " A B A"), ("The cat sat on the mat and the cat looked at the sat dog", " cat sat dog"), ("The quick brown fox jumps over the lazy dog", " quick fox lazy"),
    (' "oneness" or "uniqueness")', ' "oneness" or "uniqueness"'), ("CD4+ T cells express IL-2. CD8+ T cells also express IFN-g", " CD4+ cells"),
    ("a b", "b a"), ("a", "a X a"), ("a a a", "a a"), ("x", "y"), ("", ""), ("", "a"), ("a", ""), (" a  b\t\n", "b"), ("Straße der Dinge", "Strasse Dinge"), ("a\x1cb c", "a b"), ("😀 a 日本 b", "a b"),
]


def brute(source, target):
    steps = []
    for t in target:
        if t in source and (not steps or steps[-1] != t):
            steps.append(t)
    found = [()]
    for t in steps:
        found = [(*p, i) for p in found for i, x in enumerate(source) if x == t and (not p or i > p[-1])]
    return sorted(found) if steps else []


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = list(EXAMPLES)
    for _ in range(300):
        out.append((" ".join(r.choices("abcd", k=r.randint(0, 9))), " ".join(r.choices("abcdx", k=r.randint(0, 5)))))
    return out


@pytest.fixture(scope="module")
def pairs(spark, rows):
    return prepared(spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "pair_id long, source string, target string"))


def words(spark, rows):
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "i long, s string, t string")
    return {r.i: (r.a, r.b) for r in df.select("i", text.words(text.norm_text("s")).alias("a"), text.words(text.norm_text("t")).alias("b")).collect()}


def test_all_forms_equal_brute_force(spark, rows, pairs):
    cand, first, last = (F.col(c) for c in ("cand", "first", "last"))
    got = {r.pair_id: r for r in pairs.select("pair_id", "first", spans.all_alignments(cand, first, last).alias("all"), spans.count_alignments(cand).alias("n"), spans.start_positions(cand, last).alias("starts")).collect()}
    for i, (s, t) in words(spark, rows).items():
        want = brute(s, t)
        r = got[i]
        assert [tuple(p) for p in r.all] == want and r.n == len(want)
        assert (tuple(r.first) if r.first else None) == (want[0] if want else None)
        assert r.starts == sorted({p[0] for p in want})


def test_join_form_equals_row_form(spark, rows, pairs):
    source, target = (tokens.whitespace_tokens(pairs, "pair_id", c) for c in ("source", "target"))
    found = align.candidates(align.collapsed_steps(target, source, "pair_id"), source, "pair_id")
    joined = {(r.pair_id, r.alignment_id, tuple(r.path)) for r in align.enumerate_chains(found, "pair_id").collect()}
    assert joined == {(r.pair_id, r.alignment_id, tuple(r.path)) for r in align.alignments(pairs).collect()}
    assert joined == {(r.pair_id, r.alignment_id, tuple(r.path)) for r in align.alignments(pairs, at_most=2).collect()}
    assert {r.pair_id for r in align.feasible(found, "pair_id").collect()} == {i for i, _, _ in joined}


def test_table_function_lists_the_same(spark, pairs):
    baselines.register(spark)
    pairs.select("pair_id", F.array_join("src", " ").alias("s"), F.array_join(text.words(text.norm_text("target")), " ").alias("t")).createOrReplaceTempView("p")
    got = {(r.pair_id, r.alignment_id, tuple(r.path)) for r in spark.sql("SELECT pair_id, a.* FROM p, LATERAL align_all(s, t) a").collect()}
    assert got == {(r.pair_id, r.alignment_id, tuple(r.path)) for r in align.alignments(pairs).collect()}
    assert spark.sql("SELECT align_lcs(array('a', 'b'), array('b')) AS x").first().x == [1]


def test_large_counts_do_not_overflow(spark):
    n = 120
    df = prepared(spark.createDataFrame([(1, " ".join("ab" * n), " ".join("ab" * 20))], "pair_id long, source string, target string"))
    got = df.select(spans.count_alignments(F.col("cand")).alias("n")).first().n
    state = [0] * 40
    for c in "ab" * n:
        state = [s + ((1 if i == 0 else state[i - 1]) if "ab"[i % 2] == c else 0) for i, s in enumerate(state)]
    assert int(got) == state[-1] > 10**30


def slow_lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif dp[i - 1][j] >= dp[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def test_baselines():
    r = random.Random(2)
    for _ in range(500):
        a, b = (r.choices("abcde", k=r.randint(0, 40)) for _ in range(2))
        assert baselines.lcs_positions(a, b) == slow_lcs(a, b)
    a, b = r.choices("ab", k=500), r.choices("ab", k=250)
    want = [m.a + k for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks() for k in range(m.size)]
    assert baselines.block_positions(a, b) == want


def test_naive_and_snippets(spark):
    df = spark.createDataFrame([("xx ab ab", "ab"), ("a", "b"), ("a", ""), (None, "a")], "source string, target string")
    got = [r.t for r in df.select(baselines.naive().alias("t")).collect()]
    assert got[0][0].asDict() == {"token": "ab", "enc_token": -1, "start_idx": 3, "end_idx": 5} and got[1] == [] and got[2][0].end_idx == 0 and got[3] == []
    s = df.limit(1).select(render.snippet(F.col("source"), F.lit(3), F.col("target")).alias("s")).first().s
    assert s == "xx ab ab\n   ^"


def test_tokens_highlight_and_offsets(spark, rows, pairs):
    out = pairs.where("first is not null").withColumn("at", spans.token_starts(F.col("src"), lead())).withColumn("tokens", render.token_objects(F.col("src"), F.col("at"), F.col("first")))
    for r in out.select("ns", "tokens", "first", render.by_token(F.col("tokens"), " ").alias("t"), render.by_index(F.col("ns"), F.col("tokens")).alias("i"), render.highlight(F.col("ns"), F.col("tokens")).alias("h")).collect():
        assert all(r.ns[t.start_idx : t.end_idx] == t.token for t in r.tokens)
        assert r.t.replace(" ", "") == r.i and r.h.replace(render.GREEN, "").replace(render.END, "") == r.ns and r.h.count(render.GREEN) == len(r.tokens)
    joined = render.concatenated(spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "k int, i int, x string"), "k", "x", "i")
    assert joined.first().x == "ab"


def test_kgrams(spark):
    df = spark.createDataFrame([(1, "a b a b c"), (2, "x"), (3, None)], "id long, text string")
    toks = tokens.whitespace_tokens(df, "id", "text")
    index = tokens.ngram_index(toks, "id", 2)
    assert [(r.pos, r.ngram, r.ngram_id) for r in index.orderBy("pos").collect()] == [(0, ["a", "b"], 0), (1, ["b", "a"], 1), (2, ["a", "b"], 0), (3, ["b", "c"], 2)]
    assert {(r.src_id, r.dst_id) for r in tokens.overlap_graph(index, "id", 2).collect()} == {(0, 1), (1, 0), (0, 2)}
    one = tokens.ngram_index(toks, "id", 1)
    assert {(r.src_id, r.dst_id) for r in tokens.overlap_graph(one, "id", 1).where("id = 1").collect()} == {(i, j) for i in range(3) for j in range(3) if i != j}
    paths = spark.createDataFrame([(1, 0, [0, 3])], "id long, alignment_id int, path array<int>")
    assert align.group_tokens(index, paths, "id", 2).first().tokens == ["a", "b", "c"]
    with pytest.raises(KeyError):
        tokens.tokenize(df, "id", "text", "letters")


def test_normalising(spark):
    df = spark.createDataFrame([("é\x1f\x0b x",), ("éß日",), (None,), (" a\n\n b ",)], "t string")
    assert [r.n for r in df.select(text.norm_text("t").alias("n")).collect()] == ["e x", "essu65e5 ", None, " a b "]
    assert df.select(text.norm_text("t", strict=True).alias("n")).collect()[2].n == "None"
    assert df.select(text.nfc("t").alias("n")).collect()[1].n == "éß日"


def test_evaluation_pieces(spark):
    df = spark.createDataFrame([(1, [1, 2], [2, 3]), (2, [1], [1]), (3, [1], [-1])], "i int, real array<int>, got array<int>")
    out = evaluate.set_operations(df, "real", "got", "m").orderBy("i").collect()
    assert [(r.m_l, r.m_x, r.m_r, r.m_found) for r in out] == [(1, 1, 1, False), (0, 1, 0, True), (1, 0, 1, False)]
    v = spark.createDataFrame([(x,) for x in (0, 5, 10, 10)], "x int")
    assert {(r.bin, r.n) for r in evaluate.histogram(v, "x", 2).collect()} == {(1, 1), (2, 3)}
    assert [(r["rank"], r.x) for r in evaluate.reverse_cdf(v, "x", "x").orderBy("rank").collect()] == [(1, 10), (2, 10), (3, 5), (4, 0)]
    fit = evaluate.power_law(spark.createDataFrame([(float(x), 3.0 * x**2) for x in range(1, 9)], "x double, y double"), "x", "y").first()
    assert abs(fit.a - 3) < 1e-9 and abs(fit.b - 2) < 1e-9
