"""Nulls in every column, empty tables, repeated rows, long texts, and extra columns whose names operators use themselves."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, langid, packing, quality, secrets, simhash, suffix_sort, suffix_tree, topk, warc

EXTRA = ["n_words", "rule", "kept", "fp", "node", "key", "chunk", "_chunk", "bucket", "rank", "part", "length", "score", "_row", "spans", "label", "window", "_t", "_w", "_n", "_lines", "_h", "_g", "_s", "_d"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(n))
    out = [(i, text(r.randint(20, 120)), "aa", "s", 3) for i in range(30)]
    out += [(None, None, None, None, None), (None, out[3][1], None, None, None), (40, None, "aa", "s", 0), (41, "", None, None, 0), (42, " \n\t ", "aa", None, 1), (43, text(50000), None, "s", None)]
    return out + [out[5], out[5]]


@pytest.fixture(scope="module", params=["full", "empty"])
def tables(spark, rows, request, tmp_path_factory):
    base = str(tmp_path_factory.mktemp(request.param))
    docs = spark.createDataFrame(rows if request.param == "full" else [], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(7).alias(c) for c in EXTRA])
    docs.write.parquet(f"{base}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(30)] + [(None, 1, None), (3, None, None)] if request.param == "full" else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    pages = [(i, "u", "x" * i) for i in range(9)] + [(None, None, None), (10, None, "x")] if request.param == "full" else []
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{base}/pages.parquet")
    vectors = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (None, [1.0, 2.0]), (3, [])] if request.param == "full" else []
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{base}/embeddings.parquet")
    return base, len(rows) if request.param == "full" else 0


@pytest.mark.parametrize("query", [suffix_sort.op1_suffix_array, langid.op3_language_id, simhash.op4_simhash, secrets.op6_secret_scan, bpe.op7_byte_bpe, quality.op9_quality_rules, suffix_tree.op10_suffix_tree])
def test_a_row_for_each_document(spark, tables, query):
    base, n = tables
    assert query(spark, base).count() == n


def test_values_of_odd_rows(spark, tables):
    """What a null, an empty and a repeated text give, not only that they give a row."""
    import hashlib

    base, n = tables
    if not n:
        return
    none = hashlib.sha256(b"").hexdigest()
    by_id = lambda query: {(r.doc_id, k): r for k, r in enumerate(sorted(query(spark, base).collect(), key=lambda r: (r.doc_id is None, r.doc_id)))}
    of = lambda query, i: [r for (d, _), r in by_id(query).items() if d == i]
    for i in (40, 41):
        assert tuple(of(suffix_sort.op1_suffix_array, i)[0])[1:] == (0, 0, 0, none)
        assert tuple(of(suffix_tree.op10_suffix_tree, i)[0])[1:] == (0, 0, none)
        assert tuple(of(simhash.op4_simhash, i)[0])[1:] == ("0" * 16, 40)
        assert tuple(of(bpe.op7_byte_bpe, i)[0])[1:4] == (0, none, none)
        assert tuple(of(secrets.op6_secret_scan, i)[0])[1:] == (0, 0, 0, none, "")
        r = of(quality.op9_quality_rules, i)[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (0, 0, 0, 0, 0, True, False)
        r = of(langid.op3_language_id, i)[0]
        assert (r.lang_pred, r.score) == ("und", 0.0)
    # three rows of one id and text leave each other alone, and a row without an id loses what a numbered one has
    assert [r.n_removed for r in of(suffix_tree.op10_suffix_tree, 5)] == [0, 0, 0]
    words = {r.n_words: r.n_removed for r in of(suffix_tree.op10_suffix_tree, None)}
    assert words[0] == 0 and all(n == m for n, m in words.items() if n >= 50)


def test_packing_pages_and_vectors(spark, tables):
    base, n = tables
    pieces = packing.op8_packing(spark, base).where("start = 0").count()
    assert pieces == n
    assert warc.op2_warc(spark, base).count() == (11 if n else 0)
    assert [tuple(r) for r in topk.op5_exact_topk(spark, base).collect()] == ([(0, 1, 1, 5 << 20)] if n else [])


def test_stages_keep_columns_and_values(spark, tables):
    base, n = tables
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, base)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert all(all(r[c] == 7 for c in EXTRA) for r in out.collect())
    kept = corpus_pipeline.quality_rules(spark, docs, base)
    assert kept.count() <= n and corpus_pipeline.run(spark, base).where("start = 0").count() <= n
