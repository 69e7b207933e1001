import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
import zstandard

from spanloom.llm import langid, topk, warc
from spanloom.tables import table


def test_topk_against_brute_force(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(0, 1, 8)], 1) for i in range(400)]
    rows += [(i, rows[7][1], 1) for i in range(400, 470)]  # a very common vector, with ties
    rows += [(500, None, 1), (600, [1.0, None] + [0.0] * 6, 1), (601, [float("nan")] * 8, 1), (602, [float("inf")] * 8, 1), (603, [], 1), (700, [], 1), (701, [1.0, 2.0], 1), (801, rows[3][1], 1), (801, rows[3][1], 1), (None, rows[3][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(7)
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, a in good:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:10]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)}
    asked = df.where("vec_id % 100 = 0")
    for tile, shard_rows in ((64, 1 << 16), (2, 10), (1024, 50)):
        got = topk.search(df, asked, tile=tile, shard_rows=shard_rows, fan=3).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert topk.search(df, asked.limit(0)).count() == 0


def test_products_stay_exact_when_large():
    a = np.array([[2.0**40, 3.0]])
    assert topk.products(a, np.array([[2.0**20, 5.0]]))[0, 0] == 2**60 + 15
    assert topk.products(a, np.array([[2.0**50, 5.0]]))[0, 0] == 2**90 + 15


def test_scores_beyond_64_bits_keep_their_order(spark):
    """Reported at the end of the range, ranked by their exact value; below zero too, and next to small ones."""
    big = 2.0**60
    rows = [(0, [big, 1.0]), (1, [1.0, 0.0]), (2, [big, 0.0]), (3, [2 * big, 0.0]), (4, [-big, 0.0]), (5, [-2 * big, 0.0]), (6, [0.0, 1.0]), (7, [2 * big, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(r.vec_id, r.score) for r in topk.search(df, df.where("vec_id = 0"), tile=2).orderBy("rank").collect()]
    exact = {i: sum(int(1024 * a) * int(1024 * b) for a, b in zip(v, rows[0][1])) for i, v in rows[1:]}
    assert [i for i, _ in got] == sorted(exact, key=lambda i: (-exact[i], i)) == [3, 7, 2, 1, 6, 4, 5]
    assert all(s == min(max(exact[i], -(2**63)), 2**63 - 1) for i, s in got)


def test_a_query_whose_id_has_an_invalid_row_too(spark):
    for odd in (None, float("-inf"), float("nan")):
        rows = [(0, [1.0, 2.0]), (0, [odd, 2.0]), (0, [odd, -9.0]), (1, [1.0, 1.0]), (2, [3.0, 1.0])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = [tuple(r) for r in topk.search(df, df.where("vec_id % 100 = 0")).collect()]
        assert sorted(got) == [(0, 1, 2, 5 << 20), (0, 2, 1, 3 << 20)]


def test_languages_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    langs, tables = langid.fit(docs.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.identify(docs, langs, tables).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert len(held) > 200 and right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in docs.where(langid.held_out()).collect()} == {r.doc_id for r in held}


def test_language_mixture_and_odd_texts(spark):
    r = random.Random(2)
    make = lambda letters, n: " ".join("".join(r.choices(letters, k=r.randint(3, 7))) for _ in range(n))
    rows = [(i, make("abcdefg" if i % 2 else "mnopqrs", 80), "aa" if i % 2 else "mm", 1.0) for i in range(80)]
    odd = [(100, None, "aa", 1.0), (101, "", None, 1.0), (102, "12 34 !!", "mm", 1.0), (103, make("abcdefg", 300) + " " + make("mnopqrs", 100), None, 1.0), (104, make("mnopqrs", 40000), None, 1.0), (105, "日本語", None, 1.0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    langs, tables = langid.fit(df.where("doc_id < 100"))
    got = {x.doc_id: x for x in langid.identify(df, langs, tables).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == "aa" and abs(got[103].score - 0.75) < 0.03
    assert got[104].lang_pred == "mm" and got[104].score > 0.99
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)
    langs, tables = langid.fit(df.where("doc_id = 102"))
    assert {x.lang_pred for x in langid.identify(df, langs, tables).collect()} == {"und"}


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(3)
    rows = [(i, f"https://h{i % 3}.org/a b\r\n?q={i}", "<p>" + "é" * r.randint(0, 500) + str(i % 90) * 3) for i in range(300)]
    rows += [(300, None, None), (301, "u", ""), (302, "u", "\r\n\r\n WARC/1.1\r\n"), (303, "u", "y" * 900_000)]
    rows += [(i, "hot", "same") for i in range(400, 600)] + [(600, "x", "twice"), (600, "x", "twice")]
    return spark.createDataFrame([(*x, 0) for x in rows], "page_id long, url string, html string, refers_to int").repartition(6)


def test_payloads_of_one_sha1_stay_apart(pages, monkeypatch):
    """A stand-in for colliding payloads: with one SHA-1 for all, equal ones are still told by SHA-256 and length."""
    from pyspark.sql import functions as F

    from spanloom.tables import Scratch

    monkeypatch.setattr(warc.F, "sha1", lambda c: F.lit("00" * 20))
    spark = pages.sparkSession
    rows = [(1, "u", "aa"), (2, "u", "bb"), (3, "u", "aa"), (None, "u", "bb"), (None, "u", "cc"), (None, "u", "cc"), (None, None, None)]
    got = warc.resolve(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "t")).collect()
    key = lambda r: (r.page_id or 0, bytes(r.payload), r.refers_to)
    assert sorted(map(key, got), key=str) == sorted([(1, b"aa", None), (2, b"bb", None), (3, b"aa", 1), (0, b"bb", 2), (0, b"cc", None), (0, b"cc", None), (0, b"", None)], key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(pages, least):
    made = warc.archive(pages.drop("refers_to"), least, frame=4 << 10, bundle=64 << 10)
    got = sorted((tuple(r) for r in warc.read(made).collect()), key=lambda x: x[0])
    rows = sorted((tuple(r) for r in pages.collect()), key=lambda x: x[0])
    first: dict = {}
    for i, _, html, _ in rows:
        first.setdefault((html or "").encode(), i)
    assert len(got) == len(rows)
    for (i, url, html, _), g in zip(rows, got):
        data = (html or "").encode()
        to = first[data] if len(data) >= least and first[data] != i else None
        assert g[:5] == (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if to is not None else "response", to)
        assert g[5] == url and (g[6] == data) == (to is None)


def test_bundles_are_seekable_and_plain_zstd(pages):
    for r in warc.archive(pages.drop("refers_to"), frame=4 << 10, bundle=64 << 10).collect():
        reader = warc.Reader(bytes(r["data"]))
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(r["data"])), read_across_frames=True).read()
        assert whole == b"".join(reader.frame(k) for k in range(len(reader.raw)))
        assert b"".join(reader.record(e["frame"], e["offset"], e["length"]) for e in r["index"]) == whole
        assert max(reader.raw) <= max(4 << 10, max(e["length"] for e in r["index"]))


def test_warc_of_no_pages(pages):
    assert warc.read(warc.archive(pages.drop("refers_to").limit(0))).count() == 0
