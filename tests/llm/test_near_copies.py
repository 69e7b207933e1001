"""The near-duplicate stage against the Jaccard similarity of all pairs of five-word shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import simhash
from spanloom.llm.arrow import BATCH_BYTES, batch_bytes
from spanloom.tables import table


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def planted(low, high, pairs, words, seed):
    """Texts of random words in pairs whose similarity lies in low to high, by edits at random places."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    rows = []
    while len(rows) < 2 * pairs:
        one = [word() for _ in range(words)]
        two, s = list(one), 1.0
        while s > high:
            two[r.randrange(words)] = word()
            a, b = shingles(" ".join(one)), shingles(" ".join(two))
            s = len(a & b) / len(a | b)
        if s >= low:
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
    return rows


def test_pairs_below_the_bound_all_stay(spark):
    rows = planted(0.70, 0.79, 60, 300, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.copies(df).count() == 0
    assert simhash.drop_copies(df).count() == len(rows)


def test_all_pairs_at_the_bound_are_linked(spark):
    rows = planted(0.80, 0.85, 200, 300, 4)
    gone = {x.doc_id: x.component_id for x in simhash.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone == {i: i - 1 for i in range(1, len(rows), 2)}


def test_components_against_all_pairs(spark):
    """Short and long texts, groups of over MANY near copies whose links are chains, and a line that most texts share."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    texts = ["", None, "one", "ONE", "one two three", " ".join(["x"] * 30), " ".join(["x"] * 50)]
    for size, edits, many in ((100, 1, 150), (200, 2, 150), (400, 4, 60)):
        base = [word() for _ in range(size)]
        for _ in range(many):
            for _ in range(edits):
                base[r.randrange(size)] = word()
            one = list(r.choice((base, base[: size - size // 8])))
            for _ in range(r.randrange(edits)):
                one[r.randrange(len(one))] = word()
            texts.append(" ".join(one))
    line = " ".join(word() for _ in range(20))
    texts += [line + " " + " ".join(word() for _ in range(r.choice((3, 5, 8, 40)))) for _ in range(150)]
    r.shuffle(texts)
    sets = [shingles(t or "") for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 9 * both >= 4 * (len(a) + len(sets[j])) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    want = {i: x for i, x in enumerate(root) if i != x}
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sizes in ({}, {"split": 16, "tile": 40}):  # the second deals frequent shingles over tasks and compares in tiles
        assert {x.doc_id: x.component_id for x in simhash.copies(docs, **sizes).collect()} == want
    assert len(want) > 100
    salts = simhash.describe(docs.na.fill(""), 5, 80, 16).select(F.explode("salts").alias("s"))
    assert salts.where("s > 1").count() > 20


def test_rows_of_a_key_meet_once(spark):
    """Whatever the size of a key, any two of its rows share one smaller key in which their sides let them be compared."""
    rows = [(k, 1000 * k + i, n) for k, n in enumerate((1, 5, 33, 100)) for i in range(n)]
    dealt = simhash.tiles(spark.createDataFrame(rows, "key long, node long, n long"), 10).collect()
    groups, met = {}, {}
    for r in dealt:
        groups.setdefault(r.key, []).append(r)
    for members in groups.values():
        assert len(members) <= 40
        for i, a in enumerate(members):
            for b in members[:i]:
                if a.side < 0 or a.side != b.side:
                    pair = frozenset((a.node, b.node))
                    met[pair] = met.get(pair, 0) + 1
    assert set(met.values()) == {1} and len(met) == sum(n * (n - 1) // 2 for n in (1, 5, 33, 100))


def test_pairs_come_in_blocks():
    """Small blocks hold the pairs that one large block does, none is much larger than asked for, and no rows give none."""
    r = np.random.default_rng(2)
    size = np.sort(r.integers(20, 40, 900))
    t = {"key": np.repeat(np.arange(3), 300), "meta": (2 * size + r.integers(0, 2, 900)).astype(np.int32), "root": r.integers(0, 50, 900)}
    whole = list(simhash._pairs(t, 80, 900, 1 << 30))
    parts = list(simhash._pairs(t, 80, 900, 500))
    flat = lambda found: sorted((int(x), int(y)) for a, b in found for x, y in zip(a, b))
    want = [
        (x, y) for x in range(900) for y in range(x + 1, 900)
        if t["key"][x] == t["key"][y] and t["meta"][x] & 1 and size[y] * 80 <= 100 * size[x] and t["root"][x] != t["root"][y]
    ]
    assert len(whole) == 1 and len(parts) > 10 and max(len(a) for a, _ in parts) < 500 + 900
    assert flat(whole) == flat(parts) == want
    assert not list(simhash._pairs({k: x[:0] for k, x in t.items()}, 80, 900))


def test_batch_bytes_are_put_back(spark):
    before = spark.conf.get(BATCH_BYTES)
    with pytest.raises(ValueError), batch_bytes(spark, 1 << 20):
        assert spark.conf.get(BATCH_BYTES) == str(1 << 20)
        raise ValueError
    assert spark.conf.get(BATCH_BYTES) == before


def test_candidates_grow_with_the_table(spark):
    """Candidates for a document stay as few on a table ten times larger, and an oversized key is not compared pair by pair."""
    each = []
    for sf in ("sf0.01", "sf0.1"):
        docs = table(spark, f"/root/testdata/{sf}", "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        met = simhash.candidates(simhash.describe(docs, 5, 80), 80)
        each.append(met.where("b is not null").select("a", "b").distinct().count() / docs.count())
    assert each[1] <= 2 * each[0] + 0.5, each
    word = lambda k: "".join(chr(97 + (k // 26**j) % 26) for j in range(4))
    rows = [(i, "one line that all of them begin with " + " ".join(word(5 * i + j) for j in range(5))) for i in range(3000)]
    met = simhash.candidates(simhash.describe(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80), 80)
    assert met.where("b is not null").count() <= 20 * len(rows)


def test_fingerprints_link_only_what_they_should(spark):
    """The links that pigeonhole blocks give are those of all pairs within the distance, up to what connects them."""
    rows = planted(0.95, 0.985, 80, 400, 9) + [(200 + i, f"some words that stay {i % 3}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = simhash.describe(docs, 5, 80).select("doc_id", "sim", "fp").collect()
    made = simhash.fingerprint_links(simhash.describe(docs, 5, 80), 3).collect()
    sim = {r.doc_id: r.sim & (1 << 64) - 1 for r in fps}
    first = {}
    for r in sorted(fps, key=lambda r: r.doc_id):
        first.setdefault(bytes(r.fp), r.doc_id)
    ids = sorted(first.values())
    want = [(ids.index(a), ids.index(b)) for a in ids for b in ids if b < a and (sim[a] ^ sim[b]).bit_count() <= 3]
    root = simhash.labels(len(ids), *([x[k] for x in want] for k in (0, 1))) if want else []
    got = [(ids.index(r.a), ids.index(r.b)) for r in made]
    assert len(want) > 5 and simhash.labels(len(ids), *([x[k] for x in got] for k in (0, 1))).tolist() == root.tolist()
