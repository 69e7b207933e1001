import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import repeats, suffix_sort, suffix_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, symbols, window):
    """Which symbols of each row are covered by a window that also starts in a row of a smaller id."""
    least = {}
    for i, t in rows:
        s = symbols(t)
        for k in range(len(s) - window + 1):
            w = s[k : k + window] if isinstance(s, bytes) else tuple(s[k : k + window])
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        s = symbols(t)
        gone = np.zeros(len(s), bool)
        for k in range(len(s) - window + 1):
            w = s[k : k + window] if isinstance(s, bytes) else tuple(s[k : k + window])
            if least[w] < i:
                gone[k : k + window] = True
        out.append((i, s, gone))
    return out


def as_bytes(t):
    return (t or "").encode()


def as_words(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdeé\0", k=r.randint(1, 7)))
    text = lambda n: "".join(word() + r.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(n))
    shared = [text(n) for n in (9, 15, 60, 120, 400)]
    hot = text(70)
    rows = [(i, text(r.randint(0, 300)) + (r.choice(shared) if r.random() < 0.5 else "") + text(r.randint(0, 60)) + (hot if i % 3 == 0 else "")) for i in range(160)]
    rows += [(i, rows[r.randrange(100)][1]) for i in range(160, 190)]
    rows += [(i, "ab" * r.randint(10, 400)) for i in range(190, 200)] + [(i, "x " * r.randint(30, 300)) for i in range(200, 210)]
    rows += [(210, None), (211, ""), (212, " \n "), (213, "z" * 49), (214, "z" * 50), (215, "z" * 51), (216, "y " * 49), (217, "y\n" * 50), (218, "y " * 51)]
    rows += [(219, rows[0][1]), (219, rows[0][1]), (220, rows[5][1] + rows[5][1]), (221, " ".join(shared) * 30)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, chunk int, bucket int, n int").repartition(5)


def digests(covered, join):
    out = []
    for i, s, gone in covered:
        kept = bytes(np.frombuffer(s, np.uint8)[~gone]) if join is None else join.join(w for w, g in zip(s, gone) if not g).encode()
        rises = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0
        out.append((i, len(s), int(gone.sum()), *([rises] if join is None else []), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2000, 3])
def test_bytes_against_brute_force(docs, rows, hot):
    want = digests(brute(rows, as_bytes, 50), None)
    got = sorted(map(tuple, suffix_sort.substring_digests(docs, hot=hot).collect()))
    assert got == want
    assert sum(x[2] for x in got) > 10000


@pytest.mark.parametrize("hot", [2000, 3])
def test_words_against_brute_force(docs, rows, hot):
    want = digests(brute(rows, as_words, 50), " ")
    got = sorted(map(tuple, suffix_tree.word_digests(docs, hot=hot).collect()))
    assert got == want
    assert sum(x[2] for x in got) > 2000


def test_other_windows(docs, rows):
    want = digests(brute(rows, as_bytes, 20), None)
    assert sorted(map(tuple, suffix_sort.substring_digests(docs, 20, 8).collect())) == want
    want = digests(brute(rows, as_words, 12), " ")
    assert sorted(map(tuple, suffix_tree.word_digests(docs, 12, 4).collect())) == want


def test_stripped_texts(docs, rows):
    got = {r.doc_id: r for r in suffix_tree.strip_repeats(docs).collect() if r.doc_id != 219}
    for i, s, gone in brute(rows, as_words, 50):
        if i != 219:
            assert as_words(got[i].text) == [w for w, g in zip(s, gone) if not g]
            assert gone.any() or got[i].text == dict(rows)[i]
            assert got[i].chunk == 1


def pieces(seed):
    r = random.Random(seed)
    ids, lead, count, texts = [], [], [], []
    for _ in range(400):
        c = r.randint(1, 8)
        ids.append(r.randint(0, 60))
        count.append(c)
        lead.append(c - 1 + r.randint(0, 4))
        texts.append(bytes(r.choices(b"\0ab", k=c + 11)) if r.random() < 0.6 or not texts else None)
        if texts[-1] is None:
            k = r.randrange(len(texts) - 1)
            texts[-1], lead[-1], count[-1] = texts[k], lead[k], count[k]
    return repeats.Pieces.of(ids, lead, count, texts), texts


@pytest.mark.parametrize("size,limit", [(1 << 20, 1 << 26), (50, 1 << 26), (50, 200), (7, 0)])
def test_induced_order_in_memory_and_on_disk(size, limit):
    """Strings of a bucket meet at equal distances from their anchors."""
    for seed in range(3):
        p, texts = pieces(seed)
        got = suffix_sort.repeated(p, 12, size, limit)
        least = {}
        for i, a, c, t in zip(p.ids, p.lead, p.count, texts):
            for k in range(c):
                at = (a - k, t[k : k + 12])
                least[at] = min(least.get(at, i), i)
        for n, (i, a, c, t) in enumerate(zip(p.ids, p.lead, p.count, texts)):
            assert [bool(x) for x in got[n, :c]] == [least[a - k, t[k : k + 12]] < i for k in range(c)]


def marked(ids, count, texts, window):
    """Strings of the runs that also start in a run of a smaller id, by a dictionary."""
    least = {}
    for i, c, t in zip(ids, count, texts):
        w = t.split()
        for k in range(c):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, i), i)
    return [[least[tuple(t.split()[k : k + window])] < i for k in range(c)] for i, c, t in zip(ids, count, texts)]


@pytest.mark.parametrize("group,limit", [(1 << 16, 1 << 23), (40, 1 << 23), (5, 300), (1, 0)])
def test_subtrees_of_small_groups(group, limit):
    """Prefixes of any length, up to strings that are all equal and still too many for a group."""
    r = random.Random(5)
    texts = [" ".join(r.choices("abc", k=19)) + " " for _ in range(60)] * 3 + ["x " * 19] * 20
    texts += [" ".join(["aé", "b", "c"] * 6 + ["d"]) + " "] * 7
    ids, count = [r.randint(0, 30) for _ in texts], [r.randint(1, 8) for _ in texts]
    texts = [" ".join(t.split()[: c + 11]) + " " for c, t in zip(count, texts)]
    got = suffix_tree.repeated(repeats.Pieces.of(ids, [0] * len(texts), count, texts and [t.encode() for t in texts]), 12, group, limit)
    want = marked(ids, count, texts, 12)
    assert [[bool(x) for x in got[k, :c]] for k, c in enumerate(count)] == want
    assert any(map(any, want)) and not all(map(all, want))


def test_nodes_of_a_subtree():
    """Depth, parent and range of every internal node, against the definition."""
    r = random.Random(8)
    words = np.array(r.choices(range(3), k=400), np.int32)
    place = np.array(r.sample(range(380), 120))
    order, shared = suffix_tree.sorted_suffixes(words, place, 0, 12)
    rows = [tuple(words[p : p + 12]) for p in place[order]]
    assert rows == sorted(rows)
    common = lambda a, b: next((k for k in range(12) if a[k] != b[k]), 12)
    assert shared.tolist() == [0] + [common(a, b) for a, b in zip(rows, rows[1:])]
    ids = np.array([r.randint(0, 9) for _ in rows])
    tree = suffix_tree.build(ids, shared)
    want = {}
    for depth in range(13):
        for k in range(1, len(rows)):
            if shared[k] == depth:
                same = [j for j, x in enumerate(rows) if x[:depth] == rows[k][:depth]]
                want[min(same), max(same) + 1] = depth
    got = {(a, z): d for a, z, d in zip(tree.lo.tolist(), tree.hi.tolist(), tree.depth.tolist())}
    assert got == want
    for k, p in enumerate(tree.parent):
        above = [j for j in range(len(tree.lo)) if j != k and tree.lo[j] <= tree.lo[k] and tree.hi[k] <= tree.hi[j]]
        assert p == (min(above, key=lambda j: tree.hi[j] - tree.lo[j]) if above else -1)
        assert tree.least[k] == ids[tree.lo[k] : tree.hi[k]].min() and tree.most[k] == ids[tree.lo[k] : tree.hi[k]].max()


def shard(words, seed=2, runs=60000):
    """A shard of runs of which many repeat, in bytes or in words, of about 4 or 14 MB."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 4)))
    make = (lambda: " ".join(word() for _ in range(67)) + " ") if words else (lambda: "".join(r.choices("ab cd", k=67)))
    texts: list = []
    for _ in range(runs):
        texts.append(r.choice(texts) if texts and r.random() < 0.5 else make())
    ids = [r.randrange(5000) for _ in texts]
    return ids, [17] * runs, [18] * runs, [t.encode() for t in texts]


@pytest.mark.parametrize("words", [False, True])
def test_a_shard_far_larger_than_its_memory(words):
    """What a shard needs in memory follows the bounds, not the shard; the files hold the rest."""
    import tracemalloc

    ids, lead, count, texts = shard(words)
    p = repeats.Pieces.of(ids, lead, count, texts)
    run = (lambda: suffix_tree.repeated(p, 50, 1 << 12, 1 << 16)) if words else (lambda: suffix_sort.repeated(p, 50, 1 << 11, 1 << 16))
    first: dict = {}
    for i, t in zip(ids, texts):
        first[t] = min(first.get(t, i), i)
    tracemalloc.start()
    got = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = 14 * sum(count)  # bytes of tuples of one pass, if they were all in memory
    assert peak < held / 2, (peak, held)
    gone = np.asarray(got).all(1)
    assert gone.tolist() == [first[t] < i for i, t in zip(ids, texts)]


def test_word_hashes_do_not_depend_on_the_place():
    r = random.Random(3)
    words = [bytes(r.choices(b"abcd", k=r.randint(1, 9))) for _ in range(500)]
    s = repeats.Words([b" ".join(words), b"", b"  " + b"\n\n".join(words[::-1])])
    assert list(s.hashes[:500]) == list(s.hashes[500:][::-1])
    small = repeats.Words([b" ".join(words)])
    small_hashes = small._word_hashes(np.frombuffer(small.data, np.uint8), slab=16)
    assert (repeats.mix(small_hashes) == s.hashes[:500]).all()
    assert len(set(s.hashes[:500])) == len(set(words))


def test_even_keys_follow_sparks_hash(spark):
    x = list(range(-3, 1000, 7))
    assert repeats.murmur(np.array(x)).tolist() == [r.h for r in spark.createDataFrame([(k,) for k in x], "k int").select(F.hash("k").alias("h")).collect()]
    keys = repeats.even_keys(40, 7)
    assert len(set(repeats.even_keys(100_000, 3000))) == 100_000
    got = spark.createDataFrame([(k,) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(7)).alias("p")).groupBy("p").count().collect()
    assert sorted(r["count"] for r in got) == [5, 5, 6, 6, 6, 6, 6]


def test_chunks_follow_the_input(spark):
    """Fixed chunks at first; beyond, chunks grow with the input so that the pairs of chunk and bucket do not."""
    assert repeats.chunk_count(spark.createDataFrame([(0, "x")], "doc_id long, text string"), "text", 24) == 16
    many = spark.range(10).selectExpr("repeat('x', 3000000) as text").unionAll(spark.range(1).selectExpr("cast(null as string)"))
    assert repeats.chunk_count(many, "text", 1) == 29 and repeats.chunk_count(many, "text", 1, blob=75_000) == 20
    plain = spark.createDataFrame([(i, f"{'same words ' * 60} {i}") for i in range(40)], "doc_id long, text string")
    want = sorted(map(tuple, suffix_tree.word_digests(plain).collect()))
    chosen, repeats.CHOSEN = repeats.CHOSEN, 2
    try:
        assert sorted(map(tuple, suffix_tree.word_digests(plain).collect())) == want
    finally:
        repeats.CHOSEN = chosen


def test_empty_tables(docs):
    assert suffix_sort.substring_digests(docs.limit(0)).count() == 0
    assert suffix_tree.strip_repeats(docs.limit(0)).count() == 0
