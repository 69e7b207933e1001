import random
import re

import pytest
import xxhash

from spanloom.llm import simhash


def brute_fp(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < k else [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, k=3, d=3):
    fps = {i: brute_fp(t, k) for i, t in rows}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for x in ids:
        for y in ids:
            if x < y and (fps[x] ^ fps[y]).bit_count() <= d:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (fps[i], find(i)) for i in ids}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    vocab = ["".join(r.choices("abcdeé", k=4)) for _ in range(300)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one two"), (5, "ONE Two"), (6, "É x y z")]
    for i in range(7, 90):
        rows.append((i, " ".join(r.choices(vocab, k=r.randint(1, 200)))))
    for i in range(90, 200):
        words = rows[r.choice([9, 12, 20])][1].split(" ")
        words[r.randrange(len(words))] = r.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [(i, rows[30][1]) for i in range(200, 230)]
    rows.append((230, " ".join(r.choices(vocab, k=70000))))
    return rows


def test_near_duplicates_against_brute_force(spark, rows, monkeypatch):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    want = brute(rows)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 30


def test_links_of_a_crowd(monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "CROWD", 8)
    r = random.Random(1)
    fps = {0}
    while len(fps) < 300:
        x = r.choice(sorted(fps))
        for _ in range(r.randint(1, 6)):
            x ^= 1 << r.randrange(40)
        fps.add(x)
    fp = np.array(sorted(fps), np.uint64)
    a, b = simhash.close_pairs(np.zeros(len(fp), np.uint64), fp, 3)
    got = simhash.labels(len(fp), a, b)
    full = [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 3]
    want = simhash.labels(len(fp), *map(np.array, zip(*full)))
    assert (got == want).all() and len(set(want)) > 3


def test_pigeonhole_masks_cover_every_close_pair():
    masks = simhash.block_masks(5, 3)
    r = random.Random(2)
    for _ in range(2000):
        diff = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not diff & m for m in masks)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
