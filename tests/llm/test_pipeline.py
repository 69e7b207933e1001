import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import quality, secrets, simhash
from spanloom.tables import table

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF).collect()
        out.append(rows)
        if len(out) <= len(corpus_pipeline.STAGES):
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def shingles(t, k=5):
    w = [x.lower() for x in WORD.findall(t)]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_quality_stage(spark, stages):
    rules = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    names = list(quality.FEATURES)
    kept = {r.doc_id: r for r in stages[1]}
    stats = {r.doc_id: r for r in quality.statistics(table(spark, SF, "documents")).selectExpr("*", *[f"{e} as f_{n}" for n, e in quality.FEATURES.items()]).collect()}
    for r in stages[0]:
        x = stats[r.doc_id]
        base = x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words
        ruled = any(all((x["f_" + c.feature] > c.threshold) == c.above for c in rule.conditions) for rule in rules)
        assert (r.doc_id in kept) == (not base and not ruled)
        assert r.doc_id not in kept or kept[r.doc_id] == r
    good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
    assert all(r.doc_id in kept or stats[r.doc_id].n_words < 10 or 100 * stats[r.doc_id].n_repeat_words > 20 * stats[r.doc_id].n_words for r in stages[0] if r.doc_id in good) and names


def test_near_duplicate_stage(stages):
    """All pairs of texts whose shingle sets have a similarity of 0.8, by counting what every pair shares, and nothing else."""
    before, kept = {r.doc_id: r.text for r in stages[1]}, {r.doc_id for r in stages[2]}
    ids = sorted(before)
    sets = [shingles(before[i]) for i in ids]
    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    shared = collections.Counter(p for h in holders.values() for p in itertools.combinations(h, 2))
    edges = [p for p, n in shared.items() if 9 * n >= 4 * (len(sets[p[0]]) + len(sets[p[1]]))]
    root = simhash.labels(len(ids), *np.array(edges).T)
    assert kept == {i for k, i in enumerate(ids) if root[k] == k} and len(edges) > 20
    assert len({before[i] for i in kept}) == len(kept)


def test_near_copies_at_the_bound_are_caught(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    rows, near = [], 0
    for i in range(0, 400, 2):
        words = [word() for _ in range(400)]
        rows.append((i, " ".join(words)))
        for k in range(r.choice([1, 2, 4, 6])):
            words[r.randrange(400)] = word()
        rows.append((i + 1, " ".join(words)))
        near += 1
    rows += [(i, rows[0][1]) for i in range(400, 500)] + [(500, None), (501, ""), (None, "x"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {x.doc_id: x.component_id for x in simhash.copies(df).collect()}
    assert all(gone[i] == 0 for i in range(400, 500)) and gone[501] == 500
    assert sum(gone.get(i + 1) == i for i in range(0, 400, 2)) >= 0.99 * near
    assert all(gone[i] == i - 1 for i in gone if i < 400)
    assert simhash.drop_copies(df).where("doc_id is null").count() == 2


def test_substring_stage(stages):
    least = {}
    for r in stages[2]:
        w = WORD.findall(r.text)
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    after = {r.doc_id: r for r in stages[3]}
    assert len(after) == len(stages[2])
    for r in stages[2]:
        w = WORD.findall(r.text)
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < r.doc_id:
                gone[k : k + 50] = True
        got = after[r.doc_id]
        assert WORD.findall(got.text) == [x for x, g in zip(w, gone) if not g] and got.n_chars == len(got.text)
        assert gone.any() or got == r


def test_secret_stage(stages):
    before = {r.doc_id: r for r in stages[3]}
    assert len(before) == len(stages[4])
    for r in stages[4]:
        found = secrets.base_findings(before[r.doc_id].text)
        if found:
            assert "[SECRET]" in r.text and not secrets.base_findings(r.text) and r.n_chars == len(r.text)
        else:
            assert r == before[r.doc_id] or "[SECRET]" in r.text


def test_packing_stage(stages):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(list)
    for r in stages[5]:
        pieces[r.doc_id].append(r)
    for d in stages[4]:
        ids = np.array(t.encode(d.text, add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for p in sorted(pieces[d.doc_id], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_run_equals_the_stages(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[5]))
