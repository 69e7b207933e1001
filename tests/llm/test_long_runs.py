"""Secrets inside runs longer than a window of the network."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import secrets


@pytest.fixture(scope="module")
def net():
    r = random.Random(1)
    key = lambda n: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    words = "index users assets images service account reports archive static public version catalog".split()
    rows = []
    for _ in range(600):
        rows += [(w, y) for y, t in ((1, key(r.choice((20, 32, 40)))), (0, "/".join(r.choices(words, k=4)))) for w in secrets.windows(f"see {t} for", 4, 4 + len(t))]
    return secrets.train(rows)


def test_key_in_the_middle_of_a_path(net):
    r = random.Random(2)
    words = "index users assets images service account reports archive static public version catalog".split()
    hits = clean = 0
    for _ in range(50):
        key = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
        side = lambda: "/".join(r.choices(words, k=11))[:80]
        path = f"/{side()}/{key}/{side()}"
        assert len(path) > 150
        text = f"get {path} now"
        a, b = text.index(path), text.index(path) + len(path)
        hits += ("net", a, b) in secrets.findings(text, net)[1]
        clean += not secrets.findings(f"get /v2/{side()}/{side()} now", net)[1]
    assert hits >= 45 and clean >= 40


def test_windows_hold_every_stretch():
    r = random.Random(3)
    whole = secrets.INSIDE - secrets.STEP
    for n in (16, 31, 32, 33, 39, 40, 41, 200, 201, 777):
        run = "".join(r.choices("abcdef0123456789", k=n))
        got = secrets.windows(f"x {run} y", 2, 2 + n)
        inside = [w[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE].decode().rstrip() for w in got]
        for at in range(max(1, n - whole + 1)):
            assert any(run[at : at + whole] in w for w in inside)


def test_long_runs_are_scored_in_slabs(net):
    run = "".join(random.Random(4).choices("abcdef/0123456789", k=3 * secrets.STEP * secrets.SLAB + 5))
    x = np.frombuffer(b"".join(secrets.windows(run, 0, len(run))), np.uint8).reshape(-1, secrets.WIDTH).astype(np.int64)
    data, offsets = secrets.text_buffer(pa.array([run]))
    got = secrets.scores(data, offsets, *secrets.candidates(data, offsets), net)
    assert len(got) == 1 and abs(got[0] - net.score(x).max()) < 1e-6
