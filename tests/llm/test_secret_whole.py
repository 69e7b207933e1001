"""The network of the secret scan is fitted on all labelled windows, not on those that training starts from."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import secrets

HEX = "0123456789abcdef"


def texts():
    r = random.Random(8)
    word = lambda n: "".join(r.choices("abcdefghij", k=n))
    rows = []
    for i in range(300):
        key = " " + "".join(r.choices(HEX, k=32)) if i % 3 == 0 else ""
        rows.append((i, f"we saw {word(r.randint(8, 60))} on {1900 + i}-01-{10 + i % 18}{key}"))
    return rows


def test_every_labelled_window_is_in_one_block(spark):
    rows = texts()
    want = Counter()
    for _, t in rows:
        base = secrets.base_findings(t)
        for w in t.split():
            at = t.index(w)
            if len(w) >= secrets.LEAST:
                label = 1 if any(a < at + len(w) and at < z for _, a, z in base) else 0 if w.isalpha() else 2
                want.update((label, x) for x in secrets.windows(t, at, at + len(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text")
    for docs in (df.repartition(5), df.repartition(2, "text")):
        got = Counter()
        for b in secrets.labelled(docs, 10).where(F.col("part") >= 0).collect():
            x = bytes(b.windows)
            got.update((b.label, x[k : k + secrets.WIDTH]) for k in range(0, len(x), secrets.WIDTH))
        assert got == want


def test_windows_beyond_the_start_change_the_network(spark, monkeypatch):
    """Two tables of which training starts on the same 40 windows of each label; partitions make no difference, other documents do."""
    rows, start, seen, plain = texts(), [], [], secrets.train
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(secrets, "train", lambda rows, **_: start.append(rows))
    secrets.fit(df, 40)
    inside = {bytes(w)[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE].decode().strip() for w, _ in start[1]}
    some = [x for x in rows if any(run in x[1] for run in inside)]
    assert 40 <= len(some) < 200
    monkeypatch.setattr(secrets, "train", lambda rows, **more: seen.append(rows) or plain(rows, **more))
    one, other = secrets.fit(df.repartition(5), 40), secrets.fit(df.repartition(2, "text"), 40)
    fewer = secrets.fit(spark.createDataFrame(some, "doc_id long, text string"), 40)
    assert seen[:2] == seen[2:4] == seen[4:]
    assert all((one.weights[k] == other.weights[k]).all() for k in one.weights) and one.threshold == other.threshold
    assert any((one.weights[k] != fewer.weights[k]).any() for k in one.weights)


@pytest.mark.parametrize("label", [0, 1])
def test_sums_of_gradients(label):
    """Against the gradient of the loss as a whole, and over the windows in any order and number of pieces."""
    r = np.random.default_rng(3)
    x = r.integers(33, 120, (40, secrets.WIDTH)).astype(np.uint8)
    for k in range(40):
        x[k, secrets.BEFORE + 8 + k % 25 : secrets.BEFORE + secrets.INSIDE] = 32
    net, sign = secrets.Net.fresh(2), 1 if label else -1
    logits, kept = net.forward(x.astype(np.int64))
    assert np.allclose(net.logits(x), logits, atol=1e-5)
    g = net.gradient(x.astype(np.int64), np.where(sign * logits < secrets.MARGIN, logits - sign * secrets.MARGIN, 0).astype(np.float32), kept)
    got = secrets.slopes(net, label, x)
    assert np.allclose(got / secrets.UNIT, np.concatenate([g[k].ravel() for k in net.weights]), atol=1e-3)
    assert (got == secrets.slopes(net, label, x[::-2]) + secrets.slopes(net, label, x[::2])).all()
