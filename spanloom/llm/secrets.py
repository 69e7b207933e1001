"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Base findings are the matches of three patterns over the whole text. Candidates are all maximal runs of at least
``LEAST`` characters of ``[A-Za-z0-9+/_.=-]``, words of prose among them. Each is judged with the characters around it, longer
ones in overlapping windows of which the greatest score counts, by a small convolutional network in numpy: an embedding of
ASCII, one convolution, maximum and mean over the candidate and the maximum over all.

It is trained on labelled findings. The corpus gives the base findings, and as negatives plain runs (letters alone) and mixed
ones (paths, dates, host names and the like) that no pattern takes. Shapes that a corpus may lack are added by rule (``shapes``): random
keys of several alphabets, and benign runs such as UUIDs, versions, file names and identifiers, both in surroundings taken from the
corpus. Half of all windows are shown with blank surroundings, so that the characters of the candidate must carry the decision.

One scan writes all windows of all labelled runs to the shared folder. Training starts on the ``max_rows`` of each kind with the least
hash; then every window that is not held out takes part in the sums of gradients, a part of the table at each step (``refine``). The third
that is held out gives the calibration, a logistic fit, and the threshold, the highest that keeps ``recall`` of its findings (``settle``).
Mixed windows that look like keys to a network trained without them are left out: they may be of secrets that nobody labelled.

Null is the empty text and has no findings. Texts are judged by themselves, so repeated rows get the same result; an empty table
gives no rows; only the id and the text are read, whatever other columns are called, and ``redact`` passes all others on.
With no labelled findings there is no network and the base findings stand alone. Of candidates with equal scores all or none are taken.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.arrow import text_batches, text_buffer
from spanloom.tables import Scratch, released

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")  # the same as those matches of HEX that are long enough
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key", b"akia")
LEAST = 8
KINDS = {"assign": 0, "access": 1, "hex": 2, "net": 3}
BEFORE, INSIDE, AFTER = 16, 32, 4
STEP, SLAB = 8, 4096
WIDTH = BEFORE + INSIDE + AFTER
PARTS = 16  # steps of a round over all windows
HELD, FIRST = PARTS, -1
BLOCKS = 8 << 20  # bytes of windows that are written at once
MARGIN, RATE, ROUNDS, WEIGHT = 2.0, 0.002, 1, 10
UNIT, GRAIN = 2**20, 256

LETTERS = "abcdefghijklmnopqrstuvwxyz"
_RUN_BYTES = np.zeros(256, bool)
_RUN_BYTES[[*b"0123456789+/_.=-", *LETTERS.encode(), *LETTERS.upper().encode()]] = True
_LETTER_BYTES = np.zeros(256, bool)
_LETTER_BYTES[[*LETTERS.encode(), *LETTERS.upper().encode()]] = True
_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[[*b"0123456789abcdef"]] = True


def base_findings(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX_LONG.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS[x[0]]))


def written(findings: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in findings)


def _long_runs(member: np.ndarray, least: int) -> np.ndarray:
    """Starts of all stretches of ``least`` members, by doubling."""
    have, out = 1, member
    while have < least:
        step = min(have, least - have)
        out = out[:-step] & out[step:] if len(out) > step else out[:0]
        have += step
    return np.flatnonzero(out)


def interesting(column: pa.Array) -> np.ndarray:
    """Which texts can hold a base finding."""
    data, offsets = text_buffer(column)
    out = np.zeros(len(column), bool)
    low = data.tobytes().lower()
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, side="right")) - 1
            out[k] = True
            at = low.find(word, int(offsets[k + 1]))
    # runs that straddle two texts only mark a text too many
    out[np.searchsorted(offsets, _long_runs(_HEX_BYTES[data], 24), side="right") - 1] = True
    return out


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and end of every candidate of the texts that lie end to end in ``data``."""
    member = np.concatenate(([False], _RUN_BYTES[data], [False]))
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    start = np.flatnonzero(member[1:-1] & ~(member[:-2] & ~begins[:-1]))
    end = np.flatnonzero(member[1:-1] & ~(member[2:] & ~begins[1:])) + 1
    keep = end - start >= LEAST
    start, end = start[keep], end[keep]
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def parts(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first byte and end of the windows' parts of the runs.

    A run longer than a window has one every ``STEP`` characters and one at its end, so any ``INSIDE - STEP`` characters
    of it are whole in one."""
    n = np.maximum(0, -(-(end - start - INSIDE) // STEP)) + 1
    owner = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    a = np.maximum(start[owner], np.minimum(start[owner] + k * STEP, end[owner] - INSIDE))
    return owner, a, np.minimum(end[owner], a + INSIDE)


def gather(data: np.ndarray, low: np.ndarray, high: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Windows around the parts a to z of texts that go from low to high: codes at fixed places, blank where there is
    nothing; all bytes other than ASCII are one code."""
    out = np.empty((len(a), WIDTH), np.uint8)
    for at, width, first, least, most in ((0, BEFORE, a - BEFORE, low, a), (BEFORE, INSIDE, a, a, z), (BEFORE + INSIDE, AFTER, z, z, high)):
        place = first[:, None] + np.arange(width)
        there = (place >= least[:, None]) & (place < most[:, None])
        out[:, at : at + width] = np.where(there, data[np.clip(place, 0, len(data) - 1)], 32)
    return np.where(out < 128, out, 63).astype(np.uint8)


def slabs(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray):
    """All windows of the runs, at most ``SLAB`` at a time, with the run that each is of."""
    ends = np.cumsum(np.maximum(0, -(-(end - start - INSIDE) // STEP)) + 1)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB, side="right")))
        owner, a, z = parts(start[at:to], end[at:to])
        for k in range(0, len(owner), SLAB):
            s = slice(k, k + SLAB)
            own = text[at + owner[s]]
            yield at + owner[s], gather(data, offsets[own], offsets[own + 1], a[s], z[s])
        at = to


def windows(text: str, start: int, end: int) -> list[bytes]:
    """The windows of one run of an ASCII text."""
    data = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    _, a, z = parts(np.array([start]), np.array([end]))
    return [w.tobytes() for w in gather(data, np.zeros(len(a), int), np.full(len(a), len(data)), a, z)]


@dataclass
class Net:
    """Weights of the network, its calibration and threshold."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @staticmethod
    def fresh(seed: int = 5, emb: int = 8, filters: int = 24, width: int = 5) -> "Net":
        r = np.random.default_rng(seed)
        w = {"emb": r.normal(0, 0.5, (128, emb)), "conv": r.normal(0, (2 / (width * emb)) ** 0.5, (width * emb, filters)), "bias": np.zeros(filters), "out": r.normal(0, 0.1, 3 * filters), "out0": np.zeros(1)}
        return Net({k: v.astype(np.float32) for k, v in w.items()})

    def forward(self, x: np.ndarray):
        """Logits of windows of codes (n, WIDTH), and what the gradient needs."""
        w = self.weights
        width = w["conv"].shape[0] // w["emb"].shape[1]
        e = w["emb"].take(x, axis=0)
        n, t, d = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, (width, d), axis=(1, 2)).reshape(n, t - width + 1, width * d)
        z = cols @ w["conv"] + w["bias"]
        a = np.maximum(z, 0)
        own = a[:, BEFORE : BEFORE + INSIDE - width + 1]
        used = (x[:, BEFORE : BEFORE + INSIDE - width + 1] != 32).astype(np.float32)[:, :, None]
        top, all_top = (own * used).max(1), a.max(1)
        mean = (own * used).sum(1) / np.maximum(used.sum(1), 1)
        pooled = np.concatenate((top, mean, all_top), axis=1)
        return pooled @ w["out"] + w["out0"][0], (cols, a, own, used, top, all_top, pooled, width)

    def gradient(self, x, g, kept) -> dict[str, np.ndarray]:
        """Of the loss by each weight, where g is that by the logits."""
        w = self.weights
        cols, a, own, used, top, all_top, pooled, width = kept
        n, f = len(x), a.shape[2]
        gp = g[:, None] * w["out"]
        ga = np.zeros_like(a)
        part = ga[:, BEFORE : BEFORE + INSIDE - width + 1]
        part += (gp[:, f : 2 * f] / np.maximum(used.sum(1), 1))[:, None] * used
        rows, fs = np.arange(n)[:, None], np.arange(f)[None]
        at = (own * used).argmax(1)
        part[rows, at, fs] += gp[:, :f] * used[rows, at, 0]
        ga[rows, a.argmax(1), fs] += gp[:, 2 * f :]
        gz = ga * (a > 0)
        gc = gz @ w["conv"].T
        d = w["emb"].shape[1]
        ge = np.zeros((n, x.shape[1], d), np.float32)
        for k in range(width):
            ge[:, k : k + gc.shape[1]] += gc[:, :, k * d : (k + 1) * d]
        emb = np.zeros_like(w["emb"])
        np.add.at(emb, x, ge)
        return {"emb": emb, "conv": np.tensordot(cols, gz, ((0, 1), (0, 1))), "bias": gz.sum((0, 1)), "out": pooled.T @ g, "out0": np.array([g.sum()], np.float32)}

    def tables(self) -> tuple[np.ndarray, ...]:
        """What each two characters, the two after them and the last add to the filters of a place."""
        w = self.weights
        d = w["emb"].shape[1]
        t = [w["emb"] @ w["conv"][k : k + d] for k in range(0, w["conv"].shape[0], d)]
        pairs = [(t[k][:, None] + t[k + 1][None]).reshape(-1, t[k].shape[1]) for k in (0, 2)]
        return pairs[0] + w["bias"], pairs[1], t[4]

    def logits(self, x: np.ndarray, tables: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """Those of ``forward`` without what the gradient needs: windows go by their length, so that places blank in all of a
        slab are left out. The logit of a window does not depend on what other windows there are."""
        first, second, last = tables or self.tables()
        top_w, mean_w, all_w = self.weights["out"].reshape(3, -1)
        blank = np.maximum(first[32 * 129] + second[32 * 129] + last[32], 0)
        n = INSIDE - (x[:, BEFORE : BEFORE + INSIDE] == 32).sum(1)
        order = np.argsort(n, kind="stable")
        places = INSIDE - 4
        out = np.empty(len(x))
        for i in range(0, len(x), 512):
            at = order[i : i + 512]
            c = np.ascontiguousarray(x[at].T).astype(np.intp)
            two = c[:-1] * 128 + c[1:]

            def filters(a, b):
                z = first.take(two[a:b], axis=0)
                z += second.take(two[a + 2 : b + 2], axis=0)
                z += last.take(c[a + 4 : b + 4], axis=0)
                return np.maximum(z, 0, out=z)

            long = min(int(n[at[-1]]), places)
            z = filters(0, BEFORE + long)
            all_top = np.maximum(z.max(0), filters(BEFORE + places, WIDTH - 4).max(0))
            if long < places:
                all_top = np.maximum(all_top, blank)
            used = (c[BEFORE : BEFORE + long] != 32).astype(np.float32)[:, :, None]
            own = z[BEFORE:] * used
            top = own.max(0, initial=0)
            mean = own.sum(0) / np.maximum(used.sum(0), 1)
            out[at] = (top * top_w + mean * mean_w + all_top * all_w).sum(1) + self.weights["out0"][0]
        return out

    def score(self, x: np.ndarray, tables: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        return self.probability(self.logits(x, tables))

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * logits + self.shift)))


def calibrated(logits: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit, with a little ridge towards the raw scores."""
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(ab[0] * logits + ab[1])))
        d, h = weight * (p - truth), weight * p * (1 - p)
        grad = np.array([(d * logits).sum() + 0.1 * (ab[0] - 1), d.sum() + 0.1 * ab[1]])
        hess = np.array([[(h * logits * logits).sum() + 0.1, (h * logits).sum()], [(h * logits).sum(), h.sum() + 0.1]])
        move = np.linalg.solve(hess, grad)
        ab -= np.clip(move, -1, 1)
    return float(ab[0]), float(ab[1])


def train(rows: list[tuple[bytes, int]], epochs: int = 12, recall: float = 0.98, seed: int = 5, held: list[bool] | None = None) -> Net | None:
    """A calibrated network from (window, label) rows, or none unless there are rows of both labels to train and to hold out.

    Label 1 is a finding, any other is none. Rows of ``held``, or every third, are held out of the training, for calibration and threshold."""
    x = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, WIDTH).astype(np.int64) & 127
    y = np.array([r[1] == 1 for r in rows], np.float32)
    held = np.arange(len(y)) % 3 == 2 if held is None else np.array(held, bool)
    if min(y[held].sum(), (1 - y[held]).sum(), y[~held].sum(), (1 - y[~held]).sum()) < 1:
        return None
    net, r = Net.fresh(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    own, step = np.flatnonzero(~held), 0
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())).astype(np.float32)
    for _ in range(epochs):
        for at in np.array_split(r.permutation(own), max(1, len(own) // 64)):
            b = x[at].copy()
            blank = r.random(len(b)) < 0.5
            b[blank, :BEFORE] = 32
            b[blank, -AFTER:] = 32
            logits, kept = net.forward(b)
            g = ((1 / (1 + np.exp(-logits)) - y[at]) * weight[at] / len(at)).astype(np.float32)
            step += 1
            for k, d in net.gradient(b, g, kept).items():
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.001 * (d * d - second[k])
                net.weights[k] -= 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    logits, truth = net.forward(x[held])[0].astype(np.float64), y[held]
    net.scale, net.shift = calibrated(logits, truth, np.ones(len(truth)))
    found = np.sort(net.score(x[held])[truth == 1])
    net.threshold = float(found[int((1 - recall) * len(found))])
    return net


def _word(r: np.random.Generator, low: int = 2, high: int = 5) -> str:
    """A pronounceable word of so many syllables."""
    pick = lambda x: x[r.integers(len(x))]
    return "".join(pick("bcdfghklmnprstvw") + pick("aeiou") + (pick("nrslt") if r.random() < 0.3 else "") for _ in range(r.integers(low, high)))


def secret_shape(r: np.random.Generator) -> str:
    """A random key, at times behind a vendor's prefix."""
    pools = (LETTERS + LETTERS.upper() + "0123456789", LETTERS + LETTERS.upper() + "0123456789+/", LETTERS.upper() + "234567", "0123456789abcdef", "0123456789ABCDEF", LETTERS + "0123456789", LETTERS + LETTERS.upper() + "0123456789_-")
    pool = pools[r.integers(len(pools))]
    key = "".join(pool[k] for k in r.integers(0, len(pool), r.integers(16, 49)))
    mark = "_" if r.random() < 0.7 else "-"
    return mark.join([_word(r, 1, 3) for _ in range(r.integers(0, 3))] + [key])


def benign_shape(r: np.random.Generator) -> str:
    """A run that is no secret: an identifier, a path, a date, a version, a host or file name, a number, a word, a rule."""
    n = lambda low, high: str(r.integers(low, high))
    words = lambda low, high: [_word(r) for _ in range(r.integers(low, high))]
    h = "".join("0123456789abcdef"[k] for k in r.integers(0, 16, 32))
    y, m, d = n(1950, 2040), f"{r.integers(1, 13):02d}", f"{r.integers(1, 29):02d}"
    made = (
        lambda: "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:])),
        lambda: "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:])).upper(),
        lambda: ("-", ".", "/")[r.integers(3)].join((y, m, d)) + ("T" + n(10, 24) if r.random() < 0.3 else ""),
        lambda: y + m + d + ("T" + n(100000, 240000) if r.random() < 0.5 else ""),
        lambda: _word(r) + "-" + ".".join((n(0, 30), n(0, 30), n(0, 999))) + ("", ".tar.gz", "-rc" + n(1, 9), "-SNAPSHOT")[r.integers(4)],
        lambda: ".".join(words(2, 4) + [("com", "org", "net", "example", "io")[r.integers(5)]]),
        lambda: ".".join([_word(r) + n(0, 100), *words(1, 3), "org"]),
        lambda: "/" * int(r.integers(2)) + "/".join(words(2, 7)) + ("", "/", ".html", "/v" + n(1, 9), "/" + n(1, 99999))[r.integers(5)],
        lambda: "_".join([w.capitalize() if r.random() < 0.5 else w for w in words(1, 4)] + [y]) + (".pdf", ".txt", ".jpg", ".csv", ".docx")[r.integers(5)],
        lambda: "".join(str(k) for k in r.integers(0, 10, r.integers(8, 24))),
        lambda: ".".join((n(0, 10**6), n(0, 10**9))),
        lambda: "-".join("".join(str(k) for k in r.integers(0, 10, r.integers(2, 5))) for _ in range(r.integers(3, 6))),
        lambda: "".join(w.capitalize() for w in words(2, 5)) + ("" if r.random() < 0.6 else n(0, 100)),
        lambda: "".join(w.capitalize() if k else w for k, w in enumerate(words(2, 5))),
        lambda: "_".join(words(2, 6)),
        lambda: "_".join(words(2, 5)).upper(),
        lambda: "-".join(words(2, 6)),
        lambda: _word(r, 1, 3).upper() + "-" + n(100, 10**6),
        lambda: _word(r, 3, 8) + ("" if r.random() < 0.7 else "."),
        lambda: _word(r, 3, 7).capitalize(),
        lambda: _word(r, 3, 7).upper(),
        lambda: "".join(LETTERS[k] for k in r.integers(0, 26, r.integers(8, 15))),
        lambda: "".join(LETTERS[k] for k in r.integers(0, 26, r.integers(8, 15))).upper(),
        lambda: "".join(_word(r, 1, 3) + LETTERS[r.integers(26)] for _ in range(r.integers(3, 6))).upper(),
        lambda: "-=._/+"[r.integers(6)] * int(r.integers(8, 60)),
    )
    return made[r.integers(len(made))]().ljust(LEAST, "s")


def shapes(surroundings: list[bytes], n: int, seed: int = 7) -> list[tuple[bytes, int]]:
    """Windows of ``n`` random keys and ``n`` benign runs, in the surroundings of windows of the corpus."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(2 * n):
        run = benign_shape(r) if k % 2 else secret_shape(r)
        w = surroundings[r.integers(len(surroundings))] if surroundings else b" " * WIDTH
        before, after = w[:BEFORE].decode(), w[BEFORE + INSIDE :].decode()
        out += [(x, 1 - k % 2) for x in windows(before + run + after, BEFORE, BEFORE + len(run))]
    return out


def _byte_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return spans if text.isascii() else [(len(text[:a].encode("utf-8", "surrogatepass")), len(text[:z].encode("utf-8", "surrogatepass"))) for a, z in spans]


def _others(column: pa.Array, base: dict[int, list]) -> tuple[np.ndarray, ...]:
    """The bytes and offsets of the texts, and the candidates that no base finding overlaps."""
    data, offsets = text_buffer(column)
    text, start, end = candidates(data, offsets)
    keep = np.ones(len(text), bool)
    for k, found in base.items():
        s = slice(*np.searchsorted(text, (k, k + 1)))
        for a, z in _byte_spans(column[k].as_py(), [(a, z) for _, a, z in found]):
            keep[s] &= (end[s] <= offsets[k] + a) | (start[s] >= offsets[k] + z)
    return data, offsets, text[keep], start[keep], end[keep]


def _mixed_hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Least:
    """The windows of one label with the least keys so far, one for each key."""

    def __init__(self, most: int):
        self.most, self.keys, self.windows = most, np.zeros(0, np.uint64), np.zeros((0, WIDTH), np.uint8)

    def limit(self) -> np.uint64:
        return self.keys[-1] if len(self.keys) == self.most else np.uint64(2**64 - 1)

    def add(self, keys: np.ndarray, windows: np.ndarray) -> None:
        keys, windows = np.concatenate((self.keys, keys)), np.concatenate((self.windows, windows))
        order = np.lexsort((*windows.T[::-1], keys))
        keys, windows = keys[order], windows[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        self.keys, self.windows = keys[first][: self.most], windows[first][: self.most]


def labelled(docs: DataFrame, max_rows: int) -> DataFrame:
    """Blocks of all labelled windows of all documents: label 0 those of plain runs, 1 of findings, 2 of mixed runs.

    A hash of the run says which part a window is in: one of ``PARTS`` that are trained on or, every third, ``HELD``. Part ``FIRST`` has,
    one by one, the ``max_rows`` windows of each label with the least hash that a task has seen, from which training starts."""

    def run(batches):
        least = [_Least(max_rows) for _ in range(3)]
        schema = pa.schema([("part", pa.int32()), ("label", pa.int32()), ("key", pa.int64()), ("windows", pa.binary())])
        held: dict[tuple[int, int], list[bytes]] = {}
        size = 0

        def put(label, keys, x):
            nonlocal size
            where = np.where(keys % np.uint64(3) == 2, HELD, (keys // np.uint64(3) % np.uint64(PARTS)).astype(np.int64))
            order = np.argsort(where, kind="stable")
            ends = np.searchsorted(where[order], np.arange(HELD + 2))
            x = x[order]
            for part in np.flatnonzero(np.diff(ends)):
                held.setdefault((int(part), label), []).append(x[ends[part] : ends[part + 1]].tobytes())
            size += x.nbytes

        def blocks():
            nonlocal size
            rows = [(part, label, 0, b"".join(x)) for (part, label), x in sorted(held.items())]
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in text_batches(batches):
            column = b.column(0)
            base = {int(k): found for k in np.flatnonzero(interesting(column)) if (found := base_findings(column[k].as_py()))}
            data, offsets, text, start, end = _others(column, base)
            if len(start):
                # a run's key is a hash of its length, its first eight characters and the eight before them
                eight = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
                ahead = np.where(start - offsets[text] >= 8, eight[np.maximum(start - 8, 0)], np.uint64(0))
                keys = _mixed_hash(eight[start] ^ _mixed_hash(ahead ^ _mixed_hash((end - start).astype(np.uint64))))
                letters = np.concatenate(([0], np.cumsum(_LETTER_BYTES[data])))
                plain = letters[end] - letters[start] == end - start
                for label, mine in ((0, plain), (2, ~plain)):
                    at = np.flatnonzero(mine & (keys <= least[label].limit()))
                    if len(at) > max_rows:
                        at = at[keys[at] <= np.unique(keys[at])[:max_rows][-1]]
                    owner, a, z = parts(start[at], np.minimum(end[at], start[at] + INSIDE))
                    least[label].add(keys[at], gather(data, offsets[text[at]], offsets[text[at] + 1], a, z))
                for owner, x in slabs(data, offsets, text, start, end):
                    for label, mine in ((0, plain[owner]), (2, ~plain[owner])):
                        put(label, keys[owner][mine], x[mine])
                    if size > BLOCKS:
                        yield blocks()
            for k, found in base.items():
                t = column[k].as_py()
                values = []
                for _, a, z in found:
                    m = ASSIGN.match(t, a)
                    values.append(m.span(2) if m and m.end() == z else (a, z))
                spans = np.array([x for x in _byte_spans(t, values) if x[1] - x[0] >= LEAST], np.int64).reshape(-1, 2) + offsets[k]
                for _, x in slabs(data, offsets, np.full(len(spans), k), spans[:, 0], spans[:, 1]):
                    keys = np.array([int.from_bytes(hashlib.md5(w.tobytes()).digest()[:8], "little") for w in x], np.uint64)
                    least[1].add(keys, x)
                    put(1, keys, x)
                    if size > BLOCKS:
                        yield blocks()
        if held:
            yield blocks()
        rows = [(FIRST, label, int(k.view(np.int64)), w.tobytes()) for label, x in enumerate(least) for k, w in zip(x.keys, x.windows)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.where("text is not null").select("text").mapInArrow(run, "part int, label int, key bigint, windows binary")


def _codes(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(-1, WIDTH)


def _sure(label: int, x: np.ndarray, without: Net | None, tables) -> np.ndarray:
    """The windows but for mixed ones that ``without`` takes for keys."""
    return x[without.score(x, tables) < 0.5] if label == 2 and without else x


def _shown(x: np.ndarray, turn: int) -> np.ndarray:
    """The windows, half of them, by their own characters and the turn, with blank surroundings."""
    out = x.copy()
    blank = (x.sum(1) + turn) % 2 == 1
    out[blank, :BEFORE] = 32
    out[blank, -AFTER:] = 32
    return out


def slopes(net: Net, label: int, x: np.ndarray, tables=None) -> np.ndarray:
    """The gradient of half the squared distance by which logits miss ``MARGIN`` on their side, summed over the windows, in units of
    1 / ``UNIT``. Windows beyond the margin have none. Each window's is rounded by itself, so the order of windows makes no difference."""
    sign = 1 if label == 1 else -1
    missed = x[sign * net.logits(x, tables) < MARGIN]
    out = np.zeros(sum(v.size for v in net.weights.values()), np.int64)
    own, times = np.unique(np.ascontiguousarray(missed).view(f"V{WIDTH}").reshape(-1), return_counts=True)
    for w, n in zip(own, times):
        w = _codes(w.tobytes()).astype(np.int64)
        logit, kept = net.forward(w)
        g = net.gradient(w, (logit - sign * MARGIN).astype(np.float32), kept)
        out += int(n) * np.rint(np.concatenate([g[k].ravel() for k in net.weights]).astype(np.float64) * UNIT).astype(np.int64)
    return out


def _masses(totals: dict[int, int], made: dict[int, np.ndarray]) -> dict[int, float]:
    """The weight of a window of each label, where one made by rule has 1: that of the corpus's own negatives grows with their
    number up to ``WEIGHT`` times that of the made ones, of the findings up to once."""
    return {label: min(1.0, (1 if label == 1 else WEIGHT) * len(made[int(label == 1)]) / n) for label, n in totals.items() if n}


def refine(net: Net, blocks: DataFrame, totals: dict[int, int], made: dict[int, np.ndarray], without: Net | None) -> Net:
    """The network trained on by all windows of ``blocks`` that are not held out and have a label in ``totals``, a part at each step.

    Tasks send the sums of gradients, one number for each weight and label, so nothing grows with the table but their number."""
    masses = _masses(totals, made)
    names, shapes_ = list(net.weights), [v.shape for v in net.weights.values()]
    cuts = np.cumsum([v.size for v in net.weights.values()])
    now = np.concatenate([v.ravel() for v in net.weights.values()]).astype(np.float64)
    first, second, step = np.zeros_like(now), np.zeros_like(now), 0
    for turn in range(ROUNDS):
        for part in range(PARTS):

            def run(batches, net=net, turn=turn):
                out: dict[int, np.ndarray] = {}
                tables, other = net.tables(), without.tables() if without else None
                for b in batches:
                    for label, x in zip(b.column(0).to_pylist(), b.column(1)):
                        sums = slopes(net, label, _shown(_sure(label, _codes(x.as_py()), without, other), turn), tables)
                        out[label] = out.get(label, 0) + sums
                for label, sums in out.items():
                    at = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label, np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["label", "place", "total"])

            mine = blocks.where((F.col("part") == part) & F.col("label").isin(*totals)).select("label", "windows")
            got = mine.mapInArrow(run, "label int, place int, total bigint").groupBy("label", "place").agg(F.sum("total").alias("total")).collect()
            g = np.zeros_like(now)
            for label in totals:
                sums = np.zeros_like(now)
                rows = [r for r in got if r["label"] == label]
                sums[[r["place"] for r in rows]] = [r["total"] for r in rows]
                g += masses.get(label, 0) * PARTS * sums / UNIT
            for y, x in made.items():
                g += slopes(net, y, _shown(x, step)) / UNIT
            g /= sum(map(len, made.values()))
            step += 1
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            now -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            net = Net({k: v.reshape(s).astype(np.float32) for k, v, s in zip(names, np.split(now, cuts[:-1]), shapes_)}, net.scale, net.shift, net.threshold)
    return net


def settle(net: Net, blocks: DataFrame, totals: dict[int, int], made: dict[int, np.ndarray], without: Net | None, recall: float) -> Net:
    """The network calibrated on all windows held out, with the threshold that keeps ``recall`` of the findings among them.

    Logits are counted by steps of 1 / ``GRAIN``; the threshold is the highest such step that keeps the recall."""

    def counted(logits):
        return np.unique(np.clip(np.floor(logits * GRAIN), -(2**15), 2**15).astype(np.int32), return_counts=True)

    def run(batches):
        tables, other = net.tables(), without.tables() if without else None
        for b in batches:
            for label, x in zip(b.column(0).to_pylist(), b.column(1)):
                bins, n = counted(net.logits(_sure(label, _codes(x.as_py()), without, other), tables))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), label, np.int32)), pa.array(bins), pa.array(n.astype(np.int64))], names=["label", "bin", "n"])

    mine = blocks.where((F.col("part") == HELD) & F.col("label").isin(*totals)).select("label", "windows")
    rows = mine.mapInArrow(run, "label int, bin int, n bigint").groupBy("label", "bin").agg(F.sum("n").alias("n")).orderBy("label", "bin").collect()
    held = {label: sum(r["n"] for r in rows if r["label"] == label) for label in totals}
    # each kind of the corpus counts as much as the made rows of its side at most
    share = {label: min(1.0, len(made[int(label == 1)]) / n) for label, n in held.items() if n}
    seen = [(r["bin"], r["n"] * share[r["label"]], float(r["label"] == 1)) for r in rows]
    seen += [(int(k), float(n), float(y)) for y, x in made.items() for k, n in zip(*counted(net.logits(x)))]
    bins, weight, truth = (np.array(c, np.float64) for c in zip(*seen))
    scale, shift = calibrated((bins + 0.5) / GRAIN, truth, weight)
    found = truth == 1
    order = np.argsort(bins[found], kind="stable")
    steps, mass = bins[found][order], weight[found][order]
    below = np.cumsum(mass) - mass
    # the first row of a step says what lies below all of it
    steps, at = np.unique(steps, return_index=True)
    edge = steps[np.flatnonzero(below[at] <= (1 - recall) * mass.sum() + 1e-9)[-1]] / GRAIN
    out = Net(net.weights, scale, shift)
    out.threshold = float(out.probability(np.float64(edge)))
    return out


def fit(docs: DataFrame, max_rows: int = 1500, recall: float = 0.98) -> Net | None:
    """The network from all labelled windows of all documents. Training starts on at most ``max_rows`` of each label."""
    with released():
        blocks = Scratch(docs.sparkSession, "secrets").keep(labelled(docs, max_rows), "windows", "part")
        # of a key several tasks may have a window; keys are ordered as unsigned, as in the tasks, and thinned before they meet
        rows = blocks.where(F.col("part") == FIRST).groupBy("label", "key").agg(F.min("windows").alias("window"))
        place = F.row_number().over(Window.partitionBy("label").orderBy(F.expr("key < 0"), "key", "window"))
        picked = rows.withColumn("place", place).where(F.col("place") <= max_rows).select("window", "label", "key").collect()
        if not any(r["label"] == 1 for r in picked):
            return None
        own = [(bytes(r["window"]), r["label"], r["key"] % 2**64 % 3 == 2) for r in sorted(picked, key=lambda r: (r["key"], r["label"]))]
        around = [w for w, y, _ in own if y == 0]
        made, spare = shapes(around, max_rows), shapes(around, max_rows // 2, 8)
        ruled = [(*r, False) for r in made] + [(*r, True) for r in spare]

        def start(rows, **more):
            return train([r[:2] for r in rows], recall=recall, held=[r[2] for r in rows], **more)

        # a mixed run that no pattern takes may be a secret that nobody labelled: those that a network trained without them takes
        # for keys are no negatives
        first = start([r for r in own if r[1] < 2] + ruled, epochs=6)
        mixed = _codes(b"".join(w for w, y, _ in own if y == 2))
        doubtful = {w.tobytes() for w in mixed[first.score(mixed) >= 0.5]} if first else set()
        net = start([r for r in own if r[1] < 2 or r[0] not in doubtful] + ruled)
        if net is None or first is None:
            return net
        counts = blocks.where(F.col("part").between(0, PARTS - 1)).groupBy("label").agg(F.sum(F.length("windows")).alias("n")).collect()
        totals = {label: sum(r["n"] // WIDTH for r in counts if r["label"] == label) for label in range(3)}
        made, spare = ({y: _codes(b"".join(w for w, label in rows if label == y)) for y in (0, 1)} for rows in (made, spare))
        clear = {label: totals[label] for label in (0, 1)}
        first = settle(refine(first, blocks, clear, made, None), blocks, clear, spare, None, recall)
        return settle(refine(net, blocks, totals, made, first), blocks, totals, spare, first, recall)


def scores(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, net: Net) -> np.ndarray:
    """The greatest score of the windows of each candidate, of about ``SLAB`` windows at a time."""
    out = np.zeros(len(start))
    tables = net.tables()
    for run, x in slabs(data, offsets, text, start, end):
        np.maximum.at(out, run, net.score(x, tables))
    return out


def find(column: pa.Array, net: Net | None) -> dict[int, tuple[list, list]]:
    """For each text that has any: its base findings, and all: the candidates that the network takes are added where no base
    finding overlaps. Places count code points."""
    base = {int(k): found for k in np.flatnonzero(interesting(column)) if (found := base_findings(column[int(k)].as_py()))}
    out = {k: (found, found) for k, found in base.items()}
    if net is None:
        return out
    data, offsets, text, start, end = _others(column, base)
    hits = np.flatnonzero(scores(data, offsets, text, start, end, net) >= net.threshold)
    for k in np.unique(text[hits]):
        mine = hits[text[hits] == k]
        count = np.concatenate(([0], np.cumsum((data[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80)))
        more = [("net", int(count[a]), int(count[z])) for a, z in zip(start[mine] - offsets[k], end[mine] - offsets[k])]
        own = base.get(int(k), [])
        out[int(k)] = own, sorted(own + more, key=lambda f: (f[1], KINDS[f[0]]))
    return out


def findings(text: str, net: Net | None) -> tuple[list, list]:
    """The base findings of one text, and all."""
    return find(pa.array([text]), net).get(0, ([], []))


def scan(docs: DataFrame, net: Net | None) -> DataFrame:
    """A row for each document: the counts and digest of its base findings and all spans, by code point."""

    def run(batches):
        for b in text_batches(batches):
            found = find(b.column(1), net)
            rows: list[list] = [[], [], [], [], []]
            for k in range(b.num_rows):
                base, every = found.get(k, ([], []))
                counts = [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
                for column, x in zip(rows, (*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in rows[:3]), *(pa.array(c, pa.string()) for c in rows[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, net: Net | None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding replaced by ``mark``; overlapping findings are replaced together. Null stays null."""

    def clean(text: str, found: list) -> str:
        out, at = [], 0
        for _, a, b in found:
            if b > at:
                if a >= at:
                    out += [text[at:a], mark]
                at = b
        return "".join([*out, text[at:]])

    where = docs.columns.index("text")

    def run(batches):
        for b in text_batches(batches):
            column = b.column(where)
            found = find(column.fill_null(""), net)
            if not found:
                yield b
                continue
            texts = column.to_pylist()
            for k, (_, every) in found.items():
                texts[k] = clean(texts[k], every)
            yield b.set_column(where, b.schema.field(where), pa.array(texts, column.type))

    return docs.mapInArrow(run, docs.schema)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, fit(docs))
