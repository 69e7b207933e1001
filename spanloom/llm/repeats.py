"""The plan that substring operators share: find, exchange and remove strings of ``window`` symbols that repeat.

A string of ``window`` symbols is known by its anchor, the symbol run of ``gram`` symbols with the least hash inside it
(the leftmost of equals). Equal strings have equal anchors at equal places, and neighbouring strings mostly share theirs, so
a text of n symbols has about 2 n / (window - gram) anchors. The steps:

1. Documents are dealt into chunks by a hash of the id and the text; a chunk sends each of its anchors' hashes once to a bucket.
2. A bucket tells each chunk which of its anchors occur in two documents or more, and which in more than ``hot``.
3. A chunk sends the strings around the shared anchors to the bucket of the anchor: each run of strings with one anchor
   as one piece of text, so that strings which may be equal meet in one bucket. A hot anchor's strings are first resolved
   within the chunk, by the same method, and those that are left sent one by one to the bucket of their own hash: a passage
   that any share of all documents holds reaches a bucket once from each chunk, and its strings reach many buckets.
4. A bucket decides exactly which strings also start in a document with a smaller id (by suffix sorting or suffix trees).
   Its pieces lie in files of the task, never in memory as a whole.
5. A chunk removes what those strings cover.

Hashes only choose where to look: equality is decided on the symbols themselves. The documents are shuffled once, and
steps 1, 3 and 5 read the same exchange. Every group has the size of a chunk or of a bucket, whatever the keys.

A null text is empty, a null id counts as larger than all others; rows with one id do not remove each other's text. Repeated
rows are rows of their own, an empty table gives an empty result, and extra columns pass or are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm import spill

#: Symbols whose windows are searched at a time, so that the arrays stay in the processor's cache.
BLOCK = 1 << 18
LAST = np.iinfo(np.int64).max
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Bytes:
    """The symbols of a chunk are the bytes of its texts."""

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.ends - [len(t) for t in texts]
        self.n = len(self.data)

    def grams(self, a: int, z: int, gram: int) -> np.ndarray:
        """Hash of the ``gram`` symbols from each of a .. z - gram on."""
        part = self.data[a:z]
        n = len(part) - gram + 1
        at = lambda k: np.ndarray((n,), "<u8", buffer=part, offset=k, strides=(1,))
        h = at(0) * np.uint64(0x9E3779B97F4A7C15)
        for k in [*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
            h = (h ^ (h >> np.uint64(29))) + at(k)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return mix(h)

    def piece(self, a: int, z: int) -> bytes:
        return self.data[a:z]


class Words:
    """The symbols of a chunk are the words of its texts, maximal runs without ASCII white space."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        space = SPACES[raw]
        edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        self.word_at, self.word_end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        self.n = len(self.word_at)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        text_at = np.cumsum(sizes) - sizes
        self.starts = np.searchsorted(self.word_at, text_at)
        self.ends = np.append(self.starts[1:], self.n) if len(texts) else self.starts
        self.hashes = mix(self._word_hashes(raw))

    def _word_hashes(self, raw: np.ndarray, slab: int = 1 << 20) -> np.ndarray:
        """Polynomial hashes of the words, slab by slab: a word that a slab's end would cut is left to the next slab."""
        out = np.empty(self.n, np.uint64)
        base, k = 0x9E3779B97F4A7C15, 0
        inverse = pow(base, -1, 1 << 64)
        while k < self.n:
            a = self.word_at[k]
            j = max(k + 1, int(np.searchsorted(self.word_end, a + slab, side="right")))
            part = mix(raw[a : self.word_end[j - 1]].astype(np.uint64) + np.uint64(0x1234567))
            up, down = (np.full(len(part) + 1, x, np.uint64) for x in (base, inverse))
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * up[:-1], dtype=np.uint64)))
            s, e = self.word_at[k:j] - a, self.word_end[k:j] - a
            # a difference of running sums, brought back from the word's place by the inverse power
            out[k:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            k = j
        return out

    def grams(self, a: int, z: int, gram: int) -> np.ndarray:
        h, have = self.hashes[a:z], 1
        while have < gram:
            step = min(have, gram - have)
            h = mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:])
            have += step
        return h

    def piece(self, a: int, z: int) -> bytes:
        """The words with a space after each."""
        return b" ".join(self.data[self.word_at[a] : self.word_end[z - 1]].split()) + b" "


def anchors(symbols: Bytes | Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: hash of the anchor, its place, first and last window, document; in order."""
    found = []
    span = window - gram + 1
    for a in range(0, max(0, symbols.n - window + 1), BLOCK):
        z = min(symbols.n, a + BLOCK + window - 1)
        h = symbols.grams(a, z, gram)
        low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        found.append((h[at[first]], at[first] + a, first + a, last + a))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none
    key, at, first, last = (np.concatenate(x) for x in zip(*found))
    doc = np.searchsorted(symbols.ends, at, side="right")
    first, last = np.maximum(first, symbols.starts[doc]), np.minimum(last, symbols.ends[doc] - window)
    keep = first <= last
    return key[keep], at[keep], first[keep], last[keep], doc[keep]


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy()


def ordered(docs: pa.Table, id_col: str, text_col: str) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """The chunk's rows in an order that does not depend on how they arrived, their ids and their texts' bytes."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in docs.column(text_col).to_pylist()]
    ids = _ids(docs.column(id_col))
    tie = [zlib.crc32(t) for t in texts] if len(np.unique(ids)) < len(ids) else np.zeros(len(ids))
    order = np.lexsort((tie, ids))
    return docs.take(order), ids[order], [texts[i] for i in order]


def pack(**columns: np.ndarray) -> bytes:
    """Columns of one length, each written whole."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns.values())


def unpack(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(data, kind, n, at))
        at += size
    return [*out, data[at:]]


@dataclass
class Pieces:
    """Runs of strings that may be equal, as a bucket gets them: arrays in files. ``lead`` is how far the anchor is from the start
    of the first string; the text of a run has ``count + window - 1`` symbols, in ``size`` bytes of ``text`` from ``begin`` on."""

    ids: np.ndarray
    lead: np.ndarray
    count: np.ndarray
    size: np.ndarray
    text: np.ndarray

    def __post_init__(self):
        self.begin = spill.running_starts(self.size)

    @staticmethod
    def of(ids, lead, count, texts: list[bytes]) -> "Pieces":
        logs = [spill.Log(k) for k in ("i8", "i4", "i4", "i4", "u1")]
        for log, x in zip(logs, (ids, lead, count, [len(t) for t in texts])):
            log.add(x)
        for t in texts:
            logs[4].add(np.frombuffer(t, np.uint8))
        return Pieces(*(log.mapped() for log in logs))


#: A bucket's decision: for runs of strings, which also start in a document with a smaller id; rows by string of the run.
Resolver = Callable[[Pieces, int], np.ndarray]


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


_ROW = ["chunk", "bucket", "n", "data"]
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
_SCHEMA = "chunk int, bucket int, n int, data binary"


def murmur(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of ints, which places a row of that key among the partitions."""
    k = x.astype(np.uint32) * np.uint32(0xCC9E2D51)
    k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
    h = np.uint32(seed) ^ k
    h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


#: Up to so many keys are chosen to fall evenly; more of them do so by themselves.
CHOSEN = 1 << 16


def even_keys(count: int, partitions: int) -> list[int]:
    """``count`` ints that Spark's hash deals evenly over the partitions."""
    need = -(-count // partitions)
    x = np.arange(2 * count + 64 * partitions, dtype=np.int64)
    while True:
        at = murmur(x) % partitions
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(partitions + 1))
        if (np.diff(first) >= need).all():
            return (x[order][first[:-1][None, :] + np.arange(need)[:, None]]).ravel()[:count].tolist()
        x = np.arange(2 * len(x), dtype=np.int64)


def chunk_count(docs: DataFrame, text_col: str, chunk_mb: int, blob: int = 5 << 10) -> int:
    """Chunks for the bytes of all texts: of about ``chunk_mb`` while chunks times buckets leaves ``blob`` bytes of text to each
    pair, larger ones beyond; two or more for each partition."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // (chunk_mb << 20)), math.isqrt(size // blob)))


def remove_repeats(
    docs: DataFrame,
    kind: type,
    resolve: Resolver,
    render: Callable[[pa.Table, list[bytes], Bytes | Words, np.ndarray], pa.Table],
    schema: T.StructType | str,
    window: int = 50,
    gram: int = 16,
    hot: int = 2000,
    chunk_mb: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``render(rows, texts, symbols, covered)`` of each chunk: covered marks the symbols of strings that repeat."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = chunk_count(docs, text_col, chunk_mb)
    keys = even_keys(buckets, parts) if buckets <= CHOSEN else range(buckets)
    name = "_chunk"
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    number = F.pmod(F.xxhash64(id_col, text_col), F.lit(buckets)).cast("int")
    dealt = docs.withColumn(name, F.get(F.lit(keys), number) if buckets <= CHOSEN else number)

    def unique(symbols):
        key, at, first, last, doc = anchors(symbols, window, gram)
        distinct, where = np.unique(key, return_inverse=True)
        order = np.argsort(distinct % np.uint64(buckets), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return distinct[order], place[where], key, at, first, last, doc

    def tell_keys(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], _ROW, _KINDS)
        chunk = table.column(name)[0].as_py()
        _, ids, texts = ordered(table, id_col, text_col)
        distinct, place, _, _, _, _, doc = unique(kind(texts))
        # documents of each anchor: a pair of anchor and id counts once
        pairs = np.unique(place * np.int64(len(texts) + 1) + np.unique(ids, return_inverse=True)[1][doc]) // (len(texts) + 1) if len(place) else place
        seen = np.bincount(pairs, minlength=len(distinct))
        bucket = (distinct % np.uint64(buckets)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        short = (distinct // np.uint64(buckets)) & np.uint64(0xFFFFFFFFFFFF)
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            s = slice(edges[b], edges[b + 1])
            rows.append((chunk, keys[b], s.stop - s.start, short[s].view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + np.minimum(seen[s], 255).astype(np.uint8).tobytes()))
        return _table(rows, _ROW, _KINDS)

    def tell_shared(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        wide = np.zeros((int(sizes.sum()), 8), np.uint8)
        seen, at = np.empty(len(wide), np.int64), 0
        for n, data in zip(sizes, table.column("data")):
            data = data.as_py()
            wide[at : at + n, :6] = np.frombuffer(data, np.uint8, 6 * n).reshape(-1, 6)
            seen[at : at + n] = np.frombuffer(data, np.uint8, n, 6 * n)
            at += n
        short = wide.view(np.uint64).ravel()
        order = np.argsort(short, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], short[order][1:] != short[order][:-1]))) if len(order) else order
        total = np.add.reduceat(seen[order], first) if len(order) else seen
        level = np.empty(len(order), np.uint8)
        level[order] = np.repeat((total > 1).astype(np.uint8) + (total > hot), np.diff(np.append(first, len(order))))
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        rows = [(c, b, int(n), level[a:z].tobytes()) for c, b, n, a, z in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), sizes, cuts, cuts[1:])]
        return _table(rows, _ROW, _KINDS)

    def send_pieces(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], _ROW, _KINDS)
        chunk = table.column(name)[0].as_py()
        _, ids, texts = ordered(table, id_col, text_col)
        symbols = kind(texts)
        distinct, place, key, at, first, last, doc = unique(symbols)
        number = {k: b for b, k in enumerate(keys)} if buckets <= CHOSEN else keys
        level = b"".join(data for _, data in sorted((number[b], d.as_py()) for b, d in zip(told.column("bucket").to_pylist(), told.column("data"))))
        level = np.frombuffer(level, np.uint8)[place]
        mine = np.flatnonzero(level == 1)
        p, i, j, d, to = at[mine], first[mine], last[mine], doc[mine], (key[mine] % np.uint64(buckets)).astype(np.int64)
        like = place[mine]
        settled = None
        hot_runs = np.flatnonzero(level == 2)
        if len(hot_runs):
            # strings of hot anchors: what repeats within the chunk is resolved here, by the same method
            hp, hi, hj, hd = at[hot_runs], first[hot_runs], last[hot_runs], doc[hot_runs]
            local = Pieces.of(ids[hd], hp - hi, hj - hi + 1, [symbols.piece(x, y + window) for x, y in zip(hi.tolist(), hj.tolist())])
            gone = resolve(local, window)
            run, k = np.nonzero(np.arange(gone.shape[1]) < (hj - hi + 1)[:, None])
            here = np.asarray(gone[run, k])
            settled = hd[run[here]], (hi[run[here]] + k[here]) - symbols.starts[hd[run[here]]]
            run, k = run[~here], k[~here]
            x = hi[run] + k
            hashes = np.fromiter((zlib.crc32(symbols.piece(y, y + window)) for y in x.tolist()), np.int64, len(x))
            p, i, j, d, to, like = (np.concatenate(c) for c in zip((p, i, j, d, to, like), (hp[run], x, x, hd[run], hashes % buckets, hashes)))
        # by bucket, and runs of one anchor next to each other, which compresses what they share
        order = np.lexsort((i, like, to))
        p, i, j, d, to = (c[order] for c in (p, i, j, d, to))
        edges = np.searchsorted(to, np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            s = slice(edges[b], edges[b + 1])
            text = [symbols.piece(x, y + window) for x, y in zip(i[s].tolist(), j[s].tolist())]
            data = pack(a=ids[d[s]], b=d[s].astype(np.int32), c=(i[s] - symbols.starts[d[s]]).astype(np.int64), d=(p[s] - i[s]).astype(np.int32), e=(j[s] - i[s] + 1).astype(np.int32), f=np.array([len(t) for t in text], np.int32))
            # denser than the shuffle's own codec, and the largest part of what is shuffled
            rows.append((chunk, keys[b], len(text), zstandard.compress(data + b"".join(text), 1)))
        if settled is not None and len(settled[0]):
            d, x = settled
            rows.append((chunk, chunk, -len(d), pack(a=d.astype(np.int32), b=x.astype(np.int64), c=np.ones(len(d), np.int32))))
        return _table(rows, _ROW, _KINDS)

    def decide(table: pa.Table) -> pa.Table:
        kinds = ("i8", "i4", "i8", "i4", "i4", "i4")
        logs, text = [spill.Log(k) for k in kinds], spill.Log("u1")
        blobs, rows, bucket = [], [], table.column("bucket")[0].as_py() if table.num_rows else 0
        for c, n, data in zip(*(table.column(x) for x in ("chunk", "n", "data"))):
            n = n.as_py()
            if n < 0:
                rows.append((c.as_py(), bucket, -n, data.as_py()))
                continue
            *arrays, raw = unpack(zstandard.decompress(data.as_buffer()), n, *kinds)
            for log, x in zip(logs, arrays):
                log.add(x)
            text.add(np.frombuffer(raw, np.uint8))
            blobs.append((c.as_py(), n))
        ids, d, x, lead, count, size = (log.mapped() for log in logs)
        gone, a = resolve(Pieces(ids, lead, count, size, text.mapped()), window), 0
        for c, n in blobs:
            # the runs of strings that go, by their first and the one after their last
            part = np.zeros((n, gone.shape[1] + 2), np.int8)
            part[:, 1:-1] = gone[a : a + n]
            run, k = np.nonzero(np.diff(part, axis=1) > 0)
            until = np.nonzero(np.diff(part, axis=1) < 0)[1]
            if len(run):
                rows.append((c, bucket, len(run), pack(a=np.asarray(d[a + run]), b=np.asarray(x[a + run]) + k, c=(until - k).astype(np.int32))))
            a += n
        return _table(rows, _ROW, _KINDS)

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        table, _, texts = ordered(table, id_col, text_col)
        symbols = kind(texts)
        change = np.zeros(symbols.n + 1, np.int32)
        for n, data in zip(told.column("n").to_pylist(), told.column("data")):
            d, x, count, _ = unpack(data.as_py(), n, "i4", "i8", "i4")
            begin = symbols.starts[d] + x
            np.add.at(change, begin, 1)
            np.add.at(change, begin + count + window - 1, -1)
        return render(table.drop_columns([name]), texts, symbols, np.cumsum(change[:-1]) > 0)

    by_chunk = dealt.groupBy(name)
    told = by_chunk.applyInArrow(tell_keys, _SCHEMA).groupBy("bucket").applyInArrow(tell_shared, _SCHEMA)
    sent = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(send_pieces, _SCHEMA)
    gone = sent.groupBy("bucket").applyInArrow(decide, _SCHEMA)
    return by_chunk.cogroup(gone.groupBy("chunk")).applyInArrow(finish, schema)
