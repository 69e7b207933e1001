"""Substring removal by external induced sorting of suffixes.

A bucket (see ``repeats``) is a shard: runs of strings around shared anchors, whose text lies in a file. Its suffixes are sorted
by induction from a sample, the suffixes at the anchors, which equal strings have at equal places. The order of the suffixes
one symbol further left is induced from that: taken in order, each is put into the queue of the symbol before it, and the
queues read in order of symbol are the next order, since suffixes that begin alike keep the order of what follows. That
recurs, one symbol further left each time, until the first string of every run.

The sample is sorted by the same induction one level up: the text right of an anchor is cut into blocks of 8 symbols,
the blocks are named in their order, and a suffix of the sample is a short string of names; its order is induced from that
of the suffix one name shorter, down to the empty one.

With each tuple goes the length of the prefix that its suffix shares with the one before it. In the next order that is the
block's width more than the least of those passed since the last tuple of its symbol, and for the first of a symbol what the
symbol has in common with the one before it. Neighbours that share ``window`` symbols are equal strings, and those in a
document with a larger id than the least of their group are removed.

Nothing of a shard is held in memory as a whole: text, runs, names and marks lie in mapped files, tuples pass in blocks of ``size``,
and the queues move what is beyond ``limit`` bytes to disk. All of these files belong to the task (see ``spill``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm import spill
from spanloom.llm.repeats import Bytes, Pieces, remove_repeats

#: (run of strings, length of the prefix shared with the tuple before): one block of tuples.
Block = tuple[np.ndarray, np.ndarray]
#: Symbols of a block that is named.
NAMED = 8


def range_minimum(values: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The least of values[a:z] for each pair, from tables of the least of each power of two."""
    span = z - a
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(a), values.dtype)
    table, power = values, 0
    while True:
        at = np.flatnonzero(level == power)
        if len(at):
            out[at] = np.minimum(table[a[at]], table[z[at] - (1 << power)])
        power += 1
        if power > level.max(initial=0) or len(table) <= 1 << (power - 1):
            return out
        table = np.minimum(table[: -(1 << (power - 1))], table[1 << (power - 1) :])


def induce(blocks: Iterator[Block], symbol_of: Callable, alphabet: int, unit: int, common: Callable, size: int, limit: int, most: int) -> Iterator[Block]:
    """The blocks of the next order. ``symbol_of(runs)`` is the symbol before each suffix, -1 where a suffix is dropped;
    ``common(one, two)`` is how much two different symbols share, and ``unit`` what a whole one counts."""
    queues = spill.SymbolQueues(alphabet, limit)
    last = spill.array(np.int64, alphabet)  # for each symbol the place after its last tuple so far
    at_most = np.zeros(most + 1, np.int64)  # for each length the place after the last tuple that shares no more
    passed = 0
    for run, shared in blocks:
        symbol = symbol_of(run)
        order = np.argsort(symbol, kind="stable")
        order = order[np.searchsorted(symbol[order], 0) :]
        own = symbol[order]
        if len(own):
            head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            inner = np.ones(len(order), bool)
            inner[head] = False
            at = np.flatnonzero(inner)
            new = np.empty(len(order), np.int16)
            new[at] = range_minimum(shared, order[at - 1] + 1, order[at] + 1)
            before = last[own[head]]
            new[head] = np.minimum(np.minimum.accumulate(shared)[order[head]], np.searchsorted(at_most, before, side="right"))
            new = np.minimum(new + np.int16(unit), most).astype(np.int16)
            new[head[before == 0]] = -1  # the first of its symbol is compared with the symbol before when the queues are read
            last[own[head]] = passed + order[np.append(head[1:], len(order)) - 1] + 1
            queues.push(own, run[order], new)
        reach = np.searchsorted(np.minimum.accumulate(shared[::-1])[::-1], np.arange(most + 1), side="right")
        at_most = np.where(reach > 0, passed + reach, at_most)
        passed += len(run)
    before = None
    for symbol, run, shared in queues.drain(size):
        first = np.flatnonzero(shared < 0)
        if len(first):
            shared = shared.copy()
            shared[first] = common(np.where(first > 0, symbol[first - 1], symbol[first] if before is None else before), symbol[first])
            if before is None:
                shared[0] = 0
        before = symbol[-1]
        yield run, shared


def name_blocks(keys: np.ndarray, size: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the blocks of symbols, numbers in the blocks' order, and the block of each name.

    Blocks are dealt by their leading symbols until a share fits ``size``, and sorted there."""
    names, values = spill.array(np.int32, len(keys)), spill.Log("u8")

    def visit(parts: Iterator[np.ndarray], n: int, depth: int) -> None:
        if n <= size:
            at = np.concatenate(list(parts))
            found, where = np.unique(keys[at], return_inverse=True)
            names[at] = values.n + where
            values.add(found)
            return
        if depth == NAMED:  # one block, however often
            for at in parts:
                names[at] = values.n
            values.add(keys[at[:1]])
            return
        queues = spill.SymbolQueues(256, limit)
        counts = np.zeros(256, np.int64)
        for at in parts:
            symbol = (keys[at] >> np.uint64(56 - 8 * depth) & np.uint64(255)).astype(np.uint8)
            order = np.argsort(symbol, kind="stable")
            counts += np.bincount(symbol, minlength=256)
            queues.push(symbol[order], at[order], np.zeros(len(at), np.int16))
        ready = queues.drain(size, apart=True)
        for symbol in np.flatnonzero(counts):
            visit(_taken(ready, int(counts[symbol])), int(counts[symbol]), depth + 1)

    visit((np.arange(a, min(len(keys), a + size)) for a in range(0, len(keys), size)), len(keys), 0)
    return names, values.mapped()


def _taken(blocks: Iterator, n: int) -> Iterator[np.ndarray]:
    """The next ``n`` items; the blocks of one symbol never go on into the next."""
    while n:
        _, item, _ = next(blocks)
        n -= len(item)
        yield item


def anchor_order(pieces: Pieces, window: int, size: int, limit: int, most: int) -> Iterator[Block]:
    """Blocks of the suffixes at the anchors, by their next ``window`` symbols (none is below all)."""
    n, m = len(pieces.ids), -(-window // NAMED)
    keys = spill.array(np.uint64, m, n)
    slab = max(256, size >> 5)
    for a in range(0, n, slab):
        s = slice(a, a + slab)
        at = pieces.begin[s] + pieces.lead[s]
        place = at[:, None] + np.arange(m * NAMED)
        right = np.where(place < (pieces.begin[s] + pieces.size[s])[:, None], pieces.text[np.minimum(place, len(pieces.text) - 1)], 0)
        keys[:, s] = right.astype(np.uint8).view(">u8").T
    names, values = name_blocks(keys.reshape(-1), size, limit)
    names = names.reshape(m, n)

    def common(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        differ = (values[one] ^ values[two]).astype(">u8").view(np.uint8).reshape(-1, NAMED) != 0
        return np.where(differ.any(1), differ.argmax(1), NAMED)

    blocks: Iterator[Block] = ((np.arange(a, min(n, a + size)), np.zeros(min(n, a + size) - a, np.int16)) for a in range(0, n, size))
    for k in range(m - 1, -1, -1):
        blocks = induce(blocks, lambda run, k=k: names[k][run], len(values), NAMED, common, size, limit, most)
    return blocks


def repeated(pieces: Pieces, window: int = 50, size: int = 1 << 18, limit: int = 8 << 20) -> np.ndarray:
    """Which strings of each run also start in a run with a smaller id."""
    n = len(pieces.ids)
    out = spill.array(bool, n, int(pieces.count.max(initial=0)))
    if not n:
        return out
    most = -(-window // NAMED) * NAMED + window
    blocks = anchor_order(pieces, window, size, limit, most)
    nothing = lambda one, two: np.zeros(len(one), np.int16)
    for step in range(int(pieces.lead.max(initial=0)) + 1):
        if step:

            def before(run: np.ndarray, step=step) -> np.ndarray:
                """The symbol ``step`` left of the anchor, as a small integer that sorts by radix."""
                there = pieces.lead[run] >= step
                return np.where(there, pieces.text[np.maximum(pieces.begin[run] + pieces.lead[run] - step, 0)].astype(np.int16), np.int16(-1))

            blocks = induce(kept, before, 256, 1, nothing, size, limit, most)
        kept = _settle(blocks, step, pieces, window, out)
    for _ in kept:
        pass
    return out


def _settle(blocks: Iterator[Block], step: int, pieces: Pieces, window: int, out: np.ndarray) -> Iterator[Block]:
    """Passes blocks on and marks the strings that start ``step`` symbols left of their anchors.

    A group of equal strings may go over the ends of blocks: its tuples are held back until it ends."""
    open_run: list[np.ndarray] = []
    through = np.int16(32767)

    def close(run: np.ndarray, starts: np.ndarray) -> None:
        least = np.minimum.reduceat(pieces.ids[run], starts)
        gone = pieces.ids[run] > np.repeat(least, np.diff(np.append(starts, len(run))))
        out[run[gone], pieces.lead[run[gone]] - step] = True

    for run, shared in blocks:
        yield run, shared
        lead = pieces.lead[run]
        mine = np.flatnonzero((lead - pieces.count[run] < step) & (lead >= step))
        if not len(mine):
            through = min(through, shared.min(initial=32767))
            continue
        # the prefix shared with the string before: the least of all tuples between
        lows = np.minimum.reduceat(shared[: mine[-1] + 1], np.concatenate(([0], mine[:-1] + 1)))
        lows[0] = min(lows[0], through)
        through = shared[mine[-1] + 1 :].min(initial=32767)
        starts = np.flatnonzero(lows < window)
        mine = run[mine]
        if not len(starts):
            open_run.append(mine)
            continue
        head = np.concatenate([*open_run, mine[: starts[0]]])
        if len(head):
            close(head, np.zeros(1, np.int64))
        if starts[-1] > starts[0]:
            close(mine[starts[0] : starts[-1]], starts[:-1] - starts[0])
        open_run = [mine[starts[-1] :]]
    if open_run:
        close(np.concatenate(open_run), np.zeros(1, np.int64))


def _render(table: pa.Table, texts: list[bytes], symbols: Bytes, covered: np.ndarray) -> pa.Table:
    data = np.frombuffer(symbols.data, np.uint8)
    total = np.concatenate(([0], np.cumsum(covered)))
    n_removed = total[symbols.ends] - total[symbols.starts]
    rise = covered.copy()
    rise[1:] &= ~covered[:-1]
    rise[symbols.starts[symbols.starts < len(covered)]] |= covered[symbols.starts[symbols.starts < len(covered)]]
    risen = np.concatenate(([0], np.cumsum(rise)))
    digests = []
    for t, a, z, gone in zip(texts, symbols.starts, symbols.ends, n_removed):
        digests.append(hashlib.sha256(data[a:z][~covered[a:z]] if gone else t).hexdigest())
    n_bytes = symbols.ends - symbols.starts
    return pa.table([table.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, risen[symbols.ends] - risen[symbols.starts])), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def substring_digests(docs: DataFrame, window: int = 50, gram: int = 16, **options) -> DataFrame:
    """What is left of each document without the ``window``-byte strings that start in a document with a smaller id too."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return remove_repeats(docs.select("doc_id", "text"), Bytes, repeated, _render, schema, window, gram, **options)


def op1_suffix_array(spark, sf_dir: str) -> DataFrame:
    return substring_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
