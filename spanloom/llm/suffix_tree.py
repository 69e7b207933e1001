"""Substring removal by prefix-partitioned suffix trees over words.

A bucket (see ``repeats``) holds runs of words around shared anchors; a suffix starts at each word that starts a string of
``window`` words. Words are numbered exactly, by their bytes, and their numbers lie in a file. Suffixes are dealt by their first
word, and a prefix that still has more than ``group`` of them by the next, so prefixes are as long as it takes; neighbouring
prefixes share a group while that fits. Each group becomes one subtree in memory: its suffixes are sorted from the
prefix on, the words that neighbours share give the internal nodes from the deepest up, with their depth, their parent and the
range of suffixes below. Internal nodes at ``window`` words or deeper with suffixes of several documents are the repeats; below each,
suffixes of documents with a larger id than the least are removed. What is deeper than ``window`` words need not be told apart.

A prefix may reach ``window`` words and still have too many suffixes: these are all one node, which needs no tree, only
its least id. Groups are built one at a time, and all else lies in files of the task (see ``spill``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm import spill
from spanloom.llm.repeats import Pieces, Words, remove_repeats


def word_numbers(pieces: Pieces, slab: int) -> tuple[np.ndarray, int]:
    """A number for each word of the pieces, end to end, in a file; equal words have equal numbers. And how many there are.

    Only the words themselves, each once, are held in memory, and ``slab`` bytes of text."""
    log, known, a = spill.Log("i4"), {}, 0
    ends = pieces.begin
    while a < len(pieces.size):
        z = max(a + 1, int(np.searchsorted(ends, ends[a] + slab)))
        data = np.asarray(pieces.text[ends[a] : ends[z - 1] + pieces.size[z - 1]])
        space = np.flatnonzero(data == 32)  # each word ends in one
        offsets = np.concatenate(([0], space - np.arange(len(space))))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(space), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[data != 32].tobytes())])
        words = words.dictionary_encode()
        numbers = np.array([known.setdefault(w, len(known)) for w in words.dictionary.to_pylist()], np.int32)
        log.add(numbers[words.indices.to_numpy()])
        a = z
    return log.mapped(), len(known)


@dataclass
class Tree:
    """The internal nodes of a subtree, children before parents: the range of sorted suffixes below each, its depth in words,
    its parent among them (-1 for the topmost), and the least and largest id below."""

    lo: np.ndarray
    hi: np.ndarray
    depth: np.ndarray
    parent: np.ndarray
    least: np.ndarray
    most: np.ndarray


def build(ids: np.ndarray, shared: np.ndarray) -> Tree:
    """The internal nodes over sorted suffixes of which each shares ``shared`` words with the one before it (0 for the first)."""
    n = len(ids)
    # subtrees so far: first suffix, node (-1 for a leaf), least and largest id, and words shared with the subtree before
    lo, node, least, most, sep = np.arange(n), np.full(n, -1), ids, ids, shared
    made: list[tuple] = []
    parent: list[np.ndarray] = []
    count = 0
    for depth in np.unique(shared[1:])[::-1]:
        joined = sep == depth
        joined[0] = False
        head = np.flatnonzero(~joined)
        sizes = np.diff(np.append(head, len(joined)))
        grown = sizes > 1
        new = np.where(grown, count + np.cumsum(grown) - 1, node[head])
        ends = np.append(lo[head][1:], n)
        low, high = np.minimum.reduceat(least, head), np.maximum.reduceat(most, head)
        made.append((lo[head][grown], ends[grown], np.full(int(grown.sum()), depth), low[grown], high[grown]))
        child = np.repeat(grown, sizes) & (node >= 0)
        parent.append(np.stack((node[child], np.repeat(new, sizes)[child])))
        count += int(grown.sum())
        lo, node, least, most, sep = lo[head], new, low, high, sep[head]
    above = np.full(count, -1)
    for child, own in parent:
        above[child] = own
    a, z, depth, low, high = (np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in zip(*made)) if made else (np.zeros(0, np.int64),) * 5
    return Tree(a, z, depth, above, low, high)


def sorted_suffixes(words: np.ndarray, place: np.ndarray, depth: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``place``, which share ``depth`` words, by their words up to ``window``; and how many words each
    shares with the one before it."""
    n = len(place)
    order, shared = np.arange(n), np.full(n, window, np.int64)
    shared[:1] = 0
    live = np.arange(n)  # places in the order whose class has several suffixes yet
    first = np.zeros(n, bool)
    first[:1] = True
    at = depth
    while at < window and len(live):
        own = place[order[live]] + at
        one = words[own].astype(np.int64)
        two = words[own + 1].astype(np.int64) if at + 1 < window else np.zeros(len(own), np.int64)
        key, group = one << 32 | two, np.cumsum(first[live])
        by = np.lexsort((key, group))
        order[live], key, group = order[live][by], key[by], group[by]
        new = np.flatnonzero((key[1:] != key[:-1]) & (group[1:] == group[:-1])) + 1
        shared[live[new]] = at + ((key[new] ^ key[new - 1]) >> 32 == 0)
        first[live[new]] = True
        alone = first[live] & np.append(first[live][1:], True)
        live = live[~alone]
        at += 2
    return order, shared


def repeated(pieces: Pieces, window: int = 50, group: int = 1 << 16, limit: int = 8 << 20) -> np.ndarray:
    """Which strings of each run also start in a run with a smaller id."""
    n = len(pieces.ids)
    out = spill.array(bool, n, int(pieces.count.max(initial=0)))
    if not n:
        return out
    words, vocabulary = word_numbers(pieces, max(1 << 14, 16 * group))
    run_at, base = spill.running_starts(pieces.count + (window - 1)), spill.running_starts(pieces.count)

    def where(string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run of each string, and its place there."""
        run = np.searchsorted(base, string, side="right") - 1
        return run, string - base[run]

    def mark(string: np.ndarray) -> None:
        out[where(string)] = True

    def subtree(string: np.ndarray, depth: int) -> None:
        run, k = where(string)
        ids = np.asarray(pieces.ids[run])
        order, shared = sorted_suffixes(words, run_at[run] + k, depth, window)
        tree = build(ids[order], shared)
        deep = np.flatnonzero((tree.depth >= window) & (tree.least < tree.most))
        sizes = tree.hi[deep] - tree.lo[deep]
        below = np.arange(sizes.sum()) + np.repeat(tree.lo[deep] - (np.cumsum(sizes) - sizes), sizes)
        least = np.repeat(tree.least[deep], sizes)
        mark(string[order[below[ids[order[below]] > least]]])

    def visit(blocks: Iterator[np.ndarray], count: int, depth: int) -> None:
        """Builds the subtrees of suffixes that share ``depth`` words."""
        if count <= group:
            subtree(np.concatenate(list(blocks)), depth)
            return
        if depth == window:
            held, least = spill.Log("i8"), None
            for string in blocks:
                held.add(string)
                low = int(pieces.ids[where(string)[0]].min())
                least = low if least is None else min(least, low)
            strings = held.mapped()
            for a in range(0, len(strings), group):
                part = strings[a : a + group]
                mark(part[pieces.ids[where(part)[0]] > least])
            return
        queues = spill.SymbolQueues(vocabulary, limit)
        for string in blocks:
            run, k = where(string)
            word = words[run_at[run] + k + depth]
            order = np.argsort(word, kind="stable")
            queues.push(word[order], string[order], np.zeros(len(order), np.int16))
        held, room = [], 0
        for counted, part in _by_prefix(queues.drain(group), group):
            if counted > group:
                visit(part, counted, depth + 1)
                continue
            if room + counted > group:
                subtree(np.concatenate(held), depth)
                held, room = [], 0
            held += list(part)
            room += counted
        if held:
            subtree(np.concatenate(held), depth)

    total = int(pieces.count.sum())
    visit((np.arange(a, min(total, a + group)) for a in range(0, total, group)), total, 0)
    return out


def _by_prefix(blocks: Iterator, group: int) -> Iterator[tuple[int, list | Iterator]]:
    """(how many, blocks) of suffixes in order of their next word: whole words together, where they came in one block, and
    a word with more than ``group`` suffixes by itself, from a file."""
    held: list[np.ndarray] = []
    log, n, word = None, 0, None

    def add(string: np.ndarray) -> None:
        nonlocal log, n
        n += len(string)
        held.append(string)
        if n > group:
            log = log or spill.Log("i8")
            for x in held:
                log.add(x)
            held.clear()

    def ready():
        nonlocal held, log, n
        if log is None:
            out = n, held
        else:
            strings = log.mapped()
            out = n, (np.asarray(strings[a : a + group]) for a in range(0, n, group))
        held, log, n = [], None, 0
        return out

    for symbol, string, _ in blocks:
        if n and symbol[0] != word:
            yield ready()
        word = symbol[-1]
        if symbol[0] == word:
            add(string)
            continue
        a, z = np.searchsorted(symbol, symbol[0], side="right"), np.searchsorted(symbol, word)
        add(string[:a])
        yield ready()
        if z > a:
            yield int(z - a), [string[a:z]]
        add(string[z:])
    if n:
        yield ready()


def _digests(table: pa.Table, texts: list[bytes], symbols: Words, covered: np.ndarray) -> pa.Table:
    total = np.concatenate(([0], np.cumsum(covered)))
    n_removed = total[symbols.ends] - total[symbols.starts]
    digests = []
    for t, a, z, gone in zip(texts, symbols.starts, symbols.ends, n_removed):
        words = t.split()
        digests.append(hashlib.sha256(b" ".join(compress(words, (~covered[a:z]).tolist()) if gone else words)).hexdigest())
    return pa.table([table.column("doc_id"), pa.array(symbols.ends - symbols.starts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def word_digests(docs: DataFrame, window: int = 50, gram: int = 8, **options) -> DataFrame:
    """What is left of each document without the ``window``-word strings that start in a document with a smaller id too."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string"
    return remove_repeats(docs.select("doc_id", "text"), Words, repeated, _digests, schema, window, gram, **options)


def strip_repeats(docs: DataFrame, window: int = 50, gram: int = 8, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated words cut from the text, with the white space after each; other texts stay as they are."""

    def render(table: pa.Table, texts: list[bytes], symbols: Words, covered: np.ndarray) -> pa.Table:
        column = table.column(text_col).to_pylist()
        base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        for k, (a, z) in enumerate(zip(symbols.starts, symbols.ends)):
            if covered[a:z].any():
                at = symbols.word_at[a:z] - base[k]
                until = np.append(at[1:], len(texts[k]))
                left = texts[k][: at[0]] + b"".join(texts[k][i:j] for i, j in zip(at[~covered[a:z]], until[~covered[a:z]]))
                column[k] = left.decode("utf-8", "surrogatepass")
        return table.set_column(table.schema.get_field_index(text_col), text_col, pa.array(column, table.schema.field(text_col).type))

    return remove_repeats(docs, Words, repeated, render, docs.schema, window, gram, text_col=text_col, **options)


def op10_suffix_tree(spark, sf_dir: str) -> DataFrame:
    return word_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
