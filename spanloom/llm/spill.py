"""Arrays of a task that lie in files of Spark's scratch folder: only the pages in use are in memory.

The files have no name, so they go with the task, and a task that is lost with its executor starts again from its input.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np


def scratch_file():
    """An unlinked file where Spark itself spills; the system's folder outside of a task, as in tests."""
    where = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=where if where and os.path.isdir(where) else None)


def array(kind, *shape: int) -> np.ndarray:
    """Zeros of that kind and shape in a file, mapped."""
    size = math.prod(shape)
    if not size:
        return np.zeros(shape, kind)
    file = scratch_file()
    file.truncate(size * np.dtype(kind).itemsize)
    return np.memmap(file, kind, "r+", shape=shape)


def running_starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive parts of these sizes begins, in a file."""
    out = array(np.int64, len(sizes))
    total = 0
    for a in range(0, len(sizes), 1 << 16):
        part = np.cumsum(sizes[a : a + (1 << 16)], dtype=np.int64)
        out[a : a + len(part)] = total + part - sizes[a : a + len(part)]
        total += int(part[-1])
    return out


class Log:
    """Values appended to a file, then mapped as one array."""

    def __init__(self, kind):
        self.kind, self.n, self.file = np.dtype(kind), 0, scratch_file()

    def add(self, values) -> None:
        values = np.ascontiguousarray(values, self.kind)
        self.file.write(values.data if len(values) else b"")
        self.n += len(values)

    def mapped(self) -> np.ndarray:
        self.file.flush()
        return np.memmap(self.file, self.kind, "r+", shape=(self.n,)) if self.n else np.zeros(0, self.kind)


class SymbolQueues:
    """A priority queue of (symbol, item, shared) tuples by symbol, first in first out within one.

    Tuples come in blocks that are in order of symbol; blocks beyond ``limit`` bytes lie on disk. Of each block it is known where
    up to 256 ranges of symbols begin, so neighbouring ranges are read and merged together as far as ``size`` tuples allow;
    a larger range of several symbols goes through queues of its own.
    """

    def __init__(self, alphabet: int, limit: int):
        self.limit, self.held = limit, 0
        self.width = max(1, -(-alphabet // 256))
        self.bounds = np.arange(max(1, -(-alphabet // self.width)) + 1) * self.width
        self.blocks: list[tuple] = []
        self.file = None

    def push(self, symbol: np.ndarray, item: np.ndarray, shared: np.ndarray) -> None:
        edges = np.searchsorted(symbol, self.bounds)
        columns = symbol.astype(np.int32), item.astype(np.int64), shared.astype(np.int16)
        size = sum(c.nbytes for c in columns)
        if self.held + size <= self.limit:
            self.held += size
            self.blocks.append((edges, columns, None))
            return
        if self.file is None:
            self.file = scratch_file()
        at = [self.file.seek(0, 2)]
        for c in columns:
            self.file.write(c.data)
            at.append(self.file.tell())
        self.blocks.append((edges, None, at))

    def _read(self, block: tuple, r: int, q: int) -> tuple[np.ndarray, ...]:
        """The tuples of ranges r to q - 1 of a block."""
        edges, columns, at = block
        a, z = int(edges[r]), int(edges[q])
        if columns is not None:
            return tuple(c[a:z] for c in columns)
        out = []
        for begin, kind in zip(at, (np.int32, np.int64, np.int16)):
            width = np.dtype(kind).itemsize
            self.file.seek(begin + a * width)
            out.append(np.frombuffer(self.file.read((z - a) * width), kind))
        return tuple(out)

    def drain(self, size: int, apart: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """All (symbols, items, shared) blocks in order of symbol; with ``apart`` a block never spans two ranges."""
        counts = sum((np.diff(b[0]) for b in self.blocks), np.zeros(len(self.bounds) - 1, np.int64))
        ends = np.cumsum(counts)
        r = 0
        while r < len(counts):
            before = ends[r] - counts[r]
            q = r + 1 if apart else max(r + 1, int(np.searchsorted(ends, before + size, side="right")))
            n = int(ends[q - 1] - before)
            there = [b for b in self.blocks if b[0][q] > b[0][r]]
            if n <= size and there:
                columns = tuple(np.concatenate(c) for c in zip(*(self._read(b, r, q) for b in there)))
                if len(there) > 1 and self.width * (q - r) > 1:
                    order = np.argsort(columns[0], kind="stable")
                    columns = tuple(c[order] for c in columns)
                yield columns
            elif self.width > 1 and there:
                inner = SymbolQueues(self.width, self.limit)
                for b in there:
                    symbol, item, shared = self._read(b, r, q)
                    inner.push(symbol - r * self.width, item, shared)
                for symbol, item, shared in inner.drain(size):
                    yield symbol + r * self.width, item, shared
            else:
                held, k = [], 0
                for b in there:
                    held.append(self._read(b, r, q))
                    k += len(held[-1][0])
                    if k >= size:
                        yield tuple(np.concatenate(c) for c in zip(*held))
                        held, k = [], 0
                if held:
                    yield tuple(np.concatenate(c) for c in zip(*held))
            r = q
