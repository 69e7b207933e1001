"""Packing token sequences: shortest-pack-first over the histogram of lengths, then a join by rank.

A document of n ids becomes n // size whole pieces, each a sequence of its own, and one rest. Only the rests are packed, and
they are packed as a histogram of at most ``size`` counts: lengths are placed longest first, each into the pack with the
fewest ids so far (the most room) that still takes it, and equal packs are one pattern with a count. A pattern's slot
for a length takes a run of that length's pieces by rank. Ranks come from one range shuffle of the small piece rows (never
the texts) and the counts of each range, so a length that a third of all pieces share is spread over many tasks.

A null or empty text has the closing id alone. Repeated rows are packed as rows of their own; rows that tie in length, id and
start may take each other's places, which leaves the set of sequences as it is. A null id is packed like any other. An empty
table gives no rows; columns other than the id and the text are not read, whatever their names. Strings of added tokens in a
text become those tokens, as in the plain library.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrow import text_batches, text_buffer
from spanloom.llm.bpe import ranks
from spanloom.tables import Scratch

#: Both libraries split characters below this alike, whatever version of Unicode they were built with.
COMMON = re.compile("[^\x00-ɏ]")
#: A run of bytes without a change between white space and other that is longer goes to the library whose merges use a heap.
RUN = 4096


@lru_cache(maxsize=2)
def _slow(json_path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@lru_cache(maxsize=2)
def _added(json_path: str) -> tuple[bytes, ...]:
    """The strings of the vocabulary's added tokens, which the library finds in a text before it cuts the rest."""
    return tuple(sorted({t.content.encode() for t in _slow(json_path).get_added_tokens_decoder().values()} - {b""}))


def _marked(data: np.ndarray, offsets: np.ndarray, strings: tuple[bytes, ...]) -> np.ndarray:
    """Which texts hold one of the strings; one that straddles two texts only marks a text too many."""
    out, raw = np.zeros(len(offsets) - 1, bool), data.tobytes()
    for s in strings:
        at = raw.find(s)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, side="right")) - 1
            out[k] = True
            at = raw.find(s, int(offsets[k + 1]))
    return out


@lru_cache(maxsize=2)
def _fast(rank_path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(rank_path), special_tokens={})


def encode_all(column: pa.Array, json_path: str, rank_path: str | None):
    """The ids of each text, as the ``tokenizers`` file gives them without a template. With ``rank_path``, the ranks of the
    same vocabulary, texts of common characters, no very long run and no added token's string take the faster of two
    libraries that agree on them."""
    texts = column.to_pylist()
    data, offsets = text_buffer(column)
    turns = np.flatnonzero(np.diff((data <= 32).astype(np.int8))) + 1 if len(data) else np.zeros(0, np.int64)
    edges = np.concatenate(([0], turns, [len(data)]))
    has_long = np.zeros(len(texts), bool)
    for k in np.flatnonzero(np.diff(edges) > RUN):  # the run may go on over the ends of texts
        a, z = np.searchsorted(offsets, (edges[k], edges[k + 1]), side="right")
        has_long[a - 1 : z] = True
    if rank_path:
        has_long |= _marked(data, offsets, _added(json_path))
    for text, other in zip(texts, has_long):
        if rank_path and not other and (text.isascii() or not COMMON.search(text)):
            yield np.asarray(_fast(rank_path).encode_to_numpy(text), "<u4")
        else:
            yield np.array(_slow(json_path).encode(text, add_special_tokens=False).ids, "<u4")


def pieces(docs: DataFrame, json_path: str, rank_path: str | None = None, size: int = 1024, close: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the ids of each text and ``close``, cut every ``size`` ids."""

    def run(batches):
        for b in text_batches(batches):
            rows: list[list] = [[], [], [], [], []]
            for k, ids in enumerate(encode_all(b.column(1), json_path, rank_path)):
                ids = np.append(ids, np.uint32(close)).astype("<u4")
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    for column, x in zip(rows, (k, at, len(part), zlib.crc32(part), len(ids))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0])), *(pa.array(c, pa.int64()) for c in rows[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) patterns that hold every length of the histogram as often as it occurs."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    rooms: list[int] = []  # heap of negated room: the shortest pack is on top

    def put(count: int, pack: tuple[int, ...]) -> None:
        room = size - sum(pack)
        if not by_room[room]:
            heapq.heappush(rooms, -room)
        by_room[room].append((count, pack))

    for length in sorted(histogram, reverse=True):
        todo, grown = histogram[length], []
        while todo:
            room = -rooms[0] if rooms else -1
            if room < length:
                # as many of this length as fit make a new pack; those packs are shortest once closed to it
                per = size // length
                whole, rest = divmod(todo, per)
                grown += [(whole, (length,) * per)] * (whole > 0) + [(1, (length,) * rest)] * (rest > 0)
                break
            count, pack = by_room[room].pop()
            if not by_room[room]:
                heapq.heappop(rooms)
            took = min(count, todo)
            if took < count:
                put(count - took, pack)
            todo -= took
            put(took, (*pack, length))
        for count, pack in grown:
            put(count, pack)
    return [x for room in sorted(by_room) for x in by_room[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> tuple[dict[int, np.ndarray], int]:
    """For each length, rows (first rank, first sequence, offset) in the order of rank; and the number of sequences."""
    out: dict[int, list] = defaultdict(list)
    ranks_used: dict[int, int] = defaultdict(int)
    first = 0
    for count, pack in patterns:
        offset = 0
        for length in pack:
            out[length].append((ranks_used[length], first, offset))
            ranks_used[length] += count
            offset += length
        first += count
    return {k: np.array(v, np.int64) for k, v in out.items()}, first


def pack(docs: DataFrame, json_path: str, rank_path: str | None = None, size: int = 1024, close: int = 0) -> DataFrame:
    """A row for each piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = scratch.keep(pieces(docs, json_path, rank_path, size, close), "pieces")

    def number(batches):
        """Ranks within a range, by length; ranges are sorted, so a batch continues the one before."""
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            if not b.num_rows:
                continue
            lengths = b.column(2).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], lengths[1:] != lengths[:-1])))
            rank = np.arange(len(lengths)) - np.repeat(starts, np.diff(np.append(starts, len(lengths))))
            if lengths[0] == last:
                rank[lengths == last] += seen
            last, seen = lengths[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(rank)], names=[*b.schema.names, "part", "rank"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartitionByRange(parts, "length", "doc_id", "start").sortWithinPartitions("length", "doc_id", "start")
    ranked = scratch.keep(ordered.mapInArrow(number, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, rank bigint"), "ranked")
    scratch.drop("pieces")
    # a range spans neighbouring lengths: at most ranges + size rows
    counts = sorted(ranked.groupBy("length", "part").count().collect())
    histogram: dict[int, int] = defaultdict(int)
    before = {}
    for length, part, n in counts:
        before[length, part] = histogram[length]
        histogram[length] += n
    table, _ = slots(shortest_pack_first(dict(histogram), size))

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lengths, part, rank = (b.column(i).to_numpy() for i in (2, 5, 6))
            seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            edges = np.concatenate(([0], np.flatnonzero((lengths[1:] != lengths[:-1]) | (part[1:] != part[:-1])) + 1, [len(lengths)]))
            for a, z in zip(edges[:-1], edges[1:]):
                r = rank[a:z] + before[int(lengths[a]), int(part[a])]
                own = table[int(lengths[a])]
                row = own[np.searchsorted(own[:, 0], r, side="right") - 1]
                seq[a:z], off[a:z] = row[:, 1] + r - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
