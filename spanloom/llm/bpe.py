"""Byte-level BPE with the tokenizers library over Arrow batches.

A table of ranks becomes a ``tokenizers`` BPE model: each token is written in the printable characters of the byte table and
each way to split a token into two known ones is a merge, in the order of the token's rank, so the lowest rank that can be
formed is merged first. Offsets are kept in bytes (running sums of the lengths of the tokens) and mapped to characters by
counting the bytes that begin one; a token that begins inside a character has the offset of that character. Decoding looks
up the bytes of each id and joins them before any text is made, so characters split over tokens come back whole.

A match of the pattern is encoded by itself, so each distinct match need be encoded once: texts of common characters are cut
by the same pattern here and their matches looked up, new ones are encoded together; other texts go to the library whole.

A null text is empty: no tokens, and the digests are those of no bytes. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrow import text_batches

#: Every version of Unicode classes the characters below this alike, so any engine cuts them the same way.
COMMON = re.compile("[^\x00-\u024f]")
#: Matches that a worker remembers; longer ones are encoded each time.
MEMORY, LONGEST = 400_000, 64


@lru_cache(maxsize=1)
def byte_table() -> list[str]:
    """The printable character of each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table, known = byte_table(), ranks(path)
    shown = {b: "".join(table[x] for x in b) for b in known}
    merges = []
    for token, _ in sorted(known.items(), key=lambda x: x[1]):
        ways = [(known[token[:i]], known[token[i:]], i) for i in range(1, len(token)) if token[:i] in known and token[i:] in known]
        merges += [(shown[token[:i]], shown[token[i:]]) for _, _, i in sorted(ways)]
    out = Tokenizer(models.BPE(vocab={shown[b]: r for b, r in known.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


@lru_cache(maxsize=4)
def id_bytes(path: str) -> list[bytes]:
    """The bytes of each id, through the reversed byte table; ids that no token has are empty."""
    back = {c: b for b, c in enumerate(byte_table())}
    vocab = tokenizer(path).get_vocab()
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for shown, i in vocab.items():
        out[i] = bytes(back[c] for c in shown)
    return out


@lru_cache(maxsize=4)
def id_lengths(path: str) -> np.ndarray:
    return np.array([len(b) for b in id_bytes(path)], np.int64)


@lru_cache(maxsize=4)
def _cutter(path: str):
    """A function that cuts a text into matches of the pattern, and the ids of matches met before."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall, {}


def encode(texts: list[str], path: str) -> list[list[int]]:
    cut, known = _cutter(path)
    if len(known) > MEMORY:
        known.clear()
    out: list = [None] * len(texts)
    cuts = [(k, cut(t)) for k, t in enumerate(texts) if t.isascii() or not COMMON.search(t)]
    new = list(set().union(*(c for _, c in cuts)).difference(known)) if cuts else []
    cut_here = {k for k, _ in cuts}
    whole = [k for k in range(len(texts)) if k not in cut_here]
    ids = [e.ids for e in tokenizer(path).encode_batch_fast(new + [texts[k] for k in whole], add_special_tokens=False)]
    known.update((w, array("I", x).tobytes()) for w, x in zip(new, ids))
    for k, c in cuts:
        out[k] = np.frombuffer(b"".join(map(known.__getitem__, c)), np.uint32).tolist()
    for k, x in zip(whole, ids[len(new) :]):
        out[k] = x
    for word in new:
        if len(word) > LONGEST:
            del known[word]
    return out


def decode(ids: list[int], path: str) -> bytes:
    table = id_bytes(path)
    return b"".join([table[i] for i in ids])


@lru_cache(maxsize=4)
def _decimals(path: str) -> list[str]:
    return list(map(str, range(len(id_bytes(path)))))


def char_offsets(data: bytes, ids: list[int], path: str) -> tuple[np.ndarray, int]:
    """The character in which each token begins, then the number of characters; and how many tokens begin inside one."""
    begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(id_lengths(path)[np.array(ids, np.int64)])))
    seen = np.concatenate(([0], np.cumsum(begins)))
    inside = np.zeros(len(at), bool)
    inside[:-1] = ~begins[at[:-1]]
    return seen[at] - inside, int(inside.sum())


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, starts array<int>): the ids of each text and the character in which each begins."""

    def run(batches):
        for b in text_batches(batches):
            texts = b.column(1).to_pylist()
            ids = encode(texts, path)
            starts = [char_offsets(t.encode(), x, path)[0][:-1] for t, x in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32()))], names=["doc_id", "ids", "starts"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, starts array<int>")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the bytes that decoding gives back, without the arrays themselves leaving a task."""

    def run(batches):
        for b in text_batches(batches):
            texts = b.column(1).to_pylist()
            out: list[list] = [[], [], [], [], []]
            decimals = _decimals(path)
            for text, ids in zip(texts, encode(texts, path)):
                back = decode(ids, path)
                starts, split = char_offsets(back, ids, path)
                for column, x in zip(out, (len(ids), hashlib.sha256(",".join(map(decimals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(back).hexdigest(), int(starts[-1]), split)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_characters", "n_split"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_characters bigint, n_split bigint")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
