"""Language identification as a mixture: EM over n-gram likelihoods, the set of languages by penalised likelihood.

A language is a smoothed table of letter trigrams (hashed to ``BUCKETS``; other characters are the boundary). Each run of
letters of a document gets one log likelihood for each language, and expectation-maximisation over these runs estimates
the share of each language in the document. Sets of the k most likely languages are compared by their likelihood less half
the logarithm of the number of runs for each further language; where even all languages together gain less than one penalty,
one language is the answer and no set needs fitting. The prediction is the largest share of the chosen set, the score that share.

The tables are counted from about ``per_language`` labelled documents of each language (all, if it has fewer), those with
the smallest hash of the id, and their size is languages times ``BUCKETS``; every document is then judged on its whole text. Documents are
judged by themselves, so repeated rows get the same result. Null texts and texts without a letter are ``und`` with score 0,
and so is every text if no labelled document has a letter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrow import text_batches

BUCKETS = 1 << 15
ROUNDS = 10


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, the position of each run's first letter there, and the run's text."""
    joined = "\n".join(t.lower() for t in texts)
    sizes = np.array([len(t.lower()) + 1 for t in texts])
    codes = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    c = np.where(letter, codes, 0).astype(np.uint32)
    at = np.flatnonzero(letter)
    h = c[at - 1] * np.uint32(0x9E3779B1) + c[at] * np.uint32(0x85EBCA77) + c[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    runs = np.flatnonzero(~letter[at - 1])
    owner = np.searchsorted(np.cumsum(sizes), at[runs] - 1, side="right")
    return (h >> np.uint32(17)).astype(np.int64) & (BUCKETS - 1), runs, owner


def _em(e: np.ndarray, starts: np.ndarray, owner: np.ndarray, counts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after some rounds, and the log likelihood of each document under them."""
    for _ in range(rounds):
        r = share[owner] * e
        r /= r.sum(1, keepdims=True)
        share = np.add.reduceat(r, starts, axis=0) / counts[:, None]
    ll = np.add.reduceat(np.log((share[owner] * e).sum(1) + 1e-30), starts)
    return share, ll


def predict(texts: list[str], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its language (-1: no letter) and the score; ``tables`` is log p, BUCKETS x languages."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    grams, runs, owner = trigrams(texts)
    k = tables.shape[1]
    if not len(runs) or not k:
        return best, score
    ll = np.empty((len(runs), k), np.float32)
    for j in range(k):
        ll[:, j] = np.add.reduceat(tables[:, j][grams], runs)
    ll -= ll.max(1, keepdims=True)
    e = np.exp(np.maximum(ll, -60))
    docs, starts, counts = np.unique(owner, return_index=True, return_counts=True)
    local = np.repeat(np.arange(len(docs)), counts)
    share, full = _em(e, starts, local, counts, np.full((len(docs), k), 1 / k, np.float32), ROUNDS)
    alone = np.add.reduceat(np.maximum(ll, -60), starts, axis=0)
    penalty = 0.5 * np.log(np.maximum(counts, 2))
    pick, value = alone.argmax(1), np.ones(len(docs))
    top = alone.max(1).astype(np.float64)
    mixed = np.flatnonzero(full - penalty > top)
    if len(mixed) and k > 1:
        inside = np.flatnonzero(np.isin(local, mixed))
        sub_counts = counts[mixed]
        sub_starts = np.concatenate(([0], np.cumsum(sub_counts)[:-1]))
        sub_local = np.repeat(np.arange(len(mixed)), sub_counts)
        order = np.argsort(-share[mixed], axis=1, kind="stable")
        for size in range(2, k + 1):
            start = share[mixed].copy()
            np.put_along_axis(start, order[:, size:], 0, axis=1)
            start = (start + 1e-6 * (start > 0)) / (start + 1e-6 * (start > 0)).sum(1, keepdims=True)
            found, ll_set = _em(e[inside] + 1e-30, sub_starts, sub_local, sub_counts, start.astype(np.float32), ROUNDS)
            worth = ll_set - (size - 1) * penalty[mixed]
            better = worth > top[mixed]
            top[mixed[better]] = worth[better]
            pick[mixed[better]] = found[better].argmax(1)
            value[mixed[better]] = found[better].max(1)
    best[docs], score[docs] = pick, np.clip(value, 0, 1)
    return best, score


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, per_language: int = 1500) -> tuple[list[str], np.ndarray]:
    """The languages, in order, and their log tables from ``labelled`` (doc_id, text, lang)."""
    named = labelled.where("lang is not null and text is not null and doc_id is not null")
    # a share of each language by the hash of the id: no language's rows are ever gathered
    sizes = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, per_language / n)])
    rows = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for b in text_batches(batches):
            langs = np.array(b.column(1).to_pylist(), object)
            for lang in set(langs):
                grams = trigrams([t for t, x in zip(b.column(0).to_pylist(), langs) if x == lang])[0]
                seen[lang] = seen.get(lang, 0) + np.bincount(grams, minlength=BUCKETS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in counts})
    table = np.full((BUCKETS, len(langs)), 0.1)
    for r in counts:
        table[r["gram"], langs.index(r["lang"])] += r["n"]
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def identify(docs: DataFrame, langs: list[str], tables: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text)."""
    names = np.array([*langs, "und"], object)
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        for b in text_batches(batches, limit=1 << 20):
            best, score = predict(b.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    langs, tables = fit(docs.where(~held_out()))
    return identify(docs, langs, tables).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
