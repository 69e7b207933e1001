"""Exact top-k by inner product: tiled matrix products, selection per tile, tree merging.

Vectors and queries are packed into blobs, matrices of up to ``tile`` rows of one length. Blobs of vectors are dealt into shards
and each tile of queries is sent to every shard, so a task multiplies query tiles with the vector tiles of its shard and keeps
the k best of each query, ties to the smaller id. A shard returns k rows for each query, and these lists are merged in a tree,
``fan`` shards at a time. Nothing passes the driver but two counts, and nothing is broadcast: the work of a task is set by
the sizes of a shard and a tile, and the number of shards follows the vectors.

Components are integers, floor(1024 x), so products are exact: in double precision while the bound on the sum is below 2**53,
else in 64-bit integers, else in Python's. A score that does not fit 64 bits is reported as the nearest that does, but still
ranked by its exact value.

Vectors that are null or hold a null or non-finite component take no part, neither as candidates nor as queries. Only
vectors of the query's length are compared. Repeated rows are candidates of their own; rows with the query's id are not its
candidates, and of rows that repeat a query's id the least whole vector asks. No queries give no rows; rows without an id take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024.0
LOW, HIGH = -(2**63), 2**63 - 1
#: Digits of an exact score that does not fit 64 bits: components are below 2**138, so sums of 2**31 products have fewer.
DIGITS = 100


def whole_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Rows of floor(1024 x) as doubles; none for a row that takes no part."""
    lists = column.offsets.to_numpy()
    values = column.values
    with np.errstate(invalid="ignore"):
        x = np.floor(SCALE * values.to_numpy(zero_copy_only=False).astype(np.float64))
    good = np.isfinite(x)
    if values.null_count:
        good &= values.is_valid().to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~good)))
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return [x[a:z] if ok and bad[a] == bad[z] else None for a, z, ok in zip(lists[:-1], lists[1:], there)]


def products(tile: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer products, rows of the tile by queries; Python's integers where 64 bits may not do."""
    most = np.abs(tile).max(initial=0) * np.abs(queries).max(initial=0) * max(1, tile.shape[1])
    if most < 2**53:
        return (tile @ queries.T).astype(np.int64)
    if most < 2**63:
        return tile.astype(np.int64) @ queries.astype(np.int64).T
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
    return whole(tile) @ whole(queries).T


def wide(score: int) -> str | None:
    """A string by which scores at either end of 64 bits are ranked; none for those between."""
    if LOW < score < HIGH:
        return None
    return f"{score:0{DIGITS}d}" if score > 0 else f"{10**DIGITS + score:0{DIGITS}d}"


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.q, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(len(ids), LOW)
        self.exact: list[tuple[int, int, int]] = []

    def add(self, vec: np.ndarray, scores: np.ndarray) -> None:
        order = np.argsort(vec, kind="stable")
        vec, scores = vec[order], scores[order]
        own = vec[:, None] == self.ids[None]
        if scores.dtype == object:
            for q in range(len(self.ids)):
                mine = [(-s, v) for s, v, o in zip(scores[:, q], vec.tolist(), own[:, q]) if not o]
                self.exact += [(q, -s, v) for s, v in sorted(mine)[: self.k]]
            return
        limit = self.least
        if len(vec) > self.k:
            masked = np.where(own, LOW, scores) if own.any() else scores
            limit = np.maximum(limit, np.partition(masked, len(vec) - self.k, axis=0)[len(vec) - self.k])
        level = (scores == limit) & ~own
        take = ((scores > limit) & ~own) | (level & (np.cumsum(level, axis=0, dtype=np.int32) <= self.k))
        row, q = np.nonzero(take)
        q, score, vec = np.concatenate((self.q, q)), np.concatenate((self.score, scores[row, q])), np.concatenate((self.vec, vec[row]))
        # scores may be the least integer: order by the complement, which cannot overflow
        order = np.lexsort((vec, ~score, q))
        q, score, vec = q[order], score[order], vec[order]
        starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        keep = place < self.k
        self.q, self.score, self.vec = q[keep], score[keep], vec[keep]
        full = place[keep] == self.k - 1
        self.least[self.q[full]] = self.score[full]

    def rows(self, shard: int) -> pa.RecordBatch:
        q = np.concatenate((self.q, np.array([x[0] for x in self.exact], np.int64)))
        score = np.concatenate((self.score, np.array([min(max(x[1], LOW), HIGH) for x in self.exact], np.int64)))
        vec = np.concatenate((self.vec, np.array([x[2] for x in self.exact], np.int64)))
        strings = pa.array([None] * len(self.q) + [wide(x[1]) for x in self.exact], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(vec), pa.array(score), strings, pa.array(np.full(len(q), shard, np.int32))], names=["query_id", "vec_id", "score", "wide", "shard"])


def _blobs(rows: DataFrame, tile: int, base: int) -> DataFrame:
    """(dim, number, ids, data): matrices of up to ``tile`` rows of one length; ``number`` differs between those of a task."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() * base
        held: dict[int, list] = {}

        def blob(d):
            nonlocal number
            number += 1
            ids, vectors = zip(*held.pop(d))
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([number], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.array(vectors, "<f8").tobytes()], pa.binary())], names=["dim", "number", "ids", "data"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), whole_vectors(b.column(1))):
                if v is not None and i is not None:
                    held.setdefault(len(v), []).append((i, v))
                    if len(held[len(v)]) == tile:
                        yield blob(len(v))
        for d in list(held):
            yield blob(d)

    return rows.select("vec_id", "embedding").mapInArrow(run, "dim int, number bigint, ids binary, data binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, tile: int = 1024, shard_rows: int = 1 << 16, fan: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of ``vectors`` for each of ``queries``; both (vec_id, embedding)."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(min(parts, -(-vectors.count() // tile)), -(-vectors.count() // shard_rows), 1)
    valid = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = queries.where(F.col("vec_id").isNotNull() & valid).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # blobs of neighbouring numbers go to neighbouring shards, so shards are even
    right = _blobs(vectors.where("vec_id is not null"), tile, shards * 7919 + 1).withColumn("shard", F.pmod("number", F.lit(shards)).cast("int"))
    left = _blobs(asked, tile, 1 << 32).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumnsRenamed({"ids": "query_ids", "data": "query_data", "number": "query_tile"})
    met = left.hint("merge").join(right, ["shard", "dim"]).select("shard", "dim", "query_tile", "query_ids", "query_data", "ids", "data")

    def run(batches):
        best, now, matrix = None, None, None
        for b in batches:
            for shard, d, number, qi, qd, vi, vd in zip(*(c.to_pylist() for c in b.columns)):
                if now != (shard, number, d):
                    if best is not None:
                        yield best.rows(now[0])
                    ids = np.frombuffer(qi, "<i8")
                    best, now, matrix = Best(ids, k), (shard, number, d), np.frombuffer(qd, "<f8").reshape(len(ids), d)
                ids = np.frombuffer(vi, "<i8")
                best.add(ids, products(np.frombuffer(vd, "<f8").reshape(len(ids), d), matrix))
        if best is not None:
            yield best.rows(now[0])

    lists = met.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, wide string, shard int")
    order = [F.desc("score"), F.desc("wide"), F.asc("vec_id")]
    while shards > 1:
        shards = -(-shards // fan)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan).cast("int"))
        keep = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*order))
        lists = lists.withColumn("rank", keep).where(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
