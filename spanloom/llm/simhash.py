"""SimHash near-duplicates: pigeonhole blocks, one join on blocks, Hamming verification, distributed components.

A fingerprint of 64 bits is cut into ``blocks`` runs. Two fingerprints that differ in at most ``distance`` bits leave at
least ``blocks - distance`` runs untouched, so they share the key of at least one choice of that many runs. Every distinct
fingerprint is dealt out once for each choice; only the rows of one key meet, and only distinct fingerprints do, so a group
of exact copies is one row. Within a key the verified links are reduced to a spanning star at once: a key of m fingerprints
gives at most m - 1 rows, never all pairs. Components are found by alternating large-star and small-star joins.

Nulls, blanks and texts of no word have fingerprint zero and link like any other; a text of fewer words than a shingle is
one shingle. Repeated shingles count as often as they occur. An empty table gives an empty result; rows of one id stay
separate rows; columns other than the id and the text are not read. A component has the smallest id there is for its name,
so ties do not arise; null ids name a component only if it has no other.

``copies`` finds near duplicates by the similarity of their shingle sets. Fingerprints link most of them first; no bound on differing
bits reaches every pair of a given similarity, so an exact filter on shingles finds the rest.
"""

from __future__ import annotations

from itertools import combinations, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from spanloom.llm.arrow import batch_bytes, text_batches
from spanloom.tables import Scratch

BITS = 64
#: Words hashed at a time, so that a text of any length needs bounded memory.
SLAB = 1 << 16
#: A key with more fingerprints than this is split again by runs of its other bits.
CROWD = 2048
#: Of a shingle's texts, if there are more than this, only so many neighbours are compared before the rest.
MANY, NEIGHBOURS = 32, 4
#: One document in so many is looked at for frequent shingles; the texts of one that has over ``SPLIT`` by that count are dealt over several
#: tasks at first, and compared in tiles of two times ``TILE`` texts after.
SAMPLED, SPLIT, TILE = 64, 4096, 2048
#: Pairs handed on at a time, and the bytes of an Arrow batch while texts are compared in pairs.
BLOCK, BATCH = 1 << 17, 8 << 20


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of one text, signed; words are maximal runs without ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return int(np.uint64(xxh64_intdigest(b" ".join(words), 42)).astype(np.int64))
    ones, total = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for at in range(0, total, SLAB):
        part = words[at : at + SLAB + shingle - 1]
        hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(part[i:] for i in range(shingle)))), repeat(42)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row."""

    def run(batches):
        for b in text_batches(batches):
            fps = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


def block_masks(blocks: int, distance: int) -> list[int]:
    """One mask for each choice of ``blocks - distance`` of the runs that the 64 bits are cut into."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(runs, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member reachable from each of n nodes over the edges a - b."""
    out = np.arange(n)
    while len(a):
        low = np.minimum(out[a], out[b])
        before = out.copy()
        np.minimum.at(out, out[a], low)
        np.minimum.at(out, out[b], low)
        while (out[out] != out).any():
            out = out[out]
        if (out == before).all():
            break
    return out


def close_pairs(key: np.ndarray, fp: np.ndarray, distance: int, mask: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links between positions of one key, which are adjacent; enough of them to connect all that lie within ``distance``."""
    bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[bounds, len(key)])
    left, right = [], []
    end = np.repeat(bounds + sizes, sizes)
    small = np.repeat(sizes <= CROWD, sizes)
    live = np.flatnonzero(small & (np.arange(len(key)) + 1 < end))
    step = 1
    while len(live):
        near = np.bitwise_count(fp[live] ^ fp[live + step]) <= distance
        left.append(live[near])
        right.append(live[near] + step)
        step += 1
        live = live[live + step < end[live]]
    for at, size in zip(bounds[sizes > CROWD], sizes[sizes > CROWD]):
        for x, y in _crowd(fp[at : at + size], distance):
            left.append(x + at)
            right.append(y + at)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _crowd(fp: np.ndarray, distance: int):
    """Links within one large key: cut all bits into more runs and compare only where enough of these agree."""
    for mask in block_masks(2 * distance + 1, distance):
        part = fp & np.uint64(mask)
        order = np.argsort(part, kind="stable")
        part, own = part[order], fp[order]
        bounds = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for at, end in zip(bounds, np.r_[bounds[1:], len(part)]):
            if end - at < 2:
                continue
            todo = np.arange(at + 1, end)
            seen = np.array([at])
            while len(todo):  # what a found member reaches needs no further link
                pick, seen = seen[0], seen[1:]
                near = np.bitwise_count(own[todo] ^ own[pick]) <= distance
                if near.any():
                    yield np.full(near.sum(), order[pick]), order[todo[near]]
                seen, todo = np.r_[seen, todo[near]], todo[~near]
                if not len(seen) and len(todo):
                    seen, todo = todo[:1], todo[1:]


def links(distinct: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(fp, root): fingerprints that share a key and lie within ``distance`` of a chain to ``root``, a smaller one."""
    masks = block_masks(blocks, distance)

    def run(batches):
        kept: list = []

        def flush(table, fp):
            a, b = close_pairs(table, fp, distance)
            if not len(a):
                return None
            nodes, at = np.unique(np.r_[a, b], return_inverse=True)
            order = np.argsort(fp[nodes], kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            root = labels(len(nodes), rank[at[: len(a)]], rank[at[len(a) :]])
            mine = fp[nodes[order]]
            linked = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(mine[linked].view(np.int64)), pa.array(mine[root[linked]].view(np.int64))], names=["fp", "root"])

        rest_key, rest_fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column(0).to_numpy().astype(np.uint64)
            f = b.column(1).to_numpy().view(np.uint64)
            key = f & np.array(masks, np.uint64)[t]
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ t  # rows are sorted by table and masked bits; equal neighbours only
            key, f = np.r_[rest_key, key], np.r_[rest_fp, f]
            last = np.flatnonzero(key != key[-1])
            cut = last[-1] + 1 if len(last) else 0
            if cut and (out := flush(key[:cut], f[:cut])) is not None:
                yield out
            rest_key, rest_fp = key[cut:], f[cut:]
        if len(rest_key) and (out := flush(rest_key, rest_fp)) is not None:
            yield out

    dealt = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")) for m in masks])).alias("t", "key"))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(parts, "t", "key").sortWithinPartitions("t", "key", "fp").select("t", "fp")
    return met.mapInArrow(run, "fp bigint, root bigint")


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of the component of every node that has an edge; edges are (a, b) of one type."""
    stars = scratch.keep(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "stars0")
    state = None
    for turn in count(1):  # until nothing changes; a chain of n nodes takes about log2(n) turns
        # large-star: every larger neighbour of a node is hung on the smallest neighbour
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # the least of each node is written before the join: a side with an exchange of its own lets Spark split a hub
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = scratch.keep(large, "large")
        # small-star: the smaller neighbours of a node and the node itself are hung on the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(low.select("hi", F.col("m").alias("lo"))).distinct()
        name = f"stars{turn}"
        stars = scratch.keep(small, name)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        scratch.drop(f"stars{turn - 1}", "least", "large")
        if now == state:
            break
        state = now
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def blocks_for(n: int, distance: int, load: int = 16) -> int:
    """Runs to cut fingerprints into, so that of ``n`` spread ones at most ``load`` are expected under one key.

    More runs make longer keys, of ``blocks - distance`` runs each, and more of them."""
    blocks = distance + 2
    while blocks < 2 * distance + 3 and n > load << BITS * (blocks - distance) // blocks:
        blocks += 1
    return blocks


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id): the component is named by its smallest doc_id.

    ``blocks`` follows the number of distinct fingerprints unless it is given."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, shingle), "fps")
    blocks = blocks or blocks_for(fps.select("fp").distinct().count(), distance)
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    edges = links(fps.select("fp").distinct(), distance, blocks).withColumnsRenamed({"fp": "a", "root": "b"})
    roots = components(edges, scratch)
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = classes.select("fp", "root").join(first, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _pairs(t: dict[str, np.ndarray], percent: int, reach: int, block: int = BLOCK):
    """Places of the candidates, about ``block`` at a time, among rows that are sorted by key and size; rows over ``reach`` places apart are
    not compared.

    The lesser set must have the key among its first members that serve for larger ones (``meta`` is odd), and sizes must allow
    the similarity. Where rows have a ``root`` only those of different roots are compared, and where they have parities
    ``w0`` to ``w3`` only those whose bits allow it: sets of together n members whose similarity reaches the bound differ
    in at most n (100 - percent) / (100 + percent) members, so their parities cannot differ in more bits. Rows with the same ``side``,
    if that is not negative, are compared elsewhere.
    """
    key, size = t["key"], t["meta"].astype(np.int64) >> 1
    root, side, parity = t.get("root"), t.get("side"), np.stack([t[f"w{k}"].view(np.uint64) for k in range(4)], 1) if "w0" in t else None
    bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    end = np.repeat(np.append(bounds[1:], len(key)), np.diff(np.append(bounds, len(key))))
    left, right, held, step = [], [], 0, 1
    live = np.flatnonzero((t["meta"] & 1 == 1) & (np.arange(len(key)) + 1 < end))
    while len(live) and step <= reach:
        live = live[size[live + step] * percent <= 100 * size[live]]
        for part in np.array_split(live, len(live) // block + 1):
            if root is not None:
                part = part[root[part] != root[part + step]]
            if side is not None:
                part = part[(side[part] != side[part + step]) | (side[part] < 0)]
            if parity is not None:
                bits = np.bitwise_count(parity[part] ^ parity[part + step]).sum(1, dtype=np.int64)
                part = part[bits * (100 + percent) <= (size[part] + size[part + step]) * (100 - percent)]
            left.append(part)
            right.append(part + step)
            held += len(part)
            if held >= block:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
        step += 1
        live = live[live + step < end[live]]
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _whole_keys(batches):
    """Tables of the rows of whole keys, where the rows of a key follow each other."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        table = table if rest is None else pa.concat_tables([rest, table])
        key = table.column("key").to_numpy()
        last = np.flatnonzero(key != key[-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None:
        yield rest


def _hashes(text: str | None, shingle: int):
    """The hashes of a text's shingles, a slab at a time; a text of fewer words, or none, is one shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(parts) < shingle:
        yield np.array([xxh64_intdigest(b" ".join(parts), 42)], np.uint64)
        return
    for at in range(0, len(parts) - shingle + 1, SLAB):
        part = parts[at : at + SLAB + shingle - 1]
        yield np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(part[i:] for i in range(shingle)))), repeat(42)), np.uint64)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted."""
    return described(text, shingle)[0]


def described(text: str | None, shingle: int = 5) -> tuple[np.ndarray, int]:
    """The hashes of a text's distinct shingles, sorted, and the fingerprint of all of them."""
    sets, ones, total = [], np.zeros(BITS, np.int64), 0
    for h in _hashes(text, shingle):
        sets.append(np.unique(h))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        total += len(h)
    return sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets)), int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def similar(one: np.ndarray, two: np.ndarray, percent: int = 80) -> bool:
    """Whether two shingle sets have a Jaccard similarity of at least ``percent`` in a hundred."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    return (100 + percent) * both >= percent * (len(one) + len(two))


def remembered(make, limit: int = 16 << 20):
    """``make`` of a text, kept for the next time until texts and sets of about ``limit`` bytes are."""
    known, held = {}, 0

    def get(text: str) -> np.ndarray:
        nonlocal held
        if text not in known:
            if held > limit:
                known.clear()
                held = 0
            known[text] = make(text)
            held += len(text) + known[text].nbytes
        return known[text]

    return get


def verified(pairs: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs``, ids of (doc_id, text) ``rows``, whose texts are similar by their whole shingle sets."""

    def check(batches):
        sets = remembered(lambda text: shingle_set(text, shingle))
        for x in batches:
            ok = [similar(sets(one), sets(two), percent) for one, two in ((p.as_py(), q.as_py()) for p, q in zip(x.column(2), x.column(3)))]
            yield x.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    ids = F.col("doc_id").cast("bigint")
    both = pairs.join(rows.select(ids.alias("a"), F.col("text").alias("one")), "a").join(rows.select(ids.alias("b"), F.col("text").alias("two")), "b")
    return both.select("a", "b", "one", "two").mapInArrow(check, "a bigint, b bigint")


def common_shingles(rows: DataFrame, shingle: int, part: int = SAMPLED, least: int = 3, most: int = 200000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that are most frequent in one of ``part`` documents, and how many of these have each.

    They only say in which order shingles are taken and over how many tasks the texts of one are dealt. Any order and any number give the
    same links; an order that takes rare shingles first has few candidates.
    """

    def run(batches):
        for b in text_batches(batches):
            sets = [shingle_set(t, shingle) for t in b.column(0).to_pylist()]
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0).select("text").mapInArrow(run, "h bigint, n bigint")
    top = some.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = top.column("h").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def seen(members: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the documents looked at have each shingle; 0 for those that are not ``common``."""
    if not len(common[0]):
        return np.zeros(len(members), np.int64)
    at = np.minimum(np.searchsorted(common[0], members), len(common[0]) - 1)
    return np.where(common[0][at] == members, common[1][at], 0)


def prefix(members: np.ndarray, common: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, int]:
    """The members of a set of which it shares one with every larger similar set, and how many serve for larger sets alone.

    With o members shared, the first of them in a common order has o - 1 behind it. Of a set of n members
    o is at least n percent / 100, and against a set that is not smaller 2 n percent / (100 + percent).
    """
    n = len(members)
    if len(common[0]):
        members = members[np.lexsort((members, seen(members, common)))]
    return members[: n + (-percent * n // 100) + 1], n + (-2 * percent * n // (100 + percent)) + 1


PARITY = ["w0", "w1", "w2", "w3"]


def describe(rows: DataFrame, shingle: int, percent: int, split: int = SPLIT) -> DataFrame:
    """(doc_id, fp, sim, size, leads, w0 .. w3, parity, keys, salts) of (doc_id, text) rows: the digest of the shingle set, its fingerprint, the
    number of shingles, how many of the keys serve for larger sets, the parities of 256 classes of shingles and of more classes
    than there are shingles, the first members, and for those that over ``split`` texts seem to have a number from 1 on, else 0."""
    common = common_shingles(rows, shingle)

    def parities(x: np.ndarray) -> np.ndarray:
        """The parity of the number of members in each class of equal low bits, in bytes; a power of two of them."""
        classes = max(256, 1 << (3 * len(x) // 2).bit_length())
        return np.packbits(np.bincount((x & np.uint64(classes - 1)).view(np.int64), minlength=classes).astype(np.uint8) & 1, bitorder="little")

    def run(batches):
        for b in text_batches(batches):
            found = [described(t, shingle) for t in b.column(1).to_pylist()]
            sets = [x for x, _ in found]
            firsts = [prefix(x, common, percent) for x in sets]
            wide = [parities(x) for x in sets]
            bits = np.stack([folded(x, 32).view(np.int64) for x in wide])
            ends = np.cumsum([0, *(len(f) for f, _ in firsts)])
            digests, keys = [xxh3_128_digest(x.tobytes()) for x in sets], np.concatenate([f for f, _ in firsts])
            spread = np.maximum(seen(keys, common) * SAMPLED // split, 1)
            lot = np.repeat([int.from_bytes(x[:4], "little") for x in digests], np.diff(ends))
            columns = [pa.array(digests, pa.binary()), pa.array([sim for _, sim in found], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([n for _, n in firsts], pa.int32())]
            columns += [*(pa.array(bits[:, k]) for k in range(4)), pa.array([x.tobytes() for x in wide], pa.binary())]
            for x in (keys.view(np.int64), np.where(spread > 1, 1 + lot % spread, 0).astype(np.int32)):
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "fp", "sim", "size", "leads", *PARITY, "parity", "keys", "salts"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp binary, sim bigint, size int, leads int, w0 bigint, w1 bigint, w2 bigint, w3 bigint, parity binary, keys array<bigint>, salts array<int>")


def folded(parity: np.ndarray, size: int) -> np.ndarray:
    """Parities of as many classes as ``size`` bytes hold, from those of more."""
    return np.bitwise_xor.reduce(parity.reshape(-1, size), axis=0)


def sieved(pairs: DataFrame, fps: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sizes and parities allow the similarity, which is as far as anything but the texts can tell."""
    of = lambda c: fps.select(F.col("doc_id").cast("bigint").alias(c), F.col("size").alias("size_" + c), F.col("parity").alias("parity_" + c))

    def run(batches):
        for x in batches:
            ok = []
            for m, n, p, q in zip(*(x.column(k).to_pylist() for k in range(2, 6))):
                size = min(len(p), len(q))
                differ = folded(np.frombuffer(p, np.uint8), size) ^ folded(np.frombuffer(q, np.uint8), size)
                ok.append(int(np.bitwise_count(differ.view(np.uint64)).sum()) * (100 + percent) <= (m + n) * (100 - percent))
            yield x.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", "size_a", "size_b", "parity_a", "parity_b").mapInArrow(run, "a bigint, b bigint")


def fingerprint_links(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b) of documents whose fingerprints lie within ``distance``, enough of them to connect all such; by pigeonhole blocks."""
    own = fps.groupBy("sim", "fp").agg(F.min(F.col("doc_id").cast("bigint")).alias("node"))
    first = own.groupBy("sim").agg(F.min("node").alias("first"))
    close = links(fps.select(F.col("sim").alias("fp")).distinct(), distance, blocks_for(first.count(), distance))
    one, two = first.withColumnsRenamed({"sim": "fp", "first": "a"}), first.withColumnsRenamed({"sim": "root", "first": "b"})
    across = close.join(one, "fp").join(two, "root").select("a", "b")
    within = own.join(first, "sim").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return across.union(within).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def candidates(fps: DataFrame, percent: int) -> DataFrame:
    """(a, b) candidates that share one of their first members, and, with b null, (key, node as a, meta) of each row of a key that has
    over ``MANY`` of them or is dealt over several tasks, where only neighbours in a task are candidates yet. A row is dealt out with its
    size alone: 24 bytes."""

    names = ["a", "b", "key", "meta"]

    def compare(batches):
        for table in _whole_keys(batches):
            t = {c: table.column(c).to_numpy() for c in table.column_names}
            first = np.flatnonzero(np.concatenate(([True], t["key"][1:] != t["key"][:-1])))
            count = np.diff(np.append(first, len(t["key"])))
            crowded = np.repeat((count > MANY) | (t["salt"][first] > 0), count)
            for a, b in _pairs(t, percent, MANY):
                near = (~crowded[a] | (b - a <= NEIGHBOURS)) & (t["node"][a] != t["node"][b])
                a, b = t["node"][a[near]], t["node"][b[near]]
                none = (pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *none], names=names)
            rest = table.filter(pa.array(crowded))
            columns = [rest.column("node"), pa.nulls(len(rest), pa.int64()), rest.column("key"), rest.column("meta")]
            yield from pa.Table.from_arrays(columns, names=names).combine_chunks().to_batches(max_chunksize=1 << 16)

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").cast("bigint").alias("node"), "size", "leads", "keys", "salts")).alias("x")).select("x.*")
    dealt = sets.select("node", "size", "leads", F.posexplode(F.arrays_zip("keys", "salts")).alias("at", "x"))
    dealt = dealt.select(F.col("x.keys").alias("key"), F.col("x.salts").alias("salt"), "node", F.expr("2 * size + int(at < leads)").alias("meta"))
    return dealt.repartition(parts, "key", "salt").sortWithinPartitions("key", "meta", "node").mapInArrow(compare, "a bigint, b bigint, key bigint, meta int")


def tiles(rows: DataFrame, tile: int) -> DataFrame:
    """(key, node, ...) rows, of which ``n`` have their key, as rows of smaller keys with a ``side``. Any two rows of a key meet under just one.

    A key of n rows is cut into n / ``tile`` parts by a hash of the node, and each row goes to the pairs of its part with every one."""
    own, cut = F.pmod(F.xxhash64("node"), F.col("cut")), F.ceil(F.col("n") / tile)
    rows = rows.withColumn("cut", cut).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0L, cut - 1)")))
    name = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))
    return rows.withColumn("key", F.when(F.col("cut") > 1, name).otherwise(F.col("key"))).withColumn("side", side).drop("n", "cut", "own", "other")


def copies(docs: DataFrame, shingle: int = 5, percent: int = 80, distance: int = 3, split: int = SPLIT, tile: int = TILE) -> DataFrame:
    """(doc_id, component_id) of the documents that are not the smallest of their near-duplicate component.

    Texts are linked if their sets of shingles have a Jaccard similarity of at least ``percent`` in a hundred, and no such pair is
    left out. Fingerprints within ``distance`` bits, found by pigeonhole blocks, give most links at little cost. For the
    rest, in any order of all shingles two similar sets share one of their first members (``prefix``), and each distinct set is
    dealt out under these. Candidates pass bounds on size and parity, those between components that are not known to be one yet
    are compared, and the texts decide. Of a key with over ``MANY`` rows only neighbours are compared at first, and one with over ``split``
    is dealt over several tasks; once their links are known, all pairs that these leave in different components are compared, in tiles of
    at most two times ``tile`` rows on average, each a task's work.

    Rows without an id take no part and stay. A null text is empty; texts of fewer words than a shingle are one shingle, so empty ones
    are copies of each other. An empty table gives no rows; other columns are not read.
    """
    with batch_bytes(docs.sparkSession, BATCH):  # all that Python compares is written within
        return _copies(docs, shingle, percent, distance, split, tile)


def _copies(docs: DataFrame, shingle: int, percent: int, distance: int, split: int, tile: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "copies")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fps = scratch.keep(describe(rows, shingle, percent, split), "fps")
    node = F.col("doc_id").cast("bigint")
    met = scratch.keep(candidates(fps, percent), "met")
    pairs = scratch.keep(sieved(met.where("b is not null").select("a", "b").distinct(), fps, percent), "pairs")
    crowds = met.where("b is null").select("key", F.col("a").alias("node"), "meta")
    close = scratch.keep(fingerprint_links(fps, distance), "close")
    needed = pairs.select("a").union(pairs.select("b")).union(crowds.select("node")).union(close.select("a")).union(close.select("b")).distinct()
    texts = scratch.keep(rows.withColumn("a", node).join(needed, "a", "left_semi").select("doc_id", "text"), "texts")
    linked = scratch.keep(verified(close, texts, shingle, percent), "linked0")
    roots = scratch.keep(components(linked, scratch), "roots0")
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias("root_" + c))
    across = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    linked = scratch.keep(linked.union(verified(across, texts, shingle, percent)), "linked1")
    roots = scratch.keep(components(linked, scratch), "roots1")
    if not crowds.isEmpty():
        named = scratch.keep(crowds.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
        # most keys of a large group hold one component by now and have nothing left to compare
        mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
        apart = tiles(named.join(mixed, "key").join(fps.select(node.alias("node"), *PARITY), "node"), tile)

        def compare_rest(batches):
            for table in _whole_keys(batches):
                t = {c: table.column(c).to_numpy() for c in table.column_names}
                for a, b in _pairs(t, percent, len(t["key"])):
                    a, b = t["node"][a], t["node"][b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        more = apart.repartition(parts, "key").sortWithinPartitions("key", "meta", "node").select("key", "node", "meta", *PARITY, "root", "side").mapInArrow(compare_rest, "a bigint, b bigint")
        more = verified(sieved(more.where("a <> b").distinct(), fps, percent), texts, shingle, percent)
        roots = components(linked.union(more), scratch)
    scratch.drop("met", "pairs", "close", "texts")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").cast("bigint").alias("node"), F.count("*").alias("n"))
    # only classes that lose a document, written so that the join has an exchange of its own on this side and can split a class
    classes = distinct.join(roots, "node", "left").where("n > 1 or root is not null").select("fp", F.coalesce("root", "node").alias("component_id"))
    classes = scratch.keep(classes, "classes")
    return fps.select("doc_id", "fp").join(classes, "fp").where("doc_id <> component_id").select("doc_id", "component_id")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the smallest id of each near-duplicate component; rows that repeat an id stay or go together."""
    return docs.join(copies(docs, **options).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
