"""Alignment as expressions on one row: a source and a target as arrays of tokens, no shuffle and no Python.

``steps`` are the target's tokens that occur in the source, without neighbours that repeat; ``candidates`` are the source
positions of each, and all answers are folds over these short lists. Positions count from 0. Pass columns, not long
expressions: they are used more than once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTS = "array<int>"


def steps(src: Column, target: Column) -> Column:
    """Target tokens that the source has, and of neighbours left equal by that, the first."""
    there = F.filter(target, lambda x: F.array_contains(src, x))
    # only a token that comes twice can have itself before it; a list of the one list is how the rest shares it
    # a lambda sees one token at a time: the last kept one is carried along
    kept = lambda xs: F.aggregate(xs, F.slice(xs, 1, 0), lambda a, x: F.when(F.try_element_at(a, F.lit(-1)) == x, a).otherwise(F.array_append(a, x)))
    return F.get(F.transform(F.array(there), lambda xs: F.when(F.size(F.array_distinct(xs)) == F.size(xs), xs).otherwise(kept(xs))), 0)


def candidates(src: Column, q: Column) -> Column:
    """For each step the source positions of its token, ascending."""
    places = F.filter(F.sequence(F.lit(0), F.size(src) - 1), lambda i: F.array_contains(q, F.get(src, i)))
    # the places are worked out once: a list of the one list, whose element the steps share
    found = F.transform(F.array(places), lambda at: F.transform(q, lambda t: F.filter(at, lambda i: F.get(src, i) == t)))
    return F.when(F.size(q) > 0, F.get(found, 0)).otherwise(F.array().cast(f"array<{INTS}>"))


def _chain(cand: Column, pick, beyond, edge: int) -> Column:
    """Takes a position of each list in turn, each beyond the one before; null if a list has none left."""
    before = lambda a: F.when(F.size(a) == 0, F.lit(edge)).otherwise(F.try_element_at(a, F.lit(-1)))
    step = lambda a, x: F.array_append(a, pick(F.filter(x, lambda p: beyond(p, before(a)))))
    whole = lambda a: F.when(~F.exists(a, lambda p: p.isNull()), a)
    return F.when(F.size(cand) > 0, F.aggregate(cand, F.array().cast(INTS), step, whole))


def first_alignment(cand: Column) -> Column:
    """Positions of the greedy leftmost embedding, which is the first alignment in order; null if there is none."""
    return _chain(cand, F.array_min, lambda p, b: p > b, -1)


def last_alignment(cand: Column) -> Column:
    """Positions of the greedy rightmost embedding; null if there is none."""
    return F.reverse(_chain(F.reverse(cand), F.array_max, lambda p, b: p < b, 2**31 - 1))


def count_alignments(cand: Column) -> Column:
    """How many alignments there are: chains that end at each position, summed step by step; none is listed.
    Exact up to 38 digits, then null."""
    kind = "decimal(38,0)"
    total = lambda ends: F.aggregate(ends, F.lit(0).cast(kind), lambda n, e: F.try_add(n, e["n"]).cast(kind))
    start = F.array(F.struct(F.lit(-1).alias("p"), F.lit(1).cast(kind).alias("n")))
    grow = lambda ends, x: F.transform(x, lambda p: F.struct(p.alias("p"), total(F.filter(ends, lambda e: e["p"] < p)).alias("n")))
    return F.when(F.size(cand) > 0, F.aggregate(cand, start, grow, total)).otherwise(F.lit(0).cast(kind))


def start_positions(cand: Column, last: Column) -> Column:
    """Positions at which some alignment starts: those of the first step up to where the rightmost embedding starts."""
    return F.when(last.isNull(), F.array().cast(INTS)).otherwise(F.filter(F.get(cand, 0), lambda p: p <= F.get(last, 0)))


def all_alignments(cand: Column, first: Column, last: Column) -> Column:
    """Every alignment as an array of positions, in order. Only positions between the neighbours in the leftmost and the
    rightmost embedding are tried, so no path is begun that cannot be finished and the work is in proportion to the result."""
    empty = F.array(F.array().cast(INTS))

    def step(state: Column, x: Column) -> Column:
        i = F.size(F.get(state, 0))
        after = F.when(i == 0, F.lit(-1)).otherwise(F.get(first, i - 1))
        before = F.coalesce(F.get(last, i + 1), F.lit(2**31 - 1))
        fits = lambda path, p: (p > after) & (p < before) & (p > F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit(-1)))
        return F.flatten(F.transform(state, lambda path: F.transform(F.filter(x, lambda p: fits(path, p)), lambda p: F.array_append(path, p))))

    return F.when(first.isNull(), F.array().cast(f"array<{INTS}>")).otherwise(F.aggregate(cand, empty, step))


def token_starts(src: Column, lead: Column, block: int = 128) -> Column:
    """Character at which each token starts; ``lead`` is 1 if the normalised text starts with a space, else 0.

    Sums run within blocks and over them, as each step of a sum copies the array that it adds to."""
    sums = lambda xs, start, length: F.aggregate(xs, F.array(start.cast("int")), lambda a, x: F.array_append(a, F.try_element_at(a, F.lit(-1)) + length(x)))
    of_words = lambda ws, start: sums(ws, start, lambda w: F.length(w) + 1)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(src) - 1) / block).cast("int")), lambda b: of_words(F.slice(src, b * block + 1, block), F.lit(0)))

    def joined(parts: Column) -> Column:
        begins = sums(parts, lead, lambda p: F.try_element_at(p, F.lit(-1)))
        return F.flatten(F.zip_with(parts, F.slice(begins, 1, F.size(parts)), lambda p, at: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + at)))

    short = F.slice(of_words(src, lead), 1, F.size(src))
    return F.when(F.size(src) <= block, short).otherwise(F.get(F.transform(F.array(blocks), joined), 0))
