"""Pairs of 64-bit hashes within a large Hamming distance, where blocks that must be equal select nothing.

The bits are cut into chunks, and each chunk gets a radius such that two hashes within the distance are within the radius in one chunk at least (the radii, plus one each, add up to the distance
plus one). For a chunk, hashes lie in cells by its upper bits. A hash goes into its own cell to be found, and asks in every cell whose upper bits are within the radius. In a cell, the
hashes are sorted by the lower bits, and a question tries all lower bits within what is left of the radius. What meets is counted bit by bit over all 64. A pair is made in the first chunk
that brings it together. Hashes are distinct, so a cell grows with the distinct hashes in it; large ones are dealt out by hash, and each part gets the cell's questions.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.plans.storage import kept

BITS = 64
#: Hashes of a cell that a task holds, and about as many cells are made; questions that it works through at a time, and pairs that it looks at together.
CELL_ROWS, ASKED_ROWS, TOGETHER = 1 << 16, 1 << 14, 1 << 21
#: Upper bits that make cells, at most, and bits of a chunk.
MOST_UPPER, WIDEST = 12, 22
#: What looking at a pair and what trying a value cost, for the choice of chunks.
PAIR, TRY = 1.0, 2.0


@dataclass(frozen=True)
class Chunk:
    shift: int
    width: int
    radius: int


def _near(width: int, radius: int) -> int:
    return sum(math.comb(width, i) for i in range(radius + 1))


def chunks(n: int, most: int) -> list[Chunk]:
    """The chunks and radii with which n hashes cost least."""
    best: tuple[float, list[Chunk]] | None = None
    for m in range(3, 17):
        edges = [round(i * BITS / m) for i in range(m + 1)]
        widths = [b - a for a, b in zip(edges, edges[1:])]
        if max(widths) > WIDEST:
            continue
        wider, rest = divmod(most + 1, m)
        parts = [Chunk(a, w, wider - 1 + (i < rest)) for i, (a, w) in enumerate(zip(edges, widths))]
        parts = [p for p in parts if p.radius >= 0]
        cost = sum(PAIR * n * n / 2 * _near(p.width, p.radius) / 2**p.width + TRY * n * _near(p.width, p.radius) for p in parts)
        if best is None or cost < best[0]:
            best = cost, parts
    return best[1]


def flips(width: int, most: int) -> np.ndarray:
    """All values of `width` bits with at most `most` set, by their number."""
    return np.array([sum(1 << b for b in bits) for k in range(min(most, width) + 1) for bits in itertools.combinations(range(width), k)], dtype=np.uint64)


class _Cell:
    """The hashes of a cell, sorted by a chunk's lower bits."""

    def __init__(self, hashes: np.ndarray, parts: list[Chunk], at: int, upper: int, most: int, same: bool):
        part = parts[at]
        self.part, self.before, self.most, self.same, self.lower = part, parts[:at], most, same, part.width - upper
        self.mask = np.uint64((1 << self.lower) - 1)
        low = (hashes >> np.uint64(part.shift)) & self.mask
        order = np.argsort(low, kind="stable")
        self.hashes = hashes[order]
        self.starts = np.searchsorted(low[order], np.arange((1 << self.lower) + 1, dtype=np.uint64))
        self.value = (int(hashes[0]) >> part.shift) & ((1 << part.width) - 1) if len(hashes) else 0
        self.compared = 0

    def pairs(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(asked hash, hash of the cell, distance) of the pairs that are this chunk's to make. Of a table with itself, each pair once."""
        own = (asked >> np.uint64(self.part.shift)) & np.uint64((1 << self.part.width) - 1)
        upper = np.bitwise_count((own ^ np.uint64(self.value)) >> np.uint64(self.lower)).astype(np.int64)
        for used in range(self.part.radius + 1):
            rows = np.flatnonzero(upper == used)
            if not len(rows):
                continue
            group, chunk = asked[rows], own[rows]
            for flip in flips(self.lower, self.part.radius - used):
                some = group
                low = chunk & self.mask
                if self.same and not used and flip:  # only from the smaller value of the chunk to the larger one
                    smaller = (chunk >> np.uint64(int(flip).bit_length() - 1)) & np.uint64(1) == 0
                    some, low = group[smaller], low[smaller]
                to = low ^ flip
                start = self.starts[to]
                counts = self.starts[to + np.uint64(1)] - start
                ends = np.cumsum(counts)
                for a, b in _runs(ends):
                    yield from self._checked(some[a:b], start[a:b], counts[a:b], bool(flip) or bool(used))

    def _checked(self, asked: np.ndarray, start: np.ndarray, counts: np.ndarray, ordered: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        total = int(counts.sum())
        if not total:
            return
        self.compared += total
        firsts = np.cumsum(counts) - counts
        other = self.hashes[np.arange(total) + np.repeat(start - firsts, counts)]
        mine = np.repeat(asked, counts)
        apart = mine ^ other
        d = np.bitwise_count(apart)
        stay = np.flatnonzero(d <= self.most)
        mine, other, apart, d = mine[stay], other[stay], apart[stay], d[stay]
        fine = np.ones(len(d), dtype=bool) if ordered or not self.same else mine < other
        for p in self.before:
            fine &= np.bitwise_count((apart >> np.uint64(p.shift)) & np.uint64((1 << p.width) - 1)) > p.radius
        if fine.any():
            yield mine[fine], other[fine], d[fine]


def _runs(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose counts (ends: their running sum) add up to TOGETHER at most, or of one row."""
    at, n = 0, len(ends)
    while at < n:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
        yield at, to
        at = to


def near_pairs(one: DataFrame, two: DataFrame, most: int, same: bool, n: int, count: bool = False) -> DataFrame:
    """(a, b, d) of a hash of one (column a) and one of two (column b) within the distance, each pair once; both have distinct longs, n at most. same: both are the same table; each pair then comes in
    both orders, and every hash with itself. count: instead, one row `compared`, of how many pairs were looked at."""
    parts = chunks(n, most)
    upper = max(0, min(MOST_UPPER, min(p.width for p in parts), round(math.log2(max(1, n / CELL_ROWS)))))
    tops = lambda h: [F.shiftrightunsigned(F.col(h), p.shift + p.width - upper).bitwiseAND(F.lit((1 << upper) - 1)).cast("int") for p in parts]
    placed = lambda rows, h: rows.select(F.col(h).alias("h"), F.posexplode(F.array(*tops(h))).alias("chunk", "top"))
    held = placed(two, "b")
    # A row for each cell: fewer than the chunks times 2 to the power of the upper bits.
    sizes = kept(held.groupBy("chunk", "top").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("blocks")), "cells")
    reach = F.array(*[F.array(*[F.lit(int(x)) for x in flips(upper, p.radius)]) for p in parts])
    asked = placed(one, "a").select("h", "chunk", F.col("top").alias("own"), F.explode(F.get(reach, F.col("chunk"))).alias("flip")).withColumn("top", F.col("own").bitwiseXOR(F.col("flip")))
    if same:
        asked = asked.filter("top >= own")
    asked = asked.join(F.broadcast(sizes), ["chunk", "top"]).select("chunk", "top", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "h")
    found = held.join(F.broadcast(sizes), ["chunk", "top"]).select("chunk", "top", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "h")
    dealt = found.unionByName(asked).repartition("chunk", "top", "block").sortWithinPartitions("chunk", "top", "block", "kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, cell, seen = None, [], None, 0

        def out(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
            if same:
                a, b, d = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((d, d))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(d.astype(np.int32))], names=["a", "b", "d"])

        for batch in batches:
            keys, kind, h = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1), batch.column(3).to_numpy(), batch.column(4).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1) | (kind[1:] != kind[:-1])))) if len(h) else []
            for a, b in zip(cuts, [*cuts[1:], len(h)]):
                key = tuple(keys[a].tolist())
                if key != now:
                    seen += cell.compared if cell else 0
                    now, rows, cell = key, [], None
                if kind[a] == 0:
                    rows.append(h[a:b])
                    continue
                if cell is None and rows:
                    cell = _Cell(np.concatenate(rows), parts, key[0], upper, most, same)
                if cell is None:
                    continue
                for at in range(a, b, ASKED_ROWS):
                    for pairs in cell.pairs(h[at : min(at + ASKED_ROWS, b)]):
                        if not count:
                            yield out(*pairs)
        seen += cell.compared if cell else 0
        if count:
            yield pa.RecordBatch.from_pydict({"compared": [seen]})

    if count:
        return dealt.mapInArrow(meet, "compared long").agg(F.sum("compared").alias("compared"))
    pairs = dealt.mapInArrow(meet, "a long, b long, d int")
    return pairs.unionByName(one.select("a", F.col("a").alias("b"), F.lit(0).alias("d"))) if same else pairs
