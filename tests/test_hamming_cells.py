"""Hashes within a large distance against all pairs."""

import itertools

import numpy as np
import pytest

from photonlake.operators import hamming, hamming_cells


def clustered(n, seed, spread=14):
    rnd = np.random.default_rng(seed)
    middles = rnd.integers(0, 1 << 64, max(1, n // 12), dtype=np.uint64)
    out = set()
    while len(out) < n:
        h = int(middles[rnd.integers(0, len(middles))])
        for b in rnd.choice(64, rnd.integers(0, spread), replace=False):
            h ^= 1 << int(b)
        out.add(h - (h >> 63 << 64))
    return sorted(out)


def brute(one, two, most):
    return sorted((a, b, d) for a in one for b in two if (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= most)


@pytest.mark.parametrize("most", [7, 9, 12, 16, 20])
def test_chunks_miss_nothing(most):
    for n in (100, 10**6, 10**9):
        parts = hamming_cells.chunks(n, most)
        assert sum(p.radius + 1 for p in parts) >= most + 1
        assert all(0 <= p.radius and p.width <= hamming_cells.WIDEST for p in parts)
        assert all(a.shift + a.width <= b.shift for a, b in zip(parts, parts[1:]))


def test_flips():
    assert sorted(hamming_cells.flips(5, 2).tolist()) == [x for x in range(32) if x.bit_count() <= 2]
    assert hamming_cells.flips(0, 3).tolist() == [0] and len(hamming_cells.flips(3, 9)) == 8


@pytest.mark.parametrize("most,rows,asked,together", [(12, 1 << 16, 1 << 14, 1 << 21), (12, 40, 7, 5), (7, 40, 50, 64), (20, 60, 1 << 14, 1 << 10)])
def test_pairs_against_brute_force(spark, monkeypatch, most, rows, asked, together):
    for name, value in (("CELL_ROWS", rows), ("ASKED_ROWS", asked), ("TOGETHER", together)):
        monkeypatch.setattr(hamming_cells, name, value)
    one, two = clustered(300, 1), clustered(250, 1)[:150] + clustered(100, 2) + [0, -1, (1 << 63) - 1, -(1 << 63)]
    frame = lambda x: spark.createDataFrame([(h,) for h in x] + [(None,)] + [(x[0],)], "h long")
    left, right = frame(one), frame(sorted(set(two)))
    got = sorted(tuple(r) for r in hamming.hash_pairs(left, right, most).collect())
    assert got == brute(one, sorted(set(two)), most) and got
    got = sorted(tuple(r) for r in hamming.hash_pairs(left, left, most).collect())
    assert got == brute(one, one, most)


def test_one_cell_that_holds_most(spark, monkeypatch):
    """A third of the hashes and more agree on the upper bits of all chunks but few."""
    monkeypatch.setattr(hamming_cells, "CELL_ROWS", 32)
    hashes = [x | y << 40 for x, y in itertools.product(range(16), range(20))] + clustered(200, 4)
    one = spark.createDataFrame([(h,) for h in set(hashes)], "a long")
    got = sorted(tuple(r) for r in hamming_cells.near_pairs(one, one.withColumnRenamed("a", "b"), 12, True, len(set(hashes))).collect())
    assert got == brute(sorted(set(hashes)), sorted(set(hashes)), 12)


def test_few_pairs_are_compared(spark):
    """Shares of all pairs that are looked at, by chance alone: they fall with the number of hashes, as chunks get wider."""
    def share(n):
        hashes = np.unique(np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, n))
        one = spark.createDataFrame([(int(h),) for h in hashes], "a long")
        return hamming_cells.near_pairs(one, one.withColumnRenamed("a", "b"), 12, True, n, count=True).first().compared / (n * n / 2)

    assert 0 < share(20_000) < 0.1
    expected = lambda n: sum(hamming_cells._near(p.width, p.radius) / 2**p.width for p in hamming_cells.chunks(n, 12))
    assert abs(share(20_000) / expected(20_000) - 1) < 0.1  # equal values of a chunk meet from both sides
    assert expected(10**6) < 0.02 and expected(10**8) < 0.006


def test_empty(spark):
    none = spark.createDataFrame([], "h long")
    some = spark.createDataFrame([(5,)], "h long")
    assert hamming.hash_pairs(none, some, 12).count() == 0 and hamming.hash_pairs(none, none, 12).count() == 0
    assert [tuple(r) for r in hamming.hash_pairs(some, some, 12).collect()] == [(5, 5, 0)]
