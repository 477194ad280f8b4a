"""Perceptual hashes: 64 bits as 16 hex digits in tables and as signed longs in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64


def parse_hash(hex_: Column) -> Column:
    """Signed long of 16 hex digits (white space around them is fine), null for anything else."""
    digits = F.trim(hex_)
    return F.when(digits.rlike("^[0-9a-fA-F]{16}$"), F.conv(digits, 16, -10).cast("long"))


def normalized_hash(hex_: Column) -> Column:
    """16 lower-case hex digits, or null."""
    digits = F.lower(F.trim(hex_))
    return F.when(digits.rlike("^[0-9a-f]{16}$"), digits)


def hash_hex(value: Column) -> Column:
    """16 lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def similarity(bits_apart: Column) -> Column:
    """Percentage of equal bits."""
    return (BITS - bits_apart) * F.lit(100.0) / BITS


def rounded(percent: Column) -> Column:
    """Three decimals, exact halves to even."""
    return F.bround(percent.cast("double"), 3)


def most_apart(percent: float) -> int:
    """Bits by which hashes of at least this similarity may differ."""
    return math.floor((100.0 - min(100.0, max(0.0, percent))) * BITS / 100.0)


def majority(hashes: Column) -> Column:
    """Bitwise majority of an array of hashes as a signed long; a tie sets the bit, an empty array gives null."""
    present = F.filter(hashes, lambda h: h.isNotNull())

    def bit(n: int) -> Column:
        votes = F.aggregate(present, F.lit(0), lambda s, h: s + F.when(F.shiftrightunsigned(h, n).bitwiseAND(F.lit(1).cast("long")) == 1, 1).otherwise(-1))
        one = 1 << n
        return F.when(votes >= 0, F.lit(one - (1 << 64) if n == 63 else one).cast("long")).otherwise(F.lit(0).cast("long"))

    whole = bit(0)
    for n in range(1, BITS):
        whole = whole.bitwiseOR(bit(n))
    return F.when(F.size(present) > 0, whole)
