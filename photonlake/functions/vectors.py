"""Vectors as arrays. Sums are double; vectors of different lengths give null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    sums = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), sums)


def shorter_dot(a: Column, b: Column) -> Column:
    """Inner product over the first elements that both have."""
    n = F.least(F.size(a), F.size(b))
    return dot(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v at length 1; the zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 if either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).when(n == 0, F.lit(0.0))


def safe(v: Column, dim: int) -> Column:
    """v as floats if it has this many elements and none is null, else null."""
    return F.when((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()), v.cast("array<float>"))


def rounded(x: Column, digits: int) -> Column:
    """x to some decimals, as C and SQL engines round: the product with the power of ten is rounded, halves away from zero. Spark's own rounding goes by a double's shortest digits."""
    return F.round(x * float(10**digits), 0) / float(10**digits)


def seconds(ts: Column) -> Column:
    """A time stamp to three decimals; null counts as 0."""
    return F.round(F.coalesce(ts.cast("double"), F.lit(0.0)), 3)


def midpoint(start: Column, end: Column) -> Column:
    """Middle of a scene; its start if it has no length."""
    return F.when(end <= start, start).otherwise((start + end) / 2)


def best_score(v: Column, queries: list[list[float]], stored: str = "plain") -> Column:
    """The highest inner product of v with any of a few query vectors of one size; null for a null vector, one of another size or one with a null element. stored: "plain", "unit" (v is
    taken at length 1) or "cosine" (the queries too, and 0 if either is zero). A batch of rows is one matrix product."""
    asked = np.array(queries, dtype=np.float64).T
    if stored == "cosine":
        lengths = np.linalg.norm(asked, axis=0)
        asked = np.divide(asked, lengths, out=np.zeros_like(asked), where=lengths > 0)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        fits = np.flatnonzero(sizes == len(asked))
        flat = lists.flatten()
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        rows = values.reshape(-1, len(asked)) if len(fits) == len(sizes) else values[starts[fits][:, None] + np.arange(len(asked))]
        whole = np.ones(len(fits), dtype=bool)
        if flat.null_count:
            holes = flat.is_null().to_numpy(zero_copy_only=False)
            whole = ~holes[starts[fits][:, None] + np.arange(len(asked))].any(axis=1)
        best = (rows @ asked).max(axis=1) if len(fits) else np.zeros(0)
        if stored != "plain" and len(fits):
            lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))
            best = np.divide(best, lengths, out=np.zeros_like(best), where=lengths > 0)
        out = np.zeros(len(sizes))
        out[fits] = np.where(whole, best, 0.0)
        valid = np.zeros(len(sizes), dtype=bool)
        valid[fits] = whole
        return pa.array(out, mask=~valid)

    return scored(v)
