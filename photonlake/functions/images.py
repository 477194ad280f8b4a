"""Perceptual hash of small grey images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, LOW = 32, 8


def cosine_basis(n: int = SIDE) -> np.ndarray:
    """Rows of the orthonormal cosine transform."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.sqrt(2 / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n))
    basis[0] /= np.sqrt(2)
    return basis


def phash_bits(image: np.ndarray) -> int:
    """64 bits of a 32 x 32 grey image: its 8 x 8 lowest frequencies against the median of those but the first."""
    basis = cosine_basis()[:LOW]
    low = (basis @ image.astype(float) @ basis.T).ravel()
    bits = low > np.median(low[1:])
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _phash(images: pd.Series) -> pd.Series:
    def one(x):
        if x is None or len(x) != SIDE * SIDE:
            return None
        h = phash_bits(np.asarray(x, dtype=float).reshape(SIDE, SIDE))
        return h - (h >> 63 << 64)

    return images.map(one).astype("Int64")


def phash(image: Column) -> Column:
    """Hash of an array of 1024 grey values, row by row; null for other sizes."""
    return _phash(image)
