"""Pairs of images held against each other by their keypoints: descriptors matched by the ratio of the two nearest, then a homography that most matches agree on.

Keypoints with their descriptors are input: keypoints, an array of structs (x, y, descriptor). A pair is a row with both arrays, so pairs spread over tasks like any rows; what is computed of one
stays in its task. Chance in the search for a homography comes from the pair's own points, so a pair has the same figures wherever it is computed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonlake.operators.search import pair_metrics

#: Descriptors of one side that are compared with the other side at a time, and homographies that are tried at a time.
STRIP, TRIES = 512, 64


@dataclass(frozen=True)
class Rules:
    """ratio: how much nearer the nearest descriptor must be than the second one; most: matches kept, the nearest ones; reach: how far a match may be off the homography, in
    pixels; tries and sure: homographies tried at most, and how likely one of them is free of bad matches."""

    ratio: float = 0.75
    most: int = 500
    reach: float = 4.0
    tries: int = 1000
    sure: float = 0.995


def ratio_matches(a: np.ndarray, b: np.ndarray, rules: Rules = Rules()) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b that match: the nearest of b is nearer than ratio times the second nearest. At most `most`, the nearest ones first if there are more; else in the order of a."""
    if len(a) == 0 or len(b) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = a.astype(np.float64, copy=False), b.astype(np.float64, copy=False)
    squares = (b * b).sum(axis=1)
    near, first, second = [], [], []
    for at in range(0, len(a), STRIP):
        part = a[at : at + STRIP]
        far = np.maximum((part * part).sum(axis=1)[:, None] - 2.0 * (part @ b.T) + squares, 0.0)
        n = far.argmin(axis=1)
        rows = np.arange(len(part))
        # Sums of products lose the last digits of small distances, so the two nearest are taken again, difference by difference.
        far[rows, n] = np.inf
        m = far.argmin(axis=1)
        one, two = (np.sqrt(((part - b[x]) ** 2).sum(axis=1)) for x in (n, m))
        swap = two < one
        near.append(np.where(swap, m, n))
        first.append(np.where(swap, two, one))
        second.append(np.where(swap, one, two))
    n, one, two = (np.concatenate(x) for x in (near, first, second))
    good = np.flatnonzero(one < rules.ratio * two)
    if len(good) > rules.most:
        good = good[np.argsort(one[good], kind="stable")[: rules.most]]
    return good, n[good]


def _flat(p: np.ndarray) -> np.ndarray:
    """Whether any three of four points (tries x 4 x 2) lie on a line, or nearly."""
    flat = np.zeros(len(p), dtype=bool)
    for i, j, k in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)):
        u, v = p[:, j] - p[:, i], p[:, k] - p[:, i]
        flat |= np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) <= 1e-6 * (1.0 + np.abs(u).max(axis=1) * np.abs(v).max(axis=1))
    return flat


def _homographies(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The homographies that take four points to four others, for many fours at once (tries x 4 x 2 each)."""
    rows = np.zeros((len(p), 8, 8))
    x, y, u, v = p[..., 0], p[..., 1], q[..., 0], q[..., 1]
    one = np.ones_like(x)
    rows[:, 0::2, 0], rows[:, 0::2, 1], rows[:, 0::2, 2], rows[:, 0::2, 6], rows[:, 0::2, 7] = x, y, one, -u * x, -u * y
    rows[:, 1::2, 3], rows[:, 1::2, 4], rows[:, 1::2, 5], rows[:, 1::2, 6], rows[:, 1::2, 7] = x, y, one, -v * x, -v * y
    right = np.stack([u, v], axis=-1).reshape(len(p), 8, 1)
    fine = np.abs(np.linalg.det(rows)) > 1e-12
    solved = np.linalg.solve(rows[fine], right[fine])[..., 0]
    return np.concatenate([solved, np.ones((len(solved), 1))], axis=1).reshape(-1, 3, 3)


def inliers(p: np.ndarray, q: np.ndarray, rules: Rules = Rules()) -> int:
    """How many matches (points p to points q, n x 2) the best homography found agrees with. Below four there is none; four are taken to agree."""
    n = len(p)
    if n <= 4:
        return n if n == 4 else 0
    p, q = p.astype(np.float64), q.astype(np.float64)
    middle = lambda x: (x.mean(axis=0), max(x.std(), 1e-9))
    (pm, ps), (qm, qs) = middle(p), middle(q)
    a, b = (p - pm) / ps, (q - qm) / qs  # the systems are better solved around 0
    random = np.random.default_rng(zlib.crc32(p.tobytes() + q.tobytes()))
    best, done, wanted = 3, 0, rules.tries
    whole = np.concatenate([a, np.ones((n, 1))], axis=1).T
    while done < wanted:
        picks = random.random((TRIES, n)).argpartition(3, axis=1)[:, :4]
        done += TRIES
        usable = ~(_flat(a[picks]) | _flat(b[picks]))
        if not usable.any():
            continue
        found = _homographies(a[picks[usable]], b[picks[usable]])
        if not len(found):
            continue
        at = found @ whole
        with np.errstate(divide="ignore", invalid="ignore"):
            off = ((at[:, :2] / at[:, 2:] - b.T[None]) ** 2).sum(axis=1) * qs**2
        count = int((off <= rules.reach**2).sum(axis=1).max())
        if count > best:
            best = count
            clean = (count / n) ** 4
            wanted = min(rules.tries, math.ceil(math.log(1.0 - rules.sure) / math.log(1.0 - clean))) if clean < 1.0 else 0
    return best if best > 3 else 0


def figures(points_a: np.ndarray, a: np.ndarray, points_b: np.ndarray, b: np.ndarray, rules: Rules = Rules()) -> tuple[int, int]:
    """Good matches and inliers of two images' keypoints."""
    i, j = ratio_matches(a, b, rules)
    return len(i), inliers(points_a[i], points_b[j], rules)


def _keypoints(column: pa.ListArray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and descriptors of one row; keypoints without a place or descriptor, or with one of another size than the first, don't count."""
    value = column[row].values if column[row].is_valid else None
    if value is None or len(value) == 0:
        return np.zeros((0, 2)), np.zeros((0, 0))
    lists = value.field("descriptor")
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    x, y = (value.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    fine = np.flatnonzero(np.isfinite(x) & np.isfinite(y) & (sizes == (sizes[sizes > 0][0] if (sizes > 0).any() else 0)) & (sizes > 0))
    if not len(fine):
        return np.zeros((0, 2)), np.zeros((0, 0))
    size = sizes[fine[0]]
    values = lists.take(pa.array(fine)).flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.stack([x, y], axis=1)[fine], values


def matched(pairs: DataFrame, features: DataFrame, rules: Rules = Rules(), least: int = 10, least_ratio: float = 0.75) -> DataFrame:
    """pairs (file_name, candidate, ...) with keypoints_a, keypoints_b, good, inliers, ratio, score and ok. features: file_name, keypoints.

    Pairs with a file that has no row of features are left out; without keypoints on one side all figures are 0. A pair that is given twice is computed twice.
    """
    one = features.select("file_name", F.col("keypoints").alias("__a"))
    two = features.select(F.col("file_name").alias("candidate"), F.col("keypoints").alias("__b"))
    both = pairs.join(one, "file_name").join(two, "candidate").select(*pairs.columns, "__a", "__b")
    names = pairs.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(len(names) + k) for k in (0, 1))
            rows = []
            for r in range(batch.num_rows):
                (pa_, da), (pb, db) = _keypoints(a, r), _keypoints(b, r)
                good, agree = figures(pa_, da, pb, db, rules) if len(pa_) and len(pb) and da.shape[1] == db.shape[1] else (0, 0)
                rows.append((len(pa_), len(pb), good, agree))
            columns = [pa.array([x[k] for x in rows], pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *columns], names=[*names, "keypoints_a", "keypoints_b", "good", "inliers"])

    schema = both.select(*names).schema
    for name in ("keypoints_a", "keypoints_b", "good", "inliers"):
        schema = schema.add(name, "integer")
    return pair_metrics(both.mapInArrow(compare, schema), least, least_ratio)


def best_candidates(compared: DataFrame, order: str = "n") -> DataFrame:
    """The accepted candidate of each file with the most inliers, then the best score, then the first in the candidates' order: file_name, candidate, inliers, good, ratio, score.
    compared: matched pairs with a column that numbers a file's candidates. Files without an accepted candidate have no row."""
    best = Window.partitionBy("file_name").orderBy(F.col("inliers").desc(), F.col("score").desc(), order, "candidate")
    return compared.filter("ok").withColumn("__n", F.row_number().over(best)).filter("__n = 1").select("file_name", "candidate", "inliers", "good", "ratio", "score")
