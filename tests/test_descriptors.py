"""Keypoints matched and homographies found, against plain versions on planted motions, noise and strays."""

import math

import numpy as np
import pytest

from photonlake.operators import descriptors
from photonlake.operators.descriptors import Rules

H = np.array([[0.9, -0.3, 40.0], [0.25, 1.1, -12.0], [2e-4, -1e-4, 1.0]])


def moved(p):
    at = np.concatenate([p, np.ones((len(p), 1))], axis=1) @ H.T
    return at[:, :2] / at[:, 2:]


def plain_matches(a, b, ratio, most):
    good = []
    for i, x in enumerate(a):
        far = sorted((math.dist(x, y), j) for j, y in enumerate(b))
        if len(far) > 1 and far[0][0] < ratio * far[1][0]:
            good.append((far[0][0], i, far[0][1]))
    if len(good) > most:
        good = sorted(good, key=lambda g: g[:2])[:most]
    return [(i, j) for _, i, j in good]


@pytest.mark.parametrize("n,m,most", [(40, 50, 500), (40, 50, 7), (1200, 30, 500), (5, 1, 500), (0, 9, 500), (3, 0, 500)])
def test_ratio_matches_against_plain(n, m, most):
    rnd = np.random.default_rng(n + m)
    b = rnd.integers(0, 200, (m, 16)).astype(float)
    a = np.concatenate([b[rnd.integers(0, m, n // 2)] + rnd.normal(0, 12, (n // 2, 16)), rnd.integers(0, 200, (n - n // 2, 16))]) if m else rnd.random((n, 16))
    i, j = descriptors.ratio_matches(a, b, Rules(most=most))
    assert list(zip(i.tolist(), j.tolist())) == plain_matches(a, b, 0.75, most)


def test_equal_descriptors_don_t_match():
    b = np.array([[1.0, 2.0], [1.0, 2.0], [50.0, 0.0]])
    i, _ = descriptors.ratio_matches(np.array([[1.0, 2.0], [49.0, 0.0]]), b)
    assert i.tolist() == [1]


@pytest.mark.parametrize("strays", [0, 20, 90])
def test_planted_homography(strays):
    rnd = np.random.default_rng(strays)
    p = rnd.uniform(0, 600, (150, 2))
    q = moved(p)
    q[:strays] += rnd.uniform(60, 200, (strays, 2)) * rnd.choice([-1, 1], (strays, 2))
    found = descriptors.inliers(p, q)
    assert found == 150 - strays
    noisy = q + rnd.normal(0, 0.5, q.shape)
    assert 0.75 * (150 - strays) <= descriptors.inliers(p, noisy) <= 150 - strays + 3  # four noisy points carry some good matches out of reach
    assert descriptors.inliers(p, noisy) == descriptors.inliers(p, noisy)


def test_few_or_flat_matches():
    p = np.array([[0.0, 0], [1, 0], [0, 1], [1, 1], [5, 3]])
    assert [descriptors.inliers(p[:n], p[:n] + 3) for n in range(6)] == [0, 0, 0, 0, 4, 5]
    line = np.stack([np.arange(30.0), 2 * np.arange(30.0)], axis=1)
    assert descriptors.inliers(line, line) == 0
    assert descriptors.inliers(np.zeros((9, 2)), np.zeros((9, 2))) == 0


def image(points, descs):
    return [(float(x), float(y), [float(v) for v in d]) for (x, y), d in zip(points, descs)]


def test_pairs_of_a_table(spark):
    rnd = np.random.default_rng(7)
    p, d = rnd.uniform(0, 500, (60, 2)), rnd.normal(0, 100, (60, 32))
    q = moved(p)
    q[:10] += 150
    rows = [("a", image(p, d)), ("b", image(q, d + rnd.normal(0, 2, d.shape))), ("c", image(p, rnd.normal(0, 100, d.shape))), ("none", None), ("empty", []), ("other size", image(p, d[:, :5])), ("half", image(p, d)[:30] + [(None, 1.0, [1.0] * 32), (1.0, 1.0, None)])]
    features = spark.createDataFrame(rows, "file_name string, keypoints array<struct<x:double,y:double,descriptor:array<float>>>")
    pairs = spark.createDataFrame([("a", x, n) for n, x in enumerate(["b", "c", "none", "empty", "other size", "half", "gone"])] + [("none", "b", 0)], "file_name string, candidate string, n int")
    out = descriptors.matched(pairs, features)
    got = {(r.file_name, r.candidate): (r.keypoints_a, r.keypoints_b, r.good, r.inliers, r.ok) for r in out.collect()}
    assert got["a", "b"] == (60, 60, 60, 50, True)
    assert got["a", "half"] == (60, 30, 30, 30, True)
    assert got["a", "none"][1:] == (0, 0, 0, False) and got["a", "empty"][1:] == (0, 0, 0, False) and got["a", "other size"] == (60, 60, 0, 0, False)
    assert got["none", "b"] == (0, 60, 0, 0, False) and ("a", "gone") not in got and not got["a", "c"][4]
    again = {(r.file_name, r.candidate): (r.keypoints_a, r.keypoints_b, r.good, r.inliers, r.ok) for r in descriptors.matched(pairs.repartition(5), features.repartition(3)).collect()}
    assert again == got
    best = descriptors.best_candidates(out).collect()
    assert [(r.file_name, r.candidate, r.inliers) for r in best] == [("a", "b", 50)]


def test_best_candidate_ties(spark):
    rows = [("a", "x", 0, 20, 30, 0.7, 0.5, True), ("a", "y", 1, 20, 25, 0.8, 0.6, True), ("a", "z", 2, 90, 95, 0.9, 0.9, False), ("b", "y", 1, 12, 13, 0.9, 0.2, True), ("b", "x", 0, 12, 13, 0.9, 0.2, True), ("c", "x", 0, 1, 1, 1.0, 1.0, False)]
    compared = spark.createDataFrame(rows, "file_name string, candidate string, n int, inliers int, good int, ratio double, score double, ok boolean")
    assert sorted((r.file_name, r.candidate) for r in descriptors.best_candidates(compared).collect()) == [("a", "y"), ("b", "x")]
