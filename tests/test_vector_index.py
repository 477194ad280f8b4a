"""The vector index against scans of all rows."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonlake.operators import search, tables, vector_index
from photonlake.plans.storage import shared_dir

DIM = 12


def frames(spark, n=900, seed=1, names="f"):
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(0, 1, (9, DIM))
    m = middles[rnd.integers(0, 9, n)] + rnd.normal(0, 0.35, (n, DIM))
    rows = [(i, f"{names}{i // 2}{'.mp4' if i % 6 == 0 else '.jpg'}", i % 6 == 0, float(i % 2), [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(n, "null.jpg", False, None, None), (n + 1, "short.jpg", False, 1.0, [1.0] * 3), (n + 2, "zero.jpg", False, 2.0, [0.0] * DIM), (n + 3, "hole.jpg", False, 0.0, [None] + [1.0] * (DIM - 1)), (n + 4, "inf.jpg", False, 0.0, [float("inf")] + [1.0] * (DIM - 1))]
    rows += [(n + 5 + i, f"same{i}.jpg", False, 0.0, [float(x) for x in m[3]]) for i in range(20)]
    return spark.createDataFrame(rows, "id long, file_name string, is_video boolean, timestamp_sec double, vector array<float>")


@pytest.fixture(scope="module")
def index(spark):
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    rows = frames(spark).withColumn("more", F.lit("x"))
    vector_index.build(rows, path, DIM)
    return rows, path


def brute(rows, queries, k):
    usable = [(r.id, np.array(r.vector, dtype=np.float32).astype(float)) for r in rows.collect() if r.vector is not None and len(r.vector) == DIM and all(x is not None and np.isfinite(x) for x in r.vector) and any(r.vector)]
    ids, m = np.array([i for i, _ in usable]), np.array([v / np.linalg.norm(v) for _, v in usable])
    out = {}
    for q, v in queries:
        s = np.round(m @ (np.array(v) / np.linalg.norm(v)), 5)
        out[q] = [(int(ids[i]), float(s[i])) for i in np.lexsort((ids, -s))[:k]]
    return out


def test_every_row_is_there_and_near_its_code(spark, index):
    rows, path = index
    made, cells, least = vector_index.opened(spark, path)
    assert made.count() == rows.count() and "more" in made.columns
    assert made.filter(F.col("cell") == vector_index.NO_CELL).count() == 5
    for r in made.filter(F.col("cell") != vector_index.NO_CELL).collect():
        v = np.array(r.vector, dtype=float)
        v /= np.linalg.norm(v)
        near = cells.centroids[r.cell] + np.frombuffer(r.code, dtype=np.int8) * cells.scale
        assert np.linalg.norm(v - near) <= r.off < 0.2
        assert v @ cells.centroids[r.cell] >= least[r.cell] - 1e-9


@pytest.mark.parametrize("least", [-1.0, 0.0, 0.3, 0.9, 0.999])
def test_threshold_search_equals_the_scan(spark, index, least):
    rows, path = index
    rnd = random.Random(least)
    queries = [[rnd.gauss(0, 1) for _ in range(DIM)] for _ in range(2)] + [[float(x) for x in rows.first().vector]]
    usable = rows.filter("file_name NOT IN ('null.jpg', 'short.jpg', 'zero.jpg', 'hole.jpg', 'inf.jpg')")
    odd = rows.filter("file_name IN ('null.jpg', 'short.jpg', 'zero.jpg', 'hole.jpg', 'inf.jpg')").select("file_name", "is_video", F.coalesce("timestamp_sec", F.lit(0.0)).alias("timestamp_sec"), F.lit(0.0).alias("score"))
    scan = search.search_any(usable, queries, least, "cosine").drop("rank")
    want = {tuple(r) for r in (scan.unionByName(odd) if least <= 0 else scan).collect()}
    got = vector_index.search_index(spark, path, queries, least).drop("rank").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert vector_index.search_index(spark, path, [], least).count() == 0


def test_cells_are_left_out(spark, index):
    rows, path = index
    _, cells, least = vector_index.opened(spark, path)
    asked = np.array([rows.first().vector], dtype=float)
    assert len(vector_index._reaching(asked / np.linalg.norm(asked), cells.centroids, least, 0.95)) < len(least) / 2


def test_fallback(spark, index):
    rows, path = index
    query = [float(x) for x in rows.first().vector]
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    scan = rows.filter("id < 900")
    assert same(vector_index.search_or_scan(spark, path, scan, query, 0.5), vector_index.search_index(spark, path, [query], 0.5))
    assert same(vector_index.search_or_scan(spark, path, scan, query, 0.5, video_only=True), search.search(scan, query, 0.5, video_only=True))
    assert same(vector_index.search_or_scan(spark, path, scan, query, 0.5, folder="f1"), search.search(scan, query, 0.5, folder="f1"))
    assert same(vector_index.search_or_scan(spark, None, scan, query, 0.5), search.search(scan, query, 0.5))
    assert same(vector_index.search_or_scan(spark, path, scan, query[:3], 0.5), search.search(scan, query[:3], 0.5))
    with pytest.raises(ValueError, match="dimensions"):
        vector_index.search_index(spark, path, [query[:3]])


def test_nearest_exact_and_recall(spark, index, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 30)
    rows, path = index
    made, cells, least = vector_index.opened(spark, path)
    asked = [(r.id, [float(x) for x in r.vector]) for r in rows.filter("id % 50 = 0 AND id < 900").collect()]
    queries = spark.createDataFrame([*asked, (-1, None), (-2, [0.0] * DIM)], "query long, vector array<float>")
    want = brute(rows, asked, 20)
    for probes, exact in ((1, True), (None, True), (len(cells.centroids), False)):
        got = {}
        for r in vector_index.nearest(made, cells, least, queries, 20, probes, exact).orderBy("query", "n").collect():
            got.setdefault(r.query, []).append((r.id, r.score))
        if exact:
            assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
        hit = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
        assert hit >= 0.99 and set(got) == set(want)
    found = vector_index.nearest(made, cells, least, queries, 20).collect()
    hit = np.mean([len({r.id for r in found if r.query == q} & {i for i, _ in want[q]}) / 20 for q in want])
    assert hit >= 0.9 and cells.probes < len(cells.centroids)


def test_refreshed_and_layout(spark, index):
    rows, path = index
    to = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    changed = rows.filter("id % 10 = 0").select("file_name")
    new = frames(spark, seed=5).withColumn("more", F.lit("y"))
    vector_index.refreshed(spark, path, new, changed, to)
    names = {r.file_name for r in changed.collect()}
    want = sorted((r.id, r.more) for df in (rows, new) for r in df.collect() if (r.file_name in names) == (r.more == "y"))
    made, cells, least = vector_index.opened(spark, to)
    assert sorted((r.id, r.more) for r in made.collect()) == want
    everything = made.filter("more = 'y' OR more = 'x'").select("id", "vector")
    asked = [(1, [1.0] * DIM)]
    got = vector_index.nearest(made, cells, least, spark.createDataFrame(asked, "query long, vector array<double>"), 5, exact=True).orderBy("n").collect()
    assert [r.id for r in got] == [i for i, _ in brute(everything, asked, 5)[1]]
    one, two = (tables.tables_sorted(vector_index.layout(spark, p, "clip")) for p in (path, to))
    assert tables.index_faults(one, two).count() == 0
    third = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    vector_index.build(rows, third, DIM, cells=3)
    assert [r.fault for r in tables.index_faults(one, tables.tables_sorted(vector_index.layout(spark, third, "clip"))).collect()] == ["types"]


def test_empty_index(spark):
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    vector_index.build(frames(spark).limit(0), path, DIM)
    made, cells, least = vector_index.opened(spark, path)
    assert vector_index.search_index(spark, path, [[1.0] * DIM], 0.0).count() == 0
    assert vector_index.nearest(made, cells, least, spark.createDataFrame([(1, [1.0] * DIM)], "query long, vector array<float>"), 5).count() == 0
