"""Cases that earlier versions got wrong or did not end on."""

import math
import time
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from photonlake.functions import groups, labels
from photonlake.operators import duplicates, hamming, search, vector_index
from photonlake.plans import index_queries, scalar_queries, search_queries, source_queries, storage
from photonlake.plans.registry import SQL
from photonlake.streaming import sessions


def took(df) -> float:
    t = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - t


def test_hashes_by_stamp_of_many_frames(spark):
    """One array of 20,000 frames, two for each time."""
    x = F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.struct((F.floor(i / 2) / 7).alias("timestamp_sec"), F.lpad(F.hex(i.cast("long")), 16, "0").alias("phash_hex")))
    df = spark.range(1).select(groups.hashes_by_stamp(x).alias("m"))
    assert took(df) < 20
    m = df.first().m
    assert len(m) == 10_000 and m[0.143] == f"{3:016x}"


@pytest.mark.parametrize("n", [9856, 9857, 9846, 1046528, 1048575, (1 << 20) + 5243, 5 << 28, (1 << 52) + 12345, 7])
def test_size_label_as_sql(spark, n):
    sql = "SELECT label FROM (" + SQL["scl18_size_label"].replace("FROM documents", f"FROM (SELECT 0::BIGINT AS n_chars, {n}::BIGINT AS doc_id)") + ")"
    assert spark.createDataFrame([(n,)], "n long").select(labels.size_label(F.col("n"))).first()[0] == duckdb.connect().execute(sql).fetchall()[0][0]


def test_unit_rounds_as_sql(spark, tmp_path):
    """A vector of whole numbers and length 20,000,000, whose first element comes to a half in the eighth decimal."""
    v = [1000015, 16000000, 11958259, 3418, 77, 6, 2, 1]
    assert math.isqrt(sum(x * x for x in v)) == 20_000_000
    spark.createDataFrame([(0, [float(x) for x in v])], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    assert scalar_queries.scl24_unit(spark, str(tmp_path)).first().unit == db.execute(f"SELECT unit FROM ({SQL['scl24_unit']})").fetchall()[0][0]


def test_discovered_where_all_names_are_of_even_length(spark, tmp_path):
    """Sixteen files whose relative names (en/f2.jpg) have nine letters, and sixteen with ten (en/f10.jpg)."""
    rows = [(i, "src", "en", "x", 1) for i in (1, 2, 3, 4, 6, 7, 8, 9)] + [(i, "even", "en", "x", 1) for i in range(11, 99) if i % 5]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, search_queries.src16_discovered(spark, str(tmp_path)).collect()))
    assert got == [("even", "/b", 16), ("src", "/b", 8)]


def test_face_cap_of_many_groups(spark):
    """One array of 20,000 groups of 0 to 3 faces: those of the first seven in all stay."""
    faces = lambda i: F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (i % 4).cast("int"))
    g = F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.struct(i.alias("doc_id"), faces(i).alias("face_embeddings")))
    df = spark.range(1).select(F.transform(groups.capped(g, 7), lambda x: F.size(x["face_embeddings"])).alias("n"))
    assert took(df) < 20
    assert df.first().n == [0, 1, 2, 3, 0, 1] + [0] * 19_994


def test_expanded_meets_each_member_once(spark):
    """All of one group of 30,000 files are selected."""
    names = spark.range(30_000).select(F.concat(F.lit("f"), "id").alias("file_name"), F.col("id").alias("place"))
    df = duplicates.expanded(names, names.select(F.col("file_name").alias("node"), F.lit("f0").alias("root")))
    assert took(df) < 60
    assert df.count() == 30_000 and df.filter("place = 1").first().file_name == "f0"


def test_links_of_a_file_with_many(spark):
    """20,000 links to 10,000 files: the better one of each, by similarity and name."""
    x = F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.struct(F.format_string("f%05d", F.floor(i / 2)).alias("file_name"), (i % 2 == 0).alias("is_video"), (90.0 + i % 3).alias("similarity_pct")))
    df = spark.range(1).select(groups.normal_links(x).alias("m"))
    assert took(df) < 20
    m = df.first().m
    best = {f"f{k:05d}": max((2 * k) % 3, (2 * k + 1) % 3) for k in range(10_000)}
    assert [(x.file_name, x.similarity_pct) for x in m] == [(n, 90.0 + p) for n, p in sorted(best.items(), key=lambda x: (-x[1], x[0]))]


def test_manifests_are_bounded(spark, tmp_path, monkeypatch):
    """No manifest holds more than 8,192 files, however many there are."""
    spark.range(1, 40_001).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(source_queries, "shared_dir", lambda _: f"{tmp_path}/shared")
    assert source_queries.src17_manifest(spark, str(tmp_path)).count() == 40_000 - 40_000 // 3
    sizes = [r.n for r in spark.read.json(f"{tmp_path}/shared/*").select(F.size("media").alias("n")).collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 8192


def test_memory_of_a_shortlist_block():
    """4,096 queries against 8,192 candidates: what a task holds is near the block itself, not many strips and a tuple for each result."""
    rng = np.random.default_rng(1)
    kind, n = np.array([0] * 4096 + [1] * 8192), 4096 + 8192
    v = rng.standard_normal((n, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    table = pa.table({"kind": kind, "file_name": [f"c/f{i}" for i in (*range(4096), *range(8192))], "v": pa.FixedSizeListArray.from_arrays(v.ravel(), 64).cast(pa.list_(pa.float64()))})
    tracemalloc.start()
    out = search.nearest_in_block(table, 64, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 4096 * 64 and peak < 64 << 20
    first = [(r["candidate"], r["score"]) for r in out.slice(0, 64).to_pylist()]
    own = out["file_name"][0].as_py()
    x = v[int(own[3:])]
    want = sorted((-(math.floor(abs(s) * 1e5 + 0.5) * np.sign(s) / 1e5), f"c/f{i}") for i, s in enumerate(v[4096:] @ x) if f"c/f{i}" != own)[:64]
    assert first == [(c, -s) for s, c in want]


def test_hashes_by_blocks_are_not_broadcast(spark):
    """A hash has a row for each mask, which Spark's size check doesn't see: 1,000 hashes are small, their join still merges."""
    rows = spark.range(1000).select(F.concat(F.lit("f"), "id").alias("file_name"), F.xxhash64("id").alias("h"))
    plan = hamming.hash_pairs(rows, rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_best_match_sends_no_blocks_of_bits_around(spark, monkeypatch):
    """The pairs of join1_hamming_best come out of a merge, though its files are few."""
    plans = []
    monkeypatch.setattr(hamming, "kept", lambda df, at="part": plans.append((at, df._jdf.queryExecution().executedPlan().toString())) or storage.kept(df, at))
    index_queries.join1_hamming_best(spark, "/root/testdata/sf0.001")
    pairs = [p for at, p in plans if at == "pairs"]
    assert len(pairs) == 1 and "SortMergeJoin" in pairs[0] and "Broadcast" not in pairs[0]


@pytest.mark.parametrize("name", ["agg2_leader", "agg3_image_groups", "agg5_repair", "agg4_video_groups", "sort4_image_order"])
def test_no_text_is_sorted_with_images(spark, monkeypatch, name):
    """What is sorted for the order of images holds no texts."""
    seen = []
    monkeypatch.setattr(search, "kept", lambda df, at="part": seen.append(df.columns) or storage.kept(df, at))
    getattr(index_queries, name)(spark, "/root/testdata/sf0.001")
    assert seen and not any(c.startswith("text") for columns in seen for c in columns)


def test_memory_of_a_block_of_an_index():
    """4,096 queries against 8,192 codes of a cell: a task holds strips of scores, not all of them, and gives the same rows."""
    rng = np.random.default_rng(2)
    asked, n, m = rng.standard_normal((4096, 64)), 4096, 8192
    asked /= np.linalg.norm(asked, axis=1)[:, None]
    codes = rng.integers(-128, 128, (m, 64), dtype=np.int8)
    cells = vector_index.Cells(np.zeros((1, 64)), np.full(64, 1 / 1024), 1)
    none = lambda k, kind: pa.nulls(k, kind)
    head = lambda k, kind: [pa.array(np.full(k, x, np.int32)) for x in (0, 0, 0, kind)]
    names = ["cell", "block", "part", "kind", "query", "v", "reach", "id", "code", "off"]
    first = pa.RecordBatch.from_arrays([*head(n, 0), pa.array(range(n)), pa.array(list(asked)), pa.array(np.full(n, 0.6)), none(n, pa.int64()), none(n, pa.binary()), pa.array(np.zeros(n))], names=names)
    then = pa.RecordBatch.from_arrays([*head(m, 1), none(m, pa.int64()), none(m, pa.list_(pa.float64())), pa.array(np.zeros(m)), pa.array(range(m)), pa.array([c.tobytes() for c in codes]), pa.array(np.zeros(m))], names=names)
    scores = asked @ (codes / 1024).T
    for k, want in ((None, int((scores >= 0.6 - vector_index.SPARE).sum())), (8, n * 8)):
        tracemalloc.start()
        got = [len(b) for b in vector_index._scored(iter([first, then]), cells, k)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(got) == want and peak < 64 << 20


def test_queries_of_an_index_in_parts(spark, monkeypatch):
    """More queries than a task holds: each part of them meets all rows."""
    got = lambda: sorted(map(tuple, search_queries.snk4_index_exact(spark, "/root/testdata/sf0.01").collect()))
    whole = got()
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 3)
    assert whole and got() == whole


def test_newest_requests_of_many_sessions():
    """200 frames of 5,000 rows, two of each of 500,000 sessions: the sessions held aren't sorted again for every frame."""
    frames = (pd.DataFrame({"session": range(i % 100 * 5000, i % 100 * 5000 + 5000), "generation": i, "request": str(i)}) for i in range(200))
    t = time.time()
    got = pd.concat(sessions._newest(frames)).sort_values("session")
    assert time.time() - t < 10
    assert len(got) == 500_000 and (got["received"] == 2).all() and (got["generation"] == 100 + got["session"] // 5000).all() and (got["request"] == got["generation"].astype(str)).all()
