"""Grouping and search against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from photonlake.functions import vectors
from photonlake.operators import duplicates, graph, hamming, relocate, search, tables


def brute_leaders(items, most):
    masters, out = [], {}
    for name, h, _, free in sorted(items, key=lambda x: x[2]):
        near = min(((h ^ m).bit_count(), n) for n, m in masters) if masters else (99, "")
        if near[0] <= most and not free:
            out[name] = (False, near[1], near[0])
        else:
            masters.append((name, h))
            out[name] = (True, None, None)
    return out


@pytest.mark.parametrize("seed, percent", [(1, 95.0), (2, 95.0), (3, 90.0), (4, 80.0)])
def test_leaders(spark, seed, percent):
    rng = random.Random(seed)
    cores = [rng.getrandbits(62) for _ in range(6)]
    items = []
    for i in range(120):
        h = rng.choice(cores)
        for b in rng.sample(range(12), rng.randint(0, 5)):
            h ^= 1 << b
        items.append((f"f{i:03d}", h, None, rng.random() < 0.1))
    order = list(range(120))
    rng.shuffle(order)
    items = [(n, h, p, f) for (n, h, _, f), p in zip(items, order)]
    df = spark.createDataFrame(items, "file_name string, h long, place long, busy boolean")
    got = {r.file_name: (r.is_master, r.match, r.similarity_pct) for r in hamming.leaders(df, percent, "busy").collect()}
    from photonlake.functions.hashes import most_apart

    want = brute_leaders(items, most_apart(percent))
    assert {n: (m, t) for n, (m, t, _) in got.items()} == {n: (m, t) for n, (m, t, _) in want.items()}
    assert all(got[n][2] == pytest.approx((64 - d) * 100 / 64, abs=0.001) for n, (m, _, d) in want.items() if not m)


def test_matches_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(f"f{i}", rng.getrandbits(8) | 7 << 60 if i % 3 else rng.getrandbits(3)) for i in range(90)] + [("null", None)]
    rows = [(n, h if h is None or h < 1 << 63 else h - (1 << 64)) for n, h in rows]
    df = spark.createDataFrame(rows, "file_name string, h long")
    good = [(n, h) for n, h in rows if h is not None]
    dist = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = {(a, b, dist(x, y)) for a, x in good for b, y in good if a != b and dist(x, y) <= 3}
    assert {tuple(r) for r in hamming.all_matches(df, df, 3).collect()} == want
    best = {a: min((d, b) for x, b, d in want if x == a) for a in {x for x, _, _ in want}}
    assert {r.file_name: (r.d, r.match) for r in hamming.best_match(df, df, 3).collect()} == best


def test_components_of_chains_and_stars(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("s000", f"s{i:03d}") for i in range(1, 30)] + [("x", "x")]
    out = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "file_name string, target string")).collect()}
    assert len(out) == 61 + 30 and {out[n] for n in out if n[0] == "n"} == {"n000"} and {out[n] for n in out if n[0] == "s"} == {"s000"}
    assert graph.components(spark.createDataFrame([], "file_name string, target string")).count() == 0


@pytest.mark.parametrize(("n", "most"), [(10, 3), (10**7, 3), (10**10, 3), (100, 12), (10**6, 12)])
def test_masks_leave_no_pair_out(n, most):
    rng = random.Random(n)
    masks = hamming.block_masks(n, most)
    assert len(set(masks)) == len(masks)
    for _ in range(300):
        apart = sum(1 << b for b in rng.sample(range(64), rng.randint(0, most)))
        assert any(apart & m == 0 for m in masks)


def test_places_across_ranges(spark):
    rng = random.Random(1)
    rows = [(f"n{k:03}", rng.choice([None, 1, 2, 3])) for k in range(200)]
    df = spark.createDataFrame(rows, "name string, v int").repartition(7)
    got = {r.name: r.place for r in search.numbered(df, [F.col("v").desc_nulls_last(), F.col("name")], "place").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(want)}
    assert search.numbered(df.limit(0), [F.col("name")], "place").count() == 0


def test_scores_of_batches(spark):
    rows = [(0, [3.0, 4.0]), (1, None), (2, [1.0]), (3, [None, 1.0]), (4, [0.0, 0.0]), (5, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "k int, v array<float>")
    score = lambda *a: {r.k: r.s for r in df.select("k", vectors.best_score(F.col("v"), *a).alias("s")).collect()}
    assert score([[1.0, 0.0], [0.0, 1.0]]) == {0: 4.0, 1: None, 2: None, 3: None, 4: 0.0, 5: 2.0}
    unit, cosine = score([[2.0, 0.0]], "unit"), score([[2.0, 0.0], [0.0, 0.0]], "cosine")
    assert abs(unit[0] - 1.2) < 1e-9 and abs(cosine[0] - 0.6) < 1e-9 and cosine[4] == 0 and cosine[5] == 0 and unit[1] is None


def test_bridges_grow_from_the_root_by_the_best_edge(spark):
    edges = [("b", "a", 10, 0.9, 0.5), ("c", "a", 20, 0.9, 0.5), ("c", "b", 30, 0.9, 0.5), ("d", "b", 5, 0.9, 0.5)]
    df = spark.createDataFrame(edges, "file_name string, target string, inliers int, ratio double, score double")
    out = {(r.file_name, r.target) for r in graph.bridges(df, graph.components(df.select("file_name", "target"))).collect()}
    assert out == {("c", "a"), ("b", "c"), ("d", "b")}


def grown(edges):
    """Links of each group as they are taken one by one: the best edge between what is reached and what isn't."""
    left = sorted(edges, key=lambda e: (-e[2], -e[3], -e[4], e[0], e[1]))
    nodes, out = {n for e in edges for n in e[:2]}, set()
    while nodes:
        root = min(nodes)
        reached = {root}
        while border := [e for e in left if (e[0] in reached) != (e[1] in reached)]:
            a, b = border[0][:2]
            out.add((root, *((b, a) if a in reached else (a, b))))
            reached |= {a, b}
        nodes -= reached
    return out


def test_bridges_against_a_sequential_run(spark):
    rng = random.Random(4)
    edges = list({(a, b): (a, b, rng.randrange(4), rng.choice([0.5, 0.9]), 0.5) for a, b in ((f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(60)) if a != b}.values())
    edges += [(f"p{k:02}", f"p{k + 1:02}", k % 3, 0.5, 0.5) for k in range(20)]
    df = spark.createDataFrame(edges, "file_name string, target string, inliers int, ratio double, score double")
    out = {(r.root, r.file_name, r.target) for r in graph.bridges(df, graph.components(df.select("file_name", "target"))).collect()}
    assert out == grown(edges)
    assert graph.bridges(df.limit(0), graph.components(df.select("file_name", "target"))).count() == 0


def test_group_of_a_long_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(f"p{k:02}", f"p{k + 1:02}") for k in range(30)] + [("x", "y")], "file_name string, target string")
    assert sorted(r.node for r in graph.group_of(chain, "p29").collect()) == [f"p{k:02}" for k in range(31)]
    assert [r.node for r in graph.group_of(chain, "alone").collect()] == ["alone"] and graph.group_of(chain, "x").count() == 2


def test_greedy_groups_along_a_long_chain(spark):
    # Each hash is one bit from the one before, and the order goes along the chain: every second file is a master, decided one after the other.
    rows, h = [], 0
    for k in range(40):
        h ^= 0b111 << (3 * (k % 20))
        rows.append((f"f{k:03}", h - (h >> 63 << 64), k, False))
    df = spark.createDataFrame(rows, "file_name string, h long, place long, free boolean")
    out = {r.file_name: r.is_master for r in hamming.leaders(df, 95.0).collect()}
    want = brute_leaders([(n, h & (1 << 64) - 1, p, f) for n, h, p, f in rows], 3)
    assert out == {n: x[0] for n, x in want.items()}


def test_shortlist_of_eligible_files(spark):
    rng = random.Random(6)
    rows = [(f"f{k:03}", [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for k in range(60)] + [("short", [1.0]), ("none", None)]
    df = spark.createDataFrame(rows, "file_name string, vector array<float>")
    ok = spark.createDataFrame([(f"f{k:03}",) for k in range(0, 60, 3)] + [("unknown",)], "file_name string")

    def cosine(a, b):
        n = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return sum((x / (n[0] or 1)) * (y / (n[1] or 1)) for x, y in zip(a, b))

    for eligible, names in ((None, {r[0] for r in rows}), (ok, {f"f{k:03}" for k in range(0, 60, 3)})):
        got = {(r.file_name, r.n): (r.candidate, r.score) for r in search.shortlist(df, 5, eligible=eligible, rows=16).collect()}
        for n, v in rows[:60]:
            best = sorted((-round(cosine(v, w), 5), m) for m, w in rows[:60] if m != n and m in names)[:5]
            assert [got[n, i + 1] for i in range(5)] == [(m, -s) for s, m in best], n
        assert ("none", 1) not in got and ("short", 1) not in got


def test_merge_takes_families_whole_and_needs_a_primary_source(spark):
    schema = "file_name string, old_key string, main boolean, note string, sift_match_file string, sift_match_score double, sift_match_checked boolean, image_width int, image_height int"
    rows = [
        ("same", "a", False, "n", None, None, None, 1, 2), ("same", "b", False, "n", None, None, None, 1, 2),
        ("filled", "a", False, None, None, None, None, None, None), ("filled", "b", False, "x", "m", None, None, 3, None), ("filled", "c", False, None, None, 0.5, True, None, None),
        ("primary", "a", False, "x", "m", 0.1, True, 1, 1), ("primary", "b", True, None, None, 0.9, None, 2, 2),
    ]
    bad = [("torn", "a", False, "x", None, None, None, None, None), ("torn", "b", False, "y", None, None, None, None, None)]
    twice = [("two", "a", True, "x", None, None, None, None, None), ("two", "b", True, "y", None, None, None, None, None), ("even", "a", True, "x", None, None, None, None, None), ("even", "b", True, "x", None, None, None, None, None), ("even", "c", False, "y", None, None, None, None, None)]
    df = lambda r: spark.createDataFrame(r, schema)
    out = {r.file_name: r for r in relocate.coalesced(df(rows), primary="main").collect()}
    assert not out["same"].conflict and out["same"].merged == 2 and out["same"].note == "n"
    f = out["filled"]
    # The first donor of the family is b: its own nulls come along, so c's score is no match of m's.
    assert (f.note, f.sift_match_file, f.sift_match_score, f.sift_match_checked, f.image_width, f.image_height) == ("x", "m", None, None, 3, None) and not f.conflict
    p = out["primary"]
    # The primary source's score stays with its own missing match; a value that only the other has fills a single column.
    assert (p.note, p.sift_match_file, p.sift_match_score, p.image_width) == ("x", None, 0.9, 2) and p.conflict and p.resolved
    with pytest.raises(Exception, match="primary source"):
        relocate.coalesced(df(rows + bad), primary="main").collect()
    out = {r.file_name: r.resolved for r in relocate.coalesced(df(rows + bad + twice), primary="main", strict=False).collect()}
    assert {n for n, ok in out.items() if not ok} == {"torn", "two"}


def test_layouts_and_snapshots(spark):
    old = tables.tables_sorted(spark.createDataFrame([("t", 0, "k", "string"), ("t", 1, "v", "int"), ("u", 0, "k", "int"), ("w", 0, "k", "int")], "name string, place int, column string, type string"))
    new = tables.tables_sorted(spark.createDataFrame([("t", 0, "v", "int"), ("t", 1, "k", "string"), ("u", 0, "k", "long"), ("x", 0, "k", "int")], "name string, place int, column string, type string"))
    assert {tuple(r) for r in tables.index_faults(old, new).collect()} == {("t", "columns"), ("u", "types"), ("w", "missing"), ("x", "unexpected")}
    assert tables.index_faults(old, old).count() == 0
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "k int, v string")
    assert {tuple(r) for r in relocate.changes(a, b, "k", ["v"]).collect()} == {(2, "changed"), (3, "removed"), (4, "added")} and relocate.changes(a, a, "k", ["v"]).count() == 0


def test_elected_master(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b")], "file_name string, target string")
    ranks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9)], "file_name string, rank int")
    out = {r.file_name: (r.master, r.direct) for r in graph.elected(edges, ranks, [F.col("rank").desc()]).collect()}
    assert out == {"a": ("c", False), "b": ("c", False), "c": (None, False)}


def test_threshold_is_no_top_k(spark):
    rows = [(f"f{i}", False, 0.0, [0.9, 0.1]) for i in range(501)] + [("low", False, 0.0, [0.4, 0.1]), ("short", False, 0.0, [1.0])]
    df = spark.createDataFrame(rows, "file_name string, is_video boolean, timestamp_sec double, vector array<float>")
    out = search.search(df, [1.0, 0.0], 0.5)
    assert out.count() == 501 and out.agg(F.max("rank")).first()[0] == 501


def test_text_fraction(spark):
    df = spark.createDataFrame([("a", False, 0.0, "word1 word2"), ("b", False, 0.0, "word1")], "file_name string, is_video boolean, timestamp_sec double, text_lower string")
    assert [(r.file_name, r.score) for r in search.search_text(df, "word1 word2", 1.0).collect()] == [("a", 1.0)]
    assert search.search_text(df, ' "" ').count() == 0 and search.search_text(df, '"word1 word2"').count() == 1


def test_dates_order(spark):
    df = spark.createDataFrame([("oldest", 0.9, 1), ("middle", 0.5, 2), ("newest", 0.1, 3), ("none", 0.2, None)], "file_name string, score double, date_sec long")
    names = lambda o: [r.file_name for r in search.ranked(df, o).orderBy("rank").collect()]
    assert names("newest") == ["newest", "middle", "oldest", "none"] and names("oldest") == ["oldest", "middle", "newest", "none"] and names("best") == ["oldest", "middle", "none", "newest"]


def test_duplicate_groups_and_oldest(spark):
    ix = spark.createDataFrame([("copy-a", "master-a"), ("copy-b", "master-b"), ("master-a", None), ("master-b", None)], "file_name string, dedupe_match_file string")
    roots = spark.createDataFrame([("master-a", "master-a"), ("master-b", "master-a")], "node string, root string")
    grouped = duplicates.full_groups(ix, roots)
    (row,) = duplicates.group_lists(grouped).collect()
    assert row.grp == "master-a" and row.members == ["copy-a", "copy-b", "master-a", "master-b"]
    dated = spark.createDataFrame([("IMG_20240102_120000.jpg", "g", 1704196800, None, False), ("IMG_20200102_120000.jpg", "g", None, 5, False)], "file_name string, grp string, modified long, exif long, is_video boolean")
    assert {r.date_sec for r in duplicates.oldest_dates(dated).collect()} == {1577966400}


def test_gallery_dedupe(spark):
    df = spark.createDataFrame([(0, "one.jpg"), (1, "one.jpg"), (2, "two.mp4"), (3, None)], "rank int, media_path string")
    assert sorted(r.rank for r in search.first_of(df, "media_path").collect()) == [0, 2]


INDEX = [("t/Legacy/a.jpg", "t", "t/Legacy/b.jpg", "t/Legacy/b.jpg", 1, 1), ("t/Legacy/b.jpg", "t", "t/Legacy/a.jpg", None, 1, 1), ("other/r.jpg", "other", "t/Legacy/a.jpg", None, 1, 1)]


def test_relocation_fan_out_and_in(spark):
    ix = spark.createDataFrame(INDEX, "file_name string, collection_id string, dedupe_match_file string, sift_match_file string, source_size long, source_mtime_ns long")
    m = spark.createDataFrame([("t/Legacy/a.jpg", "t/One/a.jpg", "One", 5, 6), ("t/Legacy/a.jpg", "t/Two/a.jpg", "Two", 5, 6), ("t/Legacy/b.jpg", "t/Two/b.jpg", "Two", 7, 8)], "old_key string, new_key string, chat string, size long, mtime_ns long")
    out = relocate.referred(relocate.referred(relocate.fan_out(ix, m), m, "dedupe_match_file"), m, "sift_match_file")
    rows = {r.file_name: r for r in out.collect()}
    assert set(rows) == {"t/One/a.jpg", "t/Two/a.jpg", "t/Two/b.jpg", "other/r.jpg"}
    assert rows["other/r.jpg"].dedupe_match_file == "t/One/a.jpg" and rows["t/Two/b.jpg"].dedupe_match_file == "t/Two/a.jpg" and rows["t/One/a.jpg"].source_size == 5
    assert {r["check"]: r.faults for r in relocate.faults(out, m, 3, 0, 0).collect()} == {"repeated keys": 0, "stale references": 0, "uncovered targets": 0, "conservation": 0}
    one = spark.createDataFrame([("t/Legacy/a.jpg", "t/All/a.jpg", "All", 5, 6), ("t/Legacy/b.jpg", "t/All/a.jpg", "All", 5, 6)], m.schema)
    assert relocate.collisions(one).count() == 1
    merged = relocate.without_self(relocate.coalesced(relocate.referred(relocate.fan_out(ix, one), one, "dedupe_match_file").drop("chat", "mapped")))
    rows = {r.file_name: r for r in merged.collect()}
    assert rows["t/All/a.jpg"].merged == 2 and rows["t/All/a.jpg"].dedupe_match_file is None and rows["other/r.jpg"].dedupe_match_file == "t/All/a.jpg"


def test_variants_and_opaque_ids(spark):
    rows = spark.createDataFrame([("f", "f|0.000", [0.25, 0.75]), ("f", "f|0.000", [0.75, 0.25]), ("g", "g|0.000", [1.0, 1.0]), ("g", "g|0.000", [1.0, 1.0])], "file_name string, id string, vector array<float>")
    out = [r.id for r in relocate.variants(rows, ["vector"]).collect()]
    assert len(out) == 3 and sum("|variant:" in x for x in out) == 2
    m = spark.createDataFrame([("f", "x/f"), ("f", "y/f")], "old_key string, new_key string")
    assert relocate.opaque_clones(spark.createDataFrame([("opaque", "f"), ("f|1", "f")], "id string, file_name string"), m).count() == 1


def test_upsert_and_schema(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    batch = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, seq int")
    assert sorted(map(tuple, tables.upserted(base, batch, "k", "seq").collect())) == [("a", 1), ("b", 4), ("c", 5)]
    assert sorted(map(tuple, tables.without(base.unionByName(spark.createDataFrame([(None, 9)], base.schema)), spark.createDataFrame([("a",), (None,)], "k string"), "k").collect()), key=str) == [("b", 2), (None, 9)]
    legacy = spark.createDataFrame([("a", [1.0], None)], "file_name string, clip_embedding array<float>, clip_groups array<struct<timestamp_sec:float,clip_embedding:array<float>>>")
    assert tables.grouped_legacy(legacy).first().clip_groups[0].clip_embedding == [1.0]


def test_publish_checks_first(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.publish(spark.range(3), path)
    with pytest.raises(ValueError):
        tables.publish(spark.range(5), path, check=lambda df: False)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]
    tables.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
