"""The path index against the exact rule on every path, over all forms, with queries that match by edit distance only."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from photonlake.functions import paths
from photonlake.operators import path_index
from photonlake.plans.storage import shared_dir

WORDS = ["holiday", "summer-of-2019", "zürich", "photos", "a", "im", "été", "very-long-folder-name-of-photos", "IMG_0001.jpg", "img_0002.JPG", "readme", "clip.mp4", "x.y", "ÀÉ"]


@pytest.fixture(scope="module")
def index(spark):
    rnd = random.Random(3)
    rows = []
    for key in range(400):
        parts = [rnd.choice(WORDS) for _ in range(rnd.randint(1, 4))]
        rel = "/".join(parts) if rnd.random() < 0.9 else "\\".join(parts)
        own = f"collection@{key % 3}/{rel}" if key % 4 else None
        rows.append((key, f"/mnt/disk{key % 2}/{rnd.choice(WORDS)}/{rel}", own, rel if own else None, f"/roots/root{key % 3}/{rel}" if key % 5 else None))
    rows += [(None, "/no/key", None, None, None), (900, None, "c/x", "x", None), (901, "plain", None, None, None), (902, "//double//slash/", None, None, None)]
    table = spark.createDataFrame(rows, "key long, path string, db string, rel string, full string").withColumn("component", F.lit("clash"))
    path = f"{shared_dir(spark)}/paths-{uuid.uuid4().hex}"
    path_index.build(table, path, "path", "db", "rel", "full", folders=8)
    return table, path


def typo(rnd, word, n):
    for _ in range(n if word else 0):
        at = rnd.randrange(len(word) or 1)
        word = rnd.choice([word[:at] + word[at + 1 :], word[:at] + rnd.choice("xyz") + word[at:], word[:at] + "q" + word[at + 1 :]])
    return word


def queries():
    rnd = random.Random(8)
    fixed = ["holi", "0001", "/a/", "//", "", "photos/IMG_0001.JPG", "ZÜRICH/a", "e/e", "roots/root2/photos", "collection@1/holiday"]
    close = [f"{typo(rnd, rnd.choice(WORDS[:8]).lower(), rnd.randint(1, 3)) or 'q'}/{rnd.choice(WORDS[:8])}" for _ in range(6)]
    return fixed + close + ["holidqy/photos", "sumer-of-219/photos", "very-lng-folder-nameof-photos/a", "hoiday/zürihc"]


def test_index_equals_the_rule(spark, index):
    table, path = index
    rule = lambda q: paths.name_matches(q, F.col("path"), F.col("db"), F.col("rel"), F.col("full"))
    asked = queries()
    every = table.filter("key IS NOT NULL AND path IS NOT NULL").select("key", *[F.coalesce(rule(q), F.lit(False)).alias(f"q{n}") for n, q in enumerate(asked)]).collect()
    some = 0
    for n, q in enumerate(asked):
        want = sorted(r.key for r in every if r[f"q{n}"])
        got = path_index.search(spark, path, q, "path", "db", "rel", "full")
        assert sorted(r.key for r in got.select("key").collect()) == want, q
        some += bool(want) and n >= 10
    assert some >= 4  # queries with typing errors that find something


def test_components_by_edit_distance_only(spark, index):
    _, path = index
    for q, want in (("holidxy", {"holiday"}), ("sumer-of-219", {"summer-of-2019"}), ("zürch", {"zürich"}), ("folder-nxme", set()), ("img_00o1.jpg", {"img_0001.jpg", "img_0002.jpg"})):
        found = {r.component for r in path_index.components_like(spark, path, q).collect()}
        assert want <= found and all(len(x.encode()) < len(q.encode()) or x in want for x in found), q


def test_keys_of_both_sides_agree(spark):
    words = ["holiday", "zürich", "a", "été", "very-long-folder-name"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", path_index._hashed("=", path_index._bytes(F.col("w"))).alias("h"), *[p.alias(f"p{i}") for i, p in enumerate(path_index._pieces(path_index._bytes(F.col("w")), 3))]).collect()
    for r in rows:
        data = r.w.encode()
        edges = path_index._edges(len(data), 3)
        assert r.h == path_index._key("=", data)
        assert [r[f"p{i}"] for i in range(3)] == [path_index._key(f"3/{i}/{len(data)}:", data[edges[i] : edges[i + 1]]) for i in range(3)]
