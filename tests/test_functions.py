"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from photonlake.functions import dates, groups, hashes, labels, paths, vectors
from photonlake.sources import layout


def one(spark, column, **values):
    names = list(values)
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items())) if names else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_similarity_of_each_distance(spark):
    rows = spark.range(13).select(hashes.rounded(hashes.similarity(F.col("id"))).alias("p")).collect()
    assert [r.p for r in rows] == [100, 98.438, 96.875, 95.312, 93.75, 92.188, 90.625, 89.062, 87.5, 85.938, 84.375, 82.812, 81.25]
    assert [hashes.most_apart(p) for p in (95, 80, 100, 101, -5)] == [3, 12, 0, 0, 64]


@pytest.mark.parametrize("text, value", [("ffffffffffffffff", -1), (" 00000000000000ff ", 255), ("8000000000000000", -(1 << 63)), ("fff", None), ("gggggggggggggggg", None), (None, None)])
def test_hash_parsing(spark, text, value):
    assert one(spark, hashes.parse_hash(F.col("h")), h=text) == value


@pytest.mark.parametrize("name, date", [
    ("photo_8555@30-09-2016_20-03-46.jpg", "2016-09-30 20:03:46"), ("IMG_20221124_165440.jpg", "2022-11-24 16:54:40"), ("Screenshot_20221227_230518_app.jpg", "2022-12-27 23:05:18"),
    ("445739505_349698.jpg", None), ("a/2020-01-02T03:04:05.mp4", "2020-01-02 03:04:05"), ("x20201301_000000.jpg", None), (None, None),
])
def test_capture_time(spark, name, date):
    got = one(spark, F.date_format(F.timestamp_seconds(dates.capture_time(F.col("n"))), "yyyy-MM-dd HH:mm:ss"), n=name)
    assert got == date


def test_exif_time(spark):
    assert one(spark, dates.exif_time(F.col("v")), v="2016:07:14 12:34:56\0") == 1468499696
    assert one(spark, dates.exif_time(F.col("v")), v="garbage") is None


@pytest.mark.parametrize("a, b, least", [(2000, 1000, 1000), (1000, 2000, 1000), (1000, None, 1000), (None, 1000, 1000), (None, None, None)])
def test_earlier(spark, a, b, least):
    df = spark.createDataFrame([(a, b)], "a long, b long")
    assert df.select(dates.earlier(F.col("a"), F.col("b"))).first()[0] == least


@pytest.mark.parametrize("ns, s", [(1_999_999_999, 1), (-1, -1), (-1_000_000_000, -1), (0, 0), (9_223_372_036_854_775_807, 9_223_372_036)])
def test_whole_seconds(spark, ns, s):
    assert one(spark, dates.whole_seconds(F.col("n")), n=ns) == s


NAME = "collection/People/Ayman/Trips/Sensitive Information 5/photos/image.jpg"


@pytest.mark.parametrize("name, folder, inside", [
    (NAME, "/media/library/People/Ayman", True), (NAME, "People/Ayman/Trips", True), (NAME, "Sensitive Information 5/photos", True), (NAME, "ayman", True), (NAME, " ", True), (NAME, "image", False), (NAME, "collection", False),
    (NAME, "People\\Ayman", True), (NAME, "Ayman/Tri", False), ("collection/People/Trips/ayman-photo.jpg", "ayman", False),
])
def test_folder_scope(spark, name, folder, inside):
    assert one(spark, paths.in_folder(F.col("n"), F.col("s"), folder), n=name, s="/media/library/" + name.split("/", 1)[1]) is inside
    assert one(spark, paths.in_folder(F.col("n"), F.lit(None).cast("string"), folder), n=name) is (inside and not folder.startswith("/media"))


@pytest.mark.parametrize("query, candidate, fits", [
    ("photos", "photo", True), ("photos", "phxtos", True), ("photo", "phxxo", False), ("holidaypicture", "holxdaypxcture", True), ("abcd", "abxd", False), ("é2345", "a2345", False), ("x", "y", False),
])
def test_fuzzy_components(spark, query, candidate, fits):
    assert one(spark, paths.component_matches(F.col("q"), F.col("c")), q=query, c=candidate) is fits


@pytest.mark.parametrize("query, candidate, fits", [
    ("trips/photos", "c/people/trips/photo/x.jpg", True), ("trips/photos", "c/trips/people/photos", False), ("a/b/c/d", "a/b", False), ("/", "x", False), ("people/trisp", "/m/people/trips", False), ("people/trups", "/m/people/trips", True),
])
def test_partial_paths(spark, query, candidate, fits):
    assert one(spark, paths.partly_matches(F.col("q"), F.col("c")), q=query, c=candidate) is fits


def test_bytes_apart(spark):
    assert one(spark, paths.bytes_apart(F.col("a"), F.col("b"), 2), a="é", b="a") == 2
    assert one(spark, paths.bytes_apart(F.col("a"), F.col("b"), 1), a="é", b="a") is None


@pytest.mark.parametrize("path, safe", [("a/b.jpg", True), ("/a", False), ("a/../b", False), ("..", False), (" ", False), (None, False)])
def test_safe_paths(spark, path, safe):
    assert one(spark, paths.is_safe_relative(F.col("p")), p=path) is safe


@pytest.mark.parametrize("line, important", [
    ("Image Size : 4x3", True), ('"width": 3', True), ("Bit Depth : 8", True), ("Date/Time Original : x", True), ("File Modification Date/Time : x", True), ("Camera Model : x", False), ("Exposure Time : 1", False), ("ISO : 100", False),
    ("X Resolution : 72", False), ("ExifTool Version : 12", False), ("Image Size :  ", False), ("no colon", False),
])
def test_important_lines(spark, line, important):
    assert one(spark, labels.important_exif(F.col("l")), l=line) is important


@pytest.mark.parametrize("n, text", [(None, "n/a"), (5, "5 B"), (1024, "1.00 KB"), (1536 * 1024, "1.50 MB"), (3 << 30, "3.00 GB")])
def test_size_label(spark, n, text):
    df = spark.createDataFrame([(n,)], "n long")
    assert df.select(labels.size_label(F.col("n"))).first()[0] == text


@pytest.mark.parametrize("s, text", [(0.0, "00:00"), (-3.0, "00:00"), (59.6, "01:00"), (3661.0, "1:01:01")])
def test_duration_label(spark, s, text):
    assert one(spark, labels.duration_label(F.col("s")), s=s) == text


def test_compact_messages(spark):
    assert one(spark, labels.compact(F.col("m")), m=[" a ", "b"]) == "a <- caused by: b"
    assert len(one(spark, labels.compact(F.col("m")), m=["x" * 600])) == 500


def test_ids(spark):
    assert one(spark, paths.rewritten_id(F.col("i"), F.lit("a.jpg"), F.lit("n/a.jpg")), i="a.jpg|1.000|0") == "n/a.jpg|1.000|0"
    assert one(spark, paths.rewritten_id(F.col("i"), F.lit("a.jpg"), F.lit("n/a.jpg")), i="a.jpgx") == "a.jpgx"
    assert one(spark, paths.row_id(F.col("f"), F.col("t"), F.lit(2)), f="v.mp4", t=1.5) == "v.mp4|1.500|2"
    assert one(spark, paths.decoded_uri(F.col("u")), u="/a%20b+c%2") == "/a%20b+c%2"


def test_vectors(spark):
    row = spark.sql("SELECT array(3.0F, 4.0F) AS v, array(1.0F) AS s, array(0.0F, 0.0F) AS z").select(
        vectors.unit(F.col("v")).alias("u"), vectors.unit(F.col("z")).alias("z"), vectors.dot(F.col("v"), F.col("s")).alias("none"), vectors.shorter_dot(F.col("v"), F.col("s")).alias("d"), vectors.cosine(F.col("v"), F.col("z")).alias("c")
    ).first()
    assert row.u == [0.6, 0.8] and row.z == [0, 0] and row.none is None and row.d == 3 and row.c == 0


def test_links_and_lines(spark):
    df = spark.sql("SELECT array(named_struct('file_name', 'b', 'is_video', true, 'similarity_pct', 90.0F), named_struct('file_name', 'a', 'is_video', false, 'similarity_pct', 90.0F), named_struct('file_name', 'b', 'is_video', true, 'similarity_pct', NULL), named_struct('file_name', ' ', 'is_video', true, 'similarity_pct', 1.0F), named_struct('file_name', 'z', 'is_video', NULL, 'similarity_pct', NULL)) AS l")
    out = df.select(groups.normal_links(F.col("l")).alias("l")).first().l
    assert [(x.file_name, x.similarity_pct) for x in out] == [("a", 90.0), ("b", 90.0), ("z", None)]
    assert one(spark, groups.distinct_lines(F.col("t")), t=["Ab", " aB", "", "c"]) == "Ab\nc"
    assert one(spark, F.size(groups.spread(F.sequence(F.lit(1), F.lit(250)), 100))) == 100


def test_hex_dump():
    text = layout.hex_dump(bytes(range(65, 65 + 20)), 0x10)
    assert text.splitlines()[0] == "0x0010:   41 42 43 44 45 46 47 48  49 4A 4B 4C 4D 4E 4F 50   |ABCDEFGHIJKLMNOP|"
    assert text.splitlines()[1].startswith("0x0020:   51 52 53 54 ") and text.splitlines()[1].endswith("|QRST|")
    assert layout.hex_dump(b"x" * 2000).endswith("... (truncated) ...\n")


def test_layouts():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x02\x00\x03\x01\x01\x11\x00\xff\xda\x00\x02\x12\xff\x00\x34\xff\xd9"
    assert [(p[0], p[1], p[2]) for p in layout.parts(jpeg)] == [("SOI", 0, 2), ("APP0", 2, 6), ("SOF0", 8, 13), ("SOS", 21, 4), ("Image Data", 25, 4), ("EOI", 29, 2)]
    webp = b"RIFF\x10\0\0\0WEBPVP8 \x03\0\0\0abc\0"
    assert [p[0] for p in layout.parts(webp)] == ["RIFF Header", "VP8 "]
    assert [(p[0], p[2]) for p in layout.parts(b"z" * 3000)] == [("Header", 1024), ("Data", 1976)] and layout.parts(b"") == []
