"""Sources over real files."""

import hashlib
import json
import struct
import zlib

from pyspark.sql import functions as F

from photonlake.sources import capture, layout, listing, manifests, roots
from photonlake.streaming import index_stream


def test_listing(spark, tmp_path):
    for name in ("a/x.JPG", "a/b/y.mp4", "a/.hidden/z.gif", "t.tif", "n.txt", "B/q.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    files = listing.listed(spark, str(tmp_path))
    names = lambda df: [r.path[len(str(tmp_path)) + 1 :] for r in df.collect()]
    found = names(listing.media(files))
    assert {"a/x.JPG", "a/b/y.mp4", "t.tif", "B/q.png"} <= set(found) and found == sorted(found) and "n.txt" not in found
    assert "t.tif" not in names(listing.media(files, listing.VIEWED))
    assert names(listing.media(listing.listed(spark, str(tmp_path), recursive=False))) == ["t.tif"]
    assert [r.name for r in listing.folders(files, str(tmp_path)).collect()] == ["a", "B"]
    want = spark.createDataFrame([(str(tmp_path / "t.tif"), 5, hashlib.sha256(b"t.tif").hexdigest()), (str(tmp_path / "n.txt"), 6, ""), ("/gone", 1, "")], "path string, size long, sha256 string")
    assert {r.path.rsplit("/", 1)[1]: r.ok for r in listing.verified(spark, str(tmp_path), want).collect()} == {"t.tif": True, "n.txt": False, "gone": False}


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "destination_root": "/d", "chats": [{"chat_id": "1", "destination": "One"}], "media": [{"chat_id": "1", "source": "Legacy/a.jpg", "relative": "a.jpg", "size": 3, "status": "present"}]}, indent=1))
    (row,) = manifests.mapping(manifests.relocation(spark, str(tmp_path / "m.json")), "t").collect()
    assert (row.old_key, row.new_key, row.chat) == ("t/Legacy/a.jpg", "t/One/a.jpg", "One")
    (tmp_path / "s").mkdir()
    (tmp_path / "s/manifest.json").write_text(json.dumps({"source_size": 5, "frames": [{"timestamp_sec": 1.5, "image_file": "1.jpg"}]}, indent=1))
    assert manifests.stills(spark, str(tmp_path / "s")).first().frames[0].image_file == "1.jpg"
    probe = spark.createDataFrame([('{"streams":[{"codec_type":"video","width":4,"height":3,"duration":"2.5"}],"format":{"duration":"inf"}}',), ("broken",)], "j string")
    assert [r.p.duration for r in probe.select(manifests.probed(F.col("j")).alias("p")).collect()] == [2.5, None]


def test_exif_of_a_jpeg(spark):
    sub = struct.pack(">H", 1) + struct.pack(">HHII", 0x9003, 2, 20, 26 + 18) + b"\0" * 4
    tiff = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 1) + struct.pack(">HHII", 0x8769, 4, 1, 26) + b"\0" * 4 + sub + b"2016:07:14 12:34:56\0"
    assert layout.exif_dates(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + tiff) == {0x9003: "2016:07:14 12:34:56"}
    head = struct.pack(">H", 8 + len(tiff))
    far = b"\xff\xd8" + (b"\xff\xe2" + struct.pack(">H", 0xFFFF) + b"x" * 0xFFFD) * 3
    assert layout.exif_dates(far + b"\xff\xe1" + head + b"Exif\0\0" + tiff + b"\xff\xda") == {0x9003: "2016:07:14 12:34:56"}
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"crc_"
    assert layout.exif_dates(b"\x89PNG\r\n\x1a\n" + chunk(b"IDAT", b"x" * 100_000) + chunk(b"eXIf", tiff)) == {0x9003: "2016:07:14 12:34:56"}
    webp = b"VP8 " + struct.pack("<I", 70_001) + b"x" * 70_002 + b"EXIF" + struct.pack("<I", len(tiff)) + tiff
    assert layout.exif_dates(b"RIFF" + struct.pack("<I", len(webp) + 4) + b"WEBP" + webp) == {0x9003: "2016:07:14 12:34:56"}
    assert layout.exif_dates(b"nothing") == {} and layout.exif_dates(b"II*\0\xff\xff\xff\x7f") == {}


def test_roots(spark):
    raw = spark.createDataFrame([(" c ", " /m/ "), ("", "/x"), ("d", " "), (None, "/y")], "collection_id string, root_path string")
    assert [tuple(r) for r in roots.loaded(raw).collect()] == [("c", "/m")]
    files = spark.createDataFrame([("c/a/b.jpg",), ("z/q.jpg",)], "file_name string")
    assert {r.file_name: r.source_path for r in roots.resolved(files, roots.loaded(raw)).collect()} == {"c/a/b.jpg": "/m/a/b.jpg", "z/q.jpg": None}


def test_stream_upserts(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("a", k, k), (f"n{k}", k, k)], "file_name string, v int, seq int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = index_stream.arriving(spark, str(tmp_path / "in"), "file_name string, v int, seq int", 1)
    q = index_stream.keep_up(stream, str(tmp_path / "t"), str(tmp_path / "c"), "file_name", "seq")
    q.awaitTermination()
    out = {r.file_name: r.v for r in index_stream.latest(spark, str(tmp_path / "t")).collect()}
    assert out == {"a": 2, "n0": 0, "n1": 1, "n2": 2} and len(index_stream.versions(spark, str(tmp_path / "t"))) == 2


def test_stream_keeps_the_newer_row_whatever_file_it_comes_in(spark, tmp_path):
    files = [[("a", 100, 9), ("b", 1, 1)], [("a", 1, 2), ("b", 2, 5)], [("b", 3, 5), ("c", 7, None)], [("c", 8, None), ("c", 9, 0), ("a", 5, 8)]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "file_name string, v int, seq int").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema("file_name string, v int, seq int").parquet(str(tmp_path / "in/*"))
        index_stream.keep_up(stream, str(tmp_path / "t"), str(tmp_path / "c"), "file_name", "seq").awaitTermination()
    # a: the first file's row is the newest; b: of equal orders the later file's; c: a null order is lowest.
    assert {r.file_name: r.v for r in index_stream.latest(spark, str(tmp_path / "t")).collect()} == {"a": 100, "b": 3, "c": 9}


def test_all_candidate_roots_are_tried(spark):
    candidates = spark.range(12_000).selectExpr("id AS place", "concat('/m/', id) AS root_path")
    files = spark.createDataFrame([("/m/11999/a/b.jpg",), ("/m/11999/c.jpg",), ("/m/3/c.jpg",), ("/m/7/c.jpg",), ("/m/10500/d.jpg",), ("e.jpg",)], "path string")
    samples = spark.createDataFrame([("x", "a/b.jpg"), ("x", "c.jpg"), ("y", "d.jpg"), ("z", "e.jpg"), ("w", "b.jpg")], "collection_id string, rel string")
    assert {tuple(r) for r in roots.discovered(samples, candidates, files).collect()} == {("x", "/m/11999", 2), ("y", "/m/10500", 1)}


def test_captured_output(spark):
    rows = spark.createDataFrame([("a", b"one"), ("b", None)], "path string, content binary")
    out = lambda *a, **k: {r.path: (r.text, r.cut, r.state) for r in capture.captured(rows, *a, **k).collect()}
    assert out(["cat"]) == {"a": ("one", False, "ended"), "b": ("", False, "ended")}
    assert out(["cat"], most=2)["a"] == ("on", True, "stopped") and out(["yes"], most=10)["b"] == ("y\n" * 5, True, "stopped") and out(["no-such-program"])["a"] == (None, False, "missing")
    assert out(["sh", "-c", "echo x; exit 3"])["a"] == ("x\n", False, "failed 3") and out(["sleep", "9"], seconds=0.2)["a"] == ("", False, "too slow")


def test_rings_generations_and_phases(spark):
    events = spark.createDataFrame([("x", k) for k in range(7)] + [("y", 1)], "source string, at int")
    assert {r.source: ([e["at"] for e in r.events], r.dropped) for r in index_stream.ring(events, "source", "at", 3).collect()} == {"x": ([4, 5, 6], 4), "y": ([1], 0)}
    requests = spark.createDataFrame([("s", 1), ("s", 3), ("t", 2)], "session string, generation int")
    results = spark.createDataFrame([("s", 1, "old"), ("s", 3, "new"), ("t", 2, "own"), ("u", 1, "none")], "session string, generation int, r string")
    assert {r.r for r in index_stream.current(results, requests).collect()} == {"new", "own"}
    phases = spark.createDataFrame([("clip", 5), ("faces", 9)], "phase string, ready int")
    asked = spark.createDataFrame([(1, 2, "clip"), (2, 7, "clip"), (3, 2, "faces"), (4, 2, "never")], "id int, at int, phase string")
    assert {r.id: r.answered for r in index_stream.answered(asked, phases).collect()} == {1: 5, 2: 7, 3: 9, 4: None}


def test_fields_of_parts():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"crc_"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 6, 0, 0, 1)) + chunk(b"tEXt", b"Title\0A b") + chunk(b"zTXt", b"Note\0\0" + zlib.compress(b"packed")) + chunk(b"pHYs", struct.pack(">IIB", 10, 20, 1)) + chunk(b"sRGB", b"\2") + chunk(b"tIME", b"1")
    found = {x[0]: layout.fields_of(x[0], png[x[1] : x[1] + x[2]]) for x in layout.parts(png)}
    assert found["IHDR"]["width"] == "7" and found["IHDR"]["color"] == "RGB and alpha" and found["IHDR"]["interlace"] == "1"
    assert found["tEXt"] == {"key": "Title", "text": "A b"} and found["zTXt"]["text"] == "packed" and found["pHYs"]["y"] == "20" and found["sRGB"] == {"intent": "2"} and found["tIME"] == {}
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + struct.pack(">BBBHH", 1, 2, 1, 72, 73) + b"\0\0" + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 30, 40, 1) + b"abc" + b"\xff\xfe\0\4hi"
    found = {x[0]: layout.fields_of(x[0], jpeg[x[1] : x[1] + x[2]]) for x in layout.parts(jpeg)}
    assert found["APP0"] == {"major": "1", "minor": "2", "unit": "1", "x": "72", "y": "73"} and found["SOF0"]["width"] == "40" and found["COM"] == {"text": "hi"}
    assert layout.described("APP1") == "data of an application" and layout.described("VP8 ") == "compressed pixels" and layout.described("odd") == ""
