"""Queries of sources and of sinks that write files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from photonlake.operators import descriptors, search, tables
from photonlake.plans.registry import FILES, FRAMES, PATHS, WITH, query, table
from photonlake.plans.storage import shared_dir
from photonlake.sources import layout, listing, manifests


def _listing(spark, d):
    """Paths of several kinds of file."""
    kind = F.expr("CASE page_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.TIF' WHEN 2 THEN '.mp4' WHEN 3 THEN '.gif' ELSE '.txt' END")
    return PATHS.df(spark, d).select("page_id", F.concat(F.regexp_replace("path", "[.]jpg$", ""), kind).alias("path"))


KINDS = f"{WITH}, f AS (SELECT page_id, concat(substr(path, 1, length(path) - 4), CASE page_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.TIF' WHEN 2 THEN '.mp4' WHEN 3 THEN '.gif' ELSE '.txt' END) AS path FROM paths)"


@query(f"{KINDS} SELECT path, page_id % 5 = 2 AS is_video FROM f WHERE page_id % 5 IN (0, 1, 2)")
def src1_discovered(spark, d):
    """Files that are indexed."""
    return listing.media(_listing(spark, d)).select("path", "is_video")


@query(f"{KINDS} SELECT path FROM f WHERE page_id % 5 IN (0, 2, 3)")
def src2_viewed(spark, d):
    """Files that a viewer shows: gif, but not tif."""
    return listing.media(_listing(spark, d), listing.VIEWED).select("path")


@query("""SELECT file AS path FROM (SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem',
'nation', 'orders', 'pages', 'part', 'region', 'supplier']) || '.parquet' AS file)""")
def src3_flat(spark, d):
    """Names in one folder, in order."""
    rows = listing.listed(spark, d, recursive=_nested(spark, d))
    return rows.select(F.regexp_extract("path", r"([^/]+[.]parquet)(?:/[^/]*)?$", 1).alias("path")).filter("path <> ''").distinct().orderBy("path")


def _nested(spark, d: str) -> bool:
    """Whether tables are folders of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


@query(f"{WITH} SELECT DISTINCT list_extract(string_split(path, '/'), 2) AS name FROM paths")
def src4_folders(spark, d):
    """Folders right below one."""
    return listing.folders(PATHS.df(spark, d), "/")


@query("""SELECT concat('c/', 'old/', o_orderkey) AS old_key, concat('c/chat', o_custkey % 2, '/', o_orderkey, '.jpg') AS new_key, concat('chat',
o_custkey % 2) AS chat, o_orderkey AS size FROM orders WHERE o_orderkey % 3 <> 0""")
def src17_manifest(spark, d):
    """A relocation manifest as a mapping."""
    where = f"{shared_dir(spark)}/photonlake-manifest-{uuid.uuid4().hex}"
    media = F.struct(F.concat(F.lit("k"), F.col("o_custkey") % 2).alias("chat_id"), F.lit("1").alias("message_id"), F.concat(F.lit("old/"), "o_orderkey").alias("source"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("relative"), F.col("o_orderkey").alias("size"), F.lit("").alias("sha256"), F.lit("photo").alias("media_type"), F.when(F.col("o_orderkey") % 3 == 0, "missing").otherwise("present").alias("status"))
    chats = F.expr("array(named_struct('chat_id', 'k0', 'destination', 'chat0'), named_struct('chat_id', 'k1', 'destination', 'chat1'))")
    # One manifest for each range of 8,192 keys, as many bounded jobs would leave them.
    docs = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 8192).alias("part")).agg(F.collect_list(media).alias("media"))
    docs.select(F.lit(1).alias("version"), F.lit("/new").alias("destination_root"), chats.alias("chats"), "media").write.option("multiLine", False).json(where)
    rows = spark.read.schema(manifests.RELOCATION).json(where)
    flat = rows.select("chats", F.explode("media").alias("m")).select("chats", "m.*").withColumn("destination", F.get(F.filter("chats", lambda c: c["chat_id"] == F.col("chat_id")), F.lit(0))["destination"])
    return manifests.mapping(flat, "c")


@query(f"{WITH} SELECT file_name AS video, doc_id % 2 = 0 AND doc_id % 15 <> 0 AS valid FROM files WHERE is_video")
def src18_stills_valid(spark, d):
    """Manifests of stills that are still good: same file, same settings, all stills there."""
    v = FILES.df(spark, d).filter("is_video")
    rows = v.select(
        F.col("file_name").alias("video"), F.col("source_size").alias("size"), F.col("source_mtime_ns").alias("mtime_ns"), F.when(F.col("doc_id") % 2 == 0, F.col("source_size")).otherwise(-1).alias("source_size"), "source_mtime_ns",
        F.lit(27.0).alias("scene_threshold"), F.lit(15).alias("min_scene_len"), F.lit(100).alias("max_stills"), F.array(F.struct(F.lit(0.0).alias("timestamp_sec"), F.concat("file_name", F.lit("#0")).alias("image_file"))).alias("frames"),
    )
    images = v.filter("doc_id % 15 <> 0").select(F.concat("file_name", F.lit("#0")).alias("image_file"))
    return manifests.stills_valid(rows, images, 27.0, 15, 100).select("video", "valid")


@query("SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS taken FROM events")
def src19_exif(spark, d):
    """Dates out of EXIF bytes (a little-endian directory with one entry)."""
    from photonlake.functions import dates

    head = F.unhex(F.lit("49492A0008000000" + "0100" + "0390" + "0200" + "14000000" + "1A000000" + "00000000"))
    content = F.concat(head, F.date_format("ts", "yyyy:MM:dd HH:mm:ss").cast("binary"), F.unhex(F.lit("00")))
    found = layout.with_exif(table(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), content.alias("content")))
    return found.select(F.col("path").cast("long").alias("event_id"), dates.taken(F.col("original"), F.col("digitized"), F.col("changed")).alias("taken"))


@query("""SELECT doc_id, part, name, "offset", length, description, CASE WHEN part = 1 THEN CAST(doc_id + 1 AS VARCHAR) END AS width, CASE WHEN part = 1
THEN 'RGB' END AS color FROM documents,
(SELECT unnest([0, 1, 2]) AS part, unnest(['PNG Signature', 'IHDR', 'IEND']) AS name, unnest([0, 8, 33])::BIGINT AS "offset", unnest([8, 25,
12])::BIGINT AS length, unnest(['marks the file as PNG', 'size and pixel format', 'end of the image']) AS description)""")
def src21_layout(spark, d):
    """Parts of binary files, what they are and what they hold."""
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A" + "0000000D" + "49484452")), F.unhex(F.lpad(F.hex(F.col("doc_id") + 1), 8, "0")), F.unhex(F.lit("00000003" + "0802000000" + "00000000" + "0000000049454E44AE426082")))
    rows = layout.laid_out(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), png.alias("content")))
    return rows.select(F.col("path").cast("long").alias("doc_id"), "part", "name", "offset", "length", "description", F.col("fields")["width"].alias("width"), F.col("fields")["color"].alias("color"))


@query("SELECT n_name AS name, upper(n_name) AS text, FALSE AS cut, 'ended' AS state FROM nation")
def src22_captured(spark, d):
    """What a program writes about each file."""
    from photonlake.sources import capture

    rows = table(spark, d, "nation").select(F.col("n_name").alias("path"), F.lower("n_name").cast("binary").alias("content"))
    return capture.captured(rows, ["tr", "a-z", "A-Z"]).select(F.col("path").alias("name"), "text", "cut", "state")


@query("SELECT c_custkey, c_name FROM customer")
def snk2_batched(spark, d):
    """A table written in bounded files."""
    where = f"{shared_dir(spark)}/photonlake-batched-{uuid.uuid4().hex}"
    table(spark, d, "customer").select("c_custkey", "c_name").write.option("maxRecordsPerFile", 1000).parquet(where)
    return spark.read.parquet(where)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def snk4_sorted(spark, d):
    """A table sorted by its key, so that file statistics stand in for an index on it."""
    where = f"{shared_dir(spark)}/photonlake-sorted-{uuid.uuid4().hex}"
    tables.write_sorted(table(spark, d, "orders").select("o_orderkey", "o_custkey"), where, "o_orderkey")
    return spark.read.parquet(where).filter("o_orderkey BETWEEN 100 AND 200")


@query("SELECT c_custkey, CAST(2 AS INT) AS version FROM customer")
def snk10_published(spark, d):
    """A table replaced as a whole: readers see the old or the new one."""
    where = f"{shared_dir(spark)}/photonlake-published-{uuid.uuid4().hex}"
    for v in (1, 2):
        tables.publish(table(spark, d, "customer").select("c_custkey", F.lit(v).alias("version")), where)
    return spark.read.parquet(where)


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'patched' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def snk11_patched(spark, d):
    """A patch that is checked before it takes the table's place."""
    where = f"{shared_dir(spark)}/photonlake-patched-{uuid.uuid4().hex}"
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    patch = old.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("patched").alias("c_mktsegment"), F.lit(1).alias("seq"))
    n = old.count()
    tables.publish(tables.upserted(old, patch, "c_custkey", "seq"), where, check=lambda df: df.count() == n)
    return spark.read.parquet(where)


@query(f"""{WITH}, n AS (SELECT DISTINCT file_name, is_video FROM frames), g AS (SELECT file_name FROM n WHERE file_name LIKE 'c1/d0/%'),
s AS (SELECT a.file_name AS master, b.file_name, b.is_video FROM n a JOIN n b ON split_part(a.file_name, '/', 2) = split_part(b.file_name, '/', 2)
AND length(a.file_name) = length(b.file_name) AND a.file_name <> b.file_name AND right(replace(a.file_name, '.jpg', ''),
1) = right(replace(b.file_name, '.jpg', ''), 1)),
m AS (SELECT file_name FROM g UNION SELECT s.file_name FROM s JOIN g ON s.master = g.file_name WHERE NOT s.is_video) SELECT f.vec_id FROM frames f
JOIN m ON f.file_name = m.file_name WHERE NOT f.is_video""")
def sim6_seed_vectors(spark, d):
    """Vectors of a person: of the seed file, its group and their similar images (here: files of one folder whose names are as long and end alike)."""
    rows = FRAMES.df(spark, d)
    names = rows.select("file_name", "is_video").distinct()
    group = names.filter("file_name LIKE 'c1/d0/%'").select(F.col("file_name").alias("node"), F.lit("g").alias("root"))
    keys = names.selectExpr("file_name", "is_video", "split_part(file_name, '/', 2) AS folder", "length(file_name) AS n", "right(replace(file_name, '.jpg', ''), 1) AS tail")
    similar = keys.selectExpr("file_name AS master", "folder", "n", "tail").join(keys, ["folder", "n", "tail"]).filter("master <> file_name").select("master", "file_name", "is_video")
    return search.seed_frames(rows, "c1/d0/f5.jpg", group, similar).select("vec_id")


_COUNTS = "doc_id, CAST(doc_id % 90 AS INT) AS keypoints_a, CAST(n_chars % 70 AS INT) AS keypoints_b, CAST(doc_id % 50 AS INT) AS good, CAST(least(doc_id % 50, n_chars % 45) AS INT) AS inliers"


@query(f"""SELECT doc_id, CASE WHEN good > 0 THEN CAST(inliers AS DOUBLE) / good ELSE 0.0 END AS ratio, CASE WHEN least(keypoints_a, keypoints_b) > 0
THEN CAST(inliers AS DOUBLE) / least(keypoints_a, keypoints_b) ELSE 0.0 END AS score,
inliers >= 10 AND good > 0 AND CAST(inliers AS DOUBLE) / good >= 0.75 AS ok FROM (SELECT {_COUNTS} FROM documents)""")
def sim14_pair_metrics(spark, d):
    """Figures of pairs of images out of counts of keypoints, good matches and inliers that a matcher gave; counts may be 0."""
    return search.pair_metrics(table(spark, d, "documents").selectExpr(*_COUNTS.split(", CAST")[:1], *["CAST" + x for x in _COUNTS.split(", CAST")[1:]])).select("doc_id", "ratio", "score", "ok")


#: Images made of vectors: 25 rows of `embeddings` are the keypoints of one (a), with places by their ids. Its candidate 0 is turned by 90 degrees and moved, has noise in its descriptors and every
#: fifth keypoint elsewhere; candidate 1 has every second one elsewhere; candidate 2 has the descriptors of other images, so nothing matches.
_POINTS = """k AS (SELECT CAST(floor(vec_id / 25) AS BIGINT) AS g, vec_id, embedding, CAST((vec_id * 37) % 640 AS DOUBLE) AS x, CAST((vec_id * vec_id * 13 + vec_id * 91) % 480 AS DOUBLE) AS y FROM embeddings),
c AS (SELECT g, vec_id, n, embedding, 500 - y + CASE WHEN (n = 0 AND vec_id % 5 = 0) OR (n = 1 AND vec_id % 2 = 0) THEN 300 + (vec_id * 53) % 200 ELSE 0 END AS x, x + 7 + CASE WHEN n = 1 AND vec_id % 2 = 0 THEN 100 + (vec_id * 29) % 300 ELSE 0 END AS y,
(n = 0 AND vec_id % 5 = 0) OR (n = 1 AND vec_id % 2 = 0) OR n = 2 AS elsewhere FROM k CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) t)"""
_APART = "sqrt(list_sum(list_transform(list_zip(k.embedding, c.embedding, range(len(k.embedding))), lambda p: pow(CAST(p[1] AS DOUBLE) - (CASE WHEN c.n = 2 THEN -CAST(p[2] AS DOUBLE) ELSE CAST(p[2] AS DOUBLE) END + 0.01 * ((p[3] + c.vec_id) % 3 - 1)), 2))))"
_MATCHED = f"""WITH {_POINTS}, d AS (SELECT k.g, c.n, k.vec_id, c.vec_id AS other, c.elsewhere, {_APART} AS d FROM k JOIN c ON k.g = c.g),
r AS (SELECT *, row_number() OVER (PARTITION BY g, n, vec_id ORDER BY d, other) AS place, lead(d) OVER (PARTITION BY g, n, vec_id ORDER BY d, other) AS next FROM d),
s AS (SELECT g, n, count(*) AS keypoints, count(*) FILTER (d < 0.75 * next) AS good, count(*) FILTER (d < 0.75 * next AND vec_id = other AND NOT elsewhere) AS agree FROM r WHERE place = 1 GROUP BY g, n)"""


def _images(spark, d):
    """Pairs and features of the images made of vectors."""
    rows = table(spark, d, "embeddings").selectExpr("CAST(floor(vec_id / 25) AS BIGINT) AS g", "vec_id", "embedding", "CAST((vec_id * 37) % 640 AS DOUBLE) AS x", "CAST((vec_id * vec_id * 13 + vec_id * 91) % 480 AS DOUBLE) AS y")
    n, i = F.col("n"), F.col("vec_id")
    moved = ((n == 0) & (i % 5 == 0)) | ((n == 1) & (i % 2 == 0))
    noise = lambda v, at: F.when(n == 2, -v.cast("double")).otherwise(v.cast("double")) + 0.01 * ((at + i) % 3 - 1)
    made = rows.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        F.concat(F.lit("c"), "g", F.lit("-"), "n").alias("file_name"), "vec_id", (500 - F.col("y") + F.when(moved, 300 + (i * 53) % 200).otherwise(0)).alias("x"),
        (F.col("x") + 7 + F.when((n == 1) & (i % 2 == 0), 100 + (i * 29) % 300).otherwise(0)).alias("y"), F.transform("embedding", noise).alias("descriptor"),
    )
    own = rows.select(F.concat(F.lit("a"), "g").alias("file_name"), "vec_id", "x", "y", F.transform("embedding", lambda v: v.cast("double")).alias("descriptor"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x", "y", "descriptor"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["descriptor"].alias("descriptor")))
    features = own.unionByName(made).groupBy("file_name").agg(listed.alias("keypoints"))
    pairs = rows.select("g").distinct().withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("g", "n", F.concat(F.lit("a"), "g").alias("file_name"), F.concat(F.lit("c"), "g", F.lit("-"), "n").alias("candidate"))
    return pairs, features


@query(_MATCHED + """ SELECT g, n, CAST(keypoints AS INT) AS keypoints, CAST(good AS INT) AS good, CAST(CASE WHEN good < 4 THEN 0 ELSE agree END AS INT) AS inliers,
CASE WHEN good > 0 THEN CASE WHEN good < 4 THEN 0 ELSE agree END / CAST(good AS DOUBLE) ELSE 0.0 END AS ratio, CASE WHEN good < 4 THEN 0 ELSE agree END / CAST(keypoints AS DOUBLE) AS score,
good >= 4 AND agree >= 10 AND agree / CAST(good AS DOUBLE) >= 0.75 AS ok FROM s""")
def sim14_matched(spark, d):
    """Descriptors of pairs of images matched, and the matches that one homography explains: turned and moved copies with noise and strays."""
    pairs, features = _images(spark, d)
    return descriptors.matched(pairs, features).select("g", "n", F.col("keypoints_a").alias("keypoints"), "good", "inliers", "ratio", "score", "ok")


@query(_MATCHED + """, o AS (SELECT *, agree / CAST(good AS DOUBLE) AS ratio, agree / CAST(keypoints AS DOUBLE) AS score FROM s WHERE good >= 4 AND agree >= 10 AND agree / CAST(good AS DOUBLE) >= 0.4)
SELECT concat('a', g) AS file_name, concat('c', g, '-', n) AS candidate, CAST(agree AS INT) AS inliers FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY agree DESC, score DESC, n) AS place FROM o) WHERE place = 1""")
def topk4_verified(spark, d):
    """The candidate of each image that its keypoints confirm best."""
    pairs, features = _images(spark, d)
    return descriptors.best_candidates(descriptors.matched(pairs, features, least_ratio=0.4)).select("file_name", "candidate", "inliers")
