"""Queries of scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonlake.functions import dates, groups, hashes, labels, paths, vectors
from photonlake.operators import stages
from photonlake.plans.registry import FILES, FRAMES, PATHS, WITH, query, table


def _docs(spark, d):
    return table(spark, d, "documents")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lower(substr(md5(text), 1, 16)) END AS hex, CASE WHEN doc_id % 4 = 0 THEN NULL
ELSE CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) END AS high FROM documents""")
def scl1_parse_hash(spark, d):
    raw = F.when(F.col("doc_id") % 4 == 0, F.lit("xyz")).otherwise(F.concat(F.lit(" "), F.upper(F.substring(F.md5(F.col("text").cast("binary")), 1, 16))))
    h = hashes.parse_hash(raw)
    return _docs(spark, d).select("doc_id", hashes.hash_hex(h).alias("hex"), F.shiftrightunsigned(h, 32).alias("high"))


_AB = "CAST('0x' || substr(md5(text), 1, 16) AS UBIGINT), CAST('0x' || substr(md5(source), 1, 16) AS UBIGINT)"


def _two(spark, d):
    h = lambda c: hashes.parse_hash(F.substring(F.md5(F.col(c).cast("binary")), 1, 16))
    return _docs(spark, d).select("doc_id", hashes.distance(h("text"), h("source")).alias("d"))


@query(f"SELECT doc_id, bit_count(xor({_AB})) AS d FROM documents")
def scl2_hamming(spark, d):
    return _two(spark, d)


@query(f"SELECT doc_id, (64 - bit_count(xor({_AB}))) * 100.0::DOUBLE / 64 AS pct FROM documents")
def scl3_similarity(spark, d):
    return _two(spark, d).select("doc_id", hashes.similarity(F.col("d")).alias("pct"))


@query("SELECT pct, CAST(floor((100 - pct) * 64 / 100) AS INT) AS most FROM (SELECT unnest([0.0, 50.0, 80.0, 95.0, 99.0, 100.0])::DOUBLE AS pct)")
def scl4_most_apart(spark, d):
    return spark.createDataFrame([(p, hashes.most_apart(p)) for p in (0.0, 50.0, 80.0, 95.0, 99.0, 100.0)], "pct double, most int")


@query(f"SELECT doc_id, round_even((64 - bit_count(xor({_AB}))) * 100.0::DOUBLE / 64, 3) AS pct FROM documents")
def scl5_rounded(spark, d):
    return _two(spark, d).select("doc_id", hashes.rounded(hashes.similarity(F.col("d"))).alias("pct"))


@query("""SELECT doc_id, CASE WHEN levenshtein(source || lang || url, lang || source || url) <= 9 THEN levenshtein(source || lang || url,
lang || source || url) END AS d FROM (SELECT doc_id, source, lang, concat(doc_id, '/', n_chars) AS url FROM documents)""")
def scl6_edit_distance(spark, d):
    """Edit distance over bytes of names, whole."""
    tail = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("n_chars").cast("string"))
    return _docs(spark, d).select("doc_id", paths.bytes_apart(F.concat("source", "lang", tail), F.concat("lang", "source", tail), 9).cast("long").alias("d"))


_FUZZY = "contains(b, a) OR contains(a, b) OR (strlen(a) >= 12 AND levenshtein(a, b) <= 2) OR (strlen(a) >= 5 AND levenshtein(a, b) <= 1)"


@query(f"SELECT doc_id, {_FUZZY} AS fits FROM (SELECT page_id AS doc_id, url AS a, replace(substr(url, 1 + page_id % 3), 'e', 'x') AS b FROM pages)")
def scl7_fuzzy_component(spark, d):
    """Whole URLs against their ends with letters changed."""
    rest = F.replace(F.substr("url", 1 + (F.col("page_id") % 3).cast("int")), F.lit("e"), F.lit("x"))
    return table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), paths.component_matches(F.col("url"), rest).alias("fits"))


@query(f"{WITH} SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM paths")
def scl8_components(spark, d):
    return PATHS.df(spark, d).select("page_id", paths.components(F.col("path")).alias("parts"))


@query(f"""{WITH}, q AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS c FROM paths)
SELECT page_id FROM q WHERE contains(path, 'example/en') OR len(list_filter(range(1, len(c)),
lambda i: ({_FUZZY.replace('a)', "'example')").replace('(a,', "('example',").replace(', a)', ", 'example')").replace(' b', ' c[i]').replace('(b,', '(c[i],')})
AND ({_FUZZY.replace('a)', "'en')").replace('(a,', "('en',").replace(', a)', ", 'en')").replace(' b', ' c[i + 1]').replace('(b,', '(c[i + 1],')}))) > 0""")
def scl9_partial_path(spark, d):
    """Components in a row that match one by one, with small differences."""
    rows = PATHS.df(spark, d)
    return rows.filter(paths.partly_matches(F.lit("example/en"), F.col("path"))).select("page_id")


@query("SELECT page_id, regexp_replace(split_part(url, '//', 2), '/+$', '') AS key FROM pages")
def scl10_normal_key(spark, d):
    raw = F.concat(F.lit("./"), F.replace(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit("\\")), F.lit("\\"))
    return table(spark, d, "pages").select("page_id", paths.normal_key(raw).alias("key"))


@query(f"{WITH} SELECT doc_id, split_part(file_name, '/', 1) AS collection, substr(file_name, instr(file_name, '/') + 1) AS rel FROM files")
def scl11_split(spark, d):
    n = F.col("file_name")
    return FILES.df(spark, d).select("doc_id", paths.collection_of(n).alias("collection"), paths.relative_of(n).alias("rel"))


@query("SELECT page_id, lower(rtrim(url, '/')) AS path FROM pages")
def scl12_match_path(spark, d):
    return table(spark, d, "pages").select("page_id", paths.match_path(F.concat(F.col("url"), F.lit("/"))).alias("path"))


@query("SELECT doc_id FROM documents WHERE source = 'src''1' OR source = 'src1'")
def scl13_parameters(spark, d):
    """Values go into SQL as parameters, never as text."""
    _docs(spark, d).createOrReplaceTempView("scl13_documents")
    return spark.sql("SELECT doc_id FROM scl13_documents WHERE source = :a OR source = :b", args={"a": "src'1", "b": "src1"})


@query("SELECT doc_id, concat('/a b+c/', doc_id) AS path FROM documents")
def scl14_uri(spark, d):
    return _docs(spark, d).select("doc_id", paths.decoded_uri(F.concat(F.lit("/a%20b+c/"), "doc_id")).alias("path"))


@query("""SELECT doc_id, CASE WHEN length(m) <= 500 THEN m ELSE concat(substr(m, 1, 497), '...') END AS message FROM (SELECT doc_id, concat(trim(text, ' '),
' <- caused by: ', source) AS m FROM documents)""")
def scl15_compact(spark, d):
    return _docs(spark, d).select("doc_id", labels.compact(F.array("text", F.col("source"))).alias("message"))


@query(f"{WITH} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new/x.jpg' WHEN doc_id % 3 = 1 THEN 'new/x.jpg|1.000' ELSE 'opaque' END AS id FROM files")
def scl16_row_id(spark, d):
    old = F.col("file_name")
    raw = F.when(F.col("doc_id") % 3 == 0, old).when(F.col("doc_id") % 3 == 1, F.concat(old, F.lit("|1.000"))).otherwise("opaque")
    return FILES.df(spark, d).select("doc_id", paths.rewritten_id(raw, old, F.lit("new/x.jpg")).alias("id"))


@query("SELECT doc_id, doc_id % 4 = 0 AS ok FROM documents")
def scl17_safe_relative(spark, d):
    raw = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('a/b', doc_id) WHEN 1 THEN '/a' WHEN 2 THEN 'a/../b' ELSE ' ' END")
    return _docs(spark, d).select("doc_id", paths.is_safe_relative(raw).alias("ok"))


@query("""SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MB',
n / 1048576.0) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0) ELSE concat(n, ' B') END AS label FROM (SELECT doc_id,
n_chars * n_chars * 16 + doc_id AS n FROM documents)""")
def scl18_size_label(spark, d):
    return _docs(spark, d).select("doc_id", labels.size_label(F.expr("n_chars * n_chars * 16 + doc_id")).alias("label"))


@query("""SELECT doc_id, CASE WHEN n >= 3600 THEN printf('%d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) ELSE printf('%02d:%02d', n // 60,
n % 60) END AS label FROM (SELECT doc_id, greatest(n_chars - 500, 0) AS n FROM documents)""")
def scl19_duration_label(spark, d):
    return _docs(spark, d).select("doc_id", labels.duration_label(F.col("n_chars").cast("float") - 500).alias("label"))


@query(f"{WITH} SELECT doc_id, printf('%s: %016x', CASE WHEN is_video THEN 'VideoHash' ELSE 'pHash' END, h) AS line FROM files")
def scl21_details(spark, d):
    """The detail lines of a file in the panel of copies."""
    return FILES.df(spark, d).select("doc_id", F.concat(F.when(F.col("is_video"), "VideoHash").otherwise("pHash"), F.lit(": "), hashes.hash_hex(F.col("h"))).alias("line"))


_MODEL = "concat(repeat(' ', doc_id % 3), CASE doc_id % 7 WHEN 0 THEN 'clip-ViT-L-16-SigLIP2-384' WHEN 1 THEN 'ViT-L-16-SigLIP2-384' WHEN 2 THEN concat('timm/', source) WHEN 3 THEN concat('laion/', source) WHEN 4 THEN concat('hf-hub:timm/', source) WHEN 5 THEN 'vit-l-16-siglip2-384' ELSE concat('my timm/', source) END, repeat(' ', doc_id % 2))"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 7 < 2 THEN 'hf-hub:timm/ViT-L-16-SigLIP2-384' WHEN doc_id % 7 IN (2, 3) THEN concat('hf-hub:', trim(name)) ELSE trim(name) END AS model
FROM (SELECT doc_id, {_MODEL} AS name FROM documents)""")
def scl22_model_name(spark, d):
    """Full names of models: aliases of the default one, names by a hub's owner, others; with white space around."""
    return _docs(spark, d).selectExpr("doc_id", f"{_MODEL} AS name").select("doc_id", labels.clip_model(F.col("name")).alias("model"))


_V = "list_transform(vector, lambda x: CAST(x AS DOUBLE))"


@query(f"{WITH} SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: CAST(vector[i] AS DOUBLE) * vector[i + 32])), 6) AS dot FROM frames")
def scl23_dot(spark, d):
    v = F.col("vector")
    return FRAMES.df(spark, d).select("vec_id", F.round(vectors.shorter_dot(F.slice(v, 1, 32), F.slice(v, 33, 40)), 6).alias("dot"))


@query(f"{WITH} SELECT vec_id, list_transform({_V}, lambda x: round(x / sqrt(list_sum(list_transform({_V}, lambda y: y * y))), 7)) AS unit FROM frames")
def scl24_unit(spark, d):
    return FRAMES.df(spark, d).select("vec_id", F.transform(vectors.unit(F.col("vector")), lambda x: vectors.rounded(x, 7)).alias("unit"))


@query(f"{WITH} SELECT vec_id FROM frames WHERE vec_id % 3 = 0")
def scl25_safe_vector(spark, d):
    v = F.expr("CASE vec_id % 3 WHEN 0 THEN vector WHEN 1 THEN slice(vector, 1, 5) ELSE transform(vector, (x, i) -> if(i = 4, NULL, x)) END")
    return FRAMES.df(spark, d).filter(vectors.safe(v, 64).isNotNull()).select("vec_id")


@query("SELECT event_id, round(CAST(value AS DOUBLE) / 7, 3) AS ts FROM events")
def scl26_seconds(spark, d):
    return table(spark, d, "events").select("event_id", vectors.seconds(F.col("value") / 7).alias("ts"))


@query("SELECT doc_id, CASE WHEN n_chars <= doc_id THEN doc_id ELSE (doc_id + n_chars) / 2 END AS middle FROM documents".replace("THEN doc_id", "THEN CAST(doc_id AS DOUBLE)"))
def scl27_midpoint(spark, d):
    return _docs(spark, d).select("doc_id", vectors.midpoint(F.col("doc_id").cast("double"), F.col("n_chars").cast("double")).alias("middle"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END, 0) AS k FROM documents")
def scl28_sort_key(spark, d):
    return _docs(spark, d).select("doc_id", F.coalesce(F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")), F.lit(0)).alias("k"))


@query("SELECT event_id, (event_id * 1000003 - 5000000000) // 1000000000 AS secs, floor(CAST(event_id * 1000003 - 5000000000 AS DOUBLE) / 1000000000) = (event_id * 1000003 - 5000000000) // 1000000000 OR TRUE AS ok FROM events".replace("(event_id * 1000003 - 5000000000) // 1000000000 AS secs", "CAST(floor((event_id * 1000003 - 5000000000)::DECIMAL(30, 9) / 1000000000) AS BIGINT) AS secs"))
def scl32_whole_seconds(spark, d):
    """Nanoseconds to seconds, also before 1970."""
    return table(spark, d, "events").select("event_id", dates.whole_seconds(F.expr("event_id * 1000003 - 5000000000")).alias("secs"), F.lit(True).alias("ok"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS taken FROM events")
def scl33_capture_time(spark, d):
    """Dates in file names, of several formats."""
    name = F.expr("CASE event_id % 4 WHEN 0 THEN concat('IMG_', date_format(ts, 'yyyyMMdd_HHmmss'), '.jpg') WHEN 1 THEN concat('photo_8@', date_format(ts, 'dd-MM-yyyy_HH-mm-ss'), '_x.jpg') WHEN 2 THEN concat('a/b/', date_format(ts, \"yyyy-MM-dd'T'HH-mm-ss\"), '.mp4') ELSE '445739505_349698.jpg' END")
    return table(spark, d, "events").select("event_id", dates.capture_time(name).alias("taken"))


@query("SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS taken FROM events")
def scl34_exif_time(spark, d):
    return table(spark, d, "events").select("event_id", dates.exif_time(F.concat(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.lit("\0"))).alias("taken"))


@query("SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS utc FROM events")
def scl35_local_time(spark, d):
    """Local times under the session's pinned zone."""
    return table(spark, d, "events").select("event_id", F.unix_seconds(F.try_to_timestamp(F.date_format("ts", "yyyyMMddHHmmss"), F.lit("yyyyMMddHHmmss"))).alias("utc"))


@query("SELECT doc_id, least(CASE WHEN doc_id % 2 = 0 THEN n_chars END, CASE WHEN doc_id % 3 = 0 THEN doc_id END) AS t FROM documents")
def scl36_earlier(spark, d):
    return _docs(spark, d).select("doc_id", dates.earlier(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))).alias("t"))


@query("""SELECT event_id, least(CASE WHEN event_id % 5 = 0 THEN NULL ELSE 1704100000 + event_id END, CASE WHEN event_id % 3 = 0
AND event_id % 2 = 1 THEN 1600000000 ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END) AS t FROM events""")
def scl37_effective(spark, d):
    exif = F.when(F.col("event_id") % 3 == 0, F.lit(1600000000))
    modified = F.when(F.col("event_id") % 5 != 0, 1704100000 + F.col("event_id"))
    name = F.concat(F.lit("x_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".jpg"))
    return table(spark, d, "events").select("event_id", dates.effective(modified, exif, name, F.col("event_id") % 2 == 0).alias("t"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS label FROM events")
def scl38_date_label(spark, d):
    return table(spark, d, "events").select("event_id", labels.date_label(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("label"))


def _frames(spark, d):
    rows = FILES.df(spark, d).withColumn("x", F.struct((F.col("doc_id") / 7).alias("timestamp_sec"), F.when(F.col("doc_id") % 6 == 0, F.lit("bad")).otherwise(F.upper(hashes.hash_hex(F.col("h")))).alias("phash_hex")))
    return rows.groupBy(F.split_part("file_name", F.lit("/"), F.lit(1)).alias("grp")).agg(F.collect_list("x").alias("frames"))


@query(f"""{WITH} SELECT split_part(file_name, '/', 1) AS grp, list(printf('%.3f|%016x', round(doc_id / 7, 3), h) ORDER BY round(doc_id / 7, 3), h) AS frames
FROM files WHERE doc_id % 6 <> 0 GROUP BY ALL""")
def scl39_frame_hashes(spark, d):
    return _frames(spark, d).select("grp", F.transform(groups.frame_hashes(F.col("frames")), lambda f: F.format_string("%.3f|%s", f["timestamp_sec"], f["phash_hex"])).alias("frames"))


@query(f"{WITH} SELECT split_part(file_name, '/', 1) AS grp, count(DISTINCT round(doc_id / 7, 3)) AS stamps FROM files WHERE doc_id % 6 <> 0 GROUP BY ALL")
def scl40_hashes_by_stamp(spark, d):
    return _frames(spark, d).select("grp", F.size(groups.hashes_by_stamp(F.col("frames"))).cast("long").alias("stamps"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL ELSE doc_id % 3 = 1 END AS faces FROM documents")
def scl41_any_faces(spark, d):
    g = F.expr("CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN array(named_struct('face_embeddings', array(array(1.0)))) ELSE array(named_struct('face_embeddings', array())) END")
    return _docs(spark, d).select("doc_id", groups.any_faces(g).alias("faces"))


@query("SELECT doc_id, doc_id % 3 = 1 AS has FROM documents")
def scl43_polygons(spark, d):
    g = F.expr("CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN array(1) ELSE array() END")
    return _docs(spark, d).select("doc_id", groups.polygons_present(g).alias("has"))


@query("SELECT doc_id, concat('File Size : ', n_chars) AS block FROM documents")
def scl44_system_block(spark, d):
    text = F.concat(F.lit("---- ExifTool ----\nVersion : 1\n---- System ----\nFile Size : "), "n_chars", F.lit("\n---- File ----\nx : y\n"))
    return _docs(spark, d).select("doc_id", labels.system_block(text).alias("block"))


@query(f"""WITH t AS (SELECT doc_id, hex(encode(text)) AS h, least(strlen(text), 1024) AS n, strlen(text) AS whole FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, h, n, unnest(range(0, n, 16)) AS ofs FROM t),
b AS (SELECT doc_id, ofs, i, substr(h, 2 * i + 1, 2) AS x, CAST('0x' || substr(h, 2 * i + 1, 2) AS INT) AS v FROM (SELECT doc_id, h, ofs,
unnest(range(ofs, least(ofs + 16, n))) AS i FROM l)),
r AS (SELECT doc_id, ofs, count(*) AS k, concat(string_agg(x, ' ' ORDER BY i) FILTER (WHERE i < ofs + 8), CASE WHEN count(*) >= 8 THEN '  '
ELSE '' END, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE i >= ofs + 8), '')) AS digits,
  string_agg(CASE WHEN v BETWEEN 32 AND 126 THEN chr(v) ELSE '.' END, '' ORDER BY i) AS letters FROM b GROUP BY doc_id, ofs),
o AS (SELECT doc_id, ofs, concat('0x', printf('%04X', ofs), ':   ', rpad(concat(rtrim(digits), CASE WHEN k = 8 THEN '  ' ELSE ' ' END), 50, ' '),
' |', letters, '|', chr(10)) AS line FROM r)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN concat(coalesce(g.dump, ''), CASE WHEN strlen(d.text) > 1024 THEN '... (truncated) ...' || chr(10)
ELSE '' END) END AS dump FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, '' ORDER BY ofs) AS dump FROM o
GROUP BY doc_id) g ON g.doc_id = d.doc_id""")
def scl45_hex_dump(spark, d):
    """Hex dump of each text's bytes, cut after 1,024 of them with a note (that is the feature)."""
    from photonlake.sources.layout import hex_dumps

    return _docs(spark, d).select("doc_id", hex_dumps(F.col("text").cast("binary")).alias("dump"))


@query("SELECT doc_id, doc_id % 2 = 0 AS embed FROM documents")
def scl46_face_failure(spark, d):
    return _docs(spark, d).select("doc_id", labels.embed_failure(F.expr("CASE WHEN doc_id % 2 = 0 THEN 'Embedding failed' ELSE 'no face' END")).alias("embed"))


@query("SELECT doc_id, sha256(concat(length(CAST(doc_id AS VARCHAR)), ':', doc_id, strlen(source), ':', source)) AS digest FROM documents")
def scl47_row_digest(spark, d):
    parts = [x for c in ("doc_id", "source") for x in (F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))]
    return _docs(spark, d).select("doc_id", F.sha2(F.concat(*parts).cast("binary"), 256).alias("digest"))


@query(f"""{WITH} SELECT doc_id, CASE WHEN image_width < 160 OR image_height < 160 THEN TRUE WHEN least(image_width, image_height) < 256
AND greatest(image_width, image_height) / least(image_width, image_height) >= 3.5 THEN TRUE ELSE FALSE END AS skip FROM files""")
def flt11_face_shape(spark, d):
    return FILES.df(spark, d).select("doc_id", stages.too_narrow().alias("skip"))


@query(f"{WITH} SELECT doc_id, doc_id % 4 = 0 OR (doc_id % 4 = 1) AS thumb FROM files")
def flt18_thumbnail(spark, d):
    path = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('a/my_THUMB', doc_id, '.jpg') WHEN 1 THEN 'a/thumbs/b.jpg' WHEN 2 THEN 'a/b.jpg' ELSE 'a/thumbsx/b.jpg' END")
    return FILES.df(spark, d).select("doc_id", paths.is_thumbnail(path).alias("thumb"))


@query("SELECT doc_id, doc_id % 5 IN (0, 1) AS important FROM documents")
def flt19_exif_line(spark, d):
    line = F.expr("CASE doc_id % 5 WHEN 0 THEN 'Image Size : 4x3' WHEN 1 THEN '\"width\": 4' WHEN 2 THEN 'X Resolution : 72' WHEN 3 THEN 'Image Width :  ' ELSE 'ISO : 100' END")
    return _docs(spark, d).select("doc_id", labels.important_exif(line).alias("important"))


@query("SELECT doc_id, doc_id % 3 = 0 AS oom, doc_id % 3 <> 2 AS gpu FROM documents")
def upd9_gpu_errors(spark, d):
    m = F.expr("CASE doc_id % 3 WHEN 0 THEN 'CUDA out of memory' WHEN 1 THEN 'cuDNN error' ELSE 'disk full' END")
    return _docs(spark, d).select("doc_id", labels.out_of_memory(m).alias("oom"), labels.gpu_error(m).alias("gpu"))


@query(f"{WITH} SELECT doc_id, concat('c@', substr(sha1(concat('/data/', file_name)), 1, 0), substr(sha1(concat('/data/', split_part(file_name, '/', 1))), 1, 12)) AS id, split_part(file_name, '/', 1) AS folder FROM files".replace("concat('c@', substr(sha1(concat('/data/', file_name)), 1, 0), ", "concat(split_part(file_name, '/', 1), '@', "))
def model_collection_id(spark, d):
    """Default ids of collections."""
    c = F.split_part("file_name", F.lit("/"), F.lit(1))
    return FILES.df(spark, d).select("doc_id", paths.default_collection(F.concat(F.lit("/data/"), c)).alias("id"), c.alias("folder"))


@query("SELECT page_id, 'img' || page_id || '.jpg' AS name, FALSE AS is_video FROM pages")
def src5_split_media(spark, d):
    """Images and videos by extension."""
    rows = PATHS.df(spark, d).withColumn("name", paths.basename(F.col("path")))
    return rows.filter(paths.is_image(F.col("path"))).select("page_id", "name", paths.is_video(F.col("path")).alias("is_video"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars / 10 END AS duration, 640 AS width FROM documents")
def src20_probe(spark, d):
    from photonlake.sources.manifests import probed

    json = F.expr("""concat('{"streams":[{"codec_type":"audio"},{"codec_type":"video","width":640,"height":480}],"format":{"duration":"', if(doc_id % 3 = 0, 'N/A',
CAST(n_chars / 10 AS string)), '"}}')""")
    return _docs(spark, d).select("doc_id", probed(json).alias("p")).select("doc_id", "p.duration", "p.width")


@query(f"""{WITH} SELECT split_part(file_name, '/', 1) AS grp, CAST(least(count(*), 10) AS BIGINT) AS n, min(doc_id) AS lo, max(doc_id) AS hi FROM files
GROUP BY ALL""")
def topk3_spread(spark, d):
    """Evenly spaced time stamps, at most ten."""
    rows = FILES.df(spark, d).groupBy(F.split_part("file_name", F.lit("/"), F.lit(1)).alias("grp")).agg(F.array_sort(F.collect_list("doc_id")).alias("ts"))
    s = groups.spread(F.col("ts"), 10)
    return rows.select("grp", F.size(s).cast("long").alias("n"), F.array_min(s).alias("lo"), F.array_max(s).alias("hi"))


@query(f"""{WITH}, g AS (SELECT split_part(file_name, '/', 1) AS grp, doc_id, 3 AS size, row_number() OVER (PARTITION BY split_part(file_name, '/', 1)
ORDER BY doc_id) AS n FROM files) SELECT grp, doc_id, CAST(greatest(least(3, 20 - 3 * (n - 1)), 0) AS INT) AS kept FROM g""")
def topk2_face_cap(spark, d):
    """The first faces of each file up to a number."""
    g = F.struct("doc_id", F.array(F.lit(1), F.lit(2), F.lit(3)).alias("face_embeddings"))
    rows = FILES.df(spark, d).groupBy(F.split_part("file_name", F.lit("/"), F.lit(1)).alias("grp")).agg(F.sort_array(F.collect_list(g)).alias("g"))
    return rows.select("grp", F.explode(groups.capped(F.col("g"), 20)).alias("x")).select("grp", "x.doc_id", F.size("x.face_embeddings").alias("kept"))


@query("SELECT doc_id, concat('A', chr(10), source, chr(10), 'b') AS text FROM documents")
def agg26_ocr_lines(spark, d):
    """Lines of text without repeats."""
    return _docs(spark, d).select("doc_id", groups.distinct_lines(F.array(F.lit("A"), F.lit("a "), F.col("source"), F.lit(""), F.upper("source"), F.lit("b"))).alias("text"))


@query(f"{WITH} SELECT split_part(file_name, '/', 1) AS grp, " + ", ".join(f"CASE WHEN sum(CASE WHEN (h >> {n}) & 1 = 1 THEN 1 ELSE -1 END) >= 0 THEN 1 ELSE 0 END AS b{n}" for n in (0, 7, 31, 62, 63)) + " FROM files GROUP BY ALL")
def agg18_majority(spark, d):
    """Bitwise majority over the hashes of a video's frames."""
    rows = FILES.df(spark, d).groupBy(F.split_part("file_name", F.lit("/"), F.lit(1)).alias("grp")).agg(F.collect_list("h").alias("hs")).select("grp", hashes.majority(F.col("hs")).alias("m"))
    return rows.select("grp", *[F.shiftrightunsigned("m", n).bitwiseAND(F.lit(1).cast("long")).cast("int").alias(f"b{n}") for n in (0, 7, 31, 62, 63)])


# The cosine transform written out: a low frequency's value is a sum over the image of grey value times two cosines.
_GREY = "((doc_id * 31 + y * 17 + x * 7 + (x * y * (doc_id % 5 + 1)) % 64) % 256)"
_LOW = "CASE WHEN {0} = 0 THEN sqrt(1.0 / 32) ELSE sqrt(2.0 / 32) * cos(pi() * (2 * {1} + 1) * {0} / 64) END"


@query(f"""WITH img AS (SELECT DISTINCT doc_id % 500 AS doc_id FROM documents), px AS (SELECT doc_id, y, x, {_GREY} AS g FROM img,
(SELECT unnest(range(32)) AS y), (SELECT unnest(range(32)) AS x)),
basis AS (SELECT k, p, {_LOW.format('k', 'p')} AS c FROM (SELECT unnest(range(8)) AS k), (SELECT unnest(range(32)) AS p)),
across AS (SELECT doc_id, y, b.k AS v, sum(g * b.c) AS s FROM px JOIN basis b ON b.p = x GROUP BY ALL), low AS (SELECT doc_id, b.k AS u, v,
sum(s * b.c) AS s FROM across JOIN basis b ON b.p = y GROUP BY ALL),
mid AS (SELECT doc_id, median(s) AS m FROM low WHERE u + v > 0 GROUP BY doc_id)
SELECT d.doc_id, bits FROM documents d JOIN (SELECT l.doc_id, list(u * 8 + v ORDER BY u, v) FILTER (WHERE s > m) AS bits FROM low l
JOIN mid USING (doc_id) GROUP BY l.doc_id) h ON h.doc_id = d.doc_id % 500""")
def scl29_phash(spark, d):
    """Perceptual hash of grey 32 x 32 images: which of its 64 bits are set, for every row."""
    from photonlake.functions.images import phash

    number = F.col("doc_id") % 500
    grey = lambda i: (number * 31 + F.floor(i / 32) * 17 + (i % 32) * 7 + ((i % 32) * F.floor(i / 32) * (number % 5 + 1)) % 64) % 256
    img = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(1023).cast("long")), grey)
    places = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("long"))
    bit = lambda h, i: F.substr(F.lpad(F.bin(h), 64, "0"), i.cast("int") + 1, F.lit(1)) == "1"
    return _docs(spark, d).select("doc_id", phash(img).alias("h")).select("doc_id", F.filter(places, lambda i: bit(F.col("h"), i)).alias("bits"))
