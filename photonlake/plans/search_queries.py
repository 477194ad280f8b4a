"""Queries of search: scans, filters, similarity, ranks."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from photonlake.functions import paths, vectors
from photonlake.operators import path_index, search, tables, text_index, vector_index
from photonlake.plans.registry import EDGES, FILES, FRAMES, PATHS, WITH, query, table
from photonlake.plans.storage import shared_dir

DOT = "round(list_sum(list_transform(list_zip(f.vector, q.vector), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 5)"
NORM = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def _vectors(spark, d: str, *vec_ids: int) -> list[list[float]]:
    """The vectors of some rows: queries given by the user."""
    rows = table(spark, d, "embeddings").filter(F.col("vec_id").isin(*vec_ids)).select("vec_id", "embedding").collect()
    return [[float(x) for x in r.embedding] for r in sorted(rows, key=lambda r: r.vec_id)]


def _vector(spark, d: str, vec_id: int) -> list[float]:
    return _vectors(spark, d, vec_id)[0]


def _search(score: str, where: str, least: float, ids: str = "0") -> str:
    return f"""{WITH}, scored AS (SELECT f.file_name, f.is_video, f.timestamp_sec, max({score}) AS score FROM frames f, frames q WHERE q.vec_id IN ({ids})
AND {where} GROUP BY ALL),
    best AS (SELECT file_name, unnest(max_by(struct_pack(is_video := is_video, timestamp_sec := timestamp_sec, score := score),
struct_pack(a := score, b := -timestamp_sec))) FROM scored WHERE score >= {least} GROUP BY file_name)
    SELECT file_name, is_video, timestamp_sec, score, CAST(row_number() OVER (ORDER BY score DESC, file_name) AS INT) AS rank FROM best"""


COSINE = f"round(list_sum(list_transform(list_zip(f.vector, q.vector), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / ({NORM.format('f.vector')} * {NORM.format('q.vector')}), 5)"


@query(_search(DOT, "TRUE", 0.0))
def sim1_clip_topk(spark, d):
    """Exact search by a vector."""
    return search.search(FRAMES.df(spark, d), _vector(spark, d, 0), 0.0)


@query(_search(COSINE, "TRUE", 0.1))
def sim2_clip_cosine(spark, d):
    return search.search(FRAMES.df(spark, d), _vector(spark, d, 0), 0.1, metric="cosine")


@query(_search(DOT, "f.is_video", 0.05))
def flt2_video_only(spark, d):
    return search.search(FRAMES.df(spark, d), _vector(spark, d, 0), 0.05, video_only=True)


@query(_search(DOT, "TRUE", 0.25))
def flt1_threshold(spark, d):
    return search.search(FRAMES.df(spark, d), _vector(spark, d, 0), 0.25)


@query(_search(DOT, "contains(list_extract(string_split(f.file_name, '/'), 2), 'd3')", 0.0))
def flt3_folder(spark, d):
    """Search within a folder."""
    return search.search(FRAMES.df(spark, d), _vector(spark, d, 0), 0.0, folder="D3")


@query(_search(DOT, "f.file_name LIKE 'c1/d2/%'", 0.0))
def flt3_folder_path(spark, d):
    return search.search(FRAMES.df(spark, d), _vector(spark, d, 0), 0.0, folder="c1/d2")


@query(_search(DOT.replace("CAST(p[1] AS DOUBLE)", f"CAST(p[1] AS DOUBLE) / {NORM.format('f.vector')}"), "TRUE", 0.3, "0, 1, 2"))
def sim3_face_multi(spark, d):
    """Search by several vectors of one face."""
    return search.search_any(FRAMES.df(spark, d), _vectors(spark, d, 0, 1, 2))


@query(_search(COSINE, "TRUE", 0.3, "3, 4, 5"))
def sim4_face_cosine(spark, d):
    return search.search_any(FRAMES.df(spark, d), _vectors(spark, d, 3, 4, 5), metric="cosine")


def _indexed(spark, d):
    """Frames in a vector index; every seventeenth has no vector."""
    rows = FRAMES.df(spark, d).select(F.col("vec_id").alias("id"), "file_name", "is_video", "timestamp_sec", F.when(F.col("vec_id") % 17 != 0, F.col("vector")).alias("vector"))
    path = f"{shared_dir(spark)}/photonlake-index-{uuid.uuid4().hex}"
    vector_index.build(rows, path, 64)
    return rows, path


_NULL = f"CASE WHEN f.vec_id % 17 = 0 THEN 0.0 ELSE {COSINE} END"


@query(_search(_NULL, "TRUE", 0.0, "1"))
def sim2_index(spark, d):
    """Threshold search in the index, from the cells that can hold results; frames without a vector score 0."""
    _, path = _indexed(spark, d)
    return vector_index.search_or_scan(spark, path, FRAMES.df(spark, d), _vector(spark, d, 1), 0.0)


@query(_search(DOT, "f.is_video", 0.2, "1"))
def sim2_fallback(spark, d):
    """An index can't tell videos, so frames are scanned."""
    _, path = _indexed(spark, d)
    return vector_index.search_or_scan(spark, path, FRAMES.df(spark, d), _vector(spark, d, 1), 0.2, video_only=True)


@query(_search(COSINE, "f.vec_id % 17 <> 0", 0.3, "3, 4, 5"))
def sim4_index_union(spark, d):
    """A search in the index for each of several faces, the best score of each file."""
    _, path = _indexed(spark, d)
    return vector_index.search_index(spark, path, _vectors(spark, d, 3, 4, 5), 0.3)


@query(f"""{WITH}, s AS (SELECT q.vec_id AS query, f.vec_id AS id, {COSINE} AS score FROM frames f, frames q WHERE q.vec_id % 50 = 1 AND q.vec_id % 17 <> 0 AND f.vec_id % 17 <> 0)
SELECT query, id, score, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS n FROM s) WHERE n <= 64""")
def snk4_index_exact(spark, d):
    """The 64 nearest by the index in exact mode."""
    rows, path = _indexed(spark, d)
    asked = rows.filter("id % 50 = 1").select(F.col("id").alias("query"), "vector")
    return vector_index.nearest(*vector_index.opened(spark, path), asked, 64, exact=True)


@query(f"""{WITH} SELECT count(*) AS queries, TRUE AS recalled FROM frames WHERE vec_id % 50 = 1 AND vec_id % 17 <> 0""")
def snk4_index_recall(spark, d):
    """Whether the index as fitted finds nine in ten of the 64 nearest that its exact mode finds."""
    rows, path = _indexed(spark, d)
    asked = rows.filter("id % 50 = 1").select(F.col("id").alias("query"), "vector")
    opened = vector_index.opened(spark, path)
    true, found = (vector_index.nearest(*opened, asked, 64, exact=e).select("query", "id") for e in (True, False))
    both = true.withColumn("hit", F.lit(0)).unionByName(found.withColumn("hit", F.lit(1))).groupBy("query", "id").agg(F.count_if(F.col("hit") == 0).alias("t"), F.count_if(F.col("hit") == 1).alias("f"))
    return both.agg(F.count_distinct("query").alias("queries"), (F.sum(F.when(F.col("t") > 0, F.col("f")).otherwise(0)) >= 0.9 * F.sum("t")).alias("recalled"))


@query(f"""WITH base AS ({_search(DOT, "f.file_name <> 'c1/d0/f5.jpg'", 0.1, "16")})
SELECT file_name, is_video, timestamp_sec, score, rank + 1 AS rank FROM base UNION ALL SELECT 'c1/d0/f5.jpg', FALSE, 1.0, 1.0, 1""")
def sim5_more_like_this(spark, d):
    """Search by a file's own frame, which comes first."""
    return search.more_like(FRAMES.df(spark, d), "c1/d0/f5.jpg", 1.1, 0.1)


@query(_search(DOT, "f.file_name <> 'c0/d0/f0.mp4'", 0.0))
def flt16_without_seed(spark, d):
    return search.ranked(search.search(FRAMES.df(spark, d), _vector(spark, d, 0)).filter("file_name <> 'c0/d0/f0.mp4'").drop("rank"))


@query(f"""{WITH}, s AS (SELECT f.vec_id AS left_id, q.vec_id AS right_id, {DOT} AS score FROM frames f, frames q WHERE f.file_name = 'c1/d0/f5.jpg'
AND q.file_name = 'c2/d1/f6.jpg')
SELECT * FROM s ORDER BY score DESC, left_id, right_id LIMIT 1""")
def sim7_best_pair(spark, d):
    """The most alike pair of vectors of two files."""
    rows = FRAMES.df(spark, d).select("file_name", F.col("vec_id").alias("id"), "vector")
    return search.best_pair(rows.filter("file_name = 'c1/d0/f5.jpg'"), rows.filter("file_name = 'c2/d1/f6.jpg'"))


@query(f"""{WITH}, s AS (SELECT f.vec_id AS left_id, q.vec_id AS right_id, {DOT} AS score FROM frames f, frames q WHERE f.file_name = 'c1/d0/f5.jpg'
AND q.is_video)
SELECT q.file_name, t.left_id, t.score, concat(q.file_name, '#', q.timestamp_sec) AS image_file FROM (SELECT * FROM s WHERE score >= 0.2
ORDER BY score DESC, left_id, right_id LIMIT 1) t JOIN frames q ON q.vec_id = t.right_id""")
def sim8_photo_to_video(spark, d):
    """A photo's best match among the videos' faces, with the nearest still."""
    rows = FRAMES.df(spark, d)
    ids = rows.select(F.col("vec_id").alias("id"), "vector", "is_video", "file_name")
    best = search.best_pair(ids.filter("file_name = 'c1/d0/f5.jpg'"), ids.filter("is_video")).filter("score >= 0.2")
    wanted = best.join(rows, F.col("right_id") == F.col("vec_id")).select("file_name", F.col("timestamp_sec").alias("seconds"), "left_id", "score")
    stills = rows.withColumn("image_file", F.concat("file_name", F.lit("#"), F.col("timestamp_sec").cast("string")))
    near = search.nearest_frame(stills, wanted.select("file_name", "seconds"))
    return wanted.join(near, ["file_name", "seconds"]).select("file_name", "left_id", "score", "image_file")


PAIRS = f"""{WITH}, u AS (SELECT file_name, vector FROM frames WHERE timestamp_sec = 0 AND NOT is_video), pairs AS (SELECT f.file_name, q.file_name AS candidate,
{COSINE} AS score FROM u f JOIN u q ON f.file_name <> q.file_name)
SELECT file_name, candidate, score, n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY file_name ORDER BY score DESC, candidate) AS INT) AS n
FROM pairs) WHERE n <= 64"""


@query(PAIRS)
def sim9_shortlist(spark, d):
    """The 64 nearest other images of each image."""
    return search.shortlist(FRAMES.df(spark, d).filter("timestamp_sec = 0 AND NOT is_video"), 64)


@query(PAIRS.replace("n <= 64", "n <= 5"))
def topk1_candidates(spark, d):
    return search.shortlist(FRAMES.df(spark, d).filter("timestamp_sec = 0 AND NOT is_video"), 5)


_OK = "(SELECT 1 FROM edges e WHERE q.file_name LIKE '%/' || e.file_name || '.jpg' AND e.checked)"


@query(PAIRS.replace("JOIN u q ON f.file_name <> q.file_name", f"JOIN u q ON f.file_name <> q.file_name AND EXISTS {_OK}"))
def join8_eligible(spark, d):
    """Shortlist within eligible files: they are chosen before the 64 nearest are."""
    files = FRAMES.df(spark, d).filter("timestamp_sec = 0 AND NOT is_video")
    ok = EDGES.df(spark, d).filter("checked").select(F.col("file_name").alias("stem")).distinct()
    eligible = files.select("file_name", F.regexp_extract("file_name", "([^/]+)[.]jpg$", 1).alias("stem")).join(ok, "stem", "left_semi")
    return search.shortlist(files, 64, eligible=eligible)


@query(f"""{WITH}, wanted AS (SELECT DISTINCT file_name, CAST(length(file_name) % 4 AS DOUBLE) * 0.7 AS seconds FROM frames)
SELECT w.file_name, w.seconds, min_by(f.vec_id, struct_pack(a := abs(f.timestamp_sec - w.seconds), b := f.timestamp_sec)) AS image_file FROM wanted w
JOIN frames f ON f.file_name = w.file_name GROUP BY ALL""")
def sim10_nearest_still(spark, d):
    """The frame nearest to a time."""
    rows = FRAMES.df(spark, d)
    wanted = rows.select("file_name", (F.length("file_name") % 4).cast("double").alias("n")).distinct().select("file_name", (F.col("n") * 0.7).alias("seconds"))
    return search.nearest_frame(rows.withColumn("image_file", F.col("vec_id")), wanted)


@query(f"{WITH} SELECT file_name, min(vec_id) AS vec_id, CAST(any_value(len(vector)) AS INT) AS dim FROM frames GROUP BY file_name")
def sim11_first_vector(spark, d):
    """The first vector of each file that isn't empty."""
    g = F.sort_array(F.collect_list(F.struct("timestamp_sec", "vec_id", "vector")))
    first = F.get(F.filter(g, lambda x: F.size(x["vector"]) > 0), F.lit(0))
    return FRAMES.df(spark, d).groupBy("file_name").agg(first.alias("f")).select("file_name", "f.vec_id", F.size("f.vector").alias("dim"))


@query(f"{WITH} SELECT len(vector) AS dim, len(vector) = 64 AS fits, count(*) AS n FROM frames GROUP BY ALL")
def sim12_dimensions(spark, d):
    """Frames whose vectors have the query's dimension."""
    return FRAMES.df(spark, d).groupBy(F.size("vector").cast("long").alias("dim"), (F.size("vector") == 64).alias("fits")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT *, TRUE AS refused FROM ({_search(DOT, "(f.vec_id % 3 <> 0 OR f.vec_id % 9 = 0)", 0.1)})""")
def sim12_guarded(spark, d):
    """A search among frames of which some have other dimensions, and whether the same search by a shortened query is refused."""
    cut = (F.col("vec_id") % 3 == 0) & (F.col("vec_id") % 9 != 0)
    frames, vector = FRAMES.df(spark, d).withColumn("vector", F.when(cut, F.slice("vector", 1, 40)).otherwise(F.col("vector"))), _vector(spark, d, 0)
    try:
        search.guarded(frames, vector[:40], 0.1)
        refused = False
    except ValueError:
        refused = True
    return search.guarded(frames, vector, 0.1).withColumn("refused", F.lit(refused))


def _text(query_: str, terms: list[str], phrase: str, quoted: bool, least: float, where: str = "TRUE") -> str:
    hits = " + ".join(f"CAST(contains(text_lower, '{t}') AS INT)" for t in terms)
    share = "1.0" if quoted else f"({hits}) / {float(len(terms))}"
    return f"""{WITH}, found AS (SELECT file_name, is_video, timestamp_sec, {hits} AS term_hits, contains(text_lower, '{phrase}') AS phrase_hit, round({share},
5) AS score FROM files WHERE {where}),
    best AS (SELECT file_name, unnest(max_by(struct_pack(is_video := is_video, timestamp_sec := timestamp_sec, score := score,
term_hits := term_hits), struct_pack(a := term_hits * 1000 + CASE WHEN term_hits = {len(terms)} THEN 100 ELSE 0 END + CASE WHEN phrase_hit THEN 10
ELSE 0 END, b := -timestamp_sec)))
      FROM found WHERE {'phrase_hit' if quoted else 'term_hits > 0'} AND score >= {least} GROUP BY file_name)
    SELECT file_name, is_video, timestamp_sec, CAST(score AS DOUBLE) AS score, term_hits, {len(terms)} AS query_terms, {quoted} AS is_phrase,
CAST(row_number() OVER (ORDER BY score DESC, file_name) AS INT) AS rank FROM best"""


@query(_text("", ["idiot", "the", "licensed"], "idiot the licensed", False, 0.5))
def scl20_ocr_terms(spark, d):
    """Text search by terms."""
    return search.search_text(FILES.df(spark, d), " idiot The LICENSED ", 0.5)


@query(_text("", ["in", "the"], "in the", True, 0.0, "NOT is_video OR is_video"))
def scl20_ocr_phrase(spark, d):
    """Text search by a phrase."""
    return search.search_text(FILES.df(spark, d), '"in the"')


def _text_index(spark, d):
    where = f"{shared_dir(spark)}/photonlake-texts-{uuid.uuid4().hex}"
    text_index.build(FILES.df(spark, d), where, blocks=16, folders=8)
    return where


@query(_text("", ["idiot", "the", "licensed"], "idiot the licensed", False, 0.5))
def scl20_index_terms(spark, d):
    """The search by terms, out of the blocks that can hold them."""
    return text_index.search_index(spark, _text_index(spark, d), " idiot The LICENSED ", 0.5)


@query(_text("", ["in", "the"], "in the", True, 0.0, "NOT is_video OR is_video"))
def scl20_index_phrase(spark, d):
    """The search by a phrase, out of the blocks that can hold it."""
    return text_index.search_index(spark, _text_index(spark, d), '"in the"')


@query(f"""{WITH}, one AS (SELECT f.file_name, f.is_video, {DOT} AS score FROM frames f, frames q WHERE q.vec_id = 0 AND f.timestamp_sec = 0), k AS (SELECT *,
CASE WHEN is_video THEN file_name ELSE split_part(file_name, '/', 2) END AS key FROM one),
top AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, file_name) AS n FROM k) SELECT file_name, is_video, score,
CAST(row_number() OVER (ORDER BY score DESC, file_name) AS INT) AS rank FROM top WHERE n = 1""")
def agg10_collapse(spark, d):
    """The best result of each group of images; videos stand alone."""
    rows = FRAMES.df(spark, d).filter("timestamp_sec = 0").withColumn("score", F.round(vectors.best_score(F.col("vector"), [_vector(spark, d, 0)]), 5)).select("file_name", "is_video", "score")
    roots = rows.select("file_name", F.split_part("file_name", F.lit("/"), F.lit(2)).alias("root"))
    return search.collapsed(rows, roots)


def _order(by: str) -> str:
    return f"""{WITH}, r AS (SELECT file_name, CAST(doc_id % 10 AS DOUBLE) / 10 AS score, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 50 END AS date_sec
FROM files)
    SELECT file_name, score, date_sec, CAST(row_number() OVER (ORDER BY {by}, file_name) AS INT) AS rank FROM r"""


def _dated(spark, d):
    return FILES.df(spark, d).selectExpr("file_name", "CAST(doc_id % 10 AS DOUBLE) / 10 AS score", "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 50 END AS date_sec")


@query(_order("score DESC"))
def sort1_best(spark, d):
    return search.ranked(_dated(spark, d))


@query(_order("date_sec DESC NULLS LAST"))
def sort2_newest(spark, d):
    return search.ranked(_dated(spark, d), "newest")


@query(_order("date_sec ASC NULLS LAST"))
def sort2_oldest(spark, d):
    return search.ranked(_dated(spark, d), "oldest")


@query(f"{WITH} SELECT path, CAST(row_number() OVER (ORDER BY path DESC) AS BIGINT) AS place FROM paths")
def sort3_paths(spark, d):
    """Paths as a finished scan lists them."""
    return search.numbered(PATHS.df(spark, d).select("path"), [F.col("path").desc()], "place")


@query(f"""{WITH}, r AS (SELECT file_name, row_number() OVER (PARTITION BY split_part(file_name, '/', 1) ORDER BY file_name) AS n FROM files) SELECT file_name
FROM r WHERE n = 1""")
def win2_first_seen(spark, d):
    return search.first_of(FILES.df(spark, d).withColumn("key", F.split_part("file_name", F.lit("/"), F.lit(1))), "key", "file_name").select("file_name")


@query(f"{WITH} SELECT file_name, CAST(row_number() OVER (ORDER BY file_name) AS INT) AS rank FROM files")
def win1_rank(spark, d):
    return search.ranked(FILES.df(spark, d).select("file_name", F.lit(1.0).alias("score"))).select("file_name", "rank")


@query(f"""{WITH}, r AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat('p', doc_id % 40) END AS media_path FROM files), n AS (SELECT *,
row_number() OVER (PARTITION BY media_path ORDER BY doc_id) AS k FROM r WHERE media_path IS NOT NULL) SELECT doc_id, media_path FROM n WHERE k = 1""")
def flt15_gallery(spark, d):
    """The first result of each media path; results without one go."""
    return search.first_of(FILES.df(spark, d).selectExpr("doc_id", "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat('p', doc_id % 40) END AS media_path"), "media_path", "doc_id")


@query(f"{WITH} SELECT page_id FROM paths WHERE contains(lower(list_extract(string_split(path, '/'), -1)), 'img1')")
def flt4_filename(spark, d):
    rows = PATHS.df(spark, d)
    return rows.filter(paths.name_matches("IMG1", F.col("path"))).select("page_id")


@query(f"{WITH} SELECT page_id FROM paths WHERE contains(lower(path), 'en/12') OR contains(lower(path), 'en/53')")
def flt5_filename_path(spark, d):
    rows, path = PATHS.df(spark, d), F.lower("path")
    return rows.filter((paths.name_matches("en/12", F.col("path")) & F.contains(path, F.lit("en/12"))) | (paths.name_matches("EN/53", F.col("path")) & F.contains(path, F.lit("en/53")))).select("page_id")


@query(f"{WITH} SELECT page_id FROM paths WHERE list_extract(string_split(path, '/'), -1) = 'img7.jpg'")
def flt5_filename_exact(spark, d):
    """A query with a slash and a name: the name must be equal."""
    rows = PATHS.df(spark, d)
    return rows.filter(paths.name_matches("e/IMG7.jpg", F.col("path")) | (F.element_at(F.split("path", "/"), -1) == "img7.jpg")).select("page_id")


def _forms(spark, d):
    """Paths with other forms: by a collection's key, relative to it, and joined with the collection's root; every fourth has only its own."""
    rows = PATHS.df(spark, d).withColumn("rel", F.concat(F.lit("Albums/Année-"), F.col("page_id") % 9, F.lit("/img"), "page_id", F.lit(".jpg")))
    there = F.col("page_id") % 4 != 0
    return rows.select(F.col("page_id").alias("key"), "path", F.when(there, F.concat(F.lit("c"), F.col("page_id") % 5, F.lit("/"), "rel")).alias("db"), F.when(there, F.col("rel")).alias("rel"), F.when(there, F.concat(F.lit("/Volumes/Root"), F.col("page_id") % 5, F.lit("/"), "rel")).alias("full"))


_FORM_SQL = f"""{WITH}, r AS (SELECT page_id AS key, lower(path) AS path, concat('albums/année-', page_id % 9, '/img', page_id, '.jpg') AS rel FROM paths),
forms AS (SELECT key, unnest(CASE WHEN key % 4 = 0 THEN [path] ELSE [path, concat('c', key % 5, '/', rel), rel, concat('/volumes/root', key % 5, '/', rel)] END) AS f FROM r),
c AS (SELECT key, f, list_filter(string_split(f, '/'), lambda x: x <> '') AS c FROM forms)"""


def _like(q: str, c: str) -> str:
    n = len(q.encode())
    near = f" OR levenshtein('{q}', {c}) <= {2 if n >= 12 else 1}" if n >= 5 else ""
    return f"(contains({c}, '{q}') OR contains('{q}', {c}){near})"


def _found(query: str) -> str:
    """Keys of paths that match a query of two components in part, in some form."""
    a, b = query.split("/")
    return f"SELECT DISTINCT key FROM c WHERE contains(f, '{query}') OR len(list_filter(range(1, len(c)), lambda i: {_like(a, 'c[i]')} AND {_like(b, 'c[i + 1]')})) > 0"


#: Queries with letters left out, exchanged or added, in the physical form and in the others.
_TYPING = ("albms/annee-7", "volumes/rot3", "example.cm/en", "ththre.exmple.com/fr", "c2/albums", "anné-3/img3")


@query(_FORM_SQL + ", found AS (" + " UNION ALL ".join(f"SELECT '{q}' AS query, key FROM ({_found(q)})" for q in _TYPING) + ") SELECT query, key FROM found")
def flt5_forms_fuzzy(spark, d):
    """Path search over four forms of each path, out of the index: queries that match by edit distance, by parts and not at all."""
    where = f"{shared_dir(spark)}/photonlake-paths-{uuid.uuid4().hex}"
    path_index.build(_forms(spark, d), where, "path", "db", "rel", "full", folders=8)
    found = [path_index.search(spark, where, q, "path", "db", "rel", "full").select(F.lit(q).alias("query"), "key") for q in _TYPING]
    return functools.reduce(lambda a, b: a.unionByName(b), found)


@query(_FORM_SQL + ", found AS (" + _found("albums/annéee-4") + ") SELECT key FROM found")
def flt5_rule(spark, d):
    """The same rule by a scan of all paths."""
    rows = _forms(spark, d)
    return rows.filter(paths.name_matches("Albums/Annéee-4", F.col("path"), F.col("db"), F.col("rel"), F.col("full"))).select("key")


@query(f"{WITH} SELECT file_name, is_video, timestamp_sec, CAST(len(vector) AS INT) AS dim FROM frames WHERE len(vector) > 0")
def src9_clip_frames(spark, d):
    """Frames with vectors out of grouped rows, of the usual dimension."""
    grouped = FRAMES.df(spark, d).groupBy("file_name").agg(F.first("is_video").alias("is_video"), F.collect_list(F.struct("timestamp_sec", F.col("vector").alias("clip_embedding"))).alias("clip_groups"))
    return tables.clip_rows(grouped).join(grouped.select("file_name", "is_video"), "file_name").select("file_name", "is_video", "timestamp_sec", F.size("vector").alias("dim"))


@query(f"""{WITH} SELECT concat(file_name, '|', printf('%.3f', timestamp_sec), '|0') AS id, file_name, timestamp_sec, round(list_sum(list_transform(vector,
lambda x: CAST(x AS DOUBLE) * x)), 4) AS length FROM frames""")
def src10_face_frames(spark, d):
    """One row for each face, at length 1."""
    grouped = FRAMES.df(spark, d).groupBy("file_name").agg(F.collect_list(F.struct("timestamp_sec", F.array("vector").alias("face_embeddings"))).alias("face_groups"))
    rows = tables.face_rows(grouped, 64)
    return rows.select("id", "file_name", "timestamp_sec", F.round(vectors.norm(vectors.unit(F.col("vector"))), 4).alias("length"))


@query(f"""{WITH} SELECT concat(file_name, '|', printf('%.3f', timestamp_sec)) AS id, md5(lower(trim(text, ' '))) AS text_md5 FROM files WHERE doc_id % 3 <> 0
AND trim(text, ' ') <> ''""")
def src11_ocr_frames(spark, d):
    """Text of frames in which some was found."""
    grouped = FILES.df(spark, d).selectExpr("file_name", "array(named_struct('timestamp_sec', timestamp_sec, 'text_detected', doc_id % 3 <> 0, 'text', text)) AS ocr_groups")
    return tables.text_rows(grouped).select("id", F.md5(F.lower("text").cast("binary")).alias("text_md5"))


@query(f"{WITH} SELECT doc_id, file_name, is_video, image_width FROM files")
def src6_scan(spark, d):
    return FILES.df(spark, d).select("doc_id", "file_name", "is_video", "image_width")


@query(f"{WITH} SELECT file_name, source_size FROM files")
def src7_projected(spark, d):
    return FILES.df(spark, d).select("file_name", "source_size")


@query(f"""{WITH} SELECT 'copies' AS part, count(*) AS n FROM files WHERE doc_id % 3 = 0 UNION ALL SELECT 'times', count(*) FROM files
WHERE source_mtime_ns IS NOT NULL UNION ALL SELECT 'skipped', count(*) FROM files WHERE is_video UNION ALL SELECT 'edges', count(*) FROM edges
WHERE checked""")
def src8_derived(spark, d):
    """Sizes of the tables that are derived from one scan of the index."""
    files, edges = FILES.df(spark, d), EDGES.df(spark, d)
    one = files.agg(F.count_if(F.expr("doc_id % 3 = 0")).alias("copies"), F.count("source_mtime_ns").alias("times"), F.count_if("is_video").alias("skipped"))
    rows = one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c))])).alias("part", "n"))
    return rows.unionByName(edges.filter("checked").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("part"), "n"))


@query("""SELECT CAST(props AS VARCHAR) IS NOT NULL AS has, event_type, count(*) AS n, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 2) AS total FROM events
GROUP BY ALL""")
def src12_typed(spark, d):
    """Columns under declared types."""
    rows = table(spark, d, "events").select(F.col("props").cast("string").isNotNull().alias("has"), F.col("event_type").cast("string").alias("event_type"), F.col("value").cast("float").alias("value"))
    return rows.groupBy("has", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total"))


@query(f"{WITH} SELECT file_name, image_width FROM files WHERE collection_id = 'src3'")
def src13_batches(spark, d):
    """Some columns under a condition that reaches the scan."""
    return FILES.df(spark, d).filter("collection_id = 'src3'").select("file_name", "image_width")


@query("SELECT concat('src', n_nationkey) AS collection_id, concat('/media/', lower(n_name)) AS root_path FROM nation WHERE n_nationkey % 5 <> 0")
def src14_roots(spark, d):
    from photonlake.sources import roots

    raw = table(spark, d, "nation").selectExpr("concat(' src', n_nationkey, ' ') AS collection_id", "CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE concat('/media/', lower(n_name), '/') END AS root_path")
    return roots.loaded(raw)


@query(f"""{WITH}, s AS (SELECT DISTINCT split_part(file_name, '/', 1) AS collection_id, substr(file_name, instr(file_name, '/') + 1) AS rel FROM files),
n AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY rel) AS k FROM s) SELECT collection_id, rel FROM n WHERE k <= 16""")
def src15_samples(spark, d):
    from photonlake.sources import roots

    return roots.samples(FILES.df(spark, d))


@query(f"""{WITH}, s AS (SELECT DISTINCT split_part(file_name, '/', 1) AS collection_id, substr(file_name, instr(file_name, '/') + 1) AS rel FROM files),
n AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY rel) AS k FROM s) SELECT collection_id, '/b' AS root_path, count(*) AS hits
FROM n WHERE k <= 16 GROUP BY collection_id""")
def src16_discovered(spark, d):
    """The candidate folder that holds most of a collection's samples."""
    from photonlake.sources import roots

    s = roots.samples(FILES.df(spark, d))
    candidates = spark.createDataFrame([(0, "/a"), (1, "/b"), (2, "/c")], "place int, root_path string")
    # The folder before it lacks the first sample of each collection at least, whatever the names are.
    first = s.groupBy("collection_id").agg(F.min("rel").alias("rel")).select("rel")
    some = s.filter("length(rel) % 2 = 0").join(first, "rel", "left_anti")
    there = s.select(F.concat(F.lit("/b/"), "rel").alias("path")).unionByName(some.select(F.concat(F.lit("/a/"), "rel").alias("path"))).unionByName(s.select(F.concat(F.lit("/c/"), "rel").alias("path")))
    return roots.discovered(s, candidates, there)


@query(f"""{WITH} SELECT file_name, CASE WHEN n_name IS NOT NULL THEN concat('/media/', lower(n_name), '/', substr(file_name, instr(file_name,
'/') + 1)) END AS source_path FROM files LEFT JOIN nation ON split_part(file_name, '/', 1) = concat('src', n_nationkey) AND n_nationkey % 5 <> 0""")
def join9_source_path(spark, d):
    from photonlake.sources import roots

    raw = table(spark, d, "nation").filter("n_nationkey % 5 <> 0").selectExpr("concat('src', n_nationkey) AS collection_id", "concat('/media/', lower(n_name)) AS root_path")
    return roots.resolved(FILES.df(spark, d).select("file_name"), raw)


_ASKED = "CASE doc_id % 3 WHEN 0 THEN concat('/b/', file_name) WHEN 1 THEN concat('/lost/', split_part(file_name, '/', 3)) ELSE concat('/there/', split_part(file_name, '/', 3)) END"


@query(f"{WITH} SELECT path, CASE WHEN path LIKE '/there/%' THEN NULL ELSE file_name END AS file_name FROM (SELECT file_name, {_ASKED} AS path FROM files)")
def join10_db_name(spark, d):
    """The index's name of a path: by its collection's root, or for a path that doesn't exist by its name, if just one file has that."""
    from photonlake.sources import roots

    files = FILES.df(spark, d)
    asked = files.selectExpr(f"{_ASKED} AS path", "doc_id % 3 <> 1 AS path_exists")
    there = files.select(F.split_part("file_name", F.lit("/"), F.lit(1)).alias("collection_id")).distinct().select("collection_id", F.concat(F.lit("/b/"), "collection_id").alias("root_path"))
    return roots.db_names(asked, there, files).select("path", "file_name")


@query(f"{WITH} SELECT concat(replace(file_name, '.mp4', '_mp4'), '/still_1.jpg') AS still, file_name FROM files WHERE is_video")
def join11_still_owner(spark, d):
    from photonlake.sources import roots

    return FILES.df(spark, d).filter("is_video").select(F.concat(F.replace("file_name", F.lit(".mp4"), F.lit("_mp4")), F.lit("/still_1.jpg")).alias("still")).select("still", roots.still_owner(F.col("still")).alias("file_name"))


@query(f"{WITH} SELECT lower(list_extract(string_split(path, '/'), -2)) AS name, list_sort(list(page_id)) AS pages FROM paths GROUP BY ALL")
def join14_names(spark, d):
    """Multimap from a name to the files that have it."""
    return PATHS.df(spark, d).groupBy(F.lower(F.element_at(F.split("path", "/"), -2)).alias("name")).agg(F.sort_array(F.collect_list("page_id")).alias("pages"))


@query(f"""{WITH}, mapped AS (SELECT DISTINCT concat('/m/', split_part(file_name, '/', 1)) AS root FROM files WHERE split_part(file_name, '/', 1) <> 'src2'),
asked AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN concat('/m/', source) WHEN 1 THEN concat('/m/', source, '/', lang) WHEN 2 THEN '/m'
ELSE concat('/m/', source, 'x') END AS folder FROM documents)
SELECT folder, EXISTS (SELECT 1 FROM mapped WHERE folder = root OR starts_with(folder, root || '/') OR starts_with(root, folder || '/')) AS mapped
FROM asked""")
def flt17_mapped_folders(spark, d):
    """Folders that lie in, hold, or are the root of some mapped collection; names that only begin alike don't count."""
    from photonlake.sources import roots

    there = FILES.df(spark, d).select(F.split_part("file_name", F.lit("/"), F.lit(1)).alias("c")).filter("c <> 'src2'").distinct().select(F.concat(F.lit("/m/"), "c").alias("root_path"))
    asked = table(spark, d, "documents").selectExpr("CASE doc_id % 4 WHEN 0 THEN concat('/m/', source) WHEN 1 THEN concat('/m/', source, '/', lang) WHEN 2 THEN '/m' ELSE concat('/m/', source, 'x') END AS folder").distinct()
    return roots.with_mapping(asked, there)


@query(f"{WITH} SELECT file_name FROM files WHERE collection_id IS NULL OR collection_id NOT IN ('src1', 'src2')")
def flt14_excluded(spark, d):
    """All rows but those of some keys; rows without a key stay."""
    keys = spark.createDataFrame([("src1",), ("src2",), (None,)], "collection_id string")
    return tables.without(FILES.df(spark, d), keys, "collection_id").select("file_name")


@query(f"{WITH} SELECT collection_id, count(*) AS n FROM files WHERE collection_id = 'src4' GROUP BY ALL")
def flt20_scope(spark, d):
    return FILES.df(spark, d).filter("collection_id = 'src4'").groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
