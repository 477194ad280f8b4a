"""Queries of joins, groups, reports, table upkeep and relocation."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from photonlake.functions import groups, hashes, vectors
from photonlake.operators import duplicates, graph, hamming, relocate, report, search, stages, tables, vector_index
from photonlake.plans.registry import EDGES, FILES, FRAMES, WITH, query, table
from photonlake.plans.storage import shared_dir

PCT = "round_even((64 - {0}) * 100.0::DOUBLE / 64, 3)"
D = "bit_count(xor(a.h, b.h))"


def _images(spark, d):
    return FILES.df(spark, d).filter("NOT is_video")


def _videos(spark, d):
    return FILES.df(spark, d).filter("is_video")


def _placed(spark, d):
    """Images in their order. Only what the order and the hashes need is sorted: texts would be most of it."""
    rows = _images(spark, d).select("doc_id", "file_name", "h", "image_width", "image_height", "source_size", F.lit(False).alias("is_thumb"))
    return hamming.image_order(rows)


@query(f"""{WITH}, p AS (SELECT a.file_name, b.file_name AS match, {D} AS d FROM files a JOIN files b ON a.file_name <> b.file_name AND {D} <= 3),
n AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY d, match) AS k FROM p) SELECT file_name, match, d FROM n WHERE k = 1""")
def join1_hamming_best(spark, d):
    """Nearest other hash within three bits."""
    return hamming.best_match(FILES.df(spark, d), FILES.df(spark, d), 3)


@query(f"""{WITH}, wide AS (SELECT file_name, xor(h, CAST((doc_id * 11400714) % 16777216 AS UBIGINT)) AS h FROM files),
p AS (SELECT a.file_name, b.file_name AS match, {D} AS d FROM wide a JOIN wide b ON a.file_name <> b.file_name AND {D} <= 12),
n AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY d, match) AS k FROM p) SELECT file_name, match, d FROM n WHERE k = 1""")
def join1_hamming_wide(spark, d):
    """The nearest file within 12 bits (80 %), where no blocks of bits are equal for certain: copies' hashes differ in up to 24 bits, half of them in more than 12."""
    rows = FILES.df(spark, d).select("file_name", F.col("h").bitwiseXOR((F.col("doc_id") * 11400714) % 16777216).alias("h"))
    return hamming.best_match(rows, rows, 12)


@query(f"{WITH} SELECT a.file_name, b.file_name AS match, {D} AS d FROM files a JOIN files b ON a.is_video AND NOT b.is_video AND {D} <= 3")
def join2_hamming_all(spark, d):
    return hamming.all_matches(_videos(spark, d), _images(spark, d), 3)


LINKS = f"""{WITH}, near AS (SELECT a.file_name, b.file_name AS other, min({D}) AS d FROM files a JOIN files b ON NOT a.is_video AND b.is_video AND {D} <= 3
GROUP BY ALL),
links AS (SELECT file_name, other, TRUE AS is_video, {PCT.format('d')} AS similarity_pct FROM near UNION ALL SELECT other, file_name, FALSE,
{PCT.format('d')} FROM near)"""


@query(f"{LINKS} SELECT * FROM links WHERE is_video")
def join3_cross_media(spark, d):
    """Images linked to videos by their frames."""
    return hamming.cross_media(_images(spark, d), _videos(spark, d)).filter("is_video")


@query(f"{LINKS} SELECT * FROM links")
def join4_both_ways(spark, d):
    return hamming.cross_media(_images(spark, d), _videos(spark, d))


@query(f"""{LINKS}, run AS (SELECT file_name FROM files WHERE doc_id % 2 = 0), old AS (SELECT file_name, other, is_video, 50.0::DOUBLE AS similarity_pct
FROM links),
rows AS (SELECT * FROM old WHERE file_name NOT IN (SELECT file_name FROM run) AND other NOT IN (SELECT file_name FROM run) UNION ALL SELECT *
FROM links WHERE file_name IN (SELECT file_name FROM run) OR other IN (SELECT file_name FROM run))
SELECT file_name, other, bool_or(is_video) AS is_video, max(similarity_pct) AS similarity_pct FROM rows GROUP BY ALL""")
def join5_scope(spark, d):
    """Links after a run over some of the files."""
    links = hamming.cross_media(_images(spark, d), _videos(spark, d))
    run = FILES.df(spark, d).filter("doc_id % 2 = 0").select("file_name")
    touched = links.join(run, "file_name", "left_semi").unionByName(links.join(run.withColumnRenamed("file_name", "other"), "other", "left_semi")).distinct()
    return hamming.merged_links(links.withColumn("similarity_pct", F.lit(50.0)), touched, run)


@query(f"{LINKS} SELECT file_name, list(concat(other, '|', similarity_pct) ORDER BY -similarity_pct, other) AS links FROM links GROUP BY ALL")
def agg15_link_lists(spark, d):
    """Links of each file as an array by similarity and name."""
    lists = hamming.link_lists(hamming.cross_media(_images(spark, d), _videos(spark, d)))
    normal = lists.select("file_name", groups.normal_links(F.col("cross_media_matches")).alias("m"))
    return normal.select("file_name", F.transform("m", lambda x: F.concat(x["file_name"], F.lit("|"), x["similarity_pct"].cast("string"))).alias("links"))


@query(f"""{WITH}, p AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS master, file_name FROM files) SELECT p.file_name, q.file_name AS master FROM p
JOIN files q ON q.doc_id = p.master WHERE p.doc_id <> p.master""")
def join6_copies(spark, d):
    """Copies with their masters; links to oneself don't count."""
    return duplicates.copies(_index(spark, d)).select("file_name", "master")


def _index(spark, d):
    """Files with a link to the first file of equal text."""
    rows = FILES.df(spark, d)
    first = rows.groupBy("text").agg(F.min_by("file_name", "doc_id").alias("dedupe_match_file"))
    return rows.join(first, rows.text.eqNullSafe(first.text)).drop("text").withColumn("dedupe_similarity_pct", F.when(F.col("doc_id") % 3 != 0, F.lit(100.0)))


VALID = "checked AND target <> file_name AND target IN (SELECT file_name FROM edges)"


@query(f"{WITH} SELECT file_name, target FROM edges WHERE {VALID}")
def join7_valid_edges(spark, d):
    """Checked links between masters."""
    rows = EDGES.df(spark, d)
    return graph.valid_edges(rows, rows).select("file_name", "target")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name < b.n_name")
def join12_pairs(spark, d):
    """All pairs of a selection made by hand: the nations."""
    return duplicates.selection_pairs(table(spark, d, "nation").select(F.col("n_name").alias("file_name")))


def _greedy(where: str, order: str, most: int, free: str = "FALSE") -> str:
    """The same grouping, file after file."""
    return f"""{WITH}, items AS (SELECT file_name, h, {free} AS free, row_number() OVER (ORDER BY {order}) AS place FROM files WHERE {where}),
    near AS (SELECT a.place, b.place AS spot, b.file_name AS match, bit_count(xor(a.h, b.h)) AS d FROM items a JOIN items b ON b.place < a.place
AND bit_count(xor(a.h, b.h)) <= {most}),
    around AS (SELECT i.place, i.free, coalesce(list(n.spot) FILTER (WHERE n.spot IS NOT NULL), []) AS nears FROM items i LEFT
JOIN near n ON n.place = i.place GROUP BY ALL),
    run AS (SELECT 0::BIGINT AS place, []::BIGINT[] AS masters UNION ALL SELECT a.place, CASE WHEN a.free OR len(list_intersect(r.masters,
a.nears)) = 0 THEN list_append(r.masters, a.place) ELSE r.masters END FROM run r JOIN around a ON a.place = r.place + 1),
    heads AS (SELECT unnest(masters) AS place FROM (SELECT max_by(masters, place) AS masters FROM run)),
    best AS (SELECT n.place, min(struct_pack(d := n.d, match := n.match)) AS m FROM near n JOIN heads h ON h.place = n.spot GROUP BY n.place)
    SELECT i.file_name, h.place IS NOT NULL AS is_master, CASE WHEN h.place IS NULL THEN b.m.match END AS match, CASE WHEN h.place IS NULL
THEN {PCT.format('b.m.d')} END AS similarity_pct
    FROM items i LEFT JOIN heads h ON h.place = i.place LEFT JOIN best b ON b.place = i.place"""


ORDER = "greatest(image_width, image_height) DESC, CAST(image_width AS BIGINT) * image_height DESC, source_size DESC, file_name"


@query(_greedy("NOT is_video", ORDER, 3, "doc_id % 13 = 0"))
def agg2_leader(spark, d):
    """Greedy grouping of images, some of which are never demoted."""
    return hamming.leaders(_placed(spark, d).withColumn("busy", F.col("doc_id") % 13 == 0), 95.0, "busy")


@query(_greedy("NOT is_video", ORDER, 3))
def agg3_image_groups(spark, d):
    return hamming.leaders(_placed(spark, d), 95.0)


@query(_greedy("is_video", "file_name", 12))
def agg4_video_groups(spark, d):
    """Greedy grouping of videos in the order of their names."""
    return hamming.leaders(search.numbered(_videos(spark, d).select("file_name", "h"), [F.col("file_name")], "place"), 80.0)


@query(f"""{_greedy("NOT is_video", ORDER, 3).replace("    SELECT i.file_name, h.place", ", made AS (SELECT i.file_name, h.place").replace("WITH RECURSIVE", "WITH RECURSIVE", 1)}),
old AS (SELECT x.file_name, CASE WHEN m.file_name <> x.file_name THEN m.file_name END AS old FROM files x JOIN (SELECT text, min_by(file_name,
doc_id) AS file_name FROM files GROUP BY text) m ON x.text IS NOT DISTINCT FROM m.text WHERE NOT x.is_video)
SELECT count(*) FILTER (WHERE is_master) AS masters, count(*) FILTER (WHERE NOT is_master AND old IS NULL) AS demoted,
count(*) FILTER (WHERE match IS NOT NULL AND old IS NOT NULL AND match <> old) AS retargeted FROM made JOIN old USING (file_name)""")
def agg5_repair(spark, d):
    """How many masters, demoted and retargeted files a rebuild from scratch gives."""
    return hamming.repaired(_placed(spark, d), _index(spark, d).select("file_name", F.when(F.col("dedupe_match_file") != F.col("file_name"), F.col("dedupe_match_file")).alias("old")), 95.0)


@query(f"{WITH} SELECT file_name, CAST(row_number() OVER (ORDER BY {ORDER}) AS BIGINT) AS place FROM files")
def sort4_image_order(spark, d):
    rows = FILES.df(spark, d).select("file_name", "image_width", "image_height", "source_size", F.lit(False).alias("is_thumb"))
    return hamming.image_order(rows).select("file_name", "place")


@query(f"""{WITH} SELECT split_part(file_name, '/', 1) AS grp, max_by(file_name, struct_pack(a := greatest(image_width, image_height), b := source_size,
c := file_name)) AS best FROM files GROUP BY ALL""")
def sort5_highest(spark, d):
    rank = F.struct(F.greatest("image_width", "image_height"), "source_size", "file_name")
    return FILES.df(spark, d).groupBy(F.split_part("file_name", F.lit("/"), F.lit(1)).alias("grp")).agg(F.max_by("file_name", rank).alias("best"))


COMPONENTS = f"""{WITH}, e AS (SELECT file_name AS a, target AS b FROM edges WHERE {VALID}), ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS root FROM ways UNION SELECT b.b, r.root FROM reach r JOIN ways b ON b.a = r.node), comp AS (SELECT node,
min(root) AS root FROM reach GROUP BY node)"""


def _edges(spark, d):
    rows = EDGES.df(spark, d)
    return graph.valid_edges(rows, rows)


@query(f"{COMPONENTS} SELECT node, root FROM comp")
def agg6_components(spark, d):
    """Connected groups of files."""
    return graph.components(_edges(spark, d))


@query(f"""{COMPONENTS}, r AS (SELECT c.node, c.root, e.inliers, row_number() OVER (PARTITION BY c.root ORDER BY e.inliers DESC, c.node DESC) AS n FROM comp c
JOIN edges e ON e.file_name = c.node), heads AS (SELECT root, node AS master FROM r WHERE n = 1)
SELECT c.node AS file_name, CASE WHEN c.node <> h.master THEN h.master END AS master, coalesce(x.target = h.master AND c.node <> h.master,
FALSE) AS direct FROM comp c JOIN heads h ON c.root = h.root LEFT JOIN (SELECT file_name, target FROM edges WHERE {VALID}) x ON x.file_name = c.node""")
def agg7_elected(spark, d):
    """The highest-ranked file of each group as its master."""
    return graph.elected(_edges(spark, d), EDGES.df(spark, d).select("file_name", "inliers"), [F.col("inliers").desc(), F.col("file_name").desc()])


_BEFORE = """file_name, CASE WHEN n % 3 <> 0 THEN concat('f', CAST(floor(n / (2 + n % 2)) AS BIGINT)) END AS sift_match_file, CASE WHEN n % 5 <> 0 THEN round(inliers / 200.0, 6) END AS sift_match_score,
CASE WHEN n % 5 <> 0 THEN inliers END AS sift_match_inliers, CASE WHEN n % 5 <> 0 THEN inliers + 3 END AS sift_match_good_matches, CASE WHEN n % 5 <> 0 THEN 0.75 END AS sift_match_inlier_ratio, n % 4 = 0 AS sift_match_checked"""


@query(f"""{COMPONENTS}, r AS (SELECT c.node, c.root, e.inliers, row_number() OVER (PARTITION BY c.root ORDER BY e.inliers DESC, c.node DESC) AS n FROM comp c
JOIN edges e ON e.file_name = c.node), heads AS (SELECT root, node AS master FROM r WHERE n = 1), m AS (SELECT c.node AS file_name, CASE WHEN c.node <> h.master THEN h.master END AS master FROM comp c JOIN heads h ON c.root = h.root),
i AS (SELECT {_BEFORE}, n, inliers FROM (SELECT file_name, inliers, CAST(substr(file_name, 2) AS BIGINT) AS n FROM edges)),
w AS (SELECT i.*, n % 7 <> 0 AS job, m.master, x.target AS own FROM i LEFT JOIN m USING (file_name) LEFT JOIN (SELECT file_name, target FROM edges WHERE {VALID}) x USING (file_name)),
o AS (SELECT file_name, CASE WHEN NOT job THEN sift_match_file ELSE master END AS link, {", ".join(f"CASE WHEN NOT job THEN {c} WHEN master IS NULL THEN CASE WHEN sift_match_file IS NULL THEN {c} END WHEN own = master THEN {v} END AS {a}" for c, v, a in (("sift_match_score", "round(inliers / 100.0, 6)", "score"), ("sift_match_inliers", "inliers", "inliers"), ("sift_match_good_matches", "inliers + 1", "good"), ("sift_match_inlier_ratio", "0.5", "ratio")))},
CASE WHEN NOT job THEN sift_match_checked ELSE TRUE END AS checked, w.* EXCLUDE (file_name, inliers) FROM w)
SELECT file_name, link, CAST(score AS DOUBLE) AS score, CAST(inliers AS INT) AS inliers, CAST(good AS INT) AS good, CAST(ratio AS DOUBLE) AS ratio, checked, link IS DISTINCT FROM sift_match_file OR score IS DISTINCT FROM sift_match_score
OR inliers IS DISTINCT FROM sift_match_inliers OR good IS DISTINCT FROM sift_match_good_matches OR ratio IS DISTINCT FROM sift_match_inlier_ratio OR checked IS DISTINCT FROM sift_match_checked AS changed FROM o""")
def agg7_written(spark, d):
    """The election's links and figures in the rows of an index: figures stay only where the elected master is the file that they were measured against."""
    rows = EDGES.df(spark, d)
    before = rows.withColumn("n", F.substring("file_name", 2, 20).cast("long")).selectExpr(*[x.strip() for x in re.split(r",(?![^()]*\))\s*(?=CASE|n %)", _BEFORE)])
    before = before.withColumns({"sift_match_score": F.col("sift_match_score").cast("double"), "sift_match_inlier_ratio": F.col("sift_match_inlier_ratio").cast("double")})
    masters = graph.elected(_edges(spark, d), rows.select("file_name", "inliers"), [F.col("inliers").desc(), F.col("file_name").desc()])
    direct = _edges(spark, d).select("file_name", F.col("target").alias("candidate"))
    jobs = rows.filter("substr(file_name, 2) % 7 <> 0").select("file_name", F.col("inliers").alias("i")).join(direct, "file_name", "left")
    there = F.col("candidate").isNotNull()
    jobs = jobs.select("file_name", "candidate", F.when(there, F.col("i") / 100.0).alias("score"), F.when(there, F.col("i")).alias("inliers"), F.when(there, F.col("i") + 1).alias("good"), F.when(there, F.lit(0.5)).alias("ratio"))
    out = graph.with_election(before, jobs, masters)
    return out.select("file_name", F.col("sift_match_file").alias("link"), *[F.col(c).alias(v) for c, v in graph.FIGURES.items()], F.col("sift_match_checked").alias("checked"), "changed")


# An edge spans if no better edges join its ends; then the spanning edges are walked from each root.
@query(f"""{COMPONENTS}, links AS (SELECT file_name AS a, target AS b, row_number() OVER (ORDER BY inliers DESC, file_name, target) AS n FROM edges
WHERE {VALID}),
both_ AS (SELECT a, b, n FROM links UNION ALL SELECT b, a, n FROM links),
better AS (SELECT n AS edge, a AS node FROM links UNION SELECT r.edge, w.b FROM better r JOIN both_ w ON w.a = r.node AND w.n < r.edge),
tree AS (SELECT l.* FROM links l WHERE NOT EXISTS (SELECT 1 FROM better r WHERE r.edge = l.n AND r.node = l.b)), steps AS (SELECT a, b FROM tree
UNION ALL SELECT b, a FROM tree),
walk AS (SELECT DISTINCT root AS root, root AS file_name, CAST(NULL AS VARCHAR) AS target FROM comp UNION SELECT w.root, s.b, s.a FROM walk w
JOIN steps s ON s.a = w.file_name WHERE w.target IS NULL OR s.b <> w.target)
SELECT root, file_name, target FROM walk WHERE target IS NOT NULL""")
def agg8_bridges(spark, d):
    """Spanning links of each group, the best ones, as seen from its root."""
    edges = _edges(spark, d).join(EDGES.df(spark, d).select("file_name", "inliers"), "file_name").select("file_name", "target", "inliers", (F.col("inliers") / 100).alias("ratio"), F.lit(0.5).alias("score"))
    return graph.bridges(edges, graph.components(_edges(spark, d)))


@query(f"{COMPONENTS} SELECT node FROM comp WHERE root = (SELECT root FROM comp WHERE node = 'f6')")
def agg9_component_of(spark, d):
    """The group around one file."""
    return graph.group_of(_edges(spark, d), "f6")


@query(f"{COMPONENTS} SELECT root, list(DISTINCT node ORDER BY node) AS members FROM comp GROUP BY root")
def agg6_members(spark, d):
    return graph.members(graph.components(_edges(spark, d)))


_COPIES = f"{WITH}, ix AS (SELECT f.*, m.file_name AS master FROM files f JOIN (SELECT text, min_by(file_name, doc_id) AS file_name FROM files GROUP BY text) m ON f.text = m.text)"


@query(f"""{_COPIES} SELECT master, list(DISTINCT n ORDER BY n) AS members FROM (SELECT master, file_name AS n FROM ix WHERE file_name <> master UNION ALL
SELECT master, master FROM ix WHERE file_name <> master) GROUP BY master""")
def agg12_copy_groups(spark, d):
    return duplicates.copy_groups(_index(spark, d))


@query(f"""{_COPIES}, near AS (SELECT a.file_name, b.file_name AS other, min({D}) AS d FROM files a JOIN files b ON NOT a.is_video AND b.is_video AND {D} <= 3
GROUP BY ALL),
rows AS (SELECT master, file_name, CASE WHEN doc_id % 3 <> 0 THEN 100.0::DOUBLE END AS s FROM ix WHERE file_name <> master UNION ALL SELECT file_name,
other, {PCT.format('d')} FROM near UNION ALL SELECT other, file_name, {PCT.format('d')} FROM near),
best AS (SELECT master, file_name, max(s) AS s FROM rows GROUP BY ALL) SELECT master, list(file_name ORDER BY coalesce(s, -1) DESC,
file_name) AS names FROM best GROUP BY master""")
def agg11_similar(spark, d):
    """Copies and cross-media links of each file in one list."""
    return duplicates.similar_lists(duplicates.copies(_index(spark, d)), hamming.cross_media(_images(spark, d), _videos(spark, d))).select("master", F.col("similar.file_name").alias("names"))


def _grouped(spark, d):
    roots = _index(spark, d).filter("doc_id % 2 = 0 AND dedupe_match_file = file_name").select(F.col("file_name").alias("node"), F.split_part("file_name", F.lit("/"), F.lit(2)).alias("root"))
    return duplicates.full_groups(_index(spark, d), roots)


GROUPS = f"{_COPIES}, grouped AS (SELECT x.file_name, x.is_video, x.doc_id, CASE WHEN m.doc_id % 2 = 0 THEN split_part(x.master, '/', 2) ELSE x.master END AS grp FROM ix x JOIN files m ON m.file_name = x.master)"


@query(f"{GROUPS} SELECT grp, list(DISTINCT file_name ORDER BY file_name) AS members FROM grouped GROUP BY grp")
def agg13_full_groups(spark, d):
    """Copies of every member of a connected group."""
    return duplicates.group_lists(_grouped(spark, d))


@query(f"""{GROUPS}, per AS (SELECT grp, min(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 100 END) AS m, min(CASE WHEN NOT is_video THEN doc_id * 7 END) AS e
FROM grouped GROUP BY grp) SELECT g.file_name, least(m, e) AS date_sec FROM grouped g JOIN per USING (grp)""")
def agg14_oldest(spark, d):
    """The oldest date among the copies of a file."""
    rows = _grouped(spark, d).join(FILES.df(spark, d).select("file_name", "is_video", F.expr("CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 100 END").alias("modified"), (F.col("doc_id") * 7).alias("exif")), "file_name")
    return duplicates.oldest_dates(rows)


def _media(spark, d):
    """Rows of an index in every state of the stages."""
    return FILES.df(spark, d).selectExpr(
        "doc_id", "file_name", "collection_id", "is_video", "image_width", "image_height", "source_size", "source_mtime_ns",
        "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE substr(md5(file_name), 1, 16) END AS phash_hex", "doc_id % 8 = 0 AS skip_processing", "CASE WHEN doc_id % 8 = 0 THEN 'm/x.jpg' END AS dedupe_match_file",
        "CAST(CASE WHEN doc_id % 16 = 0 THEN 98.5 END AS float) AS dedupe_similarity_pct", "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS faces",
        "CASE doc_id % 12 WHEN 1 THEN 'video_hash' WHEN 2 THEN 'image_phash' WHEN 3 THEN 'faces' WHEN 4 THEN 'clip' WHEN 6 THEN 'sift_pairs' WHEN 7 THEN 'paddle_ocr' WHEN 8 THEN 'easyocr' END AS processing_error_stage",
        "CASE WHEN doc_id % 24 = 3 THEN 'Embedding broke' WHEN doc_id % 12 BETWEEN 1 AND 8 THEN 'broke' END AS processing_error",
        "doc_id % 3 = 0 AS sift_match_checked", "CASE WHEN doc_id % 21 = 0 THEN 's/y.jpg' END AS sift_match_file", "CAST(doc_id % 120 AS INT) AS sift_match_inliers", "CAST(doc_id % 20 / 20 AS float) AS sift_match_inlier_ratio", "CAST(doc_id % 10 / 20 AS float) AS sift_match_score",
        "CASE WHEN doc_id % 4 = 1 THEN array(named_struct('timestamp_sec', CAST(0 AS float), 'clip_embedding', array(CAST(1 AS float)))) END AS clip_groups",
        "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN array(named_struct('timestamp_sec', CAST(0 AS float), 'text_detected', TRUE, 'text', CAST(NULL AS string))) WHEN 2 THEN array(named_struct('timestamp_sec', CAST(0 AS float), 'text_detected', TRUE, 'text', 'a')) ELSE array(named_struct('timestamp_sec', CAST(0 AS float), 'text_detected', FALSE, 'text', '')) END AS ocr_groups",
        "array(CAST(0 AS double)) AS item_ts",
    )


_S = "coalesce(CASE doc_id % 12 WHEN 1 THEN 'video_hash' WHEN 2 THEN 'image_phash' WHEN 3 THEN 'faces' WHEN 4 THEN 'clip' WHEN 6 THEN 'sift_pairs' WHEN 7 THEN 'paddle_ocr' WHEN 8 THEN 'easyocr' END, '')"
_M, _V, _F, _FACES = "doc_id % 8 <> 0", "doc_id % 5 = 0", f"{_S} = 'faces'", "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END"
_CLIP, _OCR = "doc_id % 4 = 1", "doc_id % 5"
REPORT = {
    "total_rows": "TRUE", "image_rows": f"NOT {_V}", "video_rows": _V, "masters_total": _M,
    **{f"{n}_{k}": f"{v} AND ({c})" for n, v, f in (("vhash", _V, "video_hash"), ("phash", f"NOT {_V}", "image_phash")) for k, c in (("failures", f"{_S} = '{f}'"), ("successes", f"{_S} <> '{f}' AND doc_id % 9 <> 0"), ("not_run", f"{_S} <> '{f}' AND doc_id % 9 = 0"), ("similars", f"NOT {_M}"), ("masters", _M))},
    "face_detect_failures": f"{_M} AND {_F} AND doc_id % 24 <> 3", "face_embed_failures": f"{_M} AND {_F} AND doc_id % 24 = 3", "face_not_run": f"{_M} AND NOT {_F} AND ({_FACES}) IS NULL", "face_successes": f"{_M} AND NOT {_F} AND ({_FACES}) IS NOT NULL",
    "face_success_with_faces": f"{_M} AND NOT {_F} AND ({_FACES}) IS TRUE", "face_success_without_faces": f"{_M} AND NOT {_F} AND ({_FACES}) IS FALSE",
    "clip_failures": f"{_M} AND {_S} = 'clip'", "clip_successes": f"{_M} AND {_S} <> 'clip' AND {_CLIP}", "clip_not_run": f"{_M} AND {_S} <> 'clip' AND NOT ({_CLIP})",
    "sift_failures": f"{_M} AND NOT {_V} AND {_S} LIKE 'sift%'", "sift_successes": f"{_M} AND NOT {_V} AND doc_id % 3 = 0", "sift_success_with_similar": f"{_M} AND NOT {_V} AND doc_id % 3 = 0 AND doc_id % 21 = 0",
    "sift_success_without_similar": f"{_M} AND NOT {_V} AND doc_id % 3 = 0 AND doc_id % 21 <> 0", "sift_not_run": f"{_M} AND NOT {_V} AND doc_id % 3 <> 0",
    "paddle_failures": f"{_M} AND {_S} = 'paddle_ocr'", "paddle_successes": f"{_M} AND {_S} <> 'paddle_ocr' AND {_OCR} <> 0", "paddle_success_with_text": f"{_M} AND {_S} <> 'paddle_ocr' AND {_OCR} IN (1, 2)", "paddle_success_without_text": f"{_M} AND {_S} <> 'paddle_ocr' AND {_OCR} > 2",
    "paddle_not_run": f"{_M} AND {_S} <> 'paddle_ocr' AND {_OCR} = 0", "easyocr_failures": f"{_M} AND ({_S} = 'easyocr' OR {_OCR} = 1)", "easyocr_successes": f"{_M} AND NOT ({_S} = 'easyocr' OR {_OCR} = 1) AND {_OCR} <> 0", "easyocr_not_run": f"{_M} AND NOT ({_S} = 'easyocr' OR {_OCR} = 1) AND {_OCR} = 0",
}


@query(f"{WITH} SELECT CASE WHEN GROUPING(coalesce(collection_id, '<missing>')) = 1 THEN '__TOTAL__' ELSE coalesce(collection_id, '<missing>') END AS collection_id, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in REPORT.items()) + " FROM files GROUP BY ROLLUP (coalesce(collection_id, '<missing>'))")
def agg16_stage_report(spark, d):
    """Figures of every stage by collection and in total."""
    return report.by_collection(_media(spark, d), report.stage_columns())


@query(f"""{WITH} SELECT unnest(['hash', 'faces', 'clip']) AS stage, unnest([count(*) FILTER (WHERE doc_id % 9 <> 0), count(*) FILTER (WHERE doc_id % 6 <> 0),
count(*) FILTER (WHERE doc_id % 4 = 1)]) AS done, count(*) AS total FROM files""")
def agg17_summary(spark, d):
    return report.summary(_media(spark, d), {"hash": F.col("phash_hex").isNotNull(), "faces": F.col("faces").isNotNull(), "clip": F.col("clip_groups").isNotNull()})


_FIELD = "CASE WHEN {0} IS NULL THEN '-:' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', CAST({0} AS VARCHAR)) END"
_FIELDS = ", ".join(_FIELD.format(c) for c in ("file_name", "collection_id", "is_video", "source_size"))
_SUMS = ", ".join(f"CAST(sum(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query(f"""{WITH}, r AS (SELECT sha256(concat({_FIELDS})) AS d FROM files) SELECT count(*) AS rows, sha256(concat_ws(',', CAST(count(*) AS VARCHAR),
{_SUMS})) AS digest FROM r""")
def agg19_fingerprint(spark, d):
    """A digest of a table that doesn't depend on the order of its rows."""
    return report.fingerprint(FILES.df(spark, d), ["collection_id", "is_video", "source_size"], "file_name")


@query(f"""{WITH} SELECT doc_id, doc_id % 8 = 0 AND (doc_id % 9 <> 0 OR doc_id % 12 BETWEEN 1 AND 8) AS skip, doc_id % 9 <> 0
AND (doc_id % 16 = 0 OR doc_id % 8 <> 0) AS hash_done, doc_id % 9 <> 0 AND doc_id % 8 <> 0 AS in_tree,
doc_id % 4 = 1 AS clip_done, doc_id % 5 = 1 AS text_pending FROM files""")
def flt6_eligibility(spark, d):
    """Conditions by which stages pick their rows."""
    return _media(spark, d).select("doc_id", stages.skip_applies().alias("skip"), stages.hash_complete().alias("hash_done"), stages.in_tree().alias("in_tree"), stages.complete("clip_groups", "clip_embedding").alias("clip_done"), stages.text_pending().alias("text_pending"))


@query(f"{WITH} SELECT doc_id FROM files WHERE doc_id % 4 = 1")
def flt7_stage_complete(spark, d):
    return _media(spark, d).filter(stages.complete("clip_groups", "clip_embedding")).select("doc_id")


_STAGE = "concat(CAST(doc_id % 12 AS {0}), CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END)"


@query(f"""SELECT doc_id, {_STAGE.format('VARCHAR')} AS stage, {_STAGE.format('VARCHAR')} = '2b' OR regexp_extract({_STAGE.format('VARCHAR')},
'^[0-9]+') = '4' AS some, TRUE AS whole FROM documents""")
def flt8_rerun(spark, d):
    """Which stages a choice of stages and of their numbers runs again, and which that of all."""
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{_STAGE.format('STRING')} AS stage")
    return rows.select("doc_id", "stage", stages.reruns(F.col("stage"), {"2b", "4"}).alias("some"), stages.reruns(F.col("stage"), {"all"}).alias("whole"))


@query(f"{WITH} SELECT doc_id FROM files WHERE doc_id % 9 <> 0 AND (doc_id % 16 = 0 OR doc_id % 8 <> 0)")
def flt9_hash_complete(spark, d):
    return _media(spark, d).filter(stages.hash_complete()).select("doc_id")


@query(f"{WITH} SELECT doc_id FROM files WHERE doc_id % 9 <> 0 AND doc_id % 8 <> 0")
def flt10_in_tree(spark, d):
    return _media(spark, d).filter(stages.in_tree()).select("doc_id")


@query(f"{WITH} SELECT doc_id FROM files WHERE doc_id % 3 = 0 AND doc_id % 21 = 0 AND doc_id % 120 >= 10 AND doc_id % 20 >= 8")
def flt12_sift_shown(spark, d):
    return _media(spark, d).filter(stages.sift_shown(ratio=0.4 - 1e-6)).select("doc_id")


@query(f"{WITH} SELECT doc_id FROM files WHERE doc_id % 21 = 0 AND (doc_id % 120 < 80 OR doc_id % 20 < 18 OR doc_id % 10 < 4)")
def flt13_sift_weak(spark, d):
    return _media(spark, d).filter(stages.sift_weak(ratio=0.9 - 1e-6)).select("doc_id")


@query(f"{WITH} SELECT doc_id, doc_id % 120 >= 10 AND doc_id % 20 >= 15 AS ok FROM files")
def sim15_accepted(spark, d):
    return _media(spark, d).select("doc_id", stages.accepted("sift_match_inliers", "sift_match_inlier_ratio").alias("ok"))


@query(f"""{WITH} SELECT split_part(file_name, '/', 1) AS grp, max_by(file_name, struct_pack(a := doc_id % 120, b := doc_id % 10, c := -doc_id)) AS best
FROM files GROUP BY ALL""")
def topk4_best_candidate(spark, d):
    return _media(spark, d).groupBy(F.split_part("file_name", F.lit("/"), F.lit(1)).alias("grp")).agg(F.max_by("file_name", F.struct("sift_match_inliers", F.round("sift_match_score", 3), -F.col("doc_id"))).alias("best"))


@query(f"{WITH} SELECT file_name FROM files ORDER BY file_name LIMIT 10")
def topk5_sample(spark, d):
    """The first rows for a report (a top-k by design)."""
    return FILES.df(spark, d).select("file_name").orderBy("file_name").limit(10)


@query(f"""{WITH} SELECT doc_id, CASE WHEN doc_id % 21 = 0
AND (doc_id % 120 < 80 OR doc_id % 20 < 18 OR doc_id % 10 < 4) THEN NULL WHEN doc_id % 21 = 0 THEN 's/y.jpg' END AS sift_match_file FROM files""")
def rel16_sift_cleared(spark, d):
    """Weak links taken out."""
    return stages.cleared(_media(spark, d), stages.sift_weak(ratio=0.9 - 1e-6), stages.SIFT).select("doc_id", "sift_match_file")


@query(f"""{WITH} SELECT doc_id, doc_id % 10 = 0 OR doc_id % 8 = 0 AS skip_processing, CASE WHEN doc_id % 10 = 0 OR doc_id % 9 = 0 THEN NULL
ELSE substr(md5(file_name), 1, 16) END AS phash_hex, CASE WHEN doc_id % 10 = 0 THEN 'image_phash' ELSE NULLIF({_S}, '') END AS stage FROM files""")
def upd1_hash_failed(spark, d):
    return stages.hash_failed(_media(spark, d), F.col("doc_id") % 10 == 0, F.lit("image_phash"), F.lit("broken")).select("doc_id", "skip_processing", "phash_hex", F.col("processing_error_stage").alias("stage"))


@query(f"""{WITH} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN FALSE ELSE {_FACES} END AS faces, CASE WHEN doc_id % 10 = 0 THEN 'faces' ELSE NULLIF({_S},
'') END AS stage FROM files""")
def upd2_faces_failed(spark, d):
    return stages.faces_failed(_media(spark, d), F.col("doc_id") % 10 == 0, F.lit("timeout")).select("doc_id", "faces", F.col("processing_error_stage").alias("stage"))


@query(f"{WITH} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 5 = 2 THEN 'a' WHEN doc_id % 5 IN (3, 4) THEN '' END AS text FROM files")
def upd3_text_failed(spark, d):
    return stages.text_failed(_media(spark, d), F.col("doc_id") % 10 == 0, F.lit("timeout")).select("doc_id", F.get("ocr_groups.text", F.lit(0)).alias("text"))


@query(f"{WITH} SELECT doc_id, {_S} = 'paddle_ocr' OR doc_id % 5 = 0 AS empty FROM files")
def upd4_text_reset(spark, d):
    return stages.text_reset(_media(spark, d)).select("doc_id", F.col("ocr_groups").isNull().alias("empty"))


@query(f"""{WITH} SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE {_FACES} END AS faces, CASE WHEN doc_id % 8 = 0 AND {_S} NOT IN ('image_phash',
'video_hash') THEN NULL ELSE NULLIF({_S}, '') END AS stage FROM files""")
def upd5_demoted(spark, d):
    return stages.demoted(_media(spark, d), F.col("skip_processing")).select("doc_id", "faces", F.col("processing_error_stage").alias("stage"))


@query(f"{WITH} SELECT doc_id FROM files WHERE {_S} = 'faces' OR doc_id % 6 <> 1")
def upd6_face_rerun(spark, d):
    rows = _media(spark, d).withColumn("face_groups", F.expr("array(named_struct('timestamp_sec', CAST(0 AS float), 'face_embeddings', array(array(CAST(1 AS float)))))"))
    return rows.filter(stages.face_rerun(False)).select("doc_id")


@query(f"{WITH} SELECT file_name, doc_id = 5 AS stuck FROM files")
def upd7_stuck(spark, d):
    """The file that the newest status of its collection names in an unfinished face stage."""
    files = FILES.df(spark, d).select("file_name", F.lit("c").alias("collection_id"), "doc_id")
    name = files.filter("doc_id = 5").select("file_name").first()
    status = spark.createDataFrame([("c", 1, "faces_done", "x"), ("c", 3, "faces_running", name.file_name if name else "y"), ("c", 2, "clip_running", "z")], "collection_id string, updated int, state string, file_name string")
    return stages.stuck(files, status).select("file_name", "stuck")


@query(f"{WITH} SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'read' WHEN doc_id % 5 = 2 THEN 'a' WHEN doc_id % 5 IN (3, 4) THEN '' END AS text FROM files")
def upd8_text_filled(spark, d):
    """Unread text filled in by the reader."""
    rows = _media(spark, d).withColumn("ocr_groups", stages.detected_text()).withColumn("read", F.array(F.lit("read")))
    return rows.select("doc_id", F.get(stages.filled_text("read")["text"], F.lit(0)).alias("text"))


@query(f"{WITH} SELECT file_name, CASE WHEN doc_id = 7 THEN TRUE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 6 = 1 END AS faces FROM files")
def upd10_one_file(spark, d):
    """One row written again."""
    rows = _media(spark, d).select("file_name", "doc_id", "faces")
    one = rows.filter("doc_id = 7").withColumn("faces", F.lit(True)).withColumn("seq", F.lit(1))
    return tables.upserted(rows, one, "file_name", "seq").select("file_name", "faces")


@query(f"""{WITH} SELECT CASE WHEN a.source_size > b.source_size THEN b.file_name ELSE a.file_name END AS file_name,
CASE WHEN a.source_size > b.source_size THEN a.file_name ELSE b.file_name END AS sift_match_file FROM files a JOIN files b ON b.doc_id = a.doc_id + 1
AND a.doc_id % 4 = 0 AND a.source_size <> b.source_size""")
def upd11_fast_pair(spark, d):
    """The lower-ranked image of an accepted pair points to the higher."""
    f = FILES.df(spark, d)
    a, b = f.selectExpr("doc_id", "file_name AS a", "source_size AS sa"), f.selectExpr("doc_id - 1 AS doc_id", "file_name AS b", "source_size AS sb")
    pairs = a.join(b, "doc_id").filter("doc_id % 4 = 0").select("a", "b", (F.col("sa") != F.col("sb")).alias("accepted"))
    return duplicates.fast_pair(pairs, f.select("file_name", F.col("source_size").alias("rank")))


@query(f"""{WITH} SELECT file_name, FALSE AS is_video, 1 AS frames FROM files WHERE NOT is_video UNION ALL SELECT split_part(file_name, '/', 1), TRUE,
CAST(count(*) AS INT) FROM files WHERE is_video GROUP BY ALL""")
def bld1_items(spark, d):
    """Items to process: images, and videos with their frames."""
    videos = _videos(spark, d).select(F.split_part("file_name", F.lit("/"), F.lit(1)).alias("file_name"), F.col("doc_id").cast("double").alias("timestamp_sec"), F.col("file_name").alias("image_file"))
    return stages.media_items(_images(spark, d).select("file_name", F.col("file_name").alias("path")), videos).select("file_name", "is_video", F.size("frames").alias("frames"))


@query(f"{WITH} SELECT concat(file_name, '|', printf('%.3f', timestamp_sec), '|', vec_id % 3) AS id FROM frames WHERE vec_id % 2 = 0")
def bld2_face_rows(spark, d):
    """Rows of the table of faces; vectors of another size go."""
    v = F.expr("CASE WHEN vec_id % 2 = 0 THEN vector ELSE slice(vector, 1, 3) END")
    one = FRAMES.df(spark, d).select("file_name", "vec_id", F.array(F.struct("timestamp_sec", F.when(F.col("vec_id") % 3 == 0, F.array(v)).when(F.col("vec_id") % 3 == 1, F.array(F.lit(None), v)).otherwise(F.array(F.lit(None), F.lit(None), v)).alias("face_embeddings"))).alias("face_groups"))
    return tables.face_rows(one, 64).select("id")


@query(f"{WITH} SELECT concat(file_name, '|', printf('%.3f', timestamp_sec)) AS id, file_name, timestamp_sec FROM frames WHERE vec_id % 5 <> 0")
def bld3_clip_rows(spark, d):
    one = FRAMES.df(spark, d).select("file_name", F.array(F.struct("timestamp_sec", F.expr("CASE WHEN vec_id % 5 = 0 THEN slice(vector, 1, 3) ELSE vector END").alias("clip_embedding"))).alias("clip_groups"))
    return tables.clip_rows(one).select("id", "file_name", "timestamp_sec")


@query(f"{WITH} SELECT concat(file_name, '|0.000') AS id, 'a' AS text FROM files WHERE doc_id % 5 = 2")
def bld4_text_rows(spark, d):
    return tables.text_rows(_media(spark, d)).select("id", "text")


@query(f"{WITH} SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN [0.0::DOUBLE] END AS stamps FROM files")
def bld5_stamps(spark, d):
    return _media(spark, d).select("doc_id", groups.stamps(F.col("clip_groups")).alias("stamps"))


@query(f"{WITH} SELECT file_name, doc_id % 3 <> 0 AS reuse FROM files")
def cdc1_unchanged(spark, d):
    """Files whose size and time are those of the index."""
    rows = FILES.df(spark, d)
    listing = rows.select("file_name", F.when(F.col("doc_id") % 3 == 0, F.col("source_size") + 1).otherwise(F.col("source_size")).alias("size"), F.col("source_mtime_ns").alias("mtime_ns"))
    return stages.unchanged(rows, listing).select("file_name", "reuse")


@query(f"{WITH} SELECT file_name, timestamp_sec, vec_id % 4 <> 0 AS pending FROM frames")
def cdc2_frame_hashes(spark, d):
    """Frames without a stored hash of their file and time."""
    rows = FRAMES.df(spark, d)
    stored = rows.filter("vec_id % 4 = 0").select("file_name", vectors.seconds(F.col("timestamp_sec") + 0.0001).alias("ts")).withColumn("there", F.lit(True))
    return rows.withColumn("ts", vectors.seconds(F.col("timestamp_sec"))).join(stored, ["file_name", "ts"], "left").select("file_name", "timestamp_sec", F.col("there").isNull().alias("pending"))


@query(f"{WITH} SELECT file_name FROM files WHERE is_video AND doc_id % 8 <> 0 AND NOT (doc_id % 2 = 0 AND doc_id % 15 <> 0)")
def cdc3_extraction(spark, d):
    """Videos whose stills are taken anew: no copies, and no valid manifest (other size, or a still is gone)."""
    from photonlake.sources import manifests

    v = _media(spark, d).filter("is_video")
    size = F.when(F.col("doc_id") % 2 == 0, F.col("source_size")).otherwise(-1)
    still = F.concat("file_name", F.lit("#0"))
    settings = [F.lit(27.0).alias("scene_threshold"), F.lit(15).alias("min_scene_len"), F.lit(100).alias("max_stills")]
    frames = F.array(F.struct(F.lit(0.0).alias("timestamp_sec"), still.alias("image_file"))).alias("frames")
    rows = v.select(F.col("file_name").alias("video"), F.col("source_size").alias("size"), F.col("source_mtime_ns").alias("mtime_ns"), size.alias("source_size"), "source_mtime_ns", *settings, frames)
    valid = manifests.stills_valid(rows, v.filter("doc_id % 15 <> 0").select(still.alias("image_file")), 27.0, 15, 100)
    return stages.to_extract(v, valid).select("file_name")


@query(f"""{_COPIES} SELECT x.file_name, CASE WHEN x.is_video THEN x.master WHEN x.doc_id % 2 = 0 THEN concat('r',
x.doc_id % 10) WHEN m.doc_id % 2 = 0 THEN concat('r', m.doc_id % 10) ELSE x.master END AS master FROM ix x JOIN files m ON m.file_name = x.master""")
def dup1_panel_master(spark, d):
    """The master that a file's panel starts from."""
    ix = _index(spark, d)
    roots = ix.filter("doc_id % 2 = 0").select(F.col("file_name").alias("node"), F.concat(F.lit("r"), F.col("doc_id") % 10).alias("root"))
    return duplicates.panel_master(ix, roots)


@query(f"""{WITH}, act AS (SELECT h FROM files WHERE doc_id = 3) SELECT f.file_name, (64 - bit_count(xor(f.h, a.h))) * 100.0::DOUBLE / 64 AS pct FROM files f,
act a WHERE NOT f.is_video""")
def dup2_panel(spark, d):
    """Similarity of images to the active one."""
    active = F.lit(FILES.df(spark, d).filter("doc_id = 3").first().h).cast("long")
    none = F.lit(None).cast("array<bigint>")
    return _images(spark, d).select("file_name", hamming.file_similarity(active, F.col("h"), none, none, F.lit(False), F.col("is_video")).alias("pct"))


@query(f"""{WITH}, act AS (SELECT h FROM files WHERE doc_id = 5), v AS (SELECT split_part(file_name, '/', 1) AS grp, list(h) AS hs FROM files WHERE NOT is_video
GROUP BY ALL) SELECT v.grp, list_max(list_transform(hs, lambda x: (64 - bit_count(xor(x, a.h))) * 100.0::DOUBLE / 64)) AS pct FROM v, act a""")
def sim13_hash_similarity(spark, d):
    """A video's similarity to an image is its best frame's."""
    active = F.lit(FILES.df(spark, d).filter("doc_id = 5").first().h).cast("long")
    rows = _images(spark, d).groupBy(F.split_part("file_name", F.lit("/"), F.lit(1)).alias("grp")).agg(F.collect_list("h").alias("hs"))
    none = F.lit(None).cast("array<bigint>")
    return rows.select("grp", hamming.file_similarity(active, F.lit(None).cast("long"), none, F.col("hs"), F.lit(False), F.lit(True)).alias("pct"))


@query(f"{GROUPS} SELECT count(DISTINCT grp) AS grps, count(DISTINCT file_name) AS files FROM grouped")
def dup3_counts(spark, d):
    return _grouped(spark, d).agg(F.count_distinct("grp").alias("grps"), F.count_distinct("file_name").alias("files"))


@query(f"""{COMPONENTS}, sel AS (SELECT file_name, inliers AS place FROM edges WHERE checked AND inliers < 5), u AS (SELECT file_name, place, 0 AS k FROM sel
UNION ALL SELECT m.node, s.place, 1 FROM sel s JOIN comp c ON c.node = s.file_name JOIN comp m ON m.root = c.root), f AS (SELECT file_name,
min(struct_pack(a := place, b := k)) AS spot FROM u GROUP BY file_name) SELECT file_name, CAST(row_number() OVER (ORDER BY spot,
file_name) AS INT) AS place FROM f""")
def dup4_expanded(spark, d):
    """A selection with the whole groups of its files."""
    sel = EDGES.df(spark, d).filter("checked AND inliers < 5").select("file_name", F.col("inliers").alias("place"))
    return duplicates.expanded(sel, graph.components(_edges(spark, d)))


@query(f"""{WITH} SELECT path, min(doc_id) AS place FROM (SELECT doc_id, concat('p', doc_id % 20) AS path FROM files WHERE doc_id % 3 <> 0) GROUP BY path
ORDER BY place LIMIT 6""")
def dup5_compared(spark, d):
    return duplicates.compared(FILES.df(spark, d).select(F.concat(F.lit("p"), F.col("doc_id") % 20).alias("path"), F.col("doc_id").alias("place"), (F.col("doc_id") % 3 != 0).alias("path_exists"), F.lit(True).alias("supported")))


_SIM = "list_cosine_similarity([b.x, b.y], [a.x, a.y])"


@query(f"""WITH RECURSIVE v AS (SELECT doc_id, i, CAST((doc_id * 7 + i * 13) % 10 AS DOUBLE) + 1 AS x, CAST((doc_id * 3 + i * 5) % 10 AS DOUBLE) AS y
FROM documents, (SELECT unnest(range(0, 6)) AS i)),
near AS (SELECT a.doc_id, a.i, list(b.i) AS like_ FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.i < a.i AND {_SIM} >= 0.995 GROUP BY ALL),
run AS (SELECT doc_id, -1::BIGINT AS i, []::BIGINT[] AS kept FROM documents UNION ALL
  SELECT r.doc_id, r.i + 1, CASE WHEN len(list_intersect(r.kept, coalesce(n.like_, []))) = 0 THEN list_append(r.kept, r.i + 1) ELSE r.kept END
FROM run r LEFT JOIN near n ON n.doc_id = r.doc_id AND n.i = r.i + 1 WHERE r.i < 5)
SELECT doc_id, kept FROM run WHERE i = 5""")
def agg24_distinct_vectors(spark, d):
    """Vectors of one frame without near repeats, in their order: which of six vectors, that differ from frame to frame, stay."""
    vector = lambda i: F.array(((F.col("doc_id") * 7 + i * 13) % 10).cast("double") + 1, ((F.col("doc_id") * 3 + i * 5) % 10).cast("double"))
    frames = table(spark, d, "documents").select("doc_id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")), lambda i: F.struct(i.alias("i"), vector(i).alias("v"))).alias("vectors"))
    return frames.select("doc_id", groups.distinct_vectors(F.col("vectors"), "v", 0.995)["i"].alias("kept"))


@query("SELECT o_custkey, max_by(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def agg1_best_per_key(spark, d):
    """The best row of each key, by partial and final aggregation."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM (SELECT *,
lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type) WHERE n <= 20""")
def topk6_history(spark, d):
    """The last twenty searches of each user, without repeats in a row (a ring by design)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type").withColumn("before", F.lag("event_type").over(w)).filter(~F.col("before").eqNullSafe(F.col("event_type")))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_id").desc()))).filter("n <= 20").select("user_id", "event_id", "event_type")


@query("SELECT source AS k, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def agg25_repeated_keys(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


# Table upkeep


@query("""SELECT o_custkey AS c_custkey, round(arg_max(o_totalprice, o_orderkey), 2) AS c_acctbal FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey,
round(c_acctbal, 2) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def snk1_upsert(spark, d):
    """Keyed upsert of a batch in which the last row of a key counts."""
    base = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    batch = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("seq"))
    return tables.upserted(base, batch, "c_custkey", "seq").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(NULL AS VARCHAR) AS note FROM customer")
def snk3_conformed(spark, d):
    """A table under a newer schema."""
    from pyspark.sql import types as T

    new = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_nationkey", T.LongType()), T.StructField("note", T.StringType())])
    return tables.conformed(table(spark, d, "customer"), new)


@query(f"""{WITH} SELECT file_name, timestamp_sec, CASE WHEN file_name LIKE 'c1/%' THEN 'new' ELSE 'old' END AS state FROM frames
WHERE NOT (file_name LIKE 'c1/%' AND timestamp_sec = 2)""")
def snk5_synced(spark, d):
    """Side table after a run: changed files' rows are made again."""
    side = FRAMES.df(spark, d).select("file_name", "timestamp_sec").withColumn("state", F.lit("old"))
    new = side.filter("timestamp_sec < 2").withColumn("state", F.lit("new"))
    return tables.synced(side, new, side.filter("file_name LIKE 'c1/%'"))


@query(f"""{WITH}, changed AS (SELECT DISTINCT file_name FROM frames WHERE file_name LIKE 'c1/%')
SELECT vec_id AS id, CASE WHEN file_name LIKE 'c1/%' THEN 'new' ELSE 'old' END AS state FROM frames WHERE file_name NOT LIKE 'c1/%' OR timestamp_sec < 2""")
def snk5_index_refreshed(spark, d):
    """A vector index after a run: the rows of changed files are coded again under the same centroids."""
    rows = FRAMES.df(spark, d).select(F.col("vec_id").alias("id"), "file_name", "timestamp_sec", "vector").withColumn("state", F.lit("old"))
    one, two = (f"{shared_dir(spark)}/photonlake-index-{uuid.uuid4().hex}" for _ in range(2))
    vector_index.build(rows, one, 64)
    vector_index.refreshed(spark, one, rows.filter("timestamp_sec < 2").withColumn("state", F.lit("new")), rows.filter("file_name LIKE 'c1/%'"), two)
    return vector_index.opened(spark, two)[0].select("id", "state")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def snk6_delete(spark, d):
    """Rows without those of some keys."""
    keys = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.without(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), keys, "l_orderkey")


@query(f"""{WITH}, per AS (SELECT split_part(file_name, '/', 1) AS b, count(*) AS n, bool_or(doc_id % 5 = 2 AND lang <> 'en') AS text FROM (SELECT f.*,
split_part(file_name, '/', 2) AS lang FROM files f) GROUP BY ALL),
wanted AS (SELECT concat(b, unnest(CASE WHEN text THEN ['_face_ann', '_clip_ann', '_ocr_ann'] ELSE ['_face_ann', '_clip_ann'] END)) AS name FROM per),
there AS (SELECT concat(b, CASE n % 3 WHEN 0 THEN '_face_ann' WHEN 1 THEN '_clip_ann' ELSE '_ocr_ann' END) AS name FROM per)
SELECT name FROM wanted WHERE name NOT IN (SELECT name FROM there)""")
def snk7_missing_tables(spark, d):
    """The side tables that each source lacks."""
    text = "CASE WHEN lang <> 'en' THEN ocr_groups END AS ocr_groups"
    rows = _media(spark, d).withColumns({"base": F.split_part("file_name", F.lit("/"), F.lit(1)), "lang": F.split_part("file_name", F.lit("/"), F.lit(2))}).selectExpr("base", text)
    there = rows.groupBy("base").agg(F.count(F.lit(1)).alias("n")).selectExpr("concat(base, CASE n % 3 WHEN 0 THEN '_face_ann' WHEN 1 THEN '_clip_ann' ELSE '_ocr_ann' END) AS name")
    return tables.missing_tables(rows, there)


@query(f"{WITH} SELECT concat('new/', file_name) AS file_name FROM files")
def snk8_renamed(spark, d):
    """Old keys under a collection."""
    return tables.renamed_keys(FILES.df(spark, d).select("file_name"), "new")


@query("SELECT concat('src', n_nationkey) AS collection_id, CASE WHEN n_nationkey = 3 THEN '/moved' ELSE n_name END AS root_path FROM nation")
def rel8_roots(spark, d):
    roots = table(spark, d, "nation").select(F.concat(F.lit("src"), "n_nationkey").alias("collection_id"), F.col("n_name").alias("root_path"))
    return relocate.moved_roots(roots, "src3", "/moved")


@query("SELECT concat('c', n_nationkey) AS collection_id, concat('/m/', n_name) AS root_path FROM nation")
def snk9_roots_written(spark, d):
    """Roots written in order and read again."""
    from photonlake.plans.storage import kept

    return kept(table(spark, d, "nation").select(F.concat(F.lit("c"), "n_nationkey").alias("collection_id"), F.concat(F.lit("/m/"), "n_name").alias("root_path")).orderBy("collection_id"), "roots")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 3))")
def snk12_gone_files(spark, d):
    """Rows of a collection (urgent orders) whose file (a third line) isn't there any more go; other collections' rows stay."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("file_name"), F.col("o_orderpriority").alias("collection_id"))
    listing = table(spark, d, "lineitem").filter("l_linenumber >= 3").select(F.col("l_orderkey").cast("string").alias("file_name"))
    return tables.present_only(rows, listing, "1-URGENT").select("o_orderkey")


@query("""SELECT user_id AS collection_id, max(epoch_us(ts)) AS updated, arg_max(event_type, struct_pack(a := epoch_us(ts), b := event_type)) AS state
FROM events GROUP BY user_id""")
def snk13_newest_status(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("collection_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("updated"), F.col("event_type").alias("state"))
    return tables.newest_status(rows)


# Relocation: orders move to new keys; every third one to two places.

MAP = "(SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 3 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS chat FROM orders WHERE o_orderkey % 5 <> 0)"


def _mapping(spark, d):
    rows = table(spark, d, "orders").filter("o_orderkey % 5 <> 0").select("o_orderkey", F.explode(F.expr("IF(o_orderkey % 3 = 0, array('a', 'b'), array('a'))")).alias("chat"))
    key = F.concat(F.lit("old/"), "o_orderkey")
    return rows.select(key.alias("old_key"), F.concat(F.lit("new/"), "chat", F.lit("/"), "o_orderkey").alias("new_key"), "chat", F.col("o_orderkey").alias("size"), (F.col("o_orderkey") * 2).alias("mtime_ns"))


def _orders(spark, d):
    """Orders as an index whose rows refer to the order before."""
    rows = table(spark, d, "orders")
    ref = F.concat(F.lit("old/"), F.col("o_orderkey") - 1)
    return rows.select(F.concat(F.lit("old/"), "o_orderkey").alias("file_name"), F.lit("old").alias("collection_id"), F.lit(0).cast("long").alias("source_size"), F.lit(0).cast("long").alias("source_mtime_ns"), ref.alias("dedupe_match_file"), F.lit(None).cast("string").alias("sift_match_file"))


FAN = f"SELECT CASE WHEN m.chat IS NULL THEN concat('old/', o.o_orderkey) ELSE concat('new/', m.chat, '/', o.o_orderkey) END AS file_name, CASE WHEN m.chat IS NOT NULL THEN o.o_orderkey ELSE 0 END AS source_size, m.chat, o.o_orderkey FROM orders o LEFT JOIN {MAP} m ON m.o_orderkey = o.o_orderkey"


@query(f"SELECT file_name, source_size FROM ({FAN})")
def rel1_fanout(spark, d):
    """A row for each new place of a file."""
    return relocate.fan_out(_orders(spark, d), _mapping(spark, d)).select("file_name", "source_size")


@query(f"""SELECT f.file_name, CASE WHEN n.o_orderkey IS NULL THEN concat('old/', f.o_orderkey - 1) ELSE concat('new/', CASE WHEN (f.o_orderkey - 1) % 3 = 0
AND f.chat = 'b' THEN 'b' ELSE 'a' END, '/', f.o_orderkey - 1) END AS ref FROM ({FAN}) f LEFT JOIN (SELECT o_orderkey FROM orders
WHERE o_orderkey % 5 <> 0) n ON n.o_orderkey = f.o_orderkey - 1""")
def rel2_references(spark, d):
    """References follow to the place of the same chat, else to the first."""
    m = _mapping(spark, d)
    return relocate.referred(relocate.fan_out(_orders(spark, d), m), m, "dedupe_match_file").select("file_name", F.col("dedupe_match_file").alias("ref"))


@query(f"SELECT concat(file_name, '|1.000') AS id, file_name FROM ({FAN})")
def rel3_path_rows(spark, d):
    rows = _orders(spark, d).select(F.concat("file_name", F.lit("|1.000")).alias("id"), "file_name")
    return relocate.path_rows(rows, _mapping(spark, d))


@query("""SELECT concat('old/', o_orderkey) AS file_name, CASE WHEN (o_orderkey - 1) % 5 = 0 THEN NULL ELSE concat('old/', o_orderkey - 1) END AS ref
FROM orders WHERE o_orderkey % 5 <> 0""")
def rel4_dropped(spark, d):
    """Dropped rows go, and references to them become null."""
    rows, m = _orders(spark, d), _mapping(spark, d)
    drop = rows.filter("CAST(split_part(file_name, '/', 2) AS BIGINT) % 5 = 0").select("file_name")
    zero = spark.createDataFrame([("old/0",)], "file_name string")
    kept_ = relocate.fan_out(rows, m.limit(0), drop)
    return relocate.referred(kept_, m.limit(0), "dedupe_match_file", drop.unionByName(zero)).select("file_name", F.col("dedupe_match_file").alias("ref"))


@query("SELECT concat('n/', o_custkey) AS new_key, count(DISTINCT o_orderkey) AS sources FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) > 1")
def rel5_collisions(spark, d):
    m = table(spark, d, "orders").select(F.concat(F.lit("n/"), "o_custkey").alias("new_key"), F.concat(F.lit("o/"), "o_orderkey").alias("old_key"))
    return relocate.collisions(m)


@query(f"""{WITH} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'x' END AS ref, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 9.5::DOUBLE END AS pct,
CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'y' END AS sift, CASE WHEN doc_id % 3 = 0 THEN [NULL, NULL, NULL, NULL] ELSE [0.5, 40, 50,
0.8]::DOUBLE[] END AS figures, doc_id % 5 <> 0 AS checked,
CASE WHEN doc_id % 2 = 0 THEN ['z'] ELSE ['z', 'w'] END AS links FROM files""")
def rel6_self_links(spark, d):
    """Links of files to themselves go, each with all its figures; that a file was checked stays."""
    link = lambda name: F.struct(name.alias("file_name"), F.lit(True).alias("is_video"))
    rows = FILES.df(spark, d).select(
        "doc_id", "file_name", F.expr("IF(doc_id % 2 = 0, file_name, 'x')").alias("dedupe_match_file"), F.lit(9.5).cast("double").alias("dedupe_similarity_pct"),
        F.expr("IF(doc_id % 3 = 0, file_name, 'y')").alias("sift_match_file"), F.lit(0.5).alias("sift_match_score"), F.lit(40).alias("sift_match_inliers"), F.lit(50).alias("sift_match_good_matches"), F.lit(0.8).alias("sift_match_inlier_ratio"),
        (F.col("doc_id") % 5 != 0).alias("sift_match_checked"), F.array(link(F.lit("z")), link(F.expr("IF(doc_id % 2 = 0, file_name, 'w')"))).alias("cross_media_matches"),
    )
    figures = F.array(*[F.col(c).cast("double") for c in ("sift_match_score", "sift_match_inliers", "sift_match_good_matches", "sift_match_inlier_ratio")])
    clean = relocate.without_self(rows)
    return clean.select("doc_id", F.col("dedupe_match_file").alias("ref"), F.col("dedupe_similarity_pct").alias("pct"), F.col("sift_match_file").alias("sift"), figures.alias("figures"), F.col("sift_match_checked").alias("checked"), F.col("cross_media_matches.file_name").alias("links"))


# Rows that move to one customer: priorities and dates may differ, links come with their figures.
_MOVED = """SELECT o_custkey AS file_name, o_orderkey AS old_key, o_orderkey = first_key AND o_custkey % 2 = 0 AS is_primary, CASE WHEN o_orderkey % 2 = 0
THEN o_orderstatus END AS note,
CASE WHEN o_orderkey % 4 = 1 THEN 'm' END AS dedupe_match_file, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 0
THEN 90.0 + o_custkey % 2 END AS dedupe_similarity_pct,
CASE WHEN o_orderkey % 8 < 4 THEN 640 + 10 * (o_custkey % 3) END AS image_width, CASE WHEN o_orderkey % 8 < 2 THEN 480 END AS image_height
FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_key FROM orders)"""
_AGREED = "dedupe_match_file IS NOT NULL OR dedupe_similarity_pct IS NOT NULL"


@query(f"""WITH r AS ({_MOVED}), per AS (SELECT file_name, count(*) AS merged, count(DISTINCT note) > 1 AS dn,
count(DISTINCT dedupe_match_file) > 1 OR count(DISTINCT dedupe_similarity_pct) > 1 AS dd,
  count(DISTINCT image_width) > 1 OR count(DISTINCT image_height) > 1 AS di, min(note) AS one, coalesce(min(old_key) FILTER (WHERE is_primary),
min(old_key)) AS base, bool_or(is_primary) AS has_primary,
  min(old_key) FILTER (WHERE {_AGREED}) AS kd, min(old_key) FILTER (WHERE image_width IS NOT NULL OR image_height IS NOT NULL) AS ki FROM r GROUP BY file_name)
SELECT p.file_name, p.merged, p.dn OR p.dd OR p.di AS conflict, NOT (p.dn OR p.dd OR p.di) OR p.has_primary AS resolved, coalesce(b.note, CASE
WHEN NOT p.dn THEN p.one END) AS note,
  CASE WHEN b.dedupe_match_file IS NULL AND b.dedupe_similarity_pct IS NULL AND NOT p.dd THEN x.dedupe_match_file
ELSE b.dedupe_match_file END AS dedupe_match_file,
  CASE WHEN b.dedupe_match_file IS NULL AND b.dedupe_similarity_pct IS NULL AND NOT p.dd THEN x.dedupe_similarity_pct
ELSE b.dedupe_similarity_pct END AS dedupe_similarity_pct,
  CASE WHEN b.image_width IS NULL AND b.image_height IS NULL AND NOT p.di THEN y.image_width ELSE b.image_width END AS image_width,
  CASE WHEN b.image_width IS NULL AND b.image_height IS NULL AND NOT p.di THEN y.image_height ELSE b.image_height END AS image_height
FROM per p JOIN r b ON b.file_name = p.file_name AND b.old_key = p.base LEFT JOIN r x ON x.file_name = p.file_name AND x.old_key = p.kd LEFT
JOIN r y ON y.file_name = p.file_name AND y.old_key = p.ki""")
def agg22_coalesced(spark, d):
    """Rows that move to one key become one: families as a whole, single values if all agree, and the primary source where they don't."""
    table(spark, d, "orders").createOrReplaceTempView("photonlake_orders")
    rows = spark.sql(_MOVED.replace("FROM orders", "FROM photonlake_orders"))
    return relocate.coalesced(rows, primary="is_primary", strict=False)


@query("SELECT o_custkey AS file_name, concat(o_custkey, '|0') AS id, o_orderkey FROM orders ORDER BY 1, 2, 3")
def rel7_fan_in_order(spark, d):
    """Rows that move to one key, by target, id and old key."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("file_name"), F.concat(F.col("o_custkey").cast("string"), F.lit("|0")).alias("id"), "o_orderkey")
    return rows.repartition("file_name", "id").sortWithinPartitions("file_name", "id", "o_orderkey")


@query("SELECT o_custkey AS file_name, count(DISTINCT o_orderstatus) AS rows, count(DISTINCT o_orderstatus) > 1 AS many FROM orders GROUP BY o_custkey")
def agg23_variants(spark, d):
    """Different payloads of one id get ids of their own."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("file_name"), F.col("o_custkey").cast("string").alias("id"), F.col("o_orderstatus").alias("payload"))
    v = relocate.variants(rows, ["payload"])
    return v.groupBy("file_name").agg(F.count_distinct("id").alias("rows"), F.max(F.contains("id", F.lit("|variant:"))).alias("many"))


@query("""SELECT count(*) AS keys, count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS mapped, count(*) FILTER (WHERE o_orderkey % 5 = 0
AND o_orderkey % 2 = 1) AS unmapped, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS excluded, 0 AS missing, 0 AS repeated, 0 AS collisions FROM orders""")
def agg20_inventory(spark, d):
    rows = _orders(spark, d)
    excluded = rows.filter("CAST(split_part(file_name, '/', 2) AS BIGINT) % 10 = 0")
    return relocate.inventory(rows, _mapping(spark, d), excluded, "old").select(*[F.col(c).cast("long").alias(c) for c in ("keys", "mapped", "unmapped", "excluded", "missing", "repeated", "collisions")])


_PLANTED = """SELECT count(*) FILTER (WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0) AS gone, count(*) FILTER (WHERE o_orderkey % 5 = 0
AND o_orderkey % 11 = 0) AS twice,
count(*) FILTER (WHERE o_orderkey % 5 = 0 AND o_orderkey % 13 = 0 AND (o_orderkey - 1) IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)) AS once,
count(*) FILTER (WHERE o_orderkey % 5 = 0 AND o_orderkey % 143 = 0 AND (o_orderkey - 1) IN (SELECT o_orderkey FROM orders
WHERE o_orderkey % 5 <> 0)) AS again FROM orders"""


@query(f"""WITH p AS ({_PLANTED}) SELECT 'repeated keys' AS "check", twice AS faults FROM p UNION ALL SELECT 'stale references', once + again FROM p UNION ALL
SELECT 'uncovered targets', gone FROM p UNION ALL SELECT 'conservation', abs(twice - gone) FROM p""")
def rel10_validated(spark, d):
    """Checks of a moved table into which faults were planted: rows that are missing, rows that come twice, and references that weren't rewritten."""
    rows, m = _orders(spark, d), _mapping(spark, d)
    key = F.regexp_extract("file_name", "([0-9]+)$", 1).cast("long")
    out = relocate.referred(relocate.fan_out(rows, m), m, "dedupe_match_file").withColumn("k", key)
    out = out.filter(~((F.col("k") % 5 != 0) & (F.col("k") % 7 == 0) & (F.col("k") % 3 != 0)))
    stale = (F.col("k") % 5 == 0) & (F.col("k") % 13 == 0)
    out = out.withColumn("dedupe_match_file", F.when(stale, F.concat(F.lit("old/"), F.col("k") - 1)).otherwise(F.col("dedupe_match_file")))
    out = out.unionByName(out.filter("k % 5 = 0 AND k % 11 = 0"))
    return relocate.faults(out, m, rows.count(), 0, 0).select("check", F.col("faults").cast("long").alias("faults"))


@query(f"""SELECT (SELECT count(*) FROM ({FAN})) AS output, (SELECT count(*) FROM orders) AS source, (SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0
AND o_orderkey % 3 = 0) AS cloned""")
def agg21_conservation(spark, d):
    rows, m = _orders(spark, d), _mapping(spark, d)
    one = relocate.fan_out(rows, m).agg(F.count(F.lit(1)).alias("output"))
    return one.join(rows.agg(F.count(F.lit(1)).alias("source")), F.lit(True)).join(m.groupBy("old_key").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n").alias("cloned")), F.lit(True))


@query(f"""SELECT concat('old/', o_orderkey) AS old_key, concat('new/', chat, '/', o_orderkey) AS new_key, 'present' AS status FROM {MAP} UNION ALL
SELECT concat('old/', o_orderkey), NULL, CASE WHEN o_orderkey % 2 = 0 THEN 'excluded' ELSE 'missing' END FROM orders WHERE o_orderkey % 5 = 0""")
def rel9_ledger(spark, d):
    rest = _orders(spark, d).select("file_name", F.split_part("file_name", F.lit("/"), F.lit(2)).cast("long").alias("k")).filter("k % 5 = 0")
    return relocate.ledger(_mapping(spark, d), rest.filter("k % 2 = 1"), rest.filter("k % 2 = 0"))


@query("""SELECT concat('old/', c_custkey) AS file_name, n IS NOT NULL AS there, n AS size, last AS mtime_ns FROM customer LEFT JOIN (SELECT o_custkey,
count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY ALL) ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING'""")
def rel11_export(spark, d):
    """Files of a collection (customers of a segment) with their state on disk (their orders)."""
    rows = table(spark, d, "customer").select(F.concat(F.lit("old/"), "c_custkey").alias("file_name"), F.col("c_mktsegment").alias("collection_id"))
    listing = table(spark, d, "orders").groupBy(F.concat(F.lit("old/"), "o_custkey").alias("file_name")).agg(F.count(F.lit(1)).alias("size"), F.max("o_orderkey").alias("mtime_ns"))
    return relocate.inventory_rows(rows, listing, "BUILDING")


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents")
def rel12_content(spark, d):
    """Sizes and digests of contents."""
    data = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", F.sha2(data, 256).alias("sha256"), F.octet_length(data).cast("long").alias("size"))


@query("""SELECT concat('c/chat', o_custkey % 3, '/', o_orderkey, '.jpg') AS old_key, concat('c/chat', o_custkey % 3, '/2020-01-01T00__x/', o_orderkey,
'.jpg') AS new_key FROM orders WHERE o_orderkey % 4 <> 0""")
def rel13_range_repair(spark, d):
    """Files found again in range folders by chat, tail and size."""
    rows = table(spark, d, "orders")
    chat = F.concat(F.lit("chat"), F.col("o_custkey") % 3)
    keys = rows.select(F.concat(F.lit("c/"), chat, F.lit("/"), "o_orderkey", F.lit(".jpg")).alias("file_name"), F.col("o_custkey").alias("size"))
    files = rows.select(F.concat(chat, F.lit("/2020-01-01T00__x/"), "o_orderkey", F.lit(".jpg")).alias("path"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).alias("size"))
    return relocate.repair_candidates(keys, files, "c")


_RANGED = """WITH keys AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 9 = 0 THEN 'p' ELSE concat('chat', o_custkey % 3) END AS chat, o_orderkey % 1000 AS name,
o_custkey AS size FROM orders),
files AS (SELECT chat, name, f, CASE WHEN k % 4 = 0 THEN -1 ELSE size END AS size FROM (SELECT DISTINCT chat, name, size, k, unnest(CASE
WHEN k % 6 = 0 THEN ['2020-01-01T00__x', '2021-01-01T00__y'] ELSE ['2020-01-01T00__x'] END) AS f FROM keys))"""


@query(f"""{_RANGED}, known AS (SELECT DISTINCT chat, name, size FROM keys), met AS (SELECT k.chat, k.name, k.size, count(*) AS n, min(f) AS f FROM known k
JOIN files USING (chat, name, size) WHERE lower(k.chat) <> 'p' GROUP BY ALL),
one AS (SELECT *, count(*) OVER (PARTITION BY chat, name, f) AS m FROM met WHERE n = 1), taken AS (SELECT chat, name FROM known WHERE size % 10 = 3)
SELECT concat('c/', chat, '/', name, '.jpg#', size) AS old_key, concat('c/', chat, '/', f, '/', name, '.jpg') AS new_key FROM
  (SELECT *, count(*) OVER (PARTITION BY chat, f, name) AS alone FROM met WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.chat = met.chat
AND t.name = met.name)) WHERE alone = 1""")
def join13_repair_join(spark, d):
    """Keys with just one file of their chat, name and size in a range folder: not with two or none, not below p, not onto a key that is there, and not two onto one."""
    table(spark, d, "orders").createOrReplaceTempView("photonlake_orders")
    known = spark.sql(_RANGED.split(",\nfiles")[0].replace("FROM orders", "FROM photonlake_orders") + " SELECT DISTINCT chat, name, size, k FROM keys")
    split = F.when(F.col("k") % 6 == 0, F.array(F.lit("2020-01-01T00__x"), F.lit("2021-01-01T00__y"))).otherwise(F.array(F.lit("2020-01-01T00__x")))
    name = F.concat(F.col("name").cast("string"), F.lit(".jpg"))
    files = known.select("chat", name.alias("tail"), F.explode(split).alias("f"), F.when(F.col("k") % 4 == 0, F.lit(-1)).otherwise(F.col("size")).alias("size"))
    files = files.select(F.concat_ws("/", "chat", "f", "tail").alias("path"), "size")
    once = known.select("chat", "name", "size").distinct()
    keys = once.select(F.concat(F.lit("c/"), "chat", F.lit("/"), name).alias("file_name"), "size")
    taken = once.filter("size % 10 = 3").select(F.explode(F.transform(F.array(F.lit("2020-01-01T00__x"), F.lit("2021-01-01T00__y")), lambda f: F.concat(F.lit("c/"), "chat", F.lit("/"), f, F.lit("/"), name))).alias("file_name"), F.lit(-2).cast("long").alias("size"))
    found = relocate.repair_candidates(keys.unionByName(taken.distinct()), files, "c", by="size")
    return found.select(F.concat("old_key", F.lit("#"), F.col("size").cast("string")).alias("old_key"), "new_key")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'removed' WHEN o_orderkey % 10 = 1 THEN 'changed' END AS change FROM orders
WHERE o_orderkey % 10 IN (0, 1)
UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 10 = 2""")
def rel14_snapshot(spark, d):
    """What a job changed in a table that it should have left alone: a snapshot written before against the table after."""
    from photonlake.plans.storage import kept

    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    before = kept(rows, "snapshot")
    touched = rows.filter("o_orderkey % 10 <> 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 == 1, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey")))
    after = kept(touched.unionByName(rows.filter("o_orderkey % 10 = 2").withColumn("o_orderkey", -F.col("o_orderkey"))), "snapshot")
    return relocate.changes(before, after, "o_orderkey", ["o_custkey", "o_orderstatus"])


@query("""WITH t AS (SELECT o_custkey AS c, o_orderkey % 4 AS place, o_orderpriority AS col, o_orderstatus AS kind FROM orders WHERE o_orderkey % 3 = 0),
old AS (SELECT c, list(col ORDER BY place, col, kind) AS cols, list(kind ORDER BY place, col, kind) AS kinds FROM t GROUP BY c),
u AS (SELECT c, place, CASE WHEN c % 7 = 0 THEN 'other' ELSE col END AS col, CASE WHEN c % 11 = 0 THEN 'Z' ELSE kind END AS kind FROM t
WHERE c % 5 <> 0 UNION ALL SELECT -c, place, col, kind FROM t WHERE c % 13 = 0),
new AS (SELECT c, list(col ORDER BY place, col, kind) AS cols, list(kind ORDER BY place, col, kind) AS kinds FROM u GROUP BY c)
SELECT coalesce(o.c, n.c) AS name, CASE WHEN n.c IS NULL THEN 'missing' WHEN o.c IS NULL THEN 'unexpected' WHEN o.cols <> n.cols THEN 'columns'
ELSE 'types' END AS fault FROM old o FULL JOIN new n ON o.c = n.c WHERE n.c IS NULL OR o.c IS NULL OR o.cols <> n.cols OR o.kinds <> n.kinds""")
def rel15_layouts(spark, d):
    """What sorted tables are sorted by, captured before a rebuild and checked after it, with faults planted in between."""
    rows = table(spark, d, "orders").filter("o_orderkey % 3 = 0").selectExpr("o_custkey AS name", "o_orderkey % 4 AS place", "o_orderpriority AS column", "o_orderstatus AS type")
    new = rows.filter("name % 5 <> 0").selectExpr("name", "place", "IF(name % 7 = 0, 'other', column) AS column", "IF(name % 11 = 0, 'Z', type) AS type")
    new = new.unionByName(rows.filter("name % 13 = 0").withColumn("name", -F.col("name")))
    return tables.index_faults(tables.tables_sorted(rows), tables.tables_sorted(new))


@query("""SELECT concat('c/', c_custkey) AS file_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders
WHERE o_orderstatus = 'F') AND c_nationkey >= 5""")
def set1_unmapped(spark, d):
    """Keys of a collection (customers of a segment) that are neither mapped (by their finished orders) nor excluded (by nation)."""
    rows = table(spark, d, "customer").select(F.concat(F.lit("c/"), "c_custkey").alias("file_name"), F.col("c_mktsegment").alias("collection_id"), "c_nationkey")
    mapping = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("c/"), "o_custkey").alias("old_key"))
    return relocate.unmapped(rows, mapping, rows.filter("c_nationkey < 5"), "BUILDING")


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def set2_mapped(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").filter("c_nationkey < 10").select("c_custkey"))


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def set3_active_keys(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("k"))).distinct()


@query("SELECT DISTINCT doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def set4_changed(spark, d):
    """Files that any stage changed."""
    rows = table(spark, d, "documents").select("doc_id")
    return rows.filter("doc_id % 2 = 0").unionByName(rows.filter("doc_id % 3 = 0")).distinct()


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['new/a', 'new/b'] WHEN doc_id % 3 = 1 THEN [] ELSE ['x'] END AS links FROM documents")
def scl42_links_rewritten(spark, d):
    """Arrays of links under new keys."""
    item = "named_struct('file_name', CASE doc_id % 3 WHEN 0 THEN 'old' WHEN 1 THEN 'gone' ELSE 'x' END, 'is_video', FALSE, 'similarity_pct', CAST(1 AS float))"
    rows = FILES.df(spark, d).selectExpr("doc_id", "file_name", f"array({item}, {item}) AS cross_media_matches")
    m = spark.createDataFrame([("old", "new/a", "a"), ("old", "new/b", "b")], "old_key string, new_key string, chat string")
    gone = spark.createDataFrame([("gone",)], "file_name string")
    return relocate.referred_links(rows, m, drop=gone).select("doc_id", F.sort_array("cross_media_matches.file_name").alias("links"))
