"""Similarity and text search over frames: threshold, best frame of each file, rank.

Results have file_name, is_video, timestamp_sec, score and rank. The best frame of a file has the highest score and then the smallest
time; ranks follow the score downwards and then the file name. Queries are few and come from the caller, so they are literals of
the plan; the frames are scanned once, a batch of them is scored by one matrix product, and only one row per file is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonlake.functions import vectors
from photonlake.functions.paths import in_folder
from photonlake.operators import tables
from photonlake.plans.storage import kept

ORDERS = ("best", "newest", "oldest")


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place, from 1, in a total order. Ranges of the order are sorted by themselves; how many rows the ranges before hold is added to a row's place in its own. So
    no task gets all rows. The ranged rows are written, as a range would be cut anew when it is computed again."""
    ranged = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranged")
    own = F.shiftright("__at", 33)
    # A row for each range: as many as the session has shuffle partitions.
    sizes = ranged.groupBy(own.alias("__range")).agg(F.count(F.lit(1)).alias("__n")).collect()
    before, starts = 0, []
    for r in sorted(sizes, key=lambda r: r["__range"]):
        starts.append((r["__range"], before))
        before += r["__n"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "__range long, __before long"))
    placed = ranged.withColumn("__range", own).join(offsets, "__range")
    return placed.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*rows.columns, name)


def ranked(rows: DataFrame, order: str = "best", date: str = "date_sec") -> DataFrame:
    """rank 1..n: by score and name, or by date with undated rows last, then name. Names are unique."""
    by = {"best": F.col("score").desc(), "newest": F.col(date).desc_nulls_last() if order == "newest" else None, "oldest": F.col(date).asc_nulls_last() if order == "oldest" else None}[order]
    return numbered(rows, [by, F.col("file_name").asc()], "rank").withColumn("rank", F.col("rank").cast("int"))


def best_per_file(scored: DataFrame, min_score: float = 0.0) -> DataFrame:
    """The best frame of each file at or above the threshold."""
    best = F.max_by(F.struct("is_video", "timestamp_sec", "score"), F.struct(F.col("score"), -F.col("timestamp_sec"))).alias("b")
    return scored.filter(F.col("score") >= min_score).groupBy("file_name").agg(best).select("file_name", "b.is_video", "b.timestamp_sec", "b.score")


def scoped(frames: DataFrame, video_only: bool = False, folder: str = "", source: str | None = None) -> DataFrame:
    """Frames of videos only, or within a folder."""
    if video_only:
        frames = frames.filter("is_video")
    return frames.filter(in_folder(F.col("file_name"), F.col(source) if source else F.lit(None).cast("string"), folder)) if folder.strip() else frames


def _checked(frames: DataFrame, dim: int, column: str) -> DataFrame:
    return frames.filter(F.size(column) == dim)


def search(frames: DataFrame, query: list[float], min_score: float = 0.0, video_only: bool = False, folder: str = "", metric: str = "dot", digits: int = 5, source: str | None = None) -> DataFrame:
    """Files whose best frame's vector scores at least min_score against the query. metric: dot (stored vectors are taken as they are) or cosine.
    Frames of other dimensions are left out; scores are rounded to `digits` so that ties are ties on any machine."""
    stored = {"dot": "plain", "cosine": "cosine"}[metric]
    rows = _checked(scoped(frames, video_only, folder, source), len(query), "vector")
    scored = rows.withColumn("score", F.round(vectors.best_score(F.col("vector"), [query], stored), digits))
    return ranked(best_per_file(scored, min_score))


def search_any(frames: DataFrame, queries: list[list[float]], min_score: float = 0.3, metric: str = "dot", digits: int = 5) -> DataFrame:
    """Search by several vectors of one thing: a frame's score is its best over all of them. Without queries nothing is found."""
    if not queries:
        return ranked(frames.select("file_name", "is_video", "timestamp_sec", F.lit(0.0).alias("score")).limit(0))
    stored = {"dot": "unit", "cosine": "cosine"}[metric]
    rows = _checked(frames, len(queries[0]), "vector")
    scored = rows.withColumn("score", F.round(vectors.best_score(F.col("vector"), queries, stored), digits))
    return ranked(best_per_file(scored, min_score))


def guarded(frames: DataFrame, query: list[float], min_score: float = 0.0, **how) -> DataFrame:
    """search, for a query that must have the dimensions that the frames have, or most of them: another one is an error (ValueError) and not an empty result. Frames without
    vectors take any query."""
    dim = tables.usual_dim(frames)
    if dim and len(query) != dim:
        raise ValueError(f"the query has {len(query)} dimensions, the frames have {dim}")
    return search(frames, query, min_score, **how)


def vector_at(frames: DataFrame, file_name: str, seconds: float) -> list[float] | None:
    """The vector of a file's frame nearest to a time, the earlier one of two as near; None without frames."""
    near = _frame_at(frames, file_name, seconds)
    return near.vector if near else None


def _frame_at(frames: DataFrame, file_name: str, seconds: float):
    nearest = F.min_by(F.struct("timestamp_sec", "vector"), F.struct(F.abs(F.col("timestamp_sec") - seconds), "timestamp_sec"))
    return frames.filter(F.col("file_name") == file_name).agg(nearest.alias("f")).first().f


def more_like(frames: DataFrame, file_name: str, seconds: float, min_score: float = 0.0) -> DataFrame:
    """Search by a file's own frame; the file itself comes first with that frame and score 1 and is no other result."""
    frame = _frame_at(frames, file_name, seconds)
    if frame is None:
        return search(frames.limit(0), [0.0], min_score)
    others = search(frames, list(frame.vector), min_score).filter(F.col("file_name") != file_name).drop("rank")
    seed = frames.filter(F.col("file_name") == file_name).select("file_name", "is_video", F.lit(float(frame.timestamp_sec)).alias("timestamp_sec"), F.lit(1.0).alias("score")).limit(1)
    first = seed.withColumn("rank", F.lit(1))
    return first.unionByName(ranked(others).withColumn("rank", F.col("rank") + 1))


def terms_of(query: str) -> tuple[list[str], str, bool]:
    """Lower-case terms, the whole query and whether it was quoted."""
    text = query.strip()
    quoted = len(text) >= 2 and text[0] == text[-1] == '"'
    text = (text[1:-1].strip() if quoted else text).lower()
    return text.split(), text, quoted


def search_text(frames: DataFrame, query: str, min_score: float = 0.0, video_only: bool = False, folder: str = "") -> DataFrame:
    """Recognised text (text_lower) that holds the query's terms, or in quotes the phrase. The score is the share of terms found; a file's best
    frame has most terms, then all of them, then the phrase. Adds term_hits, query_terms and is_phrase."""
    terms, phrase, quoted = terms_of(query)
    rows = scoped(frames, video_only, folder)
    if not terms:
        rows, terms = rows.limit(0), [""]
    hits = sum((F.contains("text_lower", F.lit(t)).cast("int") for t in terms), F.lit(0))
    rows = rows.withColumn("term_hits", hits).withColumn("phrase_hit", F.contains("text_lower", F.lit(phrase)))
    share = F.lit(1.0) if quoted else F.col("term_hits") / F.lit(float(len(terms)))
    inner = F.col("term_hits") * 1000 + F.when(F.col("term_hits") == len(terms), 100).otherwise(0) + F.col("phrase_hit").cast("int") * 10
    found = rows.filter(F.col("phrase_hit") if quoted else F.col("term_hits") > 0).withColumn("score", F.round(share, 5)).filter(F.col("score") >= min_score).withColumn("inner", inner)
    fields = F.struct("is_video", "timestamp_sec", "score", "term_hits")
    best = found.groupBy("file_name").agg(F.max_by(fields, F.struct(F.col("inner"), -F.col("timestamp_sec"))).alias("b"))
    out = best.select("file_name", "b.is_video", "b.timestamp_sec", "b.score", "b.term_hits", F.lit(len(terms)).alias("query_terms"), F.lit(quoted).alias("is_phrase"))
    return ranked(out)


def collapsed(results: DataFrame, roots: DataFrame) -> DataFrame:
    """The best result of each group of images (roots: file_name, root); videos stand for themselves. Ranks are given anew."""
    tied = results.drop("rank").join(roots.select("file_name", "root"), "file_name", "left")
    key = F.when(F.col("is_video"), F.col("file_name")).otherwise(F.coalesce("root", "file_name"))
    rows = tied.withColumn("key", key)
    names = [c for c in results.columns if c != "rank"]
    top = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), "file_name"))).filter("n = 1")
    return ranked(top.select(*names))


def first_of(results: DataFrame, key: str, order: str = "rank") -> DataFrame:
    """The first row of each key in an order; rows without a key go."""
    return results.filter(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")


#: Rows of candidates and of queries that meet in one task of a shortlist, and products that it holds at once.
SHORTLIST_ROWS, SHORTLIST_PRODUCTS = 8192, 1 << 19


def nearest_in_block(table: pa.Table, k: int, digits: int, products: int = SHORTLIST_PRODUCTS) -> pa.Table:
    """The k best of the candidates (kind 1) for each of the queries (kind 0) of a block: file_name, candidate, score. table: kind, file_name and v, a unit vector. What is found is kept
    as numbers of rows, so a task holds the block, some strips of `products` scores and k numbers for each query."""
    kind, names = table["kind"].to_numpy(), table["file_name"].combine_chunks()
    lists = table["v"].combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    values = lists.flatten().to_numpy()
    place = np.argsort(np.array(names.to_pylist(), dtype=object), kind="stable")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for size in np.unique(sizes):  # vectors of different sizes aren't compared
        # By name, so that of equal scores the first are the smallest names.
        at = [place[(kind[place] == side) & (sizes[place] == size)] for side in (0, 1)]
        if not all(map(len, at)):
            continue
        one, two = at
        asked, offered = (values[(ends[i] - size)[:, None] + np.arange(size)] for i in at)
        # The same number for the same name on both sides.
        code = np.unique(np.array(names.take(pa.array(np.concatenate((one, two)))).to_pylist(), dtype=object), return_inverse=True)[1]
        mine, theirs = code[: len(one)], code[len(one) :]
        step = max(1, products // len(two))
        for lo in range(0, len(one), step):
            scores = asked[lo : lo + step] @ offered.T
            scores = np.floor(np.abs(scores) * 10**digits + 0.5) * np.sign(scores) / 10**digits
            scores[mine[lo : lo + step][:, None] == theirs[None, :]] = -np.inf
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(scores, top, axis=1)
            row, n = np.nonzero(best > -np.inf)
            found.append((one[lo + row].astype(np.int32), two[top[row, n]].astype(np.int32), best[row, n]))
    left, right, score = (np.concatenate([f[i] for f in found]) if found else np.array([], dtype=t) for i, t in enumerate((np.int32, np.int32, np.float64)))
    return pa.table({"file_name": names.take(pa.array(left)), "candidate": names.take(pa.array(right)), "score": pa.array(score)})


def shortlist(frames: DataFrame, k: int = 64, digits: int = 5, eligible: DataFrame | None = None, rows: int = SHORTLIST_ROWS) -> DataFrame:
    """The k candidates of each image by cosine, exactly: file_name, candidate, score and n. One vector per file (frames: file_name, vector).
    Only files of `eligible` (file_name), if given, are candidates; they are chosen before the k best are.

    Every image is held against every candidate, block by block: a task gets two blocks of `rows` vectors and works through their products as matrices, a strip at a time. It hands on
    the k best of each of its images, so what is shuffled are the vectors once for each block of the other side, and k rows for each image and block.
    """
    unit = kept(frames.filter(F.col("vector").isNotNull()).select("file_name", vectors.unit(F.col("vector")).alias("v")), "units")
    other = unit if eligible is None else kept(unit.join(eligible.select("file_name").distinct(), "file_name", "left_semi"), "eligible")
    a, b = (max(1, -(-x.count() // rows)) for x in (unit, other))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("file_name"), F.lit(n)).cast("int")
    left = unit.select(F.lit(0).alias("kind"), "file_name", "v", block(a).alias("i"), spread(b).alias("j"))
    right = other.select(F.lit(1).alias("kind"), "file_name", "v", spread(a).alias("i"), block(b).alias("j"))
    tasks = left.unionByName(right).repartition(min(a * b, 20_000), "i", "j")

    def best(table: pa.Table) -> pa.Table:
        return nearest_in_block(table, k, digits)

    scored = tasks.groupBy("i", "j").applyInArrow(best, "file_name string, candidate string, score double")
    order = Window.partitionBy("file_name").orderBy(F.col("score").desc(), "candidate")
    return scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)


def best_pair(left: DataFrame, right: DataFrame, digits: int = 5) -> DataFrame:
    """The most alike pair of a file's few vectors (left) and any number of others: id, vector; left_id, right_id, score. The left ones are literals of the plan, at most 4,096 of
    them, and the others are scanned once: each partition hands on its best pair."""
    asked = left.select("id", "vector").limit(4097).collect()
    if len(asked) > 4096:
        raise ValueError("the left side is one file's vectors, not a table of them")
    if not asked:
        return right.select(F.col("id").alias("left_id"), F.col("id").alias("right_id"), F.lit(0.0).alias("score")).limit(0)
    kind = left.schema["id"].dataType
    scores = F.array(*[F.struct(F.round(vectors.dot(F.col("vector"), literal(r.vector)), digits).alias("score"), F.lit(r.id).cast(kind).alias("left_id")) for r in asked])
    pairs = right.select(F.col("id").alias("right_id"), F.explode(scores).alias("s")).select("s.left_id", "right_id", "s.score").filter("score IS NOT NULL")
    return pairs.orderBy(F.col("score").desc(), "left_id", "right_id").limit(1)


def nearest_frame(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each distinct (file_name, seconds) the image of the file's frame nearest in time, the earlier of two as near, the smallest of several at one time. Frames and wanted times
    without a file or time take no part; files without frames have no row.

    Both sides are sorted together by file and time, once up and once down; each wanted time takes the last frame that went by. So a file's rows pass through a task as a stream, and
    no wanted time meets every frame.
    """
    known = frames.filter("file_name IS NOT NULL AND timestamp_sec IS NOT NULL").groupBy("file_name", F.col("timestamp_sec").cast("double").alias("at")).agg(F.min("image_file").alias("image_file"))
    asked = wanted.filter("file_name IS NOT NULL AND seconds IS NOT NULL").select("file_name", F.col("seconds").cast("double").alias("at")).distinct()
    shot = F.struct("at", "image_file")
    both = known.select("file_name", "at", F.lit(0).alias("side"), shot.alias("shot")).unionByName(asked.select("file_name", "at", F.lit(1).alias("side")), allowMissingColumns=True)
    went_by = lambda *order: F.last("shot", ignorenulls=True).over(Window.partitionBy("file_name").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = both.withColumn("down", went_by(F.col("at").desc(), "side")).withColumn("up", went_by("at", "side")).filter("side = 1")
    earlier = F.col("down").isNull() | (F.col("at") - F.col("up")["at"] <= F.col("down")["at"] - F.col("at"))
    chosen = F.when(F.col("up").isNotNull() & earlier, F.col("up")).otherwise(F.col("down"))
    return near.withColumn("shot", chosen).filter("shot IS NOT NULL").select("file_name", F.col("at").alias("seconds"), F.col("shot.image_file").alias("image_file"))


def seed_frames(frames: DataFrame, seed: str, groups: DataFrame, similar: DataFrame) -> DataFrame:
    """Frames of images of one person: those of the seed, of the files grouped with it (groups: node, root), and of the images similar to any of
    them (similar: master, file_name, is_video)."""
    one = frames.sparkSession.createDataFrame([(seed,)], "file_name string")
    root = groups.filter(F.col("node") == seed).select("root").distinct()
    members = one.unionByName(groups.join(F.broadcast(root), "root", "left_semi").select(F.col("node").alias("file_name"))).distinct()
    like = similar.filter(~F.coalesce("is_video", F.lit(False))).join(members.withColumnRenamed("file_name", "master"), "master", "left_semi").select("file_name")
    return frames.join(members.unionByName(like).distinct(), "file_name", "left_semi").filter("NOT is_video")


def pair_metrics(pairs: DataFrame, least: int = 10, least_ratio: float = 0.75) -> DataFrame:
    """pairs (keypoints_a, keypoints_b, good, inliers) with ratio (inliers of good matches), score (inliers of the fewer keypoints) and ok."""
    fewer = F.least("keypoints_a", "keypoints_b")
    ratio = F.when(F.col("good") > 0, F.col("inliers") / F.col("good")).otherwise(0.0)
    score = F.when(fewer > 0, F.col("inliers") / fewer).otherwise(0.0)
    return pairs.withColumns({"ratio": ratio, "score": score}).withColumn("ok", (F.col("inliers") >= least) & (F.col("ratio") >= least_ratio))
