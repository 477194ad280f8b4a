"""Joins and clusters of hashes by Hamming distance.

Hashes within a small distance agree on some combination of bit blocks, so these are equi-join keys; equal hashes are grouped
first, so that copies meet once. The combinations grow with the number of hashes. At large distances they select nothing; there hashes meet in cells (hamming_cells).

A hash has a row for each combination. Spark sizes that side by the hashes' file, so it would send all of it to every executor; the join is asked to merge.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonlake.functions import hashes
from photonlake.operators import hamming_cells
from photonlake.operators.search import numbered
from photonlake.plans.storage import kept


def block_masks(n: int, most: int) -> list[int]:
    """Masks of bits such that two hashes within the distance are equal on all bits of at least one: with most + k blocks of bits, k of them must be untouched.
    k is such that n hashes cost least: a row for each mask, and what chance brings together."""
    best: tuple[float, list[int]] | None = None
    for k in range(1, 5):
        m = most + k
        tables = math.comb(m, k)
        cost = tables * (4.0 * n + n * n / 2.0 ** (hashes.BITS * k / m))
        if best and cost >= best[0]:
            continue
        edges = [round(i * hashes.BITS / m) for i in range(m + 1)]
        blocks = [((1 << edges[i + 1] - edges[i]) - 1) << edges[i] for i in range(m)]
        best = cost, [sum(c) for c in itertools.combinations(blocks, k)]
    return best[1]


#: Distances from here on are looked for in cells.
WIDE = 7


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


def hash_pairs(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Distinct pairs (a, b, d) of a hash of left and one of right within the distance. Both have a column h. A pair that agrees under several masks is
    made under the first of them only, so no step removes repeats."""
    one = kept(left.filter("h IS NOT NULL").select(F.col("h").alias("a")).distinct(), "hashes")
    two = kept(right.filter("h IS NOT NULL").select(F.col("h").alias("b")).distinct(), "hashes")
    n = max(one.count(), two.count())
    if most >= WIDE:
        return hamming_cells.near_pairs(one, two, most, left is right, n)
    masks = F.array(*[F.lit(signed(m)) for m in block_masks(n, most)])
    keyed = lambda rows, h: rows.select(h, F.posexplode(F.transform(masks, lambda m: F.col(h).bitwiseAND(m))).alias("mask", "value"))
    met = keyed(one, "a").join(keyed(two, "b").hint("merge"), ["mask", "value"])
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.array_position(F.transform(masks, lambda m: apart.bitwiseAND(m) == 0), True) - 1
    return met.withColumn("d", hashes.distance(F.col("a"), F.col("b"))).filter(F.col("d") <= most).filter(first == F.col("mask")).select("a", "b", "d")


def all_matches(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Rows (file_name, match, d): every file of right whose hash is within the distance of a file of left's. A file is no match of itself."""
    pairs = kept(hash_pairs(left, right, most), "pairs")
    mine, other = left.select("file_name", F.col("h").alias("a")), right.select(F.col("file_name").alias("match"), F.col("h").alias("b"))
    return mine.join(pairs, "a").join(other, "b").filter("file_name <> match").select("file_name", "match", "d")


def best_match(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """The nearest match of each file of left, the smallest name of several as near. Each hash of right stands for its two smallest names, which
    is enough to leave out the file itself."""
    names = right.filter("h IS NOT NULL").groupBy(F.col("h").alias("b")).agg(F.min("file_name").alias("n1"), F.max("file_name").alias("last"))
    second = right.select(F.col("h").alias("b"), "file_name").join(names, "b").filter("file_name > n1").groupBy("b").agg(F.min("file_name").alias("n2"))
    names = names.drop("last").join(second, "b", "left")
    pairs = kept(hash_pairs(left, right, most), "pairs").join(names, "b")
    mine = left.select("file_name", F.col("h").alias("a"))
    met = mine.join(pairs, "a").withColumn("match", F.when(F.col("n1") != F.col("file_name"), F.col("n1")).otherwise(F.col("n2"))).filter("match IS NOT NULL")
    return met.groupBy("file_name").agg(F.min(F.struct("d", "match")).alias("m")).select("file_name", "m.match", "m.d")


def cross_media(images: DataFrame, frames: DataFrame, percent: float = 95.0) -> DataFrame:
    """Links (file_name, other, is_video, similarity_pct) between images and videos, in both directions: a pair's similarity is the best over
    the video's frames, to three decimals. images: file_name, h; frames: file_name (of the video), h."""
    pairs = kept(hash_pairs(images, frames, hashes.most_apart(percent)), "pairs")
    shots = frames.filter("h IS NOT NULL").select(F.col("file_name").alias("video"), F.col("h").alias("b")).distinct()
    near = images.select("file_name", F.col("h").alias("a")).join(pairs, "a").join(shots, "b").groupBy("file_name", "video").agg(F.min("d").alias("d"))
    percent_ = hashes.rounded(hashes.similarity(F.col("d"))).alias("similarity_pct")
    one = near.select("file_name", F.col("video").alias("other"), F.lit(True).alias("is_video"), percent_)
    two = near.select(F.col("video").alias("file_name"), F.col("file_name").alias("other"), F.lit(False).alias("is_video"), percent_)
    return one.unionByName(two)


def merged_links(existing: DataFrame, found: DataFrame, current: DataFrame) -> DataFrame:
    """Links after a run over some files (current: file_name): links between two files outside the run stay, those of a file in the run are the found
    ones; the most similar of each pair counts."""
    run = current.select("file_name").distinct()
    outside = existing.join(run, "file_name", "left_anti").join(run.withColumnRenamed("file_name", "other"), "other", "left_anti")
    rows = outside.select("file_name", "other", "is_video", "similarity_pct").unionByName(found)
    return rows.groupBy("file_name", "other").agg(F.max("is_video").alias("is_video"), F.max("similarity_pct").alias("similarity_pct"))


def link_lists(links: DataFrame) -> DataFrame:
    """One row per file with its links as an array by similarity and name."""
    item = F.struct((-F.coalesce("similarity_pct", F.lit(-1.0))).alias("k"), F.col("other").alias("file_name"), "is_video", "similarity_pct")
    return links.groupBy("file_name").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["file_name"].alias("file_name"), x["is_video"].alias("is_video"), x["similarity_pct"].alias("similarity_pct"))).alias("cross_media_matches"))


def leaders(items: DataFrame, percent: float, exempt: str | None = None) -> DataFrame:
    """Greedy grouping: in the order of `place`, a file joins the nearest earlier master within reach and else becomes one.

    items: file_name, h, place (a total order); exempt names a boolean column of files that never join but are masters. Returns file_name,
    is_master, match and similarity_pct. In rounds: files without an open or master neighbour before them become masters; files with a master before them
    join. Files without a hash are left out. Equal hashes form one class: only its first file and its exempt files can be masters.
    """
    most = hashes.most_apart(percent)
    rows = items.filter("h IS NOT NULL").select("file_name", "h", "place", (F.coalesce(F.col(exempt), F.lit(False)) if exempt else F.lit(False)).alias("free"))
    rows = kept(rows, "items")
    # By class of equal hashes: once any member is a master, later members that aren't exempt join it or one still nearer by name. So classes decide by
    # their first place; exempt members are masters whatever happens, from their own place on.
    classes = rows.groupBy("h").agg(F.min("place").alias("first"), F.min(F.when(F.col("free"), F.col("place"))).alias("free_at"))
    pairs = hash_pairs(classes, classes, most).filter("a <> b")
    info = classes.select(F.col("h").alias("b"), F.col("first").alias("b_first"), F.col("free_at").alias("b_free"))
    before = pairs.join(info, "b").join(classes.select(F.col("h").alias("a"), "first"), "a")
    # A class is hindered for good by an exempt file before its first; else by neighbours that come first and may yet be masters.
    edges = kept(before.filter((F.col("b_first") < F.col("first"))).select("a", "b", (F.coalesce(F.col("b_free"), F.lit(1 << 62)) < F.col("first")).alias("sure")), "edges")
    open_ = classes.select("h", F.col("free_at").eqNullSafe(F.col("first")).alias("start"))
    state = kept(open_.select("h", F.when(F.col("start"), "master").otherwise("open").alias("s")), "state")
    while True:  # each round decides the first open class at least
        around = edges.join(state.select(F.col("h").alias("b"), F.col("s").alias("bs")), "b").groupBy("a").agg(F.max((F.col("bs") == "master") | F.col("sure")).alias("near_master"), F.max(F.col("bs") == "open").alias("near_open"))
        step = state.join(around.withColumnRenamed("a", "h"), "h", "left")
        new = F.when(F.col("s") != "open", F.col("s")).when(F.coalesce("near_master", F.lit(False)), "member").when(F.coalesce("near_open", F.lit(False)), "open").otherwise("master")
        state = kept(step.select("h", new.alias("s")), "state")
        if not state.filter("s = 'open'").limit(1).count():
            break
    # Masters: the first file of a master class, and every exempt file.
    decided = rows.join(state, "h").join(classes.select("h", "first"), "h")
    masters = kept(decided.withColumn("is_master", F.col("free") | ((F.col("s") == "master") & (F.col("place") == F.col("first")))).select("file_name", "h", "place", "is_master"), "masters")
    heads = masters.filter("is_master").select(F.col("file_name").alias("match"), F.col("h").alias("b"), F.col("place").alias("at"))
    joins = hash_pairs(masters.filter("NOT is_master"), heads.withColumnRenamed("b", "h"), most)
    met = masters.filter("NOT is_master").join(joins, F.col("h") == F.col("a")).join(heads, "b").filter("at < place")
    best = met.groupBy("file_name").agg(F.min(F.struct("d", "match")).alias("m"))
    out = masters.select("file_name", "is_master").join(best, "file_name", "left")
    return out.select("file_name", "is_master", F.col("m.match").alias("match"), hashes.rounded(hashes.similarity(F.col("m.d"))).alias("similarity_pct"))


def repaired(items: DataFrame, links: DataFrame, percent: float) -> DataFrame:
    """One row of counts for a rebuild of greedy groups from scratch: masters, demoted (files without a link before that now have a master) and retargeted (files whose master is another
    one now). items: see leaders; links: file_name, old (the link before, or null)."""
    both = leaders(items, percent).join(links, "file_name")
    gone, moved = ~F.col("is_master") & F.col("old").isNull(), F.col("match").isNotNull() & F.col("old").isNotNull() & (F.col("match") != F.col("old"))
    return both.agg(F.count_if("is_master").alias("masters"), F.count_if(gone).alias("demoted"), F.count_if(moved).alias("retargeted"))


def image_order(images: DataFrame) -> DataFrame:
    """place of each image: larger longest side, larger area, larger file, no thumbnail, name. Missing numbers count as 0."""
    side = F.greatest(F.coalesce("image_width", F.lit(0)), F.coalesce("image_height", F.lit(0)))
    area = F.coalesce("image_width", F.lit(0)).cast("long") * F.coalesce("image_height", F.lit(0))
    return numbered(images, [side.desc(), area.desc(), F.coalesce("source_size", F.lit(0)).desc(), F.col("is_thumb"), F.col("file_name")], "place")


def file_similarity(active: Column, other: Column, active_frames: Column, other_frames: Column, active_video: Column, other_video: Column) -> Column:
    """Similarity of two files: hash against hash for two images or two videos, else the image's hash against the best of the video's frames; null if one is missing."""
    pct = lambda a, b: hashes.similarity(hashes.distance(a, b))
    best = lambda frames, h: F.array_max(F.transform(frames, lambda f: pct(f, h)))
    return F.when(active_video == other_video, pct(active, other)).when(active_video, best(active_frames, other)).otherwise(best(other_frames, active))
