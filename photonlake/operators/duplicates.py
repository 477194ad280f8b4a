"""Groups of copies: similar lists, group members, oldest dates, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.functions import dates
from photonlake.operators.search import numbered


def copies(index: DataFrame) -> DataFrame:
    """Rows (master, file_name, similarity_pct): links of copies to their master, none to oneself."""
    return index.filter("dedupe_match_file IS NOT NULL AND dedupe_match_file <> file_name").select(F.col("dedupe_match_file").alias("master"), "file_name", F.col("dedupe_similarity_pct").alias("similarity_pct"))


def copy_groups(index: DataFrame) -> DataFrame:
    """Rows (master, members): each master with its copies, sorted."""
    one = copies(index).select("master", "file_name")
    both = one.unionByName(one.select("master", F.col("master").alias("file_name")))
    return both.groupBy("master").agg(F.array_sort(F.collect_set("file_name")).alias("members"))


def similar_lists(copies_: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (master, similar): copies and cross-media links of each file as structs (file_name, similarity_pct), the best of each file (null is
    least), by similarity and name."""
    rows = copies_.select("master", "file_name", "similarity_pct").unionByName(links.select(F.col("file_name").alias("master"), F.col("other").alias("file_name"), "similarity_pct"))
    best = rows.groupBy("master", "file_name").agg(F.max("similarity_pct").alias("similarity_pct"))
    item = F.struct((-F.coalesce("similarity_pct", F.lit(-1.0))).alias("k"), "file_name", "similarity_pct")
    return best.groupBy("master").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["file_name"].alias("file_name"), x["similarity_pct"].alias("similarity_pct"))).alias("similar"))


def full_groups(index: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (file_name, grp): the group of a file is its master's connected group with the copies of all its members. index: file_name,
    dedupe_match_file; roots: node, root."""
    own = index.select("file_name", F.coalesce("dedupe_match_file", "file_name").alias("master"))
    root = roots.select(F.col("node").alias("master"), "root")
    return own.join(root, "master", "left").select("file_name", F.coalesce("root", "master").alias("grp"))


def group_lists(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("grp").agg(F.array_sort(F.collect_set("file_name")).alias("members"))


def oldest_dates(grouped: DataFrame) -> DataFrame:
    """Rows (file_name, date_sec): the oldest date of each file's group. It is the least of the files' times and of the dates in their names; EXIF times count only in groups
    where no name has a date. grouped: file_name, grp, modified, exif, is_video."""
    captured = dates.capture_time(F.col("file_name"))
    exif = F.when(~F.coalesce("is_video", F.lit(False)), F.col("exif"))
    per = grouped.groupBy("grp").agg(F.min("modified").alias("m"), F.min(captured).alias("c"), F.min(exif).alias("e"))
    oldest = per.select("grp", F.least("m", F.coalesce("c", "e")).alias("date_sec"))
    return grouped.select("file_name", "grp").join(oldest, "grp").select("file_name", "date_sec")


def panel_master(index: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (file_name, master): a video's master or itself; an image's connected root, else its master's root, else its master, else itself."""
    a, b = roots.select(F.col("node").alias("file_name"), F.col("root").alias("own_root")), roots.select(F.col("node").alias("dedupe_match_file"), F.col("root").alias("master_root"))
    rows = index.select("file_name", "is_video", "dedupe_match_file").join(a, "file_name", "left").join(b, "dedupe_match_file", "left")
    image = F.coalesce("own_root", "master_root", "dedupe_match_file", "file_name")
    return rows.select("file_name", F.when(F.col("is_video"), F.coalesce("dedupe_match_file", "file_name")).otherwise(image).alias("master"))


def expanded(selected: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (file_name, place): selected files (file_name, place) with all of their connected groups, in the order in which they first come up."""
    # A group comes up first at the least place of its selected files; no selected file meets every member.
    own = selected.join(roots.select(F.col("node").alias("file_name"), "root"), "file_name").groupBy("root").agg(F.min(F.struct("place")).alias("p"))
    more = roots.select(F.col("node").alias("file_name"), "root").join(own, "root").select("file_name", "p.place", F.lit(1).alias("k"))
    rows = selected.select("file_name", "place", F.lit(0).alias("k")).unionByName(more)
    first = rows.groupBy("file_name").agg(F.min(F.struct("place", "k")).alias("at"))
    return numbered(first, [F.col("at"), F.col("file_name")], "place").select("file_name", F.col("place").cast("int").alias("place"))


def compared(paths: DataFrame, most: int = 6) -> DataFrame:
    """The first different supported paths (path, place) that exist, at most six, in order."""
    first = paths.filter("path_exists AND supported").groupBy("path").agg(F.min("place").alias("place"))
    return first.orderBy("place").limit(most)


def selection_pairs(selected: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of a selection made by hand, which is small: one row holds it all."""
    names = selected.agg(F.array_sort(F.collect_set("file_name")).alias("names"))
    return names.select(F.posexplode("names").alias("i", "a"), "names").select("a", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("b"))


def fast_pair(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """Links of accepted pairs: the lower-ranked file points to the higher. pairs: a, b, accepted; ranks: file_name, rank (higher is better)."""
    one, two = ranks.select(F.col("file_name").alias("a"), F.col("rank").alias("ra")), ranks.select(F.col("file_name").alias("b"), F.col("rank").alias("rb"))
    rows = pairs.filter("accepted").join(one, "a").join(two, "b")
    up = (F.col("ra") > F.col("rb")) | ((F.col("ra") == F.col("rb")) & (F.col("a") > F.col("b")))
    return rows.select(F.when(up, F.col("b")).otherwise(F.col("a")).alias("file_name"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("sift_match_file"))
