"""Where collections are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonlake.functions import paths


def loaded(roots: DataFrame) -> DataFrame:
    """Roots without blank ids or paths, trimmed, without a slash at the end; of several the first path."""
    rows = roots.select(F.trim("collection_id").alias("collection_id"), F.regexp_replace(F.trim("root_path"), "(?<=.)/+$", "").alias("root_path"))
    return rows.filter("collection_id <> '' AND root_path <> ''").groupBy("collection_id").agg(F.min("root_path").alias("root_path"))


def resolved(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files with source_path: the root of the collection and the rest of the name; null without a root."""
    own = files.withColumn("__c", paths.collection_of(F.col("file_name")))
    there = own.join(roots.select(F.col("collection_id").alias("__c"), "root_path"), "__c", "left")
    return there.withColumn("source_path", F.concat_ws("/", "root_path", paths.relative_of(F.col("file_name")))).withColumn("source_path", F.when(F.col("root_path").isNotNull(), F.col("source_path"))).drop("__c", "root_path")


def samples(index: DataFrame, most: int = 16) -> DataFrame:
    """Up to 16 relative paths of each collection, the first by name: collection_id, rel."""
    rows = index.select(paths.collection_of(F.col("file_name")).alias("collection_id"), paths.relative_of(F.col("file_name")).alias("rel")).filter("collection_id IS NOT NULL AND rel <> ''").distinct()
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("collection_id").orderBy("rel"))).filter(F.col("n") <= most).drop("n")


def discovered(samples_: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """The candidate folder (place, root_path) that holds most of a collection's samples, the first of several; none without any. files: path."""
    # Each path meets the samples by its own ends and the candidates by what stands before: two equi-joins, however many candidates there are.
    parts = F.split("path", "/")
    cut = F.struct(F.array_join(F.slice(parts, F.lit(1), F.col("i")), "/").alias("root_path"), F.array_join(F.slice(parts, F.col("i") + 1, F.size(parts)), "/").alias("rel"))
    places = files.select("path").distinct().filter(F.size(parts) > 1).select("path", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("i")).select(cut.alias("c")).select("c.*")
    hits = places.join(samples_, "rel").join(candidates, "root_path").groupBy("collection_id", "place", "root_path").agg(F.count(F.lit(1)).alias("hits"))
    return hits.groupBy("collection_id").agg(F.max_by("root_path", F.struct("hits", -F.col("place"))).alias("root_path"), F.max("hits").alias("hits"))


def db_names(paths_: DataFrame, roots: DataFrame, index: DataFrame) -> DataFrame:
    """path with file_name: the path itself if the index has it, else the collection of the longest root above it, else the index's only file of that name if the path doesn't exist
    (path_exists false); null otherwise."""
    names = index.select("file_name").distinct()
    direct = paths_.select("path").distinct().join(names, F.col("path") == F.col("file_name"), "left_semi").select("path", F.col("path").alias("direct"))
    # Each path meets the roots by its own leading folders: an equi-join.
    parts = F.split("path", "/")
    above = paths_.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("root_path")).distinct()
    rooted = above.join(roots, "root_path").groupBy("path").agg(F.max_by(F.struct("collection_id", "root_path"), F.struct(F.length("root_path"), "collection_id")).alias("r"))
    rooted = rooted.select("path", F.concat("r.collection_id", F.substr(F.col("path"), F.length("r.root_path") + 1)).alias("rooted"))
    only = names.groupBy(F.lower(paths.basename(F.col("file_name"))).alias("__b")).agg(F.count(F.lit(1)).alias("n"), F.min("file_name").alias("only")).filter("n = 1")
    out = paths_.join(direct, "path", "left").join(rooted, "path", "left").withColumn("__b", F.lower(paths.basename(F.col("path")))).join(only, "__b", "left")
    return out.select(*paths_.columns, F.coalesce("direct", "rooted", F.when(~F.col("path_exists"), F.col("only"))).alias("file_name"))


def still_owner(path, extensions: tuple[str, ...] = tuple(paths.INDEXED_VIDEOS)):
    """The video's file name behind a still's path collection/folder/name_ext/still: name.ext."""
    folder = paths.parent(path)
    return F.when(folder.rlike(f"_({'|'.join(extensions)})$"), F.regexp_replace(folder, f"_({'|'.join(extensions)})$", ".$1"))


def _leading(path):
    """A path with each of the folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def with_mapping(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """folders (folder) with mapped: whether one is a root (root_path), lies below one, or has one below it. Paths are held against each other folder by folder, in equi-joins."""
    below = folders.select("folder", F.explode(_leading(F.col("folder"))).alias("root_path")).join(roots.select("root_path").distinct(), "root_path", "left_semi").select("folder")
    above = roots.select(F.explode(_leading(F.col("root_path"))).alias("folder")).distinct().join(folders, "folder", "left_semi")
    met = below.unionByName(above).distinct().withColumn("m", F.lit(True))
    return folders.join(met, "folder", "left").select(*folders.columns, F.coalesce("m", F.lit(False)).alias("mapped"))
