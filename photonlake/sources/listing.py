"""Files of a tree as a table: only paths, sizes and times are read, never contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.functions import paths

INDEXED = tuple(paths.INDEXED_IMAGES + paths.INDEXED_VIDEOS)
#: The viewer shows more kinds of image, but not tif.
VIEWED = tuple(paths.VIEWED)


def listed(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, size and mtime (microseconds) of the files below a folder, or just in it."""
    top = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root if recursive else top + "/*")
    rows = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime_us"))
    # A pattern also reaches into folders that it matches.
    return rows if recursive else rows.filter(F.regexp_replace("path", "/[^/]*$", "").endswith(top.rsplit("/", 1)[-1]))


def media(files: DataFrame, kinds: tuple[str, ...] = INDEXED) -> DataFrame:
    """Files of these extensions with is_video, by path."""
    return files.filter(paths.extension(F.col("path")).isin(*kinds)).withColumn("is_video", paths.is_video(F.col("path"))).orderBy("path")


def folders(files: DataFrame, parent: str) -> DataFrame:
    """Names of the folders right below one, without those that begin with a dot, by name in any case."""
    rest = F.substr(F.col("path"), F.lit(len(parent.rstrip("/")) + 2))
    inside = files.filter(F.col("path").startswith(parent.rstrip("/") + "/")).filter(F.instr(rest, "/") > 0)
    return inside.select(F.substring_index(rest, "/", 1).alias("name")).filter("name <> '' AND NOT startswith(name, '.')").distinct().orderBy(F.lower("name"), "name")


def verified(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """expected (path, size, sha256) with ok: the file is there, of that size and content. Files are hashed where they are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    there = found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("__size"), F.sha2("content", 256).alias("__sha"))
    return expected.join(there, "path", "left").select(*expected.columns, F.coalesce((F.col("size") == F.col("__size")) & (F.lower("sha256") == F.col("__sha")), F.lit(False)).alias("ok"))
