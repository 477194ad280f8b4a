"""JSON manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STILLS = "source_size long, source_mtime_ns long, scene_threshold double, min_scene_len int, max_stills int, frames array<struct<timestamp_sec:double,image_file:string>>"
RELOCATION = (
    "version int, db string, source_root string, destination_root string, db_committed boolean, missing array<string>, unsafe array<string>, mismatched array<string>, "
    "chats array<struct<chat_id:string,destination:string>>, excluded_sources array<struct<source:string,reason:string>>, "
    "media array<struct<chat_id:string,message_id:string,source:string,relative:string,size:long,sha256:string,media_type:string,status:string>>"
)
PROBE = "streams array<struct<codec_type:string,width:int,height:int,duration:string>>, format struct<duration:string>"


def stills(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of videos' stills, one per file; broken ones have no frames."""
    return spark.read.schema(STILLS).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(path).withColumn("manifest", F.regexp_replace(F.input_file_name(), "^file:/+", "/"))


def stills_valid(rows: DataFrame, images: DataFrame, threshold: float, min_len: int, most: int) -> DataFrame:
    """rows (video, size, mtime_ns and a manifest's columns) with valid: made from this file with these settings, and every still is there (images: image_file)."""
    same = F.col("source_size").eqNullSafe(F.col("size")) & F.col("source_mtime_ns").eqNullSafe(F.col("mtime_ns")) & F.col("scene_threshold").eqNullSafe(F.lit(threshold)) & F.col("min_scene_len").eqNullSafe(F.lit(min_len)) & F.col("max_stills").eqNullSafe(F.lit(most))
    wanted = rows.select("video", F.explode("frames.image_file").alias("image_file"))
    gone = wanted.join(images.select("image_file").distinct(), "image_file", "left_anti").select("video").distinct().withColumn("__gone", F.lit(True))
    return rows.join(gone, "video", "left").withColumn("valid", F.coalesce(same & (F.size("frames") > 0) & F.col("__gone").isNull(), F.lit(False))).drop("__gone")


def relocation(spark: SparkSession, path: str) -> DataFrame:
    """A relocation manifest as its media, one row each, with the chat's destination folder."""
    doc = spark.read.schema(RELOCATION).option("multiLine", True).json(path)
    media = doc.select("destination_root", "chats", F.explode("media").alias("m")).select("destination_root", "chats", "m.*")
    chat = F.get(F.filter("chats", lambda c: c["chat_id"] == F.col("chat_id")), F.lit(0))
    return media.withColumn("destination", chat["destination"]).drop("chats")


def mapping(media: DataFrame, collection: str) -> DataFrame:
    """old_key, new_key, chat and size of a relocation's files that are there."""
    new = F.concat_ws("/", F.lit(collection), "destination", "relative")
    return media.filter("status = 'present' OR status IS NULL").select(F.concat_ws("/", F.lit(collection), "source").alias("old_key"), new.alias("new_key"), F.col("destination").alias("chat"), "size").distinct()


def probed(json: Column) -> Column:
    """duration, width and height from a probe's JSON: the first video stream's size, and its or the container's duration if finite and above 0."""
    doc = F.from_json(json, PROBE)
    video = F.get(F.filter(doc["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    fine = lambda c: F.when(c.try_cast("double").between(1e-9, 1e15), c.try_cast("double"))
    return F.struct(F.coalesce(fine(doc["format"]["duration"]), fine(video["duration"])).alias("duration"), video["width"].alias("width"), video["height"].alias("height"))
