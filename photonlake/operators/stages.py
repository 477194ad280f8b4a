"""Conditions and updates of a media index between the stages of its making. Columns are those of schema.MEDIA_INDEX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photonlake.functions.groups import stamps
from photonlake.functions.hashes import normalized_hash
from photonlake.functions.vectors import seconds

SIFT = ("sift_match_file", "sift_match_score", "sift_match_inliers", "sift_match_good_matches", "sift_match_inlier_ratio")
PROCESSED = ("face_groups", "clip_groups", "ocr_groups", "faces")
HASH_STAGES = ("image_phash", "video_hash")


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def skip_applies() -> Column:
    """Skipped, and with a valid hash or an error to show for it."""
    return yes(F.col("skip_processing")) & (normalized_hash(F.col("phash_hex")).isNotNull() | yes(F.trim("processing_error") != ""))


def hash_complete() -> Column:
    """Nothing is left to do for the hash: a copy has its match and similarity, a master has neither."""
    match, pct = F.col("dedupe_match_file"), F.col("dedupe_similarity_pct")
    copy = yes(F.col("skip_processing")) & yes(F.trim(match) != "") & pct.isNotNull()
    master = ~F.coalesce("skip_processing", F.lit(True)) & match.isNull() & pct.isNull()
    return normalized_hash(F.col("phash_hex")).isNotNull() & (copy | master)


def in_tree() -> Column:
    """Files that later ones may match: not skipped, with a valid hash."""
    return ~yes(F.col("skip_processing")) & normalized_hash(F.col("phash_hex")).isNotNull()


def fits_item(groups: str, item: str = "item_ts") -> Column:
    """Groups stand for exactly the item's frames, in order."""
    return yes(stamps(F.col(groups)) == F.transform(item, lambda t: seconds(t)))


def complete(groups: str, field: str, item: str = "item_ts") -> Column:
    """Groups fit the item and none lacks its field."""
    return fits_item(groups, item) & yes(F.forall(groups, lambda g: g[field].isNotNull()))


def text_pending() -> Column:
    """Some frame has text that hasn't been read."""
    return yes(F.exists("ocr_groups", lambda g: yes(g["text_detected"]) & g["text"].isNull()))


def too_narrow(width: str = "image_width", height: str = "image_height", side: int = 160, strip: int = 256, aspect: float = 3.5) -> Column:
    """Images in which no face is looked for; unknown sizes are looked at."""
    small, large = F.least(width, height), F.greatest(width, height)
    return yes((small < side) | ((small < strip) & (large / small >= aspect))) & F.col(width).isNotNull() & F.col(height).isNotNull()


def sift_shown(inliers: int = 10, ratio: float = 0.4) -> Column:
    return yes(F.col("sift_match_checked")) & F.col("sift_match_file").isNotNull() & yes(F.col("sift_match_inliers") >= inliers) & yes(F.col("sift_match_inlier_ratio") >= ratio) & yes(F.col("sift_match_score") >= 0)


def sift_weak(inliers: int = 80, ratio: float = 0.9, score: float = 0.2) -> Column:
    low = lambda c, least: F.coalesce(F.col(c) < least, F.lit(True))
    return yes(F.trim("sift_match_file") != "") & (low("sift_match_inliers", inliers) | low("sift_match_inlier_ratio", ratio) | low("sift_match_score", score))


def accepted(inliers: str, ratio: str, least: int = 10, least_ratio: float = 0.75) -> Column:
    return yes((F.col(inliers) >= least) & (F.col(ratio) >= least_ratio))


def face_rerun(failed_only: bool) -> Column:
    """Rows whose faces are looked for again: failed ones or those without faces, if their groups fit."""
    bad = yes(F.col("processing_error_stage") == "faces")
    none = ~yes(F.col("faces"))
    return fits_item("face_groups") & (bad if failed_only else (bad | none))


def nullable(kind: T.DataType) -> T.DataType:
    """A type in which everything within may be null."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind.fields])
    return kind


def set_where(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """rows with new values where a condition holds (all read the old row)."""
    kinds = {f.name: nullable(f.dataType) for f in rows.schema.fields}
    new = {c: F.when(where, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items() if c in kinds}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def cleared(rows: DataFrame, where: Column, columns: tuple[str, ...]) -> DataFrame:
    """Columns emptied where a condition holds."""
    return set_where(rows, where, {c: F.lit(None) for c in columns})


def hash_failed(rows: DataFrame, where: Column, stage: Column, error: Column) -> DataFrame:
    """Files that couldn't be hashed: skipped, without links and groups, with the error."""
    gone = ("phash_hex", "dedupe_match_file", "dedupe_similarity_pct", "sift_match_checked", *SIFT, *PROCESSED)
    return set_where(rows, where, {c: F.lit(None) for c in gone} | {"skip_processing": F.lit(True), "processing_error_stage": stage, "processing_error": error})


def faces_failed(rows: DataFrame, where: Column, error: Column, item: str = "item_ts") -> DataFrame:
    """Files whose faces couldn't be looked for: an empty group for each frame, and the error."""
    empty = F.transform(item, lambda t: F.struct(seconds(t).cast("float").alias("timestamp_sec"), F.array().cast("array<array<float>>").alias("face_embeddings")))
    return set_where(rows, where, {"face_groups": empty, "faces": F.lit(False), "skip_processing": F.lit(False), "processing_error_stage": F.lit("faces"), "processing_error": error})


def text_failed(rows: DataFrame, where: Column, error: Column, item: str = "item_ts") -> DataFrame:
    """Files in which text couldn't be looked for: no text in any frame, and the error."""
    empty = F.transform(item, lambda t: F.struct(seconds(t).cast("float").alias("timestamp_sec"), F.lit(False).alias("text_detected"), F.lit("").alias("text")))
    return set_where(rows, where, {"ocr_groups": empty, "skip_processing": F.lit(False), "processing_error_stage": F.lit("paddle_ocr"), "processing_error": error})


def text_reset(rows: DataFrame) -> DataFrame:
    """Files whose text detection failed, as if it hadn't run."""
    return cleared(rows, yes(F.col("processing_error_stage") == "paddle_ocr"), ("ocr_groups", "processing_error_stage", "processing_error"))


def demoted(rows: DataFrame, where: Column) -> DataFrame:
    """Files that turned out to be copies lose what was processed; errors of hashing stay."""
    rows = cleared(rows, where & ~yes(F.col("processing_error_stage").isin(*HASH_STAGES)), ("processing_error_stage", "processing_error"))
    return cleared(rows, where, (*PROCESSED, *SIFT, "sift_match_checked"))


def detected_text(groups: str = "ocr_groups") -> Column:
    """Text of each group after detection: unread where there is some, else empty."""
    return F.transform(groups, lambda g: g.withField("text", F.when(yes(g["text_detected"]), g["text"]).otherwise(F.coalesce(g["text"], F.lit("")))))


def filled_text(read: str, groups: str = "ocr_groups") -> Column:
    """Unread texts taken from an array of texts by place; empty where that has none."""
    return F.transform(groups, lambda g, i: g.withField("text", F.coalesce(g["text"], F.when(yes(g["text_detected"]), F.get(F.col(read), i)), F.lit(""))))


def stuck(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Rows with stuck: the newest status of their collection (collection_id, updated, state, file_name) names them in an unfinished face stage."""
    last = status.groupBy("collection_id").agg(F.max_by(F.struct("state", "file_name"), F.struct("updated", "state", "file_name")).alias("s")).select("collection_id", F.col("s.state").alias("last_state"), F.col("s.file_name").alias("last_file"))
    return rows.join(last, "collection_id", "left").withColumn("stuck", yes(F.col("last_file") == F.col("file_name")) & yes(F.col("last_state").startswith("face")) & ~yes(F.col("last_state").rlike("done|complete|failed"))).drop("last_state", "last_file")


def unchanged(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed files (file_name, size, mtime_ns) with reuse: the index has their size, time and dimensions."""
    old = rows.select("file_name", "source_size", "source_mtime_ns", "image_width", "image_height")
    same = F.col("source_size").eqNullSafe(F.col("size")) & F.col("source_mtime_ns").eqNullSafe(F.col("mtime_ns")) & F.col("image_width").isNotNull() & F.col("image_height").isNotNull()
    return listing.join(old, "file_name", "left").withColumn("reuse", same).select("file_name", "size", "mtime_ns", "reuse", F.when(F.col("reuse"), F.col("image_width")).alias("image_width"), F.when(F.col("reuse"), F.col("image_height")).alias("image_height"))


def media_items(images: DataFrame, videos: DataFrame) -> DataFrame:
    """Items to process (file_name, is_video, frames): an image is one frame at 0, a video its listed frames in order; videos without frames go.
    images: file_name, path; videos: file_name, timestamp_sec, image_file."""
    frame = lambda t, p: F.struct(t.cast("double").alias("timestamp_sec"), p.alias("path"))
    one = images.select("file_name", F.lit(False).alias("is_video"), F.array(frame(F.lit(0.0), F.col("path"))).alias("frames"))
    many = videos.filter("image_file IS NOT NULL").groupBy("file_name").agg(F.array_sort(F.collect_list(frame(seconds(F.col("timestamp_sec")), F.col("image_file")))).alias("frames"))
    return one.unionByName(many.select("file_name", F.lit(True).alias("is_video"), "frames"))


def reruns(stage: Column, chosen: set[str]) -> Column:
    """Whether a choice of stages runs this one again: all, the stage itself, or the number that it begins with."""
    if "all" in chosen:
        return F.lit(True)
    names = sorted(chosen)
    return stage.isin(*names) | F.regexp_extract(stage, "^[0-9]+", 0).isin(*names)


def to_extract(videos: DataFrame, valid: DataFrame) -> DataFrame:
    """Videos whose stills have to be taken: those that aren't skipped as copies and have no valid manifest. valid: video, valid."""
    good = valid.filter("valid").select(F.col("video").alias("file_name")).distinct()
    return videos.filter(~yes(F.col("skip_processing"))).join(good, "file_name", "left_anti")
