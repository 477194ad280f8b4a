"""Reports on how far the stages have come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonlake.functions.labels import embed_failure

MISSING, TOTAL = "<missing>", "__TOTAL__"


def stage_columns() -> dict[str, Column]:
    """Condition of each figure of the report, over the columns of the media index."""
    stage = F.coalesce("processing_error_stage", F.lit(""))
    video = F.coalesce("is_video", F.lit(False))
    similar = F.coalesce(F.trim("dedupe_match_file") != "", F.lit(False))
    master = ~similar
    hashed = F.coalesce(F.col("phash_hex") != "", F.lit(False))
    faces, clip = F.col("faces"), F.coalesce(F.size("clip_groups") > 0, F.lit(False)) & F.coalesce(F.forall("clip_groups", lambda g: g["clip_embedding"].isNotNull()), F.lit(False))
    ocr = F.col("ocr_groups")
    found = F.coalesce(F.size(ocr) > 0, F.lit(False)) & F.coalesce(F.forall(ocr, lambda g: g["text_detected"].isNotNull()), F.lit(False))
    with_text = F.coalesce(F.exists(ocr, lambda g: g["text_detected"]), F.lit(False))
    pending = F.coalesce(F.exists(ocr, lambda g: g["text_detected"] & g["text"].isNull()), F.lit(False))
    out = {"total_rows": F.lit(True), "image_rows": ~video, "video_rows": video, "masters_total": master}
    for name, kind, failed in (("vhash", video, "video_hash"), ("phash", ~video, "image_phash")):
        out |= {f"{name}_failures": kind & (stage == failed), f"{name}_successes": kind & (stage != failed) & hashed, f"{name}_not_run": kind & (stage != failed) & ~hashed, f"{name}_similars": kind & similar, f"{name}_masters": kind & master}
    face_failed, embed = stage == "faces", embed_failure(F.col("processing_error"))
    out |= {
        "face_detect_failures": master & face_failed & ~embed, "face_embed_failures": master & face_failed & embed, "face_not_run": master & ~face_failed & faces.isNull(),
        "face_successes": master & ~face_failed & faces.isNotNull(), "face_success_with_faces": master & ~face_failed & F.coalesce(faces, F.lit(False)), "face_success_without_faces": master & ~face_failed & ~F.coalesce(faces, F.lit(True)),
        "clip_failures": master & (stage == "clip"), "clip_successes": master & (stage != "clip") & clip, "clip_not_run": master & (stage != "clip") & ~clip,
    }
    image, checked = master & ~video, F.coalesce("sift_match_checked", F.lit(False))
    linked = F.coalesce(F.trim("sift_match_file") != "", F.lit(False))
    out |= {"sift_failures": image & stage.startswith("sift"), "sift_successes": image & checked, "sift_success_with_similar": image & checked & linked, "sift_success_without_similar": image & checked & ~linked, "sift_not_run": image & ~checked}
    paddle, easy = stage == "paddle_ocr", (stage == "easyocr") | pending
    out |= {
        "paddle_failures": master & paddle, "paddle_successes": master & ~paddle & found, "paddle_success_with_text": master & ~paddle & found & with_text, "paddle_success_without_text": master & ~paddle & found & ~with_text,
        "paddle_not_run": master & ~paddle & ~found, "easyocr_failures": master & easy, "easyocr_successes": master & ~easy & ocr.isNotNull(), "easyocr_not_run": master & ~easy & ocr.isNull(),
    }
    return out


def by_collection(rows: DataFrame, conditions: dict[str, Column], collections: list[str] | None = None) -> DataFrame:
    """How many rows of each collection, and of all together, meet each condition. An absent collection counts as <missing>."""
    named = rows.withColumn("collection_id", F.when(F.coalesce("collection_id", F.lit("")) == "", F.lit(MISSING)).otherwise(F.col("collection_id")))
    if collections:
        named = named.filter(F.col("collection_id").isin(collections))
    counted = named.select("collection_id", *[c.cast("int").alias(n) for n, c in conditions.items()])
    return counted.rollup("collection_id").agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in conditions]).withColumn("collection_id", F.coalesce("collection_id", F.lit(TOTAL)))


def summary(rows: DataFrame, done: dict[str, Column]) -> DataFrame:
    """Rows (stage, done, total)."""
    counts = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in done.items()])
    return counts.select("total", F.explode(F.create_map(*[x for n in done for x in (F.lit(n), F.col(n))])).alias("stage", "done")).select("stage", "done", "total")


def fingerprint(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """A SHA-256 of each row's values (with their lengths, so that no two rows are written alike), and from those one of the table: the sum over
    all rows, which doesn't depend on their order. One row (rows, digest)."""
    text = F.concat_ws("", *[F.when(F.col(c).isNull(), F.lit("-:")).otherwise(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in [order, *columns]])
    digest = F.sha2(text.cast("binary"), 256)
    part = [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)]
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), *part)
    return sums.select("rows", F.sha2(F.concat_ws(",", "rows", *[F.col(f"s{i}").cast("string") for i in range(8)]).cast("binary"), 256).alias("digest"))
