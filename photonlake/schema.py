"""Tables of a media index."""

from __future__ import annotations

from pyspark.sql.types import _parse_datatype_string

MEDIA_INDEX_DDL = """
file_name string, collection_id string, is_video boolean, source_size long, source_mtime_ns long, image_width int, image_height int,
faces boolean, phash_hex string, video_frame_phashes array<struct<timestamp_sec:float,phash_hex:string>>, skip_processing boolean,
dedupe_match_file string, dedupe_similarity_pct float, cross_media_matches array<struct<file_name:string,is_video:boolean,similarity_pct:float>>,
sift_match_file string, sift_match_score float, sift_match_inliers int, sift_match_good_matches int, sift_match_inlier_ratio float,
sift_match_checked boolean, processing_error_stage string, processing_error string,
face_groups array<struct<timestamp_sec:float,face_embeddings:array<array<float>>>>,
clip_groups array<struct<timestamp_sec:float,clip_embedding:array<float>>>,
ocr_groups array<struct<timestamp_sec:float,text_detected:boolean,text:string>>
""".replace("\n", " ")


def media_index():
    """Schema of the main table (needs a running session to parse)."""
    return _parse_datatype_string(MEDIA_INDEX_DDL)
