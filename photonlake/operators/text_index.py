"""An index for text search: which blocks of frames can hold a query's terms, by posting lists of trigrams.

Frames lie in blocks by their file. A list says for each trigram which blocks have it; a term or phrase can only be in blocks that have all of its trigrams. Those blocks are read, and the search
itself (search.search_text) decides; a block that is read for nothing costs time and changes nothing.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.operators import search

GRAM = 3
LISTS = "gram long, block int, folder int"


def build(frames: DataFrame, path: str, blocks: int = 1024, folders: int = 256) -> None:
    """Write the index of frames (file_name, is_video, timestamp_sec, text_lower, ...): path/blocks has them, a folder for each block, path/lists the blocks of each trigram. blocks: so many that the
    rows of one suit a task. Frames without a text aren't kept: no search finds them."""
    rows = frames.filter("text_lower IS NOT NULL AND text_lower <> ''").withColumn("block", F.pmod(F.xxhash64("file_name"), F.lit(blocks)).cast("int"))
    rows.repartition("block").write.partitionBy("block").parquet(f"{path}/blocks")
    rows.limit(0).drop("block").coalesce(1).write.parquet(f"{path}/schema")
    frames.sparkSession.createDataFrame([(blocks, folders)], "blocks int, folders int").coalesce(1).write.parquet(f"{path}/sizes")
    grams = F.array_distinct(F.regexp_extract_all("text_lower", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    lists = rows.select("block", F.explode(grams).alias("g")).select(F.xxhash64("g").alias("gram"), "block").distinct()
    lists.withColumn("folder", F.pmod("gram", F.lit(folders)).cast("int")).repartition("folder").sortWithinPartitions("gram").write.partitionBy("folder").parquet(f"{path}/lists")


def _grams(text: str) -> list[int]:
    found = {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
    return sorted((x := xxhash.xxh64_intdigest(g.encode(), seed=42)) - (x >> 63 << 64) for g in found)


def blocks_for(spark: SparkSession, path: str, query: str) -> tuple[list[int], int]:
    """Blocks that can hold frames that a query finds, and how many blocks there are: those with all trigrams of the phrase, or of one of the terms. A term shorter than a trigram can be in any. The
    blocks' numbers come to the driver: as many as the index was built with, at most."""
    sizes = spark.read.parquet(f"{path}/sizes").first()
    terms, phrase, quoted = search.terms_of(query)
    wanted = [_grams(x) for x in ([phrase] if quoted else terms)] if terms else []
    if any(not g for g in wanted):
        return list(range(sizes.blocks)), sizes.blocks
    lists = spark.read.schema(LISTS).parquet(f"{path}/lists")
    found: set[int] = set()
    for grams in wanted:
        held = lists.filter(F.col("folder").isin(sorted({g % sizes.folders for g in grams})) & F.col("gram").isin(grams)).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        found |= {r.block for r in held.filter(F.col("n") == len(grams)).collect()}
    return sorted(found), sizes.blocks


def search_index(spark: SparkSession, path: str, query: str, min_score: float = 0.0, video_only: bool = False, folder: str = "") -> DataFrame:
    """The rows of search.search_text over all frames, out of the blocks that can hold them."""
    blocks, _ = blocks_for(spark, path, query)
    schema = spark.read.parquet(f"{path}/schema").schema.add("block", "integer")
    rows = spark.read.schema(schema).parquet(f"{path}/blocks").filter(F.col("block").isin(blocks)).drop("block")
    return search.search_text(rows, query, min_score, video_only, folder)
