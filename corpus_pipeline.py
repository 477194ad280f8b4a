"""A corpus run from raw documents to token ids: each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm import bpe, common, decontaminate, entries, line_dedup, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below 0.7, under a lexicon learned from the labelled ones among them. Null and empty texts have no matches and stay, as do rows without an id
    and repeated rows, each by its own text; an empty table stays empty; without labels nothing goes."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, lexicon)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that at least five hold, but in the last of those; n_chars follows. No row goes. Null texts stay null; rows of one id
    are one document; rows without an id are none, and keep no line that enough documents hold; an empty table stays empty."""
    return line_dedup.dedup_lines(docs, n_chars="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: SimHash fingerprints of five-word shingles, then similarity 0.8. Null and empty texts are copies of one another; rows
    of one id stay or go together; rows without an id stay; an empty table stays empty."""
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark. Null and empty texts have no words and stay; rows without an id and repeated rows stay or go by their own
    texts; an empty table stays empty, and an empty benchmark takes nothing."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with token ids (ids), their number (n_tokens) and the text decoded from them (decoded); columns of these names, in whatever case, are
    replaced. Null is encoded as empty; every row stays, repeated ones and those without an id too; an empty table stays empty."""
    coded = bpe.encode_texts(docs, entries.vocabulary(), decoded="decoded")
    return coded.select(*(c for c in coded.columns if c.lower() != "n_tokens"), F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Toxicity is learned and BPE is no SQL, so there is none for the whole run; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet in the shared folder and read again. What each stage does with null, empty, repeated and
    missing rows stands there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
