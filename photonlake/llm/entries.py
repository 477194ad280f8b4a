"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from photonlake.llm import bpe, centroids, chat, chat_repair, decontaminate, html_text, line_dedup, lm, simhash, token_files, topk, toxicity, warc


def vocabulary() -> str:
    """Where the public tokenizers keep the word-end vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def byte_vocabulary() -> str:
    """Where the public tokenizers keep the byte-level vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents; null and empty texts are one empty line, rows of one id are one document, rows without one keep no common line; every row is returned."""
    return line_dedup.line_dedup_digests(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; null and empty texts have no matches, a null id isn't held out, repeated rows are scored each; without labels all scores are near 0."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their linked groups; null and empty texts have fingerprint 0 and link like any other; a null id takes part but names no group."""
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all pages; null, empty and textless html has an empty text; null ids and urls stay, repeated rows are returned each."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives of a response made of each page; null html is an empty body, null ids and urls are named as such, repeated rows give equal records."""
    return warc.page_derivatives(_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all documents; null and empty texts have no words and are clean, repeated rows are returned each, and an empty benchmark hits nothing."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs out of all conversations; null ids are left out, null roles and texts are empty, turns of one number stand in the order of role and text."""
    return chat.preference_digests(_table(spark, sf_dir, "conversations"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents; null is encoded as empty, null ids stay, repeated rows are returned each."""
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), vocabulary())


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; null and empty texts are one end, a null id is held out, repeated rows count and are scored each."""
    return lm.score_texts(_table(spark, sf_dir, "documents"), stable=True)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of each query; vectors that are null or hold null or non-finite components take no part, nor do null ids; ties go to the smaller id; repeated candidates count each."""
    return topk.every_fiftieth(_table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits of all conversations; nulls are one space in roles, texts and the damage's key, a null id names a conversation like any other, repeated rows are rows of their own."""
    return chat_repair.repair_digests(chat_repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' ids; null texts are empty, null ids come first, repeated rows are written and returned each, an empty table gives no rows."""
    return token_files.token_file_digests(_table(spark, sf_dir, "documents"), byte_vocabulary())


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 finite components; others are left out, null ids and repeated rows are returned each, an empty table gives no rows."""
    return centroids.sort_means(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_simhash, op4_html_extraction, op5_warc, op6_decontamination, op7_chat_pairs, op8_bpe, op9_lm_scoring, op10_topk, op11_conversation_repair, op12_token_files, op13_sort_means)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE, "op6_decontamination": decontaminate.ORACLE, "op7_chat_pairs": chat.ORACLE, "op10_topk": topk.ORACLE, "op11_conversation_repair": chat_repair.ORACLE, "op13_sort_means": centroids.ORACLE}
