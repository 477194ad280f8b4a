"""Registry of queries and of the DuckDB SQL with the same rows, and the stand-ins for media tables that they read.

The tables at hand hold no media, so documents, vectors, URLs and events stand in for files, frames, paths and states.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class StandIn:
    """Columns over a table: expressions that both dialects read alike, or a pair (Spark, DuckDB)."""

    source: str
    columns: tuple[tuple[str, str | tuple[str, str]], ...]
    where: str = "TRUE"

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.source).filter(self.where).selectExpr(*[f"{e if isinstance(e, str) else e[0]} AS {n}" for n, e in self.columns])

    @property
    def sql(self) -> str:
        return "SELECT " + ", ".join(f"{e if isinstance(e, str) else e[1]} AS {n}" for n, e in self.columns) + f" FROM {self.source} WHERE {self.where}"


_K = "CAST(floor(vec_id / 3) AS BIGINT)"
#: Three frames for each file.
FRAMES = StandIn("embeddings", (
    ("file_name", f"concat('c', {_K} % 4, '/d', {_K} % 5, '/f', {_K}, CASE WHEN {_K} % 4 = 0 THEN '.mp4' ELSE '.jpg' END)"), ("is_video", f"{_K} % 4 = 0"),
    ("timestamp_sec", "CAST(vec_id % 3 AS DOUBLE)"), ("vector", "embedding"), ("vec_id", "vec_id"),
))
_HASH = ("CAST(conv(substr(md5(coalesce(text, '')), 1, 16), 16, -10) AS BIGINT) ^ (doc_id % 8)", "xor(CAST('0x' || substr(md5(coalesce(text, '')), 1, 16) AS UBIGINT), CAST(doc_id % 8 AS UBIGINT))")
_NAME = "concat(source, '/', lang, '/f', doc_id, CASE WHEN doc_id % 5 = 0 THEN '.mp4' ELSE '.jpg' END)"
#: One file for each document; copies of a text have hashes up to three bits apart.
FILES = StandIn("documents", (
    ("doc_id", "doc_id"), ("file_name", _NAME), ("collection_id", "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source END"), ("is_video", "doc_id % 5 = 0"), ("h", _HASH),
    ("image_width", "CAST(n_chars % 4000 AS INT)"), ("image_height", "CAST(n_chars % 3000 AS INT)"), ("source_size", "n_chars * 10"), ("source_mtime_ns", "doc_id * 1000000000000 - 7"),
    ("timestamp_sec", "CAST(doc_id % 3 AS DOUBLE)"), ("text_lower", "lower(text)"), ("text", "text"),
))
#: Links between files: a tree over all documents; unchecked links cut it into groups of many sizes.
EDGES = StandIn("documents", (("file_name", "concat('f', doc_id)"), ("target", "concat('f', CAST(floor(doc_id / 2) AS BIGINT))"), ("checked", "doc_id % 7 <> 0"), ("inliers", "CAST(n_chars % 100 AS INT)")))
#: Paths.
PATHS = StandIn("pages", (("page_id", "page_id"), ("path", "concat('/', split_part(split_part(url, '//', 2), '?', 1), '/img', page_id, '.jpg')")))

#: The same stand-ins as common table expressions.
WITH = f"WITH RECURSIVE frames AS ({FRAMES.sql}), files AS ({FILES.sql}), edges AS ({EDGES.sql}), paths AS ({PATHS.sql})"
