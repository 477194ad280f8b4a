"""Helpers shared by the text-corpus operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.plans.storage import kept, shared_dir  # noqa: F401  (the operators take them from here)

WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch of rows: each task holds a few of them, in the JVM and in Python.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to BATCH_BYTES, if it is higher. Texts are long, and the limit on rows alone lets batches of any size through."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([bkmgt]?)b?", spark.conf.get(name).lower())
    if not now or int(now[1]) << 10 * "bkmgt".find(now[2] or "b") > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def kept_alone(df: DataFrame, name: str) -> DataFrame:
    """kept, for a frame that nothing else computes again: the shuffle files of its plan go as soon as it is written, and not whenever the driver's collector finds them unused."""
    conf, setting = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting, None)
    conf.set(setting, "true")
    try:
        return kept(df, name)
    finally:
        conf.set(setting, before) if before else conf.unset(setting)


def fresh(df: DataFrame, name: str) -> str:
    """A helper column's name that none of df's columns has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values: all first bytes, all second ones and so on, as many as are used, compressed: the uppermost and rarely used bytes take little room."""
    used = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    rows = values.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(rows[:, :used].T.tobytes())


def from_planes(data: bytes) -> np.ndarray:
    rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    out = np.zeros((rows.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = rows.T
    return out.view(np.uint64).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; 0 for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(0))


def text_bytes(name: str = "text") -> Column:
    """A text column as UTF-8 bytes."""
    return F.col(name).cast("binary").alias(name)


def map_rows(df: DataFrame, rows: Callable[[dict[str, list]], Iterable[dict[str, list] | None]], schema: str, slices: int = 1000) -> DataFrame:
    """Run `rows` over column slices of at most `slices` rows; it yields dicts of equally long lists in the order of `schema`."""
    small_batches(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, slices):
                part = batch.slice(at, slices)
                for out in rows(dict(zip(part.schema.names, (c.to_pylist() for c in part.columns)))):
                    if out is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(batches, fields)


def ascii_lower_words(text: bytes | None) -> list[bytes]:
    """Words between [\\x20\\x09-\\x0D], with A-Z in lower case; none for null."""
    return text.lower().split() if text else []
