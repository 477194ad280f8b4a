"""Token ids in flat binary files that trainers map into memory.

A folder of parts in ascending order of the documents. Part p has `p.ids`, all its ids one after another as little-endian unsigned integers (16 bits
if every id of the vocabulary fits, else 32); `p.off`, unsigned 64-bit offsets into it, one more than documents; and `p.doc`, the documents' ids as
signed 64-bit integers. `index`, a Parquet table with a row for each part, says how many documents and ids it has and how many ids all parts before
it have (base), by prefix sums over the parts: a document's place in the whole is base + offset.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.common import shared_dir, small_batches

#: Encoded pieces that a worker keeps, and characters of the longest one among them.
CACHED, LONGEST = 500_000, 40
#: Documents that are encoded, and that are read back, at a time.
ROWS, READ_ROWS = 4096, 4096
INDEX = "part string, n_docs long, n_null long, n_ids long, base long, width int"


def mounted(folder: str) -> str:
    """A folder's path in the file system. Files are mapped into memory, so all executors must have the folder mounted: other stores are an error."""
    at = urlparse(folder)
    if at.scheme not in ("", "file"):
        raise ValueError(f"token files are mapped into memory, so they need a mounted folder: {folder}")
    return unquote(at.path) if at.scheme else folder


class Encoder:
    """Texts to ids as the tokenizers library gives them, without special tokens added and without truncation and padding.

    A byte-level BPE with its regular expression and no normaliser always starts a token at a space between two signs that aren't white space. Texts
    are cut there, and what the library says of a piece is kept for the next time it comes. Of other kinds of tokenizers whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before = said.get("pre_tokenizer") or {}
        self.cuts = (
            said.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and said.get("post_processor") is None
            and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in said.get("added_tokens", []))
        )
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        marks = [(t["content"], t["id"]) for t in said.get("added_tokens", []) if t.get("special") and not t.get("normalized")]
        self.border = marks[0] if self.cuts and marks else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    #: A space that a token starts with, whatever stands further away; and texts with other spaces.
    CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
    OTHER = r"(^|[^!-~\pL\pN]) | ([^!-~\pL\pN]|$)"

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each after a space: many in one text, between added tokens, which end all others."""
        if self.border is None or any(self.border[0] in p for p in pieces):
            return self._ids([" " + p for p in pieces])
        mark, number = self.border
        ids = np.array(self.tokenizer.encode_batch_fast([f"{mark} " + f"{mark} ".join(pieces) + mark], add_special_tokens=False)[0].ids, dtype=self.kind)
        at, data = np.flatnonzero(ids == number).tolist(), ids.tobytes()
        return [data[(x + 1) * self.width : y * self.width] for x, y in zip(at, at[1:])]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, each after a space. What came up since the cache was last full, or in the time before that, is known."""
        out = list(map(self.known.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing and self.older:
            for i in missing:
                out[i] = self.older.get(pieces[i])
            again = {pieces[i]: out[i] for i in missing if out[i] is not None}
            self.known.update(again)
            missing = [i for i in missing if out[i] is None]
        for at in range(0, len(missing), 2048):
            part = missing[at : at + 2048]
            found = self._new([pieces[i] for i in part])
            for i, x in zip(part, found):
                out[i] = x
            self.known.update((pieces[i], x) for i, x in zip(part, found) if len(pieces[i]) <= LONGEST)
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        return out

    def encode(self, texts: pa.StringArray) -> list[bytes | memoryview]:
        """The ids of each text (none null) as bytes of `kind`."""
        if not self.cuts or not len(texts):
            return self._ids(texts.to_pylist())
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.OTHER).to_numpy(zero_copy_only=False))
        plain = np.setdiff1d(np.arange(len(texts)), odd)
        split = pc.split_pattern(texts.take(pa.array(plain)), " ")
        lists = [self.CUT.split(texts[int(i)].as_py()) for i in odd]
        sizes = np.concatenate([split.value_lengths().to_numpy(zero_copy_only=False), [len(x) for x in lists]]).astype(np.int64)
        ends = np.cumsum(sizes)
        pieces = pa.concat_arrays([split.flatten().cast(pa.string()), pa.array([p for x in lists for p in x], pa.string())])
        firsts = ends - sizes
        later = np.ones(len(pieces), dtype=bool)
        later[firsts] = False
        distinct = pieces.filter(pa.array(later)).dictionary_encode()
        coded = pa.array(self._pieces(distinct.dictionary.to_pylist()), pa.large_binary()).take(distinct.indices)
        offsets, data = np.frombuffer(coded.buffers()[1], dtype=np.int64, count=len(coded) + 1, offset=8 * coded.offset), memoryview(coded.buffers()[2] or b"")
        heads = self._ids(pieces.take(pa.array(firsts)).to_pylist())
        # Of the later pieces, those of text i begin after those of the texts before it.
        begun = firsts - np.arange(len(texts))
        out: list = [None] * len(texts)
        for i, at in enumerate([*plain.tolist(), *odd.tolist()]):
            a = int(begun[i])
            out[at] = heads[i] + data[int(offsets[a]) : int(offsets[a + int(sizes[i]) - 1])]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id: str = "doc_id", text: str = "text", parts: int | None = None) -> None:
    """Write the ids of all documents, each with end_id after them, in ascending order of their ids into a new folder that all executors have mounted.

    Null texts are empty: their end alone. Null ids come first; rows of one id stand in the order of a hash of their texts, and repeated rows are written each. An empty table
    gives an index without parts. Other columns aren't read. parts: how many files of each kind to make (the session's shuffle partitions, if not given).
    A task writes under names of its own attempt and then renames, so a repeated or late one changes nothing.
    """
    spark, root, parts = docs.sparkSession, mounted(folder), parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small_batches(spark)
    os.makedirs(root)
    rows = docs.select(F.col(id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"hash": F.xxhash64("text"), "salt": F.rand(7)})
    # The order is settled by document first. Texts' hashes and the salt let the rows of one id, even equal ones, lie in several parts.
    ordered = rows.repartitionByRange(parts, F.col("doc").asc_nulls_first(), "hash", "salt").sortWithinPartitions(F.col("doc").asc_nulls_first(), "hash", "salt").select("doc", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = f"part-{task.partitionId():06d}", f"{task.taskAttemptId()}-{uuid.uuid4().hex}"
        names = [f"{root}/{part}.{end}" for end in ("ids", "off", "doc")]
        encode, at, n_docs, n_null = encoder(tokenizer), 0, 0, 0
        end = np.array([end_id], dtype=encode.kind).tobytes()
        if int.from_bytes(end, "little") != end_id:
            raise ValueError(f"the end {end_id} is no id of {encode.width} bytes")
        files = [open(f"{name}.{attempt}", "wb") for name in names]
        try:
            files[1].write(np.array([0], dtype="<u8").tobytes())
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS):
                    some = batch.slice(a, ROWS)
                    coded = encode.encode(some.column(1))
                    files[0].write(b"".join(x for c in coded for x in (c, end)))
                    ends = at + np.cumsum([len(c) // encode.width + 1 for c in coded], dtype=np.uint64)
                    at = int(ends[-1])
                    files[1].write(ends.astype("<u8").tobytes())
                    files[2].write(some.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    n_docs, n_null = n_docs + some.num_rows, n_null + some.column(0).null_count
        finally:
            for f in files:
                f.close()
        for name in names:
            os.replace(f"{name}.{attempt}", name) if n_docs else os.unlink(f"{name}.{attempt}")
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n_docs], "n_null": [n_null], "n_ids": [at], "width": [encode.width]}, schema=pa.schema([("part", pa.string()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())]))

    made = sorted(ordered.mapInArrow(write, "part string, n_docs long, n_null long, n_ids long, width int").collect())  # a row for each part
    bases = np.cumsum([0, *(r.n_ids for r in made)]).tolist()
    spark.createDataFrame([(r.part, r.n_docs, r.n_null, r.n_ids, base, r.width) for r, base in zip(made, bases)], INDEX).coalesce(1).write.parquet(f"{folder}/index")


class Part:
    """One part's files, mapped. Sizes that the index doesn't give are an error."""

    def __init__(self, root: str, part: str, n_docs: int, n_null: int, n_ids: int, base: int, width: int):
        self.base, self.n_docs, self.n_null = base, n_docs, n_null
        for end, size in (("ids", n_ids * width), ("off", (n_docs + 1) * 8), ("doc", n_docs * 8)):
            if os.path.getsize(f"{root}/{part}.{end}") != size:
                raise ValueError(f"{part}.{end} of {root} has {os.path.getsize(f'{root}/{part}.{end}')} bytes, not the {size} of the index")
        self.ids = np.memmap(f"{root}/{part}.ids", dtype=f"<u{width}", mode="r")
        self.off = np.memmap(f"{root}/{part}.off", dtype="<u8", mode="r")
        self.doc = np.memmap(f"{root}/{part}.doc", dtype="<i8", mode="r")

    def tokens(self, i: int) -> np.ndarray:
        """The ids of the part's document i, without a copy."""
        return self.ids[int(self.off[i]) : int(self.off[i + 1])]

    def doc_ids(self, a: int, b: int) -> pa.Array:
        return pa.array(self.doc[a:b], pa.int64(), mask=np.arange(a, b) < self.n_null)


def _crc(ids: np.ndarray) -> int:
    """CRC-32 of ids as 32-bit integers, a million at a time."""
    crc = 0
    for at in range(0, len(ids), 1 << 20):
        crc = zlib.crc32(ids[at : at + (1 << 20)].astype("<u4").tobytes(), crc)
    return crc


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document of a folder, and its ids if asked for; a task for each part."""
    root = mounted(folder)
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(root, **row)
                for a in range(0, part.n_docs, READ_ROWS):
                    b = min(a + READ_ROWS, part.n_docs)
                    off = part.off[a : b + 1].astype(np.int64)
                    columns = [part.doc_ids(a, b), pa.array(off[:-1] + part.base), pa.array(np.diff(off)), pa.array([_crc(part.tokens(i)) for i in range(a, b)], pa.int64())]
                    if ids:
                        values = part.ids[off[0] : off[-1]].astype(np.int64)
                        columns.append(pa.LargeListArray.from_arrays(off - off[0], values).cast(pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return index.repartition(max(1, index.count())).mapInArrow(read, schema)


def token_file_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's rows: all documents written into a new folder of the shared one and read back."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer)
    return read_tokens(docs.sparkSession, folder, ids=False)
