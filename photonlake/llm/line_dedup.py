"""Line dedup over a whole corpus.

Lines are normalised and hashed, hashes are exploded and counted by distinct document, lines over the
threshold are dropped everywhere but in one document, and what stays is put together in its order.
"""

from __future__ import annotations

import hashlib

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import WHITE, fresh, kept, map_rows, text_bytes


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends and with A-Z in lower case."""
    return line.strip(WHITE).lower()


def hashed(key: bytes) -> tuple[int, int]:
    """128 bits of a key as two signed halves; among 10^13 lines a collision is less likely than 10^-12."""
    x = xxhash.xxh3_128_intdigest(key)
    a, b = x >> 64, x & (1 << 64) - 1
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def long_keys(text: bytes | None, min_chars: int) -> set[tuple[int, int]]:
    """Hashes of a text's distinct keys of at least min_chars code points."""
    keys = {k for line in (text or b"").split(b"\n") if len(k := line_key(line)) >= min_chars}
    return {hashed(k) for k in keys if len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars}


def dropped_keys(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Rows (id, own, drop) with the key hashes that a document loses: those in at least min_docs documents, of which it isn't the one with the largest id.
    own is told_apart(id, text): rows without an id lose each its own keys."""
    slim = docs.select(F.col(id).alias("id"), told_apart(id, text).alias("own"), text_bytes(text).alias("text"))

    def keys(part):
        ids, own, a, b = [], [], [], []
        for i, o, t in zip(part["id"], part["own"], part["text"]):
            for x, y in long_keys(t, min_chars):
                ids.append(i)
                own.append(o)
                a.append(x)
                b.append(y)
        yield {"id": ids, "own": own, "a": a, "b": b}

    kind = dict(slim.dtypes)["id"]
    pairs = kept(map_rows(slim, keys, f"id {kind}, own long, a long, b long"), "lines")
    per_document = pairs.groupBy("a", "b", "id").agg(F.lit(1).alias("one"))
    # Written and read: then both sides of the join below are dealt anew, and a key of very many documents can be split.
    common = kept(per_document.groupBy("a", "b").agg(F.count("id").alias("n"), F.max("id").alias("last")).filter(F.col("n") >= min_docs).select("a", "b", "last"), "common")
    losing = pairs.join(common, ["a", "b"]).filter(~F.col("id").eqNullSafe(F.col("last")))
    return losing.groupBy("id", "own").agg(F.collect_set(F.struct("a", "b")).alias("drop"))


def told_apart(id: str, text: str) -> Column:
    """0 for a row with an id, else a hash of its text. However many rows lack an id, each meets only its own keys."""
    return F.when(F.col(id).isNull(), F.xxhash64(F.col(text).cast("binary"))).otherwise(F.lit(0))


def _kept_lines(text: bytes | None, drop: list[dict] | None, min_chars: int) -> tuple[list[bytes], int]:
    lines = (text or b"").split(b"\n")
    if not drop:
        return lines, len(lines)
    gone = {(d["a"], d["b"]) for d in drop}
    stay = [x for x in lines if not (len(k := line_key(x)) >= min_chars and hashed(k) in gone)]
    return stay, len(lines)


def _with_drop(docs: DataFrame, id: str, text: str, min_chars: int, min_docs: int) -> tuple[DataFrame, str]:
    """docs with the list of keys that each row loses, and that column's name."""
    drop = kept(dropped_keys(docs, id, text, min_chars, min_docs), "drop")
    owner, own, keys = fresh(docs, "__drop_id"), fresh(docs, "__drop_own"), fresh(docs, "__drop")
    # Merged at every size: a broadcast of short lists would give way to this anyway as the corpus grows.
    lists = drop.select(F.col("id").alias(owner), F.col("own").alias(own), F.col("drop").alias(keys)).hint("merge")
    return docs.join(lists, F.col(id).eqNullSafe(F.col(owner)) & (told_apart(id, text) == F.col(own)), "left").drop(owner, own), keys


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, n_chars: str | None = None) -> DataFrame:
    """docs with repeated lines taken out of the text column; the other columns stay, but n_chars, if named, is counted again.

    Null stays null and empty stays empty. Rows with the same id count as one document and lose the same keys. A null id
    counts as no document and keeps no line that others hold often enough. A text may end up empty; its row stays.
    """
    schema = docs.schema
    source, keys = _with_drop(docs, id, text, min_chars, min_docs)

    def rows(part):
        drop = part.pop(keys)
        texts = [t if t is None or not d else b"\n".join(_kept_lines(t.encode("utf-8", "surrogatepass"), d, min_chars)[0]).decode("utf-8", "replace") for t, d in zip(part[text], drop)]
        if n_chars:
            part = part | {n_chars: [n if not d else len(t or "") for n, t, d in zip(part[n_chars], texts, drop)]}
        yield part | {text: texts}

    return map_rows(source, rows, schema, slices=200)


def line_dedup_digests(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what dedup_lines keeps, for every row; null is one empty line. Null ids and rows of one id are treated as there."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    source, keys = _with_drop(slim, "doc_id", "text", min_chars, min_docs)

    def rows(part):
        n, gone, digest = [], [], []
        for t, d in zip(part["text"], part[keys]):
            stay, all_ = _kept_lines(t, d, min_chars)
            n.append(all_)
            gone.append(all_ - len(stay))
            digest.append(hashlib.sha256(b"\n".join(stay)).hexdigest())
        yield {"doc_id": part["doc_id"], "n_lines": n, "n_dropped": gone, "kept_sha256": digest}

    return map_rows(source, rows, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


#: The contract's rows in DuckDB SQL.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, list_extract(parts, pos) AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
