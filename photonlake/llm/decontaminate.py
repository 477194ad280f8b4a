"""Benchmark decontamination by windows of normalised words.

The windows of the benchmark become a set of hashes that is broadcast (its built size is checked; beyond the
bound, windows are joined). Documents are scanned once; a hashed hit is verified word by word, and hit
words, hit items or whole documents can then be taken out.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photonlake.llm.common import fresh, kept, map_rows, text_bytes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of the built window set up to which it is broadcast. Each Python worker holds one.
BROADCAST_BYTES = 64 << 20


def words_of(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and everything beyond ASCII, A-Z in lower case."""
    return WORD.findall(text.lower()) if text else []


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """Windows of `size` words in a row; a shorter item, if it has words, is one window."""
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) > size else [tuple(words)] if words else []


_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Powers:
    """Powers of the step and of its inverse, made once and longer as texts ask for them."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            more = 1 << max(12, n - 1).bit_length() if n > 4096 else 4096
            cls.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(more - 1, _STEP))), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(more - 1, _BACK))), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


class Sums:
    """Hashes of all windows of a text, of any size: differences of running sums."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _Powers.of(len(hashes))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * up, dtype=np.uint64)))

    def windows(self, n: int) -> np.ndarray:
        x = (self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n]
        return x ^ x >> np.uint64(31)


class WindowSet:
    """The benchmark's windows: for each length the sorted hashes, with the item and place of each; and the items' words, by which hits are verified. All of it lies in
    arrays and one string of bytes, of the size `nbytes`."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], size: int):
        self.names: list[str] = []
        texts, lengths, hashes, owners, places, at = [], [], {}, {}, {}, 0
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            n = min(size, len(words))
            found = Sums(word_hashes(words)).windows(n)
            hashes.setdefault(n, []).append(found)
            owners.setdefault(n, []).append(np.full(len(found), len(self.names), dtype=np.int32))
            places.setdefault(n, []).append(np.arange(at, at + len(found), dtype=np.int64))
            self.names.append(item if item is not None else "")
            texts.append(b" ".join(words))
            lengths.append(np.array([len(w) + 1 for w in words], dtype=np.int64))
            at += len(words)
        #: All items' words, each with a space after it, and where each begins.
        self.text = b" ".join(texts) + b" "
        self.starts = np.concatenate(([0], np.cumsum(np.concatenate(lengths)))) if lengths else np.zeros(1, dtype=np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(hashes):
            h = np.concatenate(hashes[n])
            order = np.argsort(h, kind="stable")
            h = h[order]
            bits = max(16, (8 * len(h)).bit_length())
            seen = np.zeros(1 << bits - 3, dtype=np.uint8)
            low = h & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(seen, low >> np.uint64(3), np.left_shift(np.uint8(1), (low & np.uint64(7)).astype(np.uint8)))
            self.tables[n] = h, np.concatenate(owners[n])[order], np.concatenate(places[n])[order], seen

    @property
    def nbytes(self) -> int:
        return len(self.text) + self.starts.nbytes + sum(len(n) + 60 for n in self.names) + sum(x.nbytes for t in self.tables.values() for x in t)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words stand inside an occurring window, and the items that have one."""
        hit, items = np.zeros(len(words), dtype=bool), set()
        sums = None
        for n, (known, owner, place, seen) in self.tables.items():
            if len(words) < n:
                break
            sums = sums or Sums(word_hashes(words))
            found = sums.windows(n)
            # A table of bits first: nearly all windows end there.
            low = found & np.uint64(8 * len(seen) - 1)
            at = np.flatnonzero(seen[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & np.uint8(1))
            if not len(at):
                continue
            first, last = np.searchsorted(known, found[at]), np.searchsorted(known, found[at], side="right")
            for i, a, b in zip(at[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist()):
                window = b" ".join(words[i : i + n]) + b" "
                for k in range(a, b):
                    p = int(place[k])
                    if self.text[self.starts[p] : self.starts[p + n]] == window:
                        hit[i : i + n] = True
                        items.add(self.names[owner[k]])
        return hit, items


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), text_bytes().alias("text"))


def bounded_windows(benchmark: DataFrame, size: int, limit: int) -> WindowSet | None:
    """The window set, if it takes no more than `limit` bytes as built; else None. Its text is read to the driver only if it is under an eighth of that: what is
    built has some 40 bytes for each word."""
    row = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("b")).first()
    if row.b > limit // 8:
        return None
    built = WindowSet([(r.item, r.text) for r in _items(benchmark).collect()], size)
    return built if built.nbytes <= limit else None


def _summary(n_words: int, n_hit: int, items: set[str], min_percent: int) -> tuple:
    return n_words, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0 and 100 * n_hit >= min_percent * n_words


COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _scan(docs: DataFrame, windows: WindowSet, finish, schema) -> DataFrame:
    """Broadcast path: finish(part, texts, [(words hit, items), ...]) makes the output columns."""
    sent = docs.sparkSession.sparkContext.broadcast(windows)
    text = fresh(docs, "__text")

    def rows(part):
        yield finish(part, part[text], [sent.value.hits(words_of(t)) for t in part[text]])

    return map_rows(docs.withColumn(text, text_bytes("text")), rows, schema, slices=500)


def _window_hash(words: tuple[bytes, ...]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _joined(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """Path for a benchmark of any size: rows (key, hits) where key is the digest of a text and hits are (start, length, item)."""

    def item_windows(part):
        h, n, item = [], [], []
        for i, t in zip(part["item"], part["text"]):
            for w in set(windows_of(words_of(t), size)):
                h.append(_window_hash(w))
                n.append(len(w))
                item.append(i if i is not None else "")
        yield {"h": h, "n": n, "item": item}

    wanted = kept(map_rows(_items(benchmark), item_windows, "h binary, n int, item string").distinct(), "windows")
    lengths = sorted(r.n for r in wanted.select("n").distinct().collect())  # at most `size` of them

    def document_windows(part):
        for t in part["text"]:
            w = words_of(t)
            key = xxhash.xxh3_128_digest(t or b"")
            for n in lengths:
                for at in range(0, len(w) - n + 1, 20_000):
                    k = range(at, min(at + 20_000, len(w) - n + 1))
                    yield {"key": [key] * len(k), "h": [_window_hash(tuple(w[i : i + n])) for i in k], "at": list(k)}

    texts = docs.select(text_bytes("text")).distinct()
    windows = map_rows(texts, document_windows, "key binary, h binary, at int", slices=100)
    hits = windows.join(wanted, "h")
    # A text has at most its own words as starts; items of one window are kept as one sorted list.
    at = hits.groupBy("key", "at", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return at.groupBy("key").agg(F.collect_list(F.struct("at", "n", "items")).alias("__hits"))


def _scan_joined(docs: DataFrame, benchmark: DataFrame, size: int, finish, schema) -> DataFrame:
    text, key, found_in = (fresh(docs, n) for n in ("__text", "__key", "__found"))

    def digest(part):
        yield part | {key: [xxhash.xxh3_128_digest(t or b"") for t in part[text]]}

    source = docs.withColumn(text, text_bytes("text"))
    keyed = map_rows(source, digest, T.StructType([*source.schema.fields, T.StructField(key, T.BinaryType())]))
    hits = kept(_joined(docs, benchmark, size), "hits").select(F.col("key").alias(key), F.col("__hits").alias(found_in))

    def rows(part):
        found = []
        for t, x in zip(part[text], part[found_in]):
            hit, items = np.zeros(len(words_of(t)), dtype=bool), set()
            for h in x or []:
                hit[h["at"] : h["at"] + h["n"]] = True
                items |= set(h["items"])
            found.append((hit, items))
        yield finish(part, part[text], found)

    return map_rows(keyed.join(hits, key, "left"), rows, schema, slices=500)


def _run(docs: DataFrame, benchmark: DataFrame, size: int, finish, schema, limit: int) -> DataFrame:
    if (windows := bounded_windows(benchmark, size, limit)) is not None:
        return _scan(docs, windows, finish, schema)
    return _scan_joined(docs, benchmark, size, finish, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, min_percent: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id and, for every row, words, hit words, items with occurring windows, their digest and the verdict (some hit, and
    at least min_percent of the words). Null has no words and is clean; an empty benchmark hits nothing; a null item id counts as an empty one."""

    def finish(part, source, found):
        out = [_summary(len(hit), int(hit.sum()), items, min_percent) for hit, items in found]
        return {"doc_id": part["doc_id"]} | {n: [x[i] for x in out] for i, n in enumerate(NAMES)}

    return _run(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, size, finish, f"doc_id long, {COLUMNS}", broadcast_bytes)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, min_percent: int = 5, spans: bool = False, n_chars: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without contaminated documents; every other column stays. With spans, documents stay and lose the words that are
    hit instead, with what stands between hit words that follow one another; n_chars, if named, is then counted again."""
    schema = docs.schema

    def finish(part, source, found):
        if spans:
            texts = [t if t is None or not hit.any() else _cut(b, hit) for t, b, (hit, _) in zip(part["text"], source, found)]
            counts = {n_chars: [n if not hit.any() else len(t) for n, t, (hit, _) in zip(part[n_chars], texts, found)]} if n_chars else {}
            return {n: part[n] for n in schema.names} | {"text": texts} | counts
        stay = [i for i, (hit, items) in enumerate(found) if not _summary(len(hit), int(hit.sum()), items, min_percent)[4]]
        return {n: [part[n][i] for i in stay] for n in schema.names}

    return _run(docs, benchmark, size, finish, schema, broadcast_bytes)


def _cut(text: bytes, hit: np.ndarray) -> str:
    out, at, was = [], 0, False
    for m, h in zip(WORD.finditer(text.lower()), hit):
        if h:
            if not was:
                out.append(text[at : m.start()])
            at = m.end()
        was = h
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


#: The contract's rows in DuckDB SQL.
ORACLE = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, len(x) AS n, array_to_string(x, ' ') AS key FROM (
    SELECT item, list_slice(w, i, i + 12) AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0))
), lengths AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
), hits AS (SELECT p.doc_id, p.i, p.n, v.item FROM places p JOIN windows v ON p.n = v.n AND p.key = v.key
), words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hits) GROUP BY doc_id
), owners AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items,
       coalesce(o.digest, sha256('')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AND 20 * coalesce(words.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN owners o ON o.doc_id = d.doc_id
"""
