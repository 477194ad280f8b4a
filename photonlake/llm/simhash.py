"""SimHash near-dedup.

Fingerprints are grouped first, so that copies count once. Two fingerprints within the radius agree on some
combination of bit blocks; each such combination is a table of buckets. Within a bucket, fingerprints are
compared as vertical bit planes: one shift compares every fingerprint with the one r places on, a carry-save
counter adds up the differing bits of all of them at once, and a block is abandoned as soon as every pair in
it is past the radius. Each bucket hands on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import ascii_lower_words, fresh, kept, map_rows, packed, text_bytes, unpacked
from photonlake.operators.graph import components

SEED = 42
BITS = 64
#: Fingerprints of a bucket compared by one task; larger buckets are dealt out as pairs of chunks.
CHUNK = 4096
#: Bytes of shingles held together by one task; a bucket of more is dealt out as pairs of chunks.
CHECK_BYTES = 16 << 20
#: Share of all the bytes that are compared, below which no key is dealt out (nor below a sixteenth of CHECK_BYTES).
SHARES = 64
#: Positions whose bit planes are compared together.
BLOCK = 16384


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64 bits, each 1 if set in over half of the shingles' hashes; 0 without words."""
    w = ascii_lower_words(text)
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(w) - words + 1)
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65536):
        hashes = [digest(b" ".join(w[i : i + words]), SEED) for i in range(at, min(at + 65536, n))]
        votes += np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row."""
    slim = docs.select(F.col(id).cast("long").alias("id"), text_bytes(text).alias("text"))
    return map_rows(slim, lambda part: [{"id": part["id"], "fp": [signed(fingerprint(t, words)) for t in part["text"]]}], "id long, fp long")


def block_tables(n: int, radius: int, per_bucket: int = 64) -> list[int]:
    """Masks such that two fingerprints within the radius agree on all bits of at least one. With radius + k blocks, k of
    them must agree; k grows until chance fills a bucket with at most per_bucket of n fingerprints."""
    for k in range(1, 5):
        m = radius + k
        edges = [round(i * BITS / m) for i in range(m + 1)]
        blocks = [((1 << edges[i + 1] - edges[i]) - 1) << edges[i] for i in range(m)]
        if k == 4 or n >> (BITS * k // m) <= per_bucket:
            return [sum(c) for c in combinations(blocks, k)]
    raise AssertionError


def linked_in_buckets(fps: np.ndarray, bucket: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within the radius, shift by shift. fps: unsigned, one or a row of them for each position, sorted by bucket."""
    fps = fps.reshape(len(bucket), -1)
    bits_in_all = BITS * fps.shape[1]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.append(starts, len(bucket)))
    place = np.arange(len(bucket))
    size = np.repeat(sizes, sizes)
    begin = np.repeat(starts, sizes)
    need = max(1, int(radius + 1).bit_length())  # counter planes; the last one's overflow means past the radius
    shift = 1
    while True:
        live = size > shift
        if not live.all():
            fps, bucket, place, size, begin = fps[live], bucket[live], place[live], size[live], begin[live]
        if not len(fps):
            return
        until = int(size.min())  # every bucket that is left has more than shift rows; up to the smallest size no one drops out
        planes_of: dict[int, list[int]] = {}
        for at in range(0, len(fps), BLOCK):
            far = min(len(fps), at + BLOCK + until)
            bits = np.unpackbits(np.ascontiguousarray(fps[at:far]).view(np.uint8).reshape(far - at, -1), axis=1)
            planes_of[at] = [int.from_bytes(np.packbits(bits[:, b], bitorder="little").tobytes(), "little") for b in range(bits_in_all)]
        for r in range(shift, until):
            for at, planes in planes_of.items():
                count = min(BLOCK, len(fps) - at - r)
                if count <= 0:
                    continue
                here = np.packbits(bucket[at : at + count] == bucket[at + r : at + r + count], bitorder="little")
                alive = int.from_bytes(here.tobytes(), "little")
                counters = [0] * need
                for p in planes:
                    carry = (p ^ (p >> r)) & alive
                    for k in range(need):
                        counters[k], carry = counters[k] ^ carry, counters[k] & carry
                        if not carry:
                            break
                    alive &= ~_over(counters, radius, alive)
                    if not alive:
                        break
                if alive:
                    near = np.unpackbits(np.frombuffer(alive.to_bytes(-(-count // 8), "little"), dtype=np.uint8), bitorder="little")[:count]
                    i = np.flatnonzero(near) + at
                    yield place[i], place[i + r]
        shift = until


def _over(counters: list[int], radius: int, alive: int) -> int:
    """Positions whose count is over the radius; counts never pass radius + 1, as such positions are taken out at once."""
    over = alive
    for k, c in enumerate(counters):
        over &= c if radius + 1 >> k & 1 else ~c
    return over


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n positions the smallest position that the pairs link it to."""
    root = np.arange(n)
    for a, b in pairs:
        apart = np.flatnonzero(root[a] != root[b])
        if not len(apart):
            continue
        for i, j in zip(a[apart].tolist(), b[apart].tolist()):
            while root[i] != i:
                i = root[i]
            while root[j] != j:
                j = root[j]
            if i < j:
                root[j] = i
            elif j < i:
                root[i] = j
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def links(classes: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) between fingerprints (column fp of classes), u > v: per bucket a spanning forest of the pairs within the radius."""
    n = classes.count()
    if n < 2:
        return classes.sparkSession.createDataFrame([], "u long, v long")
    masks = block_tables(n, radius)
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(signed(m)))) for t, m in enumerate(masks)])
    rows = classes.select(F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("print"), F.explode(tables).alias("key"))
    return linked(rows, radius, chunk)


def dealt(rows: DataFrame, limit: int, weight: Column | None = None) -> DataFrame:
    """rows (with node and key) with the task, a long, that compares each. A key whose weights (1 for each row unless given) pass `limit` is dealt out as
    pairs of chunks, so that any two of its rows meet in a task and no task holds much more than two chunks."""
    sizes = rows.groupBy("key").agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    large = kept(sizes.filter(F.col("n") > limit), "large")
    parts = F.coalesce(F.ceil(F.col("n") / limit), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")
    # A row of chunk c goes to the tasks (c, 0..c) and (c.., c): one for each other chunk, and one for its own.
    out = rows.join(large, "key", "left").withColumn("parts", parts).withColumn("own", own)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Keys and tasks are hashed to longs. Should two meet, some pairs are compared that no bucket asks for; links are checked by distance, so that is harmless.
    return out.withColumn("task", F.xxhash64("key", F.greatest("own", "other"), F.least("own", "other"))).drop("n", "parts", "own", "other")


def linked(rows: DataFrame, radius: int, chunk: int = CHUNK, sure: int | None = None) -> DataFrame:
    """Edges (u, v) between nodes that share a key and whose fingerprints are within the radius: for each key a spanning forest. rows: node long, print
    binary (as long for every row, whole 8-byte words), key long. A key of over `chunk` rows is dealt out as pairs of chunks. With `sure`, a smaller radius,
    there are two forests: column sure is true in that of the pairs within it."""
    spread = dealt(rows.select("node", "print", "key"), chunk).select("node", "print", "task").repartition("task").sortWithinPartitions("task", "node")

    radii = [radius] if sure is None else [radius, sure]

    def done(node: np.ndarray, task: np.ndarray, prints: list[bytes]) -> Iterator[pa.RecordBatch]:
        fps = np.frombuffer(b"".join(prints), dtype=np.uint64)
        for r in radii:
            root = forest(len(node), linked_in_buckets(fps, task, r))
            child = np.flatnonzero(root != np.arange(len(node)))
            a, b = node[child], node[root[child]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(np.full(len(a), r == sure))], names=["u", "v", "sure"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, tasks, prints = np.array([], dtype=np.int64), np.array([], dtype=np.int64), []
        for batch in batches:
            nodes = np.concatenate((nodes, batch.column(0).to_numpy()))
            tasks = np.concatenate((tasks, batch.column(2).to_numpy()))
            prints += batch.column(1).to_pylist()
            if len(nodes) < 65536:
                continue
            cut = int(np.searchsorted(tasks, tasks[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield from done(nodes[:cut], tasks[:cut], prints[:cut])
            nodes, tasks, prints = nodes[cut:], tasks[cut:], prints[cut:]
        if len(nodes):
            yield from done(nodes, tasks, prints)

    found = spread.mapInArrow(compare, "u long, v long, sure boolean").filter("u > v")
    return found.distinct() if sure is not None else found.select("u", "v").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """id, fp and component_id (the smallest id reachable over links) of every row. Null and empty texts have fingerprint 0
    and link like any other; a null id takes part and never names a component unless all its ids are null."""
    fps = kept(fingerprints(docs, id, text, words), "fps")
    classes = kept(fps.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    grouped = components(links(classes, radius), "u", "v")
    named = grouped.join(classes, grouped.node == classes.fp).select("root", "least").groupBy("root").agg(F.min("least").alias("component_id"))
    found = kept(grouped.join(named, "root").select(F.col("node").alias("fp"), "component_id"), "components")
    whole = kept(classes.join(found, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return fps.join(whole, "fp").select("id", "fp", "component_id")


#: Least shingles by which the texts of near_copies come together.
LEAST = 6
#: Words of 64 bits in the fingerprints of near_copies.
LONG_WORDS = 4
_MIX = np.array([signed((0x9E3779B97F4A7C15 * (2 * k + 1) ^ 0xD6E8FEB86659FD93 >> k) & (1 << 64) - 1 | 1) for k in range(2 * LEAST)], dtype=np.int64).view(np.uint64)
_MIX_LONG = np.array([signed((0xC2B2AE3D27D4EB4F * (2 * k + 1) ^ 0x165667B19E3779F9 >> k) & (1 << 64) - 1 | 1) for k in range(2 * LONG_WORDS)], dtype=np.int64).view(np.uint64)


def _mixed(hashes: np.ndarray, k: int, mix: np.ndarray = _MIX) -> np.ndarray:
    """Another hash of each hash."""
    x = hashes * mix[k]
    x ^= x >> np.uint64(29)
    x *= mix[k + len(mix) // 2]
    return x ^ x >> np.uint64(32)


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    w = ascii_lower_words(text)
    n = max(1, len(w) - words + 1) if w else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in range(n)), dtype=np.uint64, count=n))


#: Bits of each shingle's hash by which sets are compared: among 10^6 shingles of two texts one is taken for another by chance, among 1,000 one in a million times.
COMPARED_BITS = 40


def compared(shingles: np.ndarray) -> np.ndarray:
    """A shingle set as it is compared."""
    return np.unique(shingles >> np.uint64(64 - COMPARED_BITS))


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits by which equal shingle sets are told."""
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def least_shingles(shingles: np.ndarray) -> list[int]:
    """The least shingle under each of six hashes; none of an empty set."""
    return [signed(int(_mixed(shingles, k).min())) ^ k for k in range(LEAST)] if len(shingles) else []


def long_fingerprint(shingles: np.ndarray) -> bytes:
    """256 bits over a shingle set, each 1 if set in over half of the hashes."""
    votes = np.zeros(BITS * LONG_WORDS, dtype=np.int64)
    for at in range(0, len(shingles), 16384):
        part = shingles[at : at + 16384]
        votes += np.concatenate([np.unpackbits(_mixed(part, k, _MIX_LONG).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for k in range(LONG_WORDS)])
    return np.packbits(votes * 2 > len(shingles)).tobytes()


def long_radius(similarity: float, deviations: float = 8) -> int:
    """Bits by which the long fingerprints of sets of this similarity differ, and so many standard deviations more."""
    bits = BITS * LONG_WORDS
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def first_shingles(shingles: np.ndarray, similarity: float) -> list[int]:
    """So many of the smallest shingles that two sets of this similarity share at least one of them."""
    return [signed(x) for x in shingles[: len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1].tolist()]


def as_similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two shingle sets have this Jaccard similarity or more; both empty: yes."""
    small, large = sorted((len(a), len(b)))
    if small < similarity * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (small + large - both)


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of positions whose sets have the similarity."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    group, found = np.arange(len(sets)), []

    def tie(i: int, j: int) -> None:
        if (x := group[i]) != (y := group[j]):
            group[group == max(x, y)] = min(x, y)
            found.append((order[i], order[j]))

    # Most copies are like one of the last texts that were like none before them.
    leaders: list[int] = []
    for i, x in enumerate(sets):
        for j in leaders[:-5:-1]:
            if as_similar(x, sets[j], similarity):
                tie(i, j)
                break
        else:
            leaders.append(i)
    if len(leaders) < 2:
        return found
    # What is left in several groups: shared shingles of a text with all others are counted at once.
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, starts, ends = owner[np.argsort(code, kind="stable")], np.cumsum(counts) - counts, np.cumsum(sizes)
    for i in range(1, len(sets)):
        first = int(np.searchsorted(sizes, similarity * sizes[i]))
        if (group[first:i] == group[i]).all():
            continue
        mine = code[ends[i] - sizes[i] : ends[i]]
        n = counts[mine]
        at = np.repeat(starts[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))[first:i]
        for j in np.flatnonzero(both >= similarity * (sizes[first:i] + sizes[i] - both)) + first:
            tie(i, int(j))
    return found


def checked_links(rows: DataFrame, sets: DataFrame, similarity: float, chunk: int = CHUNK, limit: int = CHECK_BYTES) -> DataFrame:
    """Edges (u, v) between nodes that share a key and whose shingle sets have the similarity: for each key a spanning forest. rows: node long, print binary,
    size (of the set), key long; sets: print, shingles. A key of over `chunk` rows or `limit` bytes of sets is dealt out as pairs of chunks."""
    bytes_ = F.col("size") * 5 + 64
    # No key is to be more than a small share of all the work, so that one group of copies in a small corpus doesn't wait for one task.
    whole = rows.agg(F.coalesce(F.sum(bytes_), F.lit(0)).alias("n")).first().n
    limit = min(limit, max(limit // 16, whole // SHARES))
    tasks = dealt(rows, limit, F.greatest(bytes_, F.lit(limit // chunk))).select("task", "node", "print")
    tasks = tasks.join(sets, "print").select("task", "node", "shingles").repartition("task").sortWithinPartitions("task", "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, held, edges = None, [], [], []

        def finish():
            for i, j in similar_links(held, similarity):
                edges.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))

        def out():
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for task, node, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if task != now:
                    finish()
                    now, nodes, held = task, [], []
                nodes.append(node)
                held.append(unpacked(shingles))
            if edges:
                yield out()
                edges = []
        finish()
        yield out()

    return tasks.mapInArrow(check, "u long, v long").filter("u > v").distinct()


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, exact: bool = False, chunk: int = CHUNK, limit: int = CHECK_BYTES) -> DataFrame:
    """id and component_id (the smallest id reachable over links) of every row with an id.

    Texts of equal shingle sets are one class. Classes come together if they share one of their least shingles under six hashes (those of Jaccard similarity s do but for
    (1 - s)^6 of them: 1 in 15,000 at 0.8), are tied if their fingerprints are within the radius there (bit planes, as for near_duplicates), and among those tied are links if their
    sets have the similarity. The radius is 8 standard deviations beyond what the similarity lets expect, as the fingerprints of small sets stray: sets of four and five shingles are 48
    bits apart on average and 84 are allowed, of 128 between strangers. With `exact` classes come together if they share one of the first fifth of their shingles in hash order, which
    those of the similarity always do, and no fingerprint is asked; that takes some 20 times as many keys. Texts without words are copies of one another.
    """
    slim = docs.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), text_bytes(text).alias("text"))

    def rows(part):
        sets = [shingle_set(t, words) for t in part["text"]]
        made = {"id": part["id"], "print": [set_digest(x) for x in sets], "size": [len(x) for x in sets], "least": [first_shingles(x, similarity) if exact else least_shingles(x) for x in sets]}
        yield made | {"fp": [None if exact else long_fingerprint(x) for x in sets]}

    def sets(part):
        made = [shingle_set(t, words) for t in part["text"]]
        yield {"print": [set_digest(x) for x in made], "shingles": [packed(compared(x)) for x in made]}

    prints = kept(map_rows(slim, rows, "id long, print binary, size long, least array<long>, fp binary", slices=200), "prints")
    classes = kept(prints.groupBy("print").agg(F.min("id").alias("node"), F.min("size").alias("size"), F.min("least").alias("least"), F.min("fp").alias("fp")), "classes")
    keyed = classes.select("node", "print", "size", "fp", F.explode(F.array_distinct("least")).alias("key"))
    # Keys of the same classes are one bucket.
    members = [F.bit_xor(F.xxhash64(F.lit(k), "print")).alias(f"m{k}") for k in range(2)]
    busy = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *members).filter("n > 1").groupBy("n", "m0", "m1").agg(F.min("key").alias("key"))
    held = kept(keyed.join(busy.select("key"), "key", "left_semi"), "held")
    if not exact:
        tied = components(linked(held.select("node", F.col("fp").alias("print"), "key"), long_radius(similarity), chunk), "u", "v")
        near = kept(held.join(tied, "node").select("node", "print", "size", F.xxhash64("key", "root").alias("key")), "near")
        held = near.join(near.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "key", "left_semi")
    texts = slim.join(held.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    # Written, so that the texts' shuffle can go before the sets are dealt out.
    shingles = kept(map_rows(texts, sets, "print binary, shingles binary", slices=200).groupBy("print").agg(F.first("shingles").alias("shingles")), "sets")
    edges = checked_links(held, shingles, similarity, chunk, limit)

    grouped = kept(components(edges, "u", "v").select("node", F.col("root").alias("component_id")), "components")
    whole = kept(classes.select("print", "node").join(grouped, "node", "left").select("print", F.coalesce("component_id", "node").alias("component_id")), "classes")
    return prints.join(whole, "print").select("id", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, **how) -> DataFrame:
    """docs with one document of each component, the one with the smallest id; rows with a null id stay, and rows of one id are one document (they stay or go
    together). Null and empty texts are copies of one another. All columns stay; an empty table stays empty. `how` goes to near_copies."""
    own = fresh(docs, "__id")
    stay = near_copies(docs, id, text, words, similarity, **how).filter("id = component_id").select(F.col("id").alias(own)).distinct()
    rows = docs.join(kept(stay, "stay").hint("merge"), F.col(id).cast("long") == F.col(own), "left_semi")
    return rows.unionByName(docs.filter(F.col(id).isNull()))
