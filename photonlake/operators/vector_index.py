"""An index of vectors for search by cosine: cells around centroids, and residuals in a byte a dimension.

Centroids, the residuals' scale and the number of cells to look into are fitted on a bounded sample; every vector has a row. A search for the nearest looks into the cells nearest to
the query, scores their rows by the small codes, and scores the best of those again by the vectors. Rows know how far their code is off, and cells how wide they are, so
the same search can be made exact: a first answer gives a score that is reached, and a second look leaves out only what can't reach it.

A search by threshold (the usual one) leaves out cells that are too far away to hold a row that reaches it, so it is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonlake.functions import vectors
from photonlake.operators import search, tables
from photonlake.plans.storage import kept

#: Rows of the sample that an index is fitted on, cells at most, and rounds of fitting.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1024, 8
#: Rows of one cell that a task scores for all queries that look into it; larger cells are dealt out by hash.
BLOCK_ROWS = 65_536
#: Queries that a task holds for a block of rows; if there are more, each such part of them gets the block.
BLOCK_QUERIES = 8_192
#: Scores that a task holds at once, and queries whose results it hands on at once.
STRIP_SCORES, OUT_QUERIES = 1 << 19, 1_024
#: Rows without a usable vector have no cell.
NO_CELL = -1
#: Scores are compared with this much to spare, for sums in another order.
SPARE = 1e-6
CODED = ("cell", "code", "off", "vector")


@dataclass(frozen=True)
class Cells:
    """What an index was fitted to: centroids (cells x dimensions), the residuals' scale by dimension, and the cells to look into for the recall that was asked for."""

    centroids: np.ndarray
    scale: np.ndarray
    probes: int

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _nearest_cells(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (m @ centroids.T).argmax(axis=1) if len(m) else np.zeros(0, dtype=np.int64)


def fit(rows: DataFrame, dim: int, id: str = "id", cells: int | None = None, sample: int = SAMPLE, recall: float = 0.95, k: int = 64) -> Cells:
    """Cells of rows (id, vector): spherical k-means over the `sample` rows whose ids have the smallest hashes (documented bound; all that comes to the driver), rows without a usable vector
    left out. probes: the fewest cells that hold a share `recall` of the k nearest of some of the sample's rows, in the middle of those rows. Without vectors there is one cell."""
    usable = rows.select(F.col(id).alias("id"), vectors.safe(F.col("vector"), dim).alias("v")).filter("v IS NOT NULL")
    taken = usable.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    m = np.array([r.v for r in taken], dtype=np.float64).reshape(-1, dim)
    m = _unit(m[np.isfinite(m).all(axis=1) & (np.abs(m).max(axis=1, initial=0) > 0)])
    if not len(m):
        return Cells(np.eye(1, dim), np.ones(dim), 1)
    n = cells or max(1, min(MOST_CELLS, int(len(m) ** 0.5)))
    random = np.random.default_rng(0)
    centroids = m[random.permutation(len(m))[:n]].copy()
    for _ in range(ROUNDS):
        own = _nearest_cells(m, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, m)
        held = np.linalg.norm(sums, axis=1) > 0
        centroids[held] = _unit(sums[held])
    own = _nearest_cells(m, centroids)
    scale = np.maximum(np.abs(m - centroids[own]).max(axis=0), 1e-9) / 127.0
    asked = m[random.permutation(len(m))[:256]]
    near = np.argsort(-(asked @ m.T), axis=1)[:, :k]
    places = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(places, own[near], axis=1) + 1, axis=1)
    probes = int(np.ceil(needed[:, int(np.ceil(recall * near.shape[1])) - 1].mean()))
    return Cells(centroids, scale, max(1, min(n, probes)))


def coded(rows: DataFrame, cells: Cells) -> DataFrame:
    """rows with cell, code (a byte a dimension), off (how far the code is from the vector at length 1, rounded up) and the vector; a row for each row. Vectors that are null or zero, hold a null or
    non-finite element, or are of another size have no cell, and null for the rest but the vector."""
    names = [c for c in rows.columns if c not in CODED]
    centroids, scale, dim = cells.centroids, cells.scale, cells.dim
    read = rows.select(*names, F.col("vector").cast("array<float>").alias("vector"), F.transform(vectors.safe(F.col("vector"), dim), lambda x: x.cast("double")).alias("__v"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names) + 1)
            fits = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            m = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(m).all(axis=1) & (np.abs(m).max(axis=1, initial=0) > 0)
            fits, m = fits[good], _unit(m[good])
            own = _nearest_cells(m, centroids)
            q = np.clip(np.rint((m - centroids[own]) / scale), -128, 127).astype(np.int8)
            off = np.linalg.norm(m - (centroids[own] + q * scale), axis=1) * (1 + 1e-6) + 1e-9
            cell, code, far = np.full(batch.num_rows, NO_CELL, dtype=np.int32), [None] * batch.num_rows, np.full(batch.num_rows, np.nan)
            cell[fits], far[fits] = own, off
            for at, x in zip(fits.tolist(), q):
                code[at] = x.tobytes()
            columns = [*(batch.column(i) for i in range(len(names))), pa.array(cell), pa.array(code, pa.binary()), pa.array(far, mask=np.isnan(far)), batch.column(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *CODED])

    schema = read.select(*names).schema.add("cell", "integer").add("code", "binary").add("off", "double").add(read.schema["vector"])
    return read.mapInArrow(encode, schema)


def build(rows: DataFrame, path: str, dim: int, id: str = "id", **how) -> Cells:
    """Fit an index of rows (id, file_name, timestamp_sec, vector, ...) and write it: path/rows, a folder for each cell, and path/cells. Rows of a cell are dealt out by hash over a few
    tasks, so one large cell isn't one task's."""
    cells = fit(rows, dim, id, **how)
    _write(coded(rows, cells), cells, path, id)
    return cells


def _write(index: DataFrame, cells: Cells, path: str, id: str) -> None:
    spark = index.sparkSession
    index.repartition("cell", F.pmod(F.xxhash64(id), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/rows")
    fitted = spark.createDataFrame([(c, row.tolist(), cells.scale.tolist(), cells.probes) for c, row in enumerate(cells.centroids)], "cell int, centroid array<double>, scale array<double>, probes int")
    # How wide a cell is: the least cosine between its centroid and any of its rows, by the rows as written.
    index.limit(0).coalesce(1).write.parquet(f"{path}/schema")
    held = spark.read.schema(index.schema).parquet(f"{path}/rows").filter(F.col("cell") != NO_CELL)
    widths = held.join(F.broadcast(fitted.select("cell", "centroid")), "cell").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(vectors.cosine(F.col("vector"), F.col("centroid"))).alias("least"))
    fitted.join(widths, "cell", "left").coalesce(1).write.parquet(f"{path}/cells")


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, Cells, dict[int, float]]:
    """An index as written: its rows, what it was fitted to, and the least cosine of each cell that has rows. Cells are MOST_CELLS at most."""
    found = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)
    cells = Cells(np.array([r.centroid for r in found]), np.array(found[0].scale), found[0].probes)
    schema = spark.read.parquet(f"{path}/schema").schema  # an index without rows has no files that tell it
    return spark.read.schema(schema).parquet(f"{path}/rows"), cells, {r.cell: r.least for r in found if r.least is not None}


def refreshed(spark: SparkSession, path: str, rebuilt: DataFrame, changed: DataFrame, to: str, id: str = "id") -> None:
    """The index after a run, written to another place: rows of changed files (file_name) are those rebuilt, the others stay; all under the centroids of before."""
    index, cells, _ = opened(spark, path)
    _write(tables.synced(index, coded(rebuilt, cells), changed), cells, to, id)


def layout(spark: SparkSession, path: str, name: str) -> DataFrame:
    """What an index is made by, as a row for tables.tables_sorted and index_faults: the columns of its rows and their types, then its cells and dimensions."""
    index, cells, _ = opened(spark, path)
    rows = [(name, n, f.name, f.dataType.simpleString()) for n, f in enumerate(sorted(index.schema.fields, key=lambda f: f.name))]
    return spark.createDataFrame([*rows, (name, len(rows), "cells", f"{len(cells.centroids)} x {cells.dim}")], "name string, place int, column string, type string")


def _reaching(queries: np.ndarray, centroids: np.ndarray, least: dict[int, float], score: float) -> list[int]:
    """Cells that may hold a row with at least that cosine to one of the queries (at length 1): a row is no further from its centroid than the cell is wide."""
    angles = np.arccos(np.clip(queries @ centroids.T, -1.0, 1.0)).min(axis=0)
    width = {c: np.arccos(np.clip(x, -1.0, 1.0)) for c, x in least.items()}
    return [c for c, w in width.items() if np.cos(max(0.0, angles[c] - w)) >= score - SPARE]


def search_index(spark: SparkSession, path: str, queries: list[list[float]], min_score: float = 0.0, digits: int = 5) -> DataFrame:
    """Files whose best frame reaches the threshold by cosine for any of the queries: the same rows as search.search_any over all frames, from the cells that can hold them. Rows
    without a usable vector score 0, as a null distance does. Without queries nothing is found. A query of another size is an error."""
    index, cells, least = opened(spark, path)
    if any(len(q) != cells.dim for q in queries):
        raise ValueError(f"the index has {cells.dim} dimensions, a query {[len(q) for q in queries if len(q) != cells.dim][0]}")
    asked = _unit(np.array(queries, dtype=np.float64).reshape(-1, cells.dim))
    wanted = _reaching(asked, cells.centroids, least, min_score - 10.0**-digits) if queries else []
    near = index.filter(F.col("cell").isin(wanted + ([NO_CELL] if queries and min_score <= 0 else [])))
    score = F.when(F.col("cell") == NO_CELL, F.lit(0.0)).otherwise(vectors.best_score(F.col("vector"), queries or [[0.0] * cells.dim], "cosine"))
    rows = near.select("file_name", "is_video", F.coalesce("timestamp_sec", F.lit(0.0)).alias("timestamp_sec"), F.round(score, digits).alias("score"))
    return search.ranked(search.best_per_file(rows.filter("file_name IS NOT NULL"), min_score))


def search_or_scan(spark: SparkSession, path: str | None, frames: DataFrame, query: list[float], min_score: float = 0.0, video_only: bool = False, folder: str = "") -> DataFrame:
    """search_index where an index is there and can answer; else the scan of all frames. An index can't tell videos or folders, nor answer a query of another size."""
    if path is not None and not video_only and not folder.strip():
        try:
            return search_index(spark, path, [query], min_score)
        except ValueError:
            pass
    return search.search(frames, query, min_score, video_only, folder)


def _scored(batches: Iterator[pa.RecordBatch], cells: Cells, k: int | None) -> Iterator[pa.RecordBatch]:
    """(query, id, approx) of rows (cell, block, part, kind, query, v, reach, id, code, off) in that order: the queries (kind 0) of each part of a block come before its codes (kind 1). What is held doesn't
    grow with the rows: strips of scores, and for each query of a part its k best."""
    now, ids, parts, reach = None, [], [], []
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def out(q: np.ndarray, i: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i), pa.array(s)], names=["query", "id", "approx"])

    def bests() -> Iterator[pa.RecordBatch]:
        found = list(best.items())
        for at in range(0, len(found), OUT_QUERIES):
            some = found[at : at + OUT_QUERIES]
            yield out(np.repeat([q for q, _ in some], [len(i) for _, (i, _) in some]), np.concatenate([i for _, (i, _) in some]), np.concatenate([s for _, (_, s) in some]))

    for batch in batches:
        keys, kind = np.stack([batch.column(n).to_numpy() for n in range(3)], axis=1), batch.column(3).to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1) | (kind[1:] != kind[:-1])))) if len(kind) else []
        for a, b in zip(cuts, [*cuts[1:], len(kind)]):
            key = tuple(keys[a].tolist())
            if key != now:
                yield from bests()
                now, ids, parts, reach, best = key, [], [], [], {}
            if kind[a] == 0:
                ids.append(batch.column(4).slice(a, b - a).to_numpy())
                parts.append(batch.column(5).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1))
                reach.append(batch.column(6).slice(a, b - a).to_numpy())
                continue
            if not ids:
                continue
            ids, parts, reach = [np.concatenate(ids)], [np.concatenate(parts)], [np.concatenate(reach)]
            own = batch.column(7).slice(a, b - a).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(8).slice(a, b - a).to_pylist()), dtype=np.int8).reshape(b - a, -1)
            off = batch.column(9).slice(a, b - a).to_numpy()
            rows = (cells.centroids[key[0]] + codes * cells.scale).T
            step = max(1, STRIP_SCORES // int(b - a))
            for at in range(0, len(ids[0]), step):
                asked, scores = ids[0][at : at + step], parts[0][at : at + step] @ rows
                if k is None:
                    q, i = np.nonzero(scores + off >= reach[0][at : at + step, None] - SPARE)
                    if len(q):
                        yield out(asked[q], own[i], scores[q, i])
                    continue
                for r, q in enumerate(asked.tolist()):
                    top = np.argpartition(-scores[r], k - 1)[:k] if b - a > k else np.arange(b - a)
                    i, s = own[top], scores[r, top]
                    if q in best:
                        i, s = np.concatenate((best[q][0], i)), np.concatenate((best[q][1], s))
                        top = np.lexsort((i, -s))[:k]
                        i, s = i[top], s[top]
                    best[q] = i, s
    yield from bests()


def _looked(queries: DataFrame, index: DataFrame, cells: Cells, k: int | None, n: int) -> DataFrame:
    """(query, id, approx) of the rows in the cells that queries look into. queries: query, v (at length 1), cell, reach; n: how many queries there are. By k: the best of each block of rows; without,
    those that may reach `reach`.

    A task gets a block of a cell's codes after a part of the queries that look into it, and works through them batch by batch."""
    sizes = kept(index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")), "cells")  # a row for each cell
    parts = max(1, -(-n // BLOCK_QUERIES))
    asked = queries.join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "query", "v", "reach", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("off"))
    rows = index.select("cell", "id", "code", "off").join(F.broadcast(sizes), "cell")
    held = rows.select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("query"), F.lit(None).cast("array<double>").alias("v"), F.lit(0.0).alias("reach"), "id", "code", "off")
    dealt = asked.unionByName(held).repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part", "kind")
    return dealt.mapInArrow(lambda batches: _scored(batches, cells, k), "query long, id long, approx double")


def _rescored(shortlist: DataFrame, queries: DataFrame, index: DataFrame, k: int, digits: int) -> DataFrame:
    """The k best of each query of (query, id) by the vectors themselves, ties to the smaller id."""
    full = shortlist.select("query", "id").join(index.select("id", "vector"), "id").join(queries.select("query", "vector").withColumnRenamed("vector", "__q"), "query")
    scored = full.select("query", "id", F.round(vectors.cosine(F.col("vector"), F.col("__q")), digits).alias("score"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)


def nearest(index: DataFrame, cells: Cells, least: dict[int, float], queries: DataFrame, k: int = 64, probes: int | None = None, exact: bool = False, digits: int = 5, more: int = 4) -> DataFrame:
    """query, id, score and n (from 1) of the k rows nearest to each query by cosine to `digits` places, ties to the smaller id. index: id (a long, one row each); queries: query (a long), vector.

    From the `probes` nearest cells (as fitted, if not given), more * k rows of each query by their codes are scored again by their vectors. exact: the k-th of those scores is reached, so a
    second look takes all rows that may reach it, from all cells that may hold such; then only rows without a usable vector are left out. Queries without a usable vector have no rows.
    """
    dim, centroids, probes = cells.dim, cells.centroids, min(probes or cells.probes, len(cells.centroids))
    usable = queries.select("query", F.transform(vectors.safe(F.col("vector"), dim), lambda x: x.cast("double")).alias("vector")).filter("vector IS NOT NULL")
    asked = kept(usable.filter(vectors.norm(F.col("vector")) > 0).withColumn("v", vectors.unit(F.col("vector"))), "queries")
    there, n = index.filter(F.col("cell") != NO_CELL), asked.count()  # from the files' footers
    held = np.array(sorted(least), dtype=np.int64)

    def looks(rows: DataFrame, reach: bool) -> DataFrame:
        """A row for each query and cell that it looks into."""
        widths = np.arccos(np.clip([least[c] for c in held], -1.0, 1.0))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                near = m @ centroids[held].T
                floor = batch.column(2).to_numpy(zero_copy_only=False)
                if reach:
                    may = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1.0, 1.0)) - widths)) >= floor[:, None] - SPARE
                    chosen = [held[x].tolist() for x in may]
                else:
                    chosen = held[np.argsort(-near, axis=1, kind="stable")[:, :probes]].tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.list_(pa.int32()))], names=["query", "v", "reach", "cells"])

        return rows.mapInArrow(choose, "query long, v array<double>, reach double, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")

    first = _looked(looks(asked.select("query", "v", F.lit(-2.0).alias("reach")), False), there, cells, more * k, n)
    top = Window.partitionBy("query").orderBy(F.col("approx").desc(), "id")
    found = _rescored(first.withColumn("__n", F.row_number().over(top)).filter(F.col("__n") <= more * k), asked, there, k, digits)
    if not exact:
        return found
    # A score is rounded, so one that looks as good may be half a unit lower.
    reached = kept(found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).select("query", F.when(F.col("n") >= k, F.col("s") - 10.0**-digits).otherwise(F.lit(-2.0)).alias("reach")), "reached")
    again = looks(asked.join(reached, "query", "left").select("query", "v", F.coalesce("reach", F.lit(-2.0)).alias("reach")), True)
    return _rescored(_looked(again, there, cells, None, n), asked, there, k, digits)
