"""Clusters around centroids by sort-means, in whole numbers.

In each round the other centroids are sorted by their distance from each centroid. A vector looks at them in that order from the centroid that it had
before, and stops at the first one that is further from that centroid than twice the vector is: none beyond can be nearer, nor as near.

Vectors lie in blocks (a row for each, in the narrowest type) of a table that is bucketed by block. A round reads it once beside the table of the round before,
bucketed alike, so that the two meet without a shuffle, and writes a byte or so for each vector and one set of sums for each block. Only those sums are
shuffled; what comes back to the driver and goes out to the tasks is one number for each centroid and dimension.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.common import shared_dir, small_batches

#: Vectors of a block.
BLOCK_ROWS = 4096
#: Up to this size of components, four times a squared distance is a 64-bit integer for up to 2^7 dimensions; others are computed in Python's integers.
PLAIN = 1 << 25
LONG = 1 << 63


def _fine(vector: str, dims: int) -> Column:
    """Vectors of that many components, none null or non-finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) == dims) & finite


def _narrow(m: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers held as doubles, in the narrowest type that holds them all; the largest stay doubles, which hold them exactly."""
    most = np.abs(m).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, m.astype(kind).tobytes()


def _wide(data: bytes, kind: str, dims: int) -> np.ndarray:
    """A block as 64-bit or, where those might overflow, as Python's integers; a row for each vector."""
    m = np.frombuffer(data, dtype=kind).reshape(-1, dims)
    if kind == "<i2" or np.abs(m.astype(np.float64)).max(initial=0) <= PLAIN:
        return m.astype(np.int64)
    return np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)


def _squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    off = x - centroid
    return (off * off).sum(axis=1) if off.dtype == object else np.einsum("ij,ij->i", off, off)


class Centroids:
    """Centroids of one round with the others in order around each."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        plain = max((abs(x) for row in rows for x in row), default=0) <= PLAIN and len(rows[0]) <= 128
        self.at = np.array(rows, dtype=np.int64 if plain else object).reshape(len(rows), -1)
        self.apart = [_squared(self.at, c) for c in self.at]
        self.order = [sorted((j for j in range(len(rows)) if j != c), key=lambda j, c=c: (self.apart[c][j], j)) for c in range(len(rows))]

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector (the smaller number of equally near ones), its squared distance, and how many distances were computed; before: the vectors' centroids so far."""
        cluster, distance, seen = before.astype(np.int64), np.zeros(len(x), dtype=object if x.dtype == object or self.at.dtype == object else np.int64), 0
        for c in np.unique(before):
            rows = np.flatnonzero(before == c)
            own = _squared(x[rows], self.at[c])
            best, found, live = own.copy(), np.full(len(rows), c, dtype=np.int64), np.arange(len(rows))
            seen += len(rows)
            for j in self.order[c]:
                live = live[(4 * own[live] >= self.apart[c][j]).astype(bool)]
                if not len(live):
                    break
                to = _squared(x[rows[live]], self.at[j])
                seen += len(live)
                better = (to < best[live]) | ((to == best[live]) & (j < found[live]))
                at = live[better.astype(bool)]
                best[at], found[at] = to[better.astype(bool)], j
            cluster[rows], distance[rows] = found, best
        return cluster, distance, seen


class _Tables:
    """Tables of one run, bucketed by block. They leave the catalog as soon as they are read: their files in the shared folder are all that a plan needs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.run = spark, uuid.uuid4().hex
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        table = f"photonlake_{name}_{self.run}"
        df.write.bucketBy(self.buckets, "block").option("path", f"{shared_dir(self.spark)}/sort-means-{self.run}/{name}").saveAsTable(table)
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return out


def _blocks(vectors: DataFrame, id: str, vector: str, dims: int, factor: int) -> DataFrame:
    """block, ids (64-bit, with a byte for each that says whether it is null), kind and data of the vectors' scaled components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, ids, nulls = TaskContext.get().partitionId(), 0, [], [], []

        def block(n: int) -> pa.RecordBatch:
            nonlocal held, ids, nulls, seq
            m, i, z = np.concatenate(held), np.concatenate(ids), np.concatenate(nulls)
            kind, data = _narrow(m[:n])
            held, ids, nulls, seq, at = [m[n:]], [i[n:]], [z[n:]], seq + 1, (part << 32) + seq
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([i[:n].astype("<i8").tobytes()], pa.binary()), pa.array([z[:n].tobytes()], pa.binary()), pa.array([kind]), pa.array([data], pa.binary())], names=["block", "ids", "nulls", "kind", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            with np.errstate(over="ignore"):
                m = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims) * factor)
            if not np.isfinite(m).all():
                raise OverflowError(f"a component times {factor} is no double")
            held.append(m)
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
            while sum(map(len, ids)) >= BLOCK_ROWS:
                yield block(BLOCK_ROWS)
        if sum(map(len, ids)):
            yield block(BLOCK_ROWS)

    return vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(pack, "block long, ids binary, nulls binary, kind string, data binary")


def _round(blocks: DataFrame, before: DataFrame | None, centroids: Centroids, dims: int, last: bool) -> DataFrame:
    """block, clusters, distances (in the last round) and sums: in other rounds, for each centroid, how many vectors it has and their sums by dimension; in the last one, the sum of their distances."""
    k = len(centroids.rows)
    byte = "<u1" if k <= 1 << 8 else "<u2" if k <= 1 << 16 else "<u4"
    read = blocks.select("block", "kind", "data")
    if before is not None:
        read = read.join(before.select("block", "clusters").hint("shuffle_hash"), "block")
    else:
        read = read.withColumn("clusters", F.lit(None).cast("binary"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _wide(row["data"], row["kind"], dims)
                was = np.zeros(len(x), dtype=byte) if row["clusters"] is None else np.frombuffer(row["clusters"], dtype=byte)
                cluster, distance, _ = centroids.nearest(x, was)
                sums: list[int] = []
                for c in range(k):
                    rows = np.flatnonzero(cluster == c)
                    sums += [int(sum(distance[rows].tolist()))] if last else [len(rows), *(x[rows].sum(axis=0).tolist() if len(rows) else [0] * dims)]
                if last and any(d >= LONG for d in distance.tolist()):
                    raise OverflowError("a squared distance is no long")
                far = [distance.astype("<i8").tobytes() if last else None]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([cluster.astype(byte).tobytes()], pa.binary()), pa.array(far, pa.binary()), pa.array([[Decimal(s) for s in sums]], pa.list_(pa.decimal128(38, 0)))], names=["block", "clusters", "distances", "sums"])

    return read.mapInArrow(assign, "block long, clusters binary, distances binary, sums array<decimal(38,0)>")


def _totals(assigned: DataFrame, n: int) -> list[int]:
    """The blocks' sums added up, place by place."""
    out = [0] * n
    for row in assigned.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[row.at] = int(row.s)
    return out


def sort_means(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, factor: int = 1024, salt: str = "3:", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of `dims` components, none of them null or non-finite; others are left out.

    Components become floor(factor * x). The first centroids are the k vectors with the smallest SHA-256 of salt and id (null ids after all others; of equal ids the smaller vector first); fewer
    vectors give fewer centroids, and none an empty table. After each of `rounds` assignments a centroid with vectors becomes the floor of their mean, one without stays. Equal distances go to
    the smaller number. Repeated rows count and are returned each, null ids too; other columns aren't read. A distance or inertia that is no long is an error.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    fine = vectors.filter(_fine(vector, dims))
    doubles = F.transform(vector, lambda v: v.cast("double"))
    first = fine.select(F.sha2(F.concat(F.lit(salt), F.col(id).cast("string")), 256).alias("h"), doubles.alias("v")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    schema = f"{id} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = Centroids([[int(np.floor(x * factor)) for x in row.v] for row in first])
    k, tables, before = len(first), _Tables(spark), None
    blocks = tables.kept(_blocks(fine, id, vector, dims, factor).repartition(tables.buckets, "block"), "blocks")
    for r in range(rounds):
        before = tables.kept(_round(blocks, before, centroids, dims, False), f"round_{r}")
        sums = _totals(before, k * (dims + 1))
        groups = [sums[c * (dims + 1) : (c + 1) * (dims + 1)] for c in range(k)]
        centroids = Centroids([[s // n for s in total] if n else old for (n, *total), old in zip(groups, centroids.rows)])
    final = tables.kept(_round(blocks, before, centroids, dims, True), "final")
    inertia = _totals(final, k)
    if sum(inertia) >= LONG:
        raise OverflowError("the inertia is no long")
    named = spark.createDataFrame([(c, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.rows)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    byte = "<u1" if k <= 1 << 8 else "<u2" if k <= 1 << 16 else "<u4"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, nulls = np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["nulls"], dtype=np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=nulls), pa.array(np.frombuffer(row["clusters"], dtype=byte).astype(np.int32)), pa.array(np.frombuffer(row["distances"], dtype="<i8").astype(np.int64))], names=[id, "cluster", "distance"])

    rows = blocks.select("block", "ids", "nulls").join(final.select("block", "clusters", "distances").hint("shuffle_hash"), "block").mapInArrow(unpack, f"{id} long, cluster int, distance long")
    return rows.join(F.broadcast(named), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each of k centroids


def _oracle(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The contract's rows in DuckDB SQL, round by round."""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS j, e FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v ORDER BY h NULLS LAST, e LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT v.r, min({{'d': CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'j': c.j}}) AS m FROM v CROSS JOIN c{r} c GROUP BY v.r)")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT a.m.j AS j, i, sum(v.e[i]) AS s, count(*) AS n FROM a{r} a JOIN v ON a.r = v.r CROSS JOIN range(1, {dims + 1}) t(i) GROUP BY ALL
), n{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{r} GROUP BY j
), c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.e, c.e) AS e FROM c{r} c LEFT JOIN n{r} n ON c.j = n.j)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT v.vec_id, CAST(a.m.j AS INTEGER) AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON a.r = v.r JOIN c{rounds} c ON c.j = a.m.j"""


ORACLE = _oracle()
