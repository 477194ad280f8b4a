"""Exact top-k search by inner product over integer vectors: columnar branch and bound.

Candidates lie in vertical layout (dimension by dimension). Scores grow one block of dimensions at a time;
what the dimensions still to come can add is bounded by the product of the remaining norms, and only pairs
that can still reach their query's k-th best score are kept on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonlake.llm.common import kept

#: Queries that one task holds, candidates that it compares with them at a time, and dimensions per step.
QUERY_BLOCK, CANDIDATE_BLOCK, DIM_BLOCK = 16384, 2048, 16
#: Rows that one task gets of the candidates, and groups of tasks at most for a block of queries.
GROUP_ROWS, MOST_GROUPS = 8192, 4096
#: Scaled components are longs, from -LIMIT to below LIMIT.
LIMIT = float(1 << 63)
#: Products of norms below this have all their sums exact in double precision.
EXACT = float(1 << 53)


def scaled(vector: str, factor: int = 256) -> Column:
    """floor(factor * x) of each component, or null for a vector that is null, holds null or non-finite components or ones that no long can hold."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * factor))
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (v.cast("double") * factor >= -LIMIT) & (v.cast("double") * factor < LIMIT))
    return F.when(F.col(vector).isNotNull() & fine, x.cast("array<long>"))


class _Best:
    """The k best (score, id) of each query: higher scores first, then smaller ids. whole has the scores as longs, score rounded ones (-inf where there is none)."""

    def __init__(self, n: int, k: int, seeds: np.ndarray | None = None):
        """seeds: for each query a score that k candidates somewhere are known to reach (-inf: none)."""
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.seeds = np.full(n, -np.inf) if seeds is None else seeds
        self.whole = np.full((n, k), np.iinfo(np.int64).min)

    def floor(self, rows: slice) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.seeds[rows])

    def add(self, at: int, whole: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.score[at], whole.astype(np.float64))), np.concatenate((self.id[at], ids))
        w = np.concatenate((self.whole[at], whole))
        top = np.lexsort((i, np.isinf(s), ~w))[: self.k]
        self.score[at], self.id[at], self.whole[at] = s[top], i[top], w[top]


def _tails(m: np.ndarray) -> np.ndarray:
    """Norm of the dimensions from each block border on, by border and row."""
    m = m.astype(np.float64, copy=False)
    squares = np.array([(m[i : i + DIM_BLOCK] ** 2).sum(axis=0) for i in range(0, len(m), DIM_BLOCK)] + [np.zeros(m.shape[1])])
    return np.sqrt(squares[::-1].cumsum(axis=0)[::-1])


def _whole(query: np.ndarray, vectors: np.ndarray, scores: np.ndarray, error: np.ndarray | float) -> np.ndarray:
    """Exact scores of one query as longs, given rounded ones. Sums of longs wrap around, so they are right where the true score is a long."""
    if not np.any(error):
        return scores.astype(np.int64)
    whole = query.astype(np.int64) @ vectors.astype(np.int64)
    for c in np.flatnonzero(np.abs(scores) + error >= LIMIT):
        true = sum(int(x) * int(y) for x, y in zip(query, vectors[:, c]))
        if not -(1 << 63) <= true < 1 << 63:
            raise OverflowError(f"a score of the {len(query)}-dimensional search is no long: {true}")
    return whole


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: _Best) -> int:
    """Bring best up to date with a block of candidates (both matrices dimension by row). Returns the pairs whose scores were finished."""
    steps = range(0, len(vectors), DIM_BLOCK)
    q_tail, c_tail = _tails(queries), _tails(vectors)
    rounded = vectors.astype(np.float64, copy=False)
    finished = 0
    for at in range(0, len(query_ids), 256):
        rows = slice(at, min(at + 256, len(query_ids)))
        need = best.floor(rows)
        live = np.arange(len(ids))
        scores = np.zeros((rows.stop - rows.start, len(ids)))
        asked = queries[:, rows].astype(np.float64, copy=False)
        # Doubles are exact up to EXACT; beyond, scores are off by at most `error`, and so is a rounded k-th best one.
        error: np.ndarray | float = 0.0
        if q_tail[0, rows].max() * c_tail[0].max() * (1 + 1e-9) >= EXACT:
            error = q_tail[0, rows][:, None] * c_tail[0]
            error = np.where(error * (1 + 1e-9) < EXACT, 0.0, error * (len(vectors) + 8) * 2.0**-51)
            need = np.where(np.abs(need) < EXACT, need, need - np.abs(need) * 2.0**-51)
        for b, d in enumerate(steps):
            scores += asked[d : d + DIM_BLOCK].T @ rounded[d : d + DIM_BLOCK][:, live]
            reach = scores + error + q_tail[b + 1, rows][:, None] * c_tail[b + 1][live] * (1 + 1e-9)
            can = reach >= need[:, None]
            stay = can.any(axis=0)
            if not stay.all():
                live, scores, can = live[stay], scores[:, stay], can[:, stay]
                error = error[:, stay] if np.ndim(error) else error
            if not len(live):
                break
        if not len(live):
            continue
        can &= query_ids[rows][:, None] != ids[live]
        finished += int(can.sum())
        for r in np.flatnonzero(can.any(axis=1)):
            c = np.flatnonzero(can[r])
            off = error[r] if np.ndim(error) else np.zeros(len(live))
            if len(c) > best.k:
                edge = np.partition(scores[r, c] - off[c], len(c) - best.k)[len(c) - best.k]
                c = c[scores[r, c] + off[c] >= edge]
            best.add(at + r, _whole(queries[:, at + r], vectors[:, live[c]], scores[r, c], off[c]), ids[live[c]])
    return finished


def _matrix(column: pa.ListArray, rows: np.ndarray, dims: int) -> np.ndarray:
    """The rows of a list column as dims x rows; shorter vectors are filled up with 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy()
    if (lengths == dims).all():
        return values.reshape(-1, dims)[rows].T.astype(np.int64)
    out, ends = np.zeros((dims, len(rows)), dtype=np.int64), np.cumsum(lengths)
    for j, r in enumerate(rows):
        n = min(lengths[r], dims)
        out[:n, j] = values[ends[r] - lengths[r] : ends[r] - lengths[r] + n]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", factor: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows, exactly; ties go to the smaller id.

    queries and vectors are tables with the same two columns. Rows with the query's own id are no candidates. Vectors that are null or
    hold null or non-finite components (or scaled ones that no long can hold) take no part, nor do null ids. A best score that is no long is an error. Of vectors of different
    lengths the shorter is filled up with 0. Of query rows with one id the smallest vector counts; repeated candidates count each.
    """
    base = vectors.select(F.col(id).cast("long").alias("id"), scaled(vector, factor).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col(id).cast("long").alias("id"), scaled(vector, factor).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    asked = kept(asked.groupBy("id").agg(F.min("v").alias("v")), "queries")
    sizes = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    n = base.count()
    blocks = max(1, -(-sizes.n // QUERY_BLOCK))
    groups = max(1, min(MOST_GROUPS, -(-n // GROUP_ROWS)))
    group = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(groups)).cast("int")
    grouped = base.withColumn("group", group)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranks = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    seeded = asked.withColumn("seed", F.lit(None).cast("double"))
    if groups > 1:
        # The first group alone gives each query a score that k candidates reach, so that in all other groups most candidates end in their first dimensions.
        first = _searched(seeded, grouped.filter("group = 0"), blocks, 1, sizes.d, k)
        # A double may be rounded up from a long: one step down is never too high.
        floor = ranks(first).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k)
        floor = floor.select(F.col("query_id").alias("id"), (F.col("s").cast("double") - F.abs(F.col("s").cast("double")) * 2.0**-52).alias("seed"))
        seeded = asked.join(kept(floor, "seeds"), "id", "left")
    return ranks(_searched(seeded, grouped, blocks, groups, sizes.d, k)).select("query_id", "rank", "vec_id", "score")


def _searched(asked: DataFrame, grouped: DataFrame, blocks: int, groups: int, dims: int, k: int) -> DataFrame:
    """query_id, vec_id and score of the k best of each group of candidates (id, v, group) for each query (id, v, seed); with a seed, only those that reach it."""
    # Each task (block of queries, group of candidates) gets its queries first and then its candidates, which it reads as a stream.
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = asked.select(F.lit(0).alias("kind"), "id", "v", "seed", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    right = grouped.select(F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("double").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "group")
    tasks = left.unionByName(right).withColumn("task", F.col("block").cast("long") * groups + F.col("group"))
    dealt = tasks.select("task", "kind", "id", "v", "seed").repartition(min(blocks * groups, 20_000), "task").sortWithinPartitions("task", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, seeds, best, queries_ = None, [], [], [], None, None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal held
            if held and best is not None:
                m, i = np.concatenate([x for x, _ in held], axis=1), np.concatenate([x for _, x in held])
                for at in range(0, len(i), CANDIDATE_BLOCK):
                    search_block(queries_, ids, m[order, at : at + CANDIDATE_BLOCK], i[at : at + CANDIDATE_BLOCK], best)
            held = []

        def result():
            if best is None:
                return None
            q, r = np.nonzero(best.score > -np.inf)
            return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best.id[q, r]), pa.array(best.whole[q, r])], names=["query_id", "vec_id", "score"])

        order = np.arange(dims)
        for batch in batches:
            task, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (task[1:] != task[:-1]) | (kind[1:] != kind[:-1])))) if len(task) else []
            for a, b in zip(cuts, [*cuts[1:], len(task)]):
                if task[a] != now:
                    flush()
                    if (out := result()) is not None:
                        yield out
                    now, ids, parts, seeds, best, queries_ = task[a], np.array([], dtype=np.int64), [], [], None, None
                rows = np.arange(a, b)
                found, own = _matrix(batch.column(3), rows, dims), batch.column(2).to_numpy()[a:b]
                if kind[a] == 0:
                    parts.append(found)
                    seeds.append(batch.column(4).slice(a, b - a).fill_null(-np.inf).to_numpy(zero_copy_only=False))
                    ids = np.concatenate((ids, own))
                    continue
                if best is None and parts:
                    queries_ = np.concatenate(parts, axis=1)
                    order = np.argsort(-(queries_.astype(np.float64) ** 2).sum(axis=1), kind="stable")  # heavy dimensions first: bounds tighten sooner
                    queries_, best = np.ascontiguousarray(queries_[order]), _Best(len(ids), k, np.concatenate(seeds))
                held.append((found, own))
                if sum(len(i) for _, i in held) >= CANDIDATE_BLOCK:
                    flush()
        flush()
        if (out := result()) is not None:
            yield out

    return dealt.mapInArrow(search, "query_id long, vec_id long, score long")


def every_fiftieth(embeddings: DataFrame) -> DataFrame:
    """The contract's search: queries are the rows whose vec_id is divisible by 50, candidates are all rows."""
    return top_k(embeddings, embeddings.filter(F.col("vec_id") % 50 == 0))


#: The contract's rows in DuckDB SQL.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
