"""LM scoring by a weighted backoff automaton of words, pairs and triples.

Documents are read in blocks of a few megabytes. Each block counts its own distinct n-grams once and asks for their
counts in the corpus: the asks are cut into ranges of n-gram hashes, summed range by range, and the sums come back to the
blocks that asked. The model grows with the corpus and is never gathered in one place. With many blocks, asks are merged
group by group before they are cut further (`resolved`), so that the rows exchanged stay in proportion to the text.

A block then builds the part of the automaton that its texts can reach. A known pair or word is a state (and so are the
text's start and the root); a known n-gram is an arc out of the state of its first words into the state of its last two;
each state has a failure arc to the state without its first word. One pass over each text, from left to right, carries
the state along, follows failure arcs until the next word has an arc, and adds up the weights.

p(w) = (c(w) - D) / N for known words and D * V / N for the unknown word, with D = n1 / (n1 + 2 n2).
p(w | h) = (c(h, w) + mu * p(w | h without its first word)) / (c(h) + mu), with a mu for each length of h; the failure arc
of h has weight mu / (c(h) + mu).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import ascii_lower_words, from_planes, kept, kept_alone, packed, planes, remainder, small_batches, text_bytes, unpacked

#: Bytes of text in a block (one longer text is a block of its own), and bytes of text for each range of n-grams.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 4 << 20
#: Ranges that one ask is cut into at most, and asks that are summed at once.
FAN = 4096
#: Tasks of a step at most: each gets a few ranges or blocks, whatever the session's number of shuffle partitions.
MOST_TASKS = 20_000
#: Weights of the shorter context after one and after two words: the best of 200, 400, 800 and of 2, 5, 10, 20, 50 on the training texts with remainder 1 of one corpus,
#: under counts from its other training texts.
MU = (800.0, 10.0)
END, START = b"\n", b"\t"
_SALT, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_START_HASH = np.uint64(xxhash.xxh64_intdigest(START))


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    x = left * _SALT ^ (right >> np.uint64(29) ^ right << np.uint64(35))
    x = (x ^ x >> np.uint64(32)) * _TURN
    return x ^ x >> np.uint64(32)


class Block:
    """Tokens of some texts and the keys of their n-grams: 61 bits of hash and the n-gram's length in the last two."""

    def __init__(self, texts: list[bytes | None]):
        tokens: list[bytes] = []
        lengths = []
        for t in texts:
            words = ascii_lower_words(t)
            tokens += words
            tokens.append(END)
            lengths.append(len(words) + 1)
        index = dict.fromkeys(tokens)
        for i, w in enumerate(index):
            index[w] = i
        ids = np.fromiter(map(index.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        del tokens
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), dtype=np.uint64, count=len(index))
        self.lengths = np.array(lengths, dtype=np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.inner = np.ones(len(ids), dtype=bool)
        self.inner[self.first] = False  # the first word of a text ends no triple
        words = hashes[ids]
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[self.first] = _START_HASH
        pairs = _mixed(before, words)
        inner = np.flatnonzero(self.inner)
        triples = _mixed(pairs[inner - 1], words[inner] ^ _TURN)
        low = np.uint64(7)
        #: Keys of the words, pairs and triples that end at each token, one after the other, shifted by one bit.
        self.grams = np.concatenate([words & ~low | np.uint64(2), pairs & ~low | np.uint64(4), triples & ~low | np.uint64(6)])

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys and how often each stands in texts of the training set."""
        marks = np.repeat(train, self.lengths)
        seen = np.sort(self.grams | np.concatenate([marks, marks, marks[self.inner]]).astype(np.uint64))
        if not len(seen):
            return seen, seen
        keys = seen >> np.uint64(1)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[starts], np.add.reduceat(seen & np.uint64(1), starts)

    def places(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """The number of distinct keys, and where among the sorted ones each token's word, pair and triple are (-1: no triple)."""
        order = np.argsort(self.grams)
        seen = self.grams[order]
        rank = np.empty(len(seen), dtype=np.int32)
        rank[order] = np.cumsum(np.concatenate(([False], seen[1:] != seen[:-1])))
        n = len(self.inner)
        triples = np.full(n, -1, dtype=np.int32)
        triples[self.inner] = rank[2 * n :]
        return int(rank[order[-1]]) + 1, rank[:n], rank[n : 2 * n], triples


def _fixed(df: DataFrame) -> DataFrame:
    """df on the partitions that it has now. Two plans over files may split them differently, by the cores that are there at the time; plans over this one have the same partitions."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, tuple[list, list, list]]]:
    """(key of the block, columns of its rows) of a partition's rows (id, train, text). The same partition gives the same blocks again; the key is a digest of place and rows, so other rows are another block."""
    part, seq, rows, held = TaskContext.get().partitionId(), 0, ([], [], []), 0

    def key() -> int:
        digest = xxhash.xxh64(f"{part} {seq} {rows[0]} {rows[1]}")
        for t in rows[2]:
            digest.update(t or b"")
            digest.update(b"\0")
        return digest.intdigest() - (1 << 63)

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for column, value in zip(rows, row):
                column.append(value)
            held += len(row[2] or b"") + 16
            if held >= limit:
                yield key(), rows
                seq, rows, held = seq + 1, ([], [], []), 0
    if rows[0]:
        yield key(), rows


_ASKS = "range long, asker long, keys binary, counts binary"
_REPLIES = "range long, asker long, totals binary, n long, v long, n1 long, n2 long"


def _rows(schema: str, *columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])


def cut(keys: np.ndarray, counts: np.ndarray, base: int, parts: int, of: int) -> tuple[list, list, list]:
    """Sorted keys, all in the ranges base.. base + parts - 1 out of `of` equal ones, as one piece for each range that holds any: ranges, keys, counts."""
    borders = np.array([(i << 63) // of for i in range(base + 1, base + parts)], dtype=np.uint64)
    owner = np.searchsorted(borders, keys, side="right")
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(keys) else []
    ends = [*starts[1:], len(keys)]
    return [base + int(owner[a]) for a in starts], [packed(keys[a:b]) for a, b in zip(starts, ends)], [planes(counts[a:b]) for a, b in zip(starts, ends)]


def _summed(rows: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of some asks, the sums of their counts, and where each ask's keys are among them."""
    keys = [unpacked(x) for x in rows]
    whole, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(whole), dtype=np.int64)
    split = np.split(at, np.cumsum([len(x) for x in keys])[:-1])
    for place, data in zip(split, counts):
        sums[place] += from_planes(data).astype(np.int64)  # the keys of an ask are distinct
    return whole, sums, split


def _reply(table: pa.Table) -> pa.Table:
    """The sums of one range over all asks, in the order in which each ask holds its keys, and the range's share of the corpus counts."""
    whole, sums, split = _summed(table["keys"].to_pylist(), table["counts"].to_pylist())
    words = sums[whole & np.uint64(3) == 1]
    stats = [int(words.sum()), int((words > 0).sum()), int((words == 1).sum()), int((words == 2).sum())]
    rest = [0] * (table.num_rows - 1)
    return pa.Table.from_batches([_rows(_REPLIES, table["range"].to_pylist(), table["asker"].to_pylist(), [planes(sums[x]) for x in split], *([s, *rest] for s in stats))])


def resolved(asks: DataFrame, askers: int, ranges: int, fan: int) -> DataFrame:
    """A reply for each ask. Up to `fan` askers a range are summed at once. More of them are merged in groups of `fan`; each group asks once, with its
    keys cut into smaller ranges, and hands the sums on to its own askers. So a task holds `fan` asks at most, and rows stay in proportion to keys."""
    if askers <= fan:
        return asks.repartition(min(ranges, MOST_TASKS), "range").groupBy("range").applyInArrow(_reply, _REPLIES)
    teams = -(-askers // fan)
    parts = min(teams, fan)
    grouped = kept(asks.withColumn("team", F.pmod(F.xxhash64("asker"), F.lit(teams))), "asks")

    def merge(table: pa.Table) -> pa.Table:
        whole, sums, _ = _summed(table["keys"].to_pylist(), table["counts"].to_pylist())
        number, keys, counts = cut(whole, sums, table["range"][0].as_py() * parts, parts, ranges * parts)
        return pa.Table.from_batches([_rows(_ASKS, number, [table["team"][0].as_py()] * len(keys), keys, counts)])

    replies = resolved(grouped.groupBy("range", "team").applyInArrow(merge, _ASKS), teams, ranges * parts, fan)
    replies = replies.withColumn("part", F.col("range")).withColumn("range", F.floor(F.col("range") / parts)).withColumnRenamed("asker", "team")

    def hand_on(left: pa.Table, right: pa.Table) -> pa.Table:
        found = sorted(right.to_pylist(), key=lambda r: r["part"])
        sums = np.concatenate([from_planes(r["totals"]) for r in found])
        _, _, split = _summed(left["keys"].to_pylist(), left["counts"].to_pylist())
        rest = [0] * (left.num_rows - 1)
        stats = [[sum(r[k] for r in found), *rest] for k in ("n", "v", "n1", "n2")]
        return pa.Table.from_batches([_rows(_REPLIES, left["range"].to_pylist(), left["asker"].to_pylist(), [planes(sums[x]) for x in split], *stats)])

    return grouped.groupBy("range", "team").cogroup(replies.groupBy("range", "team")).applyInArrow(hand_on, _REPLIES)


class Automaton:
    """The states and arcs that a block's texts can reach. N-grams are numbered as their keys are sorted: the arc of an n-gram has its number, and so has the
    state of a word or pair. Two more states are the start of a text and the root."""

    def __init__(self, block: Block, totals: np.ndarray, n: int, v: int, n1: int, n2: int, mu: tuple[float, float] = MU):
        """totals: counts in the training texts by number."""
        size, self.words, self.pairs, self.triples = block.places()
        self.start, self.root = size, size + 1
        inner = np.flatnonzero(block.inner)
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        known = np.append(totals > 0, [True, True])
        times = np.append(totals, [0, 0]).astype(np.float64)
        times[self.start] = totals[self.words[block.first + block.lengths - 1][0]]  # as many texts start as end
        # Of each pair and triple: the state of its words but the last, and the n-gram without its first word.
        head, tail = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
        before = np.full(len(self.words), self.start, dtype=np.int32)
        before[inner] = self.words[inner - 1]
        head[self.pairs], tail[self.pairs] = before, self.words
        head[self.triples[inner]], tail[self.triples[inner]] = self.pairs[inner - 1], self.pairs[inner]
        length = np.zeros(size, dtype=np.int8)
        length[self.words], length[self.pairs], length[self.triples[inner]] = 1, 2, 3

        p = np.zeros(size)
        one = np.flatnonzero(length == 1)
        p[one] = np.where(totals[one] > 0, (totals[one] - discount) / max(n, 1), discount * v / n if n else 1.0)
        for k, m in ((2, mu[0]), (3, mu[1])):
            some = np.flatnonzero(length == k)
            c = times[head[some]]
            p[some] = (totals[some] + m * p[tail[some]]) / (c + m)
        mus = np.append(np.where(length == 2, mu[1], mu[0]), [mu[0], 1.0])
        self.weight = array("d", np.log10(p).tobytes())
        #: Where an arc leads: the longest known state of its last two words. An unknown word leads to the root.
        leads = np.where(length == 3, tail, np.arange(size))
        self.target = array("i", np.where(known[leads], leads, self.root).astype(np.int32).tobytes())
        self.fail = array("i", np.append(np.where(length == 2, np.where(known[tail], tail, self.root), self.root), [self.root, self.root]).astype(np.int32).tobytes())
        self.fail_weight = array("d", np.log10(mus / (times + mus)).tobytes())
        #: How many words a state holds: which of a token's three n-grams is an arc out of it.
        self.held = np.append(np.minimum(length, 2), [1, 0]).astype(np.uint8).tobytes()
        # Arcs are known n-grams; a word is always one, the root has an arc for every word.
        self.arcs = [self.words, *(np.where(x >= 0, np.where(known[x], x, -1), -1) for x in (self.pairs, self.triples))]

    def traverse(self, first: int, length: int) -> float:
        """log10 probability of the text whose tokens begin at `first`."""
        held, fail, fail_weight, weight, target = self.held, self.fail, self.fail_weight, self.weight, self.target
        state, total = self.start, 0.0
        for out in zip(*(x[first : first + length].tolist() for x in self.arcs)):
            while (arc := out[held[state]]) < 0:
                total += fail_weight[state]
                state = fail[state]
            total += weight[arc]
            state = target[arc]
        return total


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", modulus: int = 10, mu: tuple[float, float] = MU, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, fan: int = FAN, stable: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, under counts from the rows whose crc32(id) modulo modulus is not 0.

    Null and empty texts have one token, the end. A null id counts as held out. Repeated rows count and are scored each; an empty table gives no rows, and
    without training texts every word is unknown. Other columns are neither read nor returned. docs is read twice, in the same partitions, and must give the same rows both times;
    unless `stable` says that it does, as files do, it is written first. Rows that differ are an error. Equal 61-bit hashes count as one n-gram: among 10^8 distinct ones the chance of
    one such pair is 0.002.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id).cast("long").alias("id"), (remainder(id, modulus) != 0).alias("train"), text_bytes(text).alias("text"))
    slim = _fixed(slim if stable else kept(slim, "texts"))
    facts = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    ranges = max(8, min(fan, -(-facts.b // range_bytes)))
    askers = max(1, -(-facts.b // block_bytes))

    def ask(batches):
        for number, (_, train, texts) in _blocks(batches, block_bytes):
            keys, counts = Block(texts).counts(np.array(train, dtype=bool))
            number_of, pieces, numbers = cut(keys, counts, 0, ranges, ranges)
            for at in range(0, len(pieces), 64):
                these = slice(at, at + 64)
                yield _rows(_ASKS, number_of[these], [number] * len(pieces[these]), pieces[these], numbers[these])

    # The asks are the largest thing here, and aren't needed once they are answered.
    totals = kept_alone(resolved(slim.mapInArrow(ask, _ASKS), askers, ranges, fan), "totals")
    stats = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n1", "n2"))).first()
    n, v, n1, n2 = stats.n, stats.v, stats.n1, stats.n2

    def whole(batches):
        for number, (ids, train, texts) in _blocks(batches, block_bytes):
            sizes = np.array([len(t or b"") for t in texts], dtype=np.int64)
            columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())), *(pa.array([x], pa.binary()) for x in (sizes.tobytes(), b"".join(t or b"" for t in texts)))]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *columns], names=["block", "ids", "train", "sizes", "texts"])

    blocks = slim.mapInArrow(whole, "block long, ids array<long>, train array<boolean>, sizes binary, texts binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1 or not right.num_rows:
            raise RuntimeError("the texts aren't the same when they are read a second time")
        (row,) = left.to_pylist()
        ends = np.cumsum(np.frombuffer(row["sizes"], dtype=np.int64)).tolist()
        block = Block([row["texts"][a:b] for a, b in zip([0, *ends], ends)])
        del row["texts"]
        found = sorted(right.select(["range", "totals"]).to_pylist(), key=lambda r: r["range"])
        counts = np.concatenate([from_planes(r["totals"]) for r in found]).astype(np.int64)
        del found
        automaton = Automaton(block, counts, n, v, n1, n2, mu)
        times = counts[automaton.words]
        base = np.log10((times + 0.1) / (n + 0.1 * (v + 1)))
        known = np.add.reduceat((times > 0).astype(np.int64), block.first)
        scores = [automaton.traverse(a, k) for a, k in zip(block.first.tolist(), block.lengths.tolist())]
        return pa.Table.from_batches([_rows(_SCORES, row["ids"], [not t for t in row["train"]], block.lengths, known, np.add.reduceat(base, block.first), scores)])

    dealt = [x.repartition(min(askers, MOST_TASKS), "block").groupBy("block") for x in (blocks, totals.withColumnRenamed("asker", "block"))]
    scored = dealt[0].cogroup(dealt[1]).applyInArrow(score, _SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
