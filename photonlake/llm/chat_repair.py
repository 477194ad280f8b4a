"""Repair of the structure of conversations at the least cost.

A conversation's rows are an acceptor; a transducer keeps, re-roles or deletes each and inserts rows between; an acceptor of role initials allows what
training formats take: `(s?(ua)+)?`. Arcs of the three are put together only for the states that a conversation reaches. Weights are pairs (cost, labels), less by
cost and then by ASCII order; they are summed up from the last row to the first, and the labels are read on the way back.

A task gets a conversation's rows as a stream, in order. Of each it holds a few bytes (what kind of row it is, and the costs of the four grammar states), so the
audit, a letter for each edit, is the most that a conversation takes. Texts go by a second time, in the same order, and meet the edits there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonlake.llm.common import small_batches

WHITE = " \t\n\x0b\x0c\r"
#: What edits cost; a truncated row that stays adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Role initials that the grammar knows; all others are OTHER.
INITIALS, OTHER = "sua", 3
USER, ASSISTANT = 1, 2
ROLES = {USER: b"user", ASSISTANT: b"assistant"}
#: The grammar: the state after an initial, for each state (0: at the start, 1: after s, 2: after u, 3: after a); and its final states.
GRAMMAR = ({0: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2})
FINAL = (0, 3)
LEGAL = ((0, USER), (USER, ASSISTANT), (ASSISTANT, USER))
#: Conditions of a row, beside its initial in its code: code = initial + 4 * condition.
SOUND, CUT, OUT = 0, 1, 2
#: No cost at all is this large.
NEVER = 1 << 20
#: Edits remembered of conversations of up to so many rows.
SHORT = 64


@lru_cache(maxsize=None)
def arcs(code: int | None, state: int) -> tuple[tuple[str, int, int, bool], ...]:
    """What a row of that code (None: no row is left) and the grammar state allow: label, cost, next grammar state and whether the row is used up, in the labels' ASCII order."""
    out = [("I", INSERT, to, False) for initial, to in GRAMMAR[state].items() if initial in ROLES]
    if code is not None:
        initial, condition = code & 3, code >> 2
        out.append(("D", DELETE, state, True))
        if condition != OUT:
            more = TRUNCATED if condition == CUT else 0
            if initial in GRAMMAR[state]:
                out.append(("K", KEEP + more, GRAMMAR[state][initial], True))
            out += [("R", REROLE + more, to, True) for i, to in GRAMMAR[state].items() if i in ROLES]
    return tuple(sorted(out))


def _closed(costs: list[int]) -> list[int]:
    """Costs to the end with insertions before the next row: two at most, as a third comes back to a state that was there."""
    for _ in range(2):
        costs = [min([costs[q], *(w + costs[to] for _, w, to, _ in arcs(None, q))]) for q in range(4)]
    return costs


@lru_cache(maxsize=None)
def _step(code: int, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """From the costs after a row, less the least of them, the costs before it: the least one, and the four less it. There are few such tuples."""
    costs = _closed([min([w + after[to] for _, w, to, used in arcs(code, q) if used], default=NEVER) for q in range(4)])
    least = min(costs)
    return least, tuple(min(c - least, 255) for c in costs)


def edits(codes: bytes) -> tuple[int, str]:
    """The least cost of a conversation, given its rows' codes, and the ASCII-least labels among those of that cost."""
    return _short(codes) if len(codes) <= SHORT else _edits(codes)


def _edits(codes: bytes) -> tuple[int, str]:
    now = tuple(_closed([0 if q in FINAL else NEVER for q in range(4)]))
    ahead, steps = bytearray(bytes(now)), bytearray()
    for code in reversed(codes):
        step, now = _step(code, now)
        ahead += bytes(now)
        steps.append(step)
    # Costs to the end from the states before row i stand at 4 * (n - i), less the least of them; steps tell how much less than before a row they are after it.
    n, state, at, out = len(codes), 0, len(codes), bytearray()
    cost = sum(steps) + ahead[4 * n]
    while at or ahead[state]:
        here = ahead[4 * at + state]
        for label, w, to, used in arcs(codes[n - at] if at else None, state):
            if w + (ahead[4 * (at - 1) + to] if used else ahead[4 * at + to]) == here + (steps[at - 1] if used else 0):
                out += label.encode()
                state, at = to, at - used
                break
    return cost, out.decode()


@lru_cache(maxsize=1 << 14)
def _short(codes: bytes) -> tuple[int, str]:
    return _edits(codes)


def damaged(conversations: DataFrame, id: str = "conv_id") -> DataFrame:
    """The contract's damage: id, turn, role, text and copies, 0 for a row that is dropped and 2 for one that is repeated. Nulls are one space, but for ids and turns of the rows themselves."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space(id), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return conversations.select(
        F.col(id), F.col("turn").cast("long").alias("turn"), F.when(hit == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies")
    )


#: A row's place in its conversation. Of a turn's rows role, the text's beginning and hashes of both decide; rows equal in all are equal.
PLACE = ("turn", "role", "head", "h1", "h2")


def _marked(rows: DataFrame, id: str) -> DataFrame:
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(F.col(id).alias("id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), copies.alias("copies"))
    return plain.withColumns({"head": F.left("text", F.lit(64)), "h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("other"), "role", "text")})


def _ordered() -> list:
    return [F.col("id"), *(F.col(c).asc_nulls_first() for c in PLACE)]


_AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(rows: DataFrame, id: str = "conv_id") -> DataFrame:
    """id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of rows (id, turn, role, text, and copies if a row stands for more than one or for none).

    Rows stand by turn, null turns first, then by role, the text's first 64 characters and a hash; null roles and texts are one space; a null id names a conversation too.
    A conversation without rows has zeros and no edits; an empty table gives no rows; other columns aren't read.
    """
    small_batches(rows.sparkSession)
    marked = _marked(rows, id)
    core = F.rtrim(F.col("text"), F.lit(WHITE))
    condition = F.when(core == "", OUT).when(F.right(core, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)
    initial = F.left("role", F.lit(1))
    code = F.when(initial == "s", 0).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    light = marked.select("id", *PLACE, "copies", (core == "").alias("blank"), (code + 4 * condition).cast("int").alias("code"))
    seen = Window.partitionBy("id", "h1", "h2").orderBy(F.col("copies") == 0, F.col("turn").asc_nulls_first())
    # Rows of a conversation are together, so the window sorts them but moves nothing.
    streamed = light.repartition("id").withColumn("first", F.row_number().over(seen) == 1).sortWithinPartitions(*_ordered(), F.col("first").desc()).select("id", "turn", "copies", "blank", "code", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        for batch in batches:
            done = []
            for ident, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.id != ident:
                    done += [now.result()] if now is not None else []
                    now = _Conversation(ident)
                now.add(*row)
            if done:
                yield _records(done, batch.schema.field(0).type)
        if now is not None:
            yield _records([now.result()], batch.schema.field(0).type)

    schema = streamed.select("id").schema
    for field in rows.sparkSession.createDataFrame([], _AUDIT).schema:
        schema = schema.add(field)
    return streamed.mapInArrow(read, schema).withColumnRenamed("id", id)


def _records(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, *[pa.int64()] * 6, pa.string()]
    names = ["id", *(f.split()[0] for f in _AUDIT.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)


class _Conversation:
    """What is held of a conversation while its rows go by: counts, and a byte for each row."""

    def __init__(self, id: object):
        self.id, self.codes, self.turns, self.low, self.high = id, bytearray(), 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, copies: int, blank: bool, code: int, first: bool) -> None:
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - first
            self.truncated += first and code >> 2 == CUT
        out = code & 3 | OUT << 2
        begun = len(self.codes)
        self.codes += bytes([code if first or blank else out]) + bytes([out]) * (copies - 1)
        self.illegal += (begun > 0 and (self.codes[begun - 1] & 3, code & 3) not in LEGAL) + copies - 1

    def result(self) -> tuple:
        cost, audit = edits(bytes(self.codes))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


class _Repair:
    """One conversation's edits applied to its rows as they go by; each call returns the repaired rows that are settled by then, as (role, text) in bytes."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _made(self) -> bytes:
        (initial, self.state), *_ = ((i, to) for i, to in GRAMMAR[self.state].items() if i in ROLES)
        return ROLES[initial]

    def inserted(self) -> list[tuple[bytes, bytes]]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            out.append((self._made(), b""))
            self.at += 1
        return out

    def row(self, role: bytes, text: bytes) -> list[tuple[bytes, bytes]]:
        out = self.inserted()
        label = self.audit[self.at]
        self.at += 1
        if label == "K":
            self.state = GRAMMAR[self.state][INITIALS.index(role[:1].decode())]
            out.append((role, text))
        elif label == "R":
            out.append((self._made(), text))
        return out


def _with_edits(rows: DataFrame, audited: DataFrame, id: str) -> DataFrame:
    """Each conversation's audit row (kind 0) and then its rows in order (kind 1), in one task."""
    texts = _marked(rows, id).filter("copies > 0").withColumn("kind", F.lit(1))
    heads = audited.withColumnRenamed(id, "id").withColumn("kind", F.lit(0))
    both = heads.unionByName(texts, allowMissingColumns=True).repartition("id").sortWithinPartitions("id", "kind", *(F.col(c).asc_nulls_first() for c in PLACE))
    return both.select("id", "kind", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "copies", *(f.split()[0] for f in _AUDIT.split(", ")))


def repaired(rows: DataFrame, id: str = "conv_id") -> DataFrame:
    """id, pos (from 0), role and text of the repaired conversations' rows; those that end up empty have none."""
    both = _with_edits(rows, audits(rows, id), id)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Repair | None = None
        ident, pos = None, 0
        for batch in batches:
            out: list[tuple] = []
            for i, kind, role, text, copies, audit in zip(*(batch.column(n).to_pylist() for n in ("id", "kind", "role", "text", "copies", "audit"))):
                made = now.inserted() if kind == 0 and now else []
                out += [(ident, pos + p, *x) for p, x in enumerate(made)]
                if kind == 0:
                    now, ident, pos = _Repair(audit), i, 0
                    continue
                for _ in range(copies):
                    made = now.row(role, text)
                    out += [(ident, pos + p, *x) for p, x in enumerate(made)]
                    pos += len(made)
            if out:
                yield _turns(out, batch.schema.field(0).type)
        if now and (made := now.inserted()):
            yield _turns([(ident, pos + p, *x) for p, x in enumerate(made)], batch.schema.field(0).type)

    schema = both.select("id").schema.add("pos", "long").add("role", "string").add("text", "string")
    return both.mapInArrow(apply, schema).withColumnRenamed("id", id)


def _turns(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k).cast(t) for c, k, t in zip(zip(*rows), (key, pa.int64(), pa.binary(), pa.binary()), (key, pa.int64(), pa.string(), pa.string()))], names=["id", "pos", "role", "text"])


def repair_digests(rows: DataFrame, id: str = "conv_id") -> DataFrame:
    """audits with repaired_sha256, of the repaired `role:text` joined by line ends. A digest is taken over a conversation's texts one after another, so one task reads them as a stream;
    it holds the audit and a batch of rows. What null, equal and missing rows do stands at audits."""
    both = _with_edits(rows, audits(rows, id), id)
    n = len(_AUDIT.split(", "))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Repair | None = None
        head: tuple = ()
        sha, any_ = hashlib.sha256(), False

        def put(made: list[tuple[bytes, bytes]]) -> None:
            nonlocal any_
            for role, text in made:
                sha.update(b"\n" + role if any_ else role)
                sha.update(b":" + text)
                any_ = True

        def result() -> tuple:
            put(now.inserted())
            return *head, sha.hexdigest()

        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                ident, kind, role, text, copies = row[:5]
                if kind == 0:
                    done += [result()] if now else []
                    now, head, sha, any_ = _Repair(row[-1]), (ident, *row[5:]), hashlib.sha256(), False
                    continue
                for _ in range(copies):
                    put(now.row(role, text))
            if done:
                yield _digests(done, batch.schema.field(0).type, n)
        if now:
            yield _digests([result()], batch.schema.field(0).type, n)

    schema = both.select("id", *both.columns[-n:]).schema.add("repaired_sha256", "string")
    return both.mapInArrow(digest, schema).withColumnRenamed("id", id)


def _digests(rows: list[tuple], key: pa.DataType, n: int) -> pa.RecordBatch:
    kinds = [key, *[pa.int64()] * (n - 1), pa.string(), pa.string()]
    names = ["id", *(f.split()[0] for f in _AUDIT.split(", ")), "repaired_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)


#: The contract's rows in DuckDB SQL: CRC-32 by a table, then the weights of the four grammar states row by row. Of rows of one turn and role the text decides.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), src AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hit AS (
  SELECT src.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ord(substr(k, i, 1)) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS d
  FROM src, bits
), dam AS (
  SELECT g, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)
), num AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, left(role, 1) AS r FROM dam
), marked AS (
  SELECT *, core = '' AS is_blank, core <> '' AND row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS is_dup,
    lag(r) OVER (PARTITION BY g ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS is_illegal FROM num
), rows_ AS MATERIALIZED (
  SELECT *, NOT is_blank AND NOT is_dup AND right(core, 1) NOT IN ('.', '!', '?') AS is_cut, is_blank OR is_dup AS is_out FROM marked
), counts AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_dup) AS duplicate,
    count(*) FILTER (is_cut) AS truncated, count(*) FILTER (is_illegal) AS illegal, max(i) AS n FROM rows_ GROUP BY g
), dp AS (
  SELECT g, 0 AS i, {'c': 0, 's': ''} AS f0, {'c': 1000000000, 's': ''} AS f1, {'c': 1000000000, 's': ''} AS f2, {'c': 1000000000, 's': ''} AS f3 FROM counts
  UNION ALL
  SELECT g, i, {'c': g0.c + 3, 's': g0.s || 'D'}, least({'c': g1.c + 3, 's': g1.s || 'D'}, {'c': CASE WHEN NOT is_out AND r = 's' THEN g0.c + x ELSE 1000000000 END, 's': g0.s || 'K'}),
    least({'c': g2.c + 3, 's': g2.s || 'D'}, {'c': h.c + y, 's': h.s || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END}), least({'c': g3.c + 3, 's': g3.s || 'D'}, {'c': g2.c + z, 's': g2.s || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END})
  FROM (
    SELECT *, least(g0, g1, g3) AS h, CASE WHEN is_cut THEN 1 ELSE 0 END AS x, CASE WHEN is_out THEN 1000000000 WHEN r = 'u' THEN 0 ELSE 2 END + CASE WHEN is_cut THEN 1 ELSE 0 END AS y,
      CASE WHEN is_out THEN 1000000000 WHEN r = 'a' THEN 0 ELSE 2 END + CASE WHEN is_cut THEN 1 ELSE 0 END AS z
    FROM (SELECT *, least(f3, {'c': g2.c + 2, 's': g2.s || 'I'}) AS g3 FROM (
      SELECT m.g, m.i, m.r, m.is_out, m.is_cut, f0 AS g0, f1 AS g1, f3, least(f2, {'c': f0.c + 2, 's': f0.s || 'I'}, {'c': f1.c + 2, 's': f1.s || 'I'}, {'c': f3.c + 2, 's': f3.s || 'I'}) AS g2
      FROM dp JOIN rows_ m ON m.g = dp.g AND m.i = dp.i + 1)))
), ends AS (
  SELECT g, least(f0, f3, {'c': f2.c + 2, 's': f2.s || 'I'}, {'c': f0.c + 4, 's': f0.s || 'II'}, {'c': f1.c + 4, 's': f1.s || 'II'}) AS best FROM dp JOIN counts USING (g) WHERE dp.i = counts.n
), letters AS (
  SELECT g, p, substr(best.s, p, 1) AS e FROM ends, unnest(range(1, length(best.s) + 1)) u(p)
), placed AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY g ORDER BY p) AS i FROM letters
), out_ AS (
  SELECT l.g, l.p, l.e, m.role, m.text, m.r, row_number() OVER (PARTITION BY l.g ORDER BY l.p) - 1 AS o FROM placed l LEFT JOIN rows_ m ON l.g = m.g AND l.i = m.i AND l.e <> 'I' WHERE l.e <> 'D'
), shifted AS (SELECT *, o - max(CASE WHEN o = 0 AND e = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS q FROM out_
), texts AS (
  SELECT g, string_agg(CASE WHEN e = 'K' THEN role WHEN q % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t FROM shifted GROUP BY g
)
SELECT s.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  CAST(coalesce(e.best.c, 0) AS BIGINT) AS cost, coalesce(e.best.s, '') AS audit, sha256(coalesce(t.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM src) s LEFT JOIN counts c USING (g) LEFT JOIN ends e USING (g) LEFT JOIN texts t USING (g)
"""
