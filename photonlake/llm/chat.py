"""Preference pairs for chat training.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once as the prompt;
what follows in each is its completion, with the parts to learn from (the assistant's words) as a mask of spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, TURN_END = "<|", "|>\n", "\n<|end|>\n"


def turns_of(conversations: DataFrame, id: str = "conv_id") -> DataFrame:
    """One row for each conversation with its turns in order as an array of (turn, role, text). A row is one training text, so its turns must fit one;
    null ids are left out, null roles and texts are empty, and rows of one turn number stand in the order of role and text."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.filter(F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    """Turns as one string."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(TURN_END))))


def masked(turns: Column, role: str = "assistant") -> Column:
    """Where the texts of one role, with the end sign after each, begin and end in rendered(turns), in characters."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(TURN_END)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(pairs: DataFrame, role: str = "assistant") -> DataFrame:
    """pair_id, n_prefix, prompt, chosen, rejected and both masks of rows (pair_id, chosen_turns, rejected_turns) as turns_of makes them.

    Turns are equal if role and text are; their numbers don't count. Equal conversations have empty completions; null turns count as none.
    """
    a, b = (F.coalesce(c, F.array().cast("array<struct<turn:bigint,role:string,text:string>>")) for c in ("chosen_turns", "rejected_turns"))
    both = F.arrays_zip(F.transform(a, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("a"), F.transform(b, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("b"))
    zipped = pairs.select("pair_id", a.alias("a"), b.alias("b"), both.alias("both"))
    same = F.transform("both", lambda t: t["a"].eqNullSafe(t["b"]))
    n = F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(F.size(same)).cast("long")
    cut = zipped.withColumn("n", n).select("pair_id", "n", F.slice("a", F.lit(1), F.col("n").cast("int")).alias("p"), *(F.filter(x, lambda t, i: i >= F.col("n")).alias(x) for x in ("a", "b")))
    return cut.select("pair_id", F.col("n").alias("n_prefix"), rendered(F.col("p")).alias("prompt"), rendered(F.col("a")).alias("chosen"), rendered(F.col("b")).alias("rejected"), masked(F.col("a"), role).alias("chosen_mask"), masked(F.col("b"), role).alias("rejected_mask"))


def sibling_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs out of a table that has none: each conversation with an assistant's turn is chosen; rejected is the same up to that last turn (all turns that stand before it, those of its number too), which is
    replaced by the last assistant's turn of the conversation whose id differs in the lowest bit. Without such a turn the rejected one just ends before it."""
    turns = turns_of(conversations)
    replies = F.filter("turns", lambda t: t["role"] == "assistant")
    last = F.try_element_at(replies, F.lit(-1))
    mine = turns.withColumn("last", last).filter(F.col("last").isNotNull())
    other = mine.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.col("last").alias("other"))
    paired = mine.join(other, "id", "left")
    # By places, not by numbers: turns may share one.
    place = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)))
    before = F.filter("turns", lambda t, i: i < place)
    reply = F.when(F.col("other").isNotNull(), F.array(F.struct(F.col("last")["turn"].alias("turn"), F.col("other")["role"].alias("role"), F.col("other")["text"].alias("text")))).otherwise(F.array().cast("array<struct<turn:bigint,role:string,text:string>>"))
    return paired.select(F.col("id").alias("pair_id"), F.col("turns").alias("chosen_turns"), F.concat(before, reply).alias("rejected_turns"))


def preference_digests(conversations: DataFrame) -> DataFrame:
    """pair_id, n_prefix, the three texts' SHA-256 and the characters that each mask covers, for sibling_pairs of the whole table. Conversations without an assistant's turn give no
    pair, nor do null ids; null texts are empty; repeated rows are repeated turns; an empty table gives no rows."""
    made = preference_pairs(sibling_pairs(conversations))
    covered = lambda m: F.aggregate(m, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")]
    return made.select("pair_id", "n_prefix", *digests, covered("chosen_mask").alias("chosen_learned"), covered("rejected_mask").alias("rejected_learned"))


#: The same rows in DuckDB SQL, for tables without nulls or repeated turns.
ORACLE = r"""
WITH turns AS (SELECT conv_id AS id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations
), last AS (SELECT id, max_by(turn, pos) AS turn, max_by(text, pos) AS text, max(pos) AS pos FROM turns WHERE role = 'assistant' GROUP BY id
), rejected AS (
  SELECT t.id, t.role, t.text, row_number() OVER (PARTITION BY t.id ORDER BY t.pos) AS pos
  FROM (SELECT t.id, t.turn, t.role, t.text, t.pos FROM turns t JOIN last l ON t.id = l.id WHERE t.pos < l.pos
        UNION ALL SELECT l.id, l.turn, 'assistant', o.text, l.pos FROM last l JOIN last o ON o.id = xor(l.id, 1)) t
), chosen AS (SELECT t.id, t.pos, t.role, t.text FROM turns t JOIN last l ON t.id = l.id
), places AS (SELECT coalesce(c.id, r.id) AS id, coalesce(c.pos, r.pos) AS pos, c.role = r.role AND c.text = r.text AS same FROM chosen c FULL JOIN rejected r ON c.id = r.id AND c.pos = r.pos
), prefix AS (SELECT id, coalesce(min(pos) FILTER (WHERE same IS NOT TRUE) - 1, count(*)) AS n FROM places GROUP BY id
), texts AS (
  SELECT 'c' AS side, x.id, x.pos, x.pos <= p.n AS shared, x.role, x.text, '<|' || x.role || '|>' || chr(10) || x.text || chr(10) || '<|end|>' || chr(10) AS out FROM chosen x JOIN prefix p ON x.id = p.id
  UNION ALL SELECT 'r', x.id, x.pos, x.pos <= p.n, x.role, x.text, '<|' || x.role || '|>' || chr(10) || x.text || chr(10) || '<|end|>' || chr(10) FROM rejected x JOIN prefix p ON x.id = p.id
)
SELECT t.id AS pair_id, any_value(p.n) AS n_prefix,
  sha256(coalesce(string_agg(out, '' ORDER BY pos) FILTER (WHERE side = 'c' AND shared), '')) AS prompt_sha256,
  sha256(coalesce(string_agg(out, '' ORDER BY pos) FILTER (WHERE side = 'c' AND NOT shared), '')) AS chosen_sha256,
  sha256(coalesce(string_agg(out, '' ORDER BY pos) FILTER (WHERE side = 'r' AND NOT shared), '')) AS rejected_sha256,
  CAST(coalesce(sum(length(text) + 9) FILTER (WHERE side = 'c' AND NOT shared AND role = 'assistant'), 0) AS BIGINT) AS chosen_learned,
  CAST(coalesce(sum(length(text) + 9) FILTER (WHERE side = 'r' AND NOT shared AND role = 'assistant'), 0) AS BIGINT) AS rejected_learned
FROM texts t JOIN prefix p ON t.id = p.id GROUP BY t.id
"""
