"""Preference formatting: a chosen and a rejected conversation with their common beginning rendered once.

A pair is two conversations. Their longest common prefix of whole turns (role and text alike) becomes the
prompt; what follows in each becomes a completion. Text is rendered with one template; of a completion
the mask says which characters count for the loss: the assistant's texts and their end marks. If one
conversation is a prefix of the other, or both are equal, its completion is empty.

The registered query pairs conversation 2k (chosen) with 2k + 1 (rejected). A missing side counts as a
conversation without turns, so every conversation stands in exactly one row. Turns are ordered by their
number, then role and text; null roles and texts are rendered as empty, but null and empty differ for
the common prefix. A pair is one row of the result, so its turns must fit in one. Rows repeated in full are one turn. Rows without a conversation id have no partner and
are left out. An empty table gives no rows; columns beyond the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_START, TURN_END = "<|turn|>", "<|end|>\n"
TURN = "array<struct<turn:bigint,role:string,text:string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row a conversation, its turns in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    own = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return own.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def pairs_by_parity(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, chosen, rejected): conversation 2k against 2k + 1."""
    key = F.call_function("div", F.col("conv_id") - F.pmod("conv_id", F.lit(2)), F.lit(2)).alias("pair_id")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    own = turns.filter("conv_id is not null").withColumn("conv_id", F.col("conv_id").cast("long")).select(key, "conv_id", F.pmod("conv_id", F.lit(2)).alias("side"), turn.alias("t"))
    side = lambda k, c: F.array_sort(F.collect_set(F.when(F.col("side") == k, F.col("t")))).alias(c)
    name = lambda k, c: F.max(F.when(F.col("side") == k, F.col("conv_id"))).alias(c)
    return own.groupBy("pair_id").agg(name(0, "chosen_id"), name(1, "rejected_id"), side(0, "chosen"), side(1, "rejected"))


def _render(turns: Column) -> Column:
    each = F.transform(turns, lambda t: F.concat(F.lit(TURN_START), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(TURN_END)))
    return F.array_join(each, "")


def _spans(turns: Column) -> Column:
    """Start and end, in characters of the rendered text, of what counts for the loss."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        role, text = F.coalesce(t["role"], F.lit("")), F.coalesce(t["text"], F.lit(""))
        start = acc["at"] + F.lit(len(TURN_START)) + F.char_length(role) + 1
        end = start + F.char_length(text) + F.lit(len(TURN_END))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(role == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns at the beginning that both share."""
    size = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: ~(F.try_element_at(a, i)["role"].eqNullSafe(F.try_element_at(b, i)["role"]) & F.try_element_at(a, i)["text"].eqNullSafe(F.try_element_at(b, i)["text"])))
    return F.when(size == 0, 0).otherwise(F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, size))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Renders (pair_id, chosen_id, rejected_id, chosen, rejected).

    Gives these ids, prompt, prompt_turns, and for each side its completion and mask (spans of characters)."""
    k = common_turns(F.col("chosen"), F.col("rejected"))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    cut = pairs.withColumn("prompt_turns", k.cast("int")).withColumns({"head": F.slice("chosen", F.lit(1), F.col("prompt_turns")), "c": rest("chosen"), "r": rest("rejected")})
    return cut.select(
        "pair_id", "chosen_id", "rejected_id", "prompt_turns", _render(F.col("head")).alias("prompt"),
        _render(F.col("c")).alias("chosen_completion"), _spans(F.col("c")).alias("chosen_mask"),
        _render(F.col("r")).alias("rejected_completion"), _spans(F.col("r")).alias("rejected_mask"),
    )


def flat(formatted: DataFrame) -> DataFrame:
    """The same with masks as text, start-end joined by commas, for comparison across engines."""
    text = lambda c: F.array_join(F.transform(F.col(c), lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return formatted.withColumns({c: text(c) for c in ("chosen_mask", "rejected_mask")})


def _sql_side(c: str) -> str:
    one = "'<|turn|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|end|>' || chr(10)"
    return f"""
{c}_rest AS (SELECT t.*, {one} AS made FROM t JOIN pre USING (pair_id) WHERE side = {0 if c == 'chosen' else 1} AND i > k),
{c}_at AS (SELECT *, sum(length(made)) OVER (PARTITION BY pair_id ORDER BY i) AS e FROM {c}_rest),
{c} AS (
  SELECT pair_id, string_agg(made, '' ORDER BY i) AS completion,
    string_agg(CASE WHEN role = 'assistant' THEN (e - length(coalesce(text, '')) - 8)::BIGINT::VARCHAR || '-' || e::BIGINT::VARCHAR END, ',' ORDER BY i) AS mask
  FROM {c}_at GROUP BY pair_id
)"""


ORACLE_SQL = f"""
WITH u AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT (conv_id - conv_id % 2) // 2 AS pair_id, conv_id, conv_id % 2 AS side, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM u
),
ids AS (SELECT pair_id, max(CASE WHEN side = 0 THEN conv_id END) AS chosen_id, max(CASE WHEN side = 1 THEN conv_id END) AS rejected_id FROM t GROUP BY pair_id),
same AS (
  SELECT a.pair_id, a.i FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
    AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text
),
pre AS (
  SELECT pair_id, coalesce(max(CASE WHEN i = n THEN i END), 0) AS k
  FROM ids LEFT JOIN (SELECT pair_id, i, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS n FROM same) s USING (pair_id) GROUP BY pair_id
),
head AS (
  SELECT pair_id, string_agg('<|turn|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY i) AS prompt
  FROM t JOIN pre USING (pair_id) WHERE side = 0 AND i <= k GROUP BY pair_id
),{_sql_side('chosen')},{_sql_side('rejected')}
SELECT pair_id, chosen_id, rejected_id, k::INTEGER AS prompt_turns, coalesce(prompt, '') AS prompt,
  coalesce(chosen.completion, '') AS chosen_completion, coalesce(chosen.mask, '') AS chosen_mask,
  coalesce(rejected.completion, '') AS rejected_completion, coalesce(rejected.mask, '') AS rejected_mask
FROM ids JOIN pre USING (pair_id) LEFT JOIN head USING (pair_id) LEFT JOIN chosen USING (pair_id) LEFT JOIN rejected USING (pair_id)
"""
