"""op8: preference pairs from ``conversations``.

The table has no rejected conversations, so the query derives them: of every
conversation the last assistant turn is exchanged in its place for the last one
of its neighbour (ids 2k and 2k + 1), which answers something else; all other
turns, later ones and those without a number too, are the same on both sides.
Without a neighbour's answer the rejected conversation lacks that turn; without a
numbered assistant turn it equals the chosen one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import table
from rankforge.llm.preferences import format_preferences
from rankforge.llm.registry import register

_RENDER = "'<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)"


def _text(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda x: {_RENDER}), '')"


def _spans(turns: str) -> str:
    before = f"length(array_to_string(list_transform(({turns})[1:i - 1], lambda x: {_RENDER}), ''))"
    first = f"({before} + 13 + length(({turns})[i].role))"
    return (
        f"array_to_string(list_transform(list_filter(generate_series(1, len({turns})), lambda i: ({turns})[i].role = 'assistant'), "
        f"lambda i: {first} || ':' || ({first} + length(({turns})[i].text) + 10)), ',')"
    )


SQL = f"""
WITH final AS (
  SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id),
swapped AS (
  SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c LEFT JOIN final f USING (conv_id) 
  WHERE f.turn IS NULL OR c.role IS DISTINCT FROM 'assistant' OR c.turn IS DISTINCT FROM f.turn
  UNION ALL
  SELECT f.conv_id, f.turn, 'assistant', n.text FROM final f JOIN final n ON n.conv_id = xor(f.conv_id, 1)),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn) AS c FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn) AS r FROM swapped GROUP BY conv_id),
both_ AS (SELECT conv_id, c, coalesce(r, []) AS r FROM c LEFT JOIN r USING (conv_id)),
cut AS (
  SELECT *, coalesce(list_min(list_filter(generate_series(1, greatest(len(c), len(r))), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, len(c)) AS n
  FROM both_),
parts AS (SELECT *, c[n + 1:] AS cc, r[n + 1:] AS rr FROM cut)
SELECT conv_id, n::BIGINT AS n_common, {_text('c[1:n]')} AS prompt, {_text('cc')} AS chosen, {_text('rr')} AS rejected,
       {_spans('cc')} AS chosen_mask, {_spans('rr')} AS rejected_mask, c IS DISTINCT FROM r AS differs
FROM parts
"""


def _spelt(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["first"].cast("string"), s["last"].cast("string"))), ",")


def rejected_conversations(turns: DataFrame) -> DataFrame:
    final = turns.where((F.col("role") == "assistant") & F.col("turn").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("_last"))
    exchanged = F.col("role").eqNullSafe(F.lit("assistant")) & F.col("turn").eqNullSafe(F.col("_last.turn"))
    others = turns.join(final, "conv_id", "left").where(F.col("_last").isNull() | ~exchanged)
    other = final.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("_last.text").alias("text"))
    answers = final.join(other, "conv_id").select("conv_id", F.col("_last.turn").alias("turn"), F.lit("assistant").alias("role"), "text")
    return others.select("conv_id", "turn", "role", "text").union(answers)


@register("op8_preference_pairs", SQL)
def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pairs = format_preferences(turns, rejected_conversations(turns))
    return pairs.withColumns({m: _spelt(F.col(m)) for m in ("chosen_mask", "rejected_mask")})
