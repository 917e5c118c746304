"""Chat formatting of preference pairs.

The turns that a chosen and a rejected conversation have in common from the
start are rendered once as the prompt; what follows are two completions with
masks that leave only assistant turns to learn from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import pick

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def _rendered(turn: Column) -> Column:
    return F.concat(_head(turn), turn["text"], F.lit(CLOSE + "\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column, learn: str) -> Column:
    """Spans (first, last) in code points, last exclusive: text and closing mark of each turn to learn from."""
    kind = "array<struct<first:bigint,last:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        first = state["at"] + F.char_length(_head(turn))
        last = first + F.char_length(turn["text"]) + len(CLOSE)
        span = F.array(F.struct(first.cast("long").alias("first"), last.cast("long").alias("last")))
        return F.struct(
            (last + 1).cast("long").alias("at"),
            F.when(turn["role"] == learn, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_preferences(
    chosen: DataFrame,
    rejected: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn: str = "assistant",
) -> DataFrame:
    """One row per key of either side: ``key, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask, differs``.

    Both tables hold turns; a key names the same pair in both. Turns lie in the
    order of turn number (nulls first), then role, then text, and a repeated
    turn counts again. A null role or text is an empty one; a null key is a pair of its own. A side
    without turns has an empty completion and nothing in common with the other.
    ``differs`` is false where both conversations are equal: there is no
    preference to learn. Both sides meet in one shuffle; a pair is a row, as
    long as its conversations are. Other columns are not read.
    """

    def side(df: DataFrame, is_chosen: bool) -> DataFrame:
        turns = pick(df, key, turn, role, text).toDF("_key", "_turn", "_role", "_text")
        said = F.struct(
            F.col("_turn").alias("turn"),
            F.coalesce("_role", F.lit("")).alias("role"),
            F.coalesce("_text", F.lit("")).alias("text"),
        )
        return turns.select("_key", F.lit(is_chosen).alias("_chosen"), said.alias("_said"))

    pairs = side(chosen, True).unionByName(side(rejected, False)).groupBy("_key").agg(
        *[
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("_chosen") == wanted, F.col("_said")))),
                lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")),
            ).alias(name)
            for wanted, name in ((True, "_c"), (False, "_r"))
        ]
    )
    split = F.array_position(F.zip_with("_c", "_r", lambda a, b: a.eqNullSafe(b)), False)
    pairs = pairs.withColumn("_n", F.when(split == 0, F.size("_c")).otherwise(split - 1).cast("int"))

    def rest(name: str) -> Column:
        return F.slice(F.col(name), F.col("_n") + 1, F.greatest(F.size(name) - F.col("_n"), F.lit(0)))

    return pairs.select(
        F.col("_key").alias(key),
        F.col("_n").cast("long").alias("n_common"),
        _joined(F.slice(F.col("_c"), F.lit(1), F.col("_n"))).alias("prompt"),
        _joined(rest("_c")).alias("chosen"),
        _joined(rest("_r")).alias("rejected"),
        _mask(rest("_c"), learn).alias("chosen_mask"),
        _mask(rest("_r"), learn).alias("rejected_mask"),
        (split != 0).alias("differs"),
    )
