"""Preference formatting: one prompt, two masked completions.

A pair names a chosen and a rejected conversation.  Their longest common prefix
of turns (equal role and text) is rendered once, as the prompt; what follows it
in either conversation is a completion.  A completion carries spans of its
characters, ``start-end`` from 0 and end-exclusive, over the contents and end
marks of the turns of trained roles; a loss mask is 1 inside spans only.

Turns meet by pair in one shuffle; a conversation, which is one record of the
result, is what a task holds at once.

Edge cases: turns stand in order of (turn, role, text), nulls first, and
repeated rows are turns of their own; a null text is empty and a null role is
``unknown``; a pair of which one side is missing has an empty prompt and null on
that side; equal conversations have empty completions; turns without a
conversation id, and conversations in no pair, are in no result; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _spans(turns: Column, trained: tuple[str, ...]) -> Column:
    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(_head(t))
        stop = start + F.length(t["text"]) + len(END)
        mine = F.concat_ws("-", start.cast("string"), stop.cast("string"))
        spans = F.when(t["role"].isin(*trained), F.concat(state["spans"], F.array(mine))).otherwise(state["spans"])
        return F.struct(stop.alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, start, step, lambda s: F.array_join(s["spans"], ","))


def format_preferences(turns: DataFrame, pairs: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """pairs (pair_id, chosen_id, rejected_id) as prompt and completions."""
    sides = pairs.select("pair_id", F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(f"{c}_id").alias("conv_id")) for c in ("chosen", "rejected")])).alias("s"))
    said = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = said.join(sides.select("pair_id", "s.side", "s.conv_id"), "conv_id")
    return _formatted(rows, trained)


def _formatted(rows: DataFrame, trained: tuple[str, ...]) -> DataFrame:
    """From rows (pair_id, side, conv_id, turn, role, text)."""
    turn = F.struct("turn", "role", "text")
    both = rows.groupBy("pair_id").agg(
        *[F.max(F.when(F.col("side") == c, F.col("conv_id"))).alias(f"{c}_id") for c in ("chosen", "rejected")],
        *[F.array_sort(F.collect_list(F.when(F.col("side") == c, turn))).alias(c) for c in ("chosen", "rejected")],
    )
    bare = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    both = both.withColumns({c: bare(c) for c in ("chosen", "rejected")})
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    common = F.aggregate(
        F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda n, i: F.when((n == i) & (F.get("chosen", i) == F.get("rejected", i)), n + 1).otherwise(n),
    )
    both = both.withColumn("prefix_turns", common)
    out = both.select("pair_id", "chosen_id", "rejected_id", "prefix_turns", _rendered(F.slice("chosen", F.lit(1), F.col("prefix_turns"))).alias("prompt"), "chosen", "rejected")
    for c in ("chosen", "rejected"):
        rest = F.slice(F.col(c), F.col("prefix_turns") + 1, F.size(c))
        there = F.col(f"{c}_id").isNotNull()
        out = out.withColumns({f"{c}_spans": F.when(there, _spans(rest, trained)), c: F.when(there, _rendered(rest))})
    return out


def format_neighbours(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Pairs by number: 2j is the chosen conversation of pair j, 2j+1 the
    rejected one.  As the pair follows from the id, turns cross one shuffle."""
    conv = F.col("conv_id")
    rows = turns.filter(conv.isNotNull()).select(
        F.expr("conv_id - pmod(conv_id, 2L)").alias("base"), "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    side = F.when(F.col("conv_id") == F.col("base"), "chosen").otherwise("rejected")
    return _formatted(rows.select(F.expr("base div 2").alias("pair_id"), side.alias("side"), "conv_id", "turn", "role", "text"), trained)
