"""Preference formatting of chosen and rejected conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPANS = "array<struct<start:int,end:int>>"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Where a completion counts for the loss: each assistant turn's text with its end mark."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        start = state["at"] + F.char_length(turn["role"]) + F.lit(5)
        end = start + F.char_length(turn["text"]) + F.lit(7)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        kept = F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), kept.alias("spans"))

    return F.aggregate(turns, begin, add)["spans"]


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """One row per pair of conversations that has both sides.

    ``turns`` has ``conv_id, turn, role, text``; ``pair`` names a row's pair and ``chosen`` tells
    its side. The longest common prefix of turns (same role and text) is rendered once as
    ``prompt``; what follows it is each side's completion, with the character ranges of its
    assistant turns as mask. Columns: ``pair_id, chosen_id, rejected_id, n_prefix, prompt,
    chosen, rejected, chosen_mask, rejected_mask``.

    Turns are ordered by number, then role and text; rows with the same number all count. A null
    number comes first, a null role is ``unknown`` and a null text empty. Rows whose pair or side
    is null, and pairs with one side only, give nothing. Other columns are ignored. With several
    conversations on one side, the smallest ``conv_id`` names the side and its turns alone count.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = turns.select(
        pair.alias("pair_id"), chosen.alias("side"), F.col("conv_id"), turn.alias("turn")
    ).where("pair_id IS NOT NULL AND side IS NOT NULL AND conv_id IS NOT NULL")
    sides = (
        rows.groupBy("pair_id", "side", "conv_id")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        .groupBy("pair_id")
        .agg(
            *(
                F.min(F.when(F.col("side") == side, F.struct("conv_id", "turns"))).alias(name)
                for name, side in (("a", F.lit(True)), ("b", F.lit(False)))
            )
        )
        .where("a IS NOT NULL AND b IS NOT NULL")
    )
    a, b = F.col("a.turns"), F.col("b.turns")
    differs = F.zip_with(
        a, b, lambda x, y: ~(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    )
    first = F.array_position(differs, True)
    prefix = F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")
    counted = sides.withColumn("n_prefix", prefix)
    n = F.col("n_prefix")
    rest = counted.select(
        "pair_id",
        F.col("a.conv_id").alias("chosen_id"),
        F.col("b.conv_id").alias("rejected_id"),
        "n_prefix",
        _text(F.slice(a, F.lit(1), n)).alias("prompt"),
        F.slice(a, n + 1, F.size(a)).alias("a"),
        F.slice(b, n + 1, F.size(b)).alias("b"),
    )
    return rest.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_prefix",
        "prompt",
        _text(F.col("a")).alias("chosen"),
        _text(F.col("b")).alias("rejected"),
        _mask(F.col("a")).alias("chosen_mask"),
        _mask(F.col("b")).alias("rejected_mask"),
    )


def with_other_replies(turns: DataFrame) -> DataFrame:
    """The conversations (``conv_id, turn, role, text``) with the last assistant turn's text taken from
    that of the conversation with the next id: replies that don't answer what was said.

    The reply is empty where there is no such conversation or it has no assistant turn. Without an
    assistant turn a conversation stays as it is. The last turn is that of the greatest number, then
    text; equal rows change alike. Nulls are read as in :func:`preference_pairs`; rows without
    ``conv_id`` give nothing.
    """
    said = turns.where("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    last = said.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other"))
    is_last = (
        (F.col("role") == "assistant")
        & F.col("turn").eqNullSafe(F.col("last.turn"))
        & (F.col("text") == F.col("last.text"))
    )
    return (
        said.join(last.join(other, "conv_id", "left"), "conv_id", "left")
        .withColumn("text", F.when(is_last, F.coalesce("other", F.lit(""))).otherwise(F.col("text")))
        .select("conv_id", "turn", "role", "text")
    )


def mask_text(spans: Column) -> Column:
    """Ranges as ``start:end`` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","
    )
