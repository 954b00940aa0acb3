"""Preference formatting: a chosen and a rejected conversation as one prompt and two completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sides(turns: DataFrame) -> DataFrame:
    """``(pair_id, turns)``: each conversation's turns in order."""
    return (turns.where(F.col("pair_id").isNotNull())
            .groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct(
                "turn", F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text")))).alias("turns")))


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit("<|end|>\n"))), "")


def _mask(turns: Column, trained: str) -> Column:
    """A character of the completion counts (1) if it belongs to a trained role's text or its end mark."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.repeat(F.lit("0"), F.length(_header(t))),
        F.repeat(F.when(t["role"] == trained, "1").otherwise("0"), F.length(t["text"]) + len("<|end|>\n")))), "")


def format_preferences(chosen: DataFrame, rejected: DataFrame, trained: str = "assistant") -> DataFrame:
    """``(pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask)`` of each pair.

    Both tables are ``(pair_id, turn, role, text)``. The longest run of leading turns that both sides
    share (same role and text) is rendered once, as the prompt; what follows is each side's
    completion, with a mask of one digit per character that is 1 where the loss counts.

    A pair is kept when either side has turns: the missing side is empty. Equal sides are all prompt.
    Turns come in the order of (turn, role, text), so repeated turn numbers have a defined order and
    repeated rows are repeated turns; null roles and texts are empty; rows with a null pair id belong
    to no pair. A conversation is one text, so its turns meet in one row.
    """
    left, right = _sides(chosen).withColumnRenamed("turns", "c"), _sides(rejected).withColumnRenamed("turns", "r")
    none = F.expr("array()").cast("array<struct<turn:bigint,role:string,text:string>>")
    both = left.join(right, "pair_id", "full").select(
        "pair_id", *(F.coalesce(F.col(x).cast("array<struct<turn:bigint,role:string,text:string>>"), none).alias(x)
                     for x in "cr"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce(
        (a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, False)
    n = F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("int")
    cut = both.withColumn("n", n).select(
        "pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"),
        F.slice("c", F.col("n") + 1, F.size("c") + 1).alias("c"),
        F.slice("r", F.col("n") + 1, F.size("r") + 1).alias("r"))
    return cut.select(
        "pair_id", F.col("n").alias("n_prompt_turns"), _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("c"), trained).alias("chosen_mask"), _mask(F.col("r"), trained).alias("rejected_mask"))


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs out of plain conversations ``(conv_id, turn, role, text)``.

    Chosen is a conversation up to its last assistant turn; rejected is the same with that turn's
    text taken from the neighbour, the conversation whose id differs in the last bit. Without such
    a neighbour, or one without assistant turns, the rejected side just lacks the reply; a
    conversation without assistant turns is chosen and rejected whole.
    """
    known = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    last = known.where(F.col("role") == "assistant").groupBy("conv_id").agg(
        F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    cut = known.join(last.select("conv_id", F.col("last.turn").alias("at")), "conv_id", "left")
    chosen = cut.where(F.col("at").isNull() | (F.col("turn") <= F.col("at")))
    kept = cut.where(F.col("at").isNull() | (F.col("turn") < F.col("at")))
    donor = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("last.text").alias("text"))
    replies = last.join(donor, "conv_id").select(
        "conv_id", F.col("last.turn").alias("turn"), F.lit("assistant").alias("role"), "text")
    shape = [F.col("conv_id").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    return chosen.select(*shape), kept.select("conv_id", "turn", "role", "text").unionByName(replies).select(*shape)
