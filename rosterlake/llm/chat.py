"""Cumulative-snapshot collapse of logged conversations, then rendering. DataFrame only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Marks around a turn; inside a text they are broken by a backslash, so a turn can't forge one.
OPEN, CLOSE = "<|", "|>"


def turns_with_prefixes(conversations: DataFrame) -> DataFrame:
    """One row per turn with its place (from 1) and the hash of all turns up to it.

    Two independent 64-bit hashes of (place, role, text) are folded by XOR over the
    ordered window; as the place is hashed too, order matters. Null roles and texts
    hash apart from empty ones. Rows repeated in all columns count once; turns with
    equal numbers stand in order of role and text. Rows without conv_id are left out.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = (
        turns.withColumn("place", F.dense_rank().over(order))
        .withColumn("before", F.lag("place", 1, 0).over(order))
        .where("place > before")
        .drop("before")
    )
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def mark(salt: int) -> Column:
        return F.xxhash64(
            F.lit(salt), "place", F.col("role").isNull(), F.coalesce("role", F.lit("")),
            F.col("text").isNull(), F.coalesce("text", F.lit("")),
        )

    return placed.select(
        "*",
        F.bit_xor(mark(1)).over(upto).alias("h1"),
        F.bit_xor(mark(2)).over(upto).alias("h2"),
        F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"),
    )


def maximal_conversations(prefixed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same) of conversations that no other one extends.

    Equal conversations keep the smallest conv_id; n_same counts them. The table of
    proper prefixes is pre-aggregated, so a first turn that opens a third of all
    conversations is one row of it.
    """
    whole = (
        prefixed.where("place = n_turns")
        .groupBy("place", "h1", "h2")
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    )
    proper = prefixed.where("place < n_turns").select("place", "h1", "h2").distinct()
    return whole.join(proper, ["place", "h1", "h2"], "left_anti").select(
        "conv_id", F.col("place").cast("bigint").alias("n_turns"), "n_same"
    )


def _plain(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(OPEN), F.lit("<\\|")), F.lit(CLOSE), F.lit("|\\>"))


def render_chats(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_same, chat.

    A turn is ``<|role|>\\ntext<|end|>``; turns are joined by line breaks. Null roles
    render as ``unknown``, null texts as nothing. An empty table gives no rows.
    """
    prefixed = turns_with_prefixes(conversations)
    best = maximal_conversations(prefixed)
    turn = F.concat(
        F.lit(OPEN), _plain(F.coalesce("role", F.lit("unknown"))), F.lit(CLOSE + "\n"),
        _plain(F.col("text")), F.lit(OPEN + "end" + CLOSE),
    )
    lines = prefixed.select("conv_id", F.struct("place", turn.alias("line")).alias("turn"))
    return (
        lines.join(best, "conv_id")
        .groupBy("conv_id")
        .agg(
            F.first("n_turns").alias("n_turns"),
            F.first("n_same").alias("n_same"),
            F.array_join(F.transform(F.sort_array(F.collect_list("turn")), lambda t: t["line"]), "\n").alias("chat"),
        )
    )
