"""Cumulative snapshots of conversations: prefix hashes, anti-join, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 1024
PART = 64


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """(conv, block, pos, n, role, text, x, y): place from 1, turns in the conversation, rolling prefix hashes.

    The prefix hash after turn i is the exclusive or of a hash of (place, role, text) of the
    turns up to i, so it can be summed in blocks of 1,024 consecutive turn numbers: turns are
    sorted within a block, and only one row per block is accumulated along a conversation.
    A conversation of any length is spread over its blocks.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    ).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    along = Window.partitionBy("conv").orderBy("block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def with_blocks(df: DataFrame, blocks: DataFrame) -> DataFrame:
        b = blocks.withColumnsRenamed({"conv": "b_conv", "block": "b_block"})
        return df.join(b, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block"))).drop("b_conv", "b_block")

    counts = rows.groupBy("conv", "block").agg(F.count("*").alias("c")).select(
        "conv", "block", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("base"), F.sum("c").over(whole).alias("n"))
    placed = with_blocks(rows.withColumn("pos", F.row_number().over(inside)), counts).withColumn("pos", F.col("pos") + F.col("base"))
    parts = [F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    hashed = placed.withColumn("x", F.xxhash64("pos", *parts)).withColumn("y", F.xxhash64(F.lit(1), *reversed(parts), "pos"))
    upto = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = hashed.groupBy("conv", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by")).select(
        "conv", "block", F.coalesce(F.bit_xor("bx").over(earlier), F.lit(0)).alias("ex"),
        F.coalesce(F.bit_xor("by").over(earlier), F.lit(0)).alias("ey"))
    rolled = hashed.withColumn("x", F.bit_xor("x").over(upto)).withColumn("y", F.bit_xor("y").over(upto))
    return with_blocks(rolled, totals).select(
        "conv", "block", "pos", "n", "role", "text",
        F.col("x").bitwiseXOR(F.col("ex")).alias("x"), F.col("y").bitwiseXOR(F.col("ey")).alias("y"))


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv, n, copies): conversations that are no prefix of a longer one; of equal ones the smallest id.

    Equal conversations and equal prefixes are aggregated before they meet, so neither a
    common first turn nor a conversation logged very often makes a skewed join key.
    """
    full = rolled.filter("pos = n").groupBy("n", "x", "y").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    shorter = rolled.filter("pos < n").select(F.col("pos").alias("n"), "x", "y").distinct()
    return full.join(shorter, ["n", "x", "y"], "left_anti").select("conv", "n", "copies")


def rendered_turn(role: Column, text: Column) -> Column:
    """A turn between markers; ``<|`` inside a text or role is widened so that it can't act as one."""
    plain = lambda c, other: F.replace(F.coalesce(c, F.lit(other)), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), plain(role, "unknown"), F.lit("\n"), plain(text, ""), F.lit("<|im_end|>\n"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, copies, text): maximal conversations, rendered in parts of up to 64 turns.

    Parts 0, 1, ... of a conversation in a row are its whole text; conversations of up to 64
    turns have one. ``copies`` counts the conversations with the same turns.

    Turns are ordered by number, null first; repeated numbers by role and text. Null roles
    render as ``unknown``, null texts as empty, and both differ from equal strings in the
    comparison. Turns without conversation id form one conversation of their own. Repeated
    rows are turns of their own. An empty table gives no rows. Other columns are ignored.
    """
    rolled = numbered(turns, conv_col, turn_col, role_col, text_col)
    kept = maximal(rolled).withColumnRenamed("conv", "kept").withColumnRenamed("n", "n_turns")
    body = rolled.select("conv", "pos", rendered_turn(F.col("role"), F.col("text")).alias("turn_text"))
    joined = body.join(kept, F.col("conv").eqNullSafe(F.col("kept")))
    part = F.floor((F.col("pos") - 1) / PART).cast("int")
    return (
        joined.groupBy(F.col("kept").alias(conv_col), part.alias("part"), "n_turns", "copies")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "turn_text"))).alias("turns"))
        .select(conv_col, "part", "n_turns", "copies",
                F.array_join(F.transform("turns", lambda t: t["turn_text"]), "").alias("text"))
    )
