"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bandwalk.session import settled

BLANKS = "\t\n\x0b\x0c\r"
COARSE = 4096
MOST_SENT = 100_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; 0 for null."""
    spaced = F.translate(text, BLANKS, " " * len(BLANKS))
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda w: w != "")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int, total: Column | None = None) -> DataFrame:
    """Water level per source. ``sizes``: (source, source_size), one row per source.

    A source's weight is the next of ``weights``, repeating, in order of code points with
    null last. Sources in order of cap / weight are full up to some point; the others share
    what is left in proportion to their weights. That level is where clamping and
    resharing, repeated until no target is above its cap, ends.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    cap = F.col("source_size") * max_epochs
    return (
        sizes.withColumn("weight", weight)
        .withColumn("total", total if total is not None else F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(cap).over(earlier), F.lit(0)))
                    / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
        .withColumn("full", cap <= F.col("level") * F.col("weight"))
        # the level of the first source that is not full holds for all later ones
        .withColumn("level", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(everything_in(fill)))
        .withColumn("target", F.when(F.col("full"), cap.cast("double")).otherwise(F.col("level") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def everything_in(order):
    return order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 0, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, size, source_size, target, copies, taken) per row of ``docs``; ``row`` is the row itself.

    Sizes are words. The targets share the size of the whole table among the sources, with
    at most ``max_epochs`` times its size for each. A source at ratio r of its size takes
    every document floor(r) times, and once more the documents that come first in an order
    by a hash of seed and id, until their words reach what is missing; the last one is taken
    if that comes nearer. So a source misses its target by half a document at most, and no
    document is taken more than ``max_epochs`` times.

    The order is found in two steps: sums over 4,096 ranges of the hash per source, which are
    aggregated before they move, name the one range that is taken in part, and only that
    range is sorted. Sources meet in one task as one row each.

    Null sources are a source of their own, last in order. Null, empty and blank texts have
    size 0; they are taken 0 words whatever their copies. Equal ids share a hash and are
    ordered by size; equal rows are interchangeable. If all sizes are 0, every target is 0.
    An empty table gives no rows. Columns of ``docs`` are only carried inside ``row``.
    """
    digits = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    base = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.conv(F.substring(digits, 1, 13), 16, 10).cast("bigint").alias("hash"),
    ).withColumn("range", F.shiftright("hash", 40))

    ranges = base.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    sizes = ranges.groupBy("source").agg(F.sum("range_size").cast("bigint").alias("source_size"))
    level = targets(sizes, weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    level = level.withColumn("whole", F.floor(ratio).cast("bigint")).withColumn(
        "missing", F.col("target") - F.col("whole") * F.col("source_size"))
    before = F.coalesce(F.sum("range_size").over(
        Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = (
        ranges.withColumn("before", before).withColumnRenamed("source", "s")
        .join(level, F.col("s").eqNullSafe(F.col("source")))
        .filter((F.col("before") <= F.col("missing")) & (F.col("before") + F.col("range_size") > F.col("missing")))
        .select(F.col("s").alias("edge_source"), F.col("range").alias("edge"), F.col("before").alias("edge_before"))
    )
    # where no range is cut (nothing is missing beyond the last one), all ranges are taken
    level = settled(level.join(edge, F.col("source").eqNullSafe(F.col("edge_source")), "left").select(
        F.col("source").alias("level_source"), "source_size", "target", "whole", "missing",
        F.coalesce("edge", F.lit(COARSE)).alias("edge"), F.coalesce("edge_before", F.lit(0)).alias("edge_before")))
    joined = _with_levels(base, level)
    cut = joined.filter(F.col("range") == F.col("edge"))
    upto = F.coalesce(F.sum("size").over(
        Window.partitionBy("source").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("more", (2.0 * (F.col("edge_before") + upto) + F.col("size") <= 2.0 * F.col("missing")).cast("int"))
    rest = joined.filter(F.col("range") != F.col("edge")).withColumn("more", (F.col("range") < F.col("edge")).cast("int"))
    return rest.unionByName(cut).select(
        "row", "doc_id", "size", "source_size", "target",
        (F.col("whole") + F.col("more")).cast("int").alias("copies"),
        (F.col("size") * (F.col("whole") + F.col("more"))).cast("bigint").alias("taken"))


def _with_levels(base: DataFrame, level: DataFrame) -> DataFrame:
    """Each row with the level of its source; the rows of a large source stay spread.

    The levels are counted first. Up to ``MOST_SENT`` sources (about 8 MB) they are sent to
    all tasks and no document moves; more of them are joined on source and a salt.
    """
    same = F.col("source").eqNullSafe(F.col("level_source"))
    if level.count() <= MOST_SENT:
        return base.join(F.broadcast(level), same)
    salted = level.withColumn("level_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return base.withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int")).join(
        salted, same & (F.col("salt") == F.col("level_salt"))).drop("salt", "level_salt")


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of a mix, each as often as it is taken."""
    return mixed.filter("copies > 0").select("row", F.explode(F.expr("sequence(1, copies)"))).select("row.*")
