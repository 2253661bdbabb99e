"""Entry and exit flags and the price at which they fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def signals(channel: DataFrame) -> DataFrame:
    """Four flags per bar; a missing band raises none."""
    return channel.withColumns(
        {
            "long_entry": _true(F.col("low") <= F.col("lower")),
            "long_exit": _true(F.col("high") >= F.col("mid")),
            "short_entry": _true(F.col("high") >= F.col("upper")),
            "short_exit": _true(F.col("low") <= F.col("mid")),
        }
    )


def fill_price(flagged: DataFrame) -> DataFrame:
    """One price per bar: short entry, then long entry, then either exit."""
    return flagged.withColumn(
        "px",
        F.when(F.col("short_entry"), F.col("upper"))
        .when(F.col("long_entry"), F.col("lower"))
        .when(F.col("short_exit") | F.col("long_exit"), F.col("mid")),
    )
