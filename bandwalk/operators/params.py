"""Parameter grids and samples. Values are integer steps times a scale."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bandwalk.defaults import DEFAULTS


class Axis(NamedTuple):
    """``size`` values ``(first + k*step) / unit`` of one parameter."""

    name: str
    first: int
    step: int
    size: int
    unit: int = 1

    def value(self, k: Column) -> Column:
        n = F.lit(self.first) + k * self.step
        if self.name.endswith("window"):
            return n.cast("int").alias(self.name)
        return (n / F.lit(float(self.unit))).alias(self.name)


# The production grid (8,250 combinations).
GRID = (
    Axis("ma_window", 20, 20, 10),
    Axis("atr_window", 10, 20, 11),
    Axis("atr_mult", 2, 1, 15, 2),
    Axis("sl_stop", 2, 2, 5, 100),
)
# The stepped research space.
RESEARCH_SPACE = (
    Axis("ma_window", 10, 5, 99),
    Axis("atr_window", 5, 5, 20),
    Axis("atr_mult", 2, 1, 39, 4),
    Axis("sl_stop", 1, 1, 15, 100),
)


def size_of(axes: Sequence[Axis]) -> int:
    total = 1
    for axis in axes:
        total *= axis.size
    return total


def _decode(index: Column, axes: Sequence[Axis]) -> list[Column]:
    """Mixed-radix digits of ``index``, last axis fastest."""
    columns, below = [], 1
    for axis in reversed(axes):
        digit = F.pmod(F.floor(index / below), F.lit(axis.size))
        columns.append(axis.value(digit))
        below *= axis.size
    return columns[::-1]


def param_grid(spark: SparkSession, axes: Sequence[Axis] = GRID) -> DataFrame:
    """The full grid, one row per combination, numbered by ``combo_id``."""
    ids = spark.range(size_of(axes)).select(F.col("id").cast("int").alias("combo_id"))
    return ids.select("combo_id", *_decode(F.col("combo_id"), axes))


def param_sample(
    windows: DataFrame, n: int = DEFAULTS.n_trials, seed: int = 42,
    axes: Sequence[Axis] = RESEARCH_SPACE, keys: Sequence[str] = ("split",),
) -> DataFrame:
    """The first ``n`` combinations of a permutation keyed by (seed, window).

    All combinations are numbered and each window has its own permutation of the numbers, so the
    sample is exact, distinct, and the start of any larger sample of the same seed. The
    permutation treats a number as a pair of digits and shifts each digit in turn by a
    hash of the other (the leading 48 bits of an MD5, so other engines can repeat it).
    """
    total = size_of(axes)
    high, low = size_of(axes[: len(axes) // 2]), size_of(axes[len(axes) // 2 :])
    drawn = windows.select(*keys).withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.lit(min(n, total) - 1)))
    )
    drawn = drawn.withColumns(
        {"_h": F.floor(F.col("_k") / low).cast("bigint"), "_l": F.pmod("_k", F.lit(low)).cast("bigint")}
    )

    def shift(column: str, by: str, size: int, turn: int) -> Column:
        text = F.concat_ws(
            ":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.lit(str(turn)),
            F.col(by).cast("string"),
        )
        hashed = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
        return F.pmod(F.col(column) + hashed, F.lit(size))

    for turn in range(4):
        column, by, size = ("_l", "_h", low) if turn % 2 == 0 else ("_h", "_l", high)
        drawn = drawn.withColumn(column, shift(column, by, size, turn))
    index = F.col("_h") * low + F.col("_l")
    return drawn.select(*keys, F.col("_k").cast("int").alias("combo_id"), *_decode(index, axes))
