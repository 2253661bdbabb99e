"""Ordered series cut into blocks.

A bar series is a set of rows per key in time order. Nothing here gives a whole
series to one task: rows are numbered chunk by chunk, sorted block by block, and
what has to cross a block edge (a row count, a running total, the state of a
recursive mean) travels as one small row per block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from bandwalk.defaults import BLOCK_BARS

KEYS = ("symbol",)
PRICES = ("open", "high", "low", "close")


def with_position(
    bars: DataFrame,
    bar_seconds: int | Column,
    keys: Sequence[str] = KEYS,
    block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Add ``pos`` (0-based rank in time) and ``len`` (bars in the series).

    (key, ts) is unique, so a time chunk of ``block_bars`` bar lengths cannot hold
    more than ``block_bars`` rows whatever the length of the series. ``bar_seconds`` may be
    an expression over the key columns when timeframes are mixed.

    A bar without time, bar length or one of its four prices is an error: means, positions
    and equity have no defined value after it. ``sources.candles.complete`` drops and
    ``incomplete`` reports such bars.
    """
    keys = list(keys)
    span = F.lit(bar_seconds).cast("bigint") * block_bars
    chunk = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / span)
    whole = span.isNotNull() & F.col("ts").isNotNull()
    for price in PRICES:
        if price in bars.columns:
            whole = whole & F.col(price).isNotNull() & ~F.isnan(F.col(price).cast("double"))
    chunked = bars.withColumn(
        "_chunk",
        F.when(whole, chunk).otherwise(
            F.raise_error(F.lit("a bar lacks its time, length or a price")).cast("bigint")
        ),
    )
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    offsets = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_n"))
        .select(
            *keys,
            "_chunk",
            F.coalesce(
                F.sum("_n").over(over_chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_offset"),
            F.sum("_n").over(Window.partitionBy(*keys)).alias("len"),
        )
    )
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy("ts")
    return (
        chunked.join(offsets, [*keys, "_chunk"])
        .withColumn("pos", F.col("_offset") + F.row_number().over(in_chunk) - 1)
        .drop("_chunk", "_offset")
    )


def overlapping_blocks(
    series: DataFrame, lookback: int, block_bars: int = BLOCK_BARS
) -> DataFrame:
    """Copy each row into its own block and into those that look back at it.

    Block ``b`` owns positions [b*block_bars, (b+1)*block_bars) and also sees the
    ``lookback`` rows before them, flagged ``own = false``.
    """
    home = F.floor(F.col("pos") / block_bars)
    last = F.floor(F.least(F.col("pos") + lookback, F.col("len") - 1) / block_bars)
    return series.withColumn("blk", F.explode(F.sequence(home, last))).withColumn(
        "own", F.col("blk") == home
    )


def block_order(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys, "blk").orderBy("pos")


def windowed(
    series: DataFrame,
    columns,
    lookback: int,
    keys: Sequence[str] = KEYS,
    block_bars: int = BLOCK_BARS,
    keep_block: bool = False,
) -> DataFrame:
    """Add ordered-window columns that look back at most ``lookback`` rows.

    ``columns`` is a list of callables ``df, window -> df``; all of them share one
    shuffle and one sort. With ``keep_block`` the block number stays, so that
    ``recursive_means`` can go on in the same partitioning.
    """
    framed = overlapping_blocks(series, lookback, block_bars)
    order = block_order(keys)
    for add in columns:
        framed = add(framed, order)
    out = framed.filter("own").drop("own")
    return out if keep_block else out.drop("blk")


def carried(
    df: DataFrame,
    index: str,
    totals: dict[str, tuple[str, str]],
    keys: Sequence[str] = KEYS,
    block_rows: int = BLOCK_BARS,
) -> DataFrame:
    """Running aggregate over the rows strictly before each row.

    ``totals`` maps an output column to (``"sum"`` | ``"max"`` | ``"last"``, input column);
    ``last`` is the latest value that is not NULL. ``index`` is a dense integer order. Each
    block is aggregated once, the block totals are accumulated per key, and rows add their
    in-block prefix.
    """
    keys = list(keys)

    def latest(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(index)))

    per_block = {"sum": F.sum, "max": F.max, "last": latest}
    fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    join2 = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "max": lambda a, b: F.greatest(a, b),
        "last": lambda a, b: F.coalesce(b, a),
    }
    blocked = df.withColumn("_blk", F.floor(F.col(index) / block_rows))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        blocked.groupBy(*keys, "_blk")
        .agg(*[per_block[how](col).alias(f"_t_{out}") for out, (how, col) in totals.items()])
        .select(
            *keys,
            "_blk",
            *[fold[how](f"_t_{o}").over(before).alias(f"_c_{o}") for o, (how, _) in totals.items()],
        )
    )
    inside = (
        Window.partitionBy(*keys, "_blk").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = blocked.join(carry, [*keys, "_blk"])
    for name, (how, col) in totals.items():
        out = out.withColumn(name, join2[how](F.col(f"_c_{name}"), fold[how](col).over(inside)))
    return out.drop("_blk", *[f"_c_{o}" for o in totals])


class Recursive(NamedTuple):
    """One exponential mean: ``e = alpha*x + (1-alpha)*e``, seeded with the first value."""

    out: str
    source: str
    alpha: float
    window: int


def blocks_until_vanished(alpha: float, block_bars: int) -> int:
    """Blocks after which a value's weight is below the smallest double."""
    return max(1, math.ceil(746.0 / (block_bars * -math.log1p(-alpha)))) if alpha < 1 else 1


def seeded_weight(alpha: Column, pos: Column, last: Column) -> Column:
    """Weight of the value at ``pos`` in the mean standing at ``last``."""
    return F.when(pos == 0, F.lit(1.0)).otherwise(alpha) * F.pow(1 - alpha, last - pos)


def recursive_means(
    series: DataFrame,
    means: Sequence[Recursive],
    lagged: bool = False,
    keys: Sequence[str] = KEYS,
    block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Add exponential means, NULL for the first ``window - 1`` bars.

    The mean standing at the end of a block is a weighted sum of that block plus a
    decayed carry, so blocks are summed in parallel, the carry runs over one row per
    block, and every block is then finished on its own. With ``lagged`` the value is
    the one known before the bar opens.
    """
    keys = list(keys)
    means = list(means)
    cut = series
    if "blk" not in series.columns:
        cut = series.withColumn("blk", F.floor(F.col("pos") / block_bars))
    last = F.least((F.col("blk") + 1) * block_bars, F.col("len")) - 1
    sums = cut.groupBy(*keys, "blk").agg(
        *[
            F.sum(seeded_weight(F.lit(m.alpha), F.col("pos"), last) * F.col(m.source)).alias(
                f"_s_{m.out}"
            )
            for m in means
        ]
    )
    order = Window.partitionBy(*keys).orderBy("blk")

    def carry(m: Recursive) -> Column:
        reach = blocks_until_vanished(m.alpha, block_bars)
        decay = (1 - m.alpha) ** block_bars
        past = F.collect_list(f"_s_{m.out}").over(order.rowsBetween(-reach, -1))
        return F.when(
            F.col("blk") > 0, F.aggregate(past, F.lit(0.0), lambda acc, s: acc * decay + s)
        ).alias(f"_c_{m.out}")

    carries = sums.select(*keys, "blk", *[carry(m) for m in means])
    schema = T.StructType(
        [f for f in series.schema.fields if f.name != "blk"]
        + [T.StructField(m.out, T.DoubleType()) for m in means]
    )
    names = schema.fieldNames()

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        start = int(rows["pos"].iloc[0])
        for m in means:
            head = rows[f"_c_{m.out}"].iloc[0] if start > 0 else None
            rows[m.out] = exponential(
                rows[m.source].to_numpy(), m.alpha, m.window, start, head, lagged
            )
        return rows[names]

    return (
        cut.join(carries, [*keys, "blk"]).groupBy(*keys, "blk").applyInPandas(finish, schema)
    )


def exponential(
    x: np.ndarray, alpha: float, window: int, start: int, head: float | None, lagged: bool
) -> np.ndarray:
    """Exponential mean of one block that starts at ``start`` with carry ``head``."""
    if head is None:
        mean = pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()
        full = np.concatenate([[np.nan], mean])
    else:
        full = (
            pd.Series(np.concatenate([[head], x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()
        )
    out = full[:-1].copy() if lagged else full[1:].copy()
    known = start + np.arange(len(out)) - (1 if lagged else 0)
    out[known < window - 1] = np.nan
    return out
