"""Order-book liquidity: spread, depth, slippage, score and ranking.

A book may be of any depth: its levels are read in blocks of ``BLOCK_LEVELS``, and what one market
brings together in one place is a row per block. Levels are numbered from 1 without repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bandwalk.defaults import DEFAULTS
from bandwalk.functions.scalars import num_or_zero
from bandwalk.operators.ranking import ranked
from bandwalk.session import settled

BLOCK_LEVELS = 1024

# Fixed values of the score formula.
SPREAD_POINTS, SPREAD_FULL = 25.0, 0.5
DEPTH1_POINTS, DEPTH1_SLOPE = 25.0, 5.0
DEPTH5_POINTS, DEPTH5_SLOPE = 15.0, 3.0
SLIP_POINTS, SLIP_FULL = 15.0, 1.0
ACTIVITY_POINTS, ACTIVITY_SLOPE = 10.0, 1.43


def top_of_book(book: DataFrame) -> DataFrame:
    """Best prices, mid and spread; a market with an empty side is dropped."""

    def best(side: str) -> Column:
        return F.min_by(F.when(F.col("side") == side, F.col("price")),
                        F.when(F.col("side") == side, F.col("lvl")))

    return (
        book.groupBy("market_id")
        .agg(best("bid").alias("best_bid"), best("ask").alias("best_ask"))
        .filter(F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull())
        .withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)
        .withColumn("spread_pct", (F.col("best_ask") - F.col("best_bid")) / F.col("mid") * 100)
    )


def depth(book: DataFrame, pcts: Sequence[float] = DEFAULTS.depth_pcts) -> DataFrame:
    """USD resting within each percentage of mid: ask, bid and total."""
    usd = F.col("price") * F.col("size")
    near_ask = (F.col("side") == "ask") & (F.col("price") <= F.col("mid") * (1 + F.col("pct") / 100))
    near_bid = (F.col("side") == "bid") & (F.col("price") >= F.col("mid") * (1 - F.col("pct") / 100))
    return (
        book.join(top_of_book(book).select("market_id", "mid"), "market_id")
        .withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in pcts])))
        .groupBy("market_id", "pct")
        .agg(
            F.sum(F.when(near_ask, usd).otherwise(0.0)).alias("ask_usd"),
            F.sum(F.when(near_bid, usd).otherwise(0.0)).alias("bid_usd"),
        )
        .withColumn("total_usd", F.col("ask_usd") + F.col("bid_usd"))
    )


def slippage(
    book: DataFrame, sizes: Sequence[int] = DEFAULTS.slippage_usd, block_levels: int = BLOCK_LEVELS
) -> DataFrame:
    """Cost of walking the book with a market order of each size, per side and averaged."""

    def costs(asks: Column, bids: Column) -> Column:
        buy, sell = ([_cost(side, i, F.col("mid")) for i in range(len(sizes))] for side in (asks, bids))
        return F.array(*[
            F.struct(
                F.lit(int(usd)).alias("usd"),
                buy[i].alias("slip_buy"),
                sell[i].alias("slip_sell"),
                (asks[i]["spent"] / usd * 100).alias("fill_buy"),
                (bids[i]["spent"] / usd * 100).alias("fill_sell"),
                ((buy[i] + sell[i]) / 2).alias("slip_avg"),
            )
            for i, usd in enumerate(sizes)
        ])

    walked = _walked_book(book, sizes, (), block_levels)
    return walked.select("market_id", F.inline(costs(F.col("asks"), F.col("bids"))))


def _log_points(value: Column, points: float, slope: float) -> Column:
    return F.least(F.lit(points), F.log10(F.greatest(F.lit(1.0), value)) * slope)


def liquidity_score(
    spread: Column, depth1: Column, depth5: Column, slip: Column, volume: Column, oi: Column
) -> Column:
    """0 to 100 points from spread, depth, slippage and activity."""
    return (
        F.greatest(F.lit(0.0), (1 - spread / SPREAD_FULL) * SPREAD_POINTS)
        + _log_points(depth1, DEPTH1_POINTS, DEPTH1_SLOPE)
        + _log_points(depth5, DEPTH5_POINTS, DEPTH5_SLOPE)
        + F.greatest(F.lit(0.0), (1 - slip / SLIP_FULL) * SLIP_POINTS)
        + _log_points(volume, ACTIVITY_POINTS, ACTIVITY_SLOPE)
        + _log_points(oi, ACTIVITY_POINTS, ACTIVITY_SLOPE)
    )


def _filled(levels: Column, usd: float, before: Column) -> Column:
    """What an order of ``usd`` takes from one side of a block when ``before`` rests ahead of it: USD spent and base bought."""
    start = F.struct(before.alias("prior"), F.lit(0.0).alias("spent"), F.lit(0.0).alias("base"))

    def step(acc: Column, level: Column) -> Column:
        worth = level["price"] * level["size"]
        fill = F.least(F.greatest(F.lit(float(usd)) - acc["prior"], F.lit(0.0)), worth)
        return F.struct(
            (acc["prior"] + worth).alias("prior"),
            (acc["spent"] + fill).alias("spent"),
            (acc["base"] + fill / level["price"]).alias("base"),
        )

    return F.aggregate(levels, start, step)


def _cost(side: Column, i: int, mid: Column) -> Column:
    """Cost in percent of mid of the ``i``-th order size on one side."""
    spent, base = side[i]["spent"], side[i]["base"]
    return F.when(base == 0, F.lit(100.0)).otherwise(F.abs(spent / F.nullif(base, F.lit(0.0)) - mid) / mid * 100)


def _resting(levels: Column, inside=None) -> Column:
    """USD resting on the levels, or on those ``inside``."""
    kept = F.filter(levels, inside) if inside else levels
    return F.aggregate(kept, F.lit(0.0), lambda acc, o: acc + o["price"] * o["size"])


def _walked_book(
    book: DataFrame, sizes: Sequence[float], pcts: Sequence[float], block_levels: int = BLOCK_LEVELS
) -> DataFrame:
    """One row per two-sided market: best prices, mid, USD within each percentage (``near``), and per side and order
    size the USD spent and base bought (``asks``, ``bids``).

    A block of levels is one row of at most ``block_levels`` levels a side. What rests ahead of each block is a running
    sum over the market's blocks; then all blocks are walked side by side and their parts added up. The one
    window runs over narrow rows, one per block.
    """
    level = F.struct("lvl", "price", "size")

    def side(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("side") == name, level)))

    blocks = settled(
        book.groupBy("market_id", F.floor((F.col("lvl") - 1) / block_levels).alias("_block"))
        .agg(side("ask").alias("_asks"), side("bid").alias("_bids"))
    )
    along = Window.partitionBy("market_id").orderBy("_block")
    ahead, whole = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    narrow = blocks.select(
        "market_id", "_block",
        *[_resting(F.col(s)).alias(f"{s}_usd") for s in ("_asks", "_bids")],
        *[F.transform(F.slice(s, 1, 1), lambda o: o["price"]).alias(f"{s}_top") for s in ("_asks", "_bids")],
    )

    def best(s: str) -> Column:
        return F.get(F.first(F.when(F.size(f"{s}_top") > 0, F.col(f"{s}_top")), ignorenulls=True).over(whole), F.lit(0))

    carried = (
        narrow.select(
            "market_id", "_block",
            best("_asks").alias("best_ask"), best("_bids").alias("best_bid"),
            *[F.coalesce(F.sum(f"{s}_usd").over(ahead), F.lit(0.0)).alias(f"{s}_ahead") for s in ("_asks", "_bids")],
        )
        .filter(F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull())
        .withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)
    )

    def near(pct: float) -> Column:
        high, low = F.col("mid") * (1 + pct / 100), F.col("mid") * (1 - pct / 100)
        return _resting(F.col("_asks"), lambda o: o["price"] <= high) + _resting(F.col("_bids"), lambda o: o["price"] >= low)

    parts = blocks.join(carried, ["market_id", "_block"]).select(
        "market_id", "best_bid", "best_ask", "mid",
        *[near(pct).alias(f"_near_{i}") for i, pct in enumerate(pcts)],
        *[
            _filled(F.col(s), usd, F.col(f"{s}_ahead")).alias(f"{s}_{i}")
            for s in ("_asks", "_bids") for i, usd in enumerate(sizes)
        ],
    )

    def taken(s: str) -> Column:
        return F.array(*[
            F.struct(*[F.sum(f"{s}_{i}.{part}").alias(part) for part in ("spent", "base")]) for i in range(len(sizes))
        ])

    return parts.groupBy("market_id").agg(
        *[F.first(c).alias(c) for c in ("best_bid", "best_ask", "mid")],
        F.array(*[F.sum(f"_near_{i}") for i in range(len(pcts))]).alias("near"),
        taken("_asks").alias("asks"), taken("_bids").alias("bids"),
    )


def liquidity_report(markets: DataFrame, book: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Eight figures per market that has a two-sided book.

    The book is read and shuffled once, in blocks of levels (``_walked_book``).
    """
    mid, usd = F.col("mid"), 10_000
    figures = _walked_book(book, (usd,), (1.0, 5.0), block_levels).select(
        "market_id",
        ((F.col("best_ask") - F.col("best_bid")) / mid * 100).alias("spread"),
        F.col("near")[0].alias("depth_1pct"),
        F.col("near")[1].alias("depth_5pct"),
        ((_cost(F.col("asks"), 0, mid) + _cost(F.col("bids"), 0, mid)) / 2).alias("slip_10k"),
    )
    joined = markets.join(figures, "market_id").withColumns(
        {
            "volume_24h": num_or_zero(F.col("volume_24h")),
            "oi": num_or_zero(F.col("open_interest")),
        }
    )
    score = liquidity_score(
        F.col("spread"), F.col("depth_1pct"), F.col("depth_5pct"), F.col("slip_10k"),
        F.col("volume_24h"), F.col("oi"),
    )
    return joined.select(
        "market_id", "symbol", score.alias("score"), "spread",
        "depth_1pct", "depth_5pct", "slip_10k", "volume_24h", "oi",
    )


def rank_liquidity(markets: DataFrame, book: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Perpetual markets by score; ranks are given before the threshold is applied."""
    report = liquidity_report(markets.filter(F.col("market_type") == "perp"), book)
    return ranked(report, [F.desc("score"), F.asc("symbol")]).filter(F.col("score") >= min_score)
