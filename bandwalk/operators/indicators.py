"""Moving averages, true range, and the two volatility channels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from bandwalk.defaults import BLOCK_BARS
from bandwalk.operators.series import KEYS, Recursive, recursive_means, windowed


def rolling_mean(column: str, n: int, order: WindowSpec, first: int = 0) -> Column:
    """Mean of the last ``n`` rows; NULL until ``n`` rows from ``first`` on exist."""
    return F.when(
        F.col("pos") >= first + n - 1, F.avg(column).over(order.rowsBetween(-(n - 1), 0))
    )


def true_range_of(order: WindowSpec) -> Column:
    """max(h-l, |h-prev close|, |l-prev close|); h-l on the first bar."""
    before = F.lag("close").over(order)
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - before),
        F.abs(F.col("low") - before),
    )


def sma(
    series: DataFrame, n: int, column: str = "close", out: str = "sma",
    keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Simple moving average."""
    return windowed(
        series, [lambda d, w: d.withColumn(out, rolling_mean(column, n, w))], n, keys, block_bars
    )


def true_range(
    series: DataFrame, out: str = "tr", keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS
) -> DataFrame:
    return windowed(
        series, [lambda d, w: d.withColumn(out, true_range_of(w))], 1, keys, block_bars
    )


def _ranged(series: DataFrame, keys: Sequence[str], block_bars: int) -> DataFrame:
    """True range, still laid out in blocks."""
    return windowed(
        series, [lambda d, w: d.withColumn("tr", true_range_of(w))], 1, keys, block_bars, True
    )


def shift1(
    series: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS,
    block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Replace each column by its value one bar earlier (no look-ahead)."""

    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumns({c: F.lag(c).over(w) for c in columns})

    return windowed(series, [add], 1, keys, block_bars)


def ema_of(n: int, column: str = "close", out: str = "ema") -> Recursive:
    return Recursive(out, column, 2.0 / (n + 1), n)


def wilder_of(n: int, column: str = "tr", out: str = "atr") -> Recursive:
    return Recursive(out, column, 1.0 / n, n)


def ema(
    series: DataFrame, n: int, column: str = "close", out: str = "ema",
    keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Exponential moving average with alpha = 2/(n+1)."""
    return recursive_means(series, [ema_of(n, column, out)], False, keys, block_bars)


def atr(
    series: DataFrame, n: int, kind: str = "wilder", out: str = "atr",
    keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Average true range, ``wilder`` (alpha = 1/n) or ``simple`` (rolling mean)."""
    if kind == "simple":
        return windowed(
            series,
            [
                lambda d, w: d.withColumn("tr", true_range_of(w)),
                lambda d, w: d.withColumn(out, rolling_mean("tr", n, w)),
            ],
            n + 1,
            keys,
            block_bars,
        )
    ranged = _ranged(series, keys, block_bars)
    return recursive_means(ranged, [wilder_of(n, "tr", out)], False, keys, block_bars)


def bands(series: DataFrame, mult: float, mid: str = "mid", width: str = "atr") -> DataFrame:
    """Lower and upper band around ``mid``."""
    return series.withColumns(
        {
            "lower": F.col(mid) - F.lit(float(mult)) * F.col(width),
            "upper": F.col(mid) + F.lit(float(mult)) * F.col(width),
        }
    )


def atr_envelope(
    series: DataFrame, ma_window: int, atr_window: int, atr_mult: float, kind: str = "simple",
    keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """SMA-centred channel known before each bar: adds mid, atr, lower, upper."""
    if kind == "simple":
        ranged = windowed(
            series,
            [
                lambda d, w: d.withColumn("tr", true_range_of(w)),
                lambda d, w: d.withColumns(
                    {"_ma": rolling_mean("close", ma_window, w), "_atr": rolling_mean("tr", atr_window, w)}
                ),
                lambda d, w: d.withColumns(
                    {"mid": F.lag("_ma").over(w), "atr": F.lag("_atr").over(w)}
                ),
            ],
            max(ma_window, atr_window) + 2,
            keys,
            block_bars,
        ).drop("_ma", "_atr", "tr")
    else:
        ranged = windowed(
            series,
            [
                lambda d, w: d.withColumns(
                    {"tr": true_range_of(w), "_ma": rolling_mean("close", ma_window, w)}
                ),
                lambda d, w: d.withColumn("mid", F.lag("_ma").over(w)),
            ],
            ma_window + 1,
            keys,
            block_bars,
            True,
        ).drop("_ma")
        ranged = recursive_means(ranged, [wilder_of(atr_window)], True, keys, block_bars).drop("tr")
    return bands(ranged, atr_mult)


def keltner_channel(
    series: DataFrame, ma_window: int, atr_window: int, atr_mult: float, kind: str = "wilder",
    keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """EMA-centred channel known before each bar: adds mid, atr, lower, upper."""
    means = [ema_of(ma_window, "close", "mid")]
    if kind == "simple":
        ranged = windowed(
            series,
            [
                lambda d, w: d.withColumn("tr", true_range_of(w)),
                lambda d, w: d.withColumn("_atr", rolling_mean("tr", atr_window, w)),
                lambda d, w: d.withColumn("atr", F.lag("_atr").over(w)),
            ],
            atr_window + 2,
            keys,
            block_bars,
            True,
        ).drop("_atr")
    else:
        ranged = _ranged(series, keys, block_bars)
        means.append(wilder_of(atr_window))
    channel = recursive_means(ranged, means, True, keys, block_bars).drop("tr")
    return bands(channel, atr_mult)


def indicator_bank(
    series: DataFrame, ma_windows: Iterable[int], atr_windows: Iterable[int],
    ma_kind: str = "ema", keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Every distinct moving average and ATR of a grid, one wide column each.

    A grid of thousands of combinations has only a handful of distinct series.
    """
    ma_windows, atr_windows = sorted(set(ma_windows)), sorted(set(atr_windows))
    means = [wilder_of(n, "tr", f"atr_{n}") for n in atr_windows]
    if ma_kind == "ema":
        ranged = _ranged(series, keys, block_bars)
        means += [ema_of(n, "close", f"ma_{n}") for n in ma_windows]
    else:
        ranged = windowed(
            series,
            [
                lambda d, w: d.withColumns(
                    {"tr": true_range_of(w)}
                    | {f"ma_{n}": rolling_mean("close", n, w) for n in ma_windows}
                )
            ],
            max(ma_windows),
            keys,
            block_bars,
            True,
        )
    return recursive_means(ranged, means, False, keys, block_bars)
