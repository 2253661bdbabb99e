"""Positions, trades, equity and metrics as relational operators (no stop).

What a bar needs to know of all bars before it is little: the latest event of each leg,
the latest entry, the growth of closed trades, the highest equity. Each is carried over
fixed blocks of bars (``series.carried``): blocks are aggregated in parallel, one row per
block is accumulated along the series, and bars add what precedes them in their block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bandwalk.defaults import BLOCK_BARS, DEFAULTS
from bandwalk.operators.series import KEYS, carried, windowed
from bandwalk.operators.signals import fill_price, signals
from bandwalk.session import settled


def leg_event(entry: str, leave: str) -> Column:
    """1 opens the leg, 0 closes it, NULL leaves it as it is."""
    both = F.col("long_entry") & F.col("short_entry")
    return (
        F.when(both | (F.col(entry) & F.col(leave)), F.lit(None).cast("int"))
        .when(F.col(entry), 1)
        .when(F.col(leave), 0)
    )


def positions(
    flagged: DataFrame, keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS
) -> DataFrame:
    """Add ``position`` (-1, 0, 1) held after each bar and ``was``, the one before it."""
    events = settled(
        flagged.withColumns(
            {
                "long_ev": leg_event("long_entry", "long_exit"),
                "short_ev": leg_event("short_entry", "short_exit"),
            }
        )
    )
    legs = {"_long": ("last", "long_ev"), "_short": ("last", "short_ev")}
    zero = F.lit(0)
    return (
        carried(events, "pos", legs, keys, block_bars)
        .withColumns(
            {
                "position": F.coalesce("long_ev", "_long", zero) - F.coalesce("short_ev", "_short", zero),
                "was": F.coalesce("_long", zero) - F.coalesce("_short", zero),
            }
        )
        .drop("long_ev", "short_ev", "_long", "_short")
    )


def _entries(held: DataFrame, keys: Sequence[str], block_bars: int) -> DataFrame:
    """Add ``_opens``, ``_closes`` and the latest entry before (``_prior``) and up to (``_entry``) the bar."""
    changed = F.col("position") != F.col("was")
    opened = held.withColumns(
        {"_opens": (F.col("position") != 0) & changed, "_closes": (F.col("was") != 0) & changed}
    ).withColumn(
        "_new", F.when(F.col("_opens"), F.struct(F.col("px").alias("px"), F.col("ts").alias("ts")))
    )
    return (
        carried(opened, "pos", {"_prior": ("last", "_new")}, keys, block_bars)
        .withColumn("_entry", F.coalesce("_new", "_prior"))
        .drop("_new")
    )


def trade_return(size: float, fees: float, side: Column, p_in: Column, p_out: Column) -> Column:
    """Return of a closed trade on the equity at its entry."""
    ratio = p_out / p_in
    return F.lit(size) * (side * (ratio - 1) - fees - fees * ratio)


def mark_return(size: float, fees: float, side: Column, p_in: Column, price: Column) -> Column:
    """Return of an open trade at ``price``, before any exit fee."""
    return F.lit(size) * (side * (price / p_in - 1) - fees)


def trades(
    held: DataFrame, size: float = DEFAULTS.size, fees: float = DEFAULTS.fees,
    keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """One row per trade; a trade still open is marked at the last close.

    A trade is the bar that closes it together with the latest entry before, so trades of
    any length need no group of their own.
    """
    bars = _entries(held, keys, block_bars)
    still = (F.col("pos") == F.col("len") - 1) & (F.col("position") != 0)

    def rows(side: str, entry: str, price: str, is_open: bool) -> Column:
        p_in, p_out = F.col(f"{entry}.px"), F.col(price)
        result = mark_return if is_open else trade_return
        return F.struct(
            F.col(side).alias("side"),
            F.col(f"{entry}.ts").alias("entry_ts"),
            p_in.alias("entry_px"),
            F.col("ts").alias("exit_ts"),
            p_out.alias("exit_px"),
            F.lit(is_open).alias("is_open"),
            result(size, fees, F.col(side), p_in, p_out).alias("ret"),
        )

    ended = F.array_compact(
        F.array(
            F.when(F.col("_closes"), rows("was", "_prior", "px", False)),
            F.when(still, rows("position", "_entry", "close", True)),
        )
    )
    return bars.filter(F.col("_closes") | still).select(*keys, F.inline(ended))


def equity_curve(
    held: DataFrame, size: float = DEFAULTS.size, fees: float = DEFAULTS.fees,
    init_cash: float = DEFAULTS.init_cash, keys: Sequence[str] = KEYS,
    block_rows: int = BLOCK_BARS,
) -> DataFrame:
    """Equity marked at each close, the equity one bar earlier and the running peak.

    Three facts cross a block edge, one row per block each: the latest entry, the growth
    of the closed trades (as a sum of logarithms), and the highest and latest equity.
    """
    keys = list(keys)
    bars = settled(_entries(held, keys, block_rows))
    closes, opens = F.col("_closes"), F.col("_opens")
    stepped = bars.withColumns(
        {
            "_factor": F.when(
                closes, 1 + trade_return(size, fees, F.col("was"), F.col("_prior.px"), F.col("px"))
            ).otherwise(F.lit(1.0)),
            "_mark": F.when(
                F.col("position") != 0,
                1 + mark_return(size, fees, F.col("position"), F.col("_entry.px"), F.col("close")),
            ).otherwise(F.lit(1.0)),
        }
    ).withColumns(
        {
            "_log": F.when(F.col("_factor") > 0, F.ln("_factor")).otherwise(0.0),
            # Equity is floored at zero and stays there.
            "_broke": ((F.col("_factor") <= 0) | (F.col("_mark") <= 0)).cast("int"),
        }
    )
    grown = carried(
        stepped, "pos", {"_log_0": ("sum", "_log"), "_broke_0": ("max", "_broke")}, keys, block_rows
    )
    alive = F.greatest(F.coalesce("_broke_0", F.lit(0)), F.col("_broke")) == 0
    grown = grown.withColumn(
        "_realised", F.when(alive, init_cash * F.exp(F.col("_log_0") + F.col("_log"))).otherwise(0.0)
    ).withColumn("equity", F.col("_realised") * F.when(alive, F.col("_mark")).otherwise(0.0))
    full = carried(
        grown, "pos", {"_last": ("last", "equity"), "_peak": ("max", "equity")}, keys, block_rows
    )
    before = F.coalesce("_last", F.lit(float(init_cash)))
    fee = F.lit(size * fees)
    return full.select(
        *keys,
        "ts",
        "pos",
        "close",
        "position",
        "equity",
        before.alias("prev_equity"),
        F.greatest(F.lit(float(init_cash)), "_peak", "equity").alias("peak"),
        (opens & (before > 0)).alias("opened"),
        (closes & (before > 0)).alias("closed"),
        (F.col("_factor") - 1).alias("closed_ret"),
        # Entry fee on the equity after any close on this bar; exit fee on the equity at entry.
        (
            F.when(opens, fee * F.col("_realised")).otherwise(0.0)
            + F.when(
                closes & (F.col("_factor") > 0),
                fee * F.col("_realised") / F.col("_factor") * F.col("px") / F.col("_prior.px"),
            ).otherwise(0.0)
        ).alias("fees_paid"),
    )


def total_return(
    curve: DataFrame, init_cash: float = DEFAULTS.init_cash, keys: Sequence[str] = KEYS
) -> DataFrame:
    return curve.groupBy(*keys).agg((F.max_by("equity", "pos") / init_cash - 1).alias("total_return"))


def max_drawdown(curve: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest drop from the running peak, as a positive share."""
    return curve.groupBy(*keys).agg(F.max(_drawdown()).alias("max_drawdown"))


def sharpe(curve: DataFrame, bar_seconds: int | Column, keys: Sequence[str] = KEYS) -> DataFrame:
    return curve.groupBy(*keys).agg(_sharpe(bar_seconds).alias("sharpe"))


def trade_count(curve: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return curve.groupBy(*keys).agg(F.count_if("opened").alias("n_trades"))


def _drawdown() -> Column:
    return 1 - F.col("equity") / F.col("peak")


def annual_scale(bar_seconds: int | Column) -> Column:
    """Square root of the bars in a year of 365 days."""
    return F.sqrt(F.lit(365.0 * 86_400) / F.lit(bar_seconds))


def _sharpe(bar_seconds: int | Column) -> Column:
    # A curve at zero stays at zero: its return there is 0.
    ret = F.when(
        F.col("prev_equity") > 0, F.col("equity") / F.nullif(F.col("prev_equity"), F.lit(0.0)) - 1
    ).otherwise(0.0)
    return (
        F.avg(ret) / F.nullif(F.stddev_samp(ret), F.lit(0.0)) * annual_scale(bar_seconds)
    )


def metrics(
    curve: DataFrame, bar_seconds: int | Column, init_cash: float = DEFAULTS.init_cash,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row per key: all measures in a single map-side combined aggregate."""
    wins = F.count_if(F.col("closed") & (F.col("closed_ret") > 0))
    closed = F.count_if("closed")
    return curve.groupBy(*keys).agg(
        _sharpe(bar_seconds).alias("sharpe"),
        (F.max_by("equity", "pos") / init_cash - 1).alias("total_return"),
        F.max(_drawdown()).alias("max_drawdown"),
        F.count_if("opened").alias("n_trades"),
        (wins / F.nullif(closed, F.lit(0))).alias("win_rate"),
        F.sum("fees_paid").alias("fees_paid"),
        F.max_by("equity", "pos").alias("end_equity"),
    )


def backtest(
    channel: DataFrame, bar_seconds: int | Column, size: float = DEFAULTS.size,
    fees: float = DEFAULTS.fees, keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Channel to metrics without a stop."""
    held = positions(fill_price(signals(channel)), keys, block_bars)
    return metrics(
        equity_curve(held, size, fees, keys=keys, block_rows=block_bars), bar_seconds, keys=keys
    )


def equity_returns(
    curve: DataFrame, keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS
) -> DataFrame:
    """Bar returns of any equity series with ``pos`` and ``len``."""
    return windowed(
        curve,
        [
            lambda d, w: d.withColumn(
                "ret", F.col("equity") / F.nullif(F.lag("equity").over(w), F.lit(0.0)) - 1
            )
        ],
        1,
        keys,
        block_bars,
    )
