"""Train/test windows and the assignment of bars to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bandwalk.defaults import BLOCK_BARS, DEFAULTS
from bandwalk.operators.series import KEYS

DAY_MICROS = 86_400 * 1_000_000


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def series_bounds(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First and last time stamp and bar count per key."""
    return series.groupBy(*keys).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("len")
    )


def _both_sets(splits: DataFrame, keys: Sequence[str], train, test) -> DataFrame:
    return splits.select(
        *keys,
        "split",
        F.inline(
            F.array(F.struct(F.lit("train").alias("set_name"), *train),
                    F.struct(F.lit("test").alias("set_name"), *test))
        ),
    )


def rolling_split(
    bounds: DataFrame, n: int = DEFAULTS.n_windows, split_num: int = DEFAULTS.split_num,
    split_den: int = DEFAULTS.split_den, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """``n`` equal windows whose test parts tile without overlap: rows [lo, hi).

    With N bars, t = N(1-r) / (r + n(1-r)) test bars and t*r/(1-r) train bars, all in
    integers. Series too short for one test bar have no row here; ``too_short`` names them.
    """
    rest = split_den - split_num
    sized = bounds.withColumn("_t", _test_bars(n, split_num, split_den)).withColumn(
        "_train", F.floor(F.col("_t") * split_num / rest).cast("long")
    )
    splits = sized.filter(F.col("_t") > 0).withColumn(
        "split", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    )
    lo = F.col("split") * F.col("_t")
    mid = lo + F.col("_train")
    return _both_sets(
        splits,
        keys,
        [lo.alias("lo"), mid.alias("hi")],
        [mid.alias("lo"), (mid + F.col("_t")).alias("hi")],
    )


def _test_bars(n: int, split_num: int, split_den: int) -> Column:
    rest = split_den - split_num
    return F.floor(F.col("len") * rest / (split_num + n * rest)).cast("long")


def too_short(
    bounds: DataFrame, n: int = DEFAULTS.n_windows, split_num: int = DEFAULTS.split_num,
    split_den: int = DEFAULTS.split_den, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Series that ``rolling_split`` gives no window: (key, len, reason)."""
    rest = split_den - split_num
    least = -(-(split_num + n * rest) // rest)
    return bounds.filter(_test_bars(n, split_num, split_den) == 0).select(
        *keys, "len", F.lit(f"fewer than {least} bars for {n} windows").alias("reason")
    )


def window_sizing(bounds: DataFrame, n: int = DEFAULTS.n_windows) -> DataFrame:
    """Add whole-day lengths for about ``n`` calendar windows over the history."""
    days = F.floor((_micros("end_ts") - _micros("start_ts")) / DAY_MICROS).cast("int")
    return (
        bounds.withColumn("history_days", days)
        .withColumn("_w", F.floor(F.col("history_days") / n).cast("int"))
        .withColumn("train_days", F.floor(F.col("_w") * 2 / 3).cast("int"))
        .withColumn("test_days", F.col("_w") - F.col("train_days"))
        .withColumn(
            "step_days", F.floor((F.col("history_days") - F.col("train_days")) / n).cast("int")
        )
        .drop("_w")
    )


def _room() -> Column:
    """Microseconds left beside one train and one test interval."""
    length = _micros("end_ts") - _micros("start_ts")
    return length - (F.col("train_days") + F.col("test_days")).cast("long") * DAY_MICROS


def _roomy() -> Column:
    return F.coalesce((F.col("step_days") > 0) & (_room() >= 0), F.lit(False))


def without_windows(sized: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Series that ``calendar_windows`` gives no window: (key, len, reason)."""
    reason = F.when(F.col("step_days") > 0, "no room for a window").otherwise("step below one day")
    return sized.filter(~_roomy()).select(*keys, "len", reason.alias("reason"))


def calendar_windows(
    sized: DataFrame, half_open: bool = False, keys: Sequence[str] = KEYS,
    step_days: int | None = None,
) -> DataFrame:
    """Train and test intervals of ``train_days``/``test_days``, moved by ``step_days``.

    Intervals are closed at both ends, so the boundary bar is in train and in test;
    ``half_open`` drops it from train. ``step_days`` overrides the step of every series and
    must be positive. Histories without room for a window, or too short for a step of a
    day, have no row here; ``without_windows`` names them.
    """
    if step_days is not None:
        if step_days <= 0:
            raise ValueError("step_days must be positive")
        sized = sized.withColumn("step_days", F.lit(step_days))
    splits = sized.filter(_roomy()).withColumn(
        "split",
        F.explode(
            F.sequence(
                F.lit(0),
                F.floor(_room() / (F.col("step_days").cast("long") * DAY_MICROS)).cast("int"),
            )
        ),
    )

    def at(days):
        return F.col("start_ts") + F.make_dt_interval(days)

    begin = F.col("split") * F.col("step_days")
    middle = begin + F.col("train_days")
    edge = F.lit(half_open).alias("open_end")
    return _both_sets(
        splits,
        keys,
        [at(begin).alias("from_ts"), at(middle).alias("to_ts"), edge],
        [
            at(middle).alias("from_ts"),
            at(middle + F.col("test_days")).alias("to_ts"),
            F.lit(False).alias("open_end"),
        ],
    )


def locate_windows(
    series: DataFrame, windows: DataFrame, bar_seconds: int | Column, keys: Sequence[str] = KEYS,
    block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Turn time intervals into row ranges [lo, hi) of each series.

    Bars and intervals meet on (key, time chunk), so a long series is joined in many
    pieces and only the range ends are aggregated.
    """
    keys = list(keys)
    span = F.lit(bar_seconds).cast("bigint") * block_bars

    def chunk(column: str):
        return F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / span)

    spread = windows.withColumn("_chunk", F.explode(F.sequence(chunk("from_ts"), chunk("to_ts"))))
    inside = (F.col("ts") >= F.col("from_ts")) & F.when(
        F.col("open_end"), F.col("ts") < F.col("to_ts")
    ).otherwise(F.col("ts") <= F.col("to_ts"))
    return (
        series.select(*keys, "ts", "pos", chunk("ts").alias("_chunk"))
        .join(spread, [*keys, "_chunk"])
        .filter(inside)
        .groupBy(*keys, "split", "set_name")
        .agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"))
    )


def assign_segments(
    series: DataFrame, segments: DataFrame, keys: Sequence[str] = KEYS,
    block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Every bar with every segment [lo, hi) that holds it; ``pos``/``len`` restart there.

    A range join on (key, row bucket): the bars of a long series stay spread, and the
    planner broadcasts the segments only if they turn out small.
    """
    keys = list(keys)
    spread = segments.filter(F.col("hi") > F.col("lo")).withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor(F.col("lo") / block_bars), F.floor((F.col("hi") - 1) / block_bars)
            )
        ),
    )
    return (
        series.drop("len")
        .withColumn("_bucket", F.floor(F.col("pos") / block_bars))
        .join(spread, [*keys, "_bucket"])
        .filter((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
        .withColumn("pos", F.col("pos") - F.col("lo"))
        .withColumn("len", F.col("hi") - F.col("lo"))
        .drop("_bucket", "lo", "hi")
    )


def window_summary(segmented: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First bar, last bar and bar count per window and set."""
    return segmented.groupBy(*keys, "split", "set_name").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_bars")
    )
