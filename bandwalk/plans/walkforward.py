"""Walk-forward jobs: one Spark plan for all pairs, windows and combinations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from bandwalk.defaults import BLOCK_BARS, DEFAULTS, Defaults
from bandwalk.functions.scalars import composite_score, known_tf_seconds
from bandwalk.operators.backtest import equity_curve, metrics, positions
from bandwalk.operators.params import RESEARCH_SPACE, Axis, param_sample
from bandwalk.operators.replay import PARAMS, ReplayConfig, flagged_blocks, flagged_metrics, logged_trades, replay_metrics
from bandwalk.operators.series import KEYS, with_position
from bandwalk.operators.clusters import (
    cluster_centre,
    minmax_normalise,
    neighbour_windows,
    stable_points,
    top_quantile_per_window,
    valid_trials,
)
from bandwalk.operators.windows import (
    assign_segments,
    calendar_windows,
    locate_windows,
    rolling_split,
    series_bounds,
    too_short,
    window_sizing,
)
from bandwalk.session import settled
from bandwalk.sources.candles import PAIR, complete, is_complete
from bandwalk.sources.results import read_results, write_results

MEASURES = ("sharpe", "total_return", "max_drawdown", "n_trades", "win_rate", "fees_paid", "end_equity")


def walk_forward_grid(
    bars: DataFrame, params: DataFrame, bar_seconds: int | Column, n: int = DEFAULTS.n_windows,
    cfg: ReplayConfig = ReplayConfig(), keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Metrics for every (key, split, set, combination); indicators restart per segment."""
    keys = list(keys)
    series = settled(with_position(bars, bar_seconds, keys, block_bars))
    segments = rolling_split(series_bounds(series, keys), n, keys=keys)
    segmented = assign_segments(series, segments, keys, block_bars)
    measured = replay_metrics(segmented, params, bar_seconds, cfg, [*keys, "split", "set_name"])
    return measured.join(params, "combo_id").select(
        *keys, "split", "set_name", "combo_id", *PARAMS, *MEASURES
    )


def research_windows(
    bars: DataFrame, bar_seconds: int | Column, n: int = DEFAULTS.n_windows, half_open: bool = False,
    keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Bars with their calendar train/test windows."""
    keys = list(keys)
    series = settled(with_position(bars, bar_seconds, keys, block_bars))
    windows = calendar_windows(window_sizing(series_bounds(series, keys), n), half_open, keys)
    segments = locate_windows(series, windows, bar_seconds, keys, block_bars)
    return assign_segments(series, segments, keys, block_bars)


def trial_log(
    segmented: DataFrame, bar_seconds: int | Column, n_trials: int = DEFAULTS.n_trials, seed: int = 42,
    axes: Sequence[Axis] = RESEARCH_SPACE, cfg: ReplayConfig = ReplayConfig(),
    keys: Sequence[str] = KEYS, d: Defaults = DEFAULTS,
) -> DataFrame:
    """Score of every sampled trial on the train part of its window."""
    keys = [*keys, "split"]
    train = segmented.filter(F.col("set_name") == "train")
    sampled = settled(
        param_sample(train.select(*keys).distinct(), n_trials, seed, axes, keys)
    )
    measured = replay_metrics(train, sampled, bar_seconds, cfg, keys)
    score = composite_score(
        F.col("n_trades"), F.col("max_drawdown"), F.col("sharpe"), F.col("total_return"), d
    )
    return measured.join(sampled, [*keys, "combo_id"]).select(
        *keys, "combo_id", *PARAMS, score.alias("score")
    )


def best_trials(
    trials: DataFrame, by: Sequence[str] = ("split",), params: Sequence[str] = PARAMS
) -> DataFrame:
    """Best train score per window; ties go to the smallest parameters.

    A max over a struct, so it combines map-side and no window is sorted in one task.
    """
    best = F.max_by(
        F.struct(*[c for c in trials.columns if c not in by]),
        F.struct(F.col("score"), *[-F.col(p) for p in params]),
    )
    ranked = trials.filter(F.col("score").isNotNull()).groupBy(*by).agg(best.alias("_b"))
    return ranked.select(*by, "_b.*").withColumnRenamed("score", "train_score")


def window_winners(
    trials: DataFrame, segmented: DataFrame, bar_seconds: int | Column,
    cfg: ReplayConfig = ReplayConfig(), keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Best trial per window on train, measured on its test part."""
    keys = [*keys, "split"]
    winners = settled(best_trials(trials, keys))
    test = segmented.filter(F.col("set_name") == "test")
    measured = replay_metrics(test, winners.drop("train_score"), bar_seconds, cfg, keys)
    return measured.join(winners, [*keys, "combo_id"]).select(
        *keys,
        *PARAMS,
        "train_score",
        F.col("sharpe").alias("test_sharpe"),
        F.col("total_return").alias("test_return"),
        F.col("max_drawdown").alias("test_max_dd"),
        F.col("n_trades").alias("test_trades"),
    )


def final_backtest(
    bars: DataFrame, params: DataFrame, bar_seconds: int | Column, size: float = 1.0,
    cfg: ReplayConfig = ReplayConfig(), keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Chosen parameters on the full history, by default with all equity per trade."""
    series = settled(with_position(bars, bar_seconds, keys, block_bars))
    return replay_metrics(series, params, bar_seconds, replace(cfg, size=size), keys)


def evaluate_strategy(
    bars: DataFrame, strategy: Callable[..., DataFrame], params: dict, bar_seconds: int | Column,
    size: float = DEFAULTS.size, fees: float = DEFAULTS.fees, keys: Sequence[str] = KEYS,
    block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Metrics of a user strategy without a stop.

    ``strategy(series, **params)`` returns the series with the four flags and ``px`` as
    column expressions; everything after that is shared.
    """
    series = with_position(bars, bar_seconds, keys, block_bars)
    held = positions(strategy(series, **params), keys, block_bars)
    return metrics(
        equity_curve(held, size, fees, keys=keys, block_rows=block_bars), bar_seconds, keys=keys
    )


def strategy_with_stops(
    bars: DataFrame, strategy: Callable[..., DataFrame], params: dict, stops: Sequence[float | None], bar_seconds: int | Column,
    n: int | None = None, cfg: ReplayConfig = ReplayConfig(), keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Metrics of a user strategy for every stop (``combo_id`` is its place in ``stops``, None is no stop).

    ``strategy`` is as in ``evaluate_strategy``, and with ``n`` windows as in ``strategy_grid``: it is
    computed once, and all stops walk over the same flags.
    """
    keys = list(keys)
    series = with_position(bars, bar_seconds, keys, block_bars)
    if n is not None:
        series = settled(series)
        segments = rolling_split(series_bounds(series, keys), n, keys=keys)
        series = settled(assign_segments(series, segments, keys, block_bars))
        keys += ["split", "set_name"]
        params = params | {"keys": keys}
    return flagged_metrics(strategy(series, **params), bar_seconds, stops, cfg, keys)


def strategy_trades(
    bars: DataFrame, strategy: Callable[..., DataFrame], params: dict, stops: Sequence[float | None], bar_seconds: int | Column,
    cfg: ReplayConfig = ReplayConfig(), keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """One row per trade of a user strategy and stop."""
    series = settled(with_position(bars, bar_seconds, keys, block_bars))
    return logged_trades(flagged_blocks(strategy(series, **params), stops, cfg, keys, log=True), series, keys)


def strategy_grid(
    bars: DataFrame, strategy: Callable[..., DataFrame], param_sets: Sequence[dict], bar_seconds: int | Column,
    n: int | None = DEFAULTS.n_windows, size: float = DEFAULTS.size, fees: float = DEFAULTS.fees,
    keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """Metrics of a user strategy for every parameter set and every train and test part.

    ``strategy(series, keys=..., **params)`` returns the series with the four flags and
    ``px``; it has to hand ``keys`` on to the operators it uses, as indicators restart in
    every part. With ``n=None`` the full history is one part. All sets are branches of one
    plan over the same stored bars; ``combo_id`` is the place of the set in the list.
    """
    series = settled(with_position(bars, bar_seconds, keys, block_bars))
    keys = list(keys)
    if n is not None:
        segments = rolling_split(series_bounds(series, keys), n, keys=keys)
        series = settled(assign_segments(series, segments, keys, block_bars))
        keys += ["split", "set_name"]
    flagged = reduce(
        DataFrame.unionByName,
        [
            strategy(series, keys=keys, **params).withColumn("combo_id", F.lit(i))
            for i, params in enumerate(param_sets)
        ],
    )
    keys.append("combo_id")
    held = positions(flagged, keys, block_bars)
    return metrics(
        equity_curve(held, size, fees, keys=keys, block_rows=block_bars), bar_seconds, keys=keys
    )


def scan(
    candles: DataFrame, results: DataFrame | None, params: DataFrame,
    bar_seconds: int | Column | None = None, cfg: ReplayConfig = ReplayConfig(), keys: Sequence[str] = ("exchange", "tf", "symbol"),
) -> DataFrame:
    """Walk-forward grid over all pairs that have no stored result yet, as one job.

    The bar length comes from each pair's ``tf`` unless it is given. Pairs with an unknown timeframe and
    candles with a missing price are left out. ``scan_skipped`` names the pairs that give no row.
    """
    todo = complete(candles)
    if bar_seconds is None:
        bar_seconds = known_tf_seconds(F.col("tf"))
        todo = todo.filter(bar_seconds.isNotNull())
    if results is not None:
        todo = todo.join(results.select(*keys).distinct(), list(keys), "left_anti")
    return walk_forward_grid(todo, params, bar_seconds, cfg=cfg, keys=keys)


def _untimed(bar_seconds: int | Column | None) -> Column:
    return F.lit(False) if bar_seconds is not None else known_tf_seconds(F.col("tf")).isNull()


def scan_skipped(
    candles: DataFrame, results: DataFrame | None, n: int = DEFAULTS.n_windows,
    keys: Sequence[str] = ("exchange", "tf", "symbol"), bar_seconds: int | Column | None = None,
) -> DataFrame:
    """Pairs with candles that ``scan`` has no row for: (key, len, reason)."""
    keys = list(keys)
    lengths = candles.groupBy(*keys).agg(
        F.count_if(is_complete()).alias("len")
    )
    stored = lengths.limit(0) if results is None else results.select(*keys).distinct()
    done = lengths.join(stored, keys, "left_semi").withColumn("reason", F.lit("stored"))
    left = lengths.join(stored, keys, "left_anti")
    untimed = left.filter(_untimed(bar_seconds)).withColumn("reason", F.lit("unknown timeframe"))
    return done.unionByName(untimed).unionByName(too_short(left.filter(~_untimed(bar_seconds)), n, keys=keys))


CHUNKS = 4_096


def scan_groups(pairs: DataFrame, group_pairs: int) -> DataFrame:
    """Add ``group`` to (pair, ``len``): pairs in a fixed order, cut where their cost reaches equal shares.

    A pair costs one share for itself and one, on average, for its bars, and a group two shares a pair of ``group_pairs``. So no group
    has more than ``2 * group_pairs + 1`` pairs, and one with a long history has few. Group numbers may have gaps.
    Costs are summed inside hashed chunks of pairs and along one row per chunk.
    """
    total = pairs.agg(F.struct(F.count("*").alias("n"), F.sum("len").alias("bars")).alias("_t")).scalar()
    cost = 1 + F.col("len") * total["n"] / F.nullif(total["bars"], F.lit(0))
    spread = settled(pairs.select("*", F.coalesce(cost, F.lit(1.0)).alias("_cost"), F.pmod(F.xxhash64(*PAIR), F.lit(CHUNKS)).alias("_chunk")))
    inside = Window.partitionBy("_chunk").orderBy(*PAIR).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("_chunk").agg(F.sum("_cost").alias("_sum")).select(
        "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_offset")
    )
    ahead = F.col("_offset") + F.coalesce(F.sum("_cost").over(inside), F.lit(0.0))
    return (
        spread.join(offsets, "_chunk")
        .withColumn("group", F.floor(ahead / (2 * group_pairs)))
        .drop("_cost", "_chunk", "_offset")
    )


def pairs_only(candles: DataFrame, pairs: Sequence[Row]) -> DataFrame:
    """Candles of a short list of pairs. The names stand in the plan, so a table partitioned by them opens no other file."""
    wanted = candles
    for name in PAIR:
        wanted = wanted.filter(F.col(name).isin(sorted({p[name] for p in pairs})))
    listed = candles.sparkSession.createDataFrame([tuple(p[c] for c in PAIR) for p in pairs], ", ".join(f"{c} string" for c in PAIR))
    return wanted.join(listed, list(PAIR), "left_semi")


def scan_to(
    path: str, scan_id: str, candles: DataFrame, params: DataFrame, group_pairs: int = 1_000,
    bar_seconds: int | Column | None = None, cfg: ReplayConfig = ReplayConfig(),
) -> int:
    """Scan the pairs without a stored result in groups, storing each group when it is done.

    A run that was broken off goes on with the pairs that are missing. Pairs too short
    for a window or of an unknown timeframe count as done. Groups have about equal cost (``scan_groups``), and each reads only its own
    pairs' candles; the driver holds the names of one group. Returns the number of groups run.
    """
    spark = candles.sparkSession
    try:
        stored = read_results(spark, path, scan_id).select(*PAIR).distinct()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        stored = candles.select(*PAIR).limit(0)
    lengths = candles.filter(is_complete() & ~_untimed(bar_seconds)).groupBy(*PAIR).agg(F.count("*").alias("len"))
    pending = lengths.join(too_short(lengths, keys=PAIR), list(PAIR), "left_anti").join(stored, list(PAIR), "left_anti")
    grouped = settled(scan_groups(settled(pending), group_pairs))
    groups = [r["group"] for r in grouped.select("group").distinct().orderBy("group").collect()]
    for group in groups:
        chosen = grouped.filter(F.col("group") == group).select(*PAIR).collect()
        write_results(scan(pairs_only(candles, chosen), None, params, bar_seconds, cfg), path, scan_id)
    return len(groups)


def research_chain(
    bars: DataFrame, bar_seconds: int | Column, radius: float, axes: Sequence[Axis] = RESEARCH_SPACE,
    n_trials: int = DEFAULTS.n_trials, seed: int = 42, cfg: ReplayConfig = ReplayConfig(),
    keys: Sequence[str] = KEYS, d: Defaults = DEFAULTS, n: int = DEFAULTS.n_windows,
) -> DataFrame:
    """Trial log, cross-window clusters, centre, and its backtest on the full history.

    One row per key that has a stable cluster: the centre's parameters and the metrics.
    """
    keys = list(keys)
    segmented = settled(research_windows(bars, bar_seconds, n, keys=keys))
    log = settled(trial_log(segmented, bar_seconds, n_trials, seed, axes, cfg, keys, d))
    valid = valid_trials(log, rejected=d.rejected_score)
    top = settled(
        top_quantile_per_window(minmax_normalise(valid, PARAMS, keys), window="split", keys=keys)
    )
    near = neighbour_windows(top, radius, PARAMS, "split", keys)
    centre = settled(
        cluster_centre(stable_points(near, log, window="split", keys=keys), PARAMS, keys)
    )
    chosen = centre.withColumn("combo_id", F.lit(0))
    measured = final_backtest(bars, chosen.select(*keys, "combo_id", *PARAMS), bar_seconds, cfg=cfg, keys=keys)
    return measured.join(chosen.select(*keys, *PARAMS), keys).select(*keys, *PARAMS, *MEASURES)
