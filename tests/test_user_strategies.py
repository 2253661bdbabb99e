"""Stops for flags of any strategy, and ordered folds, at block and batch edges."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandwalk.catalog.bars import ANCHORED, RISING
from bandwalk.operators.replay import ReplayConfig, flagged_blocks, flagged_metrics
from bandwalk.operators.series import with_position
from bandwalk.plans import fold as folds
from bandwalk.plans.fold import Fold, fold_bars
from bandwalk.plans.walkforward import strategy_trades, strategy_with_stops
from tests.helpers import random_bars, to_spark

STOPS = [None, 0.004, 0.03]
FLAGS = ["long_entry", "long_exit", "short_entry", "short_exit"]


def random_flags(bars: pd.DataFrame, seed: int, share: float) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    out = bars.assign(**{f: rng.random(len(bars)) < share for f in FLAGS}, px=bars[["high", "low"]].mean(axis=1))
    out["pos"], out["len"] = np.arange(len(out)), len(out)
    return out


def plain(rows: pd.DataFrame, sl, size=0.3, fees=0.001):
    """Total return and trades of the flags, bar by bar; an entry of the other leg turns the position."""
    side, p_in, entry, base, eq, trades, opened = 0, None, None, 1.0, 1.0, [], 0
    for i, r in enumerate(rows.itertuples()):
        free = not (r.long_entry and r.short_entry)
        open_l, open_s = r.long_entry and not r.long_exit and free, r.short_entry and not r.short_exit and free
        out = None
        stopped = bool(side) and sl is not None and (r.low <= p_in * (1 - sl) if side > 0 else r.high >= p_in * (1 + sl))
        if stopped:
            level = p_in * (1 - side * sl)
            out = min(r.open, level) if side > 0 else max(r.open, level)
        elif side > 0 and (open_s or (r.long_exit and not r.long_entry and free)) or side < 0 and (open_l or (r.short_exit and not r.short_entry and free)):
            out = r.px
        if out is not None:
            ret = size * (side * (out / p_in - 1) - fees - fees * out / p_in)
            trades.append((side, entry, i, p_in, out, ret, "stop" if stopped else "signal"))
            was, base, side = side, base * (1 + ret), 0
        if not stopped and side == 0 and (open_l or open_s):
            side, p_in, entry, opened = 1 if open_l else -1, r.px, i, opened + 1
        eq = base * (1 + size * (side * (r.close / p_in - 1) - fees)) if side else base
    return eq - 1, opened, trades


@pytest.mark.parametrize("share, cfg", [(0.03, ReplayConfig()), (0.03, ReplayConfig(block_bars=16, runup=3)), (0.3, ReplayConfig(block_bars=9, runup=0))])
def test_flags_with_stops_equal_a_plain_loop(spark, share, cfg):
    parts = [random_flags(random_bars(s, n, k), k, share) for k, (s, n) in enumerate((("a", 260), ("b", 61), ("c", 1)))]
    frame = spark.createDataFrame(pd.concat(parts).drop(columns=["ts"]))
    got = {(r.symbol, r.combo_id): r for r in flagged_metrics(frame, 3600, STOPS, cfg).collect()}
    log = flagged_blocks(frame, STOPS, cfg, log=True).select("symbol", "combo_id", F.inline("log")).collect()
    assert len(got) == 9
    for rows in parts:
        for i, sl in enumerate(STOPS):
            symbol = rows["symbol"].iloc[0]
            total, opened, trades = plain(rows, sl)
            assert got[symbol, i].total_return == pytest.approx(total, rel=1e-9, abs=1e-12)
            assert got[symbol, i].n_trades == opened
            mine = sorted((t.exit_pos, t.entry_pos, t.side, t.reason, round(t.exit_px, 9)) for t in log
                          if (t.symbol, t.combo_id) == (symbol, i) and t.reason != "open")
            assert mine == [(t[2], t[1], t[0], t[6], round(t[4], 9)) for t in trades]


def touch(series, keys=("symbol",), width=0.01):
    before = F.lag("close").over(folds_window(keys))
    return series.withColumns({
        "long_entry": F.col("low") <= before * (1 - width), "long_exit": F.col("high") >= before * (1 + width),
        "short_entry": F.lit(False), "short_exit": F.lit(None).cast("boolean"), "px": F.col("close")})


def folds_window(keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy("pos")


def test_user_strategy_over_windows_and_trades(spark):
    bars = to_spark(spark, pd.concat([random_bars("a", 240, 5), random_bars("b", 200, 6)]))
    out = strategy_with_stops(bars, touch, {"width": 0.004}, [None, 0.01], 3600, n=3).collect()
    assert {(r.symbol, r.split, r.set_name, r.combo_id) for r in out} == {
        (s, k, t, c) for s in "ab" for k in range(3) for t in ("train", "test") for c in (0, 1)}
    whole = strategy_with_stops(bars, touch, {"width": 0.004}, [None, 0.01], 3600).collect()
    trades = strategy_trades(bars, touch, {"width": 0.004}, [None, 0.01], 3600)
    assert {c for c in trades.columns} >= {"entry_ts", "exit_ts", "reason"}
    assert {r.reason for r in trades.collect()} >= {"stop", "signal"}
    for r in whole:
        assert trades.filter((F.col("symbol") == r.symbol) & (F.col("combo_id") == r.combo_id)).count() == r.n_trades
    assert strategy_with_stops(bars.limit(0), touch, {}, [None], 3600).count() == 0


def rising(close):
    best = run = 1
    for a, b in zip(close, close[1:]):
        run = run + 1 if b > a else 1
        best = max(best, run)
    return best


@pytest.mark.parametrize("block, fan", [(1, 2), (7, 3), (48, 256), (10_000, 256)])
def test_a_fold_that_merges(spark, monkeypatch, block, fan):
    monkeypatch.setattr(folds, "FAN", fan)
    bars = pd.concat([random_bars("a", 300, 1), random_bars("b", 1, 2), random_bars("c", 97, 3)])
    series = with_position(to_spark(spark, bars), 3600)
    got = {r.symbol: (r.n, r.best) for r in fold_bars(series, RISING, ["close"], block_bars=block).collect()}
    assert got == {s: (len(g), rising(g["close"].tolist())) for s, g in bars.groupby("symbol")}
    assert fold_bars(series.limit(0), RISING, ["close"]).count() == 0


@pytest.mark.parametrize("records", ["3", "10000"])
def test_a_fold_in_order(spark, records):
    bars = pd.concat([random_bars(s, n, k) for k, (s, n) in enumerate((("a", 230), ("b", 5), ("c", 80)))])
    series = with_position(to_spark(spark, bars), 3600).withColumn("symbol", F.when(F.col("symbol") != "b", F.col("symbol")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        got = {r.symbol: (r.anchor, r.moves) for r in fold_bars(series, ANCHORED, ["close"]).collect()}
        sums = Fold("total double", lambda: {"total": 0.0}, lambda s, t: {"total": s["total"] + float(sum(t.column("low").to_pylist()))})
        assert {r.symbol: r.total for r in fold_bars(series, sums, ["low"]).collect()} == pytest.approx(
            {s if s != "b" else None: g["low"].sum() for s, g in bars.groupby("symbol")})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for s, g in bars.groupby("symbol"):
        anchor, moves = None, 0
        for c in g["close"]:
            if anchor is None:
                anchor = c
            elif abs(c - anchor) >= 0.01 * anchor:
                anchor, moves = c, moves + 1
        assert got[s if s != "b" else None] == (anchor, moves) and not math.isnan(anchor)
