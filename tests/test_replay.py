"""Stop-loss replay against a plain loop, with blocks small enough to cross often."""

import itertools

import numpy as np
import pandas as pd
import pytest

from bandwalk.operators import backtest as bt
from bandwalk.operators import indicators as ind
from bandwalk.operators import replay
from bandwalk.operators.replay import ReplayConfig, merge_blocks, replay_blocks, replay_metrics, replay_trades
from bandwalk.operators.series import with_position
from tests.helpers import plain_backtest, random_bars, to_spark

GRID = list(itertools.product((5, 12), (4, 9), (0.5, 1.5), (None, 0.004, 0.03)))
SMALL = ReplayConfig(block_bars=24, runup=6, max_window=20, combos_per_task=10)


def params(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "combo_id int, ma_window int, atr_window int, atr_mult double, sl_stop double",
    )


def check(spark, bars: pd.DataFrame, rows, cfg, **kinds):
    series = with_position(to_spark(spark, bars), 3600)
    got = replay_metrics(series, params(spark, rows), 3600, cfg).toPandas()
    assert len(got) == bars["symbol"].nunique() * len(rows)
    for _, g in got.iterrows():
        pdf = bars[bars["symbol"] == g["symbol"]]
        want, _ = plain_backtest(pdf, *rows[g["combo_id"]], size=cfg.size, **kinds)
        for name, value in want.items():
            if value is None:
                assert pd.isna(g[name])
            else:
                assert g[name] == pytest.approx(value, rel=1e-9, abs=1e-10), (name, g["combo_id"])
    return got


@pytest.mark.parametrize("cfg", [ReplayConfig(), SMALL], ids=["one-block", "many-blocks"])
def test_metrics_equal_plain_loop(spark, cfg):
    bars = pd.concat([random_bars("a", 230, 1), random_bars("b", 97, 2), random_bars("c", 1, 3)])
    check(spark, bars, GRID, cfg)


def test_rolling_means_in_blocks(spark):
    cfg = ReplayConfig("sma", "simple", block_bars=24, runup=4, max_window=12)
    bars = random_bars("a", 150, 5)
    check(spark, bars, [(5, 4, 0.7, 0.01), (12, 9, 1.0, None)], cfg, ma_kind="sma", atr_kind="simple")


def test_a_trend_that_never_meets_its_mean(spark):
    """In a steady rise no bar forces positions shut, so no block synchronises."""
    bars = random_bars("a", 160, 7)
    rise = bars["close"].iloc[59] * 1.01 ** np.arange(1, 101)
    wiggle = 1 + 0.002 * np.sin(np.arange(100))
    for column, scale in (("open", 0.999), ("high", 1.004), ("low", 0.996), ("close", 1.0)):
        bars.loc[60:, column] = rise * wiggle * scale
    series = with_position(to_spark(spark, bars), 3600)
    blocks = replay_blocks(series, params(spark, GRID), SMALL)
    assert blocks.filter("not resolved").count() == 0
    assert blocks.count() == 7 * len(GRID)
    check(spark, bars, GRID, SMALL)


def test_ruin_is_absorbing(spark):
    bars = random_bars("a", 120, 11)
    jump = np.where(np.arange(120) >= 50, 40.0, 1.0)
    for c in ("open", "high", "low", "close"):
        bars[c] = bars[c] * jump
    cfg = ReplayConfig(block_bars=24, runup=6, max_window=20, size=1.0)
    got = check(spark, bars, GRID, cfg)
    assert got["total_return"].min() == -1.0
    assert got["max_drawdown"].max() == 1.0


def test_no_stop_equals_windows_and_huge_stop(spark):
    bars = pd.concat([random_bars("a", 300, 21), random_bars("b", 80, 22)])
    series = with_position(to_spark(spark, bars), 3600)
    rows = [(10, 5, 0.8, None), (10, 5, 0.8, 50.0)]
    got = replay_metrics(series, params(spark, rows), 3600, SMALL).toPandas()
    flat = bt.backtest(ind.keltner_channel(series, 10, 5, 0.8), 3600).toPandas().set_index("symbol")
    for _, g in got.iterrows():
        for name in ("sharpe", "total_return", "max_drawdown", "n_trades", "win_rate", "fees_paid"):
            assert g[name] == pytest.approx(flat.loc[g["symbol"], name], rel=1e-9), name


def test_trades_equal_plain_loop(spark):
    bars = random_bars("a", 230, 31)
    series = with_position(to_spark(spark, bars), 3600)
    for cfg in (ReplayConfig(), SMALL):
        got = replay_trades(series, params(spark, [(5, 4, 0.5, 0.004)]), cfg).toPandas()
        _, want = plain_backtest(bars, 5, 4, 0.5, 0.004)
        closed = got[~got["is_open"]].sort_values("exit_ts")
        assert len(closed) == len(want)
        assert (closed["reason"] == "stop").sum() > 0
        for (_, g), w in zip(closed.iterrows(), want):
            assert g["side"] == w[0] and g["reason"] == w[6]
            assert g["entry_ts"] == bars["ts"].iloc[w[1]] and g["exit_ts"] == bars["ts"].iloc[w[2]]
            assert g["exit_px"] == pytest.approx(w[4]) and g["ret"] == pytest.approx(w[5])


def micro(rows):
    """Bars whose lagged channel is mid 100, width 1 after the warm-up of ten quiet bars."""
    quiet = [(100.0, 100.5, 99.5, 100.0)] * 10
    frame = pd.DataFrame(quiet + rows, columns=["open", "high", "low", "close"])
    frame["symbol"], frame["volume"] = "m", 1.0
    frame["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(range(len(frame)), unit="h")
    return frame


@pytest.mark.parametrize(
    "rows, sl, reasons",
    [
        ([(99.5, 99.6, 98.5, 98.8), (97.0, 97.2, 96.0, 96.5)], 0.01, ["stop"]),  # gap below the level
        ([(99.5, 99.6, 98.9, 99.0), (99.0, 101.0, 90.0, 99.0)], 0.02, ["stop"]),  # stop before exit
        ([(100.6, 101.5, 100.6, 101.2), (99.0, 99.2, 98.0, 98.2)], None, ["signal"]),  # reversal
    ],
)
def test_micro_cases(spark, rows, sl, reasons):
    bars = micro(rows)
    series = with_position(to_spark(spark, bars), 3600)
    p = params(spark, [(3, 3, 1.0, sl)])
    got = replay_trades(series, p, ReplayConfig()).toPandas()
    _, want = plain_backtest(bars, 3, 3, 1.0, sl)
    closed = got[~got["is_open"]]
    assert sorted(closed["reason"]) == sorted(w[6] for w in want) == reasons
    assert closed["exit_px"].tolist() == pytest.approx([w[4] for w in want])
    check(spark, bars, [(3, 3, 1.0, sl)], ReplayConfig())


def test_a_window_longer_than_the_series_gives_an_empty_result_row(spark):
    got = check(spark, random_bars("a", 8, 41), [(50, 20, 1.0, 0.01)], ReplayConfig())
    assert got["n_trades"].iloc[0] == 0 and pd.isna(got["sharpe"].iloc[0])


def test_the_longest_window_is_taken_from_the_parameters(spark):
    cfg = ReplayConfig("sma", "simple", block_bars=24, runup=4)
    rows = [(30, 9, 0.7, 0.01), (5, 40, 1.0, None)]
    check(spark, random_bars("a", 150, 5), rows, cfg, ma_kind="sma", atr_kind="simple")
    check(spark, random_bars("a", 8, 41), [(600, 20, 1.0, 0.01)], ReplayConfig())


def test_merging_is_independent_of_block_size(spark, monkeypatch):
    series = with_position(to_spark(spark, random_bars("a", 200, 51)), 3600)
    p = params(spark, GRID[:4])
    out = [
        merge_blocks(replay_blocks(series, p, cfg), 3600, cfg).orderBy("combo_id").toPandas()
        for cfg in (ReplayConfig(block_bars=b, runup=8, max_window=20) for b in (16, 50, 400))
    ]
    monkeypatch.setattr(replay, "MERGE_BLOCKS", 3)  # folded in two levels
    cfg = ReplayConfig(block_bars=16, runup=8, max_window=20)
    out.append(merge_blocks(replay_blocks(series, p, cfg), 3600, cfg).orderBy("combo_id").toPandas())
    for other in out[1:]:
        pd.testing.assert_frame_equal(out[0], other, rtol=1e-9)
