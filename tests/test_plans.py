"""Walk-forward jobs against their parts."""

from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandwalk.defaults import DEFAULTS
from bandwalk.operators.params import Axis, param_grid
from bandwalk.operators.replay import ReplayConfig, replay_metrics
from bandwalk.operators.series import with_position
from bandwalk.plans.walkforward import best_trials, final_backtest, research_chain, pairs_only, scan, scan_groups, scan_skipped, scan_to, walk_forward_grid
from bandwalk.sources.results import read_results
from tests.helpers import plain_backtest, random_bars, to_spark

GRID = (Axis("ma_window", 4, 4, 2), Axis("atr_window", 3, 1, 1), Axis("atr_mult", 1, 1, 2, 2), Axis("sl_stop", 1, 1, 1, 100))
CFG = ReplayConfig(max_window=10)
KEYS = ["exchange", "tf", "symbol"]


@pytest.fixture(scope="module")
def bars():
    return pd.concat([random_bars("a", 260, 1), random_bars("b", 90, 2)])


def test_grid_restarts_in_every_segment(spark, bars):
    got = walk_forward_grid(to_spark(spark, bars), param_grid(spark, GRID), 3600, cfg=CFG).toPandas()
    assert len(got) == 2 * 10 * 2 * 4
    for symbol, n in (("a", 260), ("b", 90)):
        pdf = bars[bars["symbol"] == symbol].reset_index(drop=True)
        t = n * 3 // 37
        train = t * 7 // 3
        for _, g in got[got["symbol"] == symbol].iterrows():
            lo = g["split"] * t + (0 if g["set_name"] == "train" else train)
            part = pdf.iloc[lo : lo + (train if g["set_name"] == "train" else t)]
            want, _ = plain_backtest(part, g["ma_window"], g["atr_window"], g["atr_mult"], g["sl_stop"])
            assert g["n_trades"] == want["n_trades"]
            assert g["total_return"] == pytest.approx(want["total_return"], abs=1e-12)


def test_block_size_does_not_show(spark, bars):
    params = param_grid(spark, GRID)
    small = ReplayConfig(block_bars=16, runup=4, max_window=10, combos_per_task=3)
    order = ["symbol", "split", "set_name", "combo_id"]
    a, b = (
        walk_forward_grid(to_spark(spark, bars), params, 3600, cfg=cfg, block_bars=size).toPandas()
        .sort_values(order, ignore_index=True)
        for cfg, size in ((CFG, 65_536), (small, 20))
    )
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-12)


def test_scan_mixes_timeframes_and_skips_stored_pairs(spark, bars):
    hourly = to_spark(spark, bars).withColumns({"exchange": F.lit("x"), "tf": F.lit("1h")})
    daily = hourly.withColumn("tf", F.lit("1d"))
    stored = hourly.filter("symbol = 'b'")
    got = scan(hourly.unionByName(daily), stored, param_grid(spark, GRID), cfg=CFG).toPandas()
    assert set(map(tuple, got[KEYS].drop_duplicates().to_numpy())) == {("x", "1h", "a"), ("x", "1d", "a"), ("x", "1d", "b")}
    ix = ["split", "set_name", "combo_id"]
    h, d = (got[(got["tf"] == tf) & (got["symbol"] == "a")].set_index(ix).sort_index() for tf in ("1h", "1d"))
    pd.testing.assert_series_equal(h["total_return"], d["total_return"])
    ratio = (h["sharpe"] / d["sharpe"]).dropna()
    assert len(ratio) and ratio.to_numpy() == pytest.approx(24**0.5)


def test_final_backtest_uses_all_equity(spark, bars):
    chosen = param_grid(spark, GRID).filter("combo_id = 1")
    got = final_backtest(to_spark(spark, bars), chosen, 3600, cfg=CFG).toPandas().set_index("symbol")
    want, _ = plain_backtest(bars[bars["symbol"] == "a"], 4, 3, 1.0, 0.01, size=1.0)
    assert got.loc["a", "total_return"] == pytest.approx(want["total_return"])
    one = replay_metrics(with_position(to_spark(spark, bars), 3600), chosen, 3600, CFG).toPandas()
    assert len(one) == 2


def test_ties_go_to_the_smallest_parameters(spark):
    rows = [(1, 20, 5, 1.0, 0.02, 3.0), (1, 10, 9, 1.0, 0.02, 3.0), (1, 10, 5, 2.0, 0.02, 3.0), (1, 5, 5, 1.0, 0.02, None)]
    log = spark.createDataFrame(rows, "split int, ma_window int, atr_window int, atr_mult double, sl_stop double, score double")
    got = best_trials(log).first()
    assert (got["ma_window"], got["atr_window"], got["train_score"]) == (10, 5, 3.0)


def test_a_broken_off_scan_goes_on(spark, bars, tmp_path):
    candles = to_spark(spark, bars).withColumns({"exchange": F.lit("x"), "tf": F.lit("1h")})
    short = candles.filter("symbol = 'a'").limit(5).withColumn("symbol", F.lit("c"))
    params, path = param_grid(spark, GRID), str(tmp_path / "results")
    assert scan_to(path, "s", candles.filter("symbol = 'a'"), params, cfg=CFG) == 1
    assert scan_to(path, "s", candles.unionByName(short), params, group_pairs=1, cfg=CFG) == 1
    assert scan_to(path, "s", candles.unionByName(short), params, cfg=CFG) == 0
    got = read_results(spark, path, "s")
    want = scan(candles, None, params, cfg=CFG)
    order = [*KEYS, "split", "set_name", "combo_id"]
    pd.testing.assert_frame_equal(
        got.select(*want.columns).orderBy(*order).toPandas(), want.orderBy(*order).toPandas(), rtol=1e-9
    )
    left = scan_skipped(candles.unionByName(short), got)
    assert {r["symbol"]: r["reason"] for r in left.collect()} == {
        "a": "stored", "b": "stored", "c": "fewer than 13 bars for 10 windows",
    }


def test_groups_have_equal_cost_and_read_their_own_files(spark, bars, tmp_path):
    pairs = [("x", "1h", f"s{i:03d}", 100_000 if i == 7 else 100) for i in range(400)]
    frame = spark.createDataFrame(pairs, "exchange string, tf string, symbol string, len long")
    got = scan_groups(frame, 20).toPandas()
    assert sorted(got["symbol"]) == [p[2] for p in pairs]
    sizes = got.groupby("group").size()
    assert sizes.max() <= 41 and 10 <= len(sizes) <= 21
    hot = got[got["symbol"] == "s007"]["group"].iloc[0]
    assert not (got["group"] == hot + 1).any()  # the long history fills the shares of groups after its own
    pd.testing.assert_frame_equal(
        got.sort_values("symbol", ignore_index=True),
        scan_groups(frame.repartition(3), 20).toPandas().sort_values("symbol", ignore_index=True),
    )
    path = tmp_path / "candles"
    to_spark(spark, bars).withColumns({"exchange": F.lit("x"), "tf": F.lit("1h")}).write.partitionBy(*KEYS).parquet(str(path))
    for part in path.glob("exchange=x/tf=1h/symbol=b/*.parquet"):
        part.write_bytes(b"not a file of candles")
    for crc in path.glob("exchange=x/tf=1h/symbol=b/.*.crc"):
        crc.write_bytes(b"")
    stored = spark.read.schema(to_spark(spark, bars).drop("symbol").schema.add("exchange", "string").add("tf", "string").add("symbol", "string")).parquet(str(path))
    assert pairs_only(stored, [{"exchange": "x", "tf": "1h", "symbol": "a"}]).count() == 260
    with pytest.raises(Exception):
        stored.select(F.sum("close")).collect()


def test_research_chain_ends_in_a_backtest_of_the_centre(spark):
    days = pd.concat([random_bars(s, 420, i, gaps=False) for i, s in enumerate("ab")])
    days["ts"] = pd.Timestamp("2024-01-01") + (days["ts"] - pd.Timestamp("2024-01-01")) * 24
    small = (Axis("ma_window", 4, 2, 4), Axis("atr_window", 3, 1, 3), Axis("atr_mult", 1, 1, 4, 4), Axis("sl_stop", 1, 1, 2, 100))
    got = research_chain(
        to_spark(spark, days), 86_400, 0.6, small, 60, d=replace(DEFAULTS, min_trades=1, max_drawdown=0.9)
    ).toPandas()
    assert len(got) == 2
    for _, g in got.iterrows():
        part = days[days["symbol"] == g["symbol"]].reset_index(drop=True)
        want, _ = plain_backtest(part, g["ma_window"], g["atr_window"], g["atr_mult"], g["sl_stop"], size=1.0)
        assert g["n_trades"] == want["n_trades"]
        assert g["total_return"] == pytest.approx(want["total_return"], abs=1e-9)
