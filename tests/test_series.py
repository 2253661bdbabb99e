"""Blocked series operators: the block size must never show in the result."""

import numpy as np
import pandas as pd
import pytest

from bandwalk.operators import backtest as bt
from bandwalk.operators import indicators as ind
from bandwalk.operators.ranking import ranked
from bandwalk.operators.series import blocks_until_vanished, carried, with_position
from bandwalk.operators.signals import fill_price, signals
from pyspark.sql import functions as F
from tests.helpers import channel, plain_backtest, random_bars, to_spark


@pytest.fixture(scope="module")
def bars():
    # One key holds most of the rows.
    return pd.concat([random_bars("hot", 400, 1), random_bars("b", 40, 2), random_bars("c", 1, 3)])


@pytest.mark.parametrize("block", [7, 64, 10_000])
def test_positions_are_dense_per_key(spark, bars, block):
    got = with_position(to_spark(spark, bars), 3600, block_bars=block).toPandas()
    for symbol, group in got.groupby("symbol"):
        group = group.sort_values("ts")
        assert group["pos"].tolist() == list(range(len(group)))
        assert (group["len"] == len(group)).all()
        assert len(group) == (bars["symbol"] == symbol).sum()


@pytest.mark.parametrize("block", [16, 10_000])
def test_moving_averages_and_atr(spark, bars, block):
    series = with_position(to_spark(spark, bars), 3600)
    got = ind.keltner_channel(series, 12, 9, 1.5, block_bars=block).toPandas()
    env = ind.atr_envelope(series, 12, 9, 1.5, block_bars=block).toPandas()
    mixed = ind.atr_envelope(series, 12, 9, 1.5, kind="wilder", block_bars=block).toPandas()
    for frame, kinds in ((got, {}), (env, {"ma_kind": "sma", "atr_kind": "simple"}), (mixed, {"ma_kind": "sma"})):
        for symbol in ("hot", "b", "c"):
            pdf = bars[bars["symbol"] == symbol]
            mid, width = channel(pdf, 12, 9, **kinds)
            part = frame[frame["symbol"] == symbol].sort_values("pos")
            np.testing.assert_allclose(part["mid"], np.array(mid, dtype=float), rtol=1e-12)
            np.testing.assert_allclose(part["atr"], np.array(width, dtype=float), rtol=1e-11)


def test_bank_equals_single_series(spark, bars):
    series = with_position(to_spark(spark, bars), 3600)
    bank = ind.indicator_bank(series, [5, 12], [4, 9], block_bars=50)
    single = ind.ema(series, 12).join(ind.atr(series, 9).select("symbol", "pos", "atr"), ["symbol", "pos"])
    both = bank.select("symbol", "pos", "ma_12", "atr_9").join(single, ["symbol", "pos"]).toPandas()
    np.testing.assert_allclose(both["ma_12"], both["ema"], rtol=1e-12)
    np.testing.assert_allclose(both["atr_9"], both["atr"], rtol=1e-12)


def test_warm_up_lengths(spark):
    for n in (9, 10, 11):
        series = with_position(to_spark(spark, random_bars("a", n, 4)), 3600)
        got = signals(ind.keltner_channel(series, 10, 10, 1.0)).toPandas()
        assert got["mid"].notna().sum() == max(0, n - 10)
        flags = got[["long_entry", "long_exit", "short_entry", "short_exit"]]
        assert not flags[got["mid"].isna()].any().any()


@pytest.mark.parametrize("block", [16, 10_000])
def test_backtest_is_the_plain_loop(spark, bars, block):
    series = with_position(to_spark(spark, bars), 3600)
    got = bt.backtest(ind.atr_envelope(series, 8, 5, 0.6), 3600, block_bars=block)
    got = got.toPandas().set_index("symbol")
    for symbol in ("hot", "b", "c"):
        want, _ = plain_backtest(
            bars[bars["symbol"] == symbol], 8, 5, 0.6, None, ma_kind="sma", atr_kind="simple"
        )
        for name, value in want.items():
            if value is None:
                assert pd.isna(got.loc[symbol, name])
            else:
                assert got.loc[symbol, name] == pytest.approx(value, rel=1e-9, abs=1e-10), name
    assert got["max_drawdown"].between(0, 1).all()


def test_all_four_flags_change_nothing(spark):
    row = dict(symbol="a", low=1.0, high=9.0, mid=5.0, lower=4.0, upper=6.0, pos=0, len=1)
    df = spark.createDataFrame([row]).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = bt.positions(fill_price(signals(df))).first()
    assert got["px"] == 6.0 and got["position"] == 0
    assert all(got[c] for c in ("long_entry", "long_exit", "short_entry", "short_exit"))


@pytest.mark.parametrize("rows", [3, 1000])
def test_carried_prefix(spark, rows):
    pdf = pd.DataFrame({"symbol": ["a"] * 50 + ["b"] * 5, "i": [*range(50), *range(5)]})
    pdf["v"] = (pdf["i"] * 7) % 11
    got = carried(spark.createDataFrame(pdf), "i", {"s": ("sum", "v"), "m": ("max", "v")}, block_rows=rows).toPandas()
    for _, group in got.groupby("symbol"):
        group = group.sort_values("i")
        assert group["s"].tolist() == [0, *group["v"].cumsum()[:-1]]
        np.testing.assert_array_equal(group["m"].iloc[1:].to_numpy(dtype=float), group["v"].cummax()[:-1])
        assert pd.isna(group["m"].iloc[0])


def test_vanishing_weight_is_really_zero():
    for alpha, block in ((0.002, 64), (0.5, 8), (1 / 210, 8192)):
        assert (1 - alpha) ** (block * blocks_until_vanished(alpha, block)) == 0.0


def test_ranked_is_a_total_order(spark):
    df = spark.range(1000).select("id", (F.col("id") * 37 % 101).alias("v"))
    got = ranked(df, [F.desc("v"), F.asc("id")]).toPandas().sort_values("rank")
    want = df.toPandas().sort_values(["v", "id"], ascending=[False, True])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["rank"].tolist() == list(range(1, 1001))


def test_returns_of_a_curve(spark):
    curve = spark.createDataFrame([("a", i, 4, e) for i, e in enumerate((10.0, 11.0, 9.9, 9.9))], "symbol string, pos long, len long, equity double")
    got = bt.equity_returns(curve, block_bars=2).orderBy("pos").toPandas()["ret"]
    np.testing.assert_allclose(got.iloc[1:], [0.1, -0.1, 0.0], atol=1e-12)
