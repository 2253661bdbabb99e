import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandwalk.operators.params import GRID, RESEARCH_SPACE, Axis, param_grid, param_sample, size_of
from bandwalk.operators.series import with_position
from bandwalk.operators.windows import (
    assign_segments,
    calendar_windows,
    locate_windows,
    rolling_split,
    series_bounds,
    too_short,
    window_sizing,
    window_summary,
    without_windows,
)
from tests.helpers import random_bars, to_spark


def bounds(spark, **columns):
    return spark.createDataFrame([{"symbol": "a", **columns}])


@pytest.mark.parametrize("n_bars", [5, 37, 100, 719, 10_000])
def test_rolling_split_tiles_the_test_sets(spark, n_bars):
    got = rolling_split(bounds(spark, len=n_bars)).toPandas()
    t = n_bars * 3 // 37
    if t == 0:
        assert got.empty
        return
    test = got[got["set_name"] == "test"].sort_values("split")
    train = got[got["set_name"] == "train"].sort_values("split")
    assert len(test) == len(train) == 10
    assert ((test["hi"] - test["lo"]) == t).all()
    assert (test["lo"].iloc[1:].to_numpy() == test["hi"].iloc[:-1].to_numpy()).all()
    assert (train["hi"].to_numpy() == test["lo"].to_numpy()).all()
    assert got["hi"].max() <= n_bars and got["lo"].min() == 0


def calendar(spark, days, train, test, step, half_open=False):
    frame = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=days, freq="D")})
    for c in ("open", "high", "low", "close", "volume"):
        frame[c] = 1.0
    frame["symbol"] = "a"
    series = with_position(to_spark(spark, frame), 86400, block_bars=16)
    sized = series_bounds(series).withColumns(
        {"train_days": F.lit(train), "test_days": F.lit(test), "step_days": F.lit(step)}
    )
    segments = locate_windows(series, calendar_windows(sized, half_open), 86400, block_bars=16)
    return window_summary(assign_segments(series, segments, block_bars=16)).toPandas()


def test_boundary_bar_is_in_both_sets(spark):
    got = calendar(spark, 101, 20, 10, 10).set_index(["split", "set_name"]).sort_index()
    assert len(got) == 2 * 8
    assert (got.xs("train", level=1)["last_ts"] == got.xs("test", level=1)["first_ts"]).all()
    assert set(got["n_bars"]) == {21, 11}
    half = calendar(spark, 101, 20, 10, 10, True).set_index(["split", "set_name"])
    assert set(half.xs("train", level=1)["n_bars"]) == {20}
    assert set(half.xs("test", level=1)["n_bars"]) == {11}


def test_too_short_history_has_no_windows(spark):
    assert calendar(spark, 25, 20, 10, 10).empty


def sized(spark, days, train, test, step, symbol="a"):
    start = pd.Timestamp("2020-01-01")
    return bounds(
        spark, start_ts=start.to_pydatetime(), end_ts=(start + pd.Timedelta(days=days)).to_pydatetime(), len=days
    ).withColumns(
        {"symbol": F.lit(symbol), "train_days": F.lit(train), "test_days": F.lit(test), "step_days": F.lit(step)}
    )


def test_histories_without_windows_are_named(spark):
    all_ = sized(spark, 101, 20, 10, 10).unionByName(sized(spark, 9, 0, 0, 0, "b")).unionByName(
        sized(spark, 25, 20, 10, 5, "c")
    )
    assert {r["symbol"] for r in calendar_windows(all_).select("symbol").distinct().collect()} == {"a"}
    assert {r["symbol"]: r["reason"] for r in without_windows(all_).collect()} == {
        "b": "step below one day", "c": "no room for a window",
    }
    with pytest.raises(ValueError, match="step_days"):
        calendar_windows(all_, step_days=0)
    fixed = calendar_windows(all_, step_days=70)
    assert {(r["symbol"], r["split"]) for r in fixed.collect()} == {("a", 0), ("a", 1), ("b", 0)}


def test_short_series_are_named(spark):
    lens = spark.createDataFrame([("a", 12), ("b", 13), ("c", 500)], "symbol string, len long")
    assert {r["symbol"] for r in rolling_split(lens).select("symbol").distinct().collect()} == {"b", "c"}
    short = too_short(lens).collect()
    assert [(r["symbol"], r["len"], r["reason"]) for r in short] == [("a", 12, "fewer than 13 bars for 10 windows")]


def test_a_larger_sample_starts_with_the_smaller_one(spark):
    windows = spark.createDataFrame([(i,) for i in range(3)], "split int")
    for axes in (RESEARCH_SPACE, RESEARCH_SPACE[:1], RESEARCH_SPACE[:3]):
        total = size_of(axes)
        small = {tuple(r) for r in param_sample(windows, 7, axes=axes).collect()}
        large = [tuple(r) for r in param_sample(windows, min(900, total), axes=axes).collect()]
        assert small == {r for r in large if r[1] < 7}
        assert len(set(r[:1] + r[2:] for r in large)) == len(large) == 3 * min(900, total)


def test_sizing_matches_integer_arithmetic(spark):
    for days in (30, 101, 365, 2404):
        end = pd.Timestamp("2020-01-01") + pd.Timedelta(days=days, hours=5)
        got = window_sizing(
            bounds(spark, start_ts=pd.Timestamp("2020-01-01").to_pydatetime(), end_ts=end.to_pydatetime(), len=1)
        ).first()
        w = days // 10
        assert got["train_days"] == w * 2 // 3
        assert got["test_days"] == w - w * 2 // 3
        assert got["step_days"] == (days - w * 2 // 3) // 10


@pytest.mark.parametrize("block", [8, 1000])
def test_segments_hold_exactly_their_bars(spark, block):
    series = with_position(to_spark(spark, random_bars("a", 111, 1)), 3600)
    segments = rolling_split(series_bounds(series))
    got = assign_segments(series, segments, block_bars=block).toPandas()
    for row in segments.collect():
        part = got[(got["split"] == row["split"]) & (got["set_name"] == row["set_name"])]
        assert sorted(part["pos"]) == list(range(row["hi"] - row["lo"]))
        assert (part["len"] == row["hi"] - row["lo"]).all()


def test_production_grid(spark):
    grid = param_grid(spark).toPandas()
    assert len(grid) == 8250 == size_of(GRID)
    assert sorted(grid["ma_window"].unique()) == list(range(20, 220, 20))
    assert sorted(grid["atr_window"].unique()) == list(range(10, 220, 20))
    assert sorted(grid["atr_mult"].unique()) == [1 + k / 2 for k in range(15)]
    assert sorted(grid["sl_stop"].unique()) == [0.02, 0.04, 0.06, 0.08, 0.1]
    assert grid["combo_id"].is_unique


def test_samples_are_distinct_and_repeatable(spark):
    windows = spark.createDataFrame([(i,) for i in range(5)], "split int")
    a = param_sample(windows).toPandas().sort_values(["split", "combo_id"], ignore_index=True)
    b = param_sample(windows.repartition(3)).toPandas().sort_values(["split", "combo_id"], ignore_index=True)
    pd.testing.assert_frame_equal(a, b)
    assert (a.groupby("split").size() == 200).all()
    assert not a.duplicated(["split", "ma_window", "atr_window", "atr_mult", "sl_stop"]).any()
    assert a["ma_window"].between(10, 500).all() and a["sl_stop"].between(0.01, 0.15).all()
    assert size_of(RESEARCH_SPACE) == 99 * 20 * 39 * 15


def test_a_small_space_is_sampled_whole(spark):
    axes = (Axis("ma_window", 5, 5, 3), Axis("atr_window", 5, 5, 2))
    got = param_sample(spark.createDataFrame([(1,)], "split int"), 200, axes=axes).toPandas()
    assert len(got) == 6
