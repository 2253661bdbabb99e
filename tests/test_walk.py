"""First hits, transitions of blocks, and their composition."""

import math

import numpy as np
import pandas as pd
from hypothesis import given, settings, strategies as st

from bandwalk.operators import replay
from bandwalk.operators.replay import ReplayConfig, block_transitions, leaving_states, replay_blocks
from bandwalk.operators.series import with_position
from bandwalk.operators.walk import Bars, FirstHit, Walkers, flags_of, transitions, walk
from bandwalk.session import settled
from tests.helpers import random_bars, to_spark
from tests.test_replay import GRID, SMALL, check, params


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(-1, 10), st.booleans(), st.data())
def test_first_hit(values, level, short, data):
    x = np.array(values, float)
    start = data.draw(st.integers(0, len(x)))
    hits = FirstHit(np.zeros(len(x)) if short else x, -x if short else np.zeros(len(x)))
    got = hits.find(np.array([int(short)]), np.array([start]), np.array([float(level)]))[0]
    assert got == next((i for i in range(start, len(x)) if x[i] <= level), len(x))


def block(seed, n):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 0.7, n))
    open_ = np.concatenate([[100.0], close[:-1]])
    high, low = np.maximum(open_, close) + rng.random(n), np.minimum(open_, close) - rng.random(n)
    mid = np.column_stack([close - rng.normal(0, 1, n), np.full(n, 100.0)])
    return Bars(open_, high, low, close), flags_of(mid, np.full((n, 2), 0.8), high, low)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1, 2, 7, 40]), st.sampled_from([None, 0.0, 0.004, 0.03]),
       st.sampled_from([-1, 0, 1]), st.floats(90, 110))
def test_a_transition_is_the_walk_from_any_state(seed, n, stop, side, px):
    bars, flags = block(seed, n)
    stop = math.nan if stop is None else stop
    for band in (0, 1):
        flat, longs, shorts = transitions(bars, flags, np.array([band]), np.array([stop]), 500)[0]
        start = Walkers(*(np.array([x]) for x in (band, stop, side, px, 77, 0)))
        left, _ = walk(bars, flags, start, 500)
        level = -math.inf if math.isnan(stop) else side * (px * (1 - side * stop))
        piece = flat if side == 0 else next(p for p in (longs if side > 0 else shorts) if p["level"] <= level)
        want = (int(left.side[0]), float(left.px[0]) if left.side[0] else None, int(left.pos[0]) if left.side[0] else 0)
        assert ((side, px, 77) if piece["held"] else (piece["side"], piece["px"], piece["pos"])) == want


def steady_rise(n):
    """Bars that never force a position shut after the first sixty."""
    bars = random_bars("a", n + 60, 7)
    rise = bars["close"].iloc[59] * 1.002 ** np.arange(1, n + 1)
    wiggle = 1 + 0.002 * np.sin(np.arange(n))
    for column, scale in (("open", 0.999), ("high", 1.004), ("low", 0.996), ("close", 1.0)):
        bars.loc[60:, column] = rise * wiggle * scale
    return bars


def test_a_run_of_64_open_blocks_takes_log2_rounds(spark, monkeypatch):
    bars = steady_rise(66 * 24)
    rows = [GRID[1], GRID[8], GRID[0], (12, 4, 3.0, 0.03)]
    taken, longest = [], []

    def counted(functions, known, ids):
        out, rounds = leaving_states(functions, known, ids)
        taken.append(rounds)
        longest.append(functions.groupBy(*ids).count().agg({"count": "max"}).first()[0])
        return out, rounds

    monkeypatch.setattr(replay, "leaving_states", counted)
    series = with_position(to_spark(spark, bars), 3600).cache()
    out = replay_blocks(series, params(spark, rows), SMALL)
    assert out.count() == out.filter("resolved").count() == 69 * len(rows)
    assert longest[0] >= 64 and taken[0] <= math.ceil(math.log2(longest[0])) + 1
    monkeypatch.setattr(replay, "leaving_states", leaving_states)
    check(spark, bars, rows, SMALL)


def test_composed_functions_equal_the_walk_through_all_blocks(spark):
    """Without a run-up every block but the first is open, whatever the bars do."""
    bars = pd.concat([random_bars("a", 260, 3), random_bars("b", 75, 4), steady_rise(150).assign(symbol="c")])
    check(spark, bars, GRID, ReplayConfig(block_bars=12, runup=0, max_window=20, combos_per_task=7))


def test_pieces_of_one_state_are_merged(spark):
    bars, flags = block(3, 400)
    for _, longs, shorts in transitions(bars, flags, np.array([0, 1]), np.array([0.01, 0.02]), 0):
        for pieces in (longs, shorts):
            states = [(p["held"], p["side"], p["pos"]) for p in pieces]
            assert all(a != b for a, b in zip(states, states[1:]))
            assert [p["level"] for p in pieces] == sorted((p["level"] for p in pieces), reverse=True) and pieces[-1]["level"] == -math.inf


def test_listed_combinations_do_not_travel_per_block(spark, monkeypatch):
    """Stored tables before the result hold blocks, not blocks x combinations; both routes agree."""
    bars = pd.concat([random_bars("a", 230, 1), random_bars("b", 97, 2), random_bars("c", 1, 3)])
    series = with_position(to_spark(spark, bars), 3600).cache()
    stored = []

    def counted(df):
        out = settled(df)
        stored.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(replay, "settled", counted)
    monkeypatch.setattr(replay, "_resolve", lambda blocks, work, done, *a: done)
    cfg = ReplayConfig(block_bars=24, runup=6, max_window=20, combos_per_task=5)
    replay_blocks(series, params(spark, GRID), cfg)
    (carried, n), (made, m) = stored
    assert carried == ["symbol", "blk", "ma", "atr"] and n == 10 + 5  # one per stretch between run-ups
    assert "resolved" in made and m == (10 + 5 + 1) * len(GRID)
    monkeypatch.undo()
    measure = lambda: replay.replay_metrics(series, params(spark, GRID), 3600, cfg).orderBy("symbol", "combo_id").toPandas()
    sent = measure()
    monkeypatch.setattr(replay, "MOST_COMBOS", 0)
    pd.testing.assert_frame_equal(sent, measure(), rtol=1e-9)
    none = params(spark, GRID).limit(0)
    assert replay_blocks(series, none, cfg).count() == 0
