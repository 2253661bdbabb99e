"""Walks from trade to trade inside one block of bars.

A position ends at the first bar that reaches its stop or at the next closing signal, and
nothing happens in between. So a walk needs three look-ups per trade and touches no other
bar: the next opening signal, the next closing signal (one running index per band), and the
first bar at or beyond a price (``FirstHit``). Many walkers, of different combinations or
with different starting states, go on together in arrays.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class FirstHit:
    """First bar that reaches a level, at any start: minima of runs of 1, 2, 4, ... bars.

    One table serves both sides: lows for longs, and negated highs, with negated levels, for shorts.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.size = len(low) + 1
        # the end of the bars is a hit for every level
        run = np.stack([np.append(low.astype(float), -np.inf), np.append(-high.astype(float), -np.inf)])
        self.minima = [run.ravel()]
        width = 1
        while width < self.size:
            longer = np.full_like(run, -np.inf)
            longer[:, :-width] = np.minimum(run[:, :-width], run[:, width:])
            run, width = longer, 2 * width
            self.minima.append(run.ravel())

    def find(self, short: np.ndarray, start: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The first bar from ``start`` on at or below ``level``; the number of bars if there is none."""
        base = short * self.size
        at = base + start
        for k in range(len(self.minima) - 1, -1, -1):
            at += (self.minima[k][at] > level) << k
        return at - base


class Flags(NamedTuple):
    """Signals per (bar, band), as tables of the next bar that has them, and the fill price."""

    opens: np.ndarray  # 1 a long, -1 a short
    next_open: np.ndarray
    next_close: np.ndarray  # of longs, then of shorts
    shut: np.ndarray  # both legs close, whatever was held
    px: np.ndarray


def _next(flag: np.ndarray) -> np.ndarray:
    """For every bar, and one past the end, the first bar from it on with the flag."""
    n = len(flag)
    out = np.full((n + 1, flag.shape[1]), n, np.int32)
    out[:-1] = np.where(flag, np.arange(n, dtype=np.int32)[:, None], n)
    return np.minimum.accumulate(out[::-1], axis=0)[::-1]


def flags_of(mid: np.ndarray, width: np.ndarray, high: np.ndarray, low: np.ndarray) -> Flags:
    """Signals of bands given as (bar, band); nothing is signalled while a line is unknown."""
    lower, upper = mid - width, mid + width
    high, low = high[:, None], low[:, None]
    le, lx, se, sx = low <= lower, high >= mid, high >= upper, low <= mid
    px = np.where(se, upper, np.where(le, lower, mid))
    flags = given_flags(le, lx, se, sx, px)
    return flags._replace(shut=flags.shut & ~np.isnan(mid + width))


def given_flags(le: np.ndarray, lx: np.ndarray, se: np.ndarray, sx: np.ndarray, px: np.ndarray) -> Flags:
    """Signals from entry and exit flags of both legs, each (bar, band).

    Both entries at once change nothing, nor do entry and exit of one leg; an entry of the other
    leg closes a position and turns it.
    """
    free = ~(le & se)
    open_l, open_s = le & ~lx & free, se & ~sx & free
    close_l, close_s = (lx & ~le & free) | open_s, (sx & ~se & free) | open_l
    return Flags(
        np.where(open_l, 1, np.where(open_s, -1, 0)).astype(np.int8), _next(open_l | open_s),
        np.stack([_next(close_l), _next(close_s)]), close_l & close_s, px,
    )


class Walkers(NamedTuple):
    """State of each walker: its band and stop, what it holds, and the bar it looks at next."""

    band: np.ndarray
    stop: np.ndarray  # NaN: none
    side: np.ndarray
    px: np.ndarray
    pos: np.ndarray
    bar: np.ndarray


class Steps(NamedTuple):
    """Closed trades in the order of their exits, per walker."""

    walker: np.ndarray
    side: np.ndarray
    pos: np.ndarray
    px: np.ndarray
    exit: np.ndarray
    out: np.ndarray
    stopped: np.ndarray


class Bars:
    """Prices of one block and their first-hit indexes."""

    def __init__(self, open_: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray):
        self.open, self.high, self.low, self.close = open_, high, low, close
        self.hits = FirstHit(low, high)

    def __len__(self) -> int:
        return len(self.close)


def walk(bars: Bars, flags: Flags, w: Walkers, offset: int = 0) -> tuple[Walkers, Steps]:
    """Every walker to the end of the bars; ``pos`` counts bars from ``-offset``."""
    end = len(bars)
    w = Walkers(w.band, np.where(np.isnan(w.stop), np.inf, w.stop), *(x.copy() for x in w[2:]))
    made: list[tuple] = []
    todo = np.flatnonzero(w.bar < end)
    while len(todo):
        # the flat ones enter at the next opening signal
        flat = todo[w.side[todo] == 0]
        if len(flat):
            at, band = flags.next_open[w.bar[flat], w.band[flat]], w.band[flat]
            w.bar[flat] = np.minimum(at + 1, end)
            if at.max() == end:
                some = at < end
                flat, at, band = flat[some], at[some], band[some]
                todo = todo[(w.side[todo] != 0) | (w.bar[todo] < end)]
            w.side[flat], w.px[flat], w.pos[flat] = flags.opens[at, band], flags.px[at, band], at + offset
        # those in a position leave at the stop or at the closing signal, whichever comes first
        held = todo[w.side[todo] != 0]
        side, band, start = w.side[held], w.band[held], w.bar[held]
        short = (side < 0).astype(np.int64)
        level = side * (w.px[held] * (1 - side * w.stop[held]))  # without a stop one that no bar reaches
        hit = bars.hits.find(short, start, level)
        closing = flags.next_close[short, start, band]
        leave = np.minimum(hit, closing)
        w.bar[held] = np.minimum(leave + 1, end)
        if leave.max(initial=0) == end:
            gone = leave < end
            held, leave, side, band, hit, closing, level = (x[gone] for x in (held, leave, side, band, hit, closing, level))
        stopped = hit <= closing
        px = flags.px[leave, band]
        made.append((held, side, w.pos[held], w.px[held], leave,
                     np.where(stopped, side * np.minimum(side * bars.open[leave], level), px), stopped))
        turn = ~stopped & (flags.opens[leave, band] == -side)
        w.side[held] = np.where(turn, -side, 0)
        w.px[held], w.pos[held] = px, leave + offset  # of no account unless it turned
        todo = todo[w.bar[todo] < end]
    if not made:
        made = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float, np.int64, float, bool))]
    steps = Steps(*(np.concatenate(x) for x in zip(*made)))
    # each walker's trades were made in order
    order = np.argsort(steps.walker, kind="stable")
    return w, Steps(*(x[order] for x in steps))


def staircase(lows: np.ndarray) -> np.ndarray:
    """Bars that are lower than all before them: where some level is reached for the first time."""
    before = np.minimum.accumulate(np.concatenate([[np.inf], lows[:-1]]))
    return np.flatnonzero(lows < before)


def transitions(bars: Bars, flags: Flags, band: np.ndarray, stop: np.ndarray, offset: int) -> list[tuple[dict, list[dict], list[dict]]]:
    """(flat, longs, shorts) per combination: the state a block leaves for every state it is entered in.

    ``flat`` is the state after entering flat. ``longs`` are pieces in order: a long whose stop lies
    at L takes the first piece with ``level`` <= L (for ``shorts``, levels and L are negated). A piece is a
    state, or ``held``: the position is still the one that came in.
    """
    end = len(bars)
    starts, spans = [], []  # walkers, and per combination and side: levels, first walker, whether held
    for b, s in zip(band, stop):
        starts.append((b, s, 0, 1.0, 0, 0))
        for side, edge in ((1, bars.low), (-1, -bars.high)):
            c = int(flags.next_close[int(side < 0), 0, b])
            stairs = staircase(edge[: c + 1]) if not np.isnan(s) else np.zeros(0, np.int64)
            spans.append((edge[stairs], len(starts), c == end))
            starts += [(b, s, 0, 1.0, 0, int(i) + 1) for i in stairs]
            if c < end:
                turn = flags.opens[c, b] == -side
                starts.append((b, s, -side if turn else 0, flags.px[c, b] if turn else 1.0, c + offset if turn else 0, c + 1))
    columns = [np.array(x) for x in zip(*starts)]
    w, _ = walk(bars, flags, Walkers(columns[0], columns[1].astype(float), *(c.astype(t) for c, t in zip(
        columns[2:], (np.int64, float, np.int64, np.int64)))), offset)

    def state(i: int, level: float = -np.inf) -> dict:
        side = int(w.side[i])
        return {"level": float(level), "held": False, "side": side, "px": float(w.px[i]) if side else None,
                "pos": int(w.pos[i]) if side else 0}

    out = []
    for k in range(len(band)):
        sides = []
        for levels, at, held in spans[2 * k : 2 * k + 2]:
            pieces = [state(at + n, level) for n, level in enumerate(levels)]
            pieces.append({"level": -np.inf, "held": True, "side": 0, "px": None, "pos": 0} if held else state(at + len(levels)))
            # neighbours that lead to the same state are one piece, down to the lower level
            same = [{**p, "level": 0.0} for p in pieces]
            sides.append([p for n, p in enumerate(pieces) if n + 1 == len(pieces) or same[n] != same[n + 1]])
        out.append((state(spans[2 * k][1] - 1), *sides))
    return out
