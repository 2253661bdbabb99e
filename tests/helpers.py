"""Random bars and a plain bar-by-bar backtest to compare with."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def random_bars(symbol: str, n: int, seed: int, start="2024-01-01", gaps: bool = True) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    open_ = np.concatenate([[100.0], close[:-1]]) * (1 + rng.normal(0, 0.002, n))
    high = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, 0.006, n)))
    low = np.minimum(open_, close) * (1 - np.abs(rng.normal(0, 0.006, n)))
    hours = np.cumsum(rng.integers(1, 4, n)) if gaps else np.arange(n)
    return pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.Timestamp(start) + pd.to_timedelta(hours, unit="h"),
            "open": open_, "high": high, "low": low, "close": close, "volume": 1.0,
        }
    )


def to_spark(spark, pdf: pd.DataFrame):
    schema = ("symbol string, ts timestamp_ntz, open double, high double, low double, close double, "
              "volume double")
    return spark.createDataFrame(pdf[["symbol", "ts", "open", "high", "low", "close", "volume"]], schema)


def channel(pdf, ma, atr, ma_kind="ema", atr_kind="wilder"):
    """Mid and ATR known before each bar, as plain lists with None in the warm-up."""
    h, l, c = pdf["high"].tolist(), pdf["low"].tolist(), pdf["close"].tolist()
    tr = [h[0] - l[0]] + [
        max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])) for i in range(1, len(c))
    ]

    def mean(x, n, kind, alpha):
        out, e = [], None
        for i, v in enumerate(x):
            if kind == "roll":
                out.append(math.fsum(x[i - n + 1 : i + 1]) / n if i >= n - 1 else None)
            else:
                e = v if e is None else alpha * v + (1 - alpha) * e
                out.append(e if i >= n - 1 else None)
        return [None] + out[:-1]

    mid = mean(c, ma, "roll" if ma_kind == "sma" else "exp", 2 / (ma + 1))
    width = mean(tr, atr, "roll" if atr_kind == "simple" else "exp", 1 / atr)
    return mid, width


def plain_backtest(pdf, ma, atr, mult, sl, size=0.3, fees=0.001, cash=10000.0, **kinds):
    """One pass over the bars; returns metrics and trades."""
    mid, width = channel(pdf, ma, atr, **kinds)
    side, p_in, entry, base, eq = 0, None, None, cash, cash
    peak, drop, rets, n_open, paid, trades, ruined = cash, 0.0, [], 0, 0.0, [], False
    rows = pdf[["open", "high", "low", "close"]].to_numpy()
    for i, (o, h, l, c) in enumerate(rows):
        le = lx = se = sx = False
        if mid[i] is not None and width[i] is not None:
            le, se = l <= mid[i] - mult * width[i], h >= mid[i] + mult * width[i]
        if mid[i] is not None:
            lx, sx = h >= mid[i], l <= mid[i]
        px = mid[i] + mult * width[i] if se else mid[i] - mult * width[i] if le else mid[i]
        out, stopped = None, False
        if side and sl is not None:
            level = p_in * (1 - side * sl)
            if side > 0 and l <= level:
                out, stopped = min(o, level), True
            elif side < 0 and h >= level:
                out, stopped = max(o, level), True
        if not stopped and not (le and se):
            if (side > 0 and lx and not le) or (side < 0 and sx and not se):
                out = px
        was = side
        if out is not None:
            r = size * (side * (out / p_in - 1) - fees - fees * out / p_in)
            if not ruined:
                paid += base * size * fees * out / p_in
            trades.append((side, entry, i, p_in, out, r, "stop" if stopped else "signal"))
            base, side = max(base * (1 + r), 0.0), 0
        if not stopped and not (le and se):
            new = 1 if le and not lx and was <= 0 else -1 if se and not sx and was >= 0 else 0
            if new:
                side, p_in, entry = new, px, i
                if not ruined:
                    n_open += 1
                    paid += base * size * fees
        now = base * (1 + size * (side * (c / p_in - 1) - fees)) if side else base
        now = 0.0 if ruined else max(now, 0.0)
        rets.append(now / eq - 1 if eq > 0 else 0.0)
        eq = now
        if eq <= 0:
            ruined, base = True, 0.0
        peak = max(peak, eq)
        drop = max(drop, 1 - eq / peak)
    sd = np.std(rets, ddof=1) if len(rets) > 1 else 0.0
    return {
        "sharpe": np.mean(rets) / sd * math.sqrt(365 * 24) if sd > 0 else None,
        "total_return": eq / cash - 1, "max_drawdown": drop, "n_trades": n_open, "fees_paid": paid,
    }, trades
