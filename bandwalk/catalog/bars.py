"""Queries over candles: indicators, signals, backtests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from bandwalk.catalog.base import (
    BARS_1D,
    BARS_1H,
    FLAGS,
    HELD,
    REGISTRY,
    ctes,
    curve,
    envelope,
    indexed,
    query,
    recursive_mean,
    rolling,
    rounded,
    tr_of,
    walk,
    walk_metrics,
)
from bandwalk.fixtures import BAR_SECONDS_1D, BAR_SECONDS_1H, bars_1d, bars_1h
from bandwalk.operators import backtest as bt
from bandwalk.operators import indicators as ind
from bandwalk.operators.replay import ReplayConfig, channel_metrics, replay_trades
from bandwalk.operators.series import with_position
from bandwalk.operators.signals import fill_price, signals
from bandwalk.plans.fold import Fold, fold_bars
from bandwalk.plans.walkforward import evaluate_strategy, final_backtest, strategy_trades, strategy_with_stops
from bandwalk.sources.candles import complete, incomplete


def hourly(spark, sf) -> DataFrame:
    return with_position(bars_1h(spark, sf), BAR_SECONDS_1H)


def daily(spark, sf) -> DataFrame:
    return with_position(bars_1d(spark, sf), BAR_SECONDS_1D)


def combos(spark, *rows) -> DataFrame:
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "combo_id int, ma_window int, atr_window int, atr_mult double, sl_stop double",
    )


# ---- indicators -------------------------------------------------------------------


@query("sma", ctes(*indexed(BARS_1D)) + f"select symbol, ts, round({rolling('close', 20)}, 9) as sma from ix")
def _(spark, sf):
    return rounded(ind.sma(daily(spark, sf), 20).select("symbol", "ts", "sma"), 9)


@query("true_range", ctes(*indexed(BARS_1D), *tr_of("ix")) + "select symbol, ts, round(tr, 8) as tr from trs")
def _(spark, sf):
    return rounded(ind.true_range(daily(spark, sf)).select("symbol", "ts", "tr"))


@query(
    "ema",
    ctes(*indexed(BARS_1H), ("e", recursive_mean("ix", "close", "(2.0/13)", "12")))
    + "select ix.symbol, ix.ts, round(e.v, 8) as ema from ix left join e on e.symbol = ix.symbol and e.pos = ix.pos",
)
def _(spark, sf):
    return rounded(ind.ema(hourly(spark, sf), 12).select("symbol", "ts", "ema"))


@query(
    "atr_wilder",
    ctes(*indexed(BARS_1H), *tr_of("ix"), ("e", recursive_mean("trs", "tr", "(1.0/14)", "14")))
    + "select ix.symbol, ix.ts, round(e.v, 8) as atr from ix left join e on e.symbol = ix.symbol and e.pos = ix.pos",
)
def _(spark, sf):
    return rounded(ind.atr(hourly(spark, sf), 14).select("symbol", "ts", "atr"))


@query(
    "atr_simple",
    ctes(*indexed(BARS_1D), *tr_of("ix")) + f"select symbol, ts, round({rolling('tr', 14)}, 8) as atr from trs",
)
def _(spark, sf):
    return rounded(ind.atr(daily(spark, sf), 14, kind="simple").select("symbol", "ts", "atr"))


@query(
    "shift1",
    ctes(*indexed(BARS_1D))
    + "select symbol, ts, round(lag(close) over (partition by symbol order by pos), 8) as close from ix",
)
def _(spark, sf):
    return rounded(ind.shift1(daily(spark, sf), ["close"]).select("symbol", "ts", "close"))


@query(
    "bands",
    ctes(*indexed(BARS_1D), *tr_of("ix"))
    + f"""select symbol, ts, round(ma - 1.5 * a, 9) as lower, round(ma + 1.5 * a, 9) as upper
          from (select *, {rolling('close', 20)} as ma, {rolling('tr', 10)} as a from trs)""",
)
def _(spark, sf):
    series = ind.atr(ind.sma(daily(spark, sf), 20, out="mid"), 10, "simple")
    return rounded(ind.bands(series, 1.5).select("symbol", "ts", "lower", "upper"), 9)


CHANNEL_COLUMNS = ("symbol", "ts", "mid", "atr", "lower", "upper")
def channel_sql(digits: int) -> str:
    picked = ", ".join(f"round({c}, {digits}) as {c}" for c in CHANNEL_COLUMNS[2:])
    return f"select symbol, ts, {picked} from ch"


# Rolling means of the daily prices lie on a grid of 5e-9, so 9 digits print them exactly.


@query("atr_envelope", ctes(*envelope(BARS_1D, 20, 10, 0.5)) + channel_sql(9))
def _(spark, sf):
    return rounded(ind.atr_envelope(daily(spark, sf), 20, 10, 0.5).select(*CHANNEL_COLUMNS), 9)


def keltner_sql(ma: int, atr: int, mult: float) -> list[tuple[str, str]]:
    return [
        *indexed(BARS_1H),
        *tr_of("ix"),
        ("m", recursive_mean("trs", "close", f"(2.0/{ma + 1})", str(ma))),
        ("a", recursive_mean("trs", "tr", f"(1.0/{atr})", str(atr))),
        ("ch", f"""select t.*, m.v as mid, a.v as atr, m.v - {mult} * a.v as lower, m.v + {mult} * a.v as upper
                   from trs t left join m on m.symbol = t.symbol and m.pos = t.pos - 1
                   left join a on a.symbol = t.symbol and a.pos = t.pos - 1"""),
    ]


@query("keltner_channel", ctes(*keltner_sql(10, 5, 1.0)) + channel_sql(8))
def _(spark, sf):
    return rounded(ind.keltner_channel(hourly(spark, sf), 10, 5, 1.0).select(*CHANNEL_COLUMNS))


def _bank_sql() -> str:
    parts = [*indexed(BARS_1H), *tr_of("ix")]
    picks, joins = [], []
    for kind, n, alpha, col in (
        [("ma", n, f"(2.0/{n + 1})", "close") for n in (10, 20)]
        + [("atr", n, f"(1.0/{n})", "tr") for n in (5, 14)]
    ):
        name = f"{kind}_{n}"
        parts.append((f"c_{name}", recursive_mean("trs", col, alpha, str(n))))
        picks.append(f"round(c_{name}.v, 8) as {name}")
        joins.append(f"left join c_{name} on c_{name}.symbol = t.symbol and c_{name}.pos = t.pos")
    return ctes(*parts) + f"select t.symbol, t.ts, {', '.join(picks)} from trs t {' '.join(joins)}"


@query("indicator_bank", _bank_sql())
def _(spark, sf):
    bank = ind.indicator_bank(hourly(spark, sf), [10, 20], [5, 14])
    return rounded(bank.select("symbol", "ts", "ma_10", "ma_20", "atr_5", "atr_14"))


# ---- signals ----------------------------------------------------------------------


def envelope_1d(spark, sf) -> DataFrame:
    return ind.atr_envelope(daily(spark, sf), 20, 10, 0.5)


SLICE = [*envelope(BARS_1D, 20, 10, 0.5), *FLAGS]


@query("signals", ctes(*SLICE) + "select symbol, ts, long_entry, long_exit, short_entry, short_exit from flags")
def _(spark, sf):
    return signals(envelope_1d(spark, sf)).select(
        "symbol", "ts", "long_entry", "long_exit", "short_entry", "short_exit"
    )


@query("fill_price", ctes(*SLICE) + "select symbol, ts, round(px, 9) as px from priced")
def _(spark, sf):
    return rounded(fill_price(signals(envelope_1d(spark, sf))).select("symbol", "ts", "px"), 9)


# ---- backtest without a stop --------------------------------------------------------


def held_1d(spark, sf) -> DataFrame:
    return bt.positions(fill_price(signals(envelope_1d(spark, sf))))


def curve_1d(spark, sf) -> DataFrame:
    return bt.equity_curve(held_1d(spark, sf))


HELD_SQL = [*SLICE, *HELD]
CURVE_SQL = ctes(*HELD_SQL, *curve(0.3))
YEAR_1D = repr((365 * 86400 / BAR_SECONDS_1D) ** 0.5)
YEAR_1H = repr((365 * 86400 / BAR_SECONDS_1H) ** 0.5)


@query("positions", ctes(*HELD_SQL) + "select symbol, ts, cast(position as int) as position from held")
def _(spark, sf):
    return held_1d(spark, sf).select("symbol", "ts", "position")


TRADES_SQL = [
    *HELD_SQL,
    ("t1", """select *, position <> 0 and position <> coalesce(lag(position) over (partition by symbol order by pos), 0) as opened,
              lead(px) over (partition by symbol order by pos) as npx, lead(ts) over (partition by symbol order by pos) as nts from held"""),
    ("t2", "select *, sum(cast(opened as int)) over (partition by symbol order by pos) as trade from t1"),
    ("t3", """select symbol, trade, arg_min(position, pos) as side, min(ts) as entry_ts, arg_min(px, pos) as entry_px,
              arg_max(struct_pack(nts := nts, npx := npx, ts := ts, c := close), pos) as e
              from t2 where position <> 0 group by symbol, trade"""),
    ("t4", """select symbol, cast(side as int) as side, entry_ts, entry_px, coalesce(e.nts, e.ts) as exit_ts,
              case when e.nts is null then e.c else e.npx end as exit_px, e.nts is null as is_open from t3"""),
]


@query(
    "trades",
    ctes(*TRADES_SQL)
    + """select symbol, side, entry_ts, round(entry_px, 9) as entry_px, exit_ts, round(exit_px, 9) as exit_px, is_open,
         round(0.3 * (side * (exit_px / entry_px - 1) - 0.001 - case when is_open then 0 else 0.001 * exit_px / entry_px end), 8) as ret from t4""",
)
def _(spark, sf):
    return rounded(bt.trades(held_1d(spark, sf)), 9, ret=8)


@query("equity_curve", CURVE_SQL + "select symbol, ts, round(equity, 3) as equity, round(peak, 3) as peak from eq")
def _(spark, sf):
    return rounded(curve_1d(spark, sf).select("symbol", "ts", "equity", "peak"), 3)


@query(
    "total_return",
    CURVE_SQL + "select symbol, round(arg_max(equity, pos) / 10000 - 1, 8) as total_return from eq group by symbol",
)
def _(spark, sf):
    return rounded(bt.total_return(curve_1d(spark, sf)))


@query(
    "max_drawdown",
    CURVE_SQL + "select symbol, round(max(1 - equity / peak), 8) as max_drawdown from eq group by symbol",
)
def _(spark, sf):
    return rounded(bt.max_drawdown(curve_1d(spark, sf)))


SHARPE_SQL = "avg(equity / prev_equity - 1) / nullif(stddev_samp(equity / prev_equity - 1), 0)"


@query(
    "sharpe",
    CURVE_SQL + f"select symbol, round({SHARPE_SQL} * {YEAR_1D}, 6) as sharpe from eq group by symbol",
)
def _(spark, sf):
    return rounded(bt.sharpe(curve_1d(spark, sf), BAR_SECONDS_1D), 6)


@query(
    "trade_count",
    CURVE_SQL + "select symbol, count(*) filter (where opened) as n_trades from eq group by symbol",
)
def _(spark, sf):
    return bt.trade_count(curve_1d(spark, sf))


def metrics_sql(year: str) -> str:
    return f"""select symbol, round({SHARPE_SQL} * {year}, 6) as sharpe,
      round(arg_max(equity, pos) / 10000 - 1, 8) as total_return, round(max(1 - equity / peak), 8) as max_drawdown,
      count(*) filter (where opened) as n_trades,
      round(count(*) filter (where closed and f > 1) / nullif(count(*) filter (where closed), 0), 8) as win_rate,
      round(sum(fees_paid), 6) as fees_paid, round(arg_max(equity, pos), 6) as end_equity
      from eq group by symbol"""


DIGITS = {"sharpe": 6, "fees_paid": 6, "end_equity": 6}


def envelope_metrics(spark, sf) -> DataFrame:
    """Flagship: ATR-envelope backtest metrics per symbol on hourly candles."""
    channel = ind.atr_envelope(hourly(spark, sf), 10, 5, 1.0)
    return rounded(channel_metrics(channel, BAR_SECONDS_1H), **DIGITS)


query(
    "metrics",
    ctes(*envelope(BARS_1H, 10, 5, 1.0), *FLAGS, *HELD, *curve(0.3)) + metrics_sql(YEAR_1H),
)(envelope_metrics)


@query("metrics_daily", CURVE_SQL + metrics_sql(YEAR_1D))
def _(spark, sf):
    return rounded(bt.metrics(curve_1d(spark, sf), BAR_SECONDS_1D), **DIGITS)


def touch_strategy(series: DataFrame, ma_window: int, atr_window: int, atr_mult: float) -> DataFrame:
    """A user strategy: column expressions only."""
    return fill_price(signals(ind.atr_envelope(series, ma_window, atr_window, atr_mult)))


@query(
    "user_strategy",
    ctes(*envelope(BARS_1D, 15, 8, 0.4), *FLAGS, *HELD, *curve(1.0)) + metrics_sql(YEAR_1D),
)
def _(spark, sf):
    out = evaluate_strategy(
        bars_1d(spark, sf),
        touch_strategy,
        {"ma_window": 15, "atr_window": 8, "atr_mult": 0.4},
        BAR_SECONDS_1D,
        size=1.0,
    )
    return rounded(out, **DIGITS)


# ---- backtest with a stop -----------------------------------------------------------

STOP_PARAMS = ((10, 5, 1.0, 0.01), (20, 14, 0.5, 0.002))


def stop_walk(size: float) -> list[tuple[str, str]]:
    parts = [*indexed(BARS_1H), *tr_of("ix")]
    unions = []
    for i, (ma, atr, mult, sl) in enumerate(STOP_PARAMS):
        parts += [
            (f"m{i}", recursive_mean("trs", "close", f"(2.0/{ma + 1})", str(ma))),
            (f"a{i}", recursive_mean("trs", "tr", f"(1.0/{atr})", str(atr))),
        ]
        unions.append(f"""select t.symbol, cast({i} as int) as combo_id, t.ts, t.pos, t.open, t.high, t.low, t.close,
            m.v as mid, m.v - {mult} * a.v as lower, m.v + {mult} * a.v as upper, cast({sl} as double) as sl
            from trs t left join m{i} m on m.symbol = t.symbol and m.pos = t.pos - 1
            left join a{i} a on a.symbol = t.symbol and a.pos = t.pos - 1""")
    parts.append(("cb", " union all ".join(unions)))
    return parts + walk("cb", ["symbol", "combo_id"], size)


@query(
    "trades_with_stop",
    ctes(
        *stop_walk(0.3),
        ("closed", """select symbol, combo_id, was as side, was_pos as ep, p_was as entry_px, pos as xp, p_out as exit_px, false as is_open,
                      case when hit then 'stop' else 'signal' end as reason, ret from bars_walked where gone"""),
        ("still", """select symbol, combo_id, side, in_pos as ep, p_in as entry_px, pos as xp, close as exit_px, true as is_open,
                     'open' as reason, 0.3 * (side * (close / p_in - 1) - 0.001) as ret
                     from (select w.*, b.close, row_number() over (partition by w.symbol, w.combo_id order by w.pos desc) as rn
                           from bars_walked w join ix b on b.symbol = w.symbol and b.pos = w.pos) where rn = 1 and side <> 0"""),
        recursive=True,
    )
    + """select c.symbol, c.combo_id, c.side, e.ts as entry_ts, round(c.entry_px, 8) as entry_px, x.ts as exit_ts,
         round(c.exit_px, 8) as exit_px, c.is_open, c.reason, round(c.ret, 8) as ret
         from (select * from closed union all select * from still) c
         join ix e on e.symbol = c.symbol and e.pos = c.ep join ix x on x.symbol = c.symbol and x.pos = c.xp""",
)
def _(spark, sf):
    params = combos(spark, *STOP_PARAMS)
    return rounded(replay_trades(hourly(spark, sf), params, ReplayConfig(max_window=20)))


@query(
    "final_backtest",
    ctes(*stop_walk(1.0), recursive=True) + walk_metrics(["symbol", "combo_id"], BAR_SECONDS_1H),
)
def _(spark, sf):
    params = combos(spark, *STOP_PARAMS)
    out = final_backtest(bars_1h(spark, sf), params, BAR_SECONDS_1H, cfg=ReplayConfig(max_window=20))
    return rounded(out, **DIGITS)


# ---- the same results from small blocks ---------------------------------------------
# Series here are short, so blocks are cut small enough that every carry is used many times.

BLOCK = 48
SMALL_BLOCKS = ReplayConfig(block_bars=64, runup=4)


def hourly_blocked(spark, sf) -> DataFrame:
    return with_position(bars_1h(spark, sf), BAR_SECONDS_1H, block_bars=BLOCK)


def sql_of(name: str) -> str:
    return REGISTRY[name].sql


@query("ema_blocked", sql_of("ema"))
def _(spark, sf):
    return rounded(ind.ema(hourly_blocked(spark, sf), 12, block_bars=BLOCK).select("symbol", "ts", "ema"))


@query("atr_wilder_blocked", sql_of("atr_wilder"))
def _(spark, sf):
    return rounded(ind.atr(hourly_blocked(spark, sf), 14, block_bars=BLOCK).select("symbol", "ts", "atr"))


@query("keltner_channel_blocked", sql_of("keltner_channel"))
def _(spark, sf):
    out = ind.keltner_channel(hourly_blocked(spark, sf), 10, 5, 1.0, block_bars=BLOCK)
    return rounded(out.select(*CHANNEL_COLUMNS))


@query("metrics_blocked", sql_of("metrics"))
def _(spark, sf):
    channel = ind.atr_envelope(hourly_blocked(spark, sf), 10, 5, 1.0, block_bars=BLOCK)
    return rounded(channel_metrics(channel, BAR_SECONDS_1H, SMALL_BLOCKS), **DIGITS)


@query("equity_curve_blocked", sql_of("equity_curve"))
def _(spark, sf):
    held = bt.positions(fill_price(signals(envelope_1d(spark, sf))), block_bars=BLOCK)
    return rounded(bt.equity_curve(held, block_rows=BLOCK).select("symbol", "ts", "equity", "peak"), 3)


@query("trades_with_stop_blocked", sql_of("trades_with_stop"))
def _(spark, sf):
    return rounded(replay_trades(hourly(spark, sf), combos(spark, *STOP_PARAMS), SMALL_BLOCKS))


@query("final_backtest_blocked", sql_of("final_backtest"))
def _(spark, sf):
    """Four bars of run-up leave most blocks unsettled, so rounds of resolving are needed."""
    params = combos(spark, *STOP_PARAMS)
    out = final_backtest(bars_1h(spark, sf), params, BAR_SECONDS_1H, cfg=SMALL_BLOCKS)
    return rounded(out, **DIGITS)


def long_only(series: DataFrame, ma_window: int, atr_window: int, atr_mult: float) -> DataFrame:
    """A user strategy that never shorts, so no bar forces both legs shut."""
    flagged = signals(ind.atr_envelope(series, ma_window, atr_window, atr_mult, block_bars=BLOCK))
    return fill_price(flagged.withColumns({"short_entry": F.lit(False), "short_exit": F.lit(False)}))


LONG_FLAGS = [
    (name, sql.replace("coalesce(high >= upper, false) as short_entry, coalesce(low <= mid, false) as short_exit",
                       "false as short_entry, false as short_exit"))
    for name, sql in FLAGS
]


@query(
    "user_strategy_long",
    ctes(*envelope(BARS_1D, 15, 8, 0.4), *LONG_FLAGS, *HELD, *curve(1.0)) + metrics_sql(YEAR_1D),
)
def _(spark, sf):
    out = evaluate_strategy(
        bars_1d(spark, sf), long_only, {"ma_window": 15, "atr_window": 8, "atr_mult": 0.4},
        BAR_SECONDS_1D, size=1.0, block_bars=BLOCK,
    )
    return rounded(out, **DIGITS)


# ---- user strategies with stops, and folds of the user's own --------------------------

USER_STOPS = (None, 0.01, 0.002)
USER_WALK = walk("stopped", ["symbol", "combo_id"], 0.3)
USER_BARS = [
    *envelope(BARS_1H, 15, 8, 0.4),
    ("stopped", "select ch.*, cast(s.i as int) as combo_id, s.sl from ch cross join (values "
                "(0, cast(null as double)), (1, cast(0.01 as double)), (2, cast(0.002 as double))) s(i, sl)"),
]
TOUCH = {"ma_window": 15, "atr_window": 8, "atr_mult": 0.4}


@query("user_strategy_stop", ctes(*USER_BARS, *USER_WALK, recursive=True) + walk_metrics(["symbol", "combo_id"], BAR_SECONDS_1H))
def _(spark, sf):
    return rounded(strategy_with_stops(bars_1h(spark, sf), touch_strategy, TOUCH, USER_STOPS, BAR_SECONDS_1H), **DIGITS)


@query("user_strategy_stop_blocked", sql_of("user_strategy_stop"))
def _(spark, sf):
    return rounded(strategy_with_stops(bars_1h(spark, sf), touch_strategy, TOUCH, USER_STOPS, BAR_SECONDS_1H, cfg=SMALL_BLOCKS), **DIGITS)


@query(
    "user_strategy_trades",
    ctes(*USER_BARS, *USER_WALK, ("closed", "select * from bars_walked where gone"), recursive=True)
    + """select c.symbol, c.combo_id, c.was as side, e.ts as entry_ts, round(c.p_was, 8) as entry_px, x.ts as exit_ts,
         round(c.p_out, 8) as exit_px, case when hit then 'stop' else 'signal' end as reason, round(c.ret, 8) as ret
         from closed c join ix e on e.symbol = c.symbol and e.pos = c.was_pos join ix x on x.symbol = c.symbol and x.pos = c.pos""",
)
def _(spark, sf):
    out = strategy_trades(bars_1h(spark, sf), touch_strategy, TOUCH, USER_STOPS, BAR_SECONDS_1H, cfg=SMALL_BLOCKS)
    return rounded(out.filter("not is_open").drop("is_open"))


def rising_step(state: dict, bars) -> dict:
    """Longest run of rising closes, and the runs at both ends so that stretches can be merged."""
    close = bars.column("close").to_numpy()
    stretch = {"n": len(close), "first": float(close[0]), "last": float(close[-1])}
    rises = np.concatenate([[False], close[1:] > close[:-1]])
    falls = np.flatnonzero(~rises)
    runs = np.diff(np.append(falls, len(close)))  # bars from each bar that does not rise to the next
    return rising_merge(state, stretch | {"head": int(runs[0]), "tail": int(runs[-1]), "best": int(runs.max())})


def rising_merge(a: dict, b: dict) -> dict:
    if not a["n"] or not b["n"]:
        return a if a["n"] else b
    joins = b["first"] > a["last"]
    return {
        "n": a["n"] + b["n"], "first": a["first"], "last": b["last"],
        "head": a["n"] + b["head"] if joins and a["head"] == a["n"] else a["head"],
        "tail": b["n"] + a["tail"] if joins and b["tail"] == b["n"] else b["tail"],
        "best": max(a["best"], b["best"], a["tail"] + b["head"] if joins else 0),
    }


RISING = Fold(
    "n bigint, first double, last double, head bigint, tail bigint, best bigint",
    lambda: {"n": 0, "first": None, "last": None, "head": 0, "tail": 0, "best": 0}, rising_step, rising_merge,
)


@query(
    "user_fold",
    ctes(*indexed(BARS_1H),
         ("moves", "select *, close > lag(close) over (partition by symbol order by pos) as rises from ix"),
         ("runs", "select symbol, pos, sum(case when coalesce(rises, false) then 0 else 1 end) over (partition by symbol order by pos) as run from moves"),
         ("lengths", "select symbol, run, count(*) as n from runs group by symbol, run"))
    + "select symbol, cast(sum(n) as bigint) as bars, cast(max(n) as bigint) as longest_rise from lengths group by symbol",
)
def _(spark, sf):
    out = fold_bars(hourly_blocked(spark, sf), RISING, ["close"], block_bars=BLOCK)
    return out.select("symbol", F.col("n").alias("bars"), F.col("best").alias("longest_rise"))


def anchor_step(state: dict, bars) -> dict:
    """A close one percent away from the anchor becomes the anchor; the first close is the first one."""
    close, at = bars.column("close").to_numpy(), 0
    anchor, moves = state["anchor"], state["moves"]
    if anchor is None:
        anchor, at = float(close[0]), 1
    while at < len(close):
        far = np.abs(close[at:] - anchor) >= 0.01 * anchor
        if not far.any():
            break
        at += int(far.argmax())
        anchor, moves, at = float(close[at]), moves + 1, at + 1
    return {"anchor": anchor, "moves": moves}


ANCHORED = Fold("anchor double, moves bigint", lambda: {"anchor": None, "moves": 0}, anchor_step)


@query(
    "user_fold_ordered",
    ctes(*indexed(BARS_1H),
         ("steps", """select symbol, pos, close as anchor, cast(0 as bigint) as moves from ix where pos = 0 union all
           select s.symbol, i.pos, case when abs(i.close - s.anchor) >= 0.01 * s.anchor then i.close else s.anchor end,
                  s.moves + case when abs(i.close - s.anchor) >= 0.01 * s.anchor then 1 else 0 end
           from steps s join ix i on i.symbol = s.symbol and i.pos = s.pos + 1"""), recursive=True)
    + "select symbol, round(arg_max(anchor, pos), 8) as anchor, max(moves) as moves from steps group by symbol",
)
def _(spark, sf):
    return rounded(fold_bars(hourly(spark, sf), ANCHORED, ["close"]))


# ---- missing prices -----------------------------------------------------------------

HOLED = f"""select symbol, ts, open, high, low, case when cast(volume as bigint) % 2 = 0 then null else close end as close, volume
            from ({BARS_1H})"""
WHOLE = f"select * from ({HOLED}) where close is not null"


def holed(spark, sf) -> DataFrame:
    """Hourly candles, those with an even number of ticks without a close."""
    return bars_1h(spark, sf).withColumn(
        "close", F.when(F.col("volume").cast("bigint") % 2 != 0, F.col("close"))
    )


@query("incomplete_candles", f"select symbol, ts, 'close' as missing from ({HOLED}) where close is null")
def _(spark, sf):
    return incomplete(holed(spark, sf)).select("symbol", "ts", "missing")


def missing_metrics(spark, sf, block: int) -> DataFrame:
    series = with_position(complete(holed(spark, sf)), BAR_SECONDS_1H, block_bars=block)
    channel = ind.atr_envelope(series, 10, 5, 1.0, block_bars=block)
    return rounded(bt.backtest(channel, BAR_SECONDS_1H, block_bars=block), **DIGITS)


MISSING_SQL = ctes(*envelope(WHOLE, 10, 5, 1.0), *FLAGS, *HELD, *curve(0.3)) + metrics_sql(YEAR_1H)


@query("metrics_missing", MISSING_SQL)
def _(spark, sf):
    return missing_metrics(spark, sf, 65_536)


@query("metrics_missing_blocked", MISSING_SQL)
def _(spark, sf):
    return missing_metrics(spark, sf, BLOCK)


@query(
    "ema_missing_blocked",
    ctes(*indexed(WHOLE), ("e", recursive_mean("ix", "close", "(2.0/13)", "12")))
    + "select ix.symbol, ix.ts, round(e.v, 8) as ema from ix left join e on e.symbol = ix.symbol and e.pos = ix.pos",
)
def _(spark, sf):
    series = with_position(complete(holed(spark, sf)), BAR_SECONDS_1H, block_bars=BLOCK)
    return rounded(ind.ema(series, 12, block_bars=BLOCK).select("symbol", "ts", "ema"))
