"""Queries over train/test windows, parameter grids and walk-forward jobs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from bandwalk.catalog.bars import DIGITS, YEAR_1D, daily, metrics_sql
from bandwalk.catalog.base import (
    BARS_1D,
    BARS_1H,
    FLAGS,
    HELD,
    REGISTRY,
    TRIALS,
    ctes,
    curve,
    envelope,
    indexed,
    query,
    recursive_mean,
    rounded,
    tr_of,
    walk,
    walk_metrics,
)
from bandwalk.defaults import DEFAULTS
from bandwalk.fixtures import BAR_SECONDS_1D, BAR_SECONDS_1H, bars_1d, bars_1h, table, trials
from bandwalk.catalog.ingest import new_folder
from bandwalk.operators.analysis import rank_pairs
from bandwalk.operators.clusters import PARAMS4
from bandwalk.operators.indicators import atr_envelope
from bandwalk.operators.params import GRID, RESEARCH_SPACE, Axis, param_grid, param_sample, size_of
from bandwalk.operators.replay import PARAMS, ReplayConfig
from bandwalk.operators.series import with_position
from bandwalk.operators.signals import fill_price, signals
from bandwalk.operators.windows import (
    assign_segments,
    calendar_windows,
    locate_windows,
    rolling_split,
    series_bounds,
    window_sizing,
    window_summary,
)
from bandwalk.plans.walkforward import (
    best_trials,
    research_chain,
    research_windows,
    scan,
    scan_skipped,
    scan_to,
    strategy_grid,
    trial_log,
    walk_forward_grid,
    window_winners,
)
from bandwalk.session import settled
from bandwalk.sources.results import read_results

SPLIT_SQL = [
    ("n", "select symbol, count(*) as len from bars group by symbol"),
    ("t", "select symbol, len, (3 * len) // 37 as t, (7 * ((3 * len) // 37)) // 3 as train from n"),
    ("k", "select symbol, t, train, cast(range as int) as split from t, range(10) where t > 0"),
    ("seg", """select symbol, split, 'train' as set_name, split * t as lo, split * t + train as hi from k
               union all select symbol, split, 'test', split * t + train, split * t + train + t from k"""),
]
SIZE_SQL = [
    ("bounds", "select symbol, min(ts) as start_ts, max(ts) as end_ts, count(*) as len from bars group by symbol"),
    ("days", "select *, cast(floor((epoch(end_ts) - epoch(start_ts)) / 86400) as int) as history_days from bounds"),
    ("train", "select *, cast((history_days // 10) * 2 // 3 as int) as train_days from days"),
    ("sized", """select symbol, start_ts, end_ts, len, history_days, train_days,
                 cast(history_days // 10 - train_days as int) as test_days,
                 cast((history_days - train_days) // 10 as int) as step_days from train"""),
]
CALENDAR_SQL = [
    ("win", """select symbol, cast(range as int) as split, start_ts + to_days(cast(range * step_days as int)) as a,
               start_ts + to_days(cast(range * step_days + train_days as int)) as b,
               start_ts + to_days(cast(range * step_days + train_days + test_days as int)) as c, end_ts
               from sized, range(100) where start_ts + to_days(cast(range * step_days + train_days + test_days as int)) <= end_ts"""),
    ("cal", """select symbol, split, 'train' as set_name, a as from_ts, b as to_ts from win
               union all select symbol, split, 'test', b, c from win"""),
]


@query(
    "rolling_split",
    ctes(("bars", BARS_1D), *SPLIT_SQL) + "select symbol, split, set_name, lo, hi from seg",
)
def _(spark, sf):
    return rolling_split(series_bounds(bars_1d(spark, sf)))


@query("window_sizing", ctes(("bars", BARS_1D), *SIZE_SQL) + "select * from sized")
def _(spark, sf):
    return window_sizing(series_bounds(bars_1d(spark, sf)))


@query(
    "calendar_windows",
    ctes(("bars", BARS_1D), *SIZE_SQL, *CALENDAR_SQL) + "select symbol, split, set_name, from_ts, to_ts from cal",
)
def _(spark, sf):
    return calendar_windows(window_sizing(series_bounds(bars_1d(spark, sf)))).drop("open_end")


def summary_sql(upper: str) -> str:
    return (
        ctes(("bars", BARS_1D), *SIZE_SQL, *CALENDAR_SQL)
        + f"""select c.symbol, split, set_name, min(ts) as first_ts, max(ts) as last_ts, count(*) as n_bars
             from cal c join bars b on b.symbol = c.symbol and b.ts >= from_ts and {upper} group by 1, 2, 3"""
    )


def calendar_summary(spark, sf, half_open: bool) -> DataFrame:
    series = daily(spark, sf)
    windows = calendar_windows(window_sizing(series_bounds(series)), half_open)
    segments = locate_windows(series, windows, BAR_SECONDS_1D)
    return window_summary(assign_segments(series, segments))


@query("window_summary", summary_sql("b.ts <= to_ts"))
def _(spark, sf):
    return calendar_summary(spark, sf, False)


@query(
    "window_summary_half_open",
    summary_sql("(b.ts < to_ts or (set_name = 'test' and b.ts = to_ts))"),
)
def _(spark, sf):
    return calendar_summary(spark, sf, True)


SEGMENT_BARS = """select i.symbol, split, set_name, ts, pos - lo as pos, open, high, low, close
                  from ix i join seg s on s.symbol = i.symbol and pos >= lo and pos < hi"""


@query(
    "assign_segments",
    ctes(*indexed(BARS_1D), *SPLIT_SQL, ("sb", SEGMENT_BARS)) + "select symbol, split, set_name, ts, pos from sb",
)
def _(spark, sf):
    series = daily(spark, sf)
    segments = rolling_split(series_bounds(series))
    return assign_segments(series, segments).select("symbol", "split", "set_name", "ts", "pos")


# ---- parameter spaces ---------------------------------------------------------------


@query(
    "param_grid",
    """with n as (select cast(l_orderkey % 8250 as int) as combo_id, count(*) as n_rows from lineitem group by 1),
            g as (select cast(range as int) as combo_id from range(8250))
       select combo_id, cast(20 + 20 * (combo_id // 825) as int) as ma_window,
              cast(10 + 20 * (combo_id // 75 % 11) as int) as atr_window,
              (2 + combo_id // 5 % 15) / cast(2 as double) as atr_mult,
              (2 + 2 * (combo_id % 5)) / cast(100 as double) as sl_stop, coalesce(n_rows, 0) as n_rows
       from g left join n using (combo_id)""",
)
def _(spark, sf):
    """The production grid, joined to a key folded onto its numbering."""
    folded = table(spark, sf, "lineitem").groupBy(
        (F.col("l_orderkey") % size_of(GRID)).cast("int").alias("combo_id")
    ).agg(F.count("*").alias("n_rows"))
    return param_grid(spark).join(folded, "combo_id", "left").withColumn(
        "n_rows", F.coalesce("n_rows", F.lit(0))
    )


def sample_sql(windows: str, keys: str, n: int = 200) -> list[tuple[str, str]]:
    """The first ``n`` of each window's keyed permutation of the research space."""
    high, low = size_of(RESEARCH_SPACE[:2]), size_of(RESEARCH_SPACE[2:])
    text = "'42:' || " + " || ':' || ".join(f"cast({k} as varchar)" for k in keys.split(", "))

    def shifted(column: str, by: str, size: int, turn: int) -> str:
        return (f"({column} + cast('0x' || substr(md5({text} || ':{turn}:' || cast({by} as varchar)), 1, 12) as bigint))"
                f" % {size} as {column}")

    turns = [("p0", f"select {keys}, k, k // {low} as h, k % {low} as l from ({windows}) w, (select range as k from range({n})) r")]
    for turn in range(4):
        moved = shifted("l", "h", low, turn) + ", h" if turn % 2 == 0 else "l, " + shifted("h", "l", high, turn)
        turns.append((f"p{turn + 1}", f"select {keys}, k, {moved} from p{turn}"))
    return turns + [
        ("nth", f"select {keys}, k, h * {low} + l as ix from p4"),
        ("sample", f"""select {keys}, cast(k as int) as combo_id, cast(10 + 5 * (ix // 11700) as int) as ma_window,
                    cast(5 + 5 * (ix // 585 % 20) as int) as atr_window, (2 + ix // 15 % 39) / cast(4 as double) as atr_mult,
                    (1 + ix % 15) / cast(100 as double) as sl_stop from nth"""),
    ]


@query(
    "param_sample",
    ctes(("bars", BARS_1D), *SPLIT_SQL, *sample_sql("select symbol, split from seg where set_name = 'train'", "symbol, split"))
    + "select * from sample",
)
def _(spark, sf):
    """Distinct sampled combinations per symbol and window."""
    windows = rolling_split(series_bounds(bars_1d(spark, sf))).filter("set_name = 'train'")
    return param_sample(windows.select("symbol", "split"), keys=("symbol", "split"))


# ---- walk-forward -------------------------------------------------------------------

SMALL_GRID = (
    Axis("ma_window", 5, 5, 2),
    Axis("atr_window", 3, 4, 2),
    Axis("atr_mult", 1, 1, 2, 2),
    Axis("sl_stop", 1, 1, 1, 100),
)
DENSE_GRID = SMALL_GRID[:2] + (Axis("atr_mult", 1, 1, 2, 4), SMALL_GRID[3])
SMALL_CFG = ReplayConfig(max_window=10)
LOW_BAR = replace(DEFAULTS, min_trades=5)
SEG = ("symbol", "split", "set_name")


def grid_walk(unit: int, where: str = "true") -> list[tuple[str, str]]:
    """Replay of the eight combinations on every segment row set ``sb``."""
    parts = [("sbx", f"select * from sb where {where}"), *tr_of("sbx", ", ".join(SEG))]
    for n in (5, 10):
        parts.append((f"m{n}", recursive_mean("trs", "close", f"(2.0/{n + 1})", str(n), SEG)))
    for n in (3, 7):
        parts.append((f"a{n}", recursive_mean("trs", "tr", f"(1.0/{n})", str(n), SEG)))
    parts += [
        ("mas", "select *, 5 as n from m5 union all select *, 10 from m10"),
        ("atrs", "select *, 3 as n from a3 union all select *, 7 from a7"),
        ("grid", f"""select cast(i as int) as combo_id, cast(5 + 5 * (i // 4) as int) as ma_window,
                     cast(3 + 4 * (i // 2 % 2) as int) as atr_window, (1 + i % 2) / cast({unit} as double) as atr_mult,
                     cast(0.01 as double) as sl_stop from (select range as i from range(8))"""),
        ("cb", """select t.symbol, t.split, t.set_name, g.combo_id, t.pos, t.open, t.high, t.low, t.close, m.v as mid,
                  m.v - g.atr_mult * a.v as lower, m.v + g.atr_mult * a.v as upper, g.sl_stop as sl
                  from trs t cross join grid g
                  left join mas m on m.symbol = t.symbol and m.split = t.split and m.set_name = t.set_name and m.n = g.ma_window and m.pos = t.pos - 1
                  left join atrs a on a.symbol = t.symbol and a.split = t.split and a.set_name = t.set_name and a.n = g.atr_window and a.pos = t.pos - 1"""),
    ]
    return parts + walk("cb", [*SEG, "combo_id"], 0.3)


PARAM_COLUMNS = "ma_window, atr_window, atr_mult, sl_stop"


def grid_sql(where: str = "true", lead: str = "") -> str:
    return (
        ctes(
            *indexed(BARS_1H),
            *SPLIT_SQL,
            ("sb", SEGMENT_BARS),
            *grid_walk(2, where),
            ("measured", walk_metrics([*SEG, "combo_id"], BAR_SECONDS_1H)),
            recursive=True,
        )
        + f"select {lead} m.*, {PARAM_COLUMNS} from measured m join grid g on g.combo_id = m.combo_id"
    )


@query("walk_forward_grid", grid_sql())
def _(spark, sf):
    out = walk_forward_grid(
        bars_1h(spark, sf), param_grid(spark, SMALL_GRID), BAR_SECONDS_1H, cfg=SMALL_CFG
    )
    return rounded(out, **DIGITS)


@query("scan", grid_sql("symbol not in ('click', 'view')", "'alpha' as exchange, '1h' as tf,"))
def _(spark, sf):
    """The grid over every pair without a stored result."""
    candles = bars_1h(spark, sf).withColumns({"exchange": F.lit("alpha"), "tf": F.lit("1h")})
    stored = candles.filter(F.col("symbol").isin("click", "view"))
    out = scan(candles, stored, param_grid(spark, SMALL_GRID), cfg=SMALL_CFG)
    return rounded(out, **DIGITS)


RESEARCH_SQL = [
    *indexed(BARS_1D),
    *SIZE_SQL,
    *CALENDAR_SQL,
    ("sb", """select i.symbol, split, set_name, ts, row_number() over (partition by i.symbol, split, set_name order by ts) - 1 as pos,
              open, high, low, close
              from ix i join cal c on c.symbol = i.symbol and ts >= from_ts and ts <= to_ts"""),
    *grid_walk(4),
]
MEASURED_SQL = ("measured", f"""select {', '.join(SEG)}, combo_id,
      avg(eq / prev_eq - 1) / nullif(stddev_samp(eq / prev_eq - 1), 0) * {(365 * 86400 / BAR_SECONDS_1D) ** 0.5!r} as sharpe,
      arg_max(eq, pos) / 10000 - 1 as total_return, max(1 - eq / peak) as max_drawdown,
      count(*) filter (where opened) as n_trades from peaks group by all""")
SCORED_SQL = ("scored", f"""select m.symbol, m.split, {PARAM_COLUMNS},
      case when n_trades < 5 or max_drawdown > 0.3 then -999
           else 0.7 * sharpe + 0.3 * total_return * (1 - max_drawdown) end as score
      from measured m join grid g on g.combo_id = m.combo_id where set_name = 'train'""")


def small_trials(spark, sf):
    """Segmented daily bars and the scores of the whole dense grid per train window."""
    segmented = settled(research_windows(bars_1d(spark, sf), BAR_SECONDS_1D))
    log = trial_log(
        segmented, BAR_SECONDS_1D, size_of(DENSE_GRID), axes=DENSE_GRID, cfg=SMALL_CFG, d=LOW_BAR
    )
    return segmented, log


@query(
    "trial_log",
    ctes(*RESEARCH_SQL, MEASURED_SQL, SCORED_SQL, recursive=True)
    + f"select symbol, split, {PARAM_COLUMNS}, round(score, 6) as score from scored",
)
def _(spark, sf):
    return rounded(small_trials(spark, sf)[1].drop("combo_id"), 6)


@query(
    "window_winners",
    ctes(
        *RESEARCH_SQL,
        MEASURED_SQL,
        SCORED_SQL,
        ("best", f"""select *, row_number() over (partition by symbol, split order by score desc, {PARAM_COLUMNS}) as rn from scored
                     where score is not null"""),
        recursive=True,
    )
    + """select b.symbol, b.split, b.ma_window, b.atr_window, b.atr_mult, b.sl_stop, round(b.score, 6) as train_score,
         round(m.sharpe, 6) as test_sharpe, round(m.total_return, 8) as test_return,
         round(m.max_drawdown, 8) as test_max_dd, m.n_trades as test_trades
         from best b join grid g on g.ma_window = b.ma_window and g.atr_window = b.atr_window and g.atr_mult = b.atr_mult
         join measured m on m.symbol = b.symbol and m.split = b.split and m.combo_id = g.combo_id and m.set_name = 'test'
         where b.rn = 1""",
)
def _(spark, sf):
    segmented, log = small_trials(spark, sf)
    out = window_winners(settled(log), segmented, BAR_SECONDS_1D, SMALL_CFG)
    return rounded(out, 8, train_score=6, test_sharpe=6)


def sampled_sql() -> str:
    group = ["symbol", "split", "combo_id"]

    def means(column: str, n: str, alpha: str, windows: str) -> str:
        weight = f"case when b.pos = 0 then 1.0 else {alpha} end * pow(1 - {alpha}, a.pos - b.pos)"
        return f"""select a.symbol, a.split, w.n, a.pos, sum({weight} * b.{column}) as v
            from (select distinct symbol, split, {windows} as n from sample) w
            join trs a on a.symbol = w.symbol and a.split = w.split and a.pos >= w.n - 1
            join trs b on b.symbol = a.symbol and b.split = a.split and b.pos <= a.pos group by all"""

    return (
        ctes(
            *indexed(BARS_1D),
            *SIZE_SQL,
            *CALENDAR_SQL,
            ("sb", """select i.symbol, split, ts, row_number() over (partition by i.symbol, split order by ts) - 1 as pos,
                      open, high, low, close from ix i join cal c on c.symbol = i.symbol and set_name = 'train'
                      and ts >= from_ts and ts <= to_ts"""),
            *sample_sql("select distinct symbol, split from sb", "symbol, split"),
            *tr_of("sb", "symbol, split"),
            ("mas", means("close", "n", "(2.0::double / (w.n + 1))", "ma_window")),
            ("atrs", means("tr", "n", "(1.0::double / w.n)", "atr_window")),
            ("cb", """select t.symbol, t.split, s.combo_id, t.pos, t.open, t.high, t.low, t.close, m.v as mid,
                      m.v - s.atr_mult * a.v as lower, m.v + s.atr_mult * a.v as upper, s.sl_stop as sl
                      from sample s join trs t on t.symbol = s.symbol and t.split = s.split
                      left join mas m on m.symbol = t.symbol and m.split = t.split and m.n = s.ma_window and m.pos = t.pos - 1
                      left join atrs a on a.symbol = t.symbol and a.split = t.split and a.n = s.atr_window and a.pos = t.pos - 1"""),
            *walk("cb", group, 0.3),
            ("measured", f"""select symbol, split, combo_id,
                avg(eq / prev_eq - 1) / nullif(stddev_samp(eq / prev_eq - 1), 0) * {(365 * 86400 / BAR_SECONDS_1D) ** 0.5!r} as sharpe,
                arg_max(eq, pos) / 10000 - 1 as total_return, max(1 - eq / peak) as max_drawdown,
                count(*) filter (where opened) as n_trades from peaks group by all"""),
            recursive=True,
        )
        + """select symbol, split, combo_id, ma_window, atr_window, atr_mult, sl_stop,
             round(case when n_trades < 5 or max_drawdown > 0.3 then -999
                        else 0.7 * sharpe + 0.3 * total_return * (1 - max_drawdown) end, 6) as score
             from measured join sample using (symbol, split, combo_id)"""
    )


@query("sampled_trials", sampled_sql())
def _(spark, sf):
    """Scores of sampled research-space trials on the calendar train windows."""
    segmented = settled(research_windows(bars_1d(spark, sf), BAR_SECONDS_1D))
    return rounded(trial_log(segmented, BAR_SECONDS_1D, d=LOW_BAR), 6)


def research_sql() -> str:
    """From the trial log to the centre of the stable points, then that centre bar by bar on the full history."""
    near = " + ".join(f"(a.{p}_norm - b.{p}_norm) * (a.{p}_norm - b.{p}_norm)" for p in PARAMS)
    norm = ", ".join(
        f"case when max({p}) over s > min({p}) over s then ({p} - min({p}) over s) / cast(max({p}) over s - min({p}) over s as double) else 0 end as {p}_norm"
        for p in PARAMS
    )
    centre = (
        ctes(
            *RESEARCH_SQL, MEASURED_SQL, SCORED_SQL,
            ("norm", f"select *, {norm} from scored where score > -999 window s as (partition by symbol)"),
            ("topq", """select n.* from norm n join (select symbol, split, quantile_cont(score, 0.7) as cut from norm group by 1, 2) q
                        using (symbol, split) where score >= cut"""),
            ("tot", "select symbol, count(distinct split) as n from scored group by symbol"),
            ("rt", f"""select a.symbol, a.split, {', '.join('a.' + p for p in PARAMS)},
                       (select count(distinct b.split) from topq b where b.symbol = a.symbol and b.split <> a.split
                        and sqrt({near}) <= 0.35) / cast(nullif(n - 1, 0) as double) as ratio from topq a join tot using (symbol)"""),
            ("mid", f"""select symbol, ratio >= 0.7 as green, cast(trunc(median(ma_window)) as int) as ma_window,
                        cast(trunc(median(atr_window)) as int) as atr_window, median(atr_mult) as atr_mult, median(sl_stop) as sl_stop
                        from rt where ratio >= 0.5 group by 1, 2"""),
            recursive=True,
        )
        + f"select symbol, {PARAM_COLUMNS} from (select *, row_number() over (partition by symbol order by green desc) as rn from mid) where rn = 1"
    )

    def mean(column: str, n: str, alpha: str) -> str:
        weight = f"case when b.pos = 0 then 1.0 else {alpha} end * pow(1 - {alpha}, a.pos - b.pos)"
        return f"""select a.symbol, a.pos, sum({weight} * b.{column}) as v from centre w
            join trs a on a.symbol = w.symbol and a.pos >= w.{n} - 1 join trs b on b.symbol = a.symbol and b.pos <= a.pos group by all"""

    return (
        ctes(
            *indexed(BARS_1D),
            ("centre", centre),
            *tr_of("ix"),
            ("ma", mean("close", "ma_window", "(2.0::double / (w.ma_window + 1))")),
            ("wilder", mean("tr", "atr_window", "(1.0::double / w.atr_window)")),
            ("cb", """select t.symbol, t.pos, t.open, t.high, t.low, t.close, m.v as mid, m.v - c.atr_mult * a.v as lower,
                      m.v + c.atr_mult * a.v as upper, c.sl_stop as sl
                      from centre c join trs t on t.symbol = c.symbol left join ma m on m.symbol = t.symbol and m.pos = t.pos - 1
                      left join wilder a on a.symbol = t.symbol and a.pos = t.pos - 1"""),
            *walk("cb", ["symbol"], 1.0),
            ("measured", walk_metrics(["symbol"], BAR_SECONDS_1D)),
            recursive=True,
        )
        + f"select m.*, {PARAM_COLUMNS} from measured m join centre using (symbol)"
    )


@query("research_final", research_sql())
def _(spark, sf):
    """The whole research chain: trials per window, stable cluster, its centre on the full history."""
    out = research_chain(
        bars_1d(spark, sf), BAR_SECONDS_1D, DEFAULTS.cluster_radius[4], DENSE_GRID, size_of(DENSE_GRID), cfg=SMALL_CFG, d=LOW_BAR
    )
    return rounded(out, **DIGITS)


@query(
    "best_trials",
    f"""with t as ({TRIALS}), r as (select *, row_number() over (partition by window_id
        order by score desc, ma_window, atr_window, mult_x4, sl_pct) as rn from t)
        select window_id, ma_window, atr_window, mult_x4, sl_pct, score as train_score from r where rn = 1""",
)
def _(spark, sf):
    return best_trials(trials(spark, sf), ["window_id"], PARAMS4)


# ---- small blocks, skipped pairs, grid to ranking --------------------------------------


@query("walk_forward_grid_blocked", REGISTRY["walk_forward_grid"].sql)
def _(spark, sf):
    """Blocks far shorter than a segment, so summaries are merged and rounds resolved."""
    out = walk_forward_grid(
        bars_1h(spark, sf), param_grid(spark, SMALL_GRID), BAR_SECONDS_1H,
        cfg=ReplayConfig(block_bars=16, runup=4), block_bars=64,
    )
    return rounded(out, **DIGITS)


@query("scan_skipped", f"""
    with bars as ({BARS_1H}), short as (select *, row_number() over (partition by symbol order by ts) as i from bars),
      c as (select * from short where symbol <> 'click' or i <= 12), n as (select symbol, count(*) as len from c group by 1)
    select 'alpha' as exchange, '1h' as tf, symbol, len,
      case when symbol = 'view' then 'stored' else 'fewer than 13 bars for 10 windows' end as reason
    from n where symbol in ('view', 'click')""")
def _(spark, sf):
    """One pair has a stored result, one is cut to its first twelve bars; the others are scanned."""
    series = with_position(bars_1h(spark, sf), BAR_SECONDS_1H)
    candles = (
        series.filter((F.col("symbol") != "click") | (F.col("pos") < 12)).drop("pos", "len")
        .withColumns({"exchange": F.lit("alpha"), "tf": F.lit("1h")})
    )
    stored = candles.filter("symbol = 'view'")
    return scan_skipped(candles, stored)


@query(
    "grid_then_rank",
    ctes(
        *indexed(BARS_1H), *SPLIT_SQL, ("sb", SEGMENT_BARS), *grid_walk(2),
        ("measured", walk_metrics([*SEG, "combo_id"], BAR_SECONDS_1H)),
        ("res", f"select m.*, {PARAM_COLUMNS} from measured m join grid g on g.combo_id = m.combo_id"),
        ("med", f"""select symbol, {PARAM_COLUMNS}, median(sharpe) filter (where set_name = 'train') as train_median,
                    median(sharpe) filter (where set_name = 'test') as test_median,
                    count(*) filter (where set_name = 'train' and sharpe > 0) as good from res group by all"""),
        ("cnt", "select symbol, count(distinct split) as n from res group by 1"),
        ("best", f"""select *, row_number() over (partition by symbol order by train_median desc nulls last, {PARAM_COLUMNS}) as rn from med"""),
        ("rob", f"select symbol, count(*) filter (where good >= n * {DEFAULTS.robust_share}) as n_robust from med join cnt using (symbol) group by 1"),
        ("al", f"""select symbol, split, {PARAM_COLUMNS}, max(sharpe) filter (where set_name = 'train') as a,
                   max(sharpe) filter (where set_name = 'test') as b from res group by all"""),
        ("co", "select symbol, corr(a, b) as c from al group by 1"),
        recursive=True,
    )
    + """select symbol, n_robust, round(train_median, 3) as best_sharpe_train, round(test_median, 3) as best_sharpe_test,
         round(c, 3) as corr_train_test, ma_window as best_ma_window, atr_window as best_atr_window,
         atr_mult as best_atr_mult, sl_stop as best_sl_stop
         from best join rob using (symbol) join co using (symbol) where rn = 1""",
)
def _(spark, sf):
    """Grid, store, read back, rank: the engine's own result columns all the way."""
    path = new_folder(spark, "scan")
    candles = bars_1h(spark, sf).withColumns({"exchange": F.lit("alpha"), "tf": F.lit("1h")})
    scan_to(path, "s1", candles, param_grid(spark, SMALL_GRID), group_pairs=2)
    results = rounded(read_results(spark, path, "s1"), **DIGITS)
    return rank_pairs(results, combo=PARAMS).drop("rank", "delta")


USER_SETS = ({"ma_window": 6, "atr_window": 4, "atr_mult": 0.4}, {"ma_window": 9, "atr_window": 3, "atr_mult": 0.25})
# One series per part: its name holds symbol, split and set.
PART_BARS = (
    ctes(*indexed(BARS_1D), *SPLIT_SQL)
    + """select i.symbol || '|' || split || '|' || set_name as symbol, ts, open, high, low, close, volume
         from ix i join seg s on s.symbol = i.symbol and pos >= lo and pos < hi"""
)


def user_grid_sql() -> str:
    parts = []
    for i, p in enumerate(USER_SETS):
        chain = envelope(PART_BARS, p["ma_window"], p["atr_window"], p["atr_mult"])
        body = ctes(*chain, *FLAGS, *HELD, *curve(0.3)) + metrics_sql(YEAR_1D)
        parts.append(f"select cast({i} as int) as combo_id, * from ({body})")
    return " union all ".join(parts)


def touching(series: DataFrame, keys, ma_window: int, atr_window: int, atr_mult: float) -> DataFrame:
    return fill_price(signals(atr_envelope(series, ma_window, atr_window, atr_mult, keys=keys)))


@query("user_strategy_grid", user_grid_sql())
def _(spark, sf):
    """A user strategy over two parameter sets and all train and test parts, in one plan."""
    out = strategy_grid(bars_1d(spark, sf), touching, USER_SETS, BAR_SECONDS_1D)
    named = out.withColumn("symbol", F.concat_ws("|", "symbol", F.col("split").cast("string"), "set_name"))
    return rounded(named.drop("split", "set_name"), **DIGITS)
