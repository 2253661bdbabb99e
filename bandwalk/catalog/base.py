"""Registry of queries and their SQL counterparts, and the fixture SQL they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 8, **special: int) -> DataFrame:
    """Round every double column, so both engines print the same digits."""
    out: list[Column] = []
    for field in df.schema.fields:
        if field.dataType.typeName() == "double":
            out.append(F.round(field.name, special.get(field.name, digits)).alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


BARS_1H = """
  select event_type as symbol, date_trunc('hour', ts) as ts,
         min_by(100 + value / 50, event_id) as open, max(100 + value / 50) as high,
         min(100 + value / 50) as low, max_by(100 + value / 50, event_id) as close,
         cast(count(*) as double) as volume
  from events group by event_type, date_trunc('hour', ts)"""

BARS_1D = """
  select o_orderpriority as symbol, o_orderdate as ts,
         min_by(100 + o_totalprice / 100000, o_orderkey) as open,
         max(100 + o_totalprice / 100000) as high, min(100 + o_totalprice / 100000) as low,
         max_by(100 + o_totalprice / 100000, o_orderkey) as close,
         cast(count(*) as double) as volume
  from orders group by o_orderpriority, o_orderdate"""

WF = """
  select l_returnflag as symbol, cast(l_suppkey % 10 as int) as split,
         case when l_linestatus = 'O' then 'train' else 'test' end as set_name,
         cast(20 + 20 * (l_partkey % 5) as int) as ma_window,
         cast(10 + 20 * (l_orderkey % 3) as int) as atr_window,
         cast(2 + (l_linenumber % 4) as int) as mult_x2,
         cast(2 + 2 * (l_partkey % 2) as int) as sl_pct,
         case when count(*) % 17 = 0 then null
              else cast(sum(cast(round(l_discount * 100) as bigint) - cast(round(l_tax * 100) as bigint)) as double)
                   / count(*) end as sharpe
  from lineitem group by 1, 2, 3, 4, 5, 6, 7"""

TRIALS = """
  select cast(l_suppkey % 10 + 1 as int) as window_id,
         cast(10 + 5 * (l_partkey % 99) as int) as ma_window,
         cast(5 + 5 * (l_orderkey % 20) as int) as atr_window,
         cast(2 + (l_linenumber * 5 + l_partkey) % 39 as int) as mult_x4,
         cast(1 + l_orderkey % 15 as int) as sl_pct,
         max(case when l_quantity < 10 then cast(-999 as double)
                  else cast(round(l_discount * 100) as bigint) / cast(10 as double) end) as score
  from lineitem group by 1, 2, 3, 4, 5"""

BOOK = """
  select market_id, side,
         cast(row_number() over (partition by market_id, side order by off) as int) as lvl,
         case when side = 'ask' then 100 + off / cast(20 as double)
              else 100 - off / cast(20 as double) end as price, size
  from (select cast(l_suppkey % 20 as int) as market_id,
               case when l_linestatus = 'O' then 'ask' else 'bid' end as side,
               cast(l_quantity as int) as off, cast(count(*) as double) as size
        from lineitem group by 1, 2, 3) t"""

MARKETS = """
  select cast(s_suppkey % 20 as int) as market_id, min(s_name) as symbol,
         case when s_suppkey % 20 < 15 then 'perp' else 'spot' end as market_type,
         case when s_suppkey % 20 in (3, 17) then 'inactive' else 'active' end as status,
         case when s_suppkey % 20 = 5 then null
              else cast(cast(sum(round(s_acctbal * 100)) as bigint) as double) end as volume_24h,
         count(*) as trades_24h,
         case when s_suppkey % 20 = 6 then null
              else cast(cast(max(round(s_acctbal * 100)) as bigint) as double) end as open_interest
  from supplier group by s_suppkey % 20"""


def ctes(*parts: tuple[str, str], recursive: bool = False) -> str:
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(f"{name} as ({body})" for name, body in parts)


def indexed(bars: str, keys: str = "symbol") -> list[tuple[str, str]]:
    return [
        ("bars", bars),
        ("ix", f"select *, row_number() over (partition by {keys} order by ts) - 1 as pos, "
               f"count(*) over (partition by {keys}) as len from bars"),
    ]


def tr_of(src: str, keys: str = "symbol", name: str = "trs") -> list[tuple[str, str]]:
    return [
        (f"{name}_lag", f"select *, lag(close) over (partition by {keys} order by pos) as pc from {src}"),
        (name, "select *, greatest(high - low, coalesce(abs(high - pc), high - low), "
               f"coalesce(abs(low - pc), high - low)) as tr from {name}_lag"),
    ]


def rolling(column: str, n: int, keys: str = "symbol") -> str:
    return (f"case when pos >= {n - 1} then avg({column}) over (partition by {keys} order by pos "
            f"rows between {n - 1} preceding and current row) end")


def recursive_mean(src: str, column: str, alpha: str, n: str, keys=("symbol",), extra: str = "") -> str:
    """Exponential mean as its explicit weighted sum, gated on the first n - 1 bars."""
    on = " and ".join(f"a.{k} = b.{k}" for k in keys)
    cols = ", ".join(f"a.{k}" for k in keys)
    return (f"select {cols}, a.pos, {extra} sum(case when b.pos = 0 then 1.0 else {alpha} end "
            f"* pow(cast(1 - {alpha} as double), a.pos - b.pos) * b.{column}) as v "
            f"from {src} a join {src} b on {on} and b.pos <= a.pos where a.pos >= {n} - 1 "
            f"group by all")


def envelope(bars: str, ma: int, atr: int, mult: float, src: str = "ix") -> list[tuple[str, str]]:
    """SMA-centred channel with rolling ATR: cte ``ch`` with mid, atr, lower, upper."""
    return [
        *indexed(bars),
        *tr_of(src),
        ("ra", f"select *, {rolling('close', ma)} as ma_now, {rolling('tr', atr)} as atr_now from trs"),
        ("lagged", "select *, lag(ma_now) over (partition by symbol order by pos) as mid, "
                   "lag(atr_now) over (partition by symbol order by pos) as atr from ra"),
        ("ch", f"select *, mid - {mult} * atr as lower, mid + {mult} * atr as upper from lagged"),
    ]


FLAGS = [
    ("flags", "select *, coalesce(low <= lower, false) as long_entry, coalesce(high >= mid, false) as long_exit, "
              "coalesce(high >= upper, false) as short_entry, coalesce(low <= mid, false) as short_exit from ch"),
    ("priced", "select *, case when short_entry then upper when long_entry then lower "
               "when short_exit or long_exit then mid end as px from flags"),
]

HELD = [
    ("legs", """select *,
       case when long_entry and short_entry then null when long_entry and long_exit then null
            when long_entry then 1 when long_exit then 0 end as le,
       case when long_entry and short_entry then null when short_entry and short_exit then null
            when short_entry then 1 when short_exit then 0 end as se from priced"""),
    ("held", """select *,
       coalesce(last_value(le ignore nulls) over (partition by symbol order by pos), 0)
       - coalesce(last_value(se ignore nulls) over (partition by symbol order by pos), 0) as position from legs"""),
]


def curve(size: float, fees: float = 0.001, cash: float = 10000.0) -> list[tuple[str, str]]:
    """Equity per bar from ``held`` by running products: cte ``eq``."""
    return [
        ("steps", """select *, coalesce(lag(position) over (partition by symbol order by pos), 0) as was from held"""),
        ("opens", "select *, position <> 0 and position <> was as opened, was <> 0 and position <> was as closed, "
                  "case when position <> 0 and position <> was then px end as in_px from steps"),
        ("entry", "select *, last_value(in_px ignore nulls) over (partition by symbol order by pos) as p_now, "
                  "last_value(in_px ignore nulls) over (partition by symbol order by pos rows between unbounded preceding and 1 preceding) as p_was from opens"),
        ("factor", f"select *, case when closed then 1 + {size} * (was * (px / p_was - 1) - {fees} - {fees} * px / p_was) else 1.0 end as f, "
                   f"case when position <> 0 then 1 + {size} * (position * (close / p_now - 1) - {fees}) else 1.0 end as m from entry"),
        ("prods", "select *, exp(sum(ln(f)) over (partition by symbol order by pos)) as realised from factor"),
        ("eqs", f"select *, {cash} * realised * m as equity, "
                f"case when opened then {size} * {fees} * {cash} * realised else 0 end "
                f"+ case when closed then {size} * {fees} * {cash} * realised / f * px / p_was else 0 end as fees_paid from prods"),
        ("eq", f"select *, coalesce(lag(equity) over (partition by symbol order by pos), {cash}) as prev_equity, "
               f"greatest({cash}, max(equity) over (partition by symbol order by pos)) as peak from eqs"),
    ]


def walk(bars: str, group: list[str], size: float, fees: float = 0.001) -> list[tuple[str, str]]:
    """Bar-by-bar replay as a recursive query.

    ``bars`` is a cte with the group columns, pos, o/h/l/c, mid, lower, upper and sl.
    The result ``walk`` has one row per group and bar with the marked equity.
    """
    g = ", ".join(group)
    wg = ", ".join(f"w.{c}" for c in group)
    on = " and ".join(f"b.{c} = w.{c}" for c in group)
    return [
        ("wb", f"""select *, coalesce(low <= lower, false) as le, coalesce(high >= mid, false) as lx,
             coalesce(high >= upper, false) as se, coalesce(low <= mid, false) as sx,
             case when coalesce(high >= upper, false) then upper when coalesce(low <= lower, false) then lower else mid end as px
           from {bars}"""),
        ("walk", f"""
          select {g}, cast(-1 as bigint) as pos, 0 as side, cast(null as double) as p_in, cast(null as bigint) as in_pos,
                 cast(10000 as double) as base, cast(10000 as double) as eq, cast(10000 as double) as prev_eq,
                 false as opened, false as gone, 0 as was, cast(null as double) as p_was, cast(null as bigint) as was_pos,
                 cast(null as double) as p_out, cast(null as double) as ret, false as hit, cast(0 as double) as fee
          from (select distinct {g} from wb)
          union all
          select {g}, pos, nside, case when opened then px when nside <> 0 then p_in end,
                 case when opened then pos when nside <> 0 then in_pos end, nbase,
                 case when nside <> 0 then nbase * (1 + {size} * (nside * (close / (case when opened then px else p_in end) - 1) - {fees})) else nbase end,
                 eq, opened, gone, side, p_in, in_pos, p_out, ret, hit, fee
          from (select *, case when gone then base * (1 + ret) else base end as nbase,
                       case when new_l then 1 when new_s then -1 when gone then 0 else side end as nside,
                       (new_l or new_s) as opened,
                       case when new_l or new_s then (case when gone then base * (1 + ret) else base end) * {size} * {fees} else 0 end
                       + case when gone then base * {size} * {fees} * p_out / p_in else 0 end as fee
                from (select *, case when gone then {size} * (side * (p_out / p_in - 1) - {fees} - {fees} * p_out / p_in) end as ret
                      from (select *, case when hit_l then least(open, p_in * (1 - sl)) when hit_s then greatest(open, p_in * (1 + sl)) else px end as p_out,
                                   hit or (act and ((side > 0 and lx and not le) or (side < 0 and sx and not se))) as gone,
                                   act and le and not lx and side <= 0 as new_l, act and se and not sx and side >= 0 as new_s
                            from (select *, hit_l or hit_s as hit, not (hit_l or hit_s or (le and se)) as act
                                  from (select {wg}, b.pos, b.open, b.high, b.low, b.close, b.le, b.lx, b.se, b.sx, b.px, b.sl,
                                               w.side, w.p_in, w.in_pos, w.base, w.eq,
                                               coalesce(w.side > 0 and b.low <= w.p_in * (1 - b.sl), false) as hit_l,
                                               coalesce(w.side < 0 and b.high >= w.p_in * (1 + b.sl), false) as hit_s
                                        from walk w join wb b on {on} and b.pos = w.pos + 1) s1) s2) s3) s4) s5"""),
        ("bars_walked", "select * from walk where pos >= 0"),
        ("peaks", f"select *, greatest(10000, max(eq) over (partition by {g} order by pos)) as peak from bars_walked"),
    ]


def walk_metrics(group: list[str], bar_seconds: int, digits: int = 8) -> str:
    g = ", ".join(group)
    year = (365 * 86400 / bar_seconds) ** 0.5
    return f"""select {g},
      round(avg(eq / prev_eq - 1) / nullif(stddev_samp(eq / prev_eq - 1), 0) * {year!r}, 6) as sharpe,
      round(arg_max(eq, pos) / 10000 - 1, {digits}) as total_return,
      round(max(1 - eq / peak), {digits}) as max_drawdown,
      count(*) filter (where opened) as n_trades,
      round(count(*) filter (where gone and ret > 0) / nullif(count(*) filter (where gone), 0), {digits}) as win_rate,
      round(sum(fee), 6) as fees_paid, round(arg_max(eq, pos), 6) as end_equity
      from peaks group by {g}"""
