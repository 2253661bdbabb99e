"""Queries over markets and order books."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandwalk.catalog.base import BOOK, MARKETS, ctes, query, rounded
from bandwalk.fixtures import book, markets, table
from bandwalk.functions.scalars import num_or_zero
from bandwalk.operators import liquidity as lq
from bandwalk.sources.markets import active_markets, find_market, find_markets, parse_book_reply

B = ("book", BOOK)
M = ("mk", MARKETS)
TOB = ("tob", """select market_id, bid as best_bid, ask as best_ask, (bid + ask) / 2 as mid,
       (ask - bid) / ((bid + ask) / 2) * 100 as spread_pct
       from (select market_id, arg_min(price, lvl) filter (where side = 'bid') as bid,
                    arg_min(price, lvl) filter (where side = 'ask') as ask from book group by 1)
       where bid is not null and ask is not null""")
DEPTH = ("dep", """select b.market_id, cast(p as double) as pct,
       sum(case when side = 'ask' and price <= mid * (1 + p / 100) then price * size else 0 end) as ask_usd,
       sum(case when side = 'bid' and price >= mid * (1 - p / 100) then price * size else 0 end) as bid_usd
       from book b join tob using (market_id), (select unnest([0.5::double, 1, 2, 5, 10, 20]) as p) group by 1, 2""")
SLIP = [
    ("wk", """select b.market_id, side, lvl, price, price * size as usd_here, mid,
       coalesce(sum(price * size) over (partition by b.market_id, side order by lvl rows between unbounded preceding and 1 preceding), 0) as prior
       from book b join tob using (market_id)"""),
    ("fl", """select market_id, side, q as usd, mid, price, least(greatest(q - prior, 0), usd_here) as fill
       from wk, (select unnest([1000, 5000, 10000, 50000, 100000]) as q)"""),
    ("sd", """select market_id, usd, side, case when sum(fill / price) = 0 then 100.0
       else abs(sum(fill) / sum(fill / price) - any_value(mid)) / any_value(mid) * 100 end as slip, sum(fill) / usd * 100 as fill_pct
       from fl group by 1, 2, 3"""),
    ("slp", """select market_id, usd, max(slip) filter (where side = 'ask') as slip_buy, max(slip) filter (where side = 'bid') as slip_sell,
       max(fill_pct) filter (where side = 'ask') as fill_buy, max(fill_pct) filter (where side = 'bid') as fill_sell from sd group by 1, 2"""),
]
REPORT = [
    ("rep", """select m.market_id, m.symbol, m.market_type,
       greatest(0, 25 * (1 - spread_pct / 0.5)) + least(25, 5 * log10(greatest(1, d1))) + least(15, 3 * log10(greatest(1, d5)))
       + greatest(0, 15 * (1 - s)) + least(10, 1.43 * log10(greatest(1, coalesce(volume_24h, 0))))
       + least(10, 1.43 * log10(greatest(1, coalesce(open_interest, 0)))) as score,
       spread_pct as spread, d1 as depth_1pct, d5 as depth_5pct, s as slip_10k, coalesce(volume_24h, 0) as volume_24h,
       coalesce(open_interest, 0) as oi
       from mk m join tob using (market_id)
       join (select market_id, max(ask_usd + bid_usd) filter (where pct = 1) as d1, max(ask_usd + bid_usd) filter (where pct = 5) as d5 from dep group by 1) using (market_id)
       join (select market_id, (slip_buy + slip_sell) / 2 as s from slp where usd = 10000) using (market_id)"""),
]
REPORT_COLUMNS = """market_id, symbol, round(score, 8) as score, round(spread, 8) as spread, round(depth_1pct, 6) as depth_1pct,
       round(depth_5pct, 6) as depth_5pct, round(slip_10k, 8) as slip_10k, volume_24h, oi"""
USD = {"depth_1pct": 6, "depth_5pct": 6}


@query("active_markets", ctes(M) + "select * from mk where status = 'active'")
def _(spark, sf):
    m = markets(spark, sf)
    return active_markets(m.filter("market_type = 'perp'"), m.filter("market_type = 'spot'"))


@query("active_perps", ctes(M) + "select * from mk where status = 'active' and market_type = 'perp'")
def _(spark, sf):
    m = markets(spark, sf)
    return active_markets(m.filter("market_type = 'perp'"), m.filter("market_type = 'spot'"), True)


@query("explode_book", ctes(B) + "select market_id, side, lvl, price, size from book")
def _(spark, sf):
    """The book packed into replies with string numbers and unpacked again."""
    level = F.struct(
        F.col("lvl"),
        F.col("price").cast("string").alias("price"),
        F.col("size").cast("string").alias("remaining_base_amount"),
    )

    def side(name: str):
        levels = F.array_sort(F.collect_list(F.when(F.col("side") == name, level)))
        return F.transform(levels, lambda o: o.dropFields("lvl")).alias(name + "s")

    replies = (
        book(spark, sf)
        .groupBy("market_id")  # a book side has at most 50 levels here
        .agg(side("bid"), side("ask"))
        .select("market_id", F.to_json(F.struct("bids", "asks")).alias("reply"))
    )
    return parse_book_reply(replies)


@query("find_market", ctes(M) + """, q as (select unnest(['supplier#000000003', '00001', 'SUPPLIER', 'nothing']) as query),
       c as (select query, mk.*, row_number() over (partition by query order by case when upper(symbol) = upper(query) then 0 else 1 end, market_id) as rn
             from q join mk on contains(upper(symbol), upper(query)))
       select query, market_id, symbol, market_type, status, volume_24h, trades_24h, open_interest from c where rn = 1""")
def _(spark, sf):
    return find_market(markets(spark, sf), ["supplier#000000003", "00001", "SUPPLIER", "nothing"])


@query("find_markets", ctes(M) + """, q as (select distinct unnest([c_name, substr(c_name, length(c_name) - 1 - c_nationkey % 9), 'Supplier#' || right(c_name, 9)]) as query
            from customer),
       c as (select query, mk.*, row_number() over (partition by query order by case when upper(symbol) = upper(query) then 0 else 1 end, market_id, symbol) as rn
             from q join mk on contains(upper(symbol), upper(query)))
       select query, market_id, symbol, market_type, status, volume_24h, trades_24h, open_interest from c where rn = 1""")
def _(spark, sf):
    """Whole names, endings of one to ten letters and names of suppliers, all made of the customers' names, looked up at once."""
    name = F.col("c_name")
    ending = F.substr(name, (F.length(name) - 1 - F.col("c_nationkey") % 9).cast("int"))
    wanted = table(spark, sf, "customer").select(
        F.explode(F.array(name, ending, F.concat(F.lit("Supplier#"), F.right(name, F.lit(9))))).alias("query")
    )
    return find_markets(markets(spark, sf), wanted)


@query("num_or_zero", ctes(M) + """select market_id, coalesce(volume_24h, 0) as volume_24h, coalesce(open_interest, 0) as open_interest,
       cast(coalesce(trades_24h, 0) as double) as trades_24h from mk""")
def _(spark, sf):
    return markets(spark, sf).select(
        "market_id", *[num_or_zero(F.col(c)).alias(c) for c in ("volume_24h", "open_interest", "trades_24h")]
    )


@query("top_of_book", ctes(B, TOB) + """select market_id, best_bid, best_ask, round(mid, 8) as mid,
       round(spread_pct, 8) as spread_pct from tob""")
def _(spark, sf):
    return rounded(lq.top_of_book(book(spark, sf)))


@query("depth", ctes(B, TOB, DEPTH) + """select market_id, pct, round(ask_usd, 6) as ask_usd, round(bid_usd, 6) as bid_usd,
       round(ask_usd + bid_usd, 6) as total_usd from dep""")
def _(spark, sf):
    return rounded(lq.depth(book(spark, sf)), 6)


@query("slippage", ctes(B, TOB, *SLIP) + """select market_id, usd, round(slip_buy, 8) as slip_buy, round(slip_sell, 8) as slip_sell,
       round(fill_buy, 8) as fill_buy, round(fill_sell, 8) as fill_sell, round((slip_buy + slip_sell) / 2, 8) as slip_avg from slp""")
def _(spark, sf):
    return rounded(lq.slippage(book(spark, sf)))


@query("liquidity_score", ctes(B, M, TOB, DEPTH, *SLIP, *REPORT) + "select symbol, round(score, 8) as score from rep")
def _(spark, sf):
    return rounded(lq.liquidity_report(markets(spark, sf), book(spark, sf)).select("symbol", "score"))


@query("liquidity_report", ctes(B, M, TOB, DEPTH, *SLIP, *REPORT) + f"select {REPORT_COLUMNS} from rep")
def _(spark, sf):
    return rounded(lq.liquidity_report(markets(spark, sf), book(spark, sf)), **USD)


@query("rank_liquidity", ctes(B, M, TOB, DEPTH, *SLIP, *REPORT, ("rk", """select *, row_number() over (order by score desc, symbol) as rank
       from rep where market_type = 'perp'""")) + f"select rank, {REPORT_COLUMNS} from rk where score >= 60")
def _(spark, sf):
    return rounded(lq.rank_liquidity(markets(spark, sf), book(spark, sf), 60.0), **USD)
