import pandas as pd
import pytest

from pyspark.sql import functions as F

from bandwalk.operators import liquidity as lq
from bandwalk.sources.markets import find_market, find_markets, parse_book_reply
from tests.helpers import np

SCHEMA = "market_id int, side string, lvl int, price double, size double"


def make_book(seed=1, markets=4, levels=30):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(markets):
        for side, sign in (("ask", 1), ("bid", -1)):
            px = 100 + sign * np.cumsum(rng.uniform(0.01, 0.5, levels))
            rows += [(m, side, i + 1, float(p), float(rng.uniform(1, 40))) for i, p in enumerate(px)]
    return pd.DataFrame(rows, columns=["market_id", "side", "lvl", "price", "size"])


def walk(levels, mid, usd):
    """Fill a market order level by level."""
    left, got, spent = float(usd), 0.0, 0.0
    for price, size in levels:
        take = min(left, price * size)
        got += take / price
        spent += take
        left -= take
        if left <= 0:
            break
    return (abs(spent / got - mid) / mid * 100, spent / usd * 100) if got else (100.0, 0.0)


def test_slippage_equals_walking_the_book(spark):
    pdf = make_book()
    got = lq.slippage(spark.createDataFrame(pdf, SCHEMA)).toPandas()
    assert len(got) == 4 * 5
    for _, g in got.iterrows():
        book = pdf[pdf["market_id"] == g["market_id"]]
        ask, bid = (book[book["side"] == s].sort_values("lvl") for s in ("ask", "bid"))
        mid = (ask["price"].iloc[0] + bid["price"].iloc[0]) / 2
        for side, frame in (("buy", ask), ("sell", bid)):
            slip, fill = walk(frame[["price", "size"]].to_numpy(), mid, g["usd"])
            assert g[f"slip_{side}"] == pytest.approx(slip) and g[f"fill_{side}"] == pytest.approx(fill)
    fills = got.sort_values("usd").groupby("market_id")["fill_buy"]
    assert fills.apply(lambda s: s.is_monotonic_decreasing).all()
    assert got["fill_buy"].min() < 100  # the largest order exceeds the book


def test_depth_grows_with_distance(spark):
    got = lq.depth(spark.createDataFrame(make_book(2), SCHEMA)).toPandas().sort_values("pct")
    assert got.groupby("market_id")["total_usd"].apply(lambda s: s.is_monotonic_increasing).all()


def test_an_empty_side_drops_the_market(spark):
    pdf = make_book(3)
    pdf = pdf[~((pdf["market_id"] == 2) & (pdf["side"] == "ask"))]
    book = spark.createDataFrame(pdf, SCHEMA)
    assert {r["market_id"] for r in lq.top_of_book(book).collect()} == {0, 1, 3}
    assert {r["market_id"] for r in lq.slippage(book).select("market_id").distinct().collect()} == {0, 1, 3}


def test_a_level_without_size_fills_nothing(spark):
    rows = [(1, "ask", 1, 101.0, 0.0), (1, "bid", 1, 99.0, 0.0)]
    got = lq.slippage(spark.createDataFrame(rows, SCHEMA), (1000,)).first()
    assert (got["slip_buy"], got["fill_buy"], got["slip_avg"]) == (100.0, 0.0, 100.0)


def test_rank_is_given_before_the_threshold(spark):
    rows = [(m, f"S{m}", "perp" if m < 3 else "spot", "active", 10.0 ** m, 5, None) for m in range(4)]
    markets = spark.createDataFrame(
        rows, "market_id int, symbol string, market_type string, status string, volume_24h double, trades_24h long, open_interest double"
    )
    book = spark.createDataFrame(make_book(4), SCHEMA)
    full = lq.rank_liquidity(markets, book).toPandas().sort_values("rank")
    assert len(full) == 3 and full["score"].is_monotonic_decreasing
    cut = full["score"].iloc[1]
    part = lq.rank_liquidity(markets, book, cut).toPandas()
    assert sorted(part["rank"]) == [1, 2]
    assert full["score"].between(0, 100).all() and (full["oi"] == 0).all()


def test_book_reply_and_market_lookup(spark):
    reply = '{"bids":[{"price":"9.5","remaining_base_amount":"2"}],"asks":[{"price":"10","remaining_base_amount":"1.5"},{"price":"11","remaining_base_amount":"3"}]}'
    got = parse_book_reply(spark.createDataFrame([(7, reply), (8, '{"bids":[]}')], "market_id int, reply string"))
    assert sorted(map(tuple, got.collect())) == [(7, "ask", 1, 10.0, 1.5), (7, "ask", 2, 11.0, 3.0), (7, "bid", 1, 9.5, 2.0)]
    markets = spark.createDataFrame([(1, "WBTC"), (2, "btc"), (3, "BTCX")], "market_id int, symbol string")
    found = {r["query"]: r["market_id"] for r in find_market(markets, ["BTC", "tcx", "eth", "b"]).collect()}
    assert found == {"BTC": 2, "tcx": 3, "b": 1}


def test_books_deeper_than_a_block_give_the_same_figures(spark):
    rows = list(make_book(6).itertuples(index=False, name=None))
    deep = [(9, s, i + 1, 100.0 + (i + 1) * (0.001 if s == "ask" else -0.001), 0.05) for s in ("ask", "bid") for i in range(5_000)]
    book = spark.createDataFrame(rows + deep, SCHEMA)
    order = ["market_id", "usd"]
    want = lq.slippage(book, block_levels=100_000).orderBy(*order).toPandas()
    for block in (1, 3, 64):
        got = lq.slippage(book, block_levels=block).orderBy(*order).toPandas()
        pd.testing.assert_frame_equal(got, want, rtol=1e-9)
    names = [(m, f"S{m}", "perp", "active", 10.0, 5, None) for m in (*range(4), 9)]
    markets = spark.createDataFrame(
        names, "market_id int, symbol string, market_type string, status string, volume_24h double, trades_24h long, open_interest double"
    )
    small = lq.liquidity_report(markets, book, 7).orderBy("market_id").toPandas()
    pd.testing.assert_frame_equal(small, lq.liquidity_report(markets, book, 100_000).orderBy("market_id").toPandas(), rtol=1e-9)
    # 10,000 USD take about 2,000 levels of 5 USD; the mean fill is half of that depth away.
    filled = want[(want["market_id"] == 9) & (want["usd"] == 10_000)].iloc[0]
    assert filled["slip_buy"] == pytest.approx(1.0, rel=0.02) and filled["fill_buy"] == pytest.approx(100.0)


def test_a_table_of_wanted_markets_equals_the_plain_search(spark):
    rng = np.random.default_rng(5)
    symbols = ["".join(rng.choice(list("abAB\u00e91-"), rng.integers(0, 9))) for _ in range(300)] + [None]
    queries = [s for s in symbols[:60]] + ["".join(rng.choice(list("abAB\u00e91-"), rng.integers(0, 6))) for _ in range(200)] + ["zzzz", None]
    markets = spark.createDataFrame([(i % 150, s, float(i)) for i, s in enumerate(symbols)], "market_id int, symbol string, volume_24h double")
    got = {r["query"]: (r["market_id"], r["symbol"]) for r in find_markets(markets, spark.createDataFrame([(q,) for q in queries], "query string")).collect()}
    listed = find_market(markets, [q for q in queries if q is not None], ["market_id", "symbol"])
    assert got == {r["query"]: (r["market_id"], r["symbol"]) for r in listed.collect()}
    want = {}
    for q in {q for q in queries if q is not None}:
        hits = [(s.upper() != q.upper(), i % 150, s) for i, s in enumerate(symbols) if s is not None and q.upper() in s.upper()]
        if hits:
            want[q] = min(hits)[1:]
    assert got == want


def test_many_wanted_markets_are_planned_without_a_cross_product(spark):
    markets = spark.range(1000).select(F.col("id").cast("int").alias("market_id"), F.format_string("SYM%05d", "id").alias("symbol"))
    wanted = spark.range(100_000).select(F.format_string("m%05d", "id").alias("query"))
    found = find_markets(markets, wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert found.count() == 1000
