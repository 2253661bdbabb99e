"""Market lists and order-book replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

LEVELS = "array<struct<price:string,remaining_base_amount:string>>"
# Fixed format of a book reply: bids and asks, best first, numbers as strings.
BOOK_REPLY = f"struct<bids:{LEVELS},asks:{LEVELS}>"


def active_markets(perp: DataFrame, spot: DataFrame, perp_only: bool = False) -> DataFrame:
    """Active markets of both lists."""
    both = perp.unionByName(spot).filter(F.col("status") == "active")
    return both.filter(F.col("market_type") == "perp") if perp_only else both


def explode_book(books: DataFrame, key: str = "market_id") -> DataFrame:
    """(key, side, lvl, price, size) from bids/asks arrays, strings cast to numbers.

    Both sides come out of one pass: the arrays are tagged and concatenated, not unioned.
    """

    def tagged(column: str, side: str) -> Column:
        return F.transform(
            F.coalesce(F.col(column), F.array().cast(LEVELS)),
            lambda o, i: F.struct(
                F.lit(side).alias("side"),
                (i + 1).cast("int").alias("lvl"),
                o["price"].cast("double").alias("price"),
                o["remaining_base_amount"].cast("double").alias("size"),
            ),
        )

    return books.select(key, F.inline(F.concat(tagged("bids", "bid"), tagged("asks", "ask"))))


def parse_book_reply(replies: DataFrame, key: str = "market_id", column: str = "reply") -> DataFrame:
    return explode_book(replies.select(key, F.from_json(column, BOOK_REPLY).alias("_b")).select(key, "_b.*"), key)


def _order(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def find_market(
    markets: DataFrame, wanted: Sequence[str], order: str | Sequence[str] = "market_id"
) -> DataFrame:
    """Market of each wanted symbol: exact match first, else the first that contains it.

    Case is ignored; "first" is by ``order``. Unknown symbols give no row. The list is short enough
    to be written down; ``find_markets`` takes a table of any length.
    """
    symbol, query = F.upper("symbol"), F.upper("query")
    columns = markets.columns
    return (
        markets.withColumn("query", F.explode(F.array(*[F.lit(w) for w in wanted])))
        .filter(symbol.contains(query))
        .groupBy("query")
        .agg(
            F.min_by(
                F.struct(*columns), F.struct((symbol != query).alias("partial"), *_order(order))
            ).alias("_m")
        )
        .select("query", "_m.*")
    )


def _pieces(text: Column, longest: int = 3) -> Column:
    """The distinct substrings of up to ``longest`` characters, the empty one included."""
    runs = [
        F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n))))
        .otherwise(F.array().cast("array<string>"))
        for n in range(1, longest + 1)
    ]
    return F.array_distinct(F.concat(F.array(F.lit("")), *runs))


def find_markets(
    markets: DataFrame, wanted: DataFrame, order: str | Sequence[str] = ("market_id", "symbol")
) -> DataFrame:
    """``find_market`` for a table with a column ``query``, in any number of rows.

    Repeated queries give one row; unknown symbols and nulls give none.

    Symbols are indexed by their pieces of up to three letters. A query of up to three letters is a piece, and
    each piece knows its first market. A longer query meets only the markets that hold its rarest piece.
    """
    columns = markets.columns
    queries = wanted.select("query", F.upper("query").alias("_q")).filter(F.col("query").isNotNull()).distinct()
    asked = queries.select("_q").distinct()
    named = markets.select(F.upper("symbol").alias("_s"), F.struct(*columns).alias("_m")).filter(F.col("_s").isNotNull())
    first = F.min_by("_m", F.struct(*[F.col(f"_m.{c}") for c in _order(order)])).alias("_m")

    exact = named.join(asked, F.col("_s") == F.col("_q"), "left_semi").groupBy(F.col("_s").alias("_q")).agg(first)
    open_ones = asked.join(exact.select("_q"), "_q", "left_anti")
    postings = named.select("_s", "_m", F.explode(_pieces(F.col("_s"))).alias("_piece"))

    short = open_ones.filter(F.length("_q") <= 3)
    by_piece = (
        postings.join(short, F.col("_piece") == F.col("_q"), "left_semi")
        .groupBy(F.col("_piece").alias("_q")).agg(first)
    )
    long = open_ones.filter(F.length("_q") > 3)
    wide = postings.filter(F.length("_piece") == 3)
    spread = long.select("_q", F.explode(_pieces(F.col("_q"))).alias("_piece")).filter(F.length("_piece") == 3)
    # A piece that no symbol holds counts zero: its query has no market.
    counts = wide.groupBy("_piece").agg(F.count("*").alias("_n"))
    rarest = (
        spread.join(counts, "_piece", "left").groupBy("_q")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_piece")).alias("_r"))
        .filter(F.col("_r._n") > 0).select("_q", F.col("_r._piece").alias("_piece"))
    )
    within = wide.join(rarest, "_piece").filter(F.col("_s").contains(F.col("_q"))).groupBy("_q").agg(first)

    found = exact.unionByName(by_piece).unionByName(within)
    return queries.join(found, "_q").select("query", "_m.*")
