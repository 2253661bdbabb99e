"""Queries over candle storage, replies, backfill planning and stored results."""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from bandwalk.catalog.base import BARS_1D, BARS_1H, WF, ctes, query, rounded
from bandwalk.fixtures import bars_1d, bars_1h, table, wf_results
from bandwalk.functions.scalars import tf_seconds
from bandwalk.session import settled, shared_folder
from bandwalk.sources import candles as cd
from bandwalk.sources import results as rs
from bandwalk.streaming.ingest import stream_candles

OHLCV = ("open", "high", "low", "close", "volume")
HOURLY = f"select 'alpha' as exchange, '1h' as tf, symbol, epoch_ms(ts) as date, open, high, low, close, volume, ts from ({BARS_1H})"
DAILY = f"select 'beta' as exchange, '1d' as tf, symbol, epoch_ms(ts) as date, open, high, low, close, volume, ts from ({BARS_1D})"
CANDLES = ("candles", f"{HOURLY} union all {DAILY}")
ROUNDED = ", ".join(f"round({c}, 8) as {c}" for c in OHLCV)


def _as_candles(bars: DataFrame, exchange: str, tf: str) -> DataFrame:
    return bars.select(
        F.lit(exchange).alias("exchange"),
        F.lit(tf).alias("tf"),
        "symbol",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("date"),
        *OHLCV,
    )


def candles(spark, sf) -> DataFrame:
    """Hourly and daily candles under two exchanges."""
    return _as_candles(bars_1h(spark, sf), "alpha", "1h").unionByName(
        _as_candles(bars_1d(spark, sf), "beta", "1d")
    )


def file_system(uri: str):
    """The file system of a shared folder, and the folder's path in it."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("read_candles", ctes(CANDLES) + f"""select exchange, tf, symbol, date, {ROUNDED}, ts from candles""")
def _(spark, sf):
    """Candles stored by pair and month and read back."""
    path = new_folder(spark, "candles")
    cd.write_candles(candles(spark, sf), path)
    return rounded(cd.read_candles(spark, path, ["alpha", "beta"], ["1h", "1d"]))


@query("read_candle_files", ctes(CANDLES) + f"""select exchange, tf, symbol, date, {ROUNDED}, ts from candles
       where exchange = 'alpha'""")
def _(spark, sf):
    """One CSV per pair under exchange/timeframe, read by path pattern."""
    root = new_folder(spark, "raw")
    staged = new_folder(spark, "staged")
    # Spark names its own part files; the layout under test has one file per symbol.
    (
        candles(spark, sf)
        .repartition("exchange", "tf", "symbol")
        .write.partitionBy("exchange", "tf", "symbol")
        .option("header", True)
        .csv(staged)
    )
    files, top = file_system(staged)
    target = file_system(root)[1]
    for part in files.get_file_info(pafs.FileSelector(top, recursive=True)):
        if part.extension == "csv":
            exchange, tf, symbol = (unquote(p.split("=", 1)[1]) for p in part.path.split("/")[-4:-1])
            files.create_dir(f"{target}/{exchange}/{tf}", recursive=True)
            files.move(part.path, f"{target}/{exchange}/{tf}/{symbol}.csv")
    return rounded(cd.read_candle_files(spark, root, ["alpha", "gamma"], ["1h"]))


@query("list_pairs", ctes(CANDLES) + "select distinct exchange, tf, symbol from candles where exchange in ('alpha', 'beta') and tf in ('1h', '5m')")
def _(spark, sf):
    return cd.list_pairs(candles(spark, sf), ["alpha", "beta"], ["1h", "5m"])


@query("select_pairs", ctes(CANDLES) + """select distinct exchange, tf, symbol from candles
       where exchange in ('alpha', 'beta') and tf in ('1h', '1d') and symbol in ('click', '5-LOW', 'absent')""")
def _(spark, sf):
    return cd.select_pairs(candles(spark, sf), ["alpha", "beta"], ["1h", "1d"], ["click", "5-LOW", "absent"])


@query("time_slice", ctes(("bars", BARS_1D)) + f"""select symbol, ts, {ROUNDED} from bars
       where ts between timestamp '1996-01-01' and timestamp '1997-12-31'""")
def _(spark, sf):
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("1996-01-01 00:00:00", "1997-12-31 00:00:00"))
    return rounded(cd.time_slice(bars_1d(spark, sf), start, end))


# New candles: the same hours one hour later with a higher close, each sent twice.
FRESH = ("fresh", f"""select exchange, tf, symbol, date + 3600000 as date, open, high, low, close + 1 + arrival as close, volume, arrival
         from ({HOURLY}), (select unnest([0, 1]) as arrival)""")


def fresh(spark, sf) -> DataFrame:
    return (
        _as_candles(bars_1h(spark, sf), "alpha", "1h")
        .withColumn("arrival", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("date", F.col("date") + 3_600_000)
        .withColumn("close", F.col("close") + 1 + F.col("arrival"))
    )


def upsert_sql(order: str) -> str:
    return ctes(("old", HOURLY), FRESH, ("every", f"""
        select exchange, tf, symbol, date, open, high, low, close, volume, 0 as src, 0 as seq from old
        union all select exchange, tf, symbol, date, open, high, low, close, volume, 1, arrival from fresh"""),
        ("r", f"select *, row_number() over (partition by exchange, tf, symbol, date order by {order}) as rn from every")
    ) + f"select exchange, tf, symbol, date, {ROUNDED} from r where rn = 1"


@query("upsert_candles", upsert_sql("src, seq"))
def _(spark, sf):
    old = _as_candles(bars_1h(spark, sf), "alpha", "1h")
    return rounded(cd.upsert_candles(old, fresh(spark, sf), arrival="arrival"))


@query("upsert_latest_wins", upsert_sql("src desc, seq desc"))
def _(spark, sf):
    old = _as_candles(bars_1h(spark, sf), "alpha", "1h")
    return rounded(cd.upsert_candles(old, fresh(spark, sf), latest_wins=True, arrival="arrival"))


@query("stream_candles", upsert_sql("src, seq"))
def _(spark, sf):
    """The same update through the incremental ingest, one arrival file per micro-batch set."""
    store, source, state = (new_folder(spark, n) for n in ("store", "arrivals", "state"))
    cd.write_candles(_as_candles(bars_1h(spark, sf), "alpha", "1h"), store)
    arriving = settled(fresh(spark, sf))
    arriving.filter("arrival = 0").drop("arrival").write.mode("append").parquet(source)
    stream_candles(spark, source, store, state).awaitTermination()
    # The second arrival repeats every candle and must change nothing.
    arriving.filter("arrival = 1").drop("arrival").write.mode("append").parquet(source)
    stream_candles(spark, source, store, state).awaitTermination()
    return rounded(cd.read_candles(spark, store).drop("ts"))


@query("parse_candle_reply", ctes(("bars", BARS_1H)) + f"""select symbol, epoch_ms(ts) as date, {ROUNDED} from bars
       where dayofweek(ts) <> 0""")
def _(spark, sf):
    """Daily replies of hourly candles; Sundays answer with an error code."""
    candle = F.struct(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
        F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
        F.col("close").alias("c"), F.col("volume").alias("v"),
    )
    replies = (
        bars_1h(spark, sf)
        .groupBy("symbol", F.to_date("ts").alias("day"))  # 24 candles per reply
        .agg(F.collect_list(candle).alias("c"))
        .select(
            "symbol",
            F.to_json(
                F.struct(
                    F.when(F.dayofweek("day") == 1, 500).otherwise(200).alias("code"), F.col("c")
                )
            ).alias("reply"),
        )
    )
    return rounded(cd.parse_candle_reply(replies))


@query("normalise_frame", ctes(("bars", BARS_1D)) + f"select symbol, epoch_ms(ts) as date, {ROUNDED} from bars")
def _(spark, sf):
    titled = bars_1d(spark, sf).select(
        F.col("symbol").alias("Symbol"), F.col("ts").alias("Date"), *[F.col(c).alias(c.title()) for c in OHLCV]
    )
    return rounded(cd.normalise_frame(titled))


NATIONS = "select 'alpha' as exchange, '1h' as tf, n_name as symbol from nation"
MARKET_PAIRS = ("mp", f"select distinct exchange, tf, symbol from candles union all {NATIONS}")
START, END = 1_704_067_200, 1_709_251_200


def requested_pairs(spark, sf) -> DataFrame:
    nations = table(spark, sf, "nation").select(
        F.lit("alpha").alias("exchange"), F.lit("1h").alias("tf"), F.col("n_name").alias("symbol")
    )
    return cd.list_pairs(candles(spark, sf)).unionByName(nations)


@query("plan_backfill", ctes(CANDLES, MARKET_PAIRS, ("l", "select exchange, tf, symbol, max(date) as d from candles group by 1, 2, 3"), ("f", f"""
       select mp.exchange, mp.tf, mp.symbol, case when mp.tf = '1h' then 3600 else 86400 end as step,
              coalesce(d // 1000 + case when mp.tf = '1h' then 3600 else 86400 end, {START}) as a
       from mp left join l using (exchange, tf, symbol)""")) + f"""
       select exchange, tf, symbol, cast(i as int) as chunk, a + i * 500 * step as start_s,
              least(a + (i + 1) * 500 * step, {END}) as end_s
       from (select f.*, unnest(range(cast(ceil(({END} - a) / (500.0 * step)) as bigint))) as i from f where a < {END})""")
def _(spark, sf):
    return cd.plan_backfill(requested_pairs(spark, sf), candles(spark, sf), START, END)


@query("stored_results", ctes(("wf", WF)) + """select 's1' as scan_id, 'alpha' as exchange, '1h' as tf, symbol, split, set_name,
       ma_window, atr_window, mult_x2, sl_pct, round(sharpe, 8) as sharpe from wf""")
def _(spark, sf):
    """Results written per scan and pair, one pair rewritten, one scan read back."""
    path = new_folder(spark, "results")
    results = settled(
        wf_results(spark, sf).withColumns({"exchange": F.lit("alpha"), "tf": F.lit("1h")})
    )
    rs.write_results(results, path, "s1")
    rs.write_results(results.filter("symbol = 'A'"), path, "s1")
    rs.write_results(results.filter("symbol = 'N'"), path, "s2")
    return rounded(rs.read_results(spark, path, "s1"))


@query("parse_result_name", ctes(CANDLES) + """select distinct 'scan_' || symbol || '_' || tf || '_' || exchange || '.pickle' as name,
       symbol, tf, exchange from candles""")
def _(spark, sf):
    """Names of stored results; nation names hold an underscore and make malformed ones."""
    names = cd.list_pairs(candles(spark, sf)).select("symbol", "tf", "exchange").unionByName(
        table(spark, sf, "nation").select(
            F.col("n_name").alias("symbol"), F.lit("1h").alias("tf"), F.lit("alpha").alias("exchange")
        )
    )
    return rs.parse_result_name(
        names.select(
            F.concat(
                F.lit("scan_"), F.concat_ws("_", "symbol", "tf", "exchange"), F.lit(".pickle")
            ).alias("name")
        ),
        prefix="scan_",
    )


DONE = ("done", "select distinct exchange, tf, symbol from candles where symbol in ('click', '5-LOW')")
PENDING = ("pend", """select * from mp where (exchange, tf, symbol) not in (select (exchange, tf, symbol) from done)
           and (exchange, tf, symbol) in (select (exchange, tf, symbol) from candles)""")


def pending(spark, sf) -> tuple[DataFrame, DataFrame]:
    stored = candles(spark, sf)
    done = stored.filter(F.col("symbol").isin("click", "5-LOW"))
    pairs = requested_pairs(spark, sf)
    return pairs, rs.pending_pairs(pairs, done, stored)


@query("pending_pairs", ctes(CANDLES, MARKET_PAIRS, DONE, PENDING) + "select * from pend")
def _(spark, sf):
    return pending(spark, sf)[1]


@query("skipped_pairs", ctes(CANDLES, MARKET_PAIRS, DONE, PENDING) + """select (select count(*) from mp) as n_pairs,
       (select count(*) from pend) as n_pending, (select count(*) from mp) - (select count(*) from pend) as n_skipped""")
def _(spark, sf):
    return rs.count_skipped(*pending(spark, sf))


@query("tf_seconds", """with t as (select l_linenumber || case l_returnflag when 'A' then 'm' when 'N' then 'h' else case l_linestatus when 'O' then 'd' else 'w' end end as tf,
       count(*) as n from lineitem group by 1)
       select tf, cast(tf[:-2] as bigint) * case tf[-1] when 'm' then 60 when 'h' then 3600 when 'd' then 86400 else 604800 end as seconds, n from t""")
def _(spark, sf):
    unit = (
        F.when(F.col("l_returnflag") == "A", "m")
        .when(F.col("l_returnflag") == "N", "h")
        .when(F.col("l_linestatus") == "O", "d")
        .otherwise("w")
    )
    tfs = table(spark, sf, "lineitem").groupBy(
        F.concat(F.col("l_linenumber").cast("string"), unit).alias("tf")
    ).agg(F.count("*").alias("n"))
    return tfs.select("tf", tf_seconds(F.col("tf")).alias("seconds"), "n")
