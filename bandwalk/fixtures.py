"""Input frames derived from the star-schema tables (see FIXTURES.md).

Every frame is an aggregate of a whole table, so its cost grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BAR_SECONDS_1H = 3_600
BAR_SECONDS_1D = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ohlc(df: DataFrame, price, order: str) -> DataFrame:
    return (
        df.withColumn("_px", price)
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("_px", order).alias("open"),
            F.max("_px").alias("high"),
            F.min("_px").alias("low"),
            F.max_by("_px", order).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
    )


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles per event type."""
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        "value",
        "event_id",
    )
    return _ohlc(ticks, F.lit(100) + F.col("value") / 50, "event_id")


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles per order priority."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        "o_totalprice",
        "o_orderkey",
    )
    return _ohlc(orders, F.lit(100) + F.col("o_totalprice") / 100000, "o_orderkey")


def wf_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward result rows: one Sharpe per symbol, split, set and combination."""
    cents = F.round(F.col("l_discount") * 100).cast("bigint") - F.round(F.col("l_tax") * 100).cast(
        "bigint"
    )
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("symbol"),
            (F.col("l_suppkey") % 10).cast("int").alias("split"),
            F.when(F.col("l_linestatus") == "O", "train").otherwise("test").alias("set_name"),
            (20 + 20 * (F.col("l_partkey") % 5)).cast("int").alias("ma_window"),
            (10 + 20 * (F.col("l_orderkey") % 3)).cast("int").alias("atr_window"),
            (2 + F.col("l_linenumber") % 4).cast("int").alias("mult_x2"),
            (2 + 2 * (F.col("l_partkey") % 2)).cast("int").alias("sl_pct"),
        )
        .agg(F.count("*").alias("_n"), F.sum(cents).cast("double").alias("_s"))
        .withColumn("sharpe", F.when(F.col("_n") % 17 != 0, F.col("_s") / F.col("_n")))
        .drop("_n", "_s")
    )


def trials(spark: SparkSession, sf_dir: str, by: tuple | list = ()) -> DataFrame:
    """Trial log: one score per window and sampled combination (and per ``by`` column)."""
    score = F.when(F.col("l_quantity") < 10, F.lit(-999.0)).otherwise(
        F.round(F.col("l_discount") * 100).cast("bigint") / F.lit(10.0)
    )
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            *by,
            (F.col("l_suppkey") % 10 + 1).cast("int").alias("window_id"),
            (10 + 5 * (F.col("l_partkey") % 99)).cast("int").alias("ma_window"),
            (5 + 5 * (F.col("l_orderkey") % 20)).cast("int").alias("atr_window"),
            (2 + (F.col("l_linenumber") * 5 + F.col("l_partkey")) % 39).cast("int").alias("mult_x4"),
            (1 + F.col("l_orderkey") % 15).cast("int").alias("sl_pct"),
        )
        .agg(F.max(score).alias("score"))
    )


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-book levels: (market_id, side, lvl, price, size)."""
    from pyspark.sql import Window

    # After the aggregate a (market, side) group has at most 50 rows.
    ranked = Window.partitionBy("market_id", "side").orderBy("_off")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            (F.col("l_suppkey") % 20).cast("int").alias("market_id"),
            F.when(F.col("l_linestatus") == "O", "ask").otherwise("bid").alias("side"),
            F.col("l_quantity").cast("int").alias("_off"),
        )
        .agg(F.count("*").cast("double").alias("size"))
        .select(
            "market_id",
            "side",
            F.row_number().over(ranked).alias("lvl"),
            F.when(F.col("side") == "ask", 100 + F.col("_off") / F.lit(20.0))
            .otherwise(100 - F.col("_off") / F.lit(20.0))
            .alias("price"),
            "size",
        )
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market list with activity figures."""
    slot = F.col("s_suppkey") % 20
    cents = F.round(F.col("s_acctbal") * 100)
    return (
        table(spark, sf_dir, "supplier")
        .groupBy(slot.cast("int").alias("market_id"))
        .agg(
            F.min("s_name").alias("symbol"),
            F.sum(cents).cast("bigint").cast("double").alias("_vol"),
            F.count("*").alias("trades_24h"),
            F.max(cents).cast("bigint").cast("double").alias("_oi"),
        )
        .select(
            "market_id",
            "symbol",
            F.when(F.col("market_id") < 15, "perp").otherwise("spot").alias("market_type"),
            F.when(F.col("market_id").isin(3, 17), "inactive").otherwise("active").alias("status"),
            F.when(F.col("market_id") != 5, F.col("_vol")).alias("volume_24h"),
            "trades_24h",
            F.when(F.col("market_id") != 6, F.col("_oi")).alias("open_interest"),
        )
    )
