"""Candle tables: reading, listing, upserting, reply parsing and backfill planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from bandwalk.defaults import DEFAULTS
from bandwalk.functions.scalars import tf_seconds
from bandwalk.operators.series import PRICES
from bandwalk.sources import snapshots

PAIR = ("exchange", "tf", "symbol")

CANDLES = T.StructType(
    [T.StructField("date", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)

# Fixed format of a candle reply: code and c[] of t, o, h, l, c, v.
REPLY = "struct<code:int,c:array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double>>>"


def with_ts(df: DataFrame) -> DataFrame:
    """Add ``ts`` (UTC) from ``date`` in epoch milliseconds, whatever the session's time zone."""
    return df.withColumn("ts", _utc("date"))


def _utc(column: str) -> Column:
    return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {column} / 1000)")


def clean(df: DataFrame) -> DataFrame:
    """NaN never enters: it becomes NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def _lacking() -> Column:
    """Names of the prices that are missing (NULL or NaN)."""
    return F.filter(
        F.array(
            *[
                F.when(F.col(p).isNull() | F.isnan(F.col(p).cast("double")), F.lit(p))
                for p in PRICES
            ]
        ),
        lambda p: p.isNotNull(),
    )


def is_complete() -> Column:
    return F.size(_lacking()) == 0


def complete(candles: DataFrame) -> DataFrame:
    """Candles with all four prices.

    A bar with a missing price takes no part in any series: means skip it, it trades
    nothing and marks nothing, as if the exchange had not sent it.
    """
    return candles.filter(is_complete())


def incomplete(candles: DataFrame) -> DataFrame:
    """The candles that ``complete`` drops, with the names of the missing prices."""
    return candles.withColumn("missing", F.array_join(_lacking(), ",")).filter("missing <> ''")


def _alternatives(names: Sequence[str] | None) -> str:
    return "*" if names is None else "{" + ",".join(names) + "}"


def read_candle_files(
    spark: SparkSession, root: str, exchanges: Sequence[str] | None = None,
    tfs: Sequence[str] | None = None, symbols: Sequence[str] | None = None,
) -> DataFrame:
    """Candles from ``root/<exchange>/<tf>/<symbol>.csv``.

    The filters become path patterns, so other files are never opened. Columns are found by
    their header names; a missing one, or files whose headers differ, are errors. No
    matching file gives an empty frame.
    """
    pattern = f"{root}/{_alternatives(exchanges)}/{_alternatives(tfs)}/{_alternatives(symbols)}.csv"
    try:
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(pattern)
    except AnalysisException as error:  # raised when the frame is made, before any job
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType(
            [T.StructField(k, T.StringType()) for k in PAIR] + CANDLES.fields
            + [T.StructField("ts", T.TimestampNTZType())]
        ))
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = raw.select(
        F.element_at(parts, -3).alias("exchange"),
        F.element_at(parts, -2).alias("tf"),
        F.regexp_replace(F.element_at(parts, -1), r"\.csv$", "").alias("symbol"),
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in CANDLES.fields],
    )
    return with_ts(clean(named))


PERIOD = "period"  # calendar month, so an update rewrites months and not histories
STORED = T.StructType(
    [T.StructField(k, T.StringType()) for k in PAIR] + CANDLES.fields + [T.StructField(PERIOD, T.IntegerType())]
)


def with_period(candles: DataFrame) -> DataFrame:
    stamp = _utc("date")
    return candles.withColumn(PERIOD, F.year(stamp) * 100 + F.month(stamp))


def write_candles(candles: DataFrame, path: str) -> None:
    """Store candles by pair and month as a new version; months that are not touched stay as they are."""
    rows = with_period(candles.select(*PAIR, *CANDLES.fieldNames()))
    snapshots.commit(rows, path, [*PAIR, PERIOD], "date")


def read_candles(
    spark: SparkSession, path: str, exchanges: Sequence[str] | None = None,
    tfs: Sequence[str] | None = None, symbols: Sequence[str] | None = None,
    keep_period: bool = False,
) -> DataFrame:
    """Candles of the store's last version, none if it has no version; the filters prune partitions."""
    wanted = [F.col(name).isin(list(names)) for name, names in zip(PAIR, (exchanges, tfs, symbols)) if names is not None]
    df = snapshots.read(spark, path, STORED, [*PAIR, PERIOD], *wanted)
    extra = [PERIOD] if keep_period else []
    return with_ts(df).select(*PAIR, *CANDLES.fieldNames(), "ts", *extra)


def list_pairs(
    candles: DataFrame, exchanges: Sequence[str] | None = None, tfs: Sequence[str] | None = None
) -> DataFrame:
    """Every pair that has candles under the given exchanges and timeframes."""
    df = candles
    if exchanges is not None:
        df = df.filter(F.col("exchange").isin(list(exchanges)))
    if tfs is not None:
        df = df.filter(F.col("tf").isin(list(tfs)))
    return df.select(*PAIR).distinct()


def select_pairs(
    candles: DataFrame, exchanges: Sequence[str], tfs: Sequence[str], symbols: Sequence[str]
) -> DataFrame:
    """The requested exchange x timeframe x symbol combinations that have candles.

    Keeping what matches all three lists is the product semi-joined with the data.
    """
    return list_pairs(candles, exchanges, tfs).filter(F.col("symbol").isin(list(symbols)))


def time_slice(df: DataFrame, start, end, column: str = "ts") -> DataFrame:
    """Rows between two times, both ends included."""
    return df.filter(F.col(column).between(start, end))


def upsert_candles(
    existing: DataFrame, fresh: DataFrame, latest_wins: bool = False,
    keys: Sequence[str] = PAIR, arrival: str | None = None,
) -> DataFrame:
    """One row per (key, date). Stored rows win over new ones unless ``latest_wins``.

    Among new rows the first (last) by the column ``arrival`` wins. Without one they have no order of
    their own, so the smallest (largest) values win and a rerun gives the same rows. ``min_by``
    combines map-side, so a candle repeated many times costs one row per task, not a sorted group.
    """
    def tagged(df: DataFrame, source: int) -> DataFrame:
        seq = F.col(arrival) if arrival and arrival in df.columns else F.lit(0)
        return df.withColumns({"_src": F.lit(source), "_seq": seq.cast("bigint")})

    both = tagged(existing, 0).unionByName(tagged(fresh, 1), allowMissingColumns=True)
    values = [c for c in both.columns if c not in (*keys, "date", "_src", "_seq", arrival)]
    pick = F.max_by if latest_wins else F.min_by
    return (
        both.groupBy(*keys, "date")
        .agg(pick(F.struct(*values), F.struct("_src", "_seq", *values)).alias("_v"))
        .select(*keys, "date", "_v.*")
    )


def parse_candle_reply(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Rows of the candle replies whose code is 200."""
    others = [c for c in replies.columns if c != column]
    return (
        replies.withColumn("_r", F.from_json(column, REPLY))
        .filter(F.col("_r.code") == 200)
        .select(*others, F.explode("_r.c").alias("_c"))
        .select(
            *others,
            F.col("_c.t").alias("date"),
            F.col("_c.o").alias("open"),
            F.col("_c.h").alias("high"),
            F.col("_c.l").alias("low"),
            F.col("_c.c").alias("close"),
            F.col("_c.v").alias("volume"),
        )
    )


def normalise_frame(df: DataFrame, index: str = "date") -> DataFrame:
    """Lower-case the column names and turn the time index into epoch milliseconds."""
    lowered = df.toDF(*[c.lower() for c in df.columns])
    return lowered.withColumn(index, F.unix_millis(F.col(index).cast("timestamp")))


def plan_backfill(
    markets: DataFrame, candles: DataFrame, default_start: int, end: int | Column,
    tf: str | None = None, chunk_bars: int = DEFAULTS.candles_per_request,
    keys: Sequence[str] = PAIR,
) -> DataFrame:
    """Missing ranges per market, cut into request-sized chunks (epoch seconds).

    A market resumes one bar after its last candle; one that is up to date is dropped.
    """
    keys = list(keys)
    step = tf_seconds(F.col("tf") if tf is None else F.lit(tf))
    end = F.lit(end) if isinstance(end, int) else end
    last = candles.groupBy(*keys).agg(F.max("date").alias("_last"))
    return (
        markets.select(*keys)
        .join(last, keys, "left")
        .withColumn("_step", step)
        .withColumn(
            "_from",
            F.coalesce(F.floor(F.col("_last") / 1000) + F.col("_step"), F.lit(default_start)),
        )
        .withColumn("_to", end.cast("bigint"))
        .filter(F.col("_from") < F.col("_to"))
        .withColumn("_span", F.col("_step") * chunk_bars)
        .select(
            *keys,
            "_to",
            "_span",
            F.posexplode(F.sequence(F.col("_from"), F.col("_to") - 1, F.col("_span"))).alias(
                "chunk", "start_s"
            ),
        )
        .select(
            *keys, "chunk", "start_s", F.least(F.col("start_s") + F.col("_span"), "_to").alias("end_s")
        )
    )
