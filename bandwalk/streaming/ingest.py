"""Incremental candle ingest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from bandwalk.session import settled
from bandwalk.sources.candles import (
    CANDLES,
    PAIR,
    PERIOD,
    read_candles,
    upsert_candles,
    with_period,
    with_ts,
    write_candles,
)


def candle_stream(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    """Arriving candle files (Parquet with pair columns) as a stream with ``ts``."""
    schema = "exchange string, tf string, symbol string, date bigint, " + ", ".join(
        f"{c} double" for c in CANDLES.fieldNames()[1:]
    )
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return with_ts(raw)


def deduplicated(stream: DataFrame, delay: str, keys: Sequence[str] = PAIR) -> DataFrame:
    """Drop repeats of a candle inside the watermark, with bounded state.

    Rows later than ``delay`` are lost to the watermark, so this suits a live feed that
    is never late by more; ``stream_candles`` leaves it off unless a delay is given.
    """
    timed = stream.withColumn("event_time", F.col("ts").cast("timestamp"))
    return (
        timed.withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark([*keys, "date"])
        .drop("event_time")
    )


def upsert_batch(store: str, latest_wins: bool = False) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: merge a batch into the touched months of the store.

    A batch becomes one version of the store (``sources.snapshots``). A driver lost before that leaves
    the version before; the replayed batch starts from it, or changes nothing if it was there already.
    """

    def write(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        fresh = settled(batch.drop("ts"))
        if fresh.isEmpty():
            return
        # Months that the batch does not touch are neither read nor rewritten.
        month = [*PAIR, PERIOD]
        touched = with_period(fresh).select(*[F.col(k).alias(k) for k in month]).distinct()
        stored = read_candles(spark, store, keep_period=True).join(touched, month, "left_semi").drop("ts", PERIOD)
        write_candles(upsert_candles(stored, fresh, latest_wins), store)

    return write


def stream_candles(
    spark: SparkSession, source: str, store: str, checkpoint: str, delay: str | None = None,
    latest_wins: bool = False,
) -> StreamingQuery:
    """Ingest everything that has arrived at ``source`` into ``store``, then stop.

    The upsert removes repeats however late they are; ``delay`` adds an early filter.
    """
    stream = candle_stream(spark, source)
    if delay is not None:
        stream = deduplicated(stream, delay)
    return (
        stream.writeStream.foreachBatch(upsert_batch(store, latest_wins))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
