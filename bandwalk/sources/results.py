"""Stored walk-forward results and what is still to compute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bandwalk.sources import snapshots
from bandwalk.sources.candles import PAIR


STORED_BY = ("scan_id", *PAIR)


def write_results(results: DataFrame, path: str, scan_id: str) -> None:
    """Store results by scan and pair as a new version; rerunning a pair replaces only that pair.

    A writer that dies leaves the version before, so a pair is stored as a whole or not at all.
    """
    snapshots.commit(results.withColumn("scan_id", F.lit(scan_id)), path, STORED_BY, "split")


def read_results(
    spark: SparkSession, path: str, scan_id: str | None = None,
    symbols: Sequence[str] | None = None,
) -> DataFrame:
    """Results of one or all scans in the store's last version; both filters prune partitions.

    Identity columns are text: a symbol ``007`` stays what it is.
    """
    found = spark.read.parquet(f"{path}/data").schema
    kept = [f for f in found.fields if f.name not in (snapshots.FOLDER, *STORED_BY)]
    names = [T.StructField(n, T.StringType()) for n in STORED_BY]
    wanted = []
    if scan_id is not None:
        wanted.append(F.col("scan_id") == scan_id)
    if symbols is not None:
        wanted.append(F.col("symbol").isin(list(symbols)))
    return snapshots.read(spark, path, T.StructType(kept + names), STORED_BY, *wanted)


def parse_result_name(
    names: DataFrame, column: str = "name", prefix: str = "", suffix: str = ".pickle"
) -> DataFrame:
    """Pair identity from ``<prefix><pair>_<tf>_<exchange><suffix>``; other names are dropped."""
    bare = F.replace(F.col(column), F.lit(suffix), F.lit(""))
    if prefix:
        bare = F.replace(bare, F.lit(prefix), F.lit(""))
    parts = F.split(bare, "_")
    return (
        names.withColumn("_p", parts)
        .filter(F.size("_p") == 3)
        .withColumns(
            {
                "symbol": F.element_at("_p", 1),
                "tf": F.element_at("_p", 2),
                "exchange": F.element_at("_p", 3),
            }
        )
        .drop("_p")
    )


def pending_pairs(
    pairs: DataFrame, results: DataFrame, candles: DataFrame, keys: Sequence[str] = PAIR
) -> DataFrame:
    """Requested pairs without a result that do have candles."""
    keys = list(keys)
    return pairs.join(results.select(*keys).distinct(), keys, "left_anti").join(
        candles.select(*keys).distinct(), keys, "left_semi"
    )


def count_skipped(pairs: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: pairs requested, to run and skipped."""
    todo = pending.agg(F.count("*").alias("n")).scalar()
    return pairs.agg(F.count("*").alias("n_pairs")).select(
        "n_pairs", todo.alias("n_pending"), (F.col("n_pairs") - todo).alias("n_skipped")
    )
