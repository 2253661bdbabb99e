"""Ranking a whole frame without gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bandwalk.session import settled


def ranked(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in the total order ``order``.

    Rows are range partitioned by the order, numbered inside their partition, and
    shifted by the row counts of the partitions before it (one row per partition).
    """
    parts = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        parts.join(offsets, "_part")
        .withColumn(out, (F.col("_offset") + F.row_number().over(inside)).cast("bigint"))
        .drop("_part", "_offset")
    )
