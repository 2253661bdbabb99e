"""Tables whose content changes by whole versions.

Every write puts its files into a new folder below ``data`` and then lists, in a new folder below
``versions``, which folder holds each partition. The listing counts once Spark has
put ``_SUCCESS`` there, its last act of a write. Nothing is removed or moved, so a reader
sees one whole version at any time, and a driver lost at any point leaves the version before. What
no recent version lists is removed later by ``vacuum``. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

FOLDER = "folder"


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, so any store that Spark reaches will do, and the path for it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed versions, oldest first. A store has as many as were written since the last ``vacuum``."""
    fs, where = _files(spark, f"{path}/versions/*/_SUCCESS")
    found = fs.globStatus(where)
    return sorted(status.getPath().getParent().getName() for status in found or [])


def exists(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path))


def listing(spark: SparkSession, path: str, by: T.StructType, version: str | None = None) -> DataFrame:
    """(``by``, folder) of each partition of a version, by default the last."""
    schema = T.StructType([*by.fields, T.StructField(FOLDER, T.StringType())])
    if version is None:
        known = versions(spark, path)
        if not known:
            return spark.createDataFrame([], schema)
        version = known[-1]
    return spark.read.schema(schema).parquet(f"{path}/versions/{version}")


def commit(rows: DataFrame, path: str, by: Sequence[str], *order: str) -> str:
    """Make ``rows`` the content of the partitions that they touch; other partitions stay. Returns the version's name.

    ``by`` must not be null. Files are sorted by ``by`` and ``order``. Without rows the version says the same as the last.
    """
    spark, by = rows.sparkSession, list(by)
    folder = uuid.uuid4().hex
    kinds = T.StructType([rows.schema[c] for c in by])
    known = versions(spark, path)
    data = f"{path}/data/{FOLDER}={folder}"
    rows.repartition(*by).sortWithinPartitions(*by, *order).write.partitionBy(*by).parquet(data)
    fresh = spark.read.schema(rows.schema).parquet(data).select(*by).distinct().withColumn(FOLDER, F.lit(folder))
    kept = listing(spark, path, kinds).join(fresh.select(*[F.col(c).alias(c) for c in by]), by, "left_anti")
    number = int(known[-1].split("-")[0]) + 1 if known else 0
    name = f"{number:012d}-{uuid.uuid4().hex}"
    kept.unionByName(fresh).coalesce(1).write.parquet(f"{path}/versions/{name}")
    return name


def read(spark: SparkSession, path: str, schema: T.StructType, by: Sequence[str], *where: Column, version: str | None = None) -> DataFrame:
    """Rows of one version, by default the last. Conditions on ``by`` prune the listing and the files.

    Files of folders that the version does not list for a partition are pruned when the query runs.
    """
    kinds = T.StructType([schema[c] for c in by])
    live = listing(spark, path, kinds, version)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    kept = T.StructType([f for f in schema.fields if f.name not in by] + [T.StructField(FOLDER, T.StringType())] + kinds.fields)
    files = spark.read.schema(kept).parquet(f"{path}/data")
    for condition in where:
        live, files = live.filter(condition), files.filter(condition)
    return files.join(live, [FOLDER, *by], "left_semi").select(*schema.fieldNames())


def vacuum(spark: SparkSession, path: str, by: T.StructType, keep: int = 2) -> int:
    """Remove all but the last ``keep`` versions and the folders that none of those lists; returns the folders removed.

    Not to be run beside a writer. The driver holds the names of folders, one per write since the last time.
    """
    known = versions(spark, path)
    kept = known[-keep:]
    live = {r[0] for v in kept for r in listing(spark, path, by, v).select(FOLDER).distinct().collect()}
    fs, root = _files(spark, f"{path}/versions/*")
    for status in fs.globStatus(root) or []:
        if status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)
    fs, root = _files(spark, f"{path}/data/{FOLDER}=*")
    gone = [s.getPath() for s in fs.globStatus(root) or [] if s.getPath().getName().split("=", 1)[1] not in live]
    for where in gone:
        fs.delete(where, True)
    return len(gone)
