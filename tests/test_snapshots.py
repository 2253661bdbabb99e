"""Versions of stored tables: what readers see when a writer dies."""

import os
import shutil

import pytest
from pyspark.sql import functions as F, types as T

from bandwalk.sources import candles as cd, snapshots
from bandwalk.streaming.ingest import stream_candles, upsert_batch
from tests.test_sources import candle, frame

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("m", T.IntegerType()), T.StructField("v", T.LongType())])
BY = ["k", "m"]


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(spark, path, **options):
    return sorted(map(tuple, snapshots.read(spark, path, SCHEMA, BY, **options).collect()))


def test_versions_replace_whole_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert content(spark, path) == [] and not snapshots.exists(spark, path)
    first = snapshots.commit(rows(spark, ("007", 1, 1), ("007", 1, 2), ("b", 2, 3)), path, BY, "v")
    snapshots.commit(rows(spark, ("007", 1, 9), ("c d/e", 1, 4)), path, BY)
    want = [("007", 1, 9), ("b", 2, 3), ("c d/e", 1, 4)]
    assert content(spark, path) == want
    assert content(spark, path, version=first) == [("007", 1, 1), ("007", 1, 2), ("b", 2, 3)]
    assert sorted(map(tuple, snapshots.read(spark, path, SCHEMA, BY, F.col("k") == "b").collect())) == [("b", 2, 3)]
    snapshots.commit(rows(spark), path, BY)  # nothing to change
    assert content(spark, path) == want
    kinds = T.StructType([SCHEMA["k"], SCHEMA["m"]])
    assert snapshots.vacuum(spark, path, kinds, keep=3) == 1  # the folder without rows
    assert content(spark, path, version=first) == [("007", 1, 1), ("007", 1, 2), ("b", 2, 3)]
    for n in range(3):
        snapshots.commit(rows(spark, ("b", 2, n)), path, BY)
    assert snapshots.vacuum(spark, path, kinds, keep=1) == 3
    assert content(spark, path) == [("007", 1, 9), ("b", 2, 2), ("c d/e", 1, 4)]
    assert len(snapshots.versions(spark, path)) == 1


class Lost(Exception):
    pass


@pytest.mark.parametrize("point", ["before the files", "between files and version", "inside the version"])
def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch, point):
    path = str(tmp_path / "store")
    cd.write_candles(frame(spark, [candle(0, 1), candle(1, 2), candle(0, 3, "ETH")]), path)
    before = sorted(map(tuple, cd.read_candles(spark, path).collect()))
    batch = frame(spark, [candle(1, 5), candle(2, 6), candle(3, 7, "SOL")])
    with monkeypatch.context() as patch:
        if point == "before the files":
            patch.setattr(cd.snapshots, "commit", lambda *a: (_ for _ in ()).throw(Lost()))
        elif point == "between files and version":
            patch.setattr(cd.snapshots, "listing", lambda *a: (_ for _ in ()).throw(Lost()))
        if point != "inside the version":
            with pytest.raises(Lost):
                cd.write_candles(batch, path)
    if point == "inside the version":  # the folder is there, but Spark did not finish it
        whole = shutil.copytree(path, str(tmp_path / "other"))
        cd.write_candles(batch, whole)
        name = snapshots.versions(spark, whole)[-1]
        shutil.copytree(f"{whole}/versions/{name}", f"{path}/versions/{name}")
        os.remove(f"{path}/versions/{name}/_SUCCESS")
    assert sorted(map(tuple, cd.read_candles(spark, path).collect())) == before
    # the batch is replayed by a new driver
    write = upsert_batch(path, latest_wins=True)
    for _ in range(2):  # a batch that was committed may come again
        write(batch, 1)
        got = {(r.symbol, r.date): r.close for r in cd.read_candles(spark, path).collect()}
        assert len(got) == 5 and sorted(got.values()) == [1.0, 3.0, 5.0, 6.0, 7.0]


def test_a_stream_goes_on_after_a_lost_batch(spark, tmp_path, monkeypatch):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    frame(spark, [candle(0, 1), candle(1, 2)]).write.parquet(source)
    stream_candles(spark, source, store, state).awaitTermination()
    frame(spark, [candle(1, 9), candle(2, 3)]).write.mode("append").parquet(source)
    with monkeypatch.context() as patch:
        patch.setattr(cd.snapshots, "listing", lambda *a: (_ for _ in ()).throw(Lost()))
        with pytest.raises(Exception):
            stream_candles(spark, source, store, state).awaitTermination()
    assert sorted(r.close for r in cd.read_candles(spark, store).collect()) == [1.0, 2.0]
    stream_candles(spark, source, store, state).awaitTermination()
    assert sorted(r.close for r in cd.read_candles(spark, store).collect()) == [1.0, 2.0, 3.0]


def test_repeats_without_an_order_of_arrival(spark):
    old, new = frame(spark, [candle(0, 1)]), frame(spark, [candle(1, 4), candle(1, 3), candle(1, 5)])
    for latest, want in ((False, 3.0), (True, 5.0)):
        for parts in (1, 3):
            got = cd.upsert_candles(old, new.repartition(parts), latest).filter("close > 1").collect()
            assert [r.close for r in got] == [want]
