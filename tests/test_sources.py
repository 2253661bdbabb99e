import datetime as dt
import os
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest

from bandwalk.operators.params import param_grid
from bandwalk.operators.series import with_position
from bandwalk.plans.walkforward import scan, scan_skipped
from bandwalk.sources import candles as cd
from bandwalk.sources import results as rs
from bandwalk.streaming.ingest import candle_stream, deduplicated, stream_candles

SCHEMA = "exchange string, tf string, symbol string, date long, open double, high double, low double, close double, volume double"
HOUR = 3_600_000
T0 = 1_737_100_800_000  # 2025-01-17 08:00:00


def candle(i, close, symbol="BTC"):
    return ("x", "1h", symbol, T0 + i * HOUR, 1.0, 2.0, 0.5, float(close), 1.0)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_csv_files_by_layout(spark, tmp_path):
    for tf, symbol in (("1h", "BTC"), ("1h", "ETH"), ("5m", "BTC")):
        folder = tmp_path / "venue" / tf
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{symbol}.csv").write_text(f"date,open,high,low,close,volume\n{T0},1,2,0.5,NaN,3\n")
    got = cd.read_candle_files(spark, str(tmp_path), ["venue"], ["1h"])
    rows = got.collect()
    assert {(r["tf"], r["symbol"]) for r in rows} == {("1h", "BTC"), ("1h", "ETH")}
    assert rows[0]["ts"] == dt.datetime(2025, 1, 17, 8) and rows[0]["close"] is None
    none = cd.read_candle_files(spark, str(tmp_path), ["venue"], ["1d"])
    assert none.count() == 0 and none.schema == got.schema


def test_stored_candles_prune_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    cd.write_candles(frame(spark, [candle(0, 1), candle(1, 2), candle(0, 3, "ETH")]), path)
    got = cd.read_candles(spark, path, symbols=["BTC"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "symbol" in plan.split("PartitionFilters")[1][:200]
    assert got.count() == 2
    cd.write_candles(frame(spark, [candle(0, 9)]), path)  # replaces only this pair and month
    assert cd.read_candles(spark, path).count() == 2


@pytest.mark.parametrize("latest, want", [(False, {0: 1.0, 1: 2.0, 2: 5.0}), (True, {0: 1.0, 1: 4.0, 2: 6.0})])
def test_upsert(spark, latest, want):
    old = frame(spark, [candle(0, 1), candle(1, 2)])
    new = spark.createDataFrame(
        [(*candle(1, 4), 0), (*candle(2, 5), 1), (*candle(2, 6), 2)], SCHEMA + ", arrival int"
    )
    got = cd.upsert_candles(old, new, latest, arrival="arrival")
    assert {(r["date"] - T0) // HOUR: r["close"] for r in got.collect()} == want


@pytest.mark.parametrize("latest", [False, True])
def test_stream_equals_upsert_for_late_and_repeated_candles(spark, tmp_path, latest):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    batches = [
        [candle(5, 1), candle(6, 2)],
        [candle(6, 3), candle(7, 4)],
        [candle(-900, 5), candle(5, 6), candle(0, 7, "ETH")],  # weeks late: still kept
    ]
    expected = None
    for batch in batches:
        df = frame(spark, batch)
        df.write.mode("append").parquet(source)
        stream_candles(spark, source, store, str(tmp_path / "state"), latest_wins=latest).awaitTermination()
        expected = df if expected is None else cd.upsert_candles(expected, df, latest)
        got = cd.read_candles(spark, store).drop("ts")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.select(got.columns).collect()))


def test_watermarked_stream_drops_repeats(spark, tmp_path):
    source = str(tmp_path / "in")
    frame(spark, [candle(0, 1), candle(0, 1), candle(1, 2)]).coalesce(1).write.parquet(source)
    query = (
        deduplicated(candle_stream(spark, source), "2 hours")
        .writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("deduped").count() == 2


def test_replies_with_other_codes_are_dropped(spark):
    ok = '{"code":200,"c":[{"t":1,"o":1,"h":2,"l":0.5,"c":1.5,"v":9}]}'
    got = cd.parse_candle_reply(
        spark.createDataFrame([("a", ok), ("b", '{"code":429,"c":[]}'), ("c", "oops")], "symbol string, reply string")
    ).collect()
    assert [tuple(r) for r in got] == [("a", 1, 1.0, 2.0, 0.5, 1.5, 9.0)]


def test_backfill_chunks_cover_the_gap(spark):
    markets = frame(spark, [candle(0, 1), candle(0, 1, "NEW")]).select(*cd.PAIR)
    stored = frame(spark, [candle(0, 1), candle(1, 1)])
    start, end = T0 // 1000 - 3600 * 1200, T0 // 1000 + 3600 * 2
    got = cd.plan_backfill(markets, stored, start, end).toPandas()
    assert set(got["symbol"]) == {"NEW"}  # BTC resumes at `end` and is up to date
    got = got.sort_values("chunk")
    assert got["start_s"].iloc[0] == start and got["end_s"].iloc[-1] == end
    assert (got["start_s"].iloc[1:].to_numpy() == got["end_s"].iloc[:-1].to_numpy()).all()
    assert (got["end_s"] - got["start_s"]).max() == 500 * 3600 and len(got) == 3


def test_result_store_and_names(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = [("x", "1h", s, k, "train", 0.5) for s in ("BTC", "ETH") for k in range(3)]
    df = spark.createDataFrame(rows, "exchange string, tf string, symbol string, split int, set_name string, sharpe double")
    rs.write_results(df, path, "one")
    rs.write_results(df.filter("symbol = 'BTC' and split < 2"), path, "one")
    assert rs.read_results(spark, path).groupBy("symbol").count().orderBy("symbol").toPandas()["count"].tolist() == [2, 3]
    names = spark.createDataFrame([("run_BTC_1h_x.pickle",), ("run_BTC_1h.pickle",)], "name string")
    assert [r["symbol"] for r in rs.parse_result_name(names, prefix="run_").collect()] == ["BTC"]


def test_result_identity_stays_text(spark, tmp_path):
    df = spark.createDataFrame([("1", "1h", "007", 0, 0.5)], "exchange string, tf string, symbol string, split int, sharpe double")
    rs.write_results(df, str(tmp_path), "1")
    got = rs.read_results(spark, str(tmp_path), "1", ["007"]).first()
    assert (got["scan_id"], got["exchange"], got["symbol"]) == ("1", "1", "007")


def test_csv_columns_go_by_name(spark, tmp_path):
    folder = tmp_path / "venue" / "1h"
    folder.mkdir(parents=True)
    (folder / "BTC.csv").write_text(f"date,volume,open,high,low,close\n{T0},9,1,2,0.5,1.5\n{T0 + HOUR},,1,x,0.5,1.5\n")
    got = cd.read_candle_files(spark, str(tmp_path)).orderBy("date").collect()
    assert [got[0][c] for c in ("open", "high", "low", "close", "volume")] == [1, 2, 0.5, 1.5, 9]
    assert got[1]["volume"] is None and got[1]["high"] is None
    (folder / "BTC.csv").write_text("date,open,high,low,close\n1,1,1,1,1\n")
    with pytest.raises(Exception, match="volume"):
        cd.read_candle_files(spark, str(tmp_path)).collect()


def test_unknown_timeframes_are_errors(spark):
    pairs = frame(spark, [candle(0, 1), ("x", "1M", *candle(0, 1)[2:])])
    with pytest.raises(Exception, match="unknown timeframe 1M"):
        cd.plan_backfill(pairs.select(*cd.PAIR), pairs, 0, T0 // 1000 + 9 * 3600).collect()
    left = scan_skipped(cd.with_ts(pairs), None).collect()
    assert {r["tf"]: r["reason"] for r in left} == {"1h": "fewer than 13 bars for 10 windows", "1M": "unknown timeframe"}
    assert scan(cd.with_ts(pairs), None, param_grid(spark)).count() == 0


def test_missing_prices_are_reported_and_refused(spark):
    rows = [candle(0, 1), candle(1, float("nan")), ("x", "1h", "BTC", T0 + 2 * HOUR, None, 2.0, 0.5, None, 1.0)]
    candles = cd.with_ts(frame(spark, rows))
    assert cd.complete(candles).count() == 1
    assert sorted(r["missing"] for r in cd.incomplete(candles).collect()) == ["close", "open,close"]
    with pytest.raises(Exception, match="lacks its time"):
        with_position(candles, 3600, cd.PAIR).collect()


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from bandwalk.session import get_session
from bandwalk.operators.indicators import ema
spark = get_session("away", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
bars = spark.sql("select 's' as symbol, timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int)) as ts, "
                 "id as pos, 40L as len, cast(id as double) as close from range(40)")
assert ema(bars, 3, block_bars=8).count() == 40
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_pending_pairs(spark):
    have = frame(spark, [candle(0, 1), candle(0, 1, "ETH")])
    pairs = have.select(*cd.PAIR).unionByName(frame(spark, [candle(0, 1, "SOL")]).select(*cd.PAIR))
    done = frame(spark, [candle(0, 1)])
    left = rs.pending_pairs(pairs, done, have)
    assert [r["symbol"] for r in left.collect()] == ["ETH"]
    assert tuple(rs.count_skipped(pairs, left).first()) == (3, 1, 2)


def test_frame_normalisation(spark):
    pdf = pd.DataFrame({"Date": [pd.Timestamp("2025-01-17 08:00")], "Close": [1.0]})
    got = cd.normalise_frame(spark.createDataFrame(pdf, "Date timestamp_ntz, Close double")).first()
    assert got.asDict() == {"date": T0, "close": 1.0}
