"""Ordered folds over bars with a state and a step of the user's own.

A fold is what no window expression states: every bar changes a state that the next bar sees. A
fold that can merge the states of neighbouring stretches runs block by block in parallel and
its states are merged in order, ``FAN`` at a time. Any other fold streams through each series
batch by batch, so memory is bounded by a batch and the state, but one series is one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from bandwalk.defaults import BLOCK_BARS
from bandwalk.operators.series import KEYS

FAN = 256  # neighbouring states merged by one task


@dataclass(frozen=True)
class Fold:
    """``start()`` is the state before any bar, ``step(state, bars)`` the state after an Arrow table of bars in order.

    States are dictionaries with the fields of ``schema``. ``merge(a, b)``, if given, is the state after
    the bars of ``a`` followed by those of ``b``, when ``b`` began from ``start()``.
    """

    schema: str
    start: Callable[[], dict]
    step: Callable[[dict, pa.Table], dict]
    merge: Callable[[dict, dict], dict] | None = None


def fold_bars(
    series: DataFrame, fold: Fold, columns: Sequence[str] = ("open", "high", "low", "close"),
    keys: Sequence[str] = KEYS, block_bars: int = BLOCK_BARS,
) -> DataFrame:
    """(key, state fields) per series with ``pos``; the step sees ``pos`` and ``columns`` of each bar.

    Bars are taken in the order of ``pos``. Null keys are a series like any other. An empty frame gives no rows.
    """
    keys = list(keys)
    fields = T.StructType.fromDDL(fold.schema).fields
    narrow = series.select(*keys, F.col("pos").cast("bigint").alias("pos"), *columns)
    out = T.StructType([narrow.schema[k] for k in keys] + fields)
    if fold.merge is None:
        return _streamed(narrow, fold, out, keys)
    return _merged(narrow, fold, out, keys, block_bars)


def _table(rows: list[tuple[tuple, dict]], keys: list[str], names: list[str], like: pa.Schema) -> pa.RecordBatch:
    columns = [[k[i] for k, _ in rows] for i in range(len(keys))] + [[s[n] for _, s in rows] for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, like)], schema=like)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _streamed(narrow: DataFrame, fold: Fold, out: T.StructType, keys: list[str]) -> DataFrame:
    like, names = _arrow(out), out.fieldNames()[len(keys):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            ended = []
            of = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            cuts = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1]), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if state is None or of[a] != key:
                    if state is not None:
                        ended.append((key, state))
                    key, state = of[a], fold.start()
                state = fold.step(state, pa.Table.from_batches([batch.slice(a, b - a)]).drop_columns(keys))
            yield _table(ended, keys, names, like)
        if state is not None:
            yield _table([(key, state)], keys, names, like)

    return narrow.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(run, out)


def _merged(narrow: DataFrame, fold: Fold, out: T.StructType, keys: list[str], block_bars: int) -> DataFrame:
    kept = T.StructType([*out.fields[: len(keys)], T.StructField("_blk", T.LongType()), *out.fields[len(keys):]])
    like, names = _arrow(kept), out.fieldNames()[len(keys):]

    # no type hints: Spark would read the kind of function from them
    def stepped(key, bars):
        state = fold.step(fold.start(), bars.sort_by("pos").drop_columns([*keys, "_blk"]))
        return pa.Table.from_batches([_table([(tuple(k.as_py() for k in key), state)], [*keys, "_blk"], names, like)])

    def joined(key, states):
        rows = states.sort_by("_blk").select(names).to_pylist()
        state = rows[0]
        for later in rows[1:]:
            state = fold.merge(state, later)
        return pa.Table.from_batches([_table([(tuple(k.as_py() for k in key), state)], [*keys, "_blk"], names, like)])

    blocked = narrow.withColumn("_blk", F.floor(F.col("pos") / block_bars))
    last = blocked.agg(F.max("_blk")).first()[0] or 0
    states = blocked.groupBy(*keys, "_blk").applyInArrow(stepped, kept)
    while True:
        last //= FAN
        states = states.withColumn("_blk", F.floor(F.col("_blk") / FAN)).groupBy(*keys, "_blk").applyInArrow(joined, kept)
        if last == 0:
            return states.drop("_blk")
