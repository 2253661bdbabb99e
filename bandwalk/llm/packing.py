"""Concatenate and cut: token sequences of fixed length from prefix sums of partition totals."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from bandwalk.llm.bpe import Encoder, Merger
from bandwalk.llm.texts import slices
from bandwalk.session import shared_folder


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, part, at, n, ids): each text's ids with ``end_id``, and where they begin in their partition.

    ``ids`` are little-endian unsigned 32-bit numbers. The frame is written once to the
    shared folder: a partition's numbering is whatever the task that committed it saw.
    """
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(Merger(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = None, TaskContext.get().partitionId(), 0
        for rows in slices(batches, "text"):
            encoder = encoder or Encoder(tables.value)
            ids, bounds = encoder.ids(rows.column("text"))
            n = rows.num_rows
            flat = np.insert(ids.astype("<u4"), bounds[1:], end_id)
            bounds = bounds + np.arange(n + 1)
            size = np.diff(bounds)
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(flat)]) \
                if bounds[-1] * 4 < 2**31 else pa.array([flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(at + bounds[:-1]), pa.array(size), packed],
                ["doc_id", "part", "at", "n", "ids"],
            )
            at += int(bounds[-1])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    out = narrow.mapInArrow(run, f"doc_id {kind}, part int, at bigint, n bigint, ids binary")
    path = f"{shared_folder(spark)}/bandwalk-{uuid.uuid4().hex}"
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def pack(docs: DataFrame, vocabulary: str, end_id: int, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the concatenation of all documents cut every ``length`` tokens.

    Pass one tokenises and counts per partition; a running sum over one row per partition
    gives every partition its offset in the whole, and pass two cuts each document at the
    multiples of ``length`` without moving any ids. Only the last sequence is short.

    Returns doc_id, start, length, ids (binary, as in ``tokenised``), doc_tokens,
    sequence_id and offset, one row per piece. Null and empty texts are one ``end_id``.
    A text longer than ``length`` spans several sequences. Ids may be null or repeated:
    pieces of equal rows differ in their place. An empty table gives no rows. Other
    columns are ignored.
    """
    rows = tokenised(docs, vocabulary, end_id, id_col, text_col)
    # one row per partition of the input, whatever the number of documents: the number of
    # tasks bounds the broadcast (16 bytes each, 16 MB for a million tasks)
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(before, F.lit(0)).alias("base"))
    placed = rows.join(F.broadcast(offsets), "part").withColumn("g", F.col("base") + F.col("at"))
    cut = f"""transform(sequence(g div {length}, (g + n - 1) div {length}), s -> named_struct(
        'start', greatest(0L, s * {length} - g),
        'length', least(n, (s + 1) * {length} - g) - greatest(0L, s * {length} - g),
        'ids', substring(ids, cast(4 * greatest(0L, s * {length} - g) + 1 as int),
                         cast(4 * (least(n, (s + 1) * {length} - g) - greatest(0L, s * {length} - g)) as int)),
        'sequence_id', s,
        'offset', greatest(0L, g - s * {length})))"""
    return placed.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.expr(cut)).alias("p")).select(
        "doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset"
    )
