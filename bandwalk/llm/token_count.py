"""Token counts by rank-synchronous array merging (see ``bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bandwalk.llm.bpe import Encoder, Merger
from bandwalk.llm.texts import raw, slices


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_col: str | Column = "doc_id",
                 text_col: str | Column = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file of the ``tokenizers`` library; it
    is read on the driver and its tables (a few MB, whatever the data) are broadcast.
    Counts are those of the library without added tokens, truncation or padding; special
    strings inside a text count one token each. One pass, no shuffle.

    Null and empty texts have 0 bytes and 0 tokens. Long texts are encoded whole. Ids may
    be null or repeated: every input row gives one row, an empty table none. Other columns are ignored.
    """
    tables = docs.sparkSession.sparkContext.broadcast(Merger(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for part in slices(batches, "text"):
            encoder = encoder or Encoder(tables.value)
            texts = part.column("text")
            tokens = encoder.counts(texts)
            _, bounds = raw(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(_col(id_col).alias("doc_id"), _col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
