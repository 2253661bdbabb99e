"""Fill-in-the-middle by rotating blocks in place.

Two token cuts part a text into prefix, middle and suffix. The text lies in a bytearray,
sentinels are inserted at the cuts, and segments change places by reversing each of two
neighbouring blocks and then both together (three-reversal rotation). The inverse rotation
and the removal of the sentinels give the text back exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from bandwalk.llm.texts import raw, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


@dataclass(frozen=True)
class Forms:
    """``plain_from``: hundredths of documents that are rearranged; ``spm_below``: hundredths of those with the suffix first."""

    seed: int = 1
    plain_from: int = 90
    spm_below: int = 20


class Tokens:
    """Runs of A-Z, a-z and other single code points of a slice, as byte positions."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        letter, self.lead = LETTER[data], (data & 0xC0) != 0x80
        first = self.lead.copy()
        first[1:] &= ~(letter[1:] & letter[:-1])
        opens = bounds[:-1][bounds[:-1] < bounds[1:]]
        first[opens] = True
        self.start, self.bounds = np.flatnonzero(first), bounds
        self.of = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.of)
        self.chars = np.concatenate([[0], np.cumsum(self.lead)])

    def position(self, k: np.ndarray) -> np.ndarray:
        """Byte at which token k[i] of text i begins; its end for k[i] = count[i]."""
        ends = k == self.count
        at = np.append(self.start, 0)[np.where(ends, len(self.start), self.of[:-1] + k)]
        return np.where(ends, self.bounds[1:], at)


def draws(seed: int, doc_ids: list) -> np.ndarray:
    """h1 to h4 of every id: the first four 32-bit words of sha256 of ``seed:id``; a null id counts as empty."""
    digests = (hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in doc_ids)
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def flip(view: np.ndarray, a: int, b: int) -> None:
    """Reverse view[a:b] in place."""
    half = (b - a) // 2
    head, tail = view[a : a + half], view[b - half : b][::-1]
    kept = head.copy()
    head[:] = tail
    tail[:] = kept


def rotate(buffer: bytearray, a: int, m: int, b: int) -> None:
    """buffer[a:m] and buffer[m:b] change places by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    flip(view, a, m)
    flip(view, m, b)
    flip(view, a, b)


def arranged(text: bytes, low: int, high: int, form: str) -> bytearray:
    """The text with its middle text[low:high] moved behind the suffix, and sentinels."""
    buffer = bytearray(text)
    if form == "plain":
        return buffer
    buffer[high:high] = SUFFIX
    buffer[low:low] = MIDDLE
    buffer[0:0] = PREFIX
    # now <P>prefix<M>middle<S>suffix
    suffix = high + len(PREFIX) + len(MIDDLE)
    rotate(buffer, low + len(PREFIX) if form == "psm" else 0, suffix, len(buffer))
    return buffer


def rebuilt(output: bytes, form: str) -> bytearray:
    """The text that ``arranged`` was given. It holds no sentinel, so the first of each kind is the inserted one."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    middle = buffer.find(MIDDLE)
    if form == "psm":
        low = buffer.find(SUFFIX)
        rotate(buffer, low, middle, len(buffer))
        suffix, middle = low + len(buffer) - middle, low
    else:
        turn = buffer.find(PREFIX)
        rotate(buffer, 0, turn, len(buffer))
        suffix, middle = len(buffer) - turn, middle - turn
    # again <P>prefix<M>middle<S>suffix
    del buffer[suffix : suffix + len(SUFFIX)]
    del buffer[middle : middle + len(MIDDLE)]
    del buffer[: len(PREFIX)]
    return buffer


def _strings(texts: list[bytearray]) -> pa.Array:
    bounds = np.cumsum([0, *map(len, texts)])
    data = pa.py_buffer(b"".join(texts))
    if bounds[-1] < 2**31:
        return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(bounds.astype(np.int32)), data])
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(bounds), data]).cast(pa.string())


def fill_in_middle(docs: DataFrame, forms: Forms = Forms(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of ``docs``; one pass, no shuffle.

    Cuts and form hang on a hash of the id alone, so reruns agree. ``n`` counts tokens
    (``[A-Za-z]+|[^A-Za-z]``), lengths are code points and null for the form ``plain``.

    Null and empty texts, and texts that hold a sentinel, stay plain (null becomes empty).
    Long texts are cut whole. A null id is hashed as an empty one; rows with equal ids get
    the same draws. Every input row gives one row, an empty table none. Other columns are
    ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, bounds = raw(part.column("text"))
            tokens, h = Tokens(data, bounds), draws(forms.seed, part.column("doc_id").to_pylist())
            cuts = np.sort(h[:, :2] % (tokens.count + 1)[:, None], axis=1)
            low, high = tokens.position(cuts[:, 0]), tokens.position(cuts[:, 1])
            form = np.where(h[:, 2] % 100 >= forms.plain_from, "plain", np.where(h[:, 3] % 100 < forms.spm_below, "spm", "psm"))
            whole = data.tobytes()
            outputs = []
            for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                text = whole[a:b]
                if not text or PREFIX in text or SUFFIX in text or MIDDLE in text:
                    form[i] = "plain"
                outputs.append(arranged(text, int(low[i]) - a, int(high[i]) - a, form[i]))
            plain = form == "plain"
            chars = tokens.chars
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(tokens.count), pa.array(form.tolist(), pa.string()),
                 pa.array(chars[low] - chars[bounds[:-1]], mask=plain), pa.array(chars[high] - chars[low], mask=plain),
                 _strings(outputs)],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(made: DataFrame, output_col: str = "output", form_col: str = "form", out: str = "restored") -> DataFrame:
    """``made`` with the column ``out``: the text that each output was made of.

    Rows come from ``fill_in_middle`` or hold such outputs and forms; a null output or form
    gives null. A column of the name ``out`` is replaced.
    """
    made = made.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, output_col):
            form = part.column(form_col).to_pylist()
            data, bounds = raw(part.column(output_col))
            whole = data.tobytes()
            missing = np.array([f is None for f in form]) | part.column(output_col).is_null().to_numpy(zero_copy_only=False)
            texts = [bytearray() if gone else rebuilt(whole[a:b], f)
                     for gone, f, a, b in zip(missing, form, bounds.tolist(), bounds[1:].tolist())]
            column = _strings(texts)
            if missing.any():
                column = pa.compute.if_else(pa.array(missing), pa.scalar(None, pa.string()), column)
            yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, out])

    return made.mapInArrow(run, T.StructType([*made.schema.fields, T.StructField(out, T.StringType())]))
