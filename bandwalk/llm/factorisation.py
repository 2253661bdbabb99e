"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bandwalk.llm.texts import SPACE, Words, mix, slices

STATISTICS = 24


@dataclass(frozen=True)
class Machine:
    """``fit_rows`` bounds the labelled rows that the fit uses (the first by a hash of their ids)."""

    fit_rows: int = 12_000
    buckets: int = 1 << 16
    rank: int = 8
    epochs: int = 12
    batch: int = 64
    rate: float = 0.05
    decay: float = 1e-5
    seed: int = 7


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 on division by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(texts: pa.Array, n_chars: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, index, value): sparse rows. Statistics come first (indices below STATISTICS), then hashed words.

    ``n_chars`` is the recorded length, NaN if there is none.
    """
    words = Words(texts)
    data, bounds, n = words.data, words.bounds, len(texts)
    count = words.count.astype(np.float64)
    size = np.maximum(np.diff(bounds), 1).astype(np.float64)
    one = np.maximum(count, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)

    def per_word(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[words.of[1:]] - total[words.of[:-1]]).astype(np.float64)

    kind = np.zeros(256, np.uint8)
    kind[65:91], kind[48:58] = 1, 2
    kind[[ord(c) for c in "#*$%&|<>=~^{}[]"]] = 3
    kind[[ord(c) for c in "!?"]] = 4
    kind[[ord(c) for c in ".,;:"]] = 5
    kinds = kind[data]
    length = (words.end - words.start).astype(np.float64)
    last = kinds[words.end - 1] if len(length) else np.zeros(0, np.uint8)
    hashes = words.hashes()
    key = mix(hashes ^ mix(words.text.astype(np.uint64)))
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(key))).astype(np.float64)
    word, owner = hashes[order[first]], words.text[order[first]]
    distinct = np.bincount(owner, minlength=n).astype(np.float64)
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    again = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        again[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    # pairs of words, to see loops that are longer than a word
    pair = mix(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) > 1 else np.zeros(0, np.uint64)
    same = words.text[:-1] == words.text[1:] if len(hashes) > 1 else np.zeros(0, bool)
    pair_key = np.unique(mix(pair[same] ^ mix(words.text[:-1][same].astype(np.uint64))), return_index=True)[1]
    pairs = np.bincount(words.text[:-1][same][pair_key], minlength=n) if len(pair_key) else np.zeros(n)
    lines = share(data == 10) + 1
    upper = share(kinds == 1)
    alpha = np.maximum(share((kinds == 1) | ((data >= 97) & (data < 123)) | (data > 127)), 1)
    chars = share((data & 0xC0) != 0x80)
    known = ~np.isnan(n_chars)
    off = np.where(known, np.abs(np.log1p(np.nan_to_num(n_chars).clip(0)) - np.log1p(chars)), 0)
    stats = np.stack([
        share(kinds == 3) / size * 4, np.sqrt(share(kinds == 3) / size), upper / alpha, share(kinds == 2) / size,
        share(kinds == 4) / one, share(kinds == 5) / one, per_word(last == 3) / one, per_word(last == 4) / one,
        per_word(last == 5) / one, per_word((length == 1) & (last == 3)) / one, 1 - distinct / one, top / one,
        per_word(again) / one, 1 - pairs / np.maximum(count - 1, 1), np.minimum(lines / one, 1), np.log1p(count) / 8,
        np.log1p(count / lines) / 5, np.bincount(words.text, weights=length, minlength=n) / one / 10,
        share(SPACE[data]) / size, share(data > 127) / size, (count == 0) * 1.0, (count < 20) * 1.0,
        known * 1.0, np.minimum(off, 3),
    ], axis=1)
    value = 1 + np.log(times)
    norm = np.sqrt(np.maximum(np.bincount(owner, weights=value**2, minlength=n), 1e-9))
    value = value / norm[owner]
    index = STATISTICS + (word % np.uint64(buckets)).astype(np.int64)
    by_owner = np.argsort(owner, kind="stable")
    owner, index, value = owner[by_owner], index[by_owner], value[by_owner]
    own = np.bincount(owner, minlength=n)
    out = np.concatenate([[0], np.cumsum(own + STATISTICS)])
    all_index, all_value = np.empty(out[-1], np.int64), np.empty(out[-1], np.float32)
    at = out[:-1][:, None] + np.arange(STATISTICS)
    all_index[at], all_value[at] = np.arange(STATISTICS), stats
    rest = np.ones(out[-1], bool)
    rest[at.ravel()] = False
    all_index[rest], all_value[rest] = index, value
    return out, all_index, all_value


def scores(model: dict, bounds: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Linear part plus pairwise part, the latter as half of (square of sums - sum of squares)."""
    x = value[:, None] * model["v"][index]
    first = np.add.reduceat(value * model["w"][index], bounds[:-1])
    summed = np.add.reduceat(x, bounds[:-1], axis=0)
    squares = np.add.reduceat((x * x).sum(1), bounds[:-1])
    z = model["b"] + first + 0.5 * ((summed**2).sum(1) - squares)
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], cfg: Machine) -> dict:
    """AdaGrad on the logistic loss over mini-batches; classes weigh the same in total."""
    rng = np.random.default_rng(cfg.seed)
    size = STATISTICS + cfg.buckets
    w, v = np.zeros(size, np.float32), rng.normal(0, 0.01, (size, cfg.rank)).astype(np.float32)
    model = {"b": 0.0, "w": w, "v": v}
    if not rows:
        return model
    y = np.array([r[2] for r in rows], np.float64)
    ones = y.sum()
    weight = np.where(y == 1, len(y) / max(2 * ones, 1), len(y) / max(2 * (len(y) - ones), 1))
    gw, gv, gb = np.full(size, 1e-6, np.float32), np.full((size, cfg.rank), 1e-6, np.float32), 1e-6
    for _ in range(cfg.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), cfg.batch):
            chosen = order[at : at + cfg.batch]
            index = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen])
            length = np.array([len(rows[i][0]) for i in chosen])
            bounds = np.concatenate([[0], np.cumsum(length)])
            p = scores(model, bounds, index, value)
            slope = ((p - y[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            each = np.repeat(slope, length)
            x = value[:, None] * v[index]
            summed = np.repeat(np.add.reduceat(x, bounds[:-1], axis=0), length, axis=0)
            there, inverse = np.unique(index, return_inverse=True)
            dw = np.bincount(inverse, weights=each * value, minlength=len(there)).astype(np.float32) + cfg.decay * w[there]
            part = (each * value)[:, None] * (summed - x)
            dv = np.stack([np.bincount(inverse, weights=part[:, j], minlength=len(there)) for j in range(cfg.rank)], 1).astype(np.float32)
            dv += cfg.decay * v[there]
            gw[there] += dw**2
            gv[there] += dv**2
            w[there] -= cfg.rate * dw / np.sqrt(gw[there])
            v[there] -= cfg.rate * dv / np.sqrt(gv[there])
            gb += float(slope.sum()) ** 2
            model["b"] -= cfg.rate * float(slope.sum()) / np.sqrt(gb)
    return model


def _narrow(docs: DataFrame, id_col: str, text_col: str, chars_col: str | None, *more: Column) -> DataFrame:
    chars = F.col(chars_col).cast("double") if chars_col and chars_col in docs.columns else F.lit(None).cast("double")
    return docs.select(*more, F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), chars.alias("n_chars"))


def _of(part: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    chars = part.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64)
    return features(part.column("text"), chars, buckets)


def train(docs: DataFrame, labels: DataFrame, cfg: Machine = Machine(), id_col: str = "doc_id", text_col: str = "text",
          chars_col: str | None = "n_chars", label_col: str = "quality") -> dict:
    """A model from at most ``fit_rows`` labelled rows that are not held out.

    The rows are the first in order of a hash of their ids, so the choice is the same in
    every run. Ids with labels of both kinds, null ids and null labels are left out.
    Features are made where the texts are; one task fits the bounded sample and returns
    the weights (2.4 MB, whatever the data). Without any labelled row every score is 0.5.
    """
    usable = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .filter("doc_id is not null and y in (0, 1)").filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other")
    )
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.fit_rows).select(F.col("doc_id").alias("chosen"), "y")
    rows = _narrow(docs, id_col, text_col, chars_col)
    sample = rows.join(chosen, rows["doc_id"] == chosen["chosen"]).dropDuplicates(["chosen"]).select("chosen", "y", "text", "n_chars")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            bounds, index, value = _of(part, cfg.buckets)
            yield pa.RecordBatch.from_arrays(
                [part.column("chosen"), part.column("y"), pa.array([index[a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:])]),
                 pa.array([value[a:b].astype("<f4").tobytes() for a, b in zip(bounds, bounds[1:])])],
                ["chosen", "y", "index", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: r["chosen"])
        model = fit([(np.frombuffer(r["index"], "<i4"), np.frombuffer(r["value"], "<f4"), r["y"]) for r in rows], cfg)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    kind = sample.schema["chosen"].dataType.simpleString()
    made = sample.mapInArrow(sparse, f"chosen {kind}, y int, index binary, value binary")
    model = made.repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(model[0]) if model else fit([], cfg)


def score(docs: DataFrame, model: dict, cfg: Machine = Machine(), id_col: str = "doc_id", text_col: str = "text",
          chars_col: str | None = "n_chars") -> DataFrame:
    """(row, doc_id, held_out, score, predicted) per row of ``docs``; ``row`` is the row itself.

    The score is the model's probability of label 1. One pass, no shuffle; the work per text
    is linear in its distinct words. Null and empty texts are scored by their statistics. Ids
    may be null (never held out) or repeated. A missing ``chars_col`` counts as unknown. Long texts
    are read whole, an empty table gives no rows, and columns of ``docs`` cannot clash inside ``row``.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            bounds, index, value = _of(part, cfg.buckets)
            p = scores(weights.value, bounds, index, value)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(p)], ["row", "score"])

    narrow = _narrow(docs, id_col, text_col, chars_col, F.struct("*").alias("row"))
    schema = narrow.select("row").schema.add("score", "double")
    scored = narrow.select("row", "text", "n_chars").mapInArrow(run, schema)
    doc_id = F.col("row").getField(id_col)
    return scored.select("row", doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scored_ids(docs: DataFrame, model: dict, cfg: Machine = Machine(), id_col: str = "doc_id", text_col: str = "text",
               chars_col: str | None = "n_chars") -> DataFrame:
    """``score`` without the rows: only ids come back from the workers; other columns are ignored."""
    chars = [chars_col] if chars_col and chars_col in docs.columns else []
    narrow = docs.select(id_col, text_col, *chars)
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            p = scores(weights.value, *_of(part, cfg.buckets))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    rows = _narrow(narrow, id_col, text_col, chars_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
