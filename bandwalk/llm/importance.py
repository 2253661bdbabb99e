"""Importance resampling towards a target distribution of hashed n-grams.

Per slice of texts, Arrow lower-cases (``ascii_lower``), splits (``split_pattern_regex``),
flattens (``list_flatten``) and encodes words (``dictionary_encode``). Shifted dictionary
indices make n-grams, each distinct one is hashed once by CRC-32, and counts and gains per
document are taken by bucket and reduced by text. Documents are drawn without replacement
by the largest weight plus seeded Gumbel noise.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from bandwalk.llm.texts import slices
from bandwalk.operators.ranking import ranked
from bandwalk.session import settled

# what stands between words: ASCII other than digits and letters
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Resampling:
    """``orders``: longest n-gram; ``percent`` of the texts with ``min_words`` or more are drawn."""

    orders: int = 2
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 25
    seed: int = 7
    scale: int = 1000


def hashed_grams(texts: pa.Array, cfg: Resampling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram of a slice, repeats included, and the words of each text."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), SEPARATORS)
    words, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    filled = pc.not_equal(words, "")  # a text that begins or ends with a separator
    coded = words.filter(filled).dictionary_encode()
    text, code = owner.filter(filled).to_numpy(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    vocabulary = coded.dictionary.cast(pa.binary()).to_pylist()
    crc = np.fromiter(map(zlib.crc32, vocabulary), np.int64, len(vocabulary))
    gram, last = code, code
    texts_of, buckets = [text], [crc[gram] % cfg.buckets]
    for n in range(2, cfg.orders + 1):
        # the gram that begins at a word, longer by the word n - 1 places on, inside one text
        inside = text[: len(text) - n + 1] == text[n - 1 :]
        longer = gram[: len(text) - n + 1] * max(1, len(vocabulary)) + last[n - 1 :]
        pairs = pa.array(longer[inside]).dictionary_encode()
        head, word = np.divmod(pairs.dictionary.to_numpy(), max(1, len(vocabulary)))
        spaced = [zlib.crc32(b" ", c) for c in crc.tolist()]
        crc = np.fromiter((zlib.crc32(vocabulary[w], spaced[h]) for h, w in zip(head.tolist(), word.tolist())), np.int64, len(head))
        index = pairs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        gram = np.zeros(len(inside), np.int64)
        gram[inside] = index
        texts_of.append(text[: len(inside)][inside])
        buckets.append(crc[index] % cfg.buckets)
    return np.concatenate(texts_of), np.concatenate(buckets), np.bincount(text, minlength=len(texts))


def bucket_counts(texts: DataFrame, cfg: Resampling, text_col: str) -> DataFrame:
    """(bucket, n): n-grams per bucket over all texts; each task sends its sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cfg.buckets, np.int64)
        for part in slices(batches, "text"):
            total += np.bincount(hashed_grams(part.column("text"), cfg)[1], minlength=cfg.buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), pa.array(total[there])], ["bucket", "n"])

    narrow = texts.select(F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, cfg: Resampling) -> np.ndarray:
    """floor(scale * ln of the smoothed target share over the source share) per bucket.

    The driver reads one row per bucket and table, whatever the data.
    """
    s, t = np.zeros(cfg.buckets), np.zeros(cfg.buckets)
    for counts, out in ((source, s), (target, t)):
        for r in counts.collect():
            out[r.bucket] = r.n
    share = (t + 1) * (s.sum() + cfg.buckets) / ((s + 1) * (t.sum() + cfg.buckets))
    return np.array([math.floor(cfg.scale * math.log(x)) for x in share], np.int64)


def noise(seed: int, doc_id, scale: int) -> int:
    """Seeded Gumbel noise of an id, in whole numbers; a null id counts as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, cfg: Resampling, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score): weight is the floored mean gain of a text's n-grams, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n = part.num_rows
            text, bucket, words = hashed_grams(part.column("text"), cfg)
            order = np.argsort(text, kind="stable")
            features = np.bincount(text, minlength=n)
            some = np.flatnonzero(features)
            total = np.zeros(n, np.int64)
            total[some] = np.add.reduceat(gain[bucket[order]], (np.cumsum(features) - features)[some]) if len(some) else 0
            weight = total // np.maximum(features, 1)
            drawn = np.array([noise(cfg.seed, i, cfg.scale) for i in part.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(pa.array, (words, features, weight, weight + drawn))],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(docs: DataFrame, target: DataFrame, cfg: Resampling = Resampling(), id_col: str = "doc_id",
             text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): ``docs`` drawn to look like ``target``.

    Texts are read twice: for the counts of the whole table, then for the weights. ``rank``
    is the place of a drawn document (largest score first, then smallest id, null ids first,
    then fewest n-grams and smallest weight), null if it was not drawn.

    Null and empty texts have no n-grams and weight 0 and are not drawn. Long texts are read
    whole. A null id is hashed as an empty one. Rows that repeat an id take part one by one;
    rows equal in all of these columns get neighbouring ranks. Every input row gives one row,
    so an empty table gives none; an empty target leaves the smoothed source alone. Other
    columns are ignored.
    """
    gain = gains(bucket_counts(docs, cfg, text_col), bucket_counts(target, cfg, target_text_col), cfg)
    scored = settled(weighed(docs, gain, cfg, id_col, text_col))
    able = scored.filter(F.col("n_words") >= cfg.min_words)
    drawn = able.count() * cfg.percent // 100
    order = [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")]
    placed = ranked(able, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < cfg.min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return placed.unionByName(rest)
