"""Exact top-k against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwalk.llm import topk


def brute_force(rows, chosen, k):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in usable if chosen(i)}:
        v = next(v for i, v in usable if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("chunk,shard,tile", [(2048, 16384, 4096), (7, 40, 5)])
def test_matches_brute_force(spark, monkeypatch, chunk, shard, tile):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "QUERY_TILE", tile)
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(300)]  # many ties
    rows += [(400, None), (401, []), (402, [1.0, None] * 3), (403, [float("nan")] * 6), (404, [float("inf")] * 6),
             (None, [1.0] * 6), (410, [1.0, 2.0]), (420, [0.5, 1.0]), (430, [0.1] * 6)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    out = topk.top_k(topk.quantised(frame), F.col("vec_id") % 10 == 0, 4)
    assert sorted(map(tuple, out.collect())) == brute_force(rows, lambda i: i % 10 == 0, 4)


def test_a_repeated_query_id_is_asked_by_its_smallest_vector(spark):
    rows = [(0, [3.0]), (0, [-2.0]), (0, [1.0]), (1, [1.0]), (2, [-1.0])]
    for parts in (1, 4):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
        out = topk.top_k(topk.quantised(frame), F.col("vec_id") == 0, 1).collect()
        assert [(r.query_id, r.vec_id, r.score) for r in out] == [(0, 2, 2 * 1024 * 1024)]


def test_repeated_ids_and_few_rows(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [-3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = topk.top_k(topk.quantised(frame), F.col("vec_id") == 0, 10).collect()
    assert sorted((r.rank, r.vec_id) for r in out) == [(1, 1), (2, 1), (3, 2)]
    assert topk.top_k(topk.quantised(frame.limit(0)), F.col("vec_id") == 0, 10).count() == 0
    assert topk.top_k(topk.quantised(frame), F.col("vec_id") == 9, 10).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**10, 3.0]), (2, [2.0**10, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.top_k(topk.quantised(frame), F.col("vec_id") == 0, 2).collect()
    assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank)] == [
        (2, 2**60 + 4 * 2**20), (1, 2**60 + 3 * 2**20)]
