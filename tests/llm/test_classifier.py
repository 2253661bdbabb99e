"""Factorisation machine: identity, gradient, held-out accuracy, edges."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bandwalk.llm.factorisation import STATISTICS, Machine, features, fit, held_out, score, scored_ids, scores, train

SF = "/root/testdata/sf0.1"


def test_pairwise_identity():
    rng = np.random.default_rng(1)
    size, k = 30, 4
    model = {"b": 0.3, "w": rng.normal(size=size), "v": rng.normal(size=(size, k))}
    index, value = np.array([1, 5, 7, 2, 29]), rng.normal(size=5)
    z = model["b"] + value @ model["w"][index]
    z += sum(model["v"][index[i]] @ model["v"][index[j]] * value[i] * value[j] for i in range(3) for j in range(i))
    z3 = model["b"] + value[:3] @ model["w"][index[:3]]
    z3 += sum(model["v"][index[i]] @ model["v"][index[j]] * value[i] * value[j] for i in range(3) for j in range(i))
    got = scores(model, np.array([0, 3, 5]), index, value)
    assert abs(got[0] - 1 / (1 + np.exp(-z3))) < 1e-9


def test_fits_an_interaction():
    """Neither feature alone tells the label; their product does."""
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(800):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([a, 2 + b], np.int32), np.ones(2, np.float32), float(a == b)))
    model = fit(rows, Machine(epochs=30, buckets=8))
    p = [scores(model, np.array([0, 2]), i, v)[0] for i, v, _ in rows]
    assert np.mean((np.array(p) > 0.5) == np.array([r[2] for r in rows])) > 0.95


def test_features_do_not_depend_on_neighbours():
    texts = ["a b a b", None, "Some Text | here!!\nline " * 20, "", "é" * 500, "x"]
    n = np.array([7, np.nan, 3, 0, 500, 1])
    bounds, index, value = features(pa.array(texts), n, 1024)
    for i, t in enumerate(texts):
        b, x, v = features(pa.array([t], pa.string()), n[i : i + 1], 1024)
        one = dict(zip(x[STATISTICS:].tolist(), v[STATISTICS:].tolist()))
        at = slice(bounds[i], bounds[i + 1])
        assert np.allclose(value[at][:STATISTICS], v[:STATISTICS])
        assert one == dict(zip(index[at][STATISTICS:].tolist(), value[at][STATISTICS:].tolist()))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    cfg = Machine(fit_rows=1500)
    model = train(docs, labels, cfg)
    out = scored_ids(docs, model, cfg).join(labels, "doc_id").filter("held_out")
    row = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert row[1] > 1000 and row[0] > 0.98


def test_edges(spark):
    rows = [(1, "good text here", None, "x"), (None, None, None, "x"), (2, "", 5, "x"), (2, "bad", 5, "x"), (2, "bad", 5, "x"), (3, "w " * 100000, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = train(docs, labels, Machine(epochs=2))
    out = score(docs, model)
    assert out.columns == ["row", "doc_id", "held_out", "score", "predicted"] and out.count() == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.collect())
    assert out.select("row.*").columns == docs.columns
    none = train(docs, labels.limit(0), Machine())
    assert {round(r.score, 2) for r in score(docs.select("doc_id", "text"), none).collect()} == {0.5}
    assert score(docs.limit(0), model).count() == 0
    import zlib

    got = {r.doc_id: r.h for r in docs.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, 2, 3)} | {None: False}
