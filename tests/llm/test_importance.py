"""Importance resampling against a plain Python version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from bandwalk.llm.importance import Resampling, hashed_grams, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, orders=2):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, cfg):
    count = lambda texts: Counter(zlib.crc32(g.encode()) % cfg.buckets for t in texts for g in grams(t, cfg.orders)[1])
    s, t = count(x for _, x in docs), count(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(cfg.scale * math.log((t[b] + 1) * (S + cfg.buckets) / ((s[b] + 1) * (T + cfg.buckets)))) for b in range(cfg.buckets)]
    rows = []
    for i, text in docs:
        words, g = grams(text, cfg.orders)
        weight = sum(gain[zlib.crc32(x.encode()) % cfg.buckets] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{cfg.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(g), weight, weight + math.floor(-cfg.scale * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= cfg.min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for n, r in enumerate(able[: len(able) * cfg.percent // 100]):
        r[5] = n + 1
    return sorted(map(tuple, rows), key=str)


def test_matches_plain_python(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["Alpha", "beta", "ÉTÉ", "straße", "日本", "x1", "GAMMA-ray", "it's", "z", "\x00nul"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(300)]
    docs += [(None, "null id " * 15), (7, "again seven " * 12), (7, "again seven " * 12), (301, None), (302, ""), (303, "  ...  "),
             (304, "long text with many words " * 20_000)]
    target = ["alpha beta beta", None, "", "straße z z z 日本"]
    frame = spark.createDataFrame([(*d, 1, "a") for d in docs], "doc_id long, text string, rank int, bucket string").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for cfg in (Resampling(), Resampling(orders=3, buckets=50, min_words=5, percent=60, seed=1, scale=100)):
        out = resample(frame, goal, cfg)
        assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, out.collect()), key=str) == plain(docs, target, cfg)
    # the target may be empty, and so may the documents
    assert sorted(map(tuple, resample(frame, goal.limit(0)).collect()), key=str) == plain(docs, [], Resampling())
    assert resample(frame.limit(0), goal).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB1 -é日\n\x00"), max_size=12)), min_size=1, max_size=5), st.integers(1, 4))
def test_grams_of_any_text(texts, orders):
    cfg = Resampling(orders=orders, buckets=1000)
    text, bucket, words = hashed_grams(pa.array(texts, pa.string()), cfg)
    want = [(i, zlib.crc32(g.encode()) % 1000) for i, t in enumerate(texts) for g in grams(t, orders)[1]]
    assert sorted(zip(text.tolist(), bucket.tolist())) == sorted(want)
    assert words.tolist() == [len(grams(t)[0]) for t in texts]
