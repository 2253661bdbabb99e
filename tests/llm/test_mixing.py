"""Capped water-filling and repetitions."""

import re
from collections import Counter, defaultdict

import pytest

from bandwalk.llm import mixing
from bandwalk.llm.mixing import mix, repeated


def fill(sizes, weights=(1, 2, 3), most=3):
    """Clamp what is above its cap and share the rest again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in full}
        left = sum(sizes.values()) - sum(full.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s in share if share[s] > most * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = most * sizes[s]


def check(spark, rows, extra=""):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string, size int").repartition(4)
    out = mix(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t, *_) in enumerate(rows)}
    sizes = defaultdict(int)
    for i, r in enumerate(rows):
        sizes[r[2]] += size[i]
    target = fill(sizes) if sum(sizes.values()) else {s: 0 for s in sizes}
    assert Counter((r.doc_id, r.size, r.source_size) for r in out) == Counter((r[0], size[i], sizes[r[2]]) for i, r in enumerate(rows))
    taken, longest = defaultdict(int), defaultdict(int)
    for r in out:
        source = r.row.source
        assert r.target == pytest.approx(target[source], abs=1e-6)
        assert r.taken == r.size * r.copies <= 3 * r.size
        taken[source] += r.taken
        longest[source] = max(longest[source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6
    again = mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.copies)
    assert [key(r) for r in sorted(again, key=key)] == [key(r) for r in sorted(out, key=key)]
    kept = repeated(mix(docs))
    assert kept.columns == docs.columns and kept.count() == sum(r.copies for r in out)


@pytest.mark.parametrize("sent", [100_000, 0])
def test_hot_and_small_sources(spark, monkeypatch, sent):
    monkeypatch.setattr(mixing, "MOST_SENT", sent)
    rows = [(i, "w " * (i % 50 + 1), "hot" if i % 3 == 0 else f"s{i % 11}", "t", 1) for i in range(900)]
    rows += [(1000 + i, "tiny text", "zz", "t", 1) for i in range(3)] + [(2000 + i, "null source", None, "t", 1) for i in range(20)]
    check(spark, rows)


def test_edges(spark):
    check(spark, [(1, None, "a", "t", 1), (2, "", "a", "t", 1), (3, "x y\tz\n", "b", "t", 1)])
    check(spark, [(1, None, "a", "t", 1), (None, " ", None, "t", 1)])
    check(spark, [(None, "a b", "a", "t", 1), (5, "a b", "a", "t", 1), (5, "a b", "a", "t", 1), (5, "a b c", "b", "t", 1), (6, "q " * 5000, "b", "t", 1)])
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(docs).count() == 0


def test_levels_with_many_caps(spark):
    check(spark, [(100 * s + i, "w " * (s * s + 1), f"src{s:02d}", "t", 1) for s in range(12) for i in range(4)])
