"""SimHash components against all pairs, and the covering property of the anchors."""

import numpy as np
import pytest
import xxhash

from bandwalk.llm import simhash
from bandwalk.llm.queries import QUERIES
from bandwalk.llm.simhash import anchors, fingerprint_values, forest, links, near_components


def plain_fingerprint(text, words=3, seed=42):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    h = [xxhash.xxh64_intdigest(g, seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, threshold=2):
    """Smallest index reachable over pairs of at most ``threshold`` differing bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def noisy(rng, n, bits):
    """Random fingerprints, each followed by a chain of small changes."""
    out = []
    while len(out) < n:
        x = int(rng.integers(0, 2**63))
        for _ in range(rng.integers(1, 6)):
            out.append(x)
            for b in rng.choice(64, rng.integers(0, bits + 1), replace=False):
                x ^= 1 << int(b)
    return out[:n]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_every_near_pair_meets_at_a_home(threshold):
    rng = np.random.default_rng(threshold)
    a = rng.integers(-(2**63), 2**63, 300, dtype=np.int64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, threshold, replace=False):
            b[i] ^= np.int64(signed(1 << int(bit)))
    row, anchor, home = anchors(a, threshold)
    at = dict(zip(row[home].tolist(), anchor[home].tolist()))
    assert len(at) == home.sum() == len(a)  # one home each
    visited = set(zip(*(x.tolist() for x in anchors(b, threshold)[:2])))
    assert all((i, at[i]) in visited for i in range(len(a)))
    assert (simhash.syndromes(anchor & (2**23 - 1)) == 0).all() and (simhash.syndromes(anchor >> 23) == 0).all()


def test_links_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(5)
    dense = [int(x) for x in rng.integers(0, 2**9, 300)]  # one crowded anchor
    for name, values, block in (("chains", noisy(rng, 1500, 3), 1024), ("crowd", dense, 1024), ("crowd in small blocks", dense, 16)):
        values = sorted(set(values))
        frame = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(3)
        got = [(r.a, r.b) for r in links(frame, 2, block).collect()]
        assert all(a < b and ((a ^ b) % 2**64).bit_count() <= 2 for a, b in got), name
        place = {signed(v): i for i, v in enumerate(values)}
        root = list(range(len(values)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in got:
            x, y = sorted((find(place[a]), find(place[b])))
            root[y] = x
        assert [find(i) for i in range(len(values))] == plain_components(values), name


def test_forest_is_sparse():
    fps = np.arange(64, dtype=np.int64)
    assert len(forest(fps, fps, 2)) < 2 * len(fps)


def test_fingerprints_of_long_runs(monkeypatch):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2)
    bounds = np.array([0, 0, 3, 200, 200, 500])
    want = [sum(1 << b for b in range(64) if 2 * int(((h[i:j] >> np.uint64(b)) & np.uint64(1)).sum()) > j - i) for i, j in zip(bounds, bounds[1:])]
    for limit in (60_000, 7):
        monkeypatch.setattr(simhash, "LANE_LIMIT", limit)
        assert fingerprint_values(h, bounds).tolist() == want


def check(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, fp int, component string").repartition(3)
    out = near_components(frame, **options)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(fps)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = [(i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, root)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_components_of_texts(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old barn near a river bank at night".split()
    rows = [(i, " ".join(base[: 8 + i % 14])) for i in range(60)]
    rows += [(100 + i, " ".join(base * 40 + [f"w{i}"])) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (None, None), (None, "only null ids here"), (203, "One"), (204, "one"), (205, "ONE  "),
             (206, "Two words"), (206, "two WORDS"), (207, "éÉ straße É"), (208, "word " * 70_000)]
    check(spark, rows)
    check(spark, rows, block=4)
    check(spark, [(None, "all null")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_components(empty).count() == 0


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    want = {i: (f"{f:016x}", docs[r][0]) for (i, _), f, r in zip(docs, fps, plain_components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op13_simhash_components"].run(spark, sf).collect()} == want
