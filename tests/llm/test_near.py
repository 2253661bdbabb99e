"""Near-duplicate classes against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from bandwalk.llm.components import components
from bandwalk.llm.dart_minhash import Near, forests, near_classes, open_pairs, signatures


def weights(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def alike(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) * 1000 >= 800 * sum(max(a[k], b[k]) for k in keys)


def brute_force(rows):
    """Class (smallest id) per row index."""
    sets = [weights(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and alike(a, sets[j]):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [least[root(i)] for i in range(len(rows))]


def sample_rows():
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, at = [], 0

    def add(words):
        nonlocal at
        rows.append((at, " ".join(words)))
        at += 1

    base = text(150)
    for _ in range(120):  # one large group around a text, from very near to too far
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(150)] = rng.choice(vocabulary)
        add(copy)
    chain = text(80)  # each like the one before
    for _ in range(12):
        chain = list(chain)
        chain[rng.randrange(80)] = rng.choice(vocabulary)
        add(chain)
    passage = text(60)  # a passage that many share
    for _ in range(40):
        add(text(rng.randrange(5, 120)) + passage)
    for _ in range(80):
        add(text(rng.randrange(1, 60)))
    loop = ["spam", "ham"] * 200  # repeats count
    add(loop)
    add(loop[:-20])
    add(loop[:100])
    for words in ([], ["one"], ["one"], ["one", "two"], ["two", "one"], ["a", "b", "c", "d"], ["a", "b", "c", "d"]):
        add(words)
    rows += [(at, None), (at + 1, " \n\t "), (None, " ".join(base)), (None, "null id one"), (3, "repeated id"), (3, "repeated id"),
             (at + 2, "long " + " ".join(text(30000)))]
    rows.append((at + 3, rows[-1][1] + " tail"))
    return rows


def test_classes_match_brute_force(spark):
    rows = sample_rows()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, node int, key string").repartition(5)
    got = Counter((r.doc_id, r.class_id) for r in near_classes(docs).collect())
    want = Counter()
    for (i, t), c in zip(rows, brute_force(rows)):
        want[(i, c if weights(t) else i)] += 1
    assert got == want


def test_small_blocks_still_find_the_group(spark):
    """Buckets larger than a block are dealt anew per band, and members meet elsewhere."""
    rng = random.Random(1)
    base = ["w%d" % rng.randrange(5000) for _ in range(200)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in near_classes(docs, Near(block=16)).collect()} == {0}


def template_rows(n_pairs):
    """Texts of a template at similarities of about 0.78, among them pairs at about 0.82."""
    rng = random.Random(4)
    fixed = ["w%d" % rng.randrange(5000) for _ in range(280)]
    rows = []
    for i in range(n_pairs):
        own = [f"p{i}x{j}" for j in range(39)]
        near = own[:8] + [f"q{i}x{j}" for j in range(31)]
        rows += [(2 * i, " ".join(fixed + own)), (2 * i + 1, " ".join(fixed + near))]
    return rows


def test_true_links_among_many_that_are_nearly_alike(spark):
    rows = template_rows(100)
    sets = [weights(t) for _, t in rows[:3]]
    share = lambda a, b: sum((a & b).values()) / sum((a | b).values())
    assert share(sets[0], sets[1]) > 0.81 and 0.77 < share(sets[0], sets[2]) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_classes(docs).collect()}
    assert got == {i: i // 2 * 2 for i in range(200)}
    assert got == {r.doc_id: r.class_id for r in near_classes(docs, Near(exact_rows=7)).collect()}


def test_every_pair_of_a_huge_bucket_is_examined(spark):
    """One bucket of 60 rows in blocks of 4; each row is plausible with one other only."""
    rng = np.random.default_rng(6)
    sketch = np.repeat(rng.integers(0, 256, (30, 128), dtype=np.uint8), 2, axis=0)
    rows = [(b"%02d" % i, [7], sketch[i].tobytes()) for i in range(60)]
    nodes = spark.createDataFrame(rows, "node binary, bands array<bigint>, sketch binary")
    classes = spark.createDataFrame([], "node binary, component binary")
    got = open_pairs(nodes, classes, Near(block=4)).collect()
    assert sorted((int(r.a), int(r.b)) for r in got) == [(i, i + 1) for i in range(0, 60, 2)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_classes(docs).count() == 0
    wordless = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in near_classes(wordless).collect()) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8, 0.95])
def test_agreement_estimates_weighted_similarity(share):
    rng = np.random.default_rng(3)
    k, n = 2048, 400
    both = rng.integers(1, 2**62, n).astype(np.uint64)
    a, b = both[: int(n * (1 + share) / 2)], both[n - int(n * (1 + share) / 2) :]
    a = np.concatenate([a, a[:100]])  # weight 2
    b = np.concatenate([b, b[:100]])
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    keys = ca.keys() | cb.keys()
    exact = sum(min(ca[x], cb[x]) for x in keys) / sum(max(ca[x], cb[x]) for x in keys)
    text = np.repeat([0, 1], [len(a), len(b)])
    sign = signatures(text, np.concatenate([a, b]), 2, k)
    assert abs((sign[0] == sign[1]).mean() - exact) < 5 * np.sqrt(exact * (1 - exact) / k)


def test_forests_link_what_is_plausible():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, (3, 64), dtype=np.uint8)
    sketch = np.repeat(base, 5, axis=0)
    sketch[:, :6] = rng.integers(0, 256, (15, 6))
    pairs = forests(sketch, 0.68, 3)
    assert all(a // 5 == b // 5 for a, b in pairs) and len(set(map(frozenset, pairs))) == len(pairs) <= 3 * 12
    assert len(forests(sketch, 0.68, 1)) == 12


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 180)] + [(300, 301), (301, 300), (5, 5), (None, 4)]
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(frame, "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)} | {300: 300, 301: 300}
    assert components(frame.limit(0), "a", "b").count() == 0
