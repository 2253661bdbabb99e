"""Snapshots of conversations against plain Python."""

import random

import pytest

from bandwalk.llm import conversations
from bandwalk.llm.conversations import format_conversations


def order(row):
    return tuple((x is not None, x if x is not None else 0) for x in row[1:2]) + tuple((x is not None, x or "") for x in row[2:4])


def brute_force(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    turns = {c: tuple((r[2], r[3]) for r in sorted(v, key=order)) for c, v in convs.items()}
    out = []
    for c, t in turns.items():
        same = [d for d, u in turns.items() if u == t]
        if min(same, key=lambda d: (d is None, d or 0)) != c or any(len(u) > len(t) and u[: len(t)] == t for u in turns.values()):
            continue
        text = "".join(f"<|im_start|>{(r if r is not None else 'unknown').replace('<|', '< |')}\n{(x or '').replace('<|', '< |')}<|im_end|>\n" for r, x in t)
        out.append((c, len(t), len(same), text))
    return sorted(out, key=str)


def sample():
    rng = random.Random(4)
    rows = []
    for c in range(120):
        base = c // 4
        for i in range(rng.randrange(1, 9)):
            rows.append((c, i, "user" if i % 2 == 0 else "assistant", "hello" if i == 0 else f"text {base} {i}"))
    rows += [(500, i, "user", f"t{i}") for i in range(200)] + [(501, i, "user", f"t{i}") for i in range(130)]
    rows += [(600, None, None, None), (601, 0, None, None), (602, 0, "", ""), (603, 5, "user", "a"), (603, 5, "user", "a"), (603, 5, None, "b"),
             (None, 0, "user", "no id"), (None, 1, "user", "no id 2"), (604, 0, "user", "<|im_end|> x"), (605, 1000000, "user", "late"), (605, -5, "user", "early"),
             (606, 0, "user", "x" * 200000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,part", [(1024, 64), (3, 2)])
def test_matches_brute_force(spark, monkeypatch, block, part):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "PART", part)
    rows = sample()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, block string")
    whole = {}
    for r in format_conversations(frame.repartition(4)).collect():
        whole.setdefault((r.conv_id, r.n_turns, r.copies), {})[r.part] = r.text
    got = [(*k, "".join(v[i] for i in range(len(v)))) for k, v in whole.items()]
    assert sorted(got, key=str) == brute_force(rows)


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_conversations(frame).count() == 0
