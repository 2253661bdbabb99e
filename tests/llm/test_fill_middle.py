"""Fill-in-the-middle against slices of the text, and exact round trips."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from bandwalk.llm.fill_middle import Forms, Tokens, arranged, fill_in_middle, rebuilt, restored, rotate
from bandwalk.llm.texts import raw

TEXTS = ["", None, "one", "def add(a, b):\n    return a + b\n", "wort über Straße – 日本語 🙂 end", "a<P>b", "x <S", "<M", "tail<",
         "ab12cd  \n\n", " ", "é", "same text twice", "same text twice", "long words " * 30_000, "\x00\x7f ok"]


def expected(doc_id, text, seed=1, plain_from=90, spm_below=20):
    text = text or ""
    parts = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(parts) + 1) for x in h[:2])
    form = "spm" if h[3] % 100 < spm_below else "psm"
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain_from:
        return doc_id, len(parts), "plain", None, None, text, text
    p, m, s = "".join(parts[:low]), "".join(parts[low:high]), "".join(parts[high:])
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(parts), form, len(p), len(m), out, text


def test_frame(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id here"), (None, None), (3, "again three")]
    rows += [(1000 + i, f"document number {i} – says\n{i * 7} things") for i in range(200)]
    docs = spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, text string, n int, form string").repartition(3)
    out = restored(fill_in_middle(docs)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(map(tuple, out), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0
    other = fill_in_middle(docs, Forms(seed=9, plain_from=100, spm_below=100)).collect()
    assert sorted(tuple(r)[:6] for r in other if r.doc_id is not None and r.doc_id > 100) == sorted(
        expected(*r, 9, 100, 100)[:6] for r in rows if r[0] is not None and r[0] > 100)


def test_restored_keeps_columns_and_nulls(spark):
    rows = [(1, "<P>a<S>c<M>b", "psm", "old"), (2, None, "psm", "old"), (3, "text", None, "old"), (4, "<S>c<P>a<M>b", "spm", None)]
    made = spark.createDataFrame(rows, "doc_id long, output string, form string, restored string")
    out = restored(made)
    assert out.columns == ["doc_id", "output", "form", "restored"]
    assert sorted(tuple(r)[::3] for r in out.collect()) == [(1, "abc"), (2, None), (3, None), (4, "abc")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<", "P>", "S", ">", "a", "é", "🙂", "<S", "M>"]), max_size=12).map("".join), st.data())
def test_any_cut_round_trips(text, data):
    body = text.encode()
    if any(s in body for s in (b"<P>", b"<S>", b"<M>")):
        return
    low, high = sorted(data.draw(st.integers(0, len(body))) for _ in range(2))
    for form, made in (("psm", b"<P>%b<S>%b<M>%b" % (body[:low], body[high:], body[low:high])),
                       ("spm", b"<S>%b<P>%b<M>%b" % (body[high:], body[:low], body[low:high])), ("plain", body)):
        assert arranged(body, low, high, form) == made
        assert rebuilt(made, form) == body


@given(st.binary(max_size=40), st.data())
def test_rotation(body, data):
    a, m, b = sorted(data.draw(st.integers(0, len(body))) for _ in range(3))
    buffer = bytearray(body)
    rotate(buffer, a, m, b)
    assert buffer == body[:a] + body[m:b] + body[a:m] + body[b:]


@given(st.lists(st.text(max_size=10), min_size=1, max_size=5))
def test_tokens(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    tokens = Tokens(*raw(pa.array(texts, pa.string())))
    parts = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert tokens.count.tolist() == [len(p) for p in parts]
    at = 0
    for i, p in enumerate(parts):
        for k in range(len(p) + 1):
            where = np.minimum(tokens.count, k)
            assert tokens.position(where)[i] == at + len("".join(p[:k]).encode())
        at += len(texts[i].encode())
