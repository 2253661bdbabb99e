"""Token counts and packing against the tokenizer library."""

import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from bandwalk.llm.bpe import Encoder, Merger
from bandwalk.llm.packing import pack
from bandwalk.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY
from bandwalk.llm.token_count import token_counts

ODD = [
    "", " ", "  ", "   x", "foo   bar", "foo\n bar", "foo \n bar", "foo\n \nbar", "foo \n", "a  ", "\n\n\nx",
    "don't 'tis it's '' 's x''s", "<|endoftext|> a<|endoftext|>b <|endoft", "ab\tcd \t ef", "x y 　 z",
    "日本語 テキスト 123", "a" * 3000, "é ñ ß", "\x1c a \x1cb", "🙂🙂 x🙂", "½ ²3 ⅷ", " \x85 x", "0123 45a6", "!!??  !!", "''",
    "a\r\n\r\nb", "\x00 a\x00b", "İstanbul ISTANBUL", "ΣΑΣ ΟΔΟΣ. ΣΣ", "é ́x é", "Ǆ ǅ ẞ Ÿ", "it'S I'LL", None,
]


@pytest.fixture(scope="module")
def counter():
    return Encoder(Merger(BYTE_VOCABULARY)), Tokenizer.from_file(BYTE_VOCABULARY)


@pytest.fixture(scope="module")
def worder():
    return Encoder(Merger(WORD_VOCABULARY)), Tokenizer.from_file(WORD_VOCABULARY)


def ids_of(encoder, texts):
    flat, bounds = encoder.ids(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_odd_texts(counter, worder):
    mine, library = counter
    assert mine.counts(pa.array(ODD)).tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in ODD]
    mine, library = worder
    assert ids_of(mine, ODD) == [library.encode(t or "", add_special_tokens=False).ids for t in ODD]


PIECES = st.one_of(
    st.text(max_size=12),
    st.sampled_from([" ", "  ", "\n", "\t", "'s", "'", "<|endoftext|>", "Ab", "12", "é", "́", "the", "!!", "aaa", " "]),
)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=6))
def test_any_texts(counter, worder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    mine, library = counter
    assert mine.counts(pa.array(texts)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    mine, library = worder
    assert ids_of(mine, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_counts_frame(spark, counter):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "again", "x"), (3, "again", "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = token_counts(docs, BYTE_VOCABULARY, limit=100)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = []
    for i, t, _ in rows:
        n = len(counter[1].encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 100))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert token_counts(docs.limit(0), BYTE_VOCABULARY, limit=100).count() == 0


def test_merge_order_is_by_rank(counter):
    """One long word: every round merges all places of the lowest pair only."""
    mine, library = counter
    for text in ("abababab" * 50, "aaaaaaa", "thethethe" * 30, "xyzzy" * 77):
        assert mine.counts(pa.array([text])).tolist() == [len(library.encode(text).ids)]


def test_pack_is_the_concatenation(spark, worder):
    texts = ["One two three.", "", None, "four " * 40, "x", "five SIX 77 " * 9, "x"]
    rows = [(None if i == 4 else i, t, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    out = pack(docs, WORD_VOCABULARY, end_id=2, length=16).collect()
    whole = {i: worder[1].encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}
    sequences = {}
    for doc in {r.doc_id for r in out}:
        own = sorted((r for r in out if r.doc_id == doc), key=lambda r: r.start)
        ids = []
        for r in own:
            assert r.start == len(ids) and r.doc_tokens == len(whole[doc]) and len(r.ids) == 4 * r.length > 0
            ids += [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert ids == whole[doc]
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
    total = sum(map(len, whole.values()))
    assert sorted(sequences) == list(range(-(-total // 16)))
    for s, own in sequences.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == min(16, total - 16 * s)
    assert pack(docs.limit(0), WORD_VOCABULARY, end_id=2).count() == 0


def test_pack_query_digest(spark):
    from bandwalk.llm.queries import packed

    docs = spark.createDataFrame([(7, "hello world " * 3000)], "doc_id long, text string")
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("hello world " * 3000).ids + [2]
    for r in packed(docs).collect():
        piece = b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length])
        assert r.ids_crc32 == zlib.crc32(piece) and r.doc_tokens == len(ids)
