"""Registered queries against their SQL, and the pipeline against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from bandwalk.llm.queries import QUERIES, WORD_VOCABULARY
from bandwalk.session import settled
from tests.llm.test_mixing import fill
from tests.llm.test_near import brute_force
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert entry_point.queries()[name] is QUERIES[name].run
    verdict = compare(spark, con, name, QUERIES[name].run, QUERIES[name].sql, SF)
    assert verdict.startswith(("ok", "rows")), verdict
    assert "TYPES" not in verdict, verdict


def test_near_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    got = {r.doc_id: r.class_id for r in QUERIES["op2_near_duplicates"].run(spark, SF).collect()}
    want = {r[0]: c if re.search(r"[^\x20\x09-\x0D]", r[1] or "") else r[0] for r, c in zip(rows, brute_force(rows))}
    assert got == want


def test_stages(spark):
    """Every stage against what it should do with its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "quality rules", "near-duplicates", "mixing", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    accepted = stages["quality classifier"](spark, docs, SF).cache()
    assert accepted.columns == docs.columns
    kept = {r.doc_id for r in accepted.collect()}
    known = [i for i in labels if labels[i] is not None]
    assert sum((i in kept) == (labels[i] == 1) for i in known) / len(known) > 0.9

    cleaned = stages["quality rules"](spark, accepted, SF).cache()
    assert cleaned.columns == docs.columns
    verdict = {r.doc_id: r.kept for r in QUERIES["op8_line_quality"].run(spark, SF).collect()}
    assert {r.doc_id for r in cleaned.collect()} == {i for i in kept if verdict[i]}
    assert all(r.n_chars == len(r.text) for r in cleaned.collect())

    single = stages["near-duplicates"](spark, cleaned, SF).cache()
    rows = [(r.doc_id, r.text) for r in cleaned.collect()]
    assert Counter(r.doc_id for r in single.collect()) == Counter(set(brute_force(rows)))

    mixed = stages["mixing"](spark, single, SF).cache()
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == plain_copies([(r.doc_id, r.text, r.source) for r in single.collect()])
    check_pieces(stages["packing"](spark, mixed, SF).collect(), copies, {r.doc_id: r.text for r in mixed.collect()})
    accepted.unpersist(), cleaned.unpersist(), single.unpersist(), mixed.unpersist()


def plain_copies(rows):
    """How often each document is taken: water-filling, whole repetitions, then a seeded order up to the target."""
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += words[i]
    copies = Counter()
    for source, target in fill(sizes).items():
        own = sorted((int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:13], 16), i) for i, _, s in rows if s == source)
        whole = int(target // sizes[source]) if sizes[source] else 0
        missing, upto = target - whole * sizes[source], 0
        for _, i in own:
            copies[i] = whole + (2 * upto + words[i] <= 2 * missing)
            upto += words[i]
    return +copies


def check_pieces(pieces, copies, texts):
    """Every copy of every document once, cut where sequences end, sequences full but for the last."""
    library = Tokenizer.from_file(WORD_VOCABULARY)
    tokens = Counter()
    sequences = {}
    for r in pieces:
        tokens[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, n in copies.items():
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        assert tokens[i] == n * len(ids)
        for r in pieces:
            if r.doc_id == i:
                assert r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length]))
    assert set(tokens) == set(copies)
    total = sum(tokens.values())
    assert sorted(sequences) == list(range(-(-total // 4096)))
    for s, own in sequences.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == min(4096, total - 4096 * s)


def test_run_is_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = settled(stage(spark, docs, SF))
    rows = docs.collect()
    check_pieces(corpus_pipeline.run(spark, SF).collect(), Counter(r.doc_id for r in rows), {r.doc_id: r.text for r in rows})


def test_stage_edges(spark):
    """Nulls in any column, empty and repeated rows, and an empty table, through every stage."""
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    some = whole.limit(30).collect()
    nulls = [tuple(None for _ in whole.columns)]
    empty = [tuple("" if c == "text" else 9001 if c == "doc_id" else None for c in whole.columns)]
    odd = spark.createDataFrame([tuple(r) for r in some] + [tuple(some[0])] * 2 + nulls * 2 + empty, whole.schema)
    for docs in (odd, whole.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            if name == "packing":
                assert sum(r.length for r in rows) == sum({(r.doc_id, r.ids_crc32, r.start, r.sequence_id, r.offset): r.length for r in rows}.values())
                continue
            assert out.columns == whole.columns, name
            known = {tuple(r) for r in docs.select("doc_id", "source").collect()}
            assert {(r.doc_id, r.source) for r in rows} <= known, name
            if name == "near-duplicates":  # the repeated row stays once, rows without words all stay
                assert sum(r.doc_id == some[0].doc_id for r in rows) <= 1 and sum(r.text in (None, "") for r in rows) == (3 if n else 0)
            if name in ("quality classifier", "quality rules"):
                assert len(rows) <= n


def test_dedup_stage_edges(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(5, a), (2, a), (2, a), (None, a), (7, None), (8, ""), (8, ""), (9, "other words than those above stand here")]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, name string, node int")
    out = corpus_pipeline.deduplicated(spark, docs, SF)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(2, a), (7, None), (8, ""), (8, ""), rows[-1]])
    assert corpus_pipeline.deduplicated(spark, docs.limit(0), SF).count() == 0
