"""License sentences and rules."""

import re
import textwrap

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from bandwalk.llm.licenses import ENDS, RULES, SENTENCES, Rulebook, license_scan, scan_sql

BY_NAME = dict(SENTENCES)


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    return {r.doc_id: r for r in license_scan(docs).collect()}


def test_book_is_consistent():
    book = Rulebook()
    assert book.missing_stems() == []
    # no known sentence would be cut
    assert [n for n, s in SENTENCES if re.search(ENDS + "[ \t-\r]+", s)] == []
    assert len(book.known()) == len(SENTENCES) == len(BY_NAME)
    assert {s for _, ids in RULES for s in ids} <= set(BY_NAME)
    patterns = ["".join(f"<{s}>" for s in ids) for _, ids in RULES]
    # a rule is not hidden by an earlier one that is part of it
    assert not [(a, b) for j, b in enumerate(patterns) for a in patterns[:j] if a in b]


@pytest.mark.parametrize("width", [40, 80, 10_000])
def test_whole_texts_in_any_wrapping(spark, width):
    texts, want = [], []
    for name, ids in RULES:
        body = " ".join(BY_NAME[s] for s in ids)
        texts.append("Some words before.\n\n" + textwrap.fill(body, width, break_long_words=False, break_on_hyphens=False) + "\n\nand after")
        want.append([name])
    got = scan(spark, texts)
    for i, w in enumerate(want):
        # a sentence without an end mark of its own is only told apart where a line ends
        if all(s.endswith((".", ":")) for s in map(BY_NAME.get, RULES[i][1][:-1])):
            assert set(w) <= set(got[i].licenses), (RULES[i], got[i])


def test_order_and_leftovers(spark):
    got = scan(spark, [
        "Prose.\nReleased under the MIT License.\nMore prose. licensed   under cc by-nc 4.0.",
        BY_NAME["bsd-endorse"] + "\n" + BY_NAME["mit-notice"],
        "# " + BY_NAME["mit-grant"] + "\n# " + BY_NAME["mit-condition"],
        "released under the mit licenses", None, "", " \n ", "permission", "x " * 50000 + "\nAll rights reserved.",
    ])
    assert got[0].licenses == ["CC-BY-NC-4.0", "MIT"]
    assert (got[1].licenses, got[1].unmatched) == (["MIT"], ["bsd-endorse"])
    assert got[2].licenses == ["MIT"]
    assert [got[i].licenses for i in (3, 4, 5, 6, 7)] == [[]] * 5
    assert got[8].licenses == ["LicenseRef-all-rights-reserved"]


def test_rows_stay(spark):
    docs = spark.createDataFrame([(None, "MIT License"), (1, "MIT License"), (1, "MIT License")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.licenses) for r in license_scan(docs).collect()) == [(False, ["MIT"])] * 2 + [(True, ["MIT"])]
    assert license_scan(docs.limit(0)).count() == 0


def by_sql(texts):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    return {i: (n, licenses, left) for i, n, licenses, left in con.execute(
        f"select doc_id, n_sentences, licenses, n_unmatched from ({scan_sql()})").fetchall()}


def agree(spark, texts):
    got = {i: (len(r.sentences.lines), ",".join(r.licenses), len(r.unmatched)) for i, r in scan(spark, texts).items()}
    assert got == by_sql(texts)  # the SQL has no prefilter
    return got


def test_words_of_a_stem_may_be_parted_by_any_mark(spark):
    got = agree(spark, ["# This is free and unencumbered software released into the public\n# domain.", "All rights-reserved.",
                        "ALL RIGHTS\t--\tRESERVED", "all rightsreserved."])
    assert [got[i][1] for i in range(4)] == ["Unlicense", "LicenseRef-all-rights-reserved", "LicenseRef-all-rights-reserved", ""]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(SENTENCES), st.sampled_from([" ", "\n", "\n# ", "-", " * ", "\t", "\n// "]), st.integers(1, 5)),
                min_size=20, max_size=40))
def test_prefilter_never_changes_the_answer(spark, picks):
    texts = []
    for (_, sentence), mark, every in picks:
        words = sentence.split(" ")
        texts.append("".join(w + (mark if n % every == 0 else " ") for n, w in enumerate(words, 1)))
    agree(spark, texts)
