"""Line rules against plain Python."""

import re
from collections import Counter

import duckdb
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from bandwalk.llm.line_quality import LineRules, has_word, line_fails, line_quality, quality_sql, repeat_words, suspect

PROSE = "The quick brown fox jumps over the lazy dog and then it rests for a while. "


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    return {r.doc_id: r for r in line_quality(docs).collect()}


def check(spark, texts):
    got = run(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), repr(t)[:200]
        assert not (r.kept and r.base_failed)


def test_statistics(spark):
    loop = "a b c d e f g h i"
    check(spark, [
        None, "", " ", "\n\n", "one", "a b c d e f g h", loop, loop + " " + loop, loop + " x " + loop + " y " + loop, "a " * 30, "a b " * 30,
        " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i % 13}" for i in range(40)), "x\x0by\x0cz\rq\tr", "é|ß\n\n \né|ß\né|ß \n",
        "#*$%&|<> ## 🙂🙂", "a\x1cb c d", ("lorem " * 7 + "\n") * 3, " ".join(f"w{i % 5000}" for i in range(20000)), "z" * 100000,
    ])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "\n", "\t", "é", "#", "  "]), max_size=60).map(" ".join), min_size=10, max_size=20))
def test_any_statistics(spark, texts):
    check(spark, texts)


def test_verdicts(spark):
    clean = PROSE * 1 + "\n" + " ".join(f"Sentence {i} says something else entirely." for i in range(20))
    menu = "\n".join(f"Home | About | Item {i} | Contact | More" for i in range(20))
    shout = "\n".join(" ".join(f"WORD{i}X{j}!!" for j in range(10)) for i in range(10))
    marks = " ".join(f"word{i}***" for i in range(60))
    got = run(spark, [clean, clean + "\n" + menu, menu, shout, marks, clean + "\nPlease read our privacy policy.\n\nLast line", PROSE.strip()])
    assert [got[i].kept for i in range(6)] == [True, False, False, False, False, True]
    assert got[6].base_failed
    assert got[5].cleaned == clean + "\n\nLast line"
    assert got[0].cleaned == clean


def test_rows_stay(spark):
    docs = spark.createDataFrame([(None, PROSE), (1, PROSE), (1, PROSE)], "doc_id long, text string")
    out = line_quality(docs)
    assert out.count() == 3 and out.select("row.*").columns == ["doc_id", "text"]
    assert line_quality(docs.limit(0)).count() == 0


def test_boilerplate_phrases_are_whole_words_that_fill_the_line(spark):
    clean = ["They design in the open", "Items in the catalog include tools", "The catalog in print", "children who read more learn faster"]
    gone = ["Sign in", "Please log in to continue", "All rights reserved.", "Copyright 2020 Example. All rights reserved.", "Read more..."]
    docs = spark.createDataFrame([(1, "\n".join(clean + gone))], "doc_id long, text string")
    assert line_quality(docs).first().cleaned.split("\n") == clean


WORDY = "The members of {} met in the old hall and talked about plans for {} and the coming year."
LINES = [
    "They{} design in the{} open with{} ...", "Items in the catalog include {}", "Sign in", "Please log in to continue{}", "ACCEPT COOKIES!",
    "Home | About {} | News", "a » b » {}", "wow!! {}!! so!! much!!", "cost $ {} # [x] ***", "children who read more learn faster {}",
    "blog in {} catalog in", "éread more", "read more_", "Read more: {} (privacy policy)", WORDY, WORDY, WORDY, "", "  ",
]


def test_sql_and_operator_agree_where_the_rules_differ(spark):
    texts = ["\n".join(LINES[(i * k + k) % len(LINES)].replace("{}", str(i)) for k in range(1, 12)) for i in range(150)]
    texts += ["\n".join(x.replace("{}", str(i)) for i in range(12)) for x in LINES] + [None, "", " ".join(f"w{i}" for i in range(30)) + " ##"]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = {r[0]: tuple(r[1:]) for r in con.execute(quality_sql()).fetchall()}
    got = run(spark, texts)
    assert {i: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for i, r in got.items()} == want
    # both verdicts occur, and the bare phrase alone removes nothing
    assert {r.kept for r in got.values() if not r.base_failed} == {True, False}
    assert got[150].kept


def test_texts_that_are_not_suspect_have_no_failing_line(spark):
    lines = [x.replace("{}", str(i)) for i, x in enumerate(LINES)] + ["odd =", "[", "a!!", "x ??\tb", "•", "Powered by", "ok!? no", "ÀLL RIGHTS RESERVED"]
    frame = spark.createDataFrame([(x,) for x in lines], "text string")
    rules = LineRules()
    out = frame.select("text", suspect(F.col("text"), rules).alias("s"), (has_word(F.col("text")) & line_fails(F.col("text"), rules)).alias("f")).collect()
    assert any(r.f for r in out) and not [r.text for r in out if r.f and not r.s]


def test_windows_of_any_width(spark):
    words = [list("abcabcabxabcab"), list("aaaaaaa"), list("abcdefghij"), ["a"], []]
    frame = spark.createDataFrame([(w,) for w in words], "w array<string>")
    for width in (1, 2, 3, 5, 6, 8):
        got = [r[0] for r in frame.select(repeat_words(F.col("w"), width)).collect()]
        for w, n in zip(words, got):
            grams = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
            count = Counter(grams)
            assert n == len({i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(width)}), (w, width)
