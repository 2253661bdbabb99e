"""Line-first cleaning: rules per line, then documents that lose too much text are rejected."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bandwalk.llm.mixing import BLANKS

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """A line is removed if one rule of these holds."""

    # navigation: separators make up this share (percent) of its words
    separator_percent: int = 20
    separators: str = "|»›•·"
    # punctuation: this share (percent) of its words ends in a symbol or in more than one mark
    noisy_percent: int = 30
    # boilerplate: a line of at most so many words of which phrases, as whole words, make up this share (percent)
    boilerplate_words: int = 30
    boilerplate_percent: int = 40
    boilerplate: tuple[str, ...] = (
        "all rights reserved", "terms of use", "terms of service", "privacy policy", "use of cookies", "uses cookies",
        "accept cookies", "cookie policy", "enable javascript", "javascript is disabled", "click here", "read more",
        "sign in", "log in", "sign up", "subscribe to our", "share this", "back to top", "skip to content", "powered by",
    )
    # documents that keep less than this share (percent) of the characters in their words are rejected
    kept_percent: int = 50
    min_words: int = 20
    repeat_percent: int = 30


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def solid(text: Column) -> Column:
    """Code points outside blanks."""
    return F.length(F.translate(text, " " + BLANKS, ""))


def repeat_words(words: Column, window: int = 8) -> Column:
    """Words inside windows of ``window`` words that the text holds twice or more.

    Windows are compared by a 64-bit hash, made of the hashes of their halves. Only a text with
    an equal pair sorts its windows, so the cost is that of a sort at most, however long the text.
    """

    def bind(value: Column, then) -> Column:
        # evaluates the value once, also inside other lambdas
        return F.transform(F.array(value), then)[0]

    def joined(hashes: Column, step: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - (step + 1)),
                           lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + step)))

    def runs(hashes: Column, width: int) -> Column:
        if 2 * width <= window:
            return bind(joined(hashes, width), lambda h: runs(h, 2 * width))
        return joined(hashes, window - width) if width < window else hashes

    def covered(grams: Column) -> Column:
        # (hash, place) in order: a place is repeated if a neighbour has its hash
        return bind(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), lambda s: bind(
            F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(
                (F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"]), x["i"])), lambda p: p.isNotNull())),
            lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at")), lambda acc, x: F.struct(
                (acc["n"] + F.least(F.lit(window), x - acc["at"])).alias("n"), x.alias("at")))["n"]))

    counted = bind(bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: runs(h, 1)),
                   lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0))
    return F.coalesce(F.when(F.size(words) > window, counted), F.lit(0)).cast("bigint")


NOISE = r"[#*$%&<>|=~^\[\]{}]+[ \t-\r]|[!?]{2,}[ \t-\r]"


def suspect(text: Column, rules: LineRules) -> Column:
    """False only if no line of the text can fail: it holds no separator, no noisy word and no phrase."""
    low = F.lower(text)
    marked = F.length(F.translate(text, rules.separators, "")) < F.length(text)
    return reduce(Column.__or__, [low.contains(p) for p in rules.boilerplate], marked | F.concat(text, F.lit(" ")).rlike(NOISE))


def has_word(line: Column) -> Column:
    return F.length(F.trim(F.translate(line, BLANKS, " " * len(BLANKS)))) > 0


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line with a word is removed."""
    n = F.size(split_words(line))
    marks = F.length(line) - F.length(F.translate(line, rules.separators, ""))
    navigation = (marks > 0) & (marks * 100 >= n * rules.separator_percent)
    noisy = F.size(F.split(F.concat(line, F.lit(" ")), NOISE, -1)) - 1
    low = F.lower(line)
    # words of the phrases that the line holds; the pattern is only tried where the bare phrase is found
    said = F.lit(0)
    for p in rules.boilerplate:
        whole = F.contains(low, F.lit(p)) & low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(p)}(?![\p{{L}}\p{{N}}_])")
        said = said + F.when(whole, len(p.split())).otherwise(0)
    phrase = (said > 0) & (said * 100 >= n * rules.boilerplate_percent)
    return navigation | (noisy * 100 >= n * rules.noisy_percent) | ((n <= rules.boilerplate_words) & phrase)


def line_quality(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, verdict and cleaned text per row of ``docs``, which is carried whole in ``row``.

    Returns row, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, cleaned. ``cleaned`` is the text without the lines that the rules for
    navigation, punctuation and boilerplate remove; lines without a word stay. A document
    is kept if its base statistics pass and the lines that stay hold ``kept_percent`` of the
    characters in its words. All of it is computed within the row: one pass, no shuffle.

    Null texts count as empty (``cleaned`` stays null); without words a document fails. A
    text without line ends is one line, however long. Ids may be null or repeated: every
    row gives one row, an empty table none. Columns of ``docs`` cannot clash, as they stay inside ``row``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("raw"),
                       text.alias("text"), split_words(text).alias("words"), F.split(text, "\n", -1).alias("lines"))
    full = F.filter("lines", has_word)
    staying = F.filter("lines", lambda x: ~(has_word(x) & line_fails(x, rules)))
    counted = base.select(
        "row", "doc_id", "raw",
        F.size("words").cast("bigint").alias("n_words"),
        solid(F.col("text")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.transform(F.array(full), lambda f: F.size(f) - F.size(F.array_distinct(f)))[0].cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.when(suspect(F.col("text"), rules), F.array_join(staying, "\n")).otherwise(F.col("text")).alias("stays"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    kept = ~failed & (100 * solid(F.col("stays")) >= rules.kept_percent * F.col("word_chars"))
    return counted.select(
        "row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        kept.alias("kept"), F.when(F.col("raw").isNotNull(), F.col("stays")).alias("cleaned"))


def quality_sql(rules: LineRules = LineRules()) -> str:
    """The query ``op8`` in DuckDB's SQL."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    edge = r"[^\p{L}\p{N}_]"
    said = " + ".join(f"case when regexp_matches(low, '(^|{edge}){re.escape(p)}({edge}|$)') then {len(p.split())} else 0 end"
                      for p in rules.boilerplate)
    words = "list_filter(string_split_regex({}, '[ \\t-\\r]+'), lambda w: w <> '')"
    return f"""with d as (select row_number() over () as n, doc_id, coalesce(text, '') as t from documents),
      w as (select n, {words.format('t')} as ws, t from d),
      g as (select n, i, hash(list_slice(ws, i, i + 7)) as h, list_slice(ws, i, i + 7) as gram
            from (select n, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
      twice as (select n, gram from g group by n, gram having count(*) > 1),
      hits as (select g.n, g.i from g join twice using (n, gram)),
      reps as (select n, sum(least(8, i - coalesce(before, i - 8))) as r
               from (select n, i, lag(i) over (partition by n order by i) as before from hits) group by n),
      lines as (select n, unnest(string_split(t, chr(10))) as x from d),
      full_lines as (select n, x, lower(x) as low, {words.format('x')} as lw from lines where len({words.format('x')}) > 0),
      dup as (select n, count(*) - count(distinct x) as k from full_lines group by n),
      judged as (select n, x,
          (length(x) - length(translate(x, '{rules.separators}', ''))) as marks, len(lw) as m,
          len(regexp_extract_all(x || ' ', '{NOISE}')) as noisy, {said} as said from full_lines),
      good as (select n, sum(length(translate(x, {blanks}, ''))) as c from judged
               where not ((marks > 0 and marks * 100 >= m * {rules.separator_percent}) or noisy * 100 >= m * {rules.noisy_percent}
                          or (m <= {rules.boilerplate_words} and said > 0 and said * 100 >= m * {rules.boilerplate_percent})) group by n),
      s as (select d.n, doc_id, cast(len(ws) as bigint) as n_words, length(translate(d.t, {blanks}, '')) as word_chars,
               length(d.t) - length(translate(d.t, '{SYMBOLS}', '')) as n_symbols, coalesce(k, 0) as n_dup_lines,
               cast(coalesce(r, 0) as bigint) as n_repeat_words, coalesce(c, 0) as c
            from d join w using (n) left join reps using (n) left join dup using (n) left join good using (n))
      select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        (n_words < {rules.min_words} or 100 * n_repeat_words > {rules.repeat_percent} * n_words) as base_failed,
        not (n_words < {rules.min_words} or 100 * n_repeat_words > {rules.repeat_percent} * n_words)
          and 100 * c >= {rules.kept_percent} * word_chars as kept from s"""
