"""The queries op1 to op13 over the given tables, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from bandwalk.catalog.base import Entry, Query
from bandwalk.llm import (
    conversations, dart_minhash, factorisation, fill_middle, importance, licenses, line_quality, mixing, packing, simhash,
    token_count, topk, warc,
)
from bandwalk.session import shared_folder

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = Entry(fn, sql)
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary."""
    return token_count.token_counts(read(spark, sf_dir, "documents"), BYTE_VOCABULARY, limit=1024)


NEAR_SQL = """
  with recursive d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') as ws from documents),
    s as (select doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))
                                     when len(ws) > 0 then [array_to_string(ws, ' ')] end) as g from d),
    c as (select doc_id, g, count(*) as n from s group by all),
    t as (select doc_id, sum(n) as total from c group by doc_id),
    p as (select a.doc_id as x, b.doc_id as y, sum(least(a.n, b.n)) as m from c a join c b on a.g = b.g and a.doc_id < b.doc_id group by all),
    e as (select x, y from p join t ta on ta.doc_id = x join t tb on tb.doc_id = y where 1000 * m >= 800 * (ta.total + tb.total - m)),
    both_ways as (select x, y from e union all select y, x from e),
    reach as (select doc_id, doc_id as root from documents union select y, root from reach join both_ways on x = doc_id)
  select doc_id, min(root) as class_id from reach group by doc_id"""


@query("op2_near_duplicates", NEAR_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: five words, similarity 0.8."""
    return dart_minhash.near_classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id")


MIX_SQL = """
  with d as (select doc_id, source, cast(len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '')) as bigint) as size,
        cast('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) as h from documents),
    s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
    r as (select *, cast((row_number() over (order by source is null, source) - 1) % 3 + 1 as double) as weight from s),
    f as (select *, sum(source_size) over () as total,
            coalesce(sum(source_size * 3) over (o rows between unbounded preceding and 1 preceding), 0) as caps,
            sum(weight) over () as weights,
            coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0) as used
          from r window o as (order by source_size / weight, source is null, source)),
    l as (select *, (total - caps) / (weights - used) as own from f),
    c as (select *, source_size * 3 <= own * weight as is_full from l),
    e as (select *, min(case when not is_full then own end) over () as first_level from c),
    t as (select source, source_size, case when is_full then cast(source_size * 3 as double) else
            (select arg_min(own, source_size / weight) from c where not is_full) * weight end as target from e),
    w as (select *, cast(floor(case when source_size > 0 then target / source_size else 0 end) as bigint) as whole from t),
    j as (select d.doc_id, d.size, d.h, w.*, target - whole * w.source_size as missing,
            coalesce(sum(d.size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as upto
          from d join w on d.source is not distinct from w.source)
  select doc_id, size, source_size, target, cast(size * (whole + case when 2.0 * upto + size <= 2.0 * missing then 1 else 0 end) as bigint) as taken from j"""


@query("op3_mix_sources", MIX_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


TOP_SQL = """
  with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
             from embeddings where embedding is not null and vec_id is not null
               and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    p as (select q.vec_id as query_id, c.vec_id,
            list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as score
          from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
  select query_id, cast(rank as int) as rank, vec_id, cast(score as bigint) as score from r where rank <= 10"""


@query("op4_exact_top_k", TOP_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every hundredth."""
    rows = topk.quantised(read(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, F.col("vec_id") % 100 == 0, 10)


@query("op5_pack_sequences")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents concatenated and cut into sequences of 4,096 tokens."""
    return packed(read(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, WORD_VOCABULARY, end_id=2, length=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op6_license_scan", licenses.scan_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that each document states."""
    found = licenses.license_scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentences.lines").cast("bigint").alias("n_sentences"),
                        F.array_join("licenses", ",").alias("licenses"), F.size("unmatched").cast("bigint").alias("n_unmatched"))


WARC_SQL = """
  with d as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages),
    f as (select *, count(*) over (partition by digest) as copies, min(page_id) over (partition by digest) as first,
            row_number() over (partition by digest, page_id) as nth from d)
  select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
    case when n >= 100 and (page_id is distinct from first or nth > 1) then 'revisit' else 'response' end as record_type,
    case when n >= 100 and (page_id is distinct from first or nth > 1) then first end as refers_to from f"""


@query("op7_warc_archives", WARC_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    folder = f"{shared_folder(spark)}/bandwalk-warc-{uuid.uuid4().hex}"
    manifest = warc.write_archives(read(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_line_quality", line_quality.quality_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_quality.line_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


CHAT_SQL = """
  with t as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos from conversations),
    c as (select conv_id, list({'r': role, 't': text} order by pos) as turns, count(*) as n,
            string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10)
                       || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' order by pos) as text
          from t group by conv_id),
    g as (select turns, n, min(conv_id) as conv_id, count(*) as copies, min(text) as text from c group by turns, n),
    p as (select distinct list_slice(turns, 1, k) as turns from (select turns, unnest(range(1, n)) as k from g))
  select conv_id, 0 as part, cast(n as bigint) as n_turns, cast(copies as bigint) as copies, text
  from g anti join p on g.turns = p.turns"""


@query("op9_chat_format", CHAT_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return conversations.format_conversations(read(spark, sf_dir, "conversations"))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents")
    model = factorisation.train(docs, read(spark, sf_dir, "labels"))
    return factorisation.scored_ids(docs, model)


MIDDLE_SQL = """
  with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
    u as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as parts,
            cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
            cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from d),
    c as (select *, len(parts) as n, least(h1 % (len(parts) + 1), h2 % (len(parts) + 1)) as low,
            greatest(h1 % (len(parts) + 1), h2 % (len(parts) + 1)) as high,
            case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
                 when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
    p as (select *, array_to_string(list_slice(parts, 1, low), '') as prefix, array_to_string(list_slice(parts, low + 1, high), '') as middle,
            array_to_string(list_slice(parts, high + 1, n), '') as suffix from c),
    o as (select *, case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end as output from p)
  select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
    case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
    sha256(output) as output_sha256, sha256(text) as restored_sha256 from o"""


@query("op11_fill_in_middle", MIDDLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in its middle, and restored."""
    made = fill_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    return fill_middle.restored(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


RESAMPLING_SQL = """
  with d as (select row_number() over () as r, doc_id,
               list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') as ws from documents),
    b as (select list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') as ws from benchmark),
    df as (select r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as f from d),
    bf as (select unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as f from b),
    tab as (select list(c order by i) as t from (
      select i, list_reduce(range(8), lambda a, k: case when a % 2 = 1 then xor(3988292384, a // 2) else a // 2 end, i) as c from range(256) as x(i))),
    names as (select distinct f from (select f from df union all select f from bf)),
    hex_names as (select f, hex(encode(f)) as x from names),
    crc as (select f, xor(4294967295, list_reduce(range(strlen(f)), lambda a, k:
        xor(a // 256, t[xor(a % 256, cast('0x' || substr(x, 2 * k + 1, 2) as bigint)) + 1]), 4294967295)) % 10000 as bucket from hex_names, tab),
    s as (select bucket, count(*) as n from df join crc using (f) group by bucket),
    t as (select bucket, count(*) as n from bf join crc using (f) group by bucket),
    g as (select i as bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1.0::double) * ((select coalesce(sum(n), 0) from s) + 10000.0::double)
             / ((coalesce(s.n, 0) + 1.0::double) * ((select coalesce(sum(n), 0) from t) + 10000.0::double)))) as bigint) as gain
          from range(10000) as x(i) left join s on s.bucket = i left join t on t.bucket = i),
    w as (select r, count(*) as n, cast(sum(gain) as bigint) as total from df join crc using (f) join g using (bucket) group by r),
    e as (select doc_id, len(ws) as n_words, coalesce(n, 0) as n_features,
            case when n is null then 0 else (total - ((total % n) + n) % n) // n end as weight,
            cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h from d left join w using (r)),
    z as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from e),
    k as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls first, n_features, weight) as nth from z)
  select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
    case when n_words >= 20 and nth <= (select 25 * count(*) // 100 from z where n_words >= 20) then cast(nth as bigint) end as rank from k"""


@query("op12_importance_resampling", RESAMPLING_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn to look like the benchmark."""
    drawn = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_simhash_components")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document: three words, two bits."""
    return simhash.near_components(read(spark, sf_dir, "documents"))
