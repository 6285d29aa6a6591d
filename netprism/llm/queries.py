"""The registered query of each operator: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_text, interaction, language, mixing, packing, pii, repeats, simhash, tokens, topk, variants, warc
from .common import table, word_count

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", word_count(F.col("text")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mix_sources, op2_simhash, op3_language, op4_exact_top_k, op5_personal_data, op6_main_text, op7_repeated_passages, op8_token_counts, op9_nearest, op10_pack_sequences, op11_warc, op12_filter_interactions, op13_spelling_variants)}
#: Checking SQL by query; the others are checked against brute-force versions in tests/llm.
SQL: dict[str, str] = {
    "op11_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select h, max(page_id) as m from p group by h),
d as (select p.page_id, strlen(p.h) as n, sha1(p.h) as s, m, coalesce(p.page_id <> m, m is not null) as again from p join g on g.h = p.h)
select page_id, cast(n as bigint) as payload_bytes,
  translate(concat(to_base(cast('0x' || s[1:10] as bigint), 32, 8), to_base(cast('0x' || s[11:20] as bigint), 32, 8), to_base(cast('0x' || s[21:30] as bigint), 32, 8),
    to_base(cast('0x' || s[31:40] as bigint), 32, 8)), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
  case when again then 'revisit' else 'response' end as record_type, case when again then m end as refers_to from d""",
    "op12_filter_interactions": r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as first from d),
f as (select doc_id, part, cast(len(w) < 100 as int) + 2 * cast(100 * len(list_distinct(w)) < 80 * len(w) as int)
  + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) as int) + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(coalesce(doc_id > first, false) as int) as mask from w),
l as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels where doc_id is not null group by doc_id),
m as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l on l.doc_id = f.doc_id group by 1, 2),
x as (select chr(cast(65 + i as int)) as c, 1 << i as bit from range(5) r(i)),
o as (select concat(a.c, b.c, c.c, d.c, e.c) as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from x a, x b, x c, x d, x e
  where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (select filter_order, cast(i as int) as step, bits[i] as bit, cast(coalesce(list_sum(bits[1:i - 1]), 0) as bigint) as before from o, range(1, 6) r(i)),
k as (select part, filter_order, step, bit, coalesce(sum(n) filter (mask & (before | bit) = 0), 0) as kept, coalesce(sum(n) filter (mask & before = 0 and mask & bit > 0), 0) as removed,
  coalesce(sum(n) filter (mask & before > 0 and mask & bit > 0), 0) as redundant, coalesce(sum(n) filter (mask = bit), 0) as unique_fails,
  coalesce(sum(good) filter (mask & before = 0 and mask & bit > 0), 0) as good_lost, coalesce(sum(toxic) filter (mask & before = 0 and mask & bit > 0), 0) as toxic_lost
  from m, s group by 1, 2, 3, 4)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) as shapley from k""",
    # the checksum bit by bit; near words by what is left without one letter
    "op13_spelling_variants": r"""
with recursive r as (select coalesce(cast(doc_id as varchar), '') as k, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}')) as r from documents),
t as (select k, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r, count(*) as c from r group by 1, 2),
b as (select *, hex(encode(k || ':' || r)) as x from t),
y as (select *, list_transform(range(4 * len(x)), lambda i: (cast('0x' || x[(i // 8) * 2 + 1 : (i // 8) * 2 + 2] as bigint) >> cast(i % 8 as bigint)) & 1) as bits from b),
h as (select r, c, xor(list_reduce(list_prepend(4294967295, bits), lambda s, x: case when xor(s & 1, x) = 1 then xor(s >> 1, 3988292384) else s >> 1 end), 4294967295) as h from y),
n as (select case when h % 199 = 0 then concat(substr(r, 1, h % length(r)), substr(r, h % length(r) + 2)) else r end as word, c from h),
v as (select word, cast(sum(c) as bigint) as n from n where length(word) >= 6 group by word having sum(c) >= 5),
g as (select word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
p as (select a.word, a.n, b.word as other, b.n as m from g a join g b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select g.word, g.n, v.word, v.n from g join v on v.word = g.rest union select v.word, v.n, g.word, g.n from g join v on v.word = g.rest),
q as (select word, n, count(*) as n_near, first(struct_pack(o := other, m := m) order by m desc, other) as b from p group by word, n),
f as (select word, n_near, case when b.m >= 5 * n then b.o end as form, case when b.m >= 5 * n then b.m end as form_n from q),
u as (select word as word, form as stop, 1 as d from f where form is not null union all select u.word, f.form, d + 1 from u join f on f.word = u.stop where f.form is not null),
z as (select word, arg_max(stop, d) as root from u group by word)
select v.word, f.form, coalesce(z.root, v.word) as root, v.n, coalesce(f.n_near, 0) as n_near, f.form_n from v left join f on f.word = v.word left join z on z.word = v.word""",
    "op4_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score from v a join v b on b.vec_id <> a.vec_id and len(b.q) = len(a.q) where a.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20""",
    # every 400 bytes of every text by digest; runs of starts that stand twice; what is left, put together again
    "op7_repeated_passages": """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select r, unnest(range(0, greatest(0, len(h) // 2 - 399))) as i from d),
w as (select p.r, p.i, md5(substr(d.h, 2 * p.i + 1, 800)) as m from p join d on d.r = p.r),
dup as (select r, i from w where m in (select m from w group by m having count(*) > 1)),
g as (select r, i, case when i - lag(i) over (partition by r order by i) <= 400 then 0 else 1 end as new from dup),
s as (select r, i, sum(new) over (partition by r order by i) as k from g),
runs as (select r, min(i) as a, max(i) + 400 as b from s group by r, k),
c as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as before from runs),
n as (select r, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans, max(b) as last from runs group by r),
parts as (
  select c.r, c.a as place, substr(d.h, 2 * c.before + 1, 2 * (c.a - c.before)) as x from c join d on d.r = c.r
  union all select d.r, len(d.h), substr(d.h, 2 * coalesce(n.last, 0) + 1) from d left join n on n.r = d.r),
-- characters cut in two at an end of a part are left out of the text
whole as (select r, place, x, regexp_replace(regexp_replace(x, '^([89AB][0-9A-F])+', ''), '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-9A-F]([89AB][0-9A-F]){0,2})$', '') as t from parts),
kept as (select r, string_agg(x, '' order by place) as h, string_agg(t, '' order by place) as t from whole group by r)
select d.doc_id, cast(len(d.h) // 2 as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(kept.h)) as kept_sha256, decode(unhex(kept.t)) as text
from d join kept on kept.r = d.r left join n on n.r = d.r""",
}
