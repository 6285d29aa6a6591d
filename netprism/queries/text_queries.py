"""Free text: entities, redaction, keyword index, character statistics, reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as T
from ..operators import extract as X
from ..operators import search as S
from .bindings import TEXT_LINES_SQL, config_lines, table, text_lines
from .duck import lit, with_lines
from .extract_queries import has_words
from .registry import query

# RE2 wants the flag inside; the fixed patterns carry it already
_SECRET = lit(fv.SECRET_PATTERN)


def _all(pattern: str, group: int) -> str:
    return f"regexp_extract_all(text, {lit(pattern)}, {group})"


def entity_sql(source: str) -> str:
    arm = lambda kind, p, g, conf, col="n": (
        f"select file_id, line_no, trim(text) as text, '{kind}' as type, {col} as name, {conf} as confidence from (select *, unnest({_all(p, g)}) as n from {source})")
    return f"""
_host as (select file_id, arg_min(struct_pack(n := regexp_extract(text, {lit(fv.ENTITY_HOSTNAME)}, 1), l := line_no, t := trim(text)), line_no) as h
  from {source} where regexp_matches(text, {lit(fv.ENTITY_HOSTNAME)}) group by file_id),
_found as (
  {arm('interface', fv.ENTITY_INTERFACE, 1, 0.80)}
  union all {arm('vlan', fv.ENTITY_VLAN, 1, 0.76, "concat('VLAN ', cast(n as int))")} where cast(n as int) between 1 and 4094
  union all {arm('ip_address', fv.ENTITY_IP, 0, 0.65)} where not regexp_matches(n, '(^|[.])0[0-9]') and cast(split_part(n, '.', 1) as int) not between 224 and 239 and n <> '0.0.0.0'
  union all {arm('mac_address', fv.ENTITY_MAC, 0, 0.70)}
  union all {arm('wireless_network', fv.ENTITY_SSID, 1, 0.70, 'trim(n)')}
  union all {arm('credential', fv.SECRET_PATTERN, 1, 0.86)}
  union all select file_id, h.l, h.t, 'device', h.n, 0.82 from _host),
entities as (select distinct file_id, type, name, line_no, regexp_replace(text, {_SECRET}, '\\1=<redacted>', 'g') as source_text, confidence from _found)"""


@query("text_entities_configs", with_lines("""select e.file_id, e.type, e.name, h.h.n as hostname, e.line_no, e.source_text, e.confidence,
  concat(case e.type when 'device' then 'dev' when 'interface' then 'if' when 'vlan' then 'vlan' when 'ip_address' then 'ip' when 'mac_address' then 'mac' when 'wireless_network' then 'ssid' else 'secret' end, '-',
    substr(sha1(case e.type when 'interface' then concat_ws('|', e.file_id, coalesce(h.h.n, ''), e.name) when 'vlan' then concat_ws('|', e.file_id, replace(e.name, 'VLAN ', ''))
      when 'ip_address' then concat_ws('|', e.file_id, e.name, e.line_no) when 'credential' then concat_ws('|', e.file_id, e.line_no, e.name) else concat_ws('|', e.file_id, e.name) end), 1, 10)) as id
from entities e left join _host h on h.file_id = e.file_id""", ctes=entity_sql("config_lines")))
def text_entities_configs(spark, sf):
    return X.text_entities(config_lines(spark, sf)).drop("warnings")


@query("text_entities_documents", f"with {TEXT_LINES_SQL}, {entity_sql('text_lines')} select file_id, type, name, line_no, confidence from entities")
def text_entities_documents(spark, sf):
    return X.text_entities(text_lines(spark, sf)).select("file_id", "type", "name", "line_no", "confidence")


@query("text_redaction", f"""select doc_id, regexp_replace(text, {_SECRET}, '\\1=<redacted>', 'g') as redacted, len(regexp_extract_all(text, {_SECRET})) as secrets from documents""")
def text_redaction(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.redact_secret(F.col("text")).alias("redacted"),
        F.size(F.regexp_extract_all("text", F.lit(fv.SECRET_PATTERN), F.lit(0))).cast("long").alias("secrets"))


_TRIM = r"^[_:\-./]+|[_:\-./]+$"
_STOP = ", ".join(lit(w) for w in fv.STOP_WORDS)
_WORDS = f"""
_w as (select regexp_replace(lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_./:-]{{3,}}'))), '{_TRIM}', '', 'g') as term from documents),
_kw as (select term, count(*) as count from _w where term <> '' and not regexp_full_match(term, '[0-9]+') and term not in ({_STOP}) group by term)"""


@query("text_keyword_counts", f"with {_WORDS} select * from _kw")
def text_keyword_counts(spark, sf):
    return S.keyword_counts(table(spark, sf, "documents"), "text")


@query("text_top_keywords", f"with {_WORDS} select * from _kw order by count desc, term limit 14")
def text_top_keywords(spark, sf):
    return S.top_keywords(table(spark, sf, "documents"), "text", limit=14)


@query("text_category_counts", "select source as category, count(*) as count from documents group by source order by count desc, category limit 12")
def text_category_counts(spark, sf):
    return S.category_counts(table(spark, sf, "documents"), "source", limit=12)


@query("text_character_statistics", """
with _c as (select doc_id, unnest(string_split(text, '')) as ch from documents), _n as (select doc_id, ch, count(*) as n from _c where ch <> '' group by 1, 2),
_t as (select doc_id, sum(n) as chars from _n group by 1)
select n.doc_id, cast(max(chars) as bigint) as chars, round(-sum(n / chars * log2(n / chars)), 4) as entropy from _n n join _t t on t.doc_id = n.doc_id group by n.doc_id""")
def text_character_statistics(spark, sf):
    counts = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").groupBy("doc_id", "ch").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.sum("n").alias("chars"), F.sum(F.col("n") * F.log2("n")).alias("w")).select(
        "doc_id", "chars", F.round(F.log2("chars") - F.col("w") / F.col("chars"), 4).alias("entropy"))


_SIGNS = ", ".join(f"case when regexp_matches(h, '^(..)*{code}') then '{name}' end" for name, code in (("zip", "504B0304"), ("gzip", "1F8B08"), ("bzip2", "425A68"), ("zlib", "789C"), ("xz", "FD377A585A00")))


@query("text_byte_statistics", f"""with d as (select doc_id, hex(encode(text)) as h from documents),
b as (select doc_id, byte, count(*) as n from (select doc_id, unnest(regexp_extract_all(h, '..')) as byte from d) group by 1, 2),
t as (select doc_id, cast(sum(n) as bigint) as bytes, sum(n) filter (byte between '20' and '7E' or byte in ('09', '0A', '0D')) as p, sum(n * log2(n)) as nlogn from b group by 1)
select d.doc_id, coalesce(bytes, 0) as bytes, round(log2(bytes) - nlogn / bytes, 4) as entropy, round(coalesce(p, 0) / bytes, 4) as printable_ratio, concat_ws(',', {_SIGNS}) as signatures
from d left join t on t.doc_id = d.doc_id""")
def text_byte_statistics(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return X.byte_statistics(docs, "doc_id", "content").withColumn("signatures", F.array_join("signatures", ","))


@query("text_printable_runs", r"select doc_id, cast(len(r) as bigint) as runs, cast(list_sum(list_transform(r, lambda s: len(s))) as bigint) as chars from (select doc_id, regexp_extract_all(text, '[ -~\t\r\n]{5,}') as r from documents) where len(r) > 0")
def text_printable_runs(spark, sf):
    # characters outside ASCII become bytes outside the printable range, so runs break at the same places
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return X.printable_runs(docs, "doc_id", "content").groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum(F.length("run")).alias("chars"))


@query("text_visible_hints", f"""select doc_id, array_to_string(list_sort(list_distinct({_all(fv.ENTITY_IP, 0)})), ',') as ips, array_to_string(list_sort(list_distinct({_all(fv.ENTITY_MAC, 0)})), ',') as macs,
  array_to_string(list_sort(list_distinct({_all(fv.FACT_INTERFACE, 0)})), ',') as interfaces, array_to_string(list_sort(list_distinct({_all(fv.ENTITY_VLAN, 1)})), ',') as vlans from documents""")
def text_visible_hints(spark, sf):
    df = X.visible_hints(table(spark, sf, "documents"), "doc_id", "text")
    return df.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("ips", "macs", "interfaces", "vlans")])


@query("text_traits", """select doc_id, case when regexp_matches(lower(text), 'ip routing|router ospf|router eigrp') then 'router_or_l3_switch' when regexp_matches(lower(text), 'switchport|spanning-tree') then 'switch'
    when regexp_matches(lower(text), 'wlan|ssid') then 'wireless' else 'network_device' end as device_type,
  case when contains(lower(text), 'wpa3') then 'wpa3' when contains(lower(text), 'wpa2') then 'wpa2' when contains(lower(text), 'wep') then 'wep' when contains(lower(text), 'open') then 'open' else 'unknown' end as security,
  case when contains(lower(text), 'switchport mode trunk') then 'trunk' when contains(lower(text), 'switchport mode access') then 'access' when contains(lower(text), 'ip address') then 'routed' else 'unknown' end as mode
from documents""")
def text_traits(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", T.device_type_guess(t).alias("device_type"), T.wireless_mode(t).alias("security"), T.interface_mode(t).alias("mode"))


@query("text_reconstructed_commands")
def text_reconstructed_commands(spark, sf):
    """Every order's lines of one item flattened onto one line, then cut into commands again."""
    items = table(spark, sf, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item"),
        F.format_string("junk hostname SW%d interface FastEthernet0/%d switchport access vlan %d end", "l_orderkey", "l_linenumber", (F.col("l_partkey") % 40 + 2)).alias("flat"))
    return X.reconstructed_lines(items, "item", "flat")


@query("text_raw_evidence_documents", f"with {TEXT_LINES_SQL} select file_id, line_no, text from text_lines where {has_words(fv.RAW_EVIDENCE_WORDS)}")
def text_raw_evidence_documents(spark, sf):
    return X.raw_evidence(text_lines(spark, sf))
