"""Scalar functions as columns over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import net as N
from ..functions import text as T
from .bindings import WIRELESS_SQL, clients, table
from .duck import lit, norm, vlan_text
from .registry import query

_IP = "concat(l_orderkey % 260, '.', l_partkey % 256, '.', l_suppkey % 256, '.', l_linenumber)"
_NUM = "((l_orderkey % 260) * 16777216 + (l_partkey % 256) * 65536 + (l_suppkey % 256) * 256 + l_linenumber)"


def addresses(spark, sf):
    text = F.concat_ws(".", *[c.cast("string") for c in (F.col("l_orderkey") % 260, F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_linenumber"))])
    return table(spark, sf, "lineitem").withColumn("address", text)


@query("function_ip_numbers", f"""select l_orderkey, l_linenumber, address, l_orderkey % 260 < 256 as valid, case when l_orderkey % 260 < 256 then {_NUM} end as number,
  l_orderkey % 260 < 256 and l_orderkey % 260 not between 224 and 239 and address <> '0.0.0.0' as probable, case when l_orderkey % 260 < 256 then address end as back
from (select *, {_IP} as address from lineitem)""")
def function_ip_numbers(spark, sf):
    a = F.col("address")
    return addresses(spark, sf).select(
        "l_orderkey", "l_linenumber", "address", N.looks_like_ip(a).alias("valid"), N.ip_to_long(a).alias("number"), N.probable_ip(a).alias("probable"),
        N.long_to_ip(N.ip_to_long(a)).alias("back"))


_P = "(l_linenumber * 4 + 2)"
_MASKN = f"(4294967296 - (1::bigint << (32 - {_P})))"
_DOT = lambda n: "concat(" + ", '.', ".join(f"({n} >> {s}) & 255" for s in (24, 16, 8, 0)) + ")"


@query("function_network_cidr", f"""select l_orderkey, l_linenumber, address, mask, {_P} as prefix, case when l_orderkey % 260 < 256 then concat({_DOT(f'({_NUM} & {_MASKN})')}, '/', {_P}) end as cidr
from (select *, {_IP} as address, {_DOT(_MASKN)} as mask from lineitem)""")
def function_network_cidr(spark, sf):
    prefix = (F.col("l_linenumber") * 4 + 2).cast("int")
    df = addresses(spark, sf).withColumn("mask", N.long_to_ip(N.prefix_mask(prefix)))
    return df.select("l_orderkey", "l_linenumber", "address", "mask", N.mask_to_prefix(F.col("mask")).alias("prefix"), N.network_cidr(F.col("address"), F.col("mask")).alias("cidr"))


@query("function_ip_in_cidr", f"""with {WIRELESS_SQL}
select name, ip, concat('10.10.', vlan, '.0/24') as cidr, ip <> '' and split_part(ip, '.', 3) = vlan as inside, concat('10.10.', vlan, '.', 1 + least(c_off, 253)) as host
from (select *, cast(right(name, 3) as int) as c_off from clients)""")
def function_ip_in_cidr(spark, sf):
    cidr = F.concat(F.lit("10.10."), F.col("vlan"), F.lit(".0/24"))
    offset = F.expr("cast(right(name, 3) as int)")
    return clients(spark, sf).select("name", "ip", cidr.alias("cidr"), N.ip_in_cidr(F.col("ip"), cidr).alias("inside"), N.nth_host(cidr, offset).alias("host"))


_SHORT = ["Fa0/", "Gi 0/", "Te1/", "Eth", "Po", "Se0/", "Lo", "VLAN", "FastEthernet0/", "mgmt"]
_NAMES = "list_extract([" + ", ".join(lit(s) for s in _SHORT) + "], cast(p_partkey % 10 as int) + 1)"


@query("function_interface_names", f"select p_partkey, raw, {norm('raw')} as normalized from (select p_partkey, concat({_NAMES}, p_size) as raw from part)")
def function_interface_names(spark, sf):
    raw = F.concat(F.get(F.array(*[F.lit(s) for s in _SHORT]), (F.col("p_partkey") % 10).cast("int")), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw"), T.normalize_interface(raw).alias("normalized"))


@query("function_vlan_lists", f"""select p_partkey, raw, {vlan_text('raw')} as vlans, coalesce(regexp_extract(raw, '[0-9]{{1,4}}'), '') as first_digits
from (select p_partkey, case when p_partkey % 9 = 0 then 'all' else concat('add ', p_size, ',', p_size + 3, '-', p_size + 6, ', ', p_partkey % 5, ',x') end as raw from part)""")
def function_vlan_lists(spark, sf):
    raw = F.when(F.col("p_partkey") % 9 == 0, "all").otherwise(F.concat(
        F.lit("add "), F.col("p_size").cast("string"), F.lit(","), (F.col("p_size") + 3).cast("string"), F.lit("-"), (F.col("p_size") + 6).cast("string"), F.lit(", "),
        (F.col("p_partkey") % 5).cast("string"), F.lit(",x")))
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw"), F.array_join(T.expand_vlans(raw), ",").alias("vlans"),
                                           F.coalesce(T.vlan_id(raw), F.lit("")).alias("first_digits"))


@query("function_tokens_and_ids", """select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') as token, concat('part-', substr(sha1(concat_ws('|', p_brand, p_name, p_size)), 1, 10)) as stable_id,
  concat('client-', trim(regexp_replace(lower(p_name), '[^a-z0-9]', '-', 'g'), '-')) as client_id, trim(regexp_replace(upper(p_name), '[^A-Z0-9]', '-', 'g'), '-') as ap_id,
  'Brand' || regexp_extract(p_brand, '[0-9]+') as path_last from part""")
def function_tokens_and_ids(spark, sf):
    name = F.col("p_name")
    path = F.concat(F.lit("$.parts.Brand"), F.regexp_extract("p_brand", "[0-9]+", 0), F.lit("["), F.col("p_size").cast("string"), F.lit("]"))
    return table(spark, sf, "part").select(
        "p_partkey", T.key_token(name).alias("token"), T.stable_id("part", F.col("p_brand"), name, F.col("p_size")).alias("stable_id"),
        T.client_slug(name).alias("client_id"), T.ap_slug(name).alias("ap_id"), T.path_key(path).alias("path_last"))


def _sev(col: str) -> str:
    arms = " ".join("when " + " or ".join(f"contains({col}, {lit(w)})" for w in words) + f" then '{s}'" for s, words in fv.MESSAGE_SEVERITY)
    return f"case {arms} else 'Info' end"


_MSG = "lower(text)"
_TYPE = (f"case when contains({_MSG}, 'auth') and (contains({_MSG}, 'fail') or contains({_MSG}, 'reject') or contains({_MSG}, 'deny')) then 'authentication_failure' "
         f"when contains({_MSG}, 'roam') or contains({_MSG}, 'handoff') then 'roaming' when contains({_MSG}, 'dhcp') or contains({_MSG}, 'lease') then 'dhcp_assignment' "
         f"when contains({_MSG}, 'rogue') then 'rogue_ap' when contains({_MSG}, 'disassoc') or contains({_MSG}, 'deauth') then 'disassociation' else 'association' end")


@query("function_message_classes", f"select conv_id, turn, severity, event_type, case severity when 'Critical' then 95 when 'High' then 75 when 'Medium' then 50 else 10 end as score from (select *, {_sev(_MSG)} as severity, {_TYPE} as event_type from conversations)")
def function_message_classes(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", T.message_severity(t).alias("severity"), T.message_event_type(t).alias("event_type"),
        T.lookup(T.message_severity(t), fv.SEVERITY_SCORE, 10).alias("score"))


@query("function_fingerprints", """select event_id, sha256(concat_ws('|', 'syslog_events', event_id, user_id, event_type)) as connector_fp, sha256(concat_ws('|', event_id, user_id, event_type, '', props)) as live_fp from events""")
def function_fingerprints(spark, sf):
    c = F.col
    return table(spark, sf, "events").select(
        "event_id", T.connector_fingerprint(F.lit("syslog_events"), c("event_id"), c("user_id"), c("event_type")).alias("connector_fp"),
        T.live_fingerprint(c("event_id"), c("user_id"), c("event_type"), F.lit(None), c("props")).alias("live_fp"))


@query("function_percent_and_text", "select event_id, cast(greatest(0, least(100, round_even(case when value / 100 <= 1 then value / 100 * 100 else value / 100 end, 0))) as int) as percent, case when length(props) > 6 then concat(substr(props, 1, 6), '…') else props end as short from events")
def function_percent_and_text(spark, sf):
    return table(spark, sf, "events").select("event_id", T.clamp_percent(F.col("value") / 100).alias("percent"), T.short_text(F.col("props"), 6).alias("short"))
