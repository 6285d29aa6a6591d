"""JSON documents derived from the part table: walk, facts and typed rows."""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import tree as T
from ..operators import tree_rows as R
from ..session import keep, shared_folder
from ..sources.sinks import write_tagged
from .bindings import spread, table
from .duck import lit, norm
from .registry import query

_VARS = {"p": "p_partkey", "z": "p_size", "v": "p_partkey % 40 + 2", "h": "p_partkey % 250 + 1", "m": "p_partkey % 10 + 10", "b": "p_brand"}
_TEMPLATE = (
    '{"network":{"nodes":[{"id":"n{p}","displayName":"R{p}","deviceType":"Router","model":"M{z}","interfaces":[{"name":"Gi0/{z}","ipv4":{"address":"10.0.{v}.{h}","mask":"255.255.255.0"},'
    '"switchport":{"mode":"access","vlan":{v}}},{"ifName":"Fa0/1","mode":"trunk","allowedVlans":"10,{v}"}]},{"id":"s{p}","hostname":"SW{p}","type":"switch","macAddress":"00:aa:bb:cc:dd:{m}"}],'
    '"links":[{"source":"n{p}","target":"s{p}","sourcePort":"Gi0/{z}","targetPort":"Fa0/1","cableType":"copper"}],"vlans":[{"vlanId":{v},"name":"USERS {v}"},{"vlanId":10}],'
    '"dhcpPools":[{"name":"P{p}","network":"10.0.{v}.0","mask":"255.255.255.0","gateway":"10.0.{v}.1"}],"aclRules":[{"acl":"GUEST","action":"Deny","source":"10.0.{v}.0","destination":"any"}],'
    '"routes":[{"destination":"0.0.0.0","mask":"0.0.0.0","nextHop":"10.0.{v}.254"}],"wlan":[{"ssid":"Corp{z}","security":"wpa2"}]},'
    '"tests":[{"client":"c{p}","target":"10.9.9.{h}","service":"DNS","result":"Blocked","actual_ssid":"Corp{z}","actual_vlan":{v}}],"active":true,"score":{z}.5,"note":null,'
    '"config":"hostname R{p} interface GigabitEthernet0/{z} ip address 10.0.{v}.{h} 255.255.255.0"}'
)


def _concat(template: str = _TEMPLATE) -> str:
    parts = []
    for piece in re.split(r"(\{[pzvhmb]\})", template):
        if re.fullmatch(r"\{[pzvhmb]\}", piece):
            parts.append(f"cast({_VARS[piece[1]]} as string)")
        elif piece:
            parts.append("'" + piece + "'")
    return "concat(" + ", ".join(parts) + ")"


DOC_SQL = f"docs as (select p_partkey as file_id, {_concat()} as j from part)"
NODE_SQL = f"""{DOC_SQL},
_n as (select d.file_id, t.fullkey as path, t.type as jtype, t.atom as atom, t.key as jkey, t.value as jval from docs d, json_tree(d.j) t),
nodes as (
  select file_id, replace(path, '"', '') as path, len(regexp_extract_all(replace(path, '"', ''), '[.\\[]')) as depth, jval, atom,
    case jtype when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then 'null' when 'BOOLEAN' then 'boolean' when 'VARCHAR' then 'string' when 'DOUBLE' then 'number' else 'integer' end as type from _n),
leaves as (
  select file_id, path, coalesce(list_filter(regexp_split_to_array(path, '[.\\[\\]/]+'), lambda t: t <> '' and t <> '$' and not regexp_full_match(t, '[0-9]+'))[-1], '$') as key, type,
    coalesce(json_extract_string(jval, '$'), '') as value from nodes where type not in ('object', 'array'))"""


def docs(spark, sf, template=_TEMPLATE):
    parts = spread(table(spark, sf, "part"), "p_partkey")
    return T.documents(parts.select(F.col("p_partkey").alias("file_id"), F.expr(_concat(template)).alias("j")), "file_id", "j")


def nodes(spark, sf):
    return keep(T.walk(docs(spark, sf)))


@query("tree_nodes", f"""with {NODE_SQL} select file_id, path, cast(depth as int) as depth, type, cast(case type when 'object' then len(json_keys(jval)) when 'array' then json_array_length(jval) else 0 end as int) as children from nodes""")
def tree_nodes(spark, sf):
    return T.tree_index(nodes(spark, sf)).select("file_id", "path", "depth", "type", "children")


@query("tree_leaves", f"with {NODE_SQL} select * from leaves")
def tree_leaves(spark, sf):
    return leaves(spark, sf)


def _any(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(blob, {lit(w)})" for w in words) + ")"


_TOKEN = "regexp_replace(lower(key), '[^a-z0-9]+', '', 'g')"
_DOTTED = r"(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}"
_CONFIG = r"contains(t, chr(10)) or regexp_matches(t, '^\s*(?:hostname|interface|router|vlan|access-list|ip (?:access-list|route|dhcp|nat|address))\s+\S+\s+\S', 'i')"
FACT_SQL = f"""{NODE_SQL},
_b as (select *, lower(concat(path, ' ', key)) as blob, trim(value) as t from leaves),
kv as (
  select file_id, path, key, type as value_type, value, case when t = '' then 'generic_value'
    when regexp_full_match(t, {lit(_DOTTED)}) or (regexp_matches(t, {lit(fv.ENTITY_IP)}) and {_any(fv.FACT_IP_KEYS)}) then 'ip_address' when regexp_matches(t, {lit(fv.FACT_MAC)}) then 'mac_address'
    when (regexp_matches(t, {lit(fv.FACT_INTERFACE)}) or {_any(fv.FACT_INTERFACE_KEYS)}) and not ({_CONFIG}) then 'interface'
    when regexp_matches(blob, {lit(fv.FACT_VLAN_KEY)}) and try_cast(nullif(regexp_extract(t, '\\b[0-9]{{1,4}}\\b'), '') as int) between 1 and 4094 then 'vlan'
    when (regexp_matches(t, {lit(fv.FACT_CONFIG_LINE)}) or {_any(fv.FACT_CONFIG_KEYS)}) and length(t) > 8 then 'config_or_cli'
    when (regexp_matches({_TOKEN}, {lit(fv.FACT_DEVICE_KEY)}) or {_any(fv.FACT_DEVICE_PATHS)}) and not contains(t, chr(10)) and lower(t) not in ('true', 'false', 'up', 'down', 'on', 'off', 'yes', 'no') then 'device_candidate'
    when regexp_matches(blob, {lit(fv.FACT_LINK_KEY)}) and not contains(t, chr(10)) then 'link_reference' when regexp_matches(t, {lit(fv.FACT_DOMAIN)}) then 'hostname_or_domain' else 'generic_value' end as fact_type from _b),
facts as (
  select file_id, path, key, fact_type, value from kv where fact_type <> 'generic_value'
  union all select file_id, path, key, 'ip_address', unnest(list_distinct(regexp_extract_all(value, {lit(fv.ENTITY_IP)}))) from kv where fact_type = 'config_or_cli'
  union all select file_id, path, key, 'mac_address', lower(unnest(list_distinct(regexp_extract_all(value, {lit(fv.FACT_MAC)})))) from kv where fact_type = 'config_or_cli'
  union all select file_id, path, key, 'interface', unnest(list_distinct(regexp_extract_all(value, {lit(fv.FACT_INTERFACE)}))) from kv where fact_type = 'config_or_cli')"""


@query("tree_key_values", f"with {FACT_SQL} select * from kv")
def tree_key_values(spark, sf):
    return T.key_values(leaves(spark, sf)).drop("confidence")


@query("tree_network_facts", f"with {FACT_SQL} select * from facts")
def tree_network_facts(spark, sf):
    return T.network_facts(T.key_values(leaves(spark, sf))).drop("confidence")


@query("tree_manifest", f"""with {FACT_SQL} select n.file_id, count(*) as total_nodes, count(*) filter (type not in ('object', 'array')) as leaf_values, count(*) filter (type = 'object') as objects,
  count(*) filter (type = 'array') as arrays, max(f.c) as network_facts from nodes n left join (select file_id, count(*) as c from facts group by 1) f on f.file_id = n.file_id group by n.file_id""")
def tree_manifest(spark, sf):
    return T.manifest(R.document_nodes(docs(spark, sf)), T.network_facts(T.key_values(leaves(spark, sf))))


@query("tree_payload_tables", f"""with {NODE_SQL}, _o as (select file_id, regexp_extract(path, '^(.*)\\[[0-9]+\\]$', 1) as path, json_keys(jval) as keys from nodes where type = 'object' and regexp_matches(path, '\\[[0-9]+\\]$')),
_c as (select file_id, path, unnest(keys) as "column" from _o)
select c.file_id, c.path, c."column", count(*) as presence, max(t.n) as rows from _c c join (select file_id, path, count(*) as n from _o group by 1, 2) t on t.file_id = c.file_id and t.path = c.path group by 1, 2, 3""")
def tree_payload_tables(spark, sf):
    return T.payload_tables(R.document_nodes(docs(spark, sf)))


@query("tree_list_contexts", f"""with {NODE_SQL} select list_filter(regexp_split_to_array(path, '[.\\[\\]/]+'), lambda t: t <> '' and t <> '$' and not regexp_full_match(t, '[0-9]+'))[-1] as key,
  cast(sum(json_array_length(jval)) as bigint) as total from nodes where type = 'array' group by 1""")
def tree_list_contexts(spark, sf):
    return T.list_contexts(nodes(spark, sf))


def leaves(spark, sf):
    return R.document_leaves(docs(spark, sf))


def recs(spark, sf):
    return R.document_records(docs(spark, sf))


_V, _H = "p_partkey % 40 + 2", "p_partkey % 250 + 1"


@query("tree_devices", f"select p_partkey as file_id, concat('R', p_partkey) as id, 'router' as type from part union all select p_partkey, concat('SW', p_partkey), 'switch' from part")
def tree_devices(spark, sf):
    return T.devices(recs(spark, sf)).select("file_id", "id", "type")


@query("tree_interfaces", f"""select p_partkey as file_id, concat('Gi0/', p_size) as name, {norm("concat('Gi0/', p_size)")} as normalized_name, concat('R', p_partkey) as device, concat('10.0.', {_V}, '.', {_H}) as ip_address,
  concat('10.0.', {_V}, '.0/24') as cidr, 'access' as mode, cast({_V} as varchar) as access_vlan, '' as trunk_allowed_vlans from part
union all select p_partkey, 'Fa0/1', 'FastEthernet0/1', concat('R', p_partkey), null, null, 'trunk', null, case when {_V} = 10 then '10' else concat('10,', {_V}) end from part""")
def tree_interfaces(spark, sf):
    r = keep(recs(spark, sf))
    return T.interfaces(r, T.devices(r)).select("file_id", "name", "normalized_name", "device", "ip_address", "cidr", "mode", "access_vlan", F.array_join("trunk_allowed_vlans", ",").alias("trunk_allowed_vlans"))


@query("tree_links", "select p_partkey as file_id, concat('R', p_partkey) as device, concat('SW', p_partkey) as neighbor, concat('Gi0/', p_size) as local_interface, 'Fa0/1' as remote_interface, 'copper' as platform from part")
def tree_links(spark, sf):
    r = keep(recs(spark, sf))
    return T.links(r, T.devices(r)).drop("path")


@query("tree_vlans", f"""select p_partkey as file_id, '10' as id, 'VLAN_10' as name, '$.network.vlans[1]' as path from part where {_V} <> 10
union all select p_partkey, cast({_V} as varchar), concat('USERS ', {_V}), '$.network.nodes[0].interfaces[0]' from part""")
def tree_vlans(spark, sf):
    return T.vlans(recs(spark, sf))


@query("tree_dhcp_scopes", f"select p_partkey as file_id, concat('P', p_partkey) as name, concat('10.0.', {_V}, '.0') as network, concat('10.0.', {_V}, '.0/24') as cidr, concat('10.0.', {_V}, '.1') as default_gateway from part")
def tree_dhcp_scopes(spark, sf):
    return T.dhcp_scopes(recs(spark, sf)).select("file_id", "name", "network", "cidr", "default_gateway")


@query("tree_acl_rules", f"select p_partkey as file_id, 'GUEST' as acl_name, 'deny' as action, 'ip' as protocol, concat('10.0.', {_V}, '.0') as source, 'any' as destination from part")
def tree_acl_rules(spark, sf):
    return T.acl_rules(recs(spark, sf)).drop("path", "sequence")


# a pool with a gateway is a route too
@query("tree_routes", f"""select p_partkey as file_id, '0.0.0.0' as destination, '0.0.0.0/0' as cidr, concat('10.0.', {_V}, '.254') as next_hop from part
union all select p_partkey, concat('10.0.', {_V}, '.0'), concat('10.0.', {_V}, '.0/24'), concat('10.0.', {_V}, '.1') from part""")
def tree_routes(spark, sf):
    return T.routes(recs(spark, sf)).select("file_id", "destination", "cidr", "next_hop")


@query("tree_wireless_hints", """select p_partkey as file_id, '$.network.wlan[0]' as path, 'ssid' as type, concat('Corp', p_size) as value, 'wpa2' as security, cast(null as varchar) as vlan from part""")
def tree_wireless_hints(spark, sf):
    return T.wireless_hints(recs(spark, sf))


@query("tree_endpoints", f"""with e as (
  select p_partkey as file_id, '$.network.nodes[1]' as path, concat('SW', p_partkey) as device, null as ip_address, concat('00:aa:bb:cc:dd:', p_partkey % 10 + 10) as mac, null as vlan, true as has_mac from part
  union all select p_partkey, '$.network.nodes[0].interfaces[0]', concat('Gi0/', p_size), concat('10.0.', {_V}, '.', {_H}), null, cast({_V} as varchar), false from part
  union all select p_partkey, '$.network.nodes[0].interfaces[0].ipv4', null, concat('10.0.', {_V}, '.', {_H}), null, null, false from part)
select *, cast(null as varchar) as interface from e""")
def tree_endpoints(spark, sf):
    return T.endpoints(recs(spark, sf))


@query("tree_inventory_facts", """select p_partkey as file_id, '$.network.nodes[0]' as path, concat('R', p_partkey) as device, concat('M', p_size) as model, cast(null as varchar) as serial, cast(null as varchar) as version from part
union all select p_partkey, '$.network.nodes[1]', concat('SW', p_partkey), 'switch', null, null from part""")
def tree_inventory_facts(spark, sf):
    return T.inventory_facts(recs(spark, sf))


@query("tree_access_tests", f"""select p_partkey as file_id, concat('c', p_partkey) as client, concat('10.9.9.', {_H}) as target, 'DNS' as service, 'failed' as result, concat('Corp', p_size) as actual_ssid, cast({_V} as varchar) as actual_vlan from part""")
def tree_access_tests(spark, sf):
    return T.access_tests(recs(spark, sf)).select("file_id", "client", "target", "service", "result", "actual_ssid", "actual_vlan")


_LAB = (
    '{"results":[{"client":"c{p}","target":"10.9.9.{h}","service":"DNS","result":"Blocked","ssid":"Corp{z}","vlan":{v},"ip":"10.0.{v}.{h}","ap":"AP{m}"},'
    '{"client":"c{p}","resource":"portal","result":"OK","ssid":"Corp{z}","vlan":{v}},{"event":"roaming","client":"c{p}","target":"AP9","details":"moved {z}"}]}'
)


@query("tree_lab_tables", f"""with p as (select p_partkey as file_id, concat('c', p_partkey) as c, concat('Corp', p_size) as s, cast({_V} as varchar) as v, concat('10.0.', {_V}, '.', {_H}) as ip, concat('10.9.9.', {_H}) as t,
  concat('AP', p_partkey % 10 + 10) as ap, concat('moved ', p_size) as d from part)
select file_id, 'devices' as "table", '$.results[0]' as path, 'endpoint' as kind, c as name, null as device, null as ip_address, null as ssid, null as vlan, null as ap_name, null as target, null as status, null as detail from p
union all select file_id, 'devices', '$.results[0]', 'access_point', ap, null, null, null, null, null, null, null, null from p
union all select file_id, 'devices', '$.results[0]', 'service', t, null, t, null, null, null, null, null, 'DNS' from p
union all select file_id, 'endpoint_inventory', '$.results[0]', null, c, null, ip, s, v, ap, null, null, null from p
union all select file_id, 'endpoint_inventory', '$.results[1]', null, c, null, null, s, v, null, null, null, null from p
union all select file_id, 'endpoint_inventory', '$.results[2]', null, c, null, null, null, null, null, null, null, null from p
union all select file_id, 'ip_inventory', '$.results[0]', null, ip, c, ip, s, v, ap, null, 'observed', null from p
union all select file_id, 'wireless_hints', '$.results[0]', 'access_point', ap, null, null, s, v, null, null, null, null from p
union all select file_id, 'wireless_hints', '$.results[0]', 'ssid', s, null, null, null, v, ap, null, null, null from p
union all select file_id, 'vlans', '$.results[0]', null, v, null, null, null, null, null, null, null, s from p
union all select file_id, 'service_inventory', '$.results[0]', null, 'DNS', null, null, null, null, null, t, null, null from p
union all select file_id, 'service_inventory', '$.results[1]', null, 'portal', null, null, null, null, null, 'portal', null, null from p
union all select file_id, 'roaming_events', '$.results[2]', null, c, null, null, null, null, 'AP9', 'AP9', null, d from p
union all select file_id, 'policy_controls', '$.results[0]', 'Medium', concat(c, ' to DNS'), null, null, s, v, null, t, 'review', concat('did not reach ', t) from p
union all select file_id, 'policy_controls', '$.results[1]', 'Info', concat(c, ' to portal'), null, null, s, v, null, 'portal', 'pass', 'reached portal' from p""")
def tree_lab_tables(spark, sf):
    docs_ = T.documents(table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), F.expr(_concat(_LAB)).alias("j")), "file_id", "j")
    folder = f"{shared_folder(spark).rstrip('/')}/lab-{uuid4().hex}"
    write_tagged(T.lab_rows(T.records(T.walk(docs_))), folder)
    return spark.read.parquet(folder).select("file_id", F.col("table").cast("string"), "path", *T.LAB_COLUMNS)


@query("tree_entities", f"""with e as (select p_partkey as file_id, unnest([
  struct_pack(p := '$.network.dhcpPools[0]', n := concat('P', p_partkey), t := 'route'), struct_pack(p := '$.network.nodes[0]', n := concat('n', p_partkey), t := 'ip_address'),
  struct_pack(p := '$.network.nodes[1]', n := concat('SW', p_partkey), t := 'mac_address'), struct_pack(p := '$.network.vlans[0]', n := concat('USERS ', {_V}), t := 'vlan'),
  struct_pack(p := '$.network.wlan[0]', n := concat('Corp', p_size), t := 'wireless_network'), struct_pack(p := '$.network.nodes[0].interfaces[0]', n := concat('Gi0/', p_size), t := 'vlan'),
  struct_pack(p := '$.network.nodes[0].interfaces[0].switchport', n := cast({_V} as varchar), t := 'vlan')]) as e from part)
select file_id, e.p as path, e.n as name, e.t as type, 0.74 as confidence from e""")
def tree_entities(spark, sf):
    return T.generic_entities(recs(spark, sf))


# every record two wrappers deep, under the device that holds it
_NESTED = (
    '{"site":{"devices":[{"properties":{"config":{"hostname":"R{p}","deviceType":"router"}},"metadata":[{"key":"serialNumber","value":"S{p}"},{"key":"model","value":"M{z}"}],'
    '"ports":[{"attributes":{"data":{"ifName":"Gi0/{z}"}},"portConfig":{"ipv4":{"address":"10.0.{v}.{h}","mask":"255.255.255.0"},"switchport":{"mode":"Access","accessVlan":{v}}}}],'
    '"dhcp":[{"settings":{"params":{"name":"P{p}","network":"10.0.{v}.0","mask":"255.255.255.0","gateway":"10.0.{v}.1"}}}],"acl":[{"data":{"meta":{"aclName":"GUEST","action":"Deny","source":"10.0.{v}.0"}}}],'
    '"routes":[{"config":{"details":{"destination":"0.0.0.0","mask":"0.0.0.0","nextHop":"10.0.{v}.254"}}}],"nat":[{"props":{"params":{"inside":"10.0.{v}.5","outside":"203.0.113.{h}"}}}],'
    '"vlans":[{"attributes":{"properties":{"vlanId":{v},"vlanName":"USERS {v}"}}}],"wlan":[{"settings":{"data":{"ssid":"Corp{z}","security":"wpa2"}}}]}]}}'
)


def nested(spark, sf):
    r = keep(R.document_records(docs(spark, sf, _NESTED)))
    return r, keep(T.devices(r))


@query("tree_nat_rules", f"select p_partkey as file_id, concat('10.0.', {_V}, '.5') as inside, concat('203.0.113.', {_H}) as outside, concat('R', p_partkey) as device from part")
def tree_nat_rules(spark, sf):
    r, d = nested(spark, sf)
    return T.first_of(T.with_device(T.nat_rules(r), d).filter("inside is not null and outside is not null"), "inside", "outside").select("file_id", "inside", "outside", "device")


@query("tree_nested_records", f"""with p as (select p_partkey as file_id, concat('R', p_partkey) as r, p_size as z, {_V} as v, {_H} as h from part)
select file_id, 'device' as kind, r as name, 'router' as value, r as device from p
union all select file_id, 'interface', concat('Gi0/', z), concat('10.0.', v, '.0/24 access ', v), r from p union all select file_id, 'dhcp', concat('P', file_id), concat('10.0.', v, '.0/24 10.0.', v, '.1'), r from p
union all select file_id, 'acl', 'GUEST', concat('deny 10.0.', v, '.0 any'), r from p union all select file_id, 'route', '0.0.0.0', concat('0.0.0.0/0 10.0.', v, '.254'), r from p
union all select file_id, 'route', concat('10.0.', v, '.0'), concat('10.0.', v, '.0/24 10.0.', v, '.1'), r from p
union all select file_id, 'vlan', cast(v as varchar), concat('USERS ', v), r from p union all select file_id, 'ssid', concat('Corp', z), 'wpa2', r from p
union all select file_id, 'inventory', r, concat('M', z, ' S', file_id), r from p""")
def tree_nested_records(spark, sf):
    r, d = nested(spark, sf)

    def of(kind, rows, name, *value):
        return T.first_of(T.with_device(rows, d) if "device" not in rows.columns else rows, name).select(
            "file_id", F.lit(kind).alias("kind"), F.col(name).alias("name"), F.concat_ws(" ", *value).alias("value"), "device")

    inventory = T.inventory_facts(r).filter("model is not null and serial is not null")
    parts = [of("device", d.withColumn("device", F.col("id")), "id", "type"), of("interface", T.interfaces(r, d).filter("cidr is not null and access_vlan is not null"), "name", "cidr", "mode", "access_vlan"),
             of("dhcp", T.dhcp_scopes(r).filter("cidr is not null"), "name", "cidr", "default_gateway"), of("acl", T.acl_rules(r), "acl_name", "action", "source", "destination"),
             of("route", T.routes(r).filter("cidr is not null and next_hop is not null"), "destination", "cidr", "next_hop"), of("vlan", T.vlans(r), "id", "name"), of("ssid", T.wireless_hints(r).filter("type = 'ssid'"), "value", "security"),
             of("inventory", inventory, "device", "model", "serial")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("tree_embedded_configs", f"select p_partkey as file_id, '$.config' as path, 'text' as encoding, concat('hostname R', p_partkey, ' interface GigabitEthernet0/', p_size, ' ip address 10.0.', {_V}, '.', {_H}, ' 255.255.255.0') as text from part")
def tree_embedded_configs(spark, sf):
    return T.embedded_configs(leaves(spark, sf))


@query("tree_schema_map", f"""with n as (select count(*) as n, count(*) filter ({_V} <> 10) as other from part)
select object_type, path, "count", rank from (
  select 'cdp_links' as object_type, '$.network.links[]' as path, n as "count", 1 as rank from n union all select 'devices', '$.network.nodes[]', 2 * n, 1 from n
  union all select 'interfaces', '$.network.nodes[].interfaces[]', 2 * n, 1 from n union all select 'vlans', '$.network.nodes[].interfaces[]', n, 1 from n union all select 'vlans', '$.network.vlans[]', other, 2 from n)""")
def tree_schema_map(spark, sf):
    r = keep(recs(spark, sf))
    plain = lambda df, kind: df.select(F.lit(kind).alias("object_type"), F.regexp_replace("path", r"\[\d+\]", "[]").alias("path"))
    d = keep(T.devices(r))
    return T.schema_map(plain(d, "devices").unionByName(plain(T.interfaces(r, d), "interfaces")).unionByName(plain(T.links(r, d), "cdp_links")).unionByName(plain(T.vlans(r), "vlans")))
