"""Network tables extracted from configuration and show-output lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import extract as X
from .bindings import config_lines
from .duck import block_cte, lit, m, net_cidr, norm, redact, states_cte, vlan_text, with_lines, x, xe
from .registry import query


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return config_lines(spark, sf)


def annotated(spark: SparkSession, sf: str, *states: str) -> DataFrame:
    return X.annotate(config_lines(spark, sf), list(states))


def with_states(spark: SparkSession, sf: str, *states: str, uses: str | None = None) -> DataFrame:
    return X.state_lines(config_lines(spark, sf), *states, uses=uses)


def few_lines(spark: SparkSession, sf: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Block lines of a kind with their state, and the lines that its table reads, from one reading of the source."""
    few = X.block_source(lines(spark, sf), kind)
    return X.block_lines(few, kind), few


def blocks(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    return X.block_lines(config_lines(spark, sf), *kinds)


def flat(df: DataFrame) -> DataFrame:
    """Evidence as plain columns, lists as texts."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if f.name == "evidence":
            cols += [F.col("evidence.source_line").alias("evidence_line"), F.round("evidence.confidence", 2).alias("confidence")]
        elif kind == "array":
            cols.append(F.array_join(f.name, ",").alias(f.name))
        elif f.name in ("parsed", "error_evidence"):
            continue
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


EVL = "cast(line_no as bigint) as evidence_line"
S = "trim(text)"


@query("extract_devices", with_lines(f"""
select file_id, id, id as hostname,
  case when rank = 1 then 'neighbor' when {m('(^R[0-9]+|router)', 'id')} then 'router' when {m('(^SW[0-9]+|switch)', 'id')} then 'switch' else 'device' end as type,
  case when rank = 1 then 'cdp_neighbor' else 'network_device' end as role, evidence_line, case when rank = 1 then 0.82 else 0.98 end as confidence
from (
  select file_id, {x(r'^\s*hostname\s+(\S+)')} as id, {EVL}, 0 as rank from config_lines where {m(r'^\s*hostname\s+(\S+)')}
  union all
  select file_id, id, min(line_no), 1 from (select file_id, trim({x(fv.CDP_DEVICE)}) as id, line_no from config_lines where {m(fv.CDP_DEVICE)}) c
  where not exists (select 1 from config_lines h where h.file_id = c.file_id and {x(r'^\s*hostname\s+(\S+)', col='h.text')} = c.id)
  group by file_id, id)"""))
def extract_devices(spark, sf):
    return flat(X.devices(X.needed_lines(lines(spark, sf), "devices")))


@query("extract_vlans", with_lines(f"""
select file_id, id, arg_min(name, pl) as name, arg_min(source, pl) as source, arg_min(line, pl) as evidence_line, arg_min(conf, pl) as confidence from (
  select *, prio * 1000000000 + line as pl from (
    select file_id, id, coalesce(arg_max(name, hl), concat('VLAN_', id)) as name, 'running-config vlan block' as source,
      coalesce(arg_max(nl, hl), max(hl)) as line, 0.96 as conf, 0 as prio
    from (
      select file_id, id, hl, arg_max(nm, line_no) as name, max(case when nm is not null then line_no end) as nl
      from (select file_id, hl, line_no, {x(r'^\s*vlan\s+([0-9]+)', col='ht')} as id, trim({x(r'^\s*name\s+(.+)')}) as nm from blk)
      group by file_id, id, hl)
    group by file_id, id
    union all
    select file_id, {x(fv.VLAN_ROW, 1)}, {x(fv.VLAN_ROW, 2)}, 'show vlan brief', line_no, 0.88, 1 from config_lines
      where {m(fv.VLAN_ROW)} and cast({x(fv.VLAN_ROW, 1)} as int) <= 4094
    union all
    select file_id, {x(r'encapsulation\s+dot1q\s+([0-9]+)')}, concat('VLAN_', {x(r'encapsulation\s+dot1q\s+([0-9]+)')}), 'dot1q subinterface hint', line_no, 0.78, 2
      from config_lines where {m(r'encapsulation\s+dot1q\s+([0-9]+)')}))
group by file_id, id""", ctes=block_cte("blk", "vlan")))
def extract_vlans(spark, sf):
    return flat(X.vlans(*few_lines(spark, sf, "vlan"))).drop("status", "ports_hint")


_IFNAME = x(r"^\s*interface\s+(\S+)", col="ht")
_IP = r"^\s*ip address\s+(\S+)\s+(\S+)"
_AG = r"^\s*ip access-group\s+(\S+)\s+(in|out)"
_LAST = lambda e: f"arg_max({e}, line_no)"
INTERFACE_CTES = block_cte("blk", "interface") + f""",
_if as (
  select file_id, hl as line, max(ht) as ht, {_LAST('trim(' + x(r'^\s*description\s+(.+)') + ')')} as description,
    {_LAST(x(_IP, 1))} as ip_address, {_LAST(x(_IP, 2))} as subnet_mask, {_LAST('lower(' + x(r'^\s*switchport mode\s+(\S+)') + ')')} as sw,
    {_LAST(x(r'^\s*switchport access vlan\s+([0-9]+)'))} as access_vlan, {_LAST(x(r'^\s*switchport trunk allowed vlan\s+(.+)'))} as tr,
    {_LAST(x(r'^\s*switchport trunk native vlan\s+([0-9]+)'))} as native_vlan, {_LAST(x(r'^\s*encapsulation\s+dot1q\s+([0-9]+)'))} as dot1q_vlan,
    {_LAST(f"case when lower({x(_AG, 2)}) = 'in' then {x(_AG, 1)} end")} as acl_in, {_LAST(f"case when lower({x(_AG, 2)}) = 'out' then {x(_AG, 1)} end")} as acl_out,
    {_LAST('lower(' + x(r'^\s*ip nat\s+(inside|outside)') + ')')} as nat_role,
    bool_or({m(r'^\s*switchport\s+port-security\s*$')}) as ps, bool_or({m(r'^\s*switchport\s+port-security\s+mac-address\s+sticky')}) as sticky,
    {_LAST(x(r'^\s*switchport\s+port-security\s+maximum\s+([0-9]+)'))} as port_security_max,
    {_LAST('lower(' + x(r'^\s*switchport\s+port-security\s+violation\s+(\S+)') + ')')} as port_security_violation,
    bool_or({m(r'^\s*shutdown\s*$')}) as shutdown
  from blk group by file_id, hl),
_named as (select *, {_IFNAME} as name from _if),
interfaces as (
  select file_id, name, {norm('name')} as normalized_name, coalesce(description, '') as description, ip_address, subnet_mask,
    {net_cidr('ip_address', 'subnet_mask')} as cidr,
    coalesce(sw, case when dot1q_vlan is not null then 'routed-subinterface' when access_vlan is not null then 'access' when tr is not null then 'trunk'
      when ip_address is not null then 'routed' else 'unknown' end) as mode,
    access_vlan, coalesce({vlan_text('tr')}, '') as trunk_allowed_vlans, native_vlan, dot1q_vlan, acl_in, acl_out, nat_role,
    ps or sticky as port_security_enabled, port_security_max, port_security_violation, sticky as port_security_sticky, shutdown,
    'running-config' as source, line as evidence_line, 0.95 as confidence from _named
  union all
  select file_id, name, {norm('name')}, 'show interfaces trunk hint', null, null, null, 'trunk', null, '', null, null, null, null, null, false, null, null, false, false,
    'show interfaces trunk', line, 0.72
  from (select file_id, {x(fv.TRUNK_ROW)} as name, min(line_no) as line from config_lines
        where {m(fv.TRUNK_ROW)} and text not like '%Port%' and text not like '%Vlans%' and {m(fv.PORT_PREFIX, x(fv.TRUNK_ROW))} group by 1, 2) t
  where not exists (select 1 from _named n where n.file_id = t.file_id and n.name = t.name))"""


@query("extract_interfaces", with_lines("select * from interfaces", ctes=INTERFACE_CTES))
def extract_interfaces(spark, sf):
    few = X.block_source(lines(spark, sf), "interface")
    return flat(X.interfaces(X.block_lines(few, "interface"), few))


@query("extract_interface_lines", with_lines(
    f"select file_id, hl as header_line, {_IFNAME} as interface, line_no, text from blk where line_no > hl", ctes=block_cte("blk", "interface")))
def extract_interface_lines(spark, sf):
    return X.interface_line_map(annotated(spark, sf, "blk_interface"))


_EX = r"^\s*ip dhcp excluded-address\s+(\S+)(?:\s+(\S+))?"


@query("extract_dhcp_excluded", with_lines(
    f'select file_id, {x(_EX, 1)} as "start", coalesce({x(_EX, 2)}, {x(_EX, 1)}) as "end", {EVL}, 0.94 as confidence from config_lines where {m(_EX)}'))
def extract_dhcp_excluded(spark, sf):
    return flat(X.dhcp_excluded(lines(spark, sf)))


_NET = r"^\s*network\s+(\S+)\s+(\S+)"
DHCP_CTES = block_cte("dblk", "dhcp") + f""",
_dhcp as (
  select file_id, hl, max(ht) as ht, {_LAST(x(_NET, 1))} as network, {_LAST(x(_NET, 2))} as mask,
    {_LAST("split_part(trim(" + x(r'^[ ]*default-router[ ]+(.+)') + "), ' ', 1)")} as default_gateway,
    {_LAST("replace(trim(" + x(r'^[ ]*dns-server[ ]+(.+)') + "), ' ', ',')")} as dns, {_LAST('trim(' + x(r'^[ ]*domain-name[ ]+(.+)') + ')')} as domain_name
  from dblk group by file_id, hl),
dhcp_scopes as (
  select file_id, {x(r'^[ ]*ip dhcp pool[ ]+([^ ]+)', col='ht')} as name, network, mask, {net_cidr('network', 'mask')} as cidr, default_gateway,
    coalesce(dns, '') as dns_servers, domain_name, hl as evidence_line, 0.95 as confidence from _dhcp)"""


@query("extract_dhcp_scopes", with_lines("select * from dhcp_scopes", ctes=DHCP_CTES))
def extract_dhcp_scopes(spark, sf):
    return flat(X.dhcp_scopes(blocks(spark, sf, "dhcp")))


_NUM = r"^\s*access-list\s+(\S+)\s+(permit|deny)\s+(.+)"
_RULE = r"^\s*(?:([0-9]+)\s+)?(permit|deny)\s+(.+)"
_AHEAD = r"^\s*ip access-list\s+(standard|extended)\s+(\S+)"
ACL_CTES = block_cte("ablk", "acl") + f""",
acl_rules as (
  select file_id, {x(_NUM, 1)} as acl_name,
    case when try_cast({x(_NUM, 1)} as bigint) between 100 and 199 or try_cast({x(_NUM, 1)} as bigint) between 2000 and 2699 or try_cast({x(_NUM, 1)} as bigint) is null
      then 'extended' else 'standard' end as type,
    cast(null as varchar) as sequence, lower({x(_NUM, 2)}) as action, trim({x(_NUM, 3)}) as expression, line_no as evidence_line, 0.94 as confidence
  from config_lines where {m(_NUM)}
  union all
  select file_id, {x(_AHEAD, 2, 'ht')}, lower({x(_AHEAD, 1, 'ht')}), {x(_RULE, 1)}, lower({x(_RULE, 2)}), trim({x(_RULE, 3)}), line_no, 0.92
  from ablk where line_no > hl and {m(_RULE)})"""


@query("extract_acl_rules", with_lines("select * from acl_rules", ctes=ACL_CTES))
def extract_acl_rules(spark, sf):
    return flat(X.acl_rules(*few_lines(spark, sf, "acl")))


# the rule's words one after the other: protocol, then twice an address of one word (any), of host and a word, or of a word
# and perhaps a wildcard, then what is left
_WORDS = f"""_w as (select *, string_split_regex(trim(expression), '\\s+') as t from acl_rules),
_1 as (select *, case when t[2] is null then 2 when lower(t[2]) = 'any' then 3 when lower(t[2]) = 'host' and t[3] is not null or regexp_full_match(coalesce(t[3], ''), {lit(fv.IPV4)}) then 4 else 3 end as i from _w),
_2 as (select *, case when t[i] is null then i when lower(t[i]) = 'any' then i + 1 when lower(t[i]) = 'host' and t[i + 1] is not null or regexp_full_match(coalesce(t[i + 1], ''), {lit(fv.IPV4)}) then i + 2 else i + 1 end as j from _1)"""


def _side(i: str) -> tuple[str, str]:
    a, b = f"t[{i}]", f"t[{i} + 1]"
    host = f"lower({a}) = 'host' and {b} is not null"
    return f"case when lower({a}) = 'any' then 'any' when {host} then {b} else {a} end", f"case when lower({a}) = 'any' then null when {host} then 'host' when regexp_full_match({b}, {lit(fv.IPV4)}) then {b} end"


@query("extract_acl_expressions", with_lines(f"""
select file_id, evidence_line, acl_name, case when type = 'extended' then t[1] end as protocol,
  case when type = 'standard' then t[1] else {_side('2')[0]} end as src, case when type = 'standard' then t[2] else {_side('2')[1]} end as src_wildcard,
  case when type = 'extended' then {_side('i')[0]} end as dst, case when type = 'extended' then {_side('i')[1]} end as dst_wildcard,
  case when type = 'extended' then t[j] end as operator, case when type = 'extended' then t[j + 1] end as port from _2""", ctes=f"{ACL_CTES}, {_WORDS}"))
def extract_acl_expressions(spark, sf):
    return X.acl_rules(*few_lines(spark, sf, "acl")).select(
        "file_id", F.col("evidence.source_line").alias("evidence_line"), "acl_name", "parsed.protocol", F.col("parsed.source").alias("src"),
        F.col("parsed.source_wildcard").alias("src_wildcard"), F.col("parsed.destination").alias("dst"),
        F.col("parsed.destination_wildcard").alias("dst_wildcard"), "parsed.operator", "parsed.port")


_RT = r"^\s*ip route\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+(.+))?"


@query("extract_static_routes", with_lines(f"""
select *, {net_cidr('destination', 'mask')} as cidr from (
  select file_id, 'static' as type, {x(_RT, 1)} as destination, {x(_RT, 2)} as mask, {x(_RT, 3)} as next_hop, coalesce({x(_RT, 4)}, '') as extra, {EVL},
    0.94 as confidence from config_lines where {m(_RT)})"""))
def extract_static_routes(spark, sf):
    return flat(X.static_routes(lines(spark, sf)))


_RP = r"^\s*router\s+(ospf|eigrp|rip|bgp)\s+(.+)?"


@query("extract_routing_protocols", with_lines(
    f"select file_id, lower({x(_RP, 1)}) as protocol, trim(coalesce({x(_RP, 2)}, '')) as process, {EVL}, 0.9 as confidence from config_lines where {m(_RP)}"))
def extract_routing_protocols(spark, sf):
    return flat(X.routing_protocols(lines(spark, sf)))


@query("extract_nat_rules", with_lines(
    rf"select file_id, trim(text) as expression, {EVL}, 0.88 as confidence from config_lines where {m(r'^\s*ip nat\b')}"))
def extract_nat_rules(spark, sf):
    return flat(X.nat_rules(lines(spark, sf)))




_CDP_STATES = states_cte("st_cdp", {
    "dl": f"case when {m(fv.CDP_DEVICE)} then line_no end", "dt": f"case when {m(fv.CDP_DEVICE)} then text end"})
BINDINGS_SQL_CDP = _CDP_STATES + f""",
cdp_links as (
select file_id, arg_max(neighbor, o) as neighbor, arg_max(row_local, o)['v'] as local_interface, arg_max(row_remote, o)['v'] as remote_interface,
  arg_max(row_platform, o)['v'] as platform, arg_max(capabilities, o) as capabilities, arg_max(source, o) as source,
  arg_max(line, o) as evidence_line, arg_max(conf, o) as confidence
from (
  select *, struct_pack(v := l) as row_local, struct_pack(v := r) as row_remote, struct_pack(v := platform) as row_platform,
    rank * 1000000000 + line as o, {norm('l')} as nl, {norm('r')} as nr
  from (
    select file_id, trim({x(fv.CDP_DEVICE, col='max(dt)')}) as neighbor, arg_max(trim({x(fv.CDP_PORTS, 1)}), line_no) as l,
      arg_max(trim({x(fv.CDP_PORTS, 2)}), line_no) as r, arg_max(trim({x(fv.CDP_PLATFORM)}), line_no) as platform,
      null as capabilities, null as source, dl as line, 0.82 as conf, 0 as rank from st_cdp where dl is not null group by file_id, dl
    union all
    select file_id, {x(fv.CDP_TABLE_ROW, 1)}, replace({x(fv.CDP_TABLE_ROW, 2)}, ' ', ''), replace({x(fv.CDP_TABLE_ROW, 5)}, ' ', ''), {x(fv.CDP_TABLE_ROW, 4)},
      trim({x(fv.CDP_TABLE_ROW, 3)}), 'show_cdp_neighbors_table', line_no, 0.78, 1 from config_lines
    where {m(fv.CDP_TABLE_ROW)} and not {m(fv.CDP_TABLE_HEADER)}))
group by file_id, neighbor, nl, nr)"""


@query("extract_cdp_links", with_lines("select * from cdp_links", ctes=BINDINGS_SQL_CDP))
def extract_cdp_links(spark, sf):
    few = X.needed_lines(lines(spark, sf), "cdp")
    return flat(X.cdp_links(X.state_lines(few, "cdp"), few))


_LD = f"{m(fv.LLDP_DEVICE)} and text not like '%Device ID:%'"


LLDP_CTES = states_cte("st_lldp", {
    "dl": f"case when {_LD} then line_no end", "dt": f"case when {_LD} then text end"}) + f""",
lldp_links as (
select file_id, arg_max(neighbor, line) as neighbor, arg_max(struct_pack(v := l), line)['v'] as local_interface, arg_max(struct_pack(v := r), line)['v'] as remote_interface,
  arg_max(struct_pack(v := platform), line)['v'] as platform, max(line) as evidence_line, arg_max(conf, line) as confidence
from (
  select *, {norm('l')} as nl, {norm('r')} as nr from (
    select file_id, trim({x(fv.LLDP_DEVICE, col='max(dt)')}) as neighbor, arg_max({x(fv.LLDP_LOCAL)}, line_no) as l, arg_max({x(fv.LLDP_REMOTE)}, line_no) as r,
      arg_max(trim({x(fv.LLDP_PLATFORM)}), line_no) as platform, dl as line, 0.78 as conf from st_lldp where dl is not null group by file_id, dl
    union all
    select file_id, {x(fv.LLDP_TABLE_ROW, 1)}, {x(fv.LLDP_TABLE_ROW, 2)}, {x(fv.LLDP_TABLE_ROW, 3)}, 'lldp table', line_no, 0.7 from config_lines
    where {m(fv.LLDP_TABLE_ROW)} and {m(fv.PORT_PREFIX_LLDP, x(fv.LLDP_TABLE_ROW, 2))}))
group by file_id, neighbor, nl, nr)"""


@query("extract_lldp_links", with_lines("select * from lldp_links", ctes=LLDP_CTES))
def extract_lldp_links(spark, sf):
    few = X.needed_lines(lines(spark, sf), "lldp")
    return flat(X.lldp_links(X.state_lines(few, "lldp"), few))


_B = fv.IP_BRIEF_ROW
_BRIEF = f"not {m(fv.IP_BRIEF_HEADER)} and {m(_B)} and {m(fv.L3_PORT_PREFIX, x(_B, 1))}"
_BRIEF_COLS = (f"{x(_B, 1)} as interface, {norm(x(_B, 1))} as normalized_interface, case when lower({x(_B, 2)}) <> 'unassigned' then {x(_B, 2)} end as ip_address, "
               f"lower(trim({x(_B, 3)})) as status, lower({x(_B, 4)}) as protocol")
IP_INVENTORY_CTE = f"ip_inventory as (select file_id, {_BRIEF_COLS}, {EVL}, 0.86 as confidence from config_lines where {_BRIEF})"


@query("extract_ip_inventory", with_lines("select * from ip_inventory", ctes=IP_INVENTORY_CTE))
def extract_ip_inventory(spark, sf):
    return flat(X.ip_inventory(lines(spark, sf)))


_SR = fv.STATUS_ROW
_IS_SR = f"{m(_SR)} and {m(fv.PORT_PREFIX, x(_SR, 1))}"
STATUS_CTE = f"""
interface_status as (
  select file_id, arg_max(interface, line) as interface, normalized_interface, arg_max(name, line) as name, status, arg_max(struct_pack(v := vlan), line)['v'] as vlan,
    arg_max(struct_pack(v := duplex), line)['v'] as duplex, arg_max(struct_pack(v := speed), line)['v'] as speed, arg_max(struct_pack(v := type), line)['v'] as type,
    arg_max(struct_pack(v := ip_address), line)['v'] as ip_address, arg_max(struct_pack(v := protocol), line)['v'] as protocol, max(line) as evidence_line,
    arg_max(conf, line) as confidence
  from (
    select file_id, {x(_SR, 1)} as interface, {norm(x(_SR, 1))} as normalized_interface, trim({xe(_SR, 2)}) as name, lower({x(_SR, 3)}) as status, {x(_SR, 4)} as vlan,
      {x(_SR, 5)} as duplex, {x(_SR, 6)} as speed, trim({xe(_SR, 7)}) as type, null as ip_address, null as protocol, line_no as line, 0.82 as conf
    from config_lines where {_IS_SR}
    union all
    select file_id, interface, normalized_interface, 'ip interface brief', status, null, null, null, null, ip_address, protocol, line_no, 0.76 from (
      select file_id, line_no, {_BRIEF_COLS} from config_lines where {_BRIEF} and not ({_IS_SR})))
  group by file_id, normalized_interface, status, coalesce(vlan, ip_address))"""


@query("extract_interface_status", with_lines("select * from interface_status", ctes=STATUS_CTE))
def extract_interface_status(spark, sf):
    return flat(X.interface_status(X.needed_lines(lines(spark, sf), "interface_status")))


_TV = fv.TRUNK_VLAN_ROW
_HEADING = "(lower(text) like '%vlans allowed on trunk%' or lower(text) like '%vlans allowed and active%' or lower(text) like '%vlans in spanning tree forwarding%')"
_TROW = f"(not {_HEADING} and {m(fv.TRUNK_ROW)} and {m(fv.PORT_PREFIX, x(fv.TRUNK_ROW))})"
_TLIST = f"(not {_HEADING} and not {_TROW} and seen and {m(_TV)} and {m(fv.PORT_PREFIX, x(_TV))})"
_SECT = "(case when section in ('allowed', 'active') then section else 'forwarding' end)"
TRUNK_CTES = states_cte("tst", {
    "section": "case when lower(text) like '%vlans allowed on trunk%' then 'allowed' when lower(text) like '%vlans allowed and active%' then 'active'"
               " when lower(text) like '%vlans in spanning tree forwarding%' then 'forwarding' end",
    "seen": f"case when {_TROW} then true end"}) + f""",
_tports as (
  select file_id, case when {_TROW} then {x(fv.TRUNK_ROW)} else {x(_TV)} end as interface,
    min(case when {_TROW} then line_no end) as rl, min(case when {_TLIST} then line_no end) as sl,
    arg_min(case when {_TROW} then text end, line_no) as rt,
    arg_max(case when {_TLIST} and {_SECT} = 'allowed' then {x(_TV, 2)} end, line_no) as a, arg_max(case when {_TLIST} and {_SECT} = 'active' then {x(_TV, 2)} end, line_no) as b,
    arg_max(case when {_TLIST} and {_SECT} = 'forwarding' then {x(_TV, 2)} end, line_no) as c
  from tst where {_TROW} or {_TLIST} group by 1, 2),
trunk_operational as (
  select file_id, interface, {norm('interface')} as normalized_interface, lower({x(fv.TRUNK_ROW, 2, 'rt')}) as mode, {x(fv.TRUNK_ROW, 3, 'rt')} as encapsulation,
    lower({x(fv.TRUNK_ROW, 4, 'rt')}) as status, trim({x(fv.TRUNK_ROW, 5, 'rt')}) as native_vlan, coalesce({vlan_text('a')}, '') as allowed_vlans,
    coalesce({vlan_text('b')}, '') as active_vlans, coalesce({vlan_text('c')}, '') as forwarding_vlans, coalesce(rl, sl) as evidence_line,
    case when rl is not null then 0.86 else 0.72 end as confidence from _tports
  union all
  select t.file_id, p.interface, {norm('p.interface')}, lower({x(fv.TRUNK_ROW, 2)}), {x(fv.TRUNK_ROW, 3)}, lower({x(fv.TRUNK_ROW, 4)}), trim({x(fv.TRUNK_ROW, 5)}),
    '', '', '', t.line_no, 0.86
  from tst t join _tports p on p.file_id = t.file_id and p.interface = {x(fv.TRUNK_ROW)} and t.line_no > p.rl where {_TROW})"""


@query("extract_trunk_operational", with_lines("select * from trunk_operational", ctes=TRUNK_CTES))
def extract_trunk_operational(spark, sf):
    few = X.needed_lines(lines(spark, sf), "trunk_section", "trunk_seen", once=False)
    return flat(X.trunk_operational(X.state_lines(few, "trunk_section", "trunk_seen")))


_RR = fv.ROUTE_ROW


@query("extract_route_table", with_lines(f"""
select file_id, {x(_RR, 1)} as code, {x(_RR, 2)} as network, {x(_RR, 3)} as prefix, {x(_RR, 4)} as mask, {x(_RR, 7)} as next_hop, {x(_RR, 8)} as out_interface,
  try_cast({x(_RR, 5)} as int) as administrative_distance, try_cast({x(_RR, 6)} as int) as metric, {EVL}, 0.75 as confidence from config_lines where {m(_RR)}"""))
def extract_route_table(spark, sf):
    return flat(X.route_table(lines(spark, sf)))


_OR = fv.OSPF_ROW


@query("extract_ospf_neighbors", with_lines(f"""
select file_id, {x(_OR, 1)} as neighbor_id, cast({x(_OR, 2)} as int) as priority, upper({x(_OR, 3)}) as state, {x(_OR, 4)} as address, {x(_OR, 5)} as interface,
  {norm(x(_OR, 5))} as normalized_interface, {EVL}, 0.8 as confidence from config_lines where {m(_OR)}"""))
def extract_ospf_neighbors(spark, sf):
    return flat(X.ospf_neighbors(lines(spark, sf)))


@query("extract_device_inventory", with_lines(f"""
select file_id, {x(fv.INVENTORY_NAME, 1, 'max(nt)')} as name, {xe(fv.INVENTORY_NAME, 2, 'max(nt)')} as description, arg_max(trim({xe(fv.INVENTORY_PID, 1)}), line_no) as pid,
  arg_max(trim({xe(fv.INVENTORY_PID, 2)}), line_no) as vid, arg_max(trim({xe(fv.INVENTORY_PID, 3)}), line_no) as serial, nl as evidence_line, 0.76 as confidence
from st where nl is not null group by file_id, nl
union all
select file_id, 'chassis', 'show version model', {x(fv.CHASSIS_ROW)}, null, null, line_no, 0.7 from config_lines where {m(fv.CHASSIS_ROW)}""",
    ctes=states_cte("st", {"nl": f"case when {m(fv.INVENTORY_NAME)} then line_no end", "nt": f"case when {m(fv.INVENTORY_NAME)} then text end"})))
def extract_device_inventory(spark, sf):
    few = X.needed_lines(lines(spark, sf), "inventory_name")
    return flat(X.device_inventory(X.state_lines(few, "inventory_name"), few))


_VB = fv.VLAN_BRIEF_ROW
_PORTS = f"list_filter(regexp_split_to_array(trim({xe(_VB, 4)}), '\\s*,\\s*|\\s{{2,}}'), lambda p: trim(p) <> '')"


@query("extract_vlan_brief", with_lines(f"""
select file_id, {x(_VB, 1)} as vlan, trim({x(_VB, 2)}) as name, lower({x(_VB, 3)}) as status,
  coalesce(array_to_string(list_transform({_PORTS}, lambda p: {norm('p')}), ','), '') as ports, trim({xe(_VB, 4)}) as raw_ports, {EVL},
  case when {x(_VB, 1)} in ('1002', '1003', '1004', '1005') then 0.55 when hs then 0.84 else 0.66 end as confidence
from st where {m(_VB)} and not {m(fv.VLAN_BRIEF_HEADER)}""", ctes=states_cte("st", {"hs": f"case when {m(fv.VLAN_BRIEF_HEADER)} then true end"})))
def extract_vlan_brief(spark, sf):
    return flat(X.vlan_brief(with_states(spark, sf, "vlan_header")))


_AH, _CH = fv.ACL_SHOW_HEADER, fv.ACL_CONFIG_HEADER
ACL_HITS_CTES = states_cte("hst", {"acl": f"coalesce({x(_AH, 2)}, {x(_CH, 2)})"}) + f""",
acl_hit_counts as (
  select file_id, acl as acl_name, {x(r'^[ ]*([0-9]+)[ ]+')} as sequence, cast({x(fv.ACL_MATCHES)} as bigint) as matches, trim(text) as line_text, {EVL}, 0.82 as confidence
  from hst where {m(fv.ACL_MATCHES)} and not {m(_AH)} and not {m(_CH)})"""


@query("extract_acl_hit_counts", with_lines("select * from acl_hit_counts", ctes=ACL_HITS_CTES))
def extract_acl_hit_counts(spark, sf):
    return flat(X.acl_hit_counts(with_states(spark, sf, "acl_active")))


_CC = fv.COUNTER_HEADER
_ISC = f"({m(_CC)} and {m(fv.COUNTER_PORT_PREFIX, x(_CC))})"
_NUMB = lambda p, g=1: f"cast({x(p, g)} as bigint)"
COUNTER_CTES = states_cte("cst", {"cl": f"case when {_ISC} then line_no end", "ct": f"case when {_ISC} then text end"}) + f""",
interface_counters as (
  select file_id, {x(_CC, 1, 'max(ct)')} as interface, {norm(x(_CC, 1, 'max(ct)'))} as normalized_interface, lower({x(_CC, 2, 'max(ct)')}) as status,
    lower({x(_CC, 3, 'max(ct)')}) as protocol, coalesce(arg_max({_NUMB(fv.COUNTER_INPUT)}, line_no), 0) as input_errors,
    coalesce(arg_max({_NUMB(fv.COUNTER_OUTPUT)}, line_no), 0) as output_errors, coalesce(arg_max({_NUMB(fv.COUNTER_INPUT, 2)}, line_no), 0) as crc,
    cast(coalesce(sum({_NUMB(fv.COUNTER_DROPS)}), 0) as bigint) as drops, cl as evidence_line, 0.78 as confidence
  from cst where cl is not null group by file_id, cl)"""


@query("extract_interface_counters", with_lines("select * from interface_counters", ctes=COUNTER_CTES))
def extract_interface_counters(spark, sf):
    return flat(X.interface_counters(with_states(spark, sf, "counter")))


@query("extract_stp_root", with_lines(f"""
select file_id, {x(fv.STP_VLAN, 1, 'max(st_)')} as vlan, arg_min(case when line_no > sl then lower({x(fv.STP_ADDRESS)}) end, line_no) as root_bridge,
  arg_max(case when line_no > sl then {x(fv.STP_COST, 2)} end, line_no) as root_port, arg_max(case when line_no > sl then cast({x(fv.STP_COST)} as int) end, line_no) as cost,
  arg_max(case when line_no > sl then cast({x(fv.STP_PRIORITY)} as int) end, line_no) as root_priority, sl as evidence_line, 0.72 as confidence
from st where sl is not null group by file_id, sl""",
    ctes=states_cte("st", {"sl": f"case when {m(fv.STP_VLAN)} then line_no end", "st_": f"case when {m(fv.STP_VLAN)} then text end"})))
def extract_stp_root(spark, sf):
    return flat(X.stp_root(with_states(spark, sf, "stp")))


_SP = fv.STP_ROW


@query("extract_spanning_tree", with_lines(f"""
select file_id, sv as vlan, {x(_SP, 1)} as interface, {norm(x(_SP, 1))} as normalized_interface, {x(_SP, 2)} as role, {x(_SP, 3)} as state, trim({x(_SP, 4)}) as type, {EVL},
  0.8 as confidence from st where {m(_SP)} and {m(fv.PORT_PREFIX, x(_SP, 1))}""",
    ctes=states_cte("st", {"sv": f"case when {m(fv.STP_SECTION)} then regexp_extract(text, '[0-9]+') end"})))
def extract_spanning_tree(spark, sf):
    return flat(X.spanning_tree(with_states(spark, sf, "stp_section")))


_EC = fv.ETHERCHANNEL_ROW


@query("extract_etherchannels", with_lines(f"""
select file_id, {x(_EC, 1)} as "group", {x(_EC, 2)} as port_channel, {norm(x(_EC, 2))} as normalized_port_channel, {x(_EC, 3)} as flags, {x(_EC, 4)} as protocol,
  array_to_string(regexp_extract_all({x(_EC, 5)}, {lit(fv.ETHERCHANNEL_MEMBER)}), ',') as member_ports, trim({x(_EC, 5)}) as raw_members, {EVL}, 0.8 as confidence
from config_lines where {m(_EC)}"""))
def extract_etherchannels(spark, sf):
    return flat(X.etherchannels(lines(spark, sf)))


_MC, _AR = fv.MAC_ROW, fv.ARP_ROW


@query("extract_mac_table", with_lines(f"""
select file_id, {x(_MC, 1)} as vlan, lower({x(_MC, 2)}) as mac, lower({x(_MC, 3)}) as type, {x(_MC, 4)} as interface, {norm(x(_MC, 4))} as normalized_interface, {EVL},
  0.75 as confidence from config_lines where {m(_MC)}"""))
def extract_mac_table(spark, sf):
    return flat(X.mac_table(lines(spark, sf)))


@query("extract_arp_table", with_lines(f"""
select file_id, {x(_AR, 1)} as ip_address, lower({x(_AR, 2)}) as mac, {x(_AR, 3)} as interface, {norm(x(_AR, 3))} as normalized_interface, {EVL}, 0.74 as confidence
from config_lines where {m(_AR)}"""))
def extract_arp_table(spark, sf):
    return flat(X.arp_table(lines(spark, sf)))


_PP = fv.PORT_SECURITY_PORT


@query("extract_port_security", with_lines(f"""
select file_id, normalized_interface, source, arg_max(interface, o) as interface, arg_max(enabled, o) as enabled,
  case when source like 'run%' then arg_max(struct_pack(v := maximum), o)['v'] else arg_max(maximum, o) end as maximum,
  case when source like 'run%' then arg_max(struct_pack(v := violation_mode), o)['v'] else arg_max(violation_mode, o) end as violation_mode,
  arg_max(sticky, o) as sticky, arg_max(violation_count, o) as violation_count, arg_max(last_source, o) as last_source, max(o) as evidence_line, arg_max(conf, o) as confidence
from (
  select file_id, normalized_name as normalized_interface, 'running-config interface' as source, name as interface, port_security_enabled as enabled, port_security_max as maximum,
    port_security_violation as violation_mode, port_security_sticky as sticky, cast(null as bigint) as violation_count, cast(null as varchar) as last_source,
    evidence_line as o, 0.95 as conf from interfaces
  where port_security_enabled or port_security_max is not null or port_security_violation is not null
  union all
  select file_id, {norm(x(_PP, 1, 'max(pt)'))}, 'show port-security', coalesce({x(_PP, 1, 'max(pt)')}, 'unknown'),
    arg_max(lower({x(fv.PORT_SECURITY_STATE)}) = 'enabled', line_no), arg_max({x(fv.PORT_SECURITY_MAX)}, line_no), arg_max(lower({x(fv.PORT_SECURITY_MODE)}), line_no), null,
    arg_max(cast({x(fv.PORT_SECURITY_COUNT)} as bigint), line_no), arg_max({x(fv.PORT_SECURITY_LAST)}, line_no), coalesce(pl, min(line_no)), case when pl is null then 0.78 else 0.82 end
  from pst where pl is not null or seen group by file_id, pl)
group by file_id, normalized_interface, source""", ctes=INTERFACE_CTES + ", " + states_cte("pst", {
    "pl": f"case when {m(_PP)} then line_no end", "pt": f"case when {m(_PP)} then text end", "seen": f"case when {m(fv.PORT_SECURITY_STATE)} then true end"})))
def extract_port_security(spark, sf):
    few = X.needed_lines(lines(spark, sf), "interface", "secure_port", "secure_state")
    return flat(X.port_security(X.state_lines(few, "secure_port", "secure_state"), X.interfaces(X.block_lines(few, "interface"), few)))


def _groups(p: str, g: int, col: str = "text") -> str:
    if g == 0:
        return f"trim({col})"
    return "trim(concat_ws(' ', " + ", ".join(f"regexp_extract({col}, {lit(p)}, {i}, 'i')" for i in range(1, g + 1)) + "))"


def _union(rows: list[str]) -> str:
    return " union all ".join(rows)


@query("extract_protocol_summary", with_lines(_union([
    f"select file_id, '{n}' as protocol, {_groups(p, 1 if n in ('ospf', 'eigrp', 'bgp') else 0)} as value, {EVL}, 0.76 as confidence from config_lines where {m(p)}"
    for n, p in fv.PROTOCOL_PATTERNS])))
def extract_protocol_summary(spark, sf):
    return flat(X.protocol_summary(lines(spark, sf)))


HARDENING_CTES = block_cte("vblk", "vty") + """,
_vty as (
  select file_id, hl, trim(max(ht)) as header, bool_or(lower(text) like '%transport input telnet%' or regexp_matches(lower(text), 'transport\\s+input\\s+all')) as open_,
    bool_or(lower(text) like '%transport input ssh%') as ssh, bool_or(lower(text) like '%telnet%') as telnet, bool_or(lower(text) like '%login local%') as local_
  from vblk where line_no > hl group by file_id, hl),
security_hardening as (""" + _union(
    [f"select file_id, '{n}' as name, '{posture}' as posture, {_groups(p, g)} as value, {EVL}, {c} as confidence from config_lines where {m(p)}"
     for n, p, g, posture, c in fv.HARDENING_PATTERNS]
    + ["select file_id, 'vty_telnet_allowed', 'weak', header, hl, 0.88 from _vty where open_",
       "select file_id, 'vty_ssh_only', 'positive', header, hl, 0.84 from _vty where ssh and not telnet",
       "select file_id, 'vty_login_local', 'positive', header, hl, 0.78 from _vty where local_"]) + ")"


@query("extract_security_hardening", with_lines("select * from security_hardening", ctes=HARDENING_CTES))
def extract_security_hardening(spark, sf):
    few = X.needed_lines(lines(spark, sf), "blk_vty", "hardening")
    return flat(X.security_hardening(X.state_lines(few, "blk_vty"), few))


@query("extract_wireless_hints", with_lines(_union([
    f"select file_id, '{n}' as type, {_groups(p, g)} as value, {EVL}, 0.64 as confidence from config_lines where {m(p)}" for n, p, g in fv.WIRELESS_HINT_PATTERNS])))
def extract_wireless_hints(spark, sf):
    return flat(X.wireless_hints(lines(spark, sf)))


@query("extract_device_facts", with_lines(_union([
    f"select file_id, '{n}' as name, concat_ws(' | ', {', '.join(x(p, i) for i in range(1, g + 1))}) as value, {EVL}, 0.7 as confidence from config_lines where {m(p)}"
    for n, p, g in fv.FACT_PATTERNS])))
def extract_device_facts(spark, sf):
    return flat(X.device_facts(lines(spark, sf)))


def has_words(words: list[str], col: str = "lower(text)") -> str:
    return "(" + " or ".join(f"contains({col}, {lit(w.lower())})" for w in words) + ")"


@query("extract_service_hints", with_lines(_union([
    f"select file_id, '{n}' as name, trim(text) as hint, {EVL}, 0.65 as confidence from config_lines where {has_words(w)}" for n, w in fv.SERVICE_WORDS])))
def extract_service_hints(spark, sf):
    return flat(X.service_hints(lines(spark, sf)))


_PR = fv.PROMPT_ROW


@query("extract_command_blocks", with_lines(f"""
select file_id, trim({x(_PR, 2, 'max(ht)')}) as name, {x(_PR, 1, 'max(ht)')} as device, hl as start_line, max(line_no) as end_line, max(line_no) - hl as line_count,
  hl as evidence_line, 0.7 as confidence from st where hl is not null group by file_id, hl
union all
select file_id, 'single evidence stream', null, 1, max(line_no), count(*), 1, 0.5 from st group by file_id having count(hl) = 0""",
    ctes=states_cte("st", {"hl": f"case when {m(_PR)} then line_no end", "ht": f"case when {m(_PR)} then text end"})))
def extract_command_blocks(spark, sf):
    return flat(X.command_blocks(annotated(spark, sf, "command_start")))


@query("extract_raw_evidence", with_lines(f"select file_id, line_no, text from config_lines where {has_words(fv.RAW_EVIDENCE_WORDS)}"))
def extract_raw_evidence(spark, sf):
    return X.raw_evidence(lines(spark, sf))


_TAGS = "list_filter([" + ", ".join(f"case when {has_words(w)} then '{n}' end" for n, w in fv.EVIDENCE_TAXONOMY) + "], lambda t: t is not null)"


@query("extract_evidence_index", with_lines(f"""
select file_id, line_no, text, array_to_string(tags, ',') as tags, least(1.0, cast(round(0.35 + 0.12 * len(tags), 2) as double)) as weight
from (select *, {_TAGS} as tags from config_lines) where len(tags) > 0"""))
def extract_evidence_index(spark, sf):
    return flat(X.deep_evidence_index(lines(spark, sf)))


_CTX = x(fv.COMMAND_CONTEXT, 1, S)
_CAT = "case " + " ".join(f"when {m(p, S)} then '{n}'" for n, p in fv.COMMAND_CATEGORIES) + " when ctx is not null and regexp_matches(text, '^\\s+[A-Za-z0-9_-]') then 'context_child' end"


@query("extract_config_commands", with_lines(f"""
select file_id, line_no, coalesce(ctx, 'global') as context, category, {redact(S)} as command, length(trim(text)) as raw_length, line_no as evidence_line,
  case when category = 'context_child' then 0.68 else 0.82 end as confidence
from (select *, {_CAT} as category from st where trim(text) not in ('', '!', 'end')) where category is not null""", ctes=states_cte("st", {"ctx": _CTX})))
def extract_config_commands(spark, sf):
    return flat(X.all_config_commands(with_states(spark, sf, "context")))


def _values(p: str, g: int) -> str:
    if g == 0:
        return "'true'"
    return "coalesce(nullif(concat_ws(' ', " + ", ".join(x(p, i, S) for i in range(1, g + 1)) + "), ''), 'true')"


@query("extract_interface_features", with_lines(
    f"select *, {norm('interface')} as normalized_interface, case when feature in ('voice_vlan', 'switchport_allowed_vlan_add') then {vlan_text('value')} end as vlans from ("
    + _union([f"select file_id, {_IFNAME} as interface, '{n}' as feature, {_values(p, g)} as value, {EVL}, 0.84 as confidence from blk where line_no > hl and {m(p, S)}"
              for n, p, g in fv.FEATURE_PATTERNS]) + ")", ctes=block_cte("blk", "interface")))
def extract_interface_features(spark, sf):
    return flat(X.interface_features(with_states(spark, sf, "blk_interface", uses="features")))


_LC = m(r"^line\s+(vty|console|aux)\b", S)


def _management_arm(service: str, p: str, g: int, family: str) -> str:
    value = _values(p, g)
    if service == "snmp_community":
        value = f"concat('<redacted>', regexp_extract({S}, {lit(p)}, 2, 'i'))"
    risk = "'weak'" if service == "http_server" else f"case when lower({value}) like '%telnet%' then 'weak' else 'control' end" if service == "transport_input" else "'control'"
    context = "ctx" if family == "line_access" else "'global'"
    return (f"select file_id, '{service}' as service, '{family}' as family, {context} as context, {value} as value, {redact(S)} as command, {risk} as risk, {EVL}, "
            f"0.82 as confidence from st where not {_LC} and {m(p, S)}")


@query("extract_management_services", with_lines(
    f"select file_id, 'line_context' as service, null as family, {S} as context, {S} as value, null as command, null as risk, {EVL}, 0.78 as confidence from st where {_LC} union all "
    + _union([_management_arm(*row) for row in fv.MANAGEMENT_PATTERNS]), ctes=states_cte("st", {"ctx": f"case when {_LC} then {S} end"})))
def extract_management_services(spark, sf):
    return flat(X.management_services(with_states(spark, sf, "line_context")))


_FH = r"^(standby|vrrp|glbp)\s+([0-9]+)\s+(ip|priority|preempt|track)\s*(.*)"


@query("extract_gateway_redundancy", with_lines(f"""
select file_id, case when lower({x(_FH, 1, S)}) = 'standby' then 'hsrp' else lower({x(_FH, 1, S)}) end as protocol, {_IFNAME} as interface, {norm(_IFNAME)} as normalized_interface,
  {x(_FH, 2, S)} as "group", lower({x(_FH, 3, S)}) as action, coalesce({x(_FH, 4, S)}, 'true') as value, {EVL}, 0.84 as confidence from blk where {m(_FH, S)}""",
    ctes=block_cte("blk", "interface")))
def extract_gateway_redundancy(spark, sf):
    return flat(X.gateway_redundancy(with_states(spark, sf, "blk_interface", uses="redundancy")))


_RH = r"^\s*router\s+(ospf|eigrp|rip|bgp)\s*(.*)"


@query("extract_routing_details", with_lines(f"""
select *, case when type = 'process' then 0.88 when type = 'other' then 0.62 else 0.8 end as confidence from (
  select file_id, lower({x(_RH, 1, 'ht')}) as protocol, nullif(trim({x(_RH, 2, 'ht')}), '') as process, {S} as command, {EVL},
    case when line_no = hl then 'process' when {m('^network[ ]+', S)} then 'network' when {m('^passive-interface[ ]+', S)} then 'passive_interface'
      when {m('^redistribute[ ]+', S)} then 'redistribution' when {m('^neighbor[ ]+', S)} then 'neighbor' when {m('^default-information[ ]+', S)} then 'default_origination' else 'other' end as type
  from blk where {S} not in ('', '!'))""", ctes=block_cte("blk", "router")))
def extract_routing_details(spark, sf):
    return flat(X.routing_protocol_details(with_states(spark, sf, "blk_router")))
