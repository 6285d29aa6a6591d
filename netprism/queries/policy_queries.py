"""Wired state against wireless policy, over the derived configuration lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.net import network_cidr
from ..operators import extract as X
from ..operators import policy as P
from ..operators import wireless as W
from ..plans.importing import diff_of_lines
from ..session import keep, written
from .bindings import table, CONFIG_LINES_SQL, WIRELESS_SQL, clients, config_lines, ssids, wireless_events
from .duck import block_cte, lit, m, x
from .extract_queries import (
    ACL_CTES, ACL_HITS_CTES, COUNTER_CTES, DHCP_CTES, HARDENING_CTES, INTERFACE_CTES, TRUNK_CTES,
)
from .registry import SQL, query
from .wireless_queries import ACTIONS, ANOMALY_CTES, CHECK_CTES, MATRIX_CTES, all_anomalies

_LINES = f"with {CONFIG_LINES_SQL}"


def _number(ip: str) -> str:
    return " + ".join(f"cast(split_part({ip}, '.', {i + 1}) as bigint) * {256 ** (3 - i)}" for i in range(4))


BINDING_CTE = """
bindings as (
  select file_id, acl_in as acl_name, name as interface, 'in' as direction, evidence_line as binding_line from interfaces where acl_in is not null
  union all select file_id, acl_out, name, 'out', evidence_line from interfaces where acl_out is not null)"""
IFVLAN_CTE = """
ifvlan as (
  select distinct file_id, name, acl_in, acl_out, mode, evidence_line as line, unnest([access_vlan, dot1q_vlan, native_vlan]) as vlan from interfaces),
interface_vlan as (select * from ifvlan where vlan is not null)"""
GATEWAY_CTE = """
gateways as (
  select d.file_id, d.name as pool, d.cidr, d.default_gateway, o.i as matched_interface, o.v as matched_vlan, case when o.i is null then 'unmatched' else 'match' end as status,
    case when o.i is null then 0.42 else 0.93 end as confidence, d.evidence_line
  from dhcp_scopes d left join (select file_id, ip_address, arg_max(name, evidence_line) as i, arg_max(struct_pack(v := coalesce(dot1q_vlan, access_vlan, native_vlan)), evidence_line)['v'] as v
    from interfaces where ip_address is not null group by 1, 2) o on o.file_id = d.file_id and o.ip_address = d.default_gateway)"""
TRUNKV_CTE = """
trunkv as (
  select file_id, name, evidence_line as line, unnest(case when trunk_allowed_vlans = '' then [null] else string_split(trunk_allowed_vlans, ',') end) as vlan
  from interfaces where mode = 'trunk' or trunk_allowed_vlans <> '')"""


def wired(spark, sf):
    return wired_of(X.needed_lines(config_lines(spark, sf), "interface", "dhcp"))


def wired_of(few):
    interfaces, pools = written(X.interfaces(X.block_lines(few, "interface"), few)), written(X.dhcp_scopes(X.block_lines(few, "dhcp")))
    return interfaces, pools, P.match_dhcp_gateways(pools, interfaces)


@query("join_acl_bindings", f"{_LINES}, {INTERFACE_CTES}, {BINDING_CTE} select * from bindings")
def join_acl_bindings(spark, sf):
    return P.acl_bindings(X.interfaces(X.block_lines(config_lines(spark, sf), "interface"), config_lines(spark, sf)))


@query("join_rules_to_interfaces", f"""{_LINES}, {INTERFACE_CTES}, {ACL_CTES}, {BINDING_CTE}
select r.file_id, r.acl_name, r.action, r.sequence, r.evidence_line, coalesce(b.n, 0) as applied_count, coalesce(b.n, 0) > 0 as is_applied, b.i as first_interface
from acl_rules r left join (select file_id, acl_name, count(*) as n, arg_min(interface, (binding_line, direction)) as i from bindings group by 1, 2) b
  on b.file_id = r.file_id and b.acl_name = r.acl_name""")
def join_rules_to_interfaces(spark, sf):
    a, plain = X.block_lines(config_lines(spark, sf), "interface", "acl"), config_lines(spark, sf)
    return P.bind_acls(X.acl_rules(a, plain), X.interfaces(a, plain)).select(
        "file_id", "acl_name", "action", "sequence", F.col("evidence.source_line").alias("evidence_line"), "applied_count", "is_applied",
        F.col("first_binding.interface").alias("first_interface"))


@query("join_dhcp_gateways", f"{_LINES}, {INTERFACE_CTES}, {DHCP_CTES}, {GATEWAY_CTE} select * from gateways")
def join_dhcp_gateways(spark, sf):
    return wired(spark, sf)[2]


@query("join_vlan_interfaces", f"{_LINES}, {INTERFACE_CTES}, {IFVLAN_CTE} select file_id, vlan, name, mode, line from interface_vlan")
def join_vlan_interfaces(spark, sf):
    return P.interface_vlan(wired(spark, sf)[0]).select("file_id", "vlan", "name", "mode", "line")


@query("join_relationships", f"""{_LINES}, {INTERFACE_CTES}, {DHCP_CTES}, {GATEWAY_CTE}, {BINDING_CTE}, {IFVLAN_CTE}, {TRUNKV_CTE}
select file_id, 'interface_vlan' as relation, name as source, vlan as target from interface_vlan
union all select file_id, 'trunk_vlan', name, vlan from trunkv where vlan is not null
union all select file_id, 'acl_interface', acl_name, interface from bindings
union all select file_id, 'dhcp_vlan', pool, matched_vlan from gateways where matched_vlan is not null""")
def join_relationships(spark, sf):
    interfaces, _, gateways = wired(spark, sf)
    return P.relationships(interfaces, gateways)


_DENY = """(r.action = 'deny' and (contains(lower(r.expression), split_part(s.expected_subnet, '/', 1))
  or contains(lower(r.expression), concat(split_part(s.expected_subnet, '.', 1), '.', split_part(s.expected_subnet, '.', 2), '.', split_part(s.expected_subnet, '.', 3), '.'))
  or split_part(r.expression, ' ', 2) = 'any')
  and (contains(lower(r.expression), '10.10.') or contains(lower(r.expression), 'internal')))"""
ISOLATION_CTES = f"""
scopes as (select distinct file_id from config_lines),
_base as (select f.file_id, s.* from scopes f, ssids s),
_iso as (
  select s.file_id, s.ssid, s.expected_vlan, r.acl_name, min(r.evidence_line) as rule_line from _base s join acl_rules r on r.file_id = s.file_id and {_DENY}
  where s.internal_access = 'false' group by 1, 2, 3, 4),
_va as (
  select v.file_id, v.vlan, v.name, v.line, 'in' as direction, v.acl_in as acl_name from interface_vlan v where v.acl_in is not null
  union all select v.file_id, v.vlan, v.name, v.line, 'out', v.acl_out from interface_vlan v where v.acl_out is not null),
_applied as (
  select i.file_id, i.ssid, arg_min(struct_pack(acl := i.acl_name, d := v.direction, n := v.name, l := i.rule_line), (v.line, v.direction, i.rule_line)) as a
  from _iso i join _va v on v.file_id = i.file_id and v.vlan = i.expected_vlan and v.acl_name = i.acl_name group by 1, 2),
_present as (select file_id, ssid, arg_min(struct_pack(acl := acl_name, l := rule_line), rule_line) as p from _iso group by 1, 2),
isolation as (
  select b.file_id, b.ssid, case when a.a is not null then 'Pass' when p.p is not null then 'Review' else 'Fail' end as isolation_status,
    case when a.a is not null then concat('ACL ', a.a.acl, ' is applied ', a.a.d, ' on ', a.a.n, ' and contains a deny rule for guest-to-internal traffic.')
      when p.p is not null then concat('Deny rule exists in ACL ', p.p.acl, ', but no interface binding was confirmed for VLAN ', b.expected_vlan, '.')
      else concat('No applied deny ACL was found for guest VLAN ', b.expected_vlan, '.') end as isolation_reason,
    coalesce(a.a.l, p.p.l) as isolation_line, case when a.a is not null then 0.94 when p.p is not null then 0.62 else 0.78 end as isolation_confidence
  from _base b left join _applied a on a.file_id = b.file_id and a.ssid = b.ssid left join _present p on p.file_id = b.file_id and p.ssid = b.ssid
  where b.internal_access = 'false')"""
_ISO_HEAD = f"with {CONFIG_LINES_SQL}, {WIRELESS_SQL}, {INTERFACE_CTES}, {ACL_CTES}, {IFVLAN_CTE}, {ISOLATION_CTES}"


@query("join_guest_isolation", f"{_ISO_HEAD} select * from isolation")
def join_guest_isolation(spark, sf):
    plain = config_lines(spark, sf)
    a = X.block_lines(plain, "interface", "acl")
    guests = P.for_each_ssid(plain.select("file_id").distinct(), ssids(spark)).filter("internal_access = 'false'")
    return P.guest_isolation(guests, X.interfaces(a, plain), keep(X.acl_rules(a, plain)))


# the diff looks VLANs up in the VLAN table first, then in interface order
DIFF_CTES = f"""{INTERFACE_CTES}, {ACL_CTES}, {DHCP_CTES}, {GATEWAY_CTE}, {IFVLAN_CTE}, {TRUNKV_CTE}, {ISOLATION_CTES}, {block_cte('vb', 'vlan')},
_vl as (
  select file_id, {x(r'^\s*vlan\s+([0-9]+)', col='ht')} as id, hl, max(case when {m(r'^\s*name\s+(.+)')} then line_no end) as nl from vb group by 1, 2, 3),
_vlan_lines as (
  select file_id, id, 0 as prio, coalesce(arg_max(struct_pack(v := nl), hl)['v'], max(hl)) as line from _vl group by 1, 2
  union all select file_id, {x(fv.VLAN_ROW, 1)}, 1, line_no from config_lines where {m(fv.VLAN_ROW)} and cast({x(fv.VLAN_ROW, 1)} as int) <= 4094
  union all select file_id, {x(r'encapsulation\s+dot1q\s+([0-9]+)')}, 2, line_no from config_lines where {m(r'encapsulation\s+dot1q\s+([0-9]+)')}),
_seen as (
  select file_id, vlan, arg_min(line, (rank, line)) as line from (
    select file_id, id as vlan, 0 as rank, arg_min(line, (prio, line)) as line from _vlan_lines group by 1, 2
    union all select file_id, vlan, 1, line from interface_vlan
    union all select file_id, vlan, 1, line from trunkv where vlan is not null) group by 1, 2),
_pool as (select file_id, cidr, arg_min(struct_pack(name := name, gw := default_gateway, line := evidence_line), evidence_line) as p from dhcp_scopes where cidr is not null group by 1, 2),
_gw as (select file_id, pool, arg_min(struct_pack(i := matched_interface, v := matched_vlan), evidence_line) as g from gateways group by 1, 2),
_tv as (select file_id, vlan, count(distinct (name, line)) as n, min(line) as line from trunkv where vlan is not null group by 1, 2),
_ta as (select file_id, min(line) as line from trunkv group by 1),
_acl as (select file_id, vlan, count(*) as n, arg_min(struct_pack(acl := acl_name, line := line), (line, direction)) as a from _va group by 1, 2),
_j as (
  select b.*, s.line as v_line, s.file_id is not null as has_vlan, p.p as p, g.g as g, coalesce(tv.n, 0) as carry, tv.line as tv_line, ta.line as ta_line, ac.n as acl_n, ac.a as acl_a,
    i.isolation_status, i.isolation_reason, i.isolation_line, i.isolation_confidence
  from _base b left join _seen s on s.file_id = b.file_id and s.vlan = b.expected_vlan left join _pool p on p.file_id = b.file_id and p.cidr = b.expected_subnet
    left join _gw g on g.file_id = b.file_id and g.pool = p.p.name left join _tv tv on tv.file_id = b.file_id and tv.vlan = b.expected_vlan
    left join _ta ta on ta.file_id = b.file_id left join _acl ac on ac.file_id = b.file_id and ac.vlan = b.expected_vlan
    left join isolation i on i.file_id = b.file_id and i.ssid = b.ssid),
diffs as (
  select file_id, concat('SSID-VLAN-', ssid) as id, ssid as asset, 'SSID-to-VLAN' as category,
    case when has_vlan then concat('VLAN ', expected_vlan, ' found in extracted evidence') else 'Not found in extracted wired policy' end as actual,
    case when has_vlan then 'Pass' else 'Fail' end as status, case when has_vlan then 'Info' else 'High' end as severity, v_line as evidence_line,
    case when has_vlan then 0.95 else 0.72 end as confidence,
    case when has_vlan then 'No action required.' else 'Create/restore the VLAN or upload complete VLAN evidence.' end as recommendation from _j
  union all
  select file_id, concat('DHCP-', ssid), ssid, 'DHCP Scope', case when p is not null then concat('Scope ', expected_subnet, ' found in pool ', p.name) else 'No matching DHCP evidence' end,
    case when p is not null then 'Pass' else 'Review' end, case when p is not null then 'Info' else 'Medium' end, p.line, case when p is not null then 0.93 else 0.48 end,
    case when p is not null then 'No action required.' else 'Upload DHCP pool output or create the matching DHCP network statement.' end from _j
  union all
  select file_id, concat('DHCP-GW-', ssid), ssid, 'Gateway/DHCP Matching', concat('Gateway ', coalesce(p.gw, 'None'), ' matched ', coalesce(g.i, 'None')),
    case when g.v = expected_vlan then 'Pass' else 'Review' end, case when g.v = expected_vlan then 'Info' else 'Medium' end, p.line, case when g.v = expected_vlan then 0.9 else 0.55 end,
    case when g.v = expected_vlan then 'No action required.' else 'Check default-router vs routed subinterface/SVI IP.' end from _j where p is not null
  union all
  select file_id, concat('TRUNK-', ssid), ssid, 'Trunk Coverage', case when ta_line is null then 'No trunk evidence uploaded' when carry > 0
      then concat(carry, ' trunk interface(s) carry VLAN ', expected_vlan) else concat('No trunk evidence carries VLAN ', expected_vlan) end,
    case when ta_line is null then 'Review' when carry > 0 then 'Pass' else 'Fail' end, case when ta_line is null then 'Medium' when carry > 0 then 'Info' else 'High' end,
    case when carry > 0 then tv_line else ta_line end, case when ta_line is null then 0.42 when carry > 0 then 0.9 else 0.78 end,
    case when ta_line is null then 'Upload show interfaces trunk / switchport running-config.' when carry > 0 then 'No action required.'
      else 'Add the WLAN VLAN to AP/uplink trunk allowed lists.' end from _j
  union all
  select file_id, concat('GUEST-ISOLATION-', ssid), ssid, 'Guest Isolation', isolation_reason, isolation_status, case when isolation_status = 'Pass' then 'Info' else 'Critical' end,
    isolation_line, isolation_confidence, case when isolation_status = 'Pass' then 'No action required.' else 'Apply a deny ACL inbound on the guest VLAN gateway before any permit-any rule.' end
  from _j where internal_access = 'false'
  union all
  select file_id, concat('ACL-DIRECTION-', ssid), ssid, 'ACL Direction', case when acl_n > 0 then concat('Applied ACL: ', acl_a.acl) else 'No applied ACL was confirmed' end,
    case when acl_n > 0 then 'Pass' else 'Review' end, case when acl_n > 0 then 'Info' else 'High' end, acl_a.line, case when acl_n > 0 then 0.86 else 0.5 end,
    case when acl_n > 0 then 'No action required.' else 'Apply the student policy ACL to the VLAN gateway in the correct direction.' end from _j where internal_access = 'limited')"""
_DIFF_HEAD = f"with {CONFIG_LINES_SQL}, {WIRELESS_SQL}, {DIFF_CTES}"


def diffs_of(spark, sf):
    return diff_of_lines(config_lines(spark, sf), ssids(spark))


@query("policy_diff", f"{_DIFF_HEAD} select * from diffs")
def policy_diff(spark, sf):
    return diffs_of(spark, sf)


# a client is guarded where the configuration of one of its sites (the files of its orders) proves the isolation
@query("wireless_access_decisions", f"""{_DIFF_HEAD},
_guard as (select c_name as client, asset as ssid, max(status = 'Pass') as proven from diffs join orders on o_orderkey = file_id join customer on c_custkey = o_custkey where category = 'Guest Isolation' group by 1, 2),
_asked as (select c.name, c.role, unnest([{', '.join(lit(a) for a in ACTIONS)}]) as action from clients c),
_svc as (select a.*, s.*, g.proven, case when action like '%Internal%' then 'Internal Portal' when action like '%Internet%' then 'Internet' when action like '%ERP%' then 'ERP' else action end as service
  from (select name, role as client_role, action from _asked) a left join ssids s on lower(s.role) = lower(a.client_role) left join _guard g on g.client = a.name and g.ssid = s.ssid),
_res as (select *, case when internal_access = 'false' and (action like '%Internal%' or action like '%ERP%' or action like '%File%') then case when proven then 'Pass' else 'Fail' end
  when list_contains(allowed_services, service) or (service = 'Internet' and internet) then 'Pass' else 'Review' end as status from _svc)
select name as client, action, ssid, expected_vlan as vlan, service, status, case status when 'Pass' then 'Info' when 'Fail' then 'Critical' else 'Medium' end as severity from _res""")
def wireless_access_decisions(spark, sf):
    checks = diffs_of(spark, sf).filter("category = 'Guest Isolation'").select(F.col("file_id").alias("o_orderkey"), F.col("asset").alias("ssid"), "status")
    sites = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("client")), "o_custkey")
    isolation = checks.join(sites, "o_orderkey").groupBy("client", "ssid").agg(F.when(F.max(F.col("status") == "Pass"), "Pass").otherwise("Fail").alias("isolation_status"))
    return W.access_decisions(clients(spark, sf), ssids(spark), isolation, ACTIONS)


_OWNER = "case category " + " ".join(f"when {lit(k)} then {lit(v[0])}" for k, v in fv.ROOT_CAUSE_TABLE.items()) + f" else {lit(fv.ROOT_CAUSE_DEFAULT[0])} end"
_CMDS = "case category " + " ".join(f"when {lit(k)} then {lit(' ; '.join(v[1]))}" for k, v in fv.ROOT_CAUSE_TABLE.items()) + f" else {lit(' ; '.join(fv.ROOT_CAUSE_DEFAULT[1]))} end"


@query("policy_root_causes", f"""{_DIFF_HEAD}
select file_id, id as finding_id, asset, severity, confidence, evidence_line, {_CMDS} as verification_commands, {_OWNER} as owner, recommendation as recommended_fix
from diffs where status <> 'Pass'""")
def policy_root_causes(spark, sf):
    return P.root_causes(diffs_of(spark, sf)).withColumn("verification_commands", F.array_join("verification_commands", " ; "))


@query("policy_playbooks", f"""{_DIFF_HEAD}
select file_id, id as finding_id, {_OWNER} as owner, severity, recommendation as fix, {_CMDS} as commands from diffs where status <> 'Pass'""")
def policy_playbooks(spark, sf):
    return P.wired_playbooks(diffs_of(spark, sf)).select(
        "file_id", "finding_id", "owner", "severity", F.col("steps").getItem(2).alias("fix"), F.array_join("commands", " ; ").alias("commands"))


@query("policy_risk_score", f"""{_DIFF_HEAD}
select file_id, score, case when score >= 90 then 'Excellent' when score >= 75 then 'Good' when score >= 60 then 'Needs Improvement' else 'Critical' end as grade,
  case when score >= 90 then 'Low' when score >= 60 then 'Medium' else 'High' end as risk_level
from (select file_id, cast(greatest(0, 100 - sum(case when status = 'Fail' then case when severity = 'Critical' then 25 else 14 end when status = 'Review' then 7 else 0 end)) as bigint) as score
  from diffs group by file_id)""")
def policy_risk_score(spark, sf):
    return P.wired_risk(diffs_of(spark, sf))


@query("policy_prioritized_checks", f"""{_DIFF_HEAD}
select file_id, id, severity, status from diffs order by case severity when 'Critical' then 0 when 'High' then 1 when 'Medium' then 2 when 'Low' then 3 else 4 end,
  case status when 'Fail' then 0 when 'Review' then 1 else 2 end, file_id, id limit 20""")
def policy_prioritized_checks(spark, sf):
    return P.prioritized(diffs_of(spark, sf), limit=20).select("file_id", "id", "severity", "status")


OBSERVED_CTES = f"""{INTERFACE_CTES}, {DHCP_CTES}, {GATEWAY_CTE}, {IFVLAN_CTE}, {TRUNK_CTES}, {block_cte('vb', 'vlan')},
observed as (
  select distinct file_id, source, vlan from (
    select file_id, 'configured' as source, {x(r'^\s*vlan\s+([0-9]+)', col='ht')} as vlan from vb
    union all select file_id, 'configured', {x(fv.VLAN_ROW, 1)} from config_lines where {m(fv.VLAN_ROW)} and cast({x(fv.VLAN_ROW, 1)} as int) <= 4094
    union all select file_id, 'configured', {x(r'encapsulation\s+dot1q\s+([0-9]+)')} from config_lines where {m(r'encapsulation\s+dot1q\s+([0-9]+)')}
    union all select file_id, 'show_vlan', {x(fv.VLAN_BRIEF_ROW, 1)} from config_lines where {m(fv.VLAN_BRIEF_ROW)} and not {m(fv.VLAN_BRIEF_HEADER)}
    union all select file_id, 'dhcp_gateway', matched_vlan from gateways
    union all select file_id, 'access_or_svi', vlan from interface_vlan
    union all select file_id, 'trunk_allowed', unnest(string_split(allowed_vlans, ',')) from trunk_operational where allowed_vlans <> ''
    union all select file_id, 'trunk_forwarding', unnest(string_split(forwarding_vlans, ',')) from trunk_operational where forwarding_vlans <> '') where vlan is not null),
_per as (
  select file_id, vlan, bool_or(source = 'configured') as configured, bool_or(source = 'show_vlan') as show_vlan, bool_or(source = 'dhcp_gateway') as dhcp_gateway,
    bool_or(source = 'access_or_svi') as access_or_svi, bool_or(source = 'trunk_allowed') as trunk_allowed, bool_or(source = 'trunk_forwarding') as trunk_forwarding
  from observed group by 1, 2),
crosscheck as (
  select p.*, configured or show_vlan or dhcp_gateway or access_or_svi as observed,
    (configured or show_vlan or dhcp_gateway or access_or_svi) and not trunk_allowed and vlan not in ('1', '1002', '1003', '1004', '1005')
      and p.file_id in (select file_id from observed where source = 'trunk_allowed') as missing_from_trunks from _per p)"""
_CROSS_HEAD = f"with {CONFIG_LINES_SQL}, {OBSERVED_CTES}"


#: blocks and states behind the VLAN cross check, and behind the policy controls
CROSS_READS = ("interface", "vlan", "dhcp", "vlan_header", "trunk_section", "trunk_seen")
CONTROL_READS = ("interface", "acl", "cdp", "lldp", "trunk_section", "trunk_seen", "blk_vty", "hardening", "secure_port", "secure_state", "counter", "acl_active")


def cross_inputs(spark, sf):
    return cross_of(X.needed_lines(config_lines(spark, sf), *CROSS_READS))


def ports_of(few):
    """Interfaces and trunks, written once for all that reads them."""
    return written(X.interfaces(X.block_lines(few, "interface"), few)), written(X.trunk_operational(X.state_lines(few, "trunk_section", "trunk_seen")))


def cross_of(few, ports=None):
    """Places that name a VLAN, from lines with all that `CROSS_READS` names; `ports` as `ports_of` gives them."""
    interfaces, trunks = ports or ports_of(few)
    pools = X.dhcp_scopes(X.block_lines(few, "dhcp"))
    gateways = P.match_dhcp_gateways(pools, interfaces)
    return written(P.observed_vlans(X.vlans(X.block_lines(few, "vlan"), few), X.vlan_brief(X.state_lines(few, "vlan_header")), gateways, interfaces, trunks))


@query("vlan_sources", f"{_CROSS_HEAD} select * from observed")
def vlan_sources(spark, sf):
    return cross_inputs(spark, sf)


@query("vlan_crosscheck", f"{_CROSS_HEAD} select * from crosscheck")
def vlan_crosscheck(spark, sf):
    return P.vlan_crosscheck(cross_inputs(spark, sf))


@query("policy_risk_atoms", f"""{_CROSS_HEAD}, {HARDENING_CTES}, {COUNTER_CTES}, {ACL_HITS_CTES}
select file_id, 'weak-management-plane' as key, concat('Weak management-plane signal: ', name) as title, 'High' as severity, evidence_line, 0.86 as confidence from security_hardening where posture = 'weak'
union all select c.file_id, 'interface-errors', concat('Interface errors on ', c.interface), 'Medium',
  (select max(s.line_no) from cst s where s.file_id = c.file_id and s.cl = c.evidence_line and (regexp_matches(s.text, {lit(fv.COUNTER_INPUT)}, 'i') or regexp_matches(s.text, {lit(fv.COUNTER_OUTPUT)}, 'i'))), 0.78
  from interface_counters c where input_errors + output_errors + crc > 0
union all select file_id, 'vlan-not-on-trunk', concat('VLAN ', vlan, ' missing from trunk evidence'), 'High', null, 0.76 from crosscheck where missing_from_trunks
union all select file_id, 'acl-zero-hit', concat('ACL line has zero runtime hits in ', acl_name), 'Low', evidence_line, 0.6 from acl_hit_counts where matches = 0 and acl_name is not null""")
def policy_risk_atoms(spark, sf):
    few = X.needed_lines(config_lines(spark, sf), *CROSS_READS, "blk_vty", "hardening", "counter", "acl_active")
    return P.risk_atoms(X.security_hardening(X.state_lines(few, "blk_vty"), few), X.interface_counters(X.state_lines(few, "counter")),
                        P.vlan_crosscheck(cross_of(few)), X.acl_hit_counts(X.state_lines(few, "acl_active")))


@query("policy_controls", f"""{_CROSS_HEAD}, {HARDENING_CTES}, {COUNTER_CTES}, {ACL_HITS_CTES}, {ACL_CTES}, {BINDING_CTE},
_ports as (select file_id from ({SQL['extract_port_security']})), _links as (select file_id from ({SQL['extract_cdp_links']}) union all select file_id from ({SQL['extract_lldp_links']})),
_n as (
  select f.file_id, (select count(*) from acl_rules r where r.file_id = f.file_id and exists (select 1 from bindings b where b.file_id = r.file_id and b.acl_name = r.acl_name)) as acl,
    (select count(*) from trunk_operational t where t.file_id = f.file_id) as trunk, (select count(*) from interfaces i where i.file_id = f.file_id and (mode = 'trunk' or trunk_allowed_vlans <> '')) as trunk_config,
    (select count(*) from security_hardening h where h.file_id = f.file_id and posture = 'weak') as weak,
    (select count(*) from _ports p where p.file_id = f.file_id) as secure,
    (select count(*) from _links l where l.file_id = f.file_id) as links, (select count(*) from interface_counters c where c.file_id = f.file_id and input_errors + output_errors + crc > 0) as errors,
    (select count(*) from acl_hit_counts h where h.file_id = f.file_id and matches > 0) as hits, (select count(*) from crosscheck x where x.file_id = f.file_id and missing_from_trunks) as missing
  from (select distinct file_id from config_lines) f)
select file_id, 'SEG-ACL-APPLIED' as control, case when acl > 0 then 'pass' else 'review' end as status, case when acl > 0 then 'Info' else 'High' end as severity, acl as amount, case when acl > 0 then 0.9 else 0.45 end as confidence from _n
union all select file_id, 'L2-TRUNK-COVERAGE', case when trunk + trunk_config > 0 then 'pass' else 'review' end, 'Medium', case when trunk > 0 then trunk else trunk_config end, case when trunk + trunk_config > 0 then 0.86 else 0.4 end from _n
union all select file_id, 'DEVICE-HARDENING', case when weak > 0 then 'fail' else 'pass' end, case when weak > 0 then 'High' else 'Info' end, weak, case when weak > 0 then 0.88 else 0.7 end from _n
union all select file_id, 'ACCESS-PORT-SECURITY', case when secure > 0 then 'pass' else 'review' end, 'Medium', secure, case when secure > 0 then 0.82 else 0.44 end from _n
union all select file_id, 'TOPOLOGY-ADJACENCY', case when links > 0 then 'pass' else 'review' end, 'Medium', links, case when links > 0 then 0.84 else 0.42 end from _n
union all select file_id, 'INTERFACE-ERROR-HEALTH', case when errors > 0 then 'fail' else 'pass' end, case when errors > 0 then 'Medium' else 'Info' end, errors, case when errors > 0 then 0.82 else 0.68 end from _n
union all select file_id, 'ACL-RUNTIME-HITS', case when hits > 0 then 'pass' else 'review' end, 'Medium', hits, case when hits > 0 then 0.83 else 0.42 end from _n
union all select file_id, 'VLAN-TRUNK-CROSSCHECK', case when missing > 0 then 'fail' else 'pass' end, case when missing > 0 then 'High' else 'Info' end, missing, 0.84 from _n""")
def policy_controls(spark, sf):
    lines = config_lines(spark, sf)
    few = X.needed_lines(lines, *CROSS_READS, *CONTROL_READS)
    ports = ports_of(few)
    return controls_of(few, lines.select("file_id").distinct(), cross_of(few, ports), ports)


def controls_of(few, scopes, observed, ports=None):
    """Controls of the scopes, from lines with all that `CONTROL_READS` names; `ports` as `ports_of` gives them."""
    interfaces, trunks = ports or ports_of(few)
    state = lambda *names: X.state_lines(few, *names)
    links = X.cdp_links(state("cdp"), few).select("file_id").unionByName(X.lldp_links(state("lldp"), few).select("file_id"))
    return P.policy_controls(
        scopes, P.bind_acls(X.acl_rules(X.block_lines(few, "acl"), few), interfaces), trunks, interfaces,
        X.security_hardening(state("blk_vty"), few), X.port_security(state("secure_port", "secure_state"), interfaces), links,
        X.interface_counters(state("counter")), X.acl_hit_counts(state("acl_active")), P.vlan_crosscheck(observed))


_RTE = r"^\s*ip route\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+(.+))?"


@query("subnet_inventory", f"""{_LINES}, {INTERFACE_CTES}, {DHCP_CTES},
_mem as (
  select file_id, cidr, 'interface' as kind, name, evidence_line as line from interfaces where cidr is not null
  union all select file_id, cidr, 'dhcp_pool', name, evidence_line from dhcp_scopes where cidr is not null
  union all select file_id, '0.0.0.0/0', 'route', {x(_RTE, 3)}, line_no from config_lines where {m(_RTE)})
select file_id, cidr, count(*) filter (kind = 'interface') as interfaces, count(*) filter (kind = 'dhcp_pool') as dhcp_pools, count(*) filter (kind = 'route') as routes,
  arg_min(case when kind = 'interface' then name end, line) as first_interface, arg_min(case when kind = 'dhcp_pool' then name end, line) as first_dhcp_pool,
  arg_min(case when kind = 'route' then name end, line) as first_route from _mem group by 1, 2""")
def subnet_inventory(spark, sf):
    interfaces, pools, _ = wired(spark, sf)
    return P.subnet_inventory(P.subnet_members(interfaces, pools, X.static_routes(config_lines(spark, sf))))


@query("subnet_of_address", f"""{_LINES}, {INTERFACE_CTES}, {DHCP_CTES},
_nets as (
  select distinct file_id, cidr, cast(split_part(cidr, '/', 2) as int) as len, {_number("split_part(cidr, '/', 1)")} as base from (
    select file_id, cidr from interfaces where cidr is not null union all select file_id, cidr from dhcp_scopes where cidr is not null
    union all select file_id, '0.0.0.0/0' from config_lines where {m(_RTE)}
    union all select distinct file_id, '10.10.0.0/16' from config_lines where {m(r"^ network 10[.]10[.]0[.]0 0[.]0[.]255[.]255 area 0")})),
_ips as (select distinct file_id, ip_address, {_number('ip_address')} as n from ({SQL['extract_ip_inventory']}) where ip_address is not null)
select i.file_id, i.ip_address, arg_max(c.cidr, c.len) as cidr, count(c.cidr) as nets
from _ips i left join _nets c on c.file_id = i.file_id and i.n >= c.base and i.n < c.base + (cast(1 as bigint) << (32 - c.len)) group by 1, 2""")
def subnet_of_address(spark, sf):
    """Addresses of the interface tables in the subnets of interfaces, pools, routes and routing networks of their file."""
    lines = X.needed_lines(config_lines(spark, sf), "interface", "dhcp", "static_routes", "networks", "ip_inventory")
    interfaces, pools, _ = wired_of(lines)
    nets = P.subnet_members(interfaces, pools, X.static_routes(lines)).select("file_id", "cidr")
    area = r"^ network (\S+) (\S+) area"
    routed = lines.filter(F.col("text").rlike(area)).select("file_id", network_cidr(F.regexp_extract("text", area, 1), F.regexp_extract("text", area, 2)).alias("cidr")).filter("cidr is not null")
    addresses = X.ip_inventory(lines).filter("ip_address is not null").select("file_id", "ip_address").distinct()
    # written, as the address arithmetic would be put into itself once more for each use of a network
    return P.longest_match(addresses, "ip_address", written(nets.unionByName(routed).distinct()), ["file_id"]).select("file_id", "ip_address", "cidr", "nets")


@query("policy_rule_evaluation", f"""with {WIRELESS_SQL},
rules(rule_id, condition_left, operator, condition_value, severity) as (values ('PS-ROLE-KNOWN', 'client.role', 'not_contains', 'Guest', 'High'), ('PS-VLAN-10', 'client.vlan', 'equals', '10', 'Medium'),
  ('PS-AP-SUPPORT', 'ap.supported_vlans', 'contains', '10', 'High'), ('PS-AP-CAPACITY', 'ap.max_clients', 'greater_than', '9', 'Low')),
facts as (select name as asset, 'client.role' as key, role as value from clients union all select name, 'client.vlan', vlan from clients
  union all select name, 'ap.supported_vlans', supported_text from aps union all select name, 'ap.max_clients', cast(max_clients as varchar) from aps)
select rule_id, asset, severity, operator, condition_value, value, case when case operator when 'equals' then value = condition_value when 'contains' then contains(value, condition_value)
  when 'not_contains' then not contains(value, condition_value) else try_cast(value as double) > try_cast(condition_value as double) end then 'pass' else 'fail' end as status
from rules join facts on condition_left = key""")
def policy_rule_evaluation(spark, sf):
    from .bindings import aps

    rules = spark.sql("""select * from values ('PS-ROLE-KNOWN', true, 'client.role', 'not_contains', 'Guest', 'High'), ('PS-VLAN-10', true, 'client.vlan', 'equals', '10', 'Medium'),
      ('PS-AP-SUPPORT', true, 'ap.supported_vlans', 'contains', '10', 'High'), ('PS-AP-CAPACITY', true, 'ap.max_clients', 'greater_than', '9', 'Low')
      as t(rule_id, enabled, condition_left, operator, condition_value, severity)""")
    fact = lambda df, key, value: df.select(F.col("name").alias("asset"), F.lit(key).alias("key"), value.alias("value"))
    c, a = clients(spark, sf), aps(spark, sf)
    facts = (
        fact(c, "client.role", F.col("role")).unionByName(fact(c, "client.vlan", F.col("vlan")))
        .unionByName(fact(a, "ap.supported_vlans", F.array_join("supported_vlans", ","))).unionByName(fact(a, "ap.max_clients", F.col("max_clients").cast("string")))
    )
    return P.evaluate_rules(rules, facts)


@query("policy_compliance_matrix", f"""{_DIFF_HEAD}, {MATRIX_CTES}, {ANOMALY_CTES.replace(CHECK_CTES + ",", "", 1)},
_c as (select (select count(*) from anomalies) as a, (select count(*) from anomalies where contains(detail, 'Guest') or contains(coalesce(asset, ''), 'Guest')) as guest,
  (select count(*) from anomalies where category = 'VLAN mismatch') as v, (select count(*) from anomalies where category = 'DHCP scope mismatch') as d,
  (select count(*) from anomalies where category = 'AP VLAN support') as ap, (select count(*) from matrix) as mx, (select count(*) from matrix where result <> 'Pass') as fc,
  (select count(*) from diffs where status <> 'Pass') as fd, (select count(*) from wevents) as e),
_k as (
  select 'CTRL-GUEST-ISOLATION' as id, 'Guest isolation' as control, case when guest > 0 then 'Fail' else 'Pass' end as status, 'High' as risk, 'WLAN' as p, a as n from _c
  union all select 'CTRL-SSID-VLAN', 'SSID to VLAN mapping', case when v > 0 then 'Fail' else 'Pass' end, 'High', 'MATRIX', mx from _c
  union all select 'CTRL-DHCP-ACCURACY', 'DHCP scope accuracy', case when d > 0 then 'Review' else 'Pass' end, 'Medium', 'DHCP', fc from _c
  union all select 'CTRL-AP-TRUNK', 'AP trunk coverage', case when ap > 0 then 'Fail' else 'Pass' end, 'High', 'PATH', e from _c
  union all select 'CTRL-WIRED-POLICY', 'Wired policy alignment', case when fd > 0 then 'Review' else 'Pass' end, 'Medium', 'DIFF', fd from _c
  union all select 'CTRL-AUDIT-TRAIL', 'Administrative audit trail', case when e = 0 then 'Review' else 'Pass' end, 'Low', 'AUDIT', e from _c)
select id, control, status, risk, concat(p, '-', case when n < 1000 then lpad(cast(n as varchar), 3, '0') else cast(n as varchar) end) as evidence from _k""")
def policy_compliance_matrix(spark, sf):
    from ..operators import wireless as W
    from .wireless_queries import dims

    return P.compliance_matrix(all_anomalies(spark, sf), W.client_matrix(*dims(spark, sf)), diffs_of(spark, sf), wireless_events(spark, sf))


@query("audit_timeline", f"""{_DIFF_HEAD}
select coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), '') as time, event_type as type, 'Info' as severity, props as detail from events
union all select strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'import', 'Info', concat('Imported ', o_orderkey) from orders
union all select '', 'policy_diff', severity, concat(file_id, ' ', id, ': ', actual) from diffs where status <> 'Pass'""")
def audit_timeline(spark, sf):
    """Events, imports and the open checks of the policy diff."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    e = table(spark, sf, "events").select(text("ts").alias("time"), F.col("event_type").alias("type"), F.lit("Info").alias("severity"), F.col("props").alias("detail"))
    o = table(spark, sf, "orders").select(text("o_orderdate").alias("time"), F.lit("import").alias("type"), F.lit("Info").alias("severity"),
                                          F.concat(F.lit("Imported "), F.col("o_orderkey").cast("string")).alias("detail"))
    checks = diffs_of(spark, sf).filter("status <> 'Pass'").select(F.lit("").alias("time"), F.lit("policy_diff").alias("type"), "severity",
                                                                   F.concat(F.col("file_id").cast("string"), F.lit(" "), "id", F.lit(": "), "actual").alias("detail"))
    return P.timeline(e, o, checks)
