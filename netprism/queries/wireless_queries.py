"""Wireless policy queries over the derived clients, access points and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import wireless as W
from .bindings import WIRELESS_SQL, aps, clients, ssids, wireless_events
from .duck import lit
from .registry import query

CHECK_CTES = """
_policy as (
  select c.*, coalesce(n.ssid, r.ssid) as p_ssid, case when n.ssid is not null then n.role else r.role end as p_role,
    case when n.ssid is not null then n.expected_vlan else r.expected_vlan end as p_vlan, case when n.ssid is not null then n.expected_subnet else r.expected_subnet end as p_net
  from clients c left join ssids n on lower(n.ssid) = lower(c.ssid) left join ssids r on lower(r.role) = lower(c.role)),
checked as (
  select p.*, a.name as known_ap, coalesce(p.vlan = p.p_vlan, false) as vlan_ok, coalesce(lower(p.role) = lower(p.p_role), false) as role_ok,
    coalesce(p.ip <> '' and split_part(p.ip, '.', 3) = split_part(p.p_net, '.', 3) and starts_with(p.ip, '10.10.'), false) as dhcp_ok,
    coalesce(list_contains(string_split(a.supported_text, ','), p.p_vlan), false) as ap_ok
  from _policy p left join aps a on a.name = p.ap)"""

MATRIX_CTES = CHECK_CTES + """,
matrix as (
  select name as client, role, ssid, ap, p_vlan as expected_vlan, vlan as actual_vlan, case when vlan_ok then 'Pass' else 'Fail' end as vlan_status, ip,
    p_net as dhcp_scope, case when dhcp_ok then 'Pass' else 'Review' end as dhcp_status, case when ap_ok then 'Pass' else 'Fail' end as ap_trunk_status,
    case when role_ok then 'Pass' else 'Fail' end as role_status,
    case when vlan_ok and dhcp_ok and ap_ok and role_ok then 'Pass' when not vlan_ok or not role_ok then 'Fail' else 'Review' end as result
  from checked)"""
LOAD_CTE = """
_load as (
  select a.*, coalesce(c.n, 0) as current_clients, round_even(coalesce(c.n, 0) / cast(a.max_clients as double) * 100, 1) as load_percent
  from aps a left join (select ap, count(*) as n from clients where status <> 'disassociated' group by ap) c on c.ap = a.name),
ap_load as (
  select *, case when load_percent >= 90 then 'Critical' when load_percent >= 75 then 'Warning' else 'Healthy' end as health from _load)"""
_W = f"with {WIRELESS_SQL}"
_RECS = "case category " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in fv.ANOMALY_RECOMMENDATIONS.items()) + " end"
ANOMALY_CTES = CHECK_CTES + "," + LOAD_CTE + f""",
_counts as (
  select type, case when type = 'roaming' then coalesce(client, 'unknown') else coalesce(client, ssid, 'unknown') end as key, count(*) as n
  from wevents where type in ('authentication_failure', 'roaming') group by 1, 2),
_found as (
  select 'ROLE-SSID' as detector, concat('ROLE-SSID-', name) as id, 'High' as severity, 'Role/SSID mismatch' as category, name as asset,
    concat(name, ' role ', role, ' does not match SSID ', coalesce(ssid, 'None'), ' policy.') as detail from checked where not role_ok
  union all select 'VLAN-MISMATCH', concat('VLAN-MISMATCH-', name), 'Critical', 'VLAN mismatch', name, concat('Expected VLAN ', p_vlan, ' but client is on VLAN ', vlan, '.') from checked where not vlan_ok
  union all select 'DHCP-MISMATCH', concat('DHCP-MISMATCH-', name), 'Medium', 'DHCP scope mismatch', name, concat('Client IP ', ip, ' is not proven inside ', p_net, '.') from checked where not dhcp_ok
  union all select 'AP-VLAN', concat('AP-VLAN-', name), 'High', 'AP VLAN support', ap, concat(ap, ' does not support expected VLAN ', p_vlan, ' for ', coalesce(ssid, 'None'), '.') from checked where not ap_ok
  union all select 'UNKNOWN-AP', concat('UNKNOWN-AP-', name), 'High', 'Unknown AP', ap, concat('Client ', name, ' is associated to AP ', ap, ' which is not in inventory.') from checked where known_ap is null
  union all select 'NO-IP', concat('NO-IP-', name), 'Medium', 'DHCP missing', name, concat('Associated client ', name, ' has no recorded IP lease.') from checked where status = 'associated' and ip = ''
  union all select 'PS-GUEST-DENY-INTERNAL', concat('PS-GUEST-DENY-INTERNAL-', name), 'Critical', 'Policy Studio', name, 'Policy Studio rule failed: Guest must be isolated from internal services.'
    from checked where role = 'Guest' and services_text like '%ERP%'
  union all select 'AP-LOAD', concat('AP-LOAD-', name), case when health = 'Critical' then 'High' else 'Medium' end, 'AP load', name,
    concat('AP load is ', printf('%.1f', load_percent), '% (', current_clients, '/', max_clients, ' clients).') from ap_load where health <> 'Healthy'
  union all select 'ROAMING', concat('ROAMING-', key), 'Medium', 'Roaming instability', key, concat(n, ' roaming events detected for one client.') from _counts where type = 'roaming' and n >= 4
  union all select 'AUTH-FAIL', concat('AUTH-FAIL-', key), 'High', 'Authentication failures', key, concat(n, ' authentication failures detected.') from _counts where type <> 'roaming' and n >= 3),
anomalies as (select *, {_RECS} as recommendation, case when severity in ('Critical', 'High') then 90 else 75 end as confidence from _found)"""


def dims(spark, sf):
    return clients(spark, sf), ssids(spark), aps(spark, sf)


def all_anomalies(spark, sf):
    c, s, a = dims(spark, sf)
    return W.anomalies(c, s, a, wireless_events(spark, sf))


@query("wireless_client_matrix", f"{_W}, {MATRIX_CTES} select *, case when result = 'Pass' then 95 when result = 'Review' then 75 else 88 end as confidence from matrix")
def wireless_client_matrix(spark, sf):
    return W.client_matrix(*dims(spark, sf))


@query("wireless_ap_load", f"{_W}, {LOAD_CTE} select name, switch, uplink_interface, max_clients, supported_text as supported_vlans, current_clients, load_percent, health from ap_load")
def wireless_ap_load(spark, sf):
    c, _, a = dims(spark, sf)
    return W.ap_load(c, a).withColumn("supported_vlans", F.array_join("supported_vlans", ","))


@query("wireless_client_distribution", f"""{_W}
select 'ap' as dimension, ap as value, count(*) as clients from clients where status <> 'disassociated' group by ap
union all select 'ssid', ssid, count(*) from clients where status <> 'disassociated' group by ssid
union all select 'role', role, count(*) from clients where status <> 'disassociated' group by role""")
def wireless_client_distribution(spark, sf):
    return W.client_distribution(clients(spark, sf))


@query("wireless_event_correlation", f"""{_W}
select e.id, e.ts as time, e.type as event_type, e.client, coalesce(n.ssid, r.ssid, e.ssid, '') as ssid,
  coalesce(case when n.ssid is not null then n.expected_vlan else r.expected_vlan end, c.vlan, '') as expected_vlan,
  coalesce(e.to_ap, e.ap, c.ap, 'unknown') as ap,
  concat(coalesce(e.to_ap, e.ap, c.ap, 'Unknown AP'), ' → ', coalesce(a.switch, 'Unknown switch'), ' ', coalesce(a.uplink_interface, 'Unknown uplink'), ' → VLAN ',
    coalesce(case when n.ssid is not null then n.expected_vlan else r.expected_vlan end, c.vlan, '')) as wired_path,
  case when coalesce(list_contains(string_split(a.supported_text, ','), coalesce(case when n.ssid is not null then n.expected_vlan else r.expected_vlan end, c.vlan, '')), false)
    then 'Pass' else 'Fail' end as status
from wevents e left join clients c on c.name = e.client left join ssids n on lower(n.ssid) = lower(coalesce(e.ssid, c.ssid))
  left join ssids r on lower(r.role) = lower(c.role) left join aps a on a.name = coalesce(e.to_ap, e.ap, c.ap)""")
def wireless_event_correlation(spark, sf):
    c, s, a = dims(spark, sf)
    return W.event_correlation(wireless_events(spark, sf), c, s, a)


@query("wireless_unknown_aps", f"{_W} select name, ap, role from clients c where ap <> '' and not exists (select 1 from aps a where a.name = c.ap)")
def wireless_unknown_aps(spark, sf):
    return W.unknown_aps(clients(spark, sf), aps(spark, sf)).select("name", "ap", "role")


@query("wireless_event_thresholds", f"""{_W}, {ANOMALY_CTES}
select type, key, n from _counts where n >= case when type = 'roaming' then 4 else 3 end""")
def wireless_event_thresholds(spark, sf):
    return W.event_thresholds(wireless_events(spark, sf))


@query("wireless_anomalies", f"{_W}, {ANOMALY_CTES} select * from anomalies")
def wireless_anomalies(spark, sf):
    return all_anomalies(spark, sf)


@query("wireless_risk_score", f"""{_W}, {ANOMALY_CTES}
select score, case when score >= 90 then 'Excellent' when score >= 75 then 'Good' when score >= 60 then 'Needs Improvement' else 'Critical' end as grade,
  case when score >= 90 then 'Low' when score >= 60 then 'Medium' else 'High' end as risk_level, anomaly_count, critical, high
from (select cast(greatest(0, 100 - coalesce(sum(case severity when 'Critical' then 18 when 'High' then 10 when 'Medium' then 5 else 2 end), 0)) as bigint) as score,
  count(*) as anomaly_count, count(*) filter (severity = 'Critical') as critical, count(*) filter (severity = 'High') as high from anomalies)""")
def wireless_risk_score(spark, sf):
    return W.wireless_risk(all_anomalies(spark, sf))


_PB = "case category " + " ".join(f"when {lit(k)} then {lit(' ; '.join(v))}" for k, v in fv.PLAYBOOK_COMMANDS.items()) + f" else {lit(' ; '.join(fv.PLAYBOOK_DEFAULT_COMMANDS))} end"


@query("wireless_playbooks", f"""{_W}, {ANOMALY_CTES}
select concat('PB-', id) as id, id as finding, severity, concat('Remediate ', category) as title, detail as why, recommendation as fix, {_PB} as verify from anomalies""")
def wireless_playbooks(spark, sf):
    return W.playbooks(all_anomalies(spark, sf)).withColumn("verify", F.array_join("verify", " ; "))


ACTIONS = ["Open Internal Portal", "Browse Internet", "Use ERP", "File Server"]


@query("wireless_roaming_transitions", f"""{_W},
_prev as (select *, last_value(case when type in ('roaming', 'association') then coalesce(to_ap, ap) end ignore nulls)
  over (partition by client order by ts, id rows between unbounded preceding and 1 preceding) as previous_ap from wevents)
select id, ts, client, previous_ap as from_ap, coalesce(to_ap, ap, previous_ap) as to_ap from _prev where type = 'roaming'""")
def wireless_roaming_transitions(spark, sf):
    return W.roaming_transitions(wireless_events(spark, sf))


SESSION_CTES = """
_s1 as (select e.*, last_value(case when type = 'association' then e.ssid end ignore nulls) over w as own from wevents e
  window w as (partition by client order by ts, id rows between unbounded preceding and current row)),
_s2 as (select s.*, c.role as c_role, c.ssid as c_ssid, c.vlan as c_vlan, c.ip as c_ip, c.ap as c_ap, c.status as c_status, p.ssid as p_ssid, p.role as p_role, p.expected_vlan as p_vlan
  from _s1 s left join clients c on c.name = s.client left join ssids p on lower(p.ssid) = lower(coalesce(s.own, c.ssid))),
sessions as (
  select id, client, ts, coalesce(last_value(case when type = 'association' then p_role end ignore nulls) over w, c_role) as role,
    coalesce(last_value(case when type = 'association' then p_ssid end ignore nulls) over w, c_ssid) as ssid,
    coalesce(last_value(case when type in ('association', 'roaming') then coalesce(to_ap, ap) end ignore nulls) over w, c_ap) as ap,
    coalesce(last_value(case when type = 'association' and p_ssid is not null then coalesce(vlan, p_vlan) when type = 'dhcp_assignment' then vlan end ignore nulls) over w, c_vlan) as vlan,
    coalesce(last_value(case when type in ('association', 'dhcp_assignment') then ip end ignore nulls) over w, c_ip) as ip,
    coalesce(last_value(case when type = 'association' then 'associated' when type = 'disassociation' then 'disassociated' end ignore nulls) over w, c_status, 'associated') as status,
    type as last_event
  from _s2 window w as (partition by client order by ts, id rows between unbounded preceding and current row))"""


def sessions_of(spark, sf):
    return W.client_sessions(wireless_events(spark, sf), clients(spark, sf), ssids(spark))


@query("wireless_client_sessions", f"{_W}, {SESSION_CTES} select * from sessions")
def wireless_client_sessions(spark, sf):
    return sessions_of(spark, sf)


@query("wireless_client_state", f"""{_W}, {SESSION_CTES}
select client, concat('client-', trim(regexp_replace(lower(client), '[^a-z0-9]', '-', 'g'), '-')) as client_id, arg_max(struct_pack(v := role), (ts, id))['v'] as role,
  arg_max(struct_pack(v := ssid), (ts, id))['v'] as ssid, arg_max(struct_pack(v := ap), (ts, id))['v'] as ap, arg_max(struct_pack(v := vlan), (ts, id))['v'] as vlan,
  arg_max(struct_pack(v := ip), (ts, id))['v'] as ip, arg_max(status, (ts, id)) as status, arg_max(last_event, (ts, id)) as last_event, max(ts) as last_seen, count(*) as sessions
from sessions group by client""")
def wireless_client_state(spark, sf):
    return W.client_state(sessions_of(spark, sf))


@query("wireless_session_numbers", f"""{_W}
select id, client, row_number() over (partition by client order by ts, id) as session_no from wevents""")
def wireless_session_numbers(spark, sf):
    return W.number_sessions(wireless_events(spark, sf).select("id", "client", "ts")).select("id", "client", "session_no")


_CHANGE = "case role when 'Guest' then 'Student' when 'Student' then 'Staff' else 'Guest' end"


@query("wireless_role_changes", f"""{_W}, _n as (select count(*) as n from clients)
select c.name, s.role, s.ssid, s.expected_vlan as vlan, s.expected_subnet, concat('10.10.', s.expected_vlan, '.', 1 + least(n + 40, 253)) as ip, c.ap,
  array_to_string(s.allowed_services, ',') as services
from clients c join ssids s on s.role = {_CHANGE.replace('role', 'c.role', 1)}, _n""")
def wireless_role_changes(spark, sf):
    c, s, _ = dims(spark, sf)
    changes = c.select("name", F.expr(_CHANGE).alias("new_role"), F.lit(c.count()).alias("client_count"))
    moved, _ = W.role_changes(changes, c, s)
    return moved.withColumn("services", F.array_join("services", ","))


@query("wireless_role_change_events", f"""{_W}
select 'role_change' as type, c.name as client, 'Info' as severity, c.role as old_role, s.role as new_role, c.vlan as old_vlan, s.expected_vlan as new_vlan, s.ssid, c.ap
from clients c join ssids s on s.role = {_CHANGE.replace('role', 'c.role', 1)}""")
def wireless_role_change_events(spark, sf):
    c, s, _ = dims(spark, sf)
    changes = c.select("name", F.expr(_CHANGE).alias("new_role"), F.lit(0).alias("client_count"))
    return W.role_changes(changes, c, s)[1]
