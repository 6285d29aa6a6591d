"""Wireless policy against clients, access points and events.

Dimension sides carry no broadcast hint: Catalyst broadcasts them when their
measured size allows it, and AQE splits hot keys otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.net import cidr_base, cidr_prefix, ip_to_long, nth_host, prefix_mask
from ..functions.text import client_slug, lookup
from .carry import carry_forward, running_count, with_row_chunks

SSID_FIELDS = ["ssid", "role", "expected_vlan", "expected_subnet", "internet", "internal_access", "allowed_services"]


def ssid_dimensions(ssids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First SSID row per name and per role, in policy order."""
    net, mask = cidr_base(F.col("expected_subnet")), prefix_mask(cidr_prefix(F.col("expected_subnet")))
    row = F.min_by(F.struct(*SSID_FIELDS, net.alias("net"), mask.alias("mask"),
                            nth_host(F.col("expected_subnet"), F.lit(40)).alias("first_ip")), "position")
    return (ssids.groupBy(F.lower("ssid").alias("_ssid_key")).agg(row.alias("_by_name")),
            ssids.groupBy(F.lower("role").alias("_role_key")).agg(row.alias("_by_role")))


def with_policy(df: DataFrame, ssids: DataFrame, ssid: Column, role: Column) -> DataFrame:
    """Add `policy`: the SSID row by name, else by role, as one whole struct."""
    by_name, by_role = ssid_dimensions(ssids)
    return (
        df.withColumn("_s", F.lower(ssid)).withColumn("_r", F.lower(role))
        .join(by_name, F.col("_s") == F.col("_ssid_key"), "left").join(by_role, F.col("_r") == F.col("_role_key"), "left")
        .withColumn("policy", F.coalesce("_by_name", "_by_role"))
        .drop("_s", "_r", "_ssid_key", "_role_key", "_by_name", "_by_role")
    )


def _client_checks(clients: DataFrame, ssids: DataFrame, aps: DataFrame) -> DataFrame:
    known = aps.select(F.col("name").alias("_ap"), F.col("supported_vlans").alias("_vlans"))
    df = with_policy(clients, ssids, F.col("ssid"), F.col("role")).join(known, F.col("ap") == F.col("_ap"), "left")
    expected = F.coalesce("policy.expected_vlan", F.lit(""))
    subnet = F.coalesce("policy.expected_subnet", F.lit(""))
    ok = lambda c: F.coalesce(c, F.lit(False))
    vlan_ok = ok(F.coalesce("vlan", F.lit("")) == expected)
    role_ok = ok(F.lower(F.coalesce("role", F.lit(""))) == F.lower(F.coalesce("policy.role", F.lit(""))))
    dhcp_ok = ok(ip_to_long(F.col("ip")).bitwiseAND(F.col("policy.mask")) == F.col("policy.net"))
    ap_ok = ok(F.array_contains("_vlans", expected))
    return df.withColumns({"_expected": expected, "_subnet": subnet}).withColumns(
        {"_vlan_ok": vlan_ok, "_role_ok": role_ok, "_dhcp_ok": dhcp_ok, "_ap_ok": ap_ok})


def _status(flag: str, bad: str) -> Column:
    return F.when(F.col(flag), "Pass").otherwise(bad)


def client_matrix(clients: DataFrame, ssids: DataFrame, aps: DataFrame) -> DataFrame:
    """One row per client: VLAN, DHCP, access point and role checks with the combined result."""
    df = _client_checks(clients, ssids, aps)
    result = F.when(F.col("_vlan_ok") & F.col("_dhcp_ok") & F.col("_ap_ok") & F.col("_role_ok"), "Pass").when(
        ~F.col("_vlan_ok") | ~F.col("_role_ok"), "Fail").otherwise("Review")
    return df.select(
        F.col("name").alias("client"), "role", "ssid", "ap", F.col("_expected").alias("expected_vlan"),
        F.coalesce("vlan", F.lit("")).alias("actual_vlan"), _status("_vlan_ok", "Fail").alias("vlan_status"), "ip",
        F.col("_subnet").alias("dhcp_scope"), _status("_dhcp_ok", "Review").alias("dhcp_status"),
        _status("_ap_ok", "Fail").alias("ap_trunk_status"), _status("_role_ok", "Fail").alias("role_status"), result.alias("result"),
        F.when(result == "Pass", 95).when(result == "Review", 75).otherwise(88).alias("confidence"),
    )


def _active(clients: DataFrame) -> DataFrame:
    return clients.filter(F.coalesce("status", F.lit("associated")) != "disassociated")


def ap_load(clients: DataFrame, aps: DataFrame, warning: int = fv.AP_LOAD_WARNING, critical: int = fv.AP_LOAD_CRITICAL) -> DataFrame:
    """Active clients per access point, also those without clients, with share of capacity and health."""
    counts = _active(clients).groupBy(F.col("ap").alias("name")).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    capacity = F.when(F.coalesce("max_clients", F.lit(0)) == 0, 1).otherwise(F.col("max_clients"))
    pct = F.bround(n / capacity * 100, 1)
    return aps.join(counts, "name", "left").select(
        *aps.columns, n.alias("current_clients"), pct.alias("load_percent"),
        F.when(pct >= critical, "Critical").when(pct >= warning, "Warning").otherwise("Healthy").alias("health"))


def client_distribution(clients: DataFrame) -> DataFrame:
    """Active clients by access point, by SSID and by role in one pass."""
    g = _active(clients).groupingSets([[F.col("ap")], [F.col("ssid")], [F.col("role")]], "ap", "ssid", "role").agg(
        F.count("*").alias("clients"), F.grouping_id().alias("_set"))
    by = F.when(F.col("_set") == 3, "ap").when(F.col("_set") == 5, "ssid").otherwise("role")
    return g.select(by.alias("dimension"), F.coalesce("ap", "ssid", "role").alias("value"), "clients")


def event_correlation(events: DataFrame, clients: DataFrame, ssids: DataFrame, aps: DataFrame) -> DataFrame:
    """Every event with client, policy and the wired path of its access point."""
    who = clients.select(F.col("name").alias("_name"), F.struct("ssid", "role", "ap", "vlan").alias("_c"))
    known = aps.select(F.col("name").alias("_ap"), F.struct("switch", "uplink_interface", "supported_vlans").alias("_a"))
    df = events.join(who, F.col("client") == F.col("_name"), "left")
    df = with_policy(df, ssids, F.coalesce("ssid", "_c.ssid"), F.col("_c.role"))
    df = df.withColumn("_ap_name", F.coalesce("to_ap", "ap", "_c.ap")).join(known, F.col("_ap_name") == F.col("_ap"), "left")
    vlan = F.coalesce(F.when(F.col("policy").isNotNull(), F.col("policy.expected_vlan")), "_c.vlan", F.lit(""))
    supported = F.coalesce(F.array_contains("_a.supported_vlans", vlan), F.lit(False))
    path = F.concat(F.coalesce("_ap_name", F.lit("Unknown AP")), F.lit(" → "), F.coalesce("_a.switch", F.lit("Unknown switch")), F.lit(" "),
                    F.coalesce("_a.uplink_interface", F.lit("Unknown uplink")), F.lit(" → VLAN "), vlan)
    return df.select(
        "id", F.col("ts").alias("time"), F.col("type").alias("event_type"), "client", F.coalesce("policy.ssid", F.col("ssid"), F.lit("")).alias("ssid"),
        vlan.alias("expected_vlan"), F.coalesce("_ap_name", F.lit("unknown")).alias("ap"), path.alias("wired_path"),
        F.when(supported, "Pass").when(F.col("type").isin("import", "simulation", "acl_check"), "Review").otherwise("Fail").alias("status"))


def unknown_aps(clients: DataFrame, aps: DataFrame) -> DataFrame:
    named = clients.filter(F.coalesce("ap", F.lit("")) != "")
    return named.join(aps.select(F.col("name").alias("ap")), "ap", "left_anti")


def event_thresholds(events: DataFrame, auth: int = fv.AUTH_FAILURE_THRESHOLD, roam: int = fv.ROAMING_THRESHOLD) -> DataFrame:
    """Clients with too many authentication failures or roams, over all history."""
    key = F.when(F.col("type") == "roaming", F.coalesce("client", F.lit("unknown"))).otherwise(F.coalesce("client", "ssid", F.lit("unknown")))
    return (
        events.filter(F.col("type").isin("authentication_failure", "roaming")).groupBy("type", key.alias("key")).agg(F.count("*").alias("n"))
        .filter(F.col("n") >= F.when(F.col("type") == "roaming", roam).otherwise(auth))
    )


def _say(*parts) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("None")) if isinstance(p, Column) else F.lit(p) for p in parts])


def anomalies(clients: DataFrame, ssids: DataFrame, aps: DataFrame, events: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    """All detectors. The client detectors share one pass over the checked clients."""
    c = F.col
    checked = _client_checks(clients, ssids, aps)

    def hit(test: Column, detector: str, severity: str, category: str, asset: Column, detail: Column) -> Column:
        return F.when(test, F.struct(
            F.lit(detector).alias("detector"), _say(detector + "-", c("name")).alias("id"), F.lit(severity).alias("severity"),
            F.lit(category).alias("category"), asset.alias("asset"), detail.alias("detail")))

    extra_service = F.exists("services", lambda s: ~s.isin("Internet", "DNS")) if "services" in clients.columns else F.lit(False)
    hits = F.array(
        hit(~c("_role_ok"), "ROLE-SSID", "High", "Role/SSID mismatch", c("name"), _say(c("name"), " role ", c("role"), " does not match SSID ", c("ssid"), " policy.")),
        hit(~c("_vlan_ok"), "VLAN-MISMATCH", "Critical", "VLAN mismatch", c("name"), _say("Expected VLAN ", c("_expected"), " but client is on VLAN ", F.coalesce("vlan", F.lit("")), ".")),
        hit(~c("_dhcp_ok"), "DHCP-MISMATCH", "Medium", "DHCP scope mismatch", c("name"), _say("Client IP ", c("ip"), " is not proven inside ", c("_subnet"), ".")),
        hit(~c("_ap_ok"), "AP-VLAN", "High", "AP VLAN support", c("ap"), _say(c("ap"), " does not support expected VLAN ", c("_expected"), " for ", c("ssid"), ".")),
        hit((F.coalesce("ap", F.lit("")) != "") & c("_ap").isNull(), "UNKNOWN-AP", "High", "Unknown AP", c("ap"),
            _say("Client ", c("name"), " is associated to AP ", c("ap"), " which is not in inventory.")),
        hit((c("status") == "associated") & (F.coalesce("ip", F.lit("")) == ""), "NO-IP", "Medium", "DHCP missing", c("name"),
            _say("Associated client ", c("name"), " has no recorded IP lease.")),
        hit((c("role") == "Guest") & extra_service, "PS-GUEST-DENY-INTERNAL", "Critical", "Policy Studio", c("name"),
            F.lit("Policy Studio rule failed: Guest must be isolated from internal services.")),
    )
    from_clients = checked.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("h.*")
    load = ap_load(clients, aps).filter(c("health") != "Healthy").select(
        F.lit("AP-LOAD").alias("detector"), _say("AP-LOAD-", c("name")).alias("id"),
        F.when(c("health") == "Critical", "High").otherwise("Medium").alias("severity"), F.lit("AP load").alias("category"), c("name").alias("asset"),
        _say("AP load is ", F.format_string("%.1f", "load_percent"), "% (", c("current_clients"), "/", c("max_clients"), " clients).").alias("detail"))
    counts = event_thresholds(events)
    is_roam = c("type") == "roaming"
    from_events = counts.select(
        F.when(is_roam, "ROAMING").otherwise("AUTH-FAIL").alias("detector"),
        F.concat(F.when(is_roam, "ROAMING-").otherwise("AUTH-FAIL-"), c("key")).alias("id"), F.when(is_roam, "Medium").otherwise("High").alias("severity"),
        F.when(is_roam, "Roaming instability").otherwise("Authentication failures").alias("category"), c("key").alias("asset"),
        F.when(is_roam, _say(c("n"), " roaming events detected for one client.")).otherwise(_say(c("n"), " authentication failures detected.")).alias("detail"))
    out = from_clients.unionByName(load).unionByName(from_events).withColumn("recommendation", lookup(c("category"), fv.ANOMALY_RECOMMENDATIONS))
    if diffs is not None:
        drift = diffs.filter(c("status") != "Pass").select(
            F.lit("WIRED").alias("detector"), _say("WIRED-", c("id")).alias("id"), "severity", F.lit("Wired policy drift").alias("category"), "asset",
            c("actual").alias("detail"), "recommendation")
        out = out.unionByName(drift)
    return out.withColumn("confidence", F.when(c("severity").isin("Critical", "High"), 90).otherwise(75))


def wireless_risk(found: DataFrame) -> DataFrame:
    """Score 0-100 and grade from all anomalies."""
    sev = F.col("severity")
    weight = F.when(sev == "Critical", 18).when(sev == "High", 10).when(sev == "Medium", 5).otherwise(2)
    score = F.greatest(F.lit(0), F.lit(100) - F.coalesce(F.sum(weight), F.lit(0)))
    return found.agg(
        score.cast("long").alias("score"), F.count("*").alias("anomaly_count"), F.count_if(sev == "Critical").alias("critical"), F.count_if(sev == "High").alias("high")
    ).select("score", _grade(F.col("score")).alias("grade"), _level(F.col("score")).alias("risk_level"), "anomaly_count", "critical", "high")


def _grade(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 60, "Needs Improvement").otherwise("Critical")


def _level(score: Column) -> Column:
    return F.when(score >= 90, "Low").when(score >= 60, "Medium").otherwise("High")


def confidence_meter(objects: DataFrame, events: DataFrame, aps: DataFrame, sessions: DataFrame, ssids: DataFrame, diffs: DataFrame) -> DataFrame:
    """How much evidence is present, minus a bounded penalty for drift."""
    parts = [(objects, 35), (events, 20), (aps, 15), (sessions, 15), (ssids, 15)]
    present = None
    for df, weight in parts:
        one = df.limit(1).select(F.lit(weight).alias("w"), F.lit(0).alias("f"))
        present = one if present is None else present.unionByName(one)
    fails = diffs.filter(F.col("status") != "Pass").agg(F.count("*").cast("int").alias("f")).select(F.lit(0).alias("w"), "f")
    total = present.unionByName(fails).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"), F.coalesce(F.sum("f"), F.lit(0)).alias("f"))
    penalty = F.least(F.lit(20), F.col("f") * 2)
    score = F.greatest(F.lit(20), F.least(F.lit(100), F.col("w") - penalty))
    return total.select(score.cast("long").alias("score"), F.when(score >= 80, "High").when(score >= 55, "Medium").otherwise("Low").alias("level"),
                        penalty.cast("long").alias("wired_drift_penalty"))


def playbooks(found: DataFrame) -> DataFrame:
    table = F.coalesce(*[F.when(F.col("category") == k, F.array(*[F.lit(x) for x in v])) for k, v in fv.PLAYBOOK_COMMANDS.items()],
                       F.array(*[F.lit(x) for x in fv.PLAYBOOK_DEFAULT_COMMANDS]))
    return found.select(
        F.concat(F.lit("PB-"), "id").alias("id"), F.col("id").alias("finding"), "severity", F.concat(F.lit("Remediate "), "category").alias("title"),
        F.col("detail").alias("why"), F.col("recommendation").alias("fix"), table.alias("verify"))


def access_decisions(clients: DataFrame, ssids: DataFrame, isolation: DataFrame, actions: list[str]) -> DataFrame:
    """Policy verdict for every client and action; isolation holds `ssid, isolation_status`, and `client` where it is known for each."""
    asked = clients.select("name", "role", F.explode(F.array(*[F.lit(a) for a in actions])).alias("action"))
    _, by_role = ssid_dimensions(ssids)
    df = asked.join(by_role, F.lower("role") == F.col("_role_key"), "left").withColumn("policy", F.col("_by_role"))
    same = F.col("policy.ssid") == F.col("_iso_ssid")
    known = isolation.withColumnRenamed("ssid", "_iso_ssid")
    if "client" in isolation.columns:
        known, same = known.withColumnRenamed("client", "_iso_client"), same & (F.col("name") == F.col("_iso_client"))
    df = df.join(known, same, "left")
    a = F.col("action")
    service = F.when(a.contains("Internal"), "Internal Portal").when(a.contains("Internet"), "Internet").when(a.contains("ERP"), "ERP").otherwise(a)
    allowed = F.coalesce(F.array_contains("policy.allowed_services", service), F.lit(False)) | (
        (service == "Internet") & F.coalesce("policy.internet", F.lit(False)))
    guarded = (F.coalesce("policy.internal_access", F.lit("")) == "false") & (a.contains("Internal") | a.contains("ERP") | a.contains("File"))
    status = F.when(guarded, F.when(F.col("isolation_status") == "Pass", "Pass").otherwise("Fail")).when(allowed, "Pass").otherwise("Review")
    return df.select(
        F.col("name").alias("client"), "action", F.col("policy.ssid").alias("ssid"), F.col("policy.expected_vlan").alias("vlan"), service.alias("service"),
        status.alias("status"), F.when(status == "Pass", "Info").when(status == "Fail", "Critical").otherwise("Medium").alias("severity"))


# --- event sourcing ---------------------------------------------------------
def _with_order(events: DataFrame) -> DataFrame:
    return with_row_chunks(events.withColumn("_o", F.struct("ts", "id")), "_part", "client", "ts")


def roaming_transitions(events: DataFrame) -> DataFrame:
    """Roams with the access point before them, from the client's own history when the event does not say."""
    new_ap = F.when(F.col("type").isin("roaming", "association"), F.coalesce("to_ap", "ap"))
    df = carry_forward(_with_order(events), {"previous_ap": new_ap}, key="client", order="_o", chunk=F.col("_part"), inclusive=False)
    own = F.col("from_ap") if "from_ap" in events.columns else F.lit(None).cast("string")
    return df.filter(F.col("type") == "roaming").select(
        "id", "ts", "client", F.coalesce(own, "previous_ap").alias("from_ap"), F.coalesce("to_ap", "ap", "previous_ap").alias("to_ap"))


def client_sessions(events: DataFrame, clients: DataFrame, ssids: DataFrame) -> DataFrame:
    """Client state after every event (one session row per event)."""
    kind = F.col("type")
    assoc = kind == "association"
    dims = ssid_dimensions(ssids)[0].withColumnsRenamed({"_ssid_key": "_key", "_by_name": "_p"})
    start = clients.select(F.col("name").alias("client"), F.struct("role", "ssid", "vlan", "ip", "ap", "status").alias("_c"))
    df = _with_order(events).join(dims.select("_key", F.col("_p.ssid").alias("_known")), F.lower("ssid") == F.col("_key"), "left").drop("_key")
    df = carry_forward(df, {"_own": F.when(assoc, F.col("_known")), "_seen": F.lit(True)}, key="client", order="_o", chunk=F.col("_part"))
    df = df.join(start, "client", "left").withColumn("_ssid", F.coalesce("_own", "_c.ssid"))
    df = df.join(dims, F.lower("_ssid") == F.col("_key"), "left").drop("_key")
    ap = F.coalesce("to_ap", "ap")
    df = carry_forward(df, {
        "s_status": F.when(assoc, "associated").when(kind == "disassociation", "disassociated"),
        "s_ssid": F.when(assoc, F.col("_p.ssid")), "s_role": F.when(assoc, F.col("_p.role")),
        "s_vlan": F.when(assoc & F.col("_p").isNotNull(), F.coalesce("vlan", "_p.expected_vlan")).when(kind == "dhcp_assignment", F.col("vlan")),
        "s_ap": F.when(assoc | (kind == "roaming"), ap), "s_ip": F.when(assoc | (kind == "dhcp_assignment"), F.col("ip")),
        # what a client unknown to the inventory starts with: the values of its first event
        "s_first": F.when(F.col("_c").isNull(), F.struct(
            F.col("ssid").alias("ssid"), F.coalesce("_p.role", F.lit("Guest")).alias("role"), F.coalesce("vlan", "_p.expected_vlan", F.lit("")).alias("vlan"),
            F.coalesce("ip", "_p.first_ip", F.lit("10.10.30.41")).alias("ip"), F.coalesce(ap, F.lit("AP-01")).alias("ap"))),
    }, key="client", order="_o", chunk=F.col("_part"))
    pick = lambda f: F.coalesce(f"s_{f}", f"_c.{f}", f"s_first.{f}").alias(f)
    return df.select(
        "id", "client", "ts", pick("role"), pick("ssid"), pick("ap"), pick("vlan"), pick("ip"),
        F.coalesce("s_status", "_c.status", F.lit("associated")).alias("status"), kind.alias("last_event"))


def client_state(sessions: DataFrame) -> DataFrame:
    """Latest state per client: the last session row, by one partial aggregation."""
    fields = ["role", "ssid", "ap", "vlan", "ip", "status", "last_event"]
    return sessions.groupBy("client").agg(
        F.max_by(F.struct(*fields, "ts"), F.struct("ts", "id")).alias("s"), F.count("*").alias("sessions")
    ).select("client", client_slug(F.col("client")).alias("client_id"), *[f"s.{f}" for f in fields], F.col("s.ts").alias("last_seen"), "sessions")


def number_sessions(sessions: DataFrame) -> DataFrame:
    """Running session number per client, counted by chunks of rows."""
    df = _with_order(sessions)
    return running_count(df, {"session_no": F.lit(True)}, key="client", order="_o", chunk=F.col("_part")).drop("_o", "_part")


def role_changes(changes: DataFrame, clients: DataFrame, ssids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clients moved to a new role, and the role_change events; changes holds `name, new_role, client_count`."""
    _, by_role = ssid_dimensions(ssids)
    df = changes.join(clients, "name").join(by_role, F.lower("new_role") == F.col("_role_key")).withColumn("p", F.col("_by_role"))
    ip = F.coalesce(F.nullif(nth_host(F.col("p.expected_subnet"), F.col("client_count") + 40), F.lit("")), "ip", F.lit(""))
    moved = df.select("name", F.col("p.role").alias("role"), F.col("p.ssid").alias("ssid"), F.col("p.expected_vlan").alias("vlan"),
                      F.col("p.expected_subnet").alias("expected_subnet"), ip.alias("ip"), "ap", F.col("p.allowed_services").alias("services"))
    log = df.select(
        F.lit("role_change").alias("type"), F.col("name").alias("client"), F.lit("Info").alias("severity"), F.col("role").alias("old_role"),
        F.col("p.role").alias("new_role"), F.col("vlan").alias("old_vlan"), F.col("p.expected_vlan").alias("new_vlan"), F.col("p.ssid").alias("ssid"), "ap")
    return moved, log
