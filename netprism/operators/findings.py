"""Normalised entities, findings and their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.net import probable_ip
from ..functions.text import lookup, redact_secret, stable_id
from .merge import first_wins_rows


# fixed values: object table -> entity type
ENTITY_TYPES = {
    "devices": "device", "interfaces": "interface", "ip_inventory": "ip_address", "vlans": "vlan", "vlan_database": "vlan", "routes": "route", "routing": "route",
    "wireless_networks": "wireless_network", "ssids": "wireless_network", "acl_rules": "firewall_rule", "security_rules": "firewall_rule",
    "credentials": "credential", "secrets": "credential", "links": "topology_link", "cdp_links": "topology_link", "topology_links": "topology_link",
}
# fixed values: finding kind -> (why it matters, recommendation, category)
FINDING_TEXTS = {
    "wireless-weak": ("Attackers may join or decrypt traffic when wireless encryption is missing or weak.",
                      "Use WPA2/WPA3 Enterprise or strong WPA2/WPA3 PSK; remove WEP/open production SSIDs.", "Wireless"),
    "cleartext-secret": ("Cleartext secrets in configs or logs can enable unauthorized access if the file is shared or committed.",
                         "Rotate exposed secrets, replace plaintext with hashed/secret-store values, and redact reports by default.", "Secrets"),
    "duplicate-ip": ("Duplicate IP addresses can cause intermittent outage, hijacked traffic, or unstable routing.",
                     "Verify interface inventories and DHCP reservations; remove the conflicting assignment.", "Addressing"),
    "flat-network": ("A flat topology increases blast radius when one endpoint or VLAN is compromised.",
                     "Create separate VLANs/security zones for users, servers, guests, management, and IoT; enforce ACLs/firewall policy.", "Segmentation"),
    "missing-firewall-evidence": ("Without ACL/firewall evidence, the report cannot prove segmentation or deny rules.",
                                  "Import show access-lists, firewall policies, or running-config security sections.", "Evidence Coverage"),
    "interface-missing-vlan": ("Access ports without clear VLAN evidence make segmentation validation weaker.",
                               "Confirm access VLAN and port-security status for this interface.", "Interface Hygiene"),
    "mgmt-service": ("Exposed management services increase attack surface, especially from user or guest networks.",
                     "Restrict management services to admin VLAN/VPN, prefer SSH/HTTPS, and disable Telnet/VNC where possible.", "Exposure"),
}


def entities_of(objects: DataFrame) -> DataFrame:
    """Stacked object rows `category, name, position, confidence` to typed entities with clamped confidence."""
    kind = lookup(F.col("category"), ENTITY_TYPES)
    conf = F.col("confidence")
    scaled = F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.coalesce(F.when(conf > 1, conf / 100).otherwise(conf), F.lit(0.72))))
    return objects.withColumn("type", kind).filter("type is not null").select(
        stable_id("x", F.col("source_file"), F.col("category"), F.col("position"), F.col("name")).substr(3, 10).alias("_digest"), "type", "name", "source_file",
        scaled.alias("confidence"), F.concat(F.lit("objects."), "category", F.lit("["), (F.col("position") - 1).cast("string"), F.lit("]")).alias("raw_reference"),
        F.when(scaled >= 0.55, F.array().cast("array<string>")).otherwise(F.array(F.lit("Low-confidence recovered/inferred evidence"))).alias("warnings"),
    ).select(F.concat(F.substring("type", 1, 4), F.lit("-"), "_digest").alias("id"), "type", "name", "source_file", "confidence", "raw_reference", "warnings")


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """First entity per type, name, file and reference."""
    return first_wins_rows(entities, ["type", "name", "source_file", "raw_reference"], F.col("id"))


def entity_summary(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("entities"), F.round(F.avg(F.col("confidence").cast("decimal(12,6)")).cast("double"), 3).alias("confidence_avg"))


def duplicate_ips(rows: DataFrame, shown: int = 6) -> DataFrame:
    """Addresses with more than one owner, the number of owners, and the first owners in order.

    Owners are made distinct first; only the first few are ever collected, so
    one address with very many owners stays cheap.
    """
    from pyspark.sql import Window

    owners = rows.filter(probable_ip(F.col("ip")) & (F.coalesce("owner", F.lit("")) != "")).select("ip", "owner").distinct()
    count = owners.groupBy("ip").agg(F.count("*").alias("owners")).filter("owners > 1")
    rank = F.row_number().over(Window.partitionBy("ip").orderBy("owner"))
    first = owners.withColumn("_r", rank).filter(F.col("_r") <= shown).groupBy("ip").agg(F.sort_array(F.collect_list("owner")).alias("first_owners"))
    return count.join(first, "ip").select("ip", "owners", "first_owners")


def _finding(df: DataFrame, kind: str, title: Column, severity, confidence: float, asset: Column, evidence: Column) -> DataFrame:
    why, fix, category = FINDING_TEXTS[kind]
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return df.select(title.alias("title"), sev.alias("severity"), F.lit(confidence).alias("confidence"), asset.alias("affected_asset"), evidence.alias("_evidence"),
                     F.lit(why).alias("why_it_matters"), F.lit(fix).alias("recommendation"), F.lit(category).alias("category"), F.lit(kind).alias("kind"))


def analyze(wireless: DataFrame, credentials: DataFrame, addresses: DataFrame, interfaces: DataFrame, services: DataFrame, counts: DataFrame) -> DataFrame:
    """Seven detectors, first finding per title, asset and severity.

    wireless: name, security; credentials: name, text; addresses: ip, owner;
    interfaces: name, mode, shutdown, access_vlan; services: host, port;
    counts: one row devices, vlans, rules.
    """
    c = F.col
    mode = F.lower(F.coalesce("security", F.lit("")))
    weak = mode.isin("open", "none", "wep") | mode.contains("wep") | mode.contains("open")
    rows = [
        _finding(wireless.filter(weak), "wireless-weak", F.concat(F.lit("Weak wireless security on "), "name"),
                 F.when(mode.contains("open") | (mode == "none"), "High").otherwise("Medium"), 0.86, c("name"), F.concat(F.lit("Security mode: "), mode)),
        _finding(credentials, "cleartext-secret", F.concat(F.lit("Sensitive credential indicator detected: "), "name"), "High", 0.88, c("name"), c("text")),
        _finding(duplicate_ips(addresses), "duplicate-ip", F.concat(F.lit("Duplicate IP address candidate: "), "ip"), "Medium", 0.76, c("ip"), F.array_join("first_owners", ", ")),
        _finding(counts.filter("devices >= 3 and vlans <= 1"), "flat-network", F.lit("Possible flat network / weak segmentation"), "Medium", 0.62, F.lit("network"),
                 F.concat(c("devices").cast("string"), F.lit(" device(s), "), c("vlans").cast("string"), F.lit(" VLAN(s)"))),
        _finding(counts.filter("devices >= 2 and rules = 0"), "missing-firewall-evidence", F.lit("No firewall/ACL evidence found"), "Low", 0.55, F.lit("network"),
                 F.lit("No ACL/security-rule rows extracted")),
        _finding(interfaces.filter((F.lower("mode") == "access") & ~F.coalesce("shutdown", F.lit(False)) & (F.coalesce("access_vlan", F.lit("")) == "")), "interface-missing-vlan",
                 F.concat(F.lit("Access interface lacks VLAN evidence: "), "name"), "Low", 0.58, c("name"), c("name")),
        _finding(services.filter(c("port").isin(*fv.MANAGEMENT_PORTS)), "mgmt-service",
                 F.concat(F.lit("Management service exposed: "), lookup(c("port"), fv.MANAGEMENT_PORTS), F.lit(":"), c("port").cast("string")),
                 F.when(c("port") == 23, "High").otherwise("Medium"), 0.72, c("host"), F.concat(c("host"), F.lit(":"), c("port").cast("string"))),
    ]
    found = rows[0]
    for r in rows[1:]:
        found = found.unionByName(r)
    found = found.withColumn("evidence", redact_secret(c("_evidence")))
    # the id is made for the rows that stay, not for each that falls together with one
    first = first_wins_rows(found, ["title", "affected_asset", "severity"], F.struct("evidence", "_evidence"))
    ident = stable_id("finding", c("kind"), c("title"), c("affected_asset"), c("_evidence"))
    return first.select(ident.alias("id"), "title", "severity", "confidence", "affected_asset", "evidence", "why_it_matters", "recommendation", "category")


def ordered(findings: DataFrame) -> DataFrame:
    """Findings by severity, falling confidence and title."""
    return findings.orderBy(lookup(F.col("severity"), fv.SEVERITY_RANK, 9), F.col("confidence").desc(), "title")


def score(findings: DataFrame) -> DataFrame:
    """Weighted mean plus a bounded bonus for many findings."""
    weight = lookup(F.col("severity"), fv.SEVERITY_WEIGHT, 12)
    one = findings.agg(F.count("*").alias("n"), F.sum((weight * F.col("confidence")).cast("decimal(18,6)")).cast("double").alias("w"), F.max(weight).alias("top"))
    raw = F.least(F.lit(100.0), F.bround(F.col("w") / F.col("n") + F.least(F.lit(18), F.col("n") * 2)))
    s = F.when(F.col("n") == 0, 0).otherwise(raw).cast("int")
    label = F.when(F.col("n") == 0, "No confirmed risk").when(s >= 90, "Critical exposure").when(s >= 72, "High risk").when(s >= 45, "Moderate risk").otherwise("Low risk")
    by_weight = {v: k for k, v in fv.SEVERITY_WEIGHT.items()}
    return one.select(s.alias("score"), label.alias("label"), F.coalesce(lookup(F.col("top"), by_weight), F.lit("Info")).alias("max_severity"), F.col("n").alias("finding_count"))


def recommended_actions(findings: DataFrame, has_rules: bool = True, has_links: bool = True, first: int | None = None, limit: int | None = None) -> DataFrame:
    """Distinct recommendations of the findings in order (of the first ones only, if asked), then the gaps, findings or none."""
    # fixed values: texts of the two gaps
    gaps = [(has_rules, "Import ACL/firewall policy evidence to validate segmentation instead of guessing."),
            (has_links, "Import CDP/LLDP or topology export to improve attack-path confidence.")]
    rank = F.struct(lookup(F.col("severity"), fv.SEVERITY_RANK, 9).alias("s"), (-F.col("confidence")).alias("c"), F.col("title").alias("t"))
    top = (findings if first is None else ordered(findings).limit(first)).groupBy(F.col("recommendation").alias("action")).agg(F.min(rank).alias("r"))
    out = top.select("action", F.lit(0).alias("g"), "r")
    for i, (present, text) in enumerate(gaps):
        if not present:
            one = findings.sparkSession.range(1)
            out = out.unionByName(one.select(F.lit(text).alias("action"), F.lit(i + 1).alias("g"), F.lit(None).cast(dict(top.dtypes)["r"]).alias("r")))
    out = out.orderBy("g", "r")
    return (out if limit is None else out.limit(limit)).select("action")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))


def validation_findings(devices: DataFrame, interfaces: DataFrame, links: DataFrame, vlans: DataFrame, addresses: DataFrame, tests: DataFrame) -> DataFrame:
    """Referential and consistency findings of structured sources."""
    c = F.col
    row = lambda df, key, sev, title: df.select("file_id", F.lit(key).alias("key"), F.lit(sev).alias("severity"), title.alias("title"))
    say = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    orphan = row(interfaces.filter(F.coalesce("device", F.lit("")) == ""), "orphan-interface", "Low", say("Interface ", c("name"), " has no device owner"))
    used = interfaces.select("file_id", F.explode(F.filter(F.array("access_vlan", "native_vlan", "dot1q_vlan"), lambda v: v.isNotNull())).alias("id"))
    undefined = row(used.join(vlans.select("file_id", "id").distinct(), ["file_id", "id"], "left_anti"), "vlan-referenced-not-defined", "Medium",
                    say("VLAN ", c("id"), " referenced but not explicitly defined"))
    bare = row(interfaces.filter((c("mode") == "trunk") & (F.size("trunk_allowed_vlans") == 0)), "trunk-without-allowed-list", "Medium", say("Trunk ", c("name"), " has no allowed VLAN list"))
    ends = links.select("file_id", F.explode(F.array("device", "neighbor")).alias("id")).filter("id is not null").join(devices.select("file_id", "id").distinct(), ["file_id", "id"], "left_anti")
    ends = row(ends, "link-endpoint-not-defined", "Low", say("Link endpoint ", c("id"), " was inferred"))
    twice = addresses.groupBy("file_id", "ip").agg(F.count_distinct("owner").alias("n")).filter("n > 1")
    twice = row(twice, "duplicate-ip", "High", say("Duplicate IP candidate ", c("ip")))
    no_plan = tests.groupBy("file_id").agg(F.count("expected_result").alias("n")).filter("n = 0")
    no_plan = row(no_plan, "expected-policy-baseline-missing", "Medium", F.lit("Access matrix has observed results but no expected policy baseline"))
    name = F.lower(F.coalesce("service", "target", F.lit("")))
    mixed = tests.groupBy("file_id", F.coalesce("client", F.lit("unknown")).alias("client")).agg(
        F.max((name == "internet") & (c("result") == "success")).alias("net"), F.max((name == "dns") & (c("result") == "failed")).alias("dns")).filter("net and dns")
    mixed = row(mixed, "dns-internet-result-inconsistency", "Medium", say(c("client"), " reached Internet but DNS test failed"))
    out = orphan
    for df in (undefined, bare, ends, twice, no_plan, mixed):
        out = out.unionByName(df)
    return out


# --- lab result matrix ------------------------------------------------------
def lab_result(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(low.isin(*fv.LAB_SUCCESS), "success").when(low.isin(*fv.LAB_FAILED), "failed").when(low == "", "unknown").otherwise(low)


def client_access_matrix(tests: DataFrame) -> DataFrame:
    """Per client the first known place, counts, and services by result; tests carry `position`."""
    svc = F.coalesce("service", "target", F.lit("unknown"))
    ok, bad = F.col("result") == "success", F.col("result") == "failed"
    first = lambda col, out: F.min_by(col, F.when(F.col(col).isNotNull(), F.col("position"))).alias(out)
    key = F.coalesce("client", F.lit("unknown"))
    base = tests.groupBy(key.alias("client")).agg(
        first("actual_ssid", "ssid"), first("actual_vlan", "vlan"), first("actual_ip", "ip"), first("ap_name", "ap"), F.count_if(ok).alias("allowed_count"), F.count_if(bad).alias("blocked_count"))
    # a service is one row per client and result before it is listed, so lists hold services, not tests
    services = tests.filter(ok | bad).groupBy(key.alias("client"), "result", svc.alias("svc")).agg(F.min("position").alias("p"))
    listed = services.groupBy("client").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("result") == r, F.struct("p", "svc")))), lambda s: s["svc"]), ",").alias(n)
                                              for r, n in (("success", "services_allowed"), ("failed", "services_blocked"))])
    return base.join(listed, "client", "left")


def lab_summary(tests: DataFrame) -> DataFrame:
    d = F.count_distinct
    return tests.agg(
        F.count("*").alias("total_tests"), F.count_if(F.col("result") == "success").alias("success"), F.count_if(F.col("result") == "failed").alias("failed"),
        d(F.coalesce("client", F.lit("unknown"))).alias("clients"), d("actual_ssid").alias("ssids"), d("actual_vlan").alias("vlans"), d("ap_name").alias("aps"),
        d(F.coalesce("service", "target", F.lit("unknown"))).alias("services"))


