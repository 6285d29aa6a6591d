"""Wired state against wireless policy: joins of extracted tables, diffs, causes and scores.

`scope` is the namespace of one import (a file by default). Each scope is
checked against every SSID row: that product is what is asked for. SSID rows are
parameters of a policy, read once with a checked bound, and each scope explodes
one literal array of them, so no join is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.net import DOTTED_STRICT, cidr_base, cidr_prefix, ip_to_long, prefix_mask

from .wireless import _grade, _level

LINE = "evidence.source_line"
#: SSID rows that a policy may have; they are parameters, not data.
POLICY_ROWS = 1000


def for_each_ssid(scopes: DataFrame, ssids: DataFrame, fields: tuple[str, ...] = ("ssid", "expected_vlan", "expected_subnet", "internal_access")) -> DataFrame:
    """Every scope with every SSID row of the policy."""
    rows = ssids.select(*fields).limit(POLICY_ROWS + 1).collect()
    if len(rows) > POLICY_ROWS:
        raise ValueError(f"a policy has {POLICY_ROWS} SSID rows at most")
    kinds = dict(ssids.dtypes)
    policy = F.array(*[F.struct(*[F.lit(r[f]).cast(kinds[f]).alias(f) for f in fields]) for r in rows])
    if not rows:
        policy = F.array().cast("array<struct<" + ",".join(f"{f}:{kinds[f]}" for f in fields) + ">>")
    return scopes.select("*", F.explode(policy).alias("_s")).select(*scopes.columns, "_s.*")


# --- joins between extracted tables -----------------------------------------
def acl_bindings(interfaces: DataFrame) -> DataFrame:
    """One row per interface and direction that names an access list."""
    sides = F.filter(F.array(
        F.struct(F.lit("in").alias("direction"), F.col("acl_in").alias("acl_name")),
        F.struct(F.lit("out").alias("direction"), F.col("acl_out").alias("acl_name"))), lambda s: s["acl_name"].isNotNull())
    return interfaces.select("file_id", F.col("name").alias("interface"), F.col(LINE).alias("binding_line"), F.explode(sides).alias("s")).select(
        "file_id", "s.acl_name", "interface", "s.direction", "binding_line")


def bind_acls(rules: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Rules with the number of bindings and the first of them; `acl_bindings` holds them all."""
    first = F.min_by(F.struct("interface", "direction", "binding_line"), F.struct("binding_line", "direction"))
    bound = acl_bindings(interfaces).groupBy("file_id", "acl_name").agg(F.count("*").alias("applied_count"), first.alias("first_binding"))
    return rules.join(bound, ["file_id", "acl_name"], "left").withColumns(
        {"applied_count": F.coalesce("applied_count", F.lit(0)), "is_applied": F.coalesce(F.col("applied_count") > 0, F.lit(False))})


def interface_vlan(interfaces: DataFrame) -> DataFrame:
    """VLAN -> interface rows over access, tagged and native VLAN, each pair once."""
    ids = F.array_distinct(F.filter(F.array("access_vlan", "dot1q_vlan", "native_vlan"), lambda v: v.isNotNull()))
    return interfaces.select("file_id", F.explode(ids).alias("vlan"), "name", "acl_in", "acl_out", "mode", F.col(LINE).alias("line"))


def match_dhcp_gateways(scopes: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Pool gateway = interface address; the last interface with an address counts."""
    vlan = F.coalesce("dot1q_vlan", "access_vlan", "native_vlan")
    owner = interfaces.filter(F.col("ip_address").isNotNull()).groupBy("file_id", F.col("ip_address").alias("default_gateway")).agg(
        F.max_by(F.struct(F.col("name").alias("i"), vlan.alias("v")), LINE).alias("m"))
    return scopes.join(owner, ["file_id", "default_gateway"], "left").select(
        "file_id", F.col("name").alias("pool"), "cidr", "default_gateway", F.col("m.i").alias("matched_interface"), F.col("m.v").alias("matched_vlan"),
        F.when(F.col("m").isNotNull(), "match").otherwise("unmatched").alias("status"),
        F.when(F.col("m").isNotNull(), 0.93).otherwise(0.42).alias("confidence"), F.col(LINE).alias("evidence_line"))


def trunk_vlans(interfaces: DataFrame) -> DataFrame:
    """Trunk interface -> carried VLAN (`all` stays `all`)."""
    trunk = (F.col("mode") == "trunk") | (F.size("trunk_allowed_vlans") > 0)
    return interfaces.filter(trunk).select("file_id", "name", F.col(LINE).alias("line"), F.explode_outer("trunk_allowed_vlans").alias("vlan"))


def relationships(interfaces: DataFrame, gateways: DataFrame) -> DataFrame:
    """Interface-VLAN, trunk-VLAN, ACL-interface and pool-VLAN pairs in one table."""
    rel = lambda df, kind, a, b: df.select("file_id", F.lit(kind).alias("relation"), F.col(a).alias("source"), F.col(b).alias("target"))
    return (
        rel(interface_vlan(interfaces), "interface_vlan", "name", "vlan")
        .unionByName(rel(trunk_vlans(interfaces).filter("vlan is not null"), "trunk_vlan", "name", "vlan"))
        .unionByName(rel(acl_bindings(interfaces), "acl_interface", "acl_name", "interface"))
        .unionByName(rel(gateways.filter("matched_vlan is not null"), "dhcp_vlan", "pool", "matched_vlan"))
    )


def guest_deny_candidate(action: Column, expression: Column, source: Column, destination: Column, subnet: Column) -> Column:
    """Deny rule whose source is the guest net and whose target is internal."""
    net = F.split(subnet, "/").getItem(0)
    prefix = F.concat(F.substring_index(net, ".", 3), F.lit("."))
    low, dst = F.lower(expression), F.lower(F.coalesce(destination, F.lit("")))
    from_guest = F.contains(low, net) | F.contains(low, prefix) | (F.lower(F.coalesce(source, F.lit(""))) == "any")
    internal = low.contains("10.10.") | dst.startswith("10.") | low.contains("internal")
    return F.coalesce((action == "deny") & from_guest & internal, F.lit(False))


def guest_isolation(scopes: DataFrame, interfaces: DataFrame, rules: DataFrame) -> DataFrame:
    """Per scope and SSID row: is a deny rule bound to the SSID's VLAN, only present, or absent?

    scopes holds `file_id, ssid, expected_vlan, expected_subnet`. Rules are
    reduced per list and SSID subnet before they meet the interfaces.
    """
    denies = rules.filter(F.col("action") == "deny").select(
        "file_id", "acl_name", "action", "expression", F.col("parsed.source").alias("src"), F.col("parsed.destination").alias("dst"), F.col(LINE).alias("rule_line"))
    candidate = guest_deny_candidate(F.col("action"), F.col("expression"), F.col("src"), F.col("dst"), F.col("expected_subnet"))
    lists = (
        scopes.select("file_id", "ssid", "expected_vlan", "expected_subnet").join(denies, "file_id").filter(candidate)
        .groupBy("file_id", "ssid", "expected_vlan", "acl_name").agg(F.min("rule_line").alias("rule_line"))
    )
    vlan_acl = interface_vlan(interfaces).select("file_id", F.col("vlan").alias("expected_vlan"), "name", "line", F.explode(F.filter(F.array(
        F.struct(F.lit("in").alias("direction"), F.col("acl_in").alias("acl_name")),
        F.struct(F.lit("out").alias("direction"), F.col("acl_out").alias("acl_name"))), lambda s: s["acl_name"].isNotNull())).alias("s")).select(
        "file_id", "expected_vlan", "name", "line", "s.*")
    applied = lists.join(vlan_acl, ["file_id", "expected_vlan", "acl_name"]).groupBy("file_id", "ssid").agg(F.min_by(F.struct(
        "acl_name", "direction", F.col("name").alias("interface"), "rule_line"), F.struct("line", "direction", "rule_line")).alias("a"))
    present = lists.groupBy("file_id", "ssid").agg(F.min_by(F.struct("acl_name", "rule_line"), "rule_line").alias("p"))
    df = scopes.join(applied, ["file_id", "ssid"], "left").join(present, ["file_id", "ssid"], "left")
    ok, some = F.col("a").isNotNull(), F.col("p").isNotNull()
    return df.select(
        "file_id", "ssid", F.when(ok, "Pass").when(some, "Review").otherwise("Fail").alias("isolation_status"),
        F.when(ok, F.concat(F.lit("ACL "), "a.acl_name", F.lit(" is applied "), "a.direction", F.lit(" on "), "a.interface",
                            F.lit(" and contains a deny rule for guest-to-internal traffic.")))
        .when(some, F.concat(F.lit("Deny rule exists in ACL "), "p.acl_name", F.lit(", but no interface binding was confirmed for VLAN "), "expected_vlan", F.lit(".")))
        .otherwise(F.concat(F.lit("No applied deny ACL was found for guest VLAN "), "expected_vlan", F.lit("."))).alias("isolation_reason"),
        F.coalesce("a.rule_line", "p.rule_line").alias("isolation_line"), F.when(ok, 0.94).when(some, 0.62).otherwise(0.78).alias("isolation_confidence"))


# --- policy diff ------------------------------------------------------------
def policy_diff(objects: dict[str, DataFrame], ssids: DataFrame, scopes: DataFrame) -> DataFrame:
    """Three to five checks per scope and SSID, each with status, severity, line and confidence.

    objects: vlans, interfaces, dhcp_scopes, gateways, acl_rules. scopes: one `file_id` per import.
    """
    interfaces, vlans, pools, gateways = (objects[k] for k in ("interfaces", "vlans", "dhcp_scopes", "gateways"))
    base = for_each_ssid(scopes.select("file_id"), ssids)

    # where each VLAN is seen, with the line that the lookup order would pick: VLAN table, then interface order
    direct = vlans.select("file_id", F.col("id").alias("vlan"), F.struct(F.lit(0).alias("rank"), F.col(LINE).alias("line")).alias("o"))
    ports = interfaces.select("file_id", F.struct(F.lit(1).alias("rank"), F.col(LINE).alias("line")).alias("o"), F.explode(F.array_distinct(F.filter(
        F.concat(F.array("access_vlan", "dot1q_vlan", "native_vlan"), "trunk_allowed_vlans"), lambda v: v.isNotNull()))).alias("vlan"))
    seen = direct.unionByName(ports).groupBy("file_id", F.col("vlan").alias("expected_vlan")).agg(F.min("o").alias("v"))
    pool = pools.filter("cidr is not null").groupBy("file_id", F.col("cidr").alias("expected_subnet")).agg(
        F.min_by(F.struct("name", "default_gateway", F.col(LINE).alias("line")), LINE).alias("p"))
    gateway = gateways.groupBy("file_id", F.col("pool").alias("_pool")).agg(F.min_by(F.struct("matched_interface", "matched_vlan"), "evidence_line").alias("g"))
    trunks = trunk_vlans(interfaces)
    per_vlan = trunks.groupBy("file_id", F.col("vlan").alias("expected_vlan")).agg(F.count_distinct("name", "line").alias("n"), F.min("line").alias("line"))
    any_trunk = trunks.groupBy("file_id").agg(
        F.min("line").alias("trunk_line"), F.count_distinct(F.when(F.col("vlan") == "all", F.struct("name", "line"))).alias("all_n"),
        F.min(F.when(F.col("vlan") == "all", F.col("line"))).alias("all_line"))
    applied = interface_vlan(interfaces).select("file_id", F.col("vlan").alias("expected_vlan"), "line", F.explode(F.filter(F.array(
        F.struct(F.lit(0).alias("d"), F.col("acl_in").alias("acl")), F.struct(F.lit(1).alias("d"), F.col("acl_out").alias("acl"))),
        lambda s: s["acl"].isNotNull())).alias("s")).groupBy("file_id", "expected_vlan").agg(
        F.min_by(F.struct("s.acl", "line"), F.struct("line", "s.d")).alias("acl"), F.count("*").alias("acl_n"))
    isolation = guest_isolation(base.filter("internal_access = 'false'"), interfaces, objects["acl_rules"])

    df = (
        base.join(seen, ["file_id", "expected_vlan"], "left").join(pool, ["file_id", "expected_subnet"], "left")
        .withColumn("_pool", F.col("p.name")).join(gateway, ["file_id", "_pool"], "left")
        .join(per_vlan.select("file_id", "expected_vlan", F.col("n").alias("vlan_n"), F.col("line").alias("vlan_trunk_line")), ["file_id", "expected_vlan"], "left")
        .join(any_trunk, "file_id", "left").join(applied, ["file_id", "expected_vlan"], "left").join(isolation, ["file_id", "ssid"], "left")
    )
    c = F.col
    cat = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])

    def check(kind, category, present, status, bad_severity, line, good_conf, bad_conf, actual, recommendation):
        good = status == "Pass"
        num = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(present, F.struct(
            cat(kind + "-", c("ssid")).alias("id"), c("ssid").alias("asset"), F.lit(category).alias("category"), actual.alias("actual"), status.alias("status"),
            F.when(good, "Info").otherwise(bad_severity).alias("severity"), line.cast("long").alias("evidence_line"),
            F.when(good, num(good_conf)).otherwise(num(bad_conf)).cast("double").alias("confidence"),
            F.when(good, "No action required.").otherwise(recommendation).alias("recommendation")))

    has_vlan, has_pool, has_trunk = c("v").isNotNull(), c("p").isNotNull(), c("trunk_line").isNotNull()
    carrying = F.coalesce("vlan_n", F.lit(0)) + F.coalesce("all_n", F.lit(0))
    verdict = lambda ok, bad: F.when(ok, "Pass").otherwise(bad)
    vlan_text = cat("VLAN ", c("expected_vlan"))
    gw_ok = F.coalesce(c("g.matched_vlan") == c("expected_vlan"), F.lit(False))
    checks = F.array(
        check("SSID-VLAN", "SSID-to-VLAN", F.lit(True), verdict(has_vlan, "Fail"), "High", c("v.line"), 0.95, 0.72,
              F.when(has_vlan, cat(vlan_text, " found in extracted evidence")).otherwise("Not found in extracted wired policy"),
              "Create/restore the VLAN or upload complete VLAN evidence."),
        check("DHCP", "DHCP Scope", F.lit(True), verdict(has_pool, "Review"), "Medium", c("p.line"), 0.93, 0.48,
              F.when(has_pool, cat("Scope ", c("expected_subnet"), " found in pool ", c("p.name"))).otherwise("No matching DHCP evidence"),
              "Upload DHCP pool output or create the matching DHCP network statement."),
        check("DHCP-GW", "Gateway/DHCP Matching", has_pool, verdict(gw_ok, "Review"), "Medium", c("p.line"), 0.90, 0.55,
              cat("Gateway ", F.coalesce("p.default_gateway", F.lit("None")), " matched ", F.coalesce("g.matched_interface", F.lit("None"))),
              "Check default-router vs routed subinterface/SVI IP."),
        check("TRUNK", "Trunk Coverage", F.lit(True), F.when(~has_trunk, "Review").otherwise(verdict(carrying > 0, "Fail")),
              F.when(has_trunk, "High").otherwise("Medium"),
              F.when(carrying > 0, F.least("vlan_trunk_line", "all_line")).otherwise(c("trunk_line")), 0.90, F.when(has_trunk, 0.78).otherwise(0.42),
              F.when(~has_trunk, "No trunk evidence uploaded").when(carrying > 0, cat(carrying.cast("string"), " trunk interface(s) carry ", vlan_text))
              .otherwise(cat("No trunk evidence carries ", vlan_text)),
              F.when(has_trunk, "Add the WLAN VLAN to AP/uplink trunk allowed lists.").otherwise("Upload show interfaces trunk / switchport running-config.")),
        check("GUEST-ISOLATION", "Guest Isolation", c("internal_access") == "false", c("isolation_status"), "Critical", c("isolation_line"),
              c("isolation_confidence"), c("isolation_confidence"), c("isolation_reason"),
              "Apply a deny ACL inbound on the guest VLAN gateway before any permit-any rule."),
        check("ACL-DIRECTION", "ACL Direction", c("internal_access") == "limited", verdict(c("acl_n") > 0, "Review"), "High", c("acl.line"), 0.86, 0.50,
              F.when(c("acl_n") > 0, cat("Applied ACL: ", c("acl.acl"))).otherwise("No applied ACL was confirmed"),
              "Apply the student policy ACL to the VLAN gateway in the correct direction."),
    )
    return df.select("file_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("d")).select("file_id", "d.*")


def root_causes(diffs: DataFrame) -> DataFrame:
    """Owner and verification commands for every check that did not pass."""
    commands = F.coalesce(*[F.when(F.col("category") == k, F.array(*[F.lit(x) for x in v[1]])) for k, v in fv.ROOT_CAUSE_TABLE.items()],
                          F.array(*[F.lit(x) for x in fv.ROOT_CAUSE_DEFAULT[1]]))
    owner = F.coalesce(*[F.when(F.col("category") == k, F.lit(v[0])) for k, v in fv.ROOT_CAUSE_TABLE.items()], F.lit(fv.ROOT_CAUSE_DEFAULT[0]))
    return diffs.filter(F.col("status") != "Pass").select(
        "file_id", F.col("id").alias("finding_id"), "asset", "severity", "confidence", "evidence_line", commands.alias("verification_commands"),
        owner.alias("owner"), F.col("recommendation").alias("recommended_fix"))


def wired_playbooks(diffs: DataFrame) -> DataFrame:
    steps = F.array(
        F.lit("Confirm the affected SSID/VLAN/service path in the evidence view."), F.lit("Run the verification commands listed below."),
        F.col("recommended_fix"), F.lit("Re-import fresh outputs."), F.lit("Verify that the finding changes to Pass with line-level evidence."))
    return root_causes(diffs).select("file_id", "finding_id", "owner", "severity", steps.alias("steps"), F.col("verification_commands").alias("commands"))


def wired_risk(diffs: DataFrame) -> DataFrame:
    """Score, grade and level per scope."""
    d = F.when(F.col("status") == "Fail", F.when(F.col("severity") == "Critical", 25).otherwise(14)).when(F.col("status") == "Review", 7).otherwise(0)
    score = F.greatest(F.lit(0), F.lit(100) - F.col("_lost")).cast("long")
    return diffs.groupBy("file_id").agg(F.sum(d).alias("_lost")).select(
        "file_id", score.alias("score"), _grade(score).alias("grade"), _level(score).alias("risk_level"))


# --- cross checks and derived controls --------------------------------------
def observed_vlans(vlans: DataFrame, vlan_brief: DataFrame, gateways: DataFrame, interfaces: DataFrame, trunks: DataFrame) -> DataFrame:
    """`file_id, source, vlan` for every place that names a VLAN, each once."""
    one = lambda df, source, col: df.select("file_id", F.lit(source).alias("source"), F.col(col).alias("vlan"))
    both = lambda col: trunks.select("file_id", F.explode(col).alias("vlan"))
    rows = (
        one(vlans, "configured", "id").unionByName(one(vlan_brief, "show_vlan", "vlan")).unionByName(one(gateways, "dhcp_gateway", "matched_vlan"))
        .unionByName(one(interface_vlan(interfaces), "access_or_svi", "vlan"))
        .unionByName(one(both("allowed_vlans"), "trunk_allowed", "vlan")).unionByName(one(both("forwarding_vlans"), "trunk_forwarding", "vlan"))
    )
    return rows.filter("vlan is not null").distinct()


def vlan_crosscheck(observed: DataFrame) -> DataFrame:
    """Per scope and VLAN: where it is seen, and whether the trunks miss it."""
    sources = ["configured", "show_vlan", "dhcp_gateway", "access_or_svi", "trunk_allowed", "trunk_forwarding"]
    per = observed.groupBy("file_id", "vlan").agg(*[F.max(F.col("source") == s).alias(s) for s in sources])
    trunked = observed.filter(F.col("source") == "trunk_allowed").select("file_id").distinct().withColumn("_has", F.lit(True))
    seen = F.col("configured") | F.col("show_vlan") | F.col("dhcp_gateway") | F.col("access_or_svi")
    missing = seen & F.coalesce("_has", F.lit(False)) & ~F.col("trunk_allowed") & ~F.col("vlan").isin("1", "1002", "1003", "1004", "1005")
    return per.join(trunked, "file_id", "left").select("file_id", "vlan", *sources, seen.alias("observed"), missing.alias("missing_from_trunks"))


def risk_atoms(hardening: DataFrame, counters: DataFrame, crosscheck: DataFrame, hits: DataFrame) -> DataFrame:
    """Small, evidence-backed signals: weak management, interface errors, VLANs off trunks, rules without hits."""
    row = lambda df, key, title, severity, line, conf: df.select(
        "file_id", F.lit(key).alias("key"), title.alias("title"), F.lit(severity).alias("severity"), line.cast("long").alias("evidence_line"), F.lit(conf).alias("confidence"))
    errors = F.col("input_errors") + F.col("output_errors") + F.col("crc")
    none = F.lit(None)
    return (
        row(hardening.filter("posture = 'weak'"), "weak-management-plane", F.concat(F.lit("Weak management-plane signal: "), "name"), "High", F.col(LINE), 0.86)
        .unionByName(row(counters.filter(errors > 0), "interface-errors", F.concat(F.lit("Interface errors on "), "interface"), "Medium",
                         F.coalesce("error_evidence.source_line", LINE), 0.78))
        .unionByName(row(crosscheck.filter("missing_from_trunks"), "vlan-not-on-trunk", F.concat(F.lit("VLAN "), "vlan", F.lit(" missing from trunk evidence")), "High", none, 0.76))
        .unionByName(row(hits.filter("matches = 0 and acl_name is not null"), "acl-zero-hit", F.concat(F.lit("ACL line has zero runtime hits in "), "acl_name"), "Low", F.col(LINE), 0.60))
    )


def policy_controls(scopes: DataFrame, bound_rules: DataFrame, trunks: DataFrame, interfaces: DataFrame, hardening: DataFrame, port_security: DataFrame,
                    links: DataFrame, counters: DataFrame, hits: DataFrame, crosscheck: DataFrame) -> DataFrame:
    """Eight assertions per scope, from one count per table and scope."""
    errors = F.col("input_errors") + F.col("output_errors") + F.col("crc")
    count = lambda df, n: df.groupBy("file_id").agg(F.count("*").alias("c")).select("file_id", F.lit(n).alias("n"), "c")
    configured = interfaces.filter((F.col("mode") == "trunk") | (F.size("trunk_allowed_vlans") > 0))
    counts = count(bound_rules.filter("is_applied"), "acl")
    for df, n in ((trunks, "trunk"), (configured, "trunk_config"), (hardening.filter("posture = 'weak'"), "weak"), (port_security, "secure"), (links, "links"),
                  (counters.filter(errors > 0), "errors"), (hits.filter("matches > 0"), "hits"), (crosscheck.filter("missing_from_trunks"), "missing")):
        counts = counts.unionByName(count(df, n))
    names = ["acl", "trunk", "trunk_config", "weak", "secure", "links", "errors", "hits", "missing"]
    wide = scopes.select("file_id").join(counts, "file_id", "left").groupBy("file_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("n") == n, F.col("c"))), F.lit(0)).alias(n) for n in names])
    n = lambda x: F.col(x)
    trunk_n = F.when(n("trunk") > 0, n("trunk")).otherwise(n("trunk_config"))

    def control(name, amount, ok, bad, severity, good_conf, bad_conf):
        return F.struct(F.lit(name).alias("control"), F.when(ok, "pass").otherwise(bad).alias("status"), severity.alias("severity"),
                        amount.alias("amount"), F.when(ok, good_conf).otherwise(bad_conf).alias("confidence"))

    lit = F.lit
    rows = F.array(
        control("SEG-ACL-APPLIED", n("acl"), n("acl") > 0, "review", F.when(n("acl") > 0, "Info").otherwise("High"), 0.90, 0.45),
        control("L2-TRUNK-COVERAGE", trunk_n, trunk_n > 0, "review", lit("Medium"), 0.86, 0.40),
        control("DEVICE-HARDENING", n("weak"), n("weak") == 0, "fail", F.when(n("weak") > 0, "High").otherwise("Info"), 0.70, 0.88),
        control("ACCESS-PORT-SECURITY", n("secure"), n("secure") > 0, "review", lit("Medium"), 0.82, 0.44),
        control("TOPOLOGY-ADJACENCY", n("links"), n("links") > 0, "review", lit("Medium"), 0.84, 0.42),
        control("INTERFACE-ERROR-HEALTH", n("errors"), n("errors") == 0, "fail", F.when(n("errors") > 0, "Medium").otherwise("Info"), 0.68, 0.82),
        control("ACL-RUNTIME-HITS", n("hits"), n("hits") > 0, "review", lit("Medium"), 0.83, 0.42),
        control("VLAN-TRUNK-CROSSCHECK", n("missing"), n("missing") == 0, "fail", F.when(n("missing") > 0, "High").otherwise("Info"), 0.84, 0.84),
    )
    return wide.select("file_id", F.inline(rows))


def subnet_members(interfaces: DataFrame, pools: DataFrame, routes: DataFrame) -> DataFrame:
    """Every interface, pool and next hop of a subnet, one row each."""
    row = lambda df, kind, name: df.filter("cidr is not null").select("file_id", "cidr", F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(LINE).alias("line"))
    return row(interfaces, "interface", "name").unionByName(row(pools, "dhcp_pool", "name")).unionByName(row(routes, "route", "next_hop"))


def subnet_inventory(members: DataFrame) -> DataFrame:
    """One row per subnet with the number of members of each kind and the first of each."""
    kinds = ["interface", "dhcp_pool", "route"]
    return members.groupBy("file_id", "cidr").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds],
        *[F.min_by("name", F.when(F.col("kind") == k, F.col("line"))).alias(f"first_{k}") for k in kinds])


def longest_match(addresses: DataFrame, ip: str, subnets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """addresses with the narrowest subnet that holds them (`cidr`, null if none) and the number that do (`nets`).

    subnets: `cidr` and the keys. An address becomes one prefix for each prefix length that its keys know (33 at most), and
    prefixes meet subnets by equality, so no range is compared. Subnets that repeat count once; invalid ones are left out.
    """
    keys = keys or []
    own = [c for c in addresses.columns if c not in ("cidr", "nets")]
    nets = subnets.select(*keys, "cidr", cidr_base(F.col("cidr")).alias("_base"), cidr_prefix(F.col("cidr")).alias("_len")).filter("_base is not null and _len is not null").distinct()
    rows = addresses.select(*own, F.when(F.col(ip).rlike(DOTTED_STRICT), ip_to_long(F.col(ip))).alias("_n"))
    asked = rows.select(*keys, "_n").filter("_n is not null").distinct()
    lens = asked.join(nets.groupBy(*keys).agg(F.collect_set("_len").alias("_lens")), keys) if keys else asked.withColumn("_lens", F.sequence(F.lit(0), F.lit(32)))
    prefixes = lens.select(*keys, "_n", F.explode("_lens").alias("_len")).withColumn("_base", F.col("_n").bitwiseAND(prefix_mask(F.col("_len"))))
    found = prefixes.join(nets, [*keys, "_base", "_len"]).groupBy(*keys, "_n").agg(F.max_by("cidr", F.struct("_len", "cidr")).alias("cidr"), F.count("*").alias("nets"))
    return rows.join(found, [*keys, "_n"], "left").select(*own, "cidr", F.coalesce("nets", F.lit(0)).cast("long").alias("nets"))


def evaluate_rules(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """Declarative rules over a fact view.

    rules: `rule_id, enabled, condition_left, operator, condition_value, severity`;
    facts: `asset, key, value`. A rule meets only the facts of its own key.
    """
    left, right = F.col("value"), F.col("condition_value")
    has = F.contains(left, right)
    verdict = (
        F.when(F.col("operator") == "equals", left == right).when(F.col("operator") == "contains", has).when(F.col("operator") == "not_contains", ~has)
        .when(F.col("operator") == "greater_than", left.try_cast("double") > right.try_cast("double"))
    )
    return rules.filter("enabled").join(facts, F.col("condition_left") == F.col("key")).select(
        "rule_id", "asset", "severity", "operator", "condition_value", "value", F.when(verdict, "pass").otherwise("fail").alias("status"))


def compliance_matrix(anomalies: DataFrame, matrix: DataFrame, diffs: DataFrame, events: DataFrame, correlations: int | None = None) -> DataFrame:
    """Six controls from anomalies, client matrix, diffs and events, all reduced to counts first."""
    guest = F.contains(F.coalesce("detail", F.lit("")), F.lit("Guest")) | F.contains(F.coalesce("asset", F.lit("")), F.lit("Guest"))
    is_cat = lambda c: F.count_if(F.col("category") == c)
    part = lambda df, *cols: df.agg(*cols).select(F.to_json(F.struct("*")).alias("j"))
    a = part(anomalies, F.count("*").alias("anomalies"), F.count_if(guest).alias("guest"), is_cat("VLAN mismatch").alias("vlan"),
             is_cat("DHCP scope mismatch").alias("dhcp"), is_cat("AP VLAN support").alias("ap"))
    b = part(matrix, F.count("*").alias("matrix"), F.count_if(F.col("result") != "Pass").alias("failed_clients"))
    c = part(diffs, F.count_if(F.col("status") != "Pass").alias("failed_diffs"))
    d = part(events, F.count("*").alias("events"))
    keys = ["anomalies", "guest", "vlan", "dhcp", "ap", "matrix", "failed_clients", "failed_diffs", "events"]
    one = a.unionByName(b).unionByName(c).unionByName(d).select(*[F.get_json_object("j", f"$.{k}").cast("long").alias(k) for k in keys]).agg(
        *[F.coalesce(F.max(k), F.lit(0)).alias(k) for k in keys])
    n = lambda k: F.col(k)
    paths = F.lit(correlations).cast("long") if correlations is not None else n("events")

    def control(id_, name, bad, word, risk, prefix, amount):
        return F.struct(F.lit(id_).alias("id"), F.lit(name).alias("control"), F.when(bad, word).otherwise("Pass").alias("status"), F.lit(risk).alias("risk"),
                        F.concat(F.lit(prefix + "-"), F.when(amount < 1000, F.lpad(amount.cast("string"), 3, "0")).otherwise(amount.cast("string"))).alias("evidence"))

    return one.select(F.inline(F.array(
        control("CTRL-GUEST-ISOLATION", "Guest isolation", n("guest") > 0, "Fail", "High", "WLAN", n("anomalies")),
        control("CTRL-SSID-VLAN", "SSID to VLAN mapping", n("vlan") > 0, "Fail", "High", "MATRIX", n("matrix")),
        control("CTRL-DHCP-ACCURACY", "DHCP scope accuracy", n("dhcp") > 0, "Review", "Medium", "DHCP", n("failed_clients")),
        control("CTRL-AP-TRUNK", "AP trunk coverage", n("ap") > 0, "Fail", "High", "PATH", paths),
        control("CTRL-WIRED-POLICY", "Wired policy alignment", n("failed_diffs") > 0, "Review", "Medium", "DIFF", n("failed_diffs")),
        control("CTRL-AUDIT-TRAIL", "Administrative audit trail", n("events") == 0, "Review", "Low", "AUDIT", n("events")),
    )))


def timeline(events: DataFrame, imports: DataFrame, diffs: DataFrame) -> DataFrame:
    """Events, imports and open checks as one list; missing times sort last."""
    cols = ["time", "type", "severity", "detail"]
    rows = events.select(*cols).unionByName(imports.select(*cols)).unionByName(diffs.select(*cols))
    return rows.orderBy(F.coalesce(F.col("time").cast("string"), F.lit("")).desc(), "type", "detail")


def prioritized(diffs: DataFrame, limit: int | None = None) -> DataFrame:
    """The first checks by severity, then Fail before Review before Pass."""
    from ..functions.text import lookup

    rank = lookup(F.col("severity"), fv.SEVERITY_RANK, 9)
    state = F.when(F.col("status") == "Fail", 0).when(F.col("status") == "Review", 1).otherwise(2)
    out = diffs.orderBy(rank, state, "file_id", "id")
    return out if limit is None else out.limit(limit)


