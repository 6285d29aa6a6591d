from pyspark.sql import functions as F
from samples import CAMPUS, INDENTED, RUNTIME, TRUNK_GAP

from netprism.operators import extract as X
from netprism.operators import policy as P
from netprism.plans.importing import diff_of_lines, extract_tables, object_rows
from netprism.queries.bindings import ssids


def test_campus_passes_every_check(spark, lines_of):
    diffs = diff_of_lines(lines_of(campus=CAMPUS), ssids(spark)).cache()
    rows = diffs.collect()
    assert len(rows) == 14 and {r["status"] for r in rows} == {"Pass"}
    score = P.wired_risk(diffs).first()
    assert (score["score"], score["grade"], score["risk_level"]) == (100, "Excellent", "Low")


def test_trunk_gap_fails(spark, lines_of):
    diffs = {r["id"]: r for r in diff_of_lines(lines_of(gap=TRUNK_GAP), ssids(spark)).collect()}
    assert diffs["TRUNK-GuestWiFi"]["status"] == "Fail" and diffs["TRUNK-StaffWiFi"]["status"] == "Pass"
    assert diffs["GUEST-ISOLATION-GuestWiFi"]["severity"] == "Critical"
    causes = P.root_causes(diff_of_lines(lines_of(gap=TRUNK_GAP), ssids(spark))).filter("finding_id = 'TRUNK-GuestWiFi'").first()
    assert causes["owner"] == "Network Operations" and "show interfaces trunk" in causes["verification_commands"]


def test_interfaces_and_bindings(lines_of):
    a = X.annotate(lines_of(campus=CAMPUS))
    rows = {r["name"]: r for r in X.interfaces(a).collect()}
    guest = rows["GigabitEthernet0/0.30"]
    assert (guest["dot1q_vlan"], guest["cidr"], guest["mode"], guest["acl_in"]) == ("30", "10.10.30.0/24", "routed-subinterface", "GUEST_IN")
    assert rows["GigabitEthernet0/1"]["trunk_allowed_vlans"] == ["10", "20", "30"]
    bound = P.bind_acls(X.acl_rules(a), X.interfaces(a)).collect()
    assert all(r["is_applied"] for r in bound if r["acl_name"] == "GUEST_IN")
    deny = next(r for r in bound if r["action"] == "deny")
    assert deny["parsed"]["destination"] == "10.10.0.0" and deny["parsed"]["destination_wildcard"] == "0.0.255.255"
    assert {r["matched_vlan"] for r in P.match_dhcp_gateways(X.dhcp_scopes(a), X.interfaces(a)).collect()} == {"10", "20", "30"}


def test_indented_text_does_not_close_blocks(lines_of):
    a = X.annotate(lines_of(x=INDENTED))
    row = X.interfaces(a).first()
    assert (row["name"], row["access_vlan"], row["port_security_max"], row["port_security_enabled"]) == ("Fa0/3", "12", "2", True)
    assert X.spanning_tree(a).first()["vlan"] == "0012" and X.etherchannels(a).first()["port_channel"] == "Po1"


def test_runtime_tables(lines_of):
    lines = lines_of(x=RUNTIME)
    t = extract_tables(lines)
    assert {r["matches"] for r in t["acl_hit_counts"].collect()} == {24, 0}
    c = t["interface_counters"].first()
    assert (c["input_errors"], c["crc"], c["output_errors"]) == (7, 2, 1)
    assert [r["vlan"] for r in t["vlan_crosscheck"].filter("missing_from_trunks").collect()] == ["30"]
    assert {r["key"] for r in t["risk_atoms"].collect()} == {"weak-management-plane", "interface-errors", "vlan-not-on-trunk", "acl-zero-hit"}
    trunk = t["trunk_operational"].first()
    assert trunk["allowed_vlans"] == ["10", "20"] and trunk["forwarding_vlans"] == ["10"]
    controls = {r["control"]: r["status"] for r in t["policy_controls"].collect()}
    assert controls["DEVICE-HARDENING"] == "fail" and controls["VLAN-TRUNK-CROSSCHECK"] == "fail" and controls["ACL-RUNTIME-HITS"] == "pass"
    stacked = object_rows({k: t[k] for k in ("vlan_brief", "acl_hit_counts", "raw_evidence")})
    assert {r["category"] for r in stacked.select("category").distinct().collect()} == {"vlan_brief", "acl_hit_counts", "raw_evidence"}


def test_small_chunks_give_the_same_tables(lines_of):
    """State carried over chunk edges: a file cut every three lines parses like the whole."""
    lines = lines_of(campus=CAMPUS, runtime=RUNTIME, indented=INDENTED)
    whole, cut = X.annotate(lines), X.annotate(lines, chunk=3)
    for table in (X.interfaces, X.acl_rules, X.dhcp_scopes, X.vlans, X.trunk_operational, X.interface_counters, X.security_hardening, X.acl_hit_counts, X.command_blocks):
        a, b = (sorted(map(str, table(x).collect())) for x in (whole, cut))
        assert a == b, table.__name__


def test_reconstruction_invents_nothing(spark):
    df = spark.createDataFrame([("a", "junk hostname SW1 interface FastEthernet0/1 switchport access vlan 30 end")], "id string, flat string")
    got = [r["command"] for r in X.reconstructed_lines(df, "id", "flat").orderBy("position").collect()]
    assert got == ["hostname SW1", "interface FastEthernet0/1", "switchport access vlan 30", "end"]


def test_byte_statistics(spark):
    raw = bytes((i * 37 + 19) % 256 for i in range(4096))
    row = X.byte_statistics(spark.createDataFrame([("a", bytearray(raw))], "id string, content binary"), "id", "content").first()
    assert row["bytes"] == 4096 and row["entropy"] == 8.0


def test_rule_operators(spark):
    rules = spark.createDataFrame([("a", True, "k", "equals", "x", "High"), ("b", True, "n", "greater_than", "3", "Low"), ("c", False, "k", "equals", "x", "Low")],
                                  "rule_id string, enabled boolean, condition_left string, operator string, condition_value string, severity string")
    facts = spark.createDataFrame([("one", "k", "x"), ("two", "k", "y"), ("one", "n", "10")], "asset string, key string, value string")
    got = {(r["rule_id"], r["asset"]): r["status"] for r in P.evaluate_rules(rules, facts).collect()}
    assert got == {("a", "one"): "pass", ("a", "two"): "fail", ("b", "one"): "pass"}


def test_guest_rule_without_binding_needs_review(spark, lines_of):
    text = CAMPUS.replace(" ip access-group GUEST_IN in\n", "")
    diffs = {r["id"]: r["status"] for r in diff_of_lines(lines_of(c=text), ssids(spark)).collect()}
    assert diffs["GUEST-ISOLATION-GuestWiFi"] == "Review"
    assert F is not None
