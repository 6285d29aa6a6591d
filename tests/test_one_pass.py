"""Tables that read their lines once: no join of a table with itself, no second reading, the same rows."""

import pytest
from pyspark.sql import functions as F

from netprism.operators import extract as X
from netprism.queries import QUERIES


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def lines(spark, texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "file_id bigint, line_no bigint, text string")


def test_trunk_table_is_not_joined_with_itself(spark, sf):
    p = plan(QUERIES["extract_trunk_operational"](spark, sf))
    assert "Join" not in p and p.count("lineitem") <= 1 and p.count("Relation") == 1


def test_trunk_rows_repeats_and_lists(spark):
    texts = ["Gi0/1  10", "Gi0/1  on  802.1q  trunking  1", "Port  Vlans allowed on trunk", "Gi0/1  10,20-22", "Gi0/1  5", "Gi0/2  7",
             "Port  Vlans allowed and active in management domain", "Gi0/1  20", "Gi0/1  auto  802.1q  Trunking  9 ", "vlan 3"]
    out = X.trunk_operational(X.state_lines(lines(spark, texts), "trunk_section", "trunk_seen")).select(
        "interface", "mode", "native_vlan", F.array_join("allowed_vlans", ",").alias("a"), F.array_join("active_vlans", ",").alias("b"),
        F.array_join("forwarding_vlans", ",").alias("c"), "evidence.source_line", "evidence.confidence").collect()
    assert sorted(tuple(r) for r in out if r[0] == "Gi0/1") == [
        ("Gi0/1", "auto", "9", "", "", "", 9, 0.86), ("Gi0/1", "on", "1", "5", "20", "", 2, 0.86)]
    assert [tuple(r) for r in out if r[0] == "Gi0/2"] == [("Gi0/2", None, None, "7", "", "", 6, 0.72)]


def test_findings_take_their_lines_from_one_reading(spark, sf, monkeypatch):
    from netprism.queries import findings_queries as Q

    df = Q.found(spark, sf)
    # what is still to run reads the lines that were written once, not the source again
    assert "l_orderkey" not in plan(df)


def test_a_line_names_a_secret_once(spark):
    df = lines(spark, ["password abcd secret efgh password ijkl", "no word", " community: pubs "])
    rows = sorted((r["line_no"], r["name"], r["source_text"]) for r in X.text_credentials(df).collect())
    whole = X.text_entities(df).filter("type = 'credential'").collect()
    assert rows == sorted((r["line_no"], r["name"], r["source_text"]) for r in whole)
    assert [r[:2] for r in rows] == [(1, "password"), (1, "secret"), (3, "community")]


def test_access_ports_need_their_own_lines_only(spark):
    texts = ["interface Fa0/1", " switchport mode access", " ip address 10.0.0.1 255.0.0.0", "interface Fa0/2", " switchport mode ACCESS", " switchport access vlan 7",
             "interface Fa0/3", " switchport access vlan 8", " switchport mode access", " shutdown", "interface Fa0/4", " switchport mode access", " shutdown",
             "interface Fa0/5", " encapsulation dot1q 9", " switchport mode trunk", " switchport mode access", "vlan 4", " switchport access vlan 5", "interface Gi0/6", "Gi0/7  on  802.1q  trunking  1"]
    every = lines(spark, texts)
    missing = lambda df: sorted(r["name"] for r in df.filter("lower(mode) = 'access' and not shutdown and access_vlan is null").collect())
    few = X.needed_lines(every, "blk_interface", "access_ports", "credential", "counted")
    assert few.filter("text like '%ip address%'").count() == 0
    got = missing(X.interfaces(X.state_lines(few, "blk_interface", uses="access_ports"), few))
    assert got == missing(X.interfaces(X.block_lines(every, "interface"), every)) == ["Fa0/1", "Fa0/5"]


def test_network_facts_class_a_value_once(spark):
    from netprism.operators import tree as T

    kv = spark.createDataFrame([(1, "$.a", "a", "string", "hostname R1 ip address 10.0.0.1 mac 00:AA:BB:CC:DD:01 Gi0/1 10.0.0.1", "config_or_cli", 0.76), (1, "$.b", "b", "string", "10.0.0.9", "ip_address", 0.9),
                                (1, "$.c", "c", "string", "x", "generic_value", 0.45)], "file_id bigint, path string, key string, value_type string, value string, fact_type string, confidence double")
    df = T.network_facts(kv)
    assert "Union" not in plan(df)
    rows = sorted((r["path"], r["fact_type"], r["value"]) for r in df.collect())
    assert ("$.a", "ip_address", "10.0.0.1") in rows and ("$.a", "mac_address", "00:aa:bb:cc:dd:01") in rows and ("$.b", "ip_address", "10.0.0.9") in rows
    assert not any(p == "$.c" for p, _, _ in rows) and len(rows) == len(set(rows))
