import ipaddress

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netprism.functions import net as N
from netprism.functions import text as T


def run(spark, rows, schema, **cols):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_interface_names(spark):
    names = ["Fa0/1", "Gi0/2", "VLAN10", "Te 1/1", "mgmt0", None]
    got = run(spark, [(n,) for n in names], "n string", x=T.normalize_interface(F.col("n")))
    assert [g["x"] for g in got] == ["FastEthernet0/1", "GigabitEthernet0/2", "Vlan10", "TenGigabitEthernet1/1", "mgmt0", ""]


def test_vlan_lists(spark):
    values = ["10,20-22", "all", "add 5,3,3", "none", "x,7-", "9-5"]
    got = run(spark, [(v,) for v in values], "v string", x=T.expand_vlans(F.col("v")))
    assert [g["x"] for g in got] == [["10", "20", "21", "22"], ["all"], ["3", "5"], ["none"], [], []]


def test_networks_match_ipaddress(spark):
    rows = [(f"10.{i}.{i * 7 % 256}.{i * 13 % 256}", str(ipaddress.ip_network(f"0.0.0.0/{i % 33}").netmask)) for i in range(66)] + [("1.2.3.4", "0.0.0.255"), ("1.2.3.4", "24")]
    got = run(spark, rows, "ip string, mask string", ip=F.col("ip"), mask=F.col("mask"), cidr=N.network_cidr(F.col("ip"), F.col("mask")))
    for g in got:
        assert g["cidr"] == str(ipaddress.ip_network(f"{g['ip']}/{g['mask']}", strict=False))
    bad = run(spark, [("1.2.3.4", "255.0.255.0"), ("1.2.3", "255.0.0.0"), ("300.1.1.1", "255.0.0.0")], "ip string, mask string", c=N.network_cidr(F.col("ip"), F.col("mask")))
    assert [b["c"] for b in bad] == [None, None, None]


def test_membership_and_hosts(spark):
    got = run(spark, [("10.0.5.9", "10.0.4.0/22"), ("10.0.8.1", "10.0.4.0/22"), ("", "10.0.0.0/8"), ("10.0.0.1", "bad")], "ip string, c string", x=N.ip_in_cidr(F.col("ip"), F.col("c")))
    assert [g["x"] for g in got] == [True, False, False, False]
    got = run(spark, [("10.0.0.0/24",), ("10.0.0.0/30",), ("10.0.0.4/32",), ("x",)], "c string", x=N.nth_host(F.col("c"), F.lit(40)))
    assert [g["x"] for g in got] == ["10.0.0.41", "10.0.0.2", "10.0.0.4", ""]


def test_redaction(spark):
    rows = ["enable secret 5 abc", "username bob privilege 15 secret zzz", "snmp-server community pub RO", "hostname R1"]
    got = run(spark, [(r,) for r in rows], "t string", x=T.redact_command(F.col("t")))
    assert [g["x"] for g in got] == ["enable secret <redacted>", "username bob privilege 15 secret <redacted>", "snmp-server community <redacted> RO", "hostname R1"]
    got = run(spark, [("the api_key: abcd1234, rest",)], "t string", x=T.redact_secret(F.col("t")))
    assert got[0]["x"] == "the api_key=<redacted>, rest"


def test_message_classes(spark):
    rows = [("Auth fail for bob", "High", "authentication_failure"), ("client roamed", "Medium", "roaming"), ("rogue ap seen", "Critical", "rogue_ap"), ("hello", "Info", "association")]
    got = run(spark, [(r[0],) for r in rows], "t string", s=T.message_severity(F.col("t")), e=T.message_event_type(F.col("t")))
    assert [(g["s"], g["e"]) for g in got] == [(r[1], r[2]) for r in rows]


@pytest.mark.parametrize("value,want", [(0.5, 50), (75.0, 75), (250.0, 100), (-3.0, 0)])
def test_percent(spark, value, want):
    assert run(spark, [(value,)], "v double", x=T.clamp_percent(F.col("v")))[0]["x"] == want


@settings(max_examples=5, deadline=None)
@given(st.sets(st.integers(1, 4094), min_size=1, max_size=30))
def test_vlan_round_trip(spark, ids):
    got = run(spark, [(",".join(str(i) for i in ids),)], "v string", x=T.expand_vlans(F.col("v")))
    assert got[0]["x"] == [str(i) for i in sorted(ids)]
