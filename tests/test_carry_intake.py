"""Chunks by rows, lines that states read, lookups by prefix, folder intake, tagged rows and versions of a stream's state."""

import ipaddress
import json
import random

import numpy as np
from pyspark.sql import functions as F
from samples import CAMPUS

from netprism.operators import extract as X
from netprism.operators import policy as P
from netprism.operators import tree as T
from netprism.operators import wireless as W
from netprism.operators.carry import carry_forward, with_row_chunks
from netprism.sources.intake import intake
from netprism.sources.sinks import read_tagged, write_tagged
from netprism.streaming import live as L


def test_hot_client_becomes_many_chunks(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 2 else f"c{i % 7}", f"2024-01-01 00:{rng.randrange(60):02d}:{rng.randrange(60):02d}", rng.choice(["roaming", "association", "other"]), f"AP{rng.randrange(9)}") for i in range(900)]
    rows += [(1000, None, "2024-01-01 00:00:00", "roaming", "AP1"), (1001, "hot", None, "roaming", "AP1")]
    df = spark.createDataFrame(rows, "id long, client string, ts string, type string, ap string").withColumn("ts", F.col("ts").cast("timestamp"))
    cut = with_row_chunks(df, "part", "client", "ts", rows=50)
    assert cut.count() == len(rows)
    per = {r["client"]: r["n"] for r in cut.groupBy("client").agg(F.count_distinct("part").alias("n")).collect()}
    assert per["hot"] >= 8 and per["c2"] <= 3
    largest = cut.filter("client = 'hot'").groupBy("part").count().agg(F.max("count")).first()[0]
    assert largest < 60
    ordered = cut.filter("client = 'hot' and ts is not null").select("ts", "part").collect()
    assert [p for _, p in sorted((r["ts"], r["part"]) for r in ordered)] == sorted(r["part"] for r in ordered)
    marks = {"last": F.when(F.col("type") == "association", F.col("ap"))}
    dated = cut.filter("client is not null and ts is not null").withColumn("o", F.struct("ts", "id"))
    whole = carry_forward(dated, marks, key="client", order="o", chunk=F.lit(0))
    parts = carry_forward(dated, marks, key="client", order="o", chunk=F.col("part"))
    assert sorted((r["id"], r["last"] or "") for r in whole.collect()) == sorted((r["id"], r["last"] or "") for r in parts.collect())
    moves = W.roaming_transitions(df.withColumn("to_ap", F.lit(None).cast("string")).filter("client is not null"))
    assert moves.count() == sum(r[1] is not None and r[3] == "roaming" for r in rows)


def test_tables_need_only_the_lines_of_their_states(spark, lines_of):
    lines = lines_of(campus=CAMPUS, again=CAMPUS)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    few = X.block_source(lines, "interface", "vlan", "dhcp", "acl")
    assert few.count() < lines.count()
    whole = X.annotate(lines)
    assert same(X.interfaces(X.block_lines(few, "interface"), few), X.interfaces(whole)) and same(X.vlans(X.block_lines(few, "vlan"), few), X.vlans(whole))
    assert same(X.dhcp_scopes(X.block_lines(few, "dhcp")), X.dhcp_scopes(whole)) and same(X.acl_rules(X.block_lines(few, "acl"), few), X.acl_rules(whole))
    state = lambda *s, **k: X.state_lines(lines, *s, **k)
    assert same(X.cdp_links(state("cdp"), lines), X.cdp_links(whole)) and same(X.trunk_operational(state("trunk_section", "trunk_seen")), X.trunk_operational(whole))
    assert same(X.interface_counters(state("counter")), X.interface_counters(whole)) and same(X.stp_root(state("stp")), X.stp_root(whole))
    assert same(X.all_config_commands(state("context")), X.all_config_commands(whole)) and same(X.management_services(state("line_context")), X.management_services(whole))
    assert same(X.interface_features(state("blk_interface", uses="features")), X.interface_features(whole)) and same(X.security_hardening(state("blk_vty"), lines), X.security_hardening(whole))


def test_longest_match(spark):
    rng = random.Random(2)
    nets = [("a", f"10.{rng.randrange(4)}.{rng.randrange(3)}.0/{rng.choice([8, 16, 24, 30])}") for _ in range(40)] + [("a", "0.0.0.0/0"), ("b", "10.1.0.0/16"), ("b", "bad"), ("b", "10.1.0.0/99"), ("b", None), ("a", nets0 := "10.1.1.0/24"), ("a", nets0)]
    ips = [(k, f"10.{rng.randrange(4)}.{rng.randrange(3)}.{rng.randrange(256)}") for k in "abc" for _ in range(30)] + [("b", "11.0.0.1"), ("b", None), ("a", "10.1"), ("a", "10.1.1.1"), ("a", "10.1.1.1")]

    def want(key, ip, keyed):
        try:
            own = {c: ipaddress.ip_network(c, strict=False) for k, c in nets if c and c not in ("bad", "10.1.0.0/99") and (k == key or not keyed)}
            hits = [c for c, n in own.items() if ipaddress.ip_address(ip) in n]
        except ValueError:
            return None, 0
        return max(hits, key=lambda c: (own[c].prefixlen, c), default=None), len(hits)

    a, n = spark.createDataFrame(ips, "k string, ip string"), spark.createDataFrame(nets, "k string, cidr string")
    for keyed in (True, False):
        got = P.longest_match(a, "ip", n, ["k"] if keyed else None)
        assert sorted(map(str, ((r["k"], r["ip"], r["cidr"], r["nets"]) for r in got.collect()))) == sorted(str((k, ip, *want(k, ip, keyed))) for k, ip in ips)


def test_folder_intake(spark, tmp_path):
    (tmp_path / "one" / "deep").mkdir(parents=True)
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "r1 core.cfg").write_text("hostname R1\nvlan 10\n")
    (tmp_path / "one" / "deep" / "sw.txt").write_text("hostname SW1\n")
    (tmp_path / "one" / "lab.json").write_text('﻿{"devices":[{"hostname":"J1","deviceType":"router"}]}')
    (tmp_path / "one" / "bad.json").write_text("{")
    (tmp_path / "two" / "net.xml").write_text('<lab><devices><device hostname="X1"><deviceType>Switch</deviceType></device></devices></lab>')
    (tmp_path / "two" / "events.csv").write_text('client,note\nc1,"a, b"\nc2,\n')
    (tmp_path / "two" / "long.cfg").write_text("x\n" * 4000)
    (tmp_path / "two" / "picture.png").write_bytes(b"\x89PNG")
    taken = intake(spark, str(tmp_path), member_bytes=4000)
    verdicts = {r["source_label"]: r["reason"] for r in taken["members"].collect()}
    assert verdicts["two:long.cfg"] == "member too large" and verdicts["two:picture.png"] == "unsupported member"
    assert sum(v is None for v in verdicts.values()) == 6
    assert sorted((r["file_id"], r["line_no"], r["text"]) for r in taken["lines"].collect()) == [("one:deep/sw.txt", 1, "hostname SW1"), ("one:r1 core.cfg", 1, "hostname R1"), ("one:r1 core.cfg", 2, "vlan 10")]
    assert sorted((r["file_id"], r["fields"]["client"], r["fields"]["note"]) for r in taken["records"].collect()) == [("two:events.csv", "c1", "a, b"), ("two:events.csv", "c2", "")]
    for name, want in (("json", ("one:lab.json", "J1")), ("xml", ("two:net.xml", "X1"))):
        assert [(r["file_id"], r["id"]) for r in T.devices(T.records(T.walk(taken[name]))).collect()] == [want]
    assert {r["file_id"]: r["warning"] for r in taken["warnings"].collect()} == {"one:bad.json": "invalid JSON", "two:long.cfg": "member too large", "two:picture.png": "unsupported member"}
    small = intake(spark, str(tmp_path), total_bytes=60)["members"]
    assert small.filter("reason = 'bundle size limit reached'").count() > 0


def test_wrappers_pairs_and_owners(spark):
    doc = {"devices": [{"attributes": {"data": {"hostname": "R1"}}, "metadata": [{"key": "serialNumber", "value": "S1"}, {"key": "", "value": "x"}, 3], "ports": [{"portConfig": {"ipv4": {"address": "10.0.0.1", "mask": "255.255.255.0"}}, "ifName": "Gi0/1"}]},
                       {"name": "hostname", "value": "R2"}]}
    docs = T.documents(spark.createDataFrame([("f", json.dumps(doc))], "id string, j string"), "id", "j")
    recs = T.records(T.walk(docs))
    fields = {r["path"]: {f["k"]: f["v"] for f in reversed(r["fields"])} for r in recs.collect()}
    assert fields["$.devices[0]"]["hostname"] == "R1" and fields["$.devices[0]"]["datahostname"] == "R1" and fields["$.devices[0]"]["serialnumber"] == "S1"
    assert fields["$.devices[0].ports[0]"]["address"] == "10.0.0.1" and fields["$.devices[1]"]["hostname"] == "R2"
    got = T.interfaces(recs, T.devices(recs)).filter("cidr is not null").collect()
    assert {(r["name"], r["device"], r["cidr"]) for r in got} == {("Gi0/1", "R1", "10.0.0.0/24")}


def test_tagged_rows_come_back_by_table(spark, tmp_path):
    doc = {"matrix": [{"client": "c", "target": "10.0.0.9", "service": "DNS", "result": "ok", "ssid": "S", "vlan": 5}, {"event": "roaming", "client": "c", "target": "AP2"}, {"client": None, "result": "ok"}]}
    recs = T.records(T.walk(T.documents(spark.createDataFrame([("f", json.dumps(doc))], "id string, j string"), "id", "j")))
    write_tagged(T.lab_rows(recs), str(tmp_path / "lab"))
    of = lambda n, *c: sorted(tuple(r) for r in read_tagged(spark, str(tmp_path / "lab"), n, list(c)).collect())
    assert of("devices", "name", "kind") == [("10.0.0.9", "service"), ("c", "endpoint")] and of("vlans", "name", "detail") == [("5", "S")]
    assert of("policy_controls", "status", "kind") == [("pass", "Info")] and of("roaming_events", "name", "ap_name") == [("c", "AP2")]


def test_state_of_a_stream_survives_a_batch_tried_again(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"c{rng.randrange(6)}", rng.randrange(50), i, rng.choice(["association", "roaming", "disassociation"]), rng.choice(["A", "B", None])) for i in range(120)]
    marks = lambda part: L.register_marks(spark.createDataFrame(part, "client string, s long, id long, type string, ap string").select(
        "client", F.timestamp_seconds("s").alias("ts"), "id", "type", "ap", F.lit(None).cast("string").alias("to_ap"), F.lit("S").alias("ssid"), F.lit("5").alias("vlan"), F.lit(None).cast("string").alias("ip")), ["S"])
    write = L.state_versions(str(tmp_path / "state"))
    for batch, part in enumerate((rows[:40], rows[40:80], rows[80:])):
        write(L.client_registers(marks(part)), batch)
        if batch == 1:
            write(L.client_registers(marks(part)), batch)  # tried again
    want = sorted(map(str, L.client_registers(marks(rows)).collect()))
    assert sorted(map(str, L.read_state(spark, str(tmp_path / "state")).collect())) == want
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["version=1", "version=2"]


def test_bytes_are_counted(spark):
    contents = [b"", b"a\tb\n", bytes(range(256)) * 3, None]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "id long, c binary")
    for r in df.select("id", X.byte_histogram(F.col("c")).alias("h")).collect():
        assert r["h"] == np.bincount(np.frombuffer(contents[r["id"]] or b"", np.uint8), minlength=256).tolist()
    got = {r["id"]: (r["bytes"], r["entropy"], r["printable_ratio"]) for r in X.byte_statistics(df, "id", "c").collect()}
    assert got[2] == (768, 8.0, round(98 / 256, 4)) and got[1] == (4, 2.0, 1.0) and got[0][0] == 0 and got[0][1] is None and got[3][0] == 0
