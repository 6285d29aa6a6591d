import json

from pyspark.sql import functions as F

from netprism.operators import findings as N
from netprism.operators import tree as T
from netprism.streaming import live as L


def records(spark, *payloads):
    df = spark.createDataFrame([(f"f{i}", json.dumps(p)) for i, p in enumerate(payloads)], "file_id string, j string")
    return T.records(T.walk(T.documents(df, "file_id", "j")))


def test_nested_nodes_and_link_names(spark):
    r = records(spark, {"network": {"nodes": [
        {"id": "n1", "displayName": "R1", "deviceType": "Router", "interfaces": [{"name": "Gi0/0", "ipv4": {"address": "10.0.0.1", "mask": "255.255.255.0"}}]},
        {"id": "n2", "displayName": "SW1", "deviceType": "Switch", "interfaces": [{"name": "Fa0/1", "switchport": {"mode": "access", "vlan": 10}}]}],
        "links": [{"source": "n1", "target": "n2", "sourcePort": "Gi0/0", "targetPort": "Fa0/1"}]}})
    d = T.devices(r)
    assert {(x["id"], x["type"]) for x in d.collect()} == {("R1", "router"), ("SW1", "switch")}
    ports = {x["name"]: x for x in T.interfaces(r, d).collect()}
    assert set(ports) == {"Gi0/0", "Fa0/1"}
    assert (ports["Gi0/0"]["device"], ports["Gi0/0"]["cidr"]) == ("R1", "10.0.0.0/24") and (ports["Fa0/1"]["access_vlan"], ports["Fa0/1"]["mode"]) == ("10", "access")
    links = T.links(r, d).collect()
    assert [(x["device"], x["neighbor"]) for x in links] == [("R1", "SW1")]


def test_object_maps_name_records(spark):
    r = records(spark, {"topology": {"devices": {"R1": {"type": "router", "interfaces": {"Gi0/0": {"vlan": 10}}}}}})
    d = T.devices(r)
    assert [x["id"] for x in d.collect()] == ["R1"]
    port = T.interfaces(r, d).first()
    assert (port["name"], port["device"], port["access_vlan"]) == ("Gi0/0", "R1", "10")


def test_facts_and_broken_documents(spark):
    docs = spark.createDataFrame([("a", json.dumps({"host": {"mgmtAddress": "10.1.1.1"}, "runningConfig": "hostname R1\ninterface Gi0/1\n ip address 10.2.2.2 255.0.0.0"})), ("b", "{oops")], "file_id string, j string")
    nodes = T.walk(T.documents(docs, "file_id", "j"))
    facts = {(r["fact_type"], r["value"]) for r in T.network_facts(T.key_values(T.leaves(nodes))).collect()}
    assert ("ip_address", "10.1.1.1") in facts and ("ip_address", "10.2.2.2") in facts
    assert {r["file_id"] for r in nodes.select("file_id").distinct().collect()} == {"a"}


def test_lab_matrix(spark):
    rows = [{"client": "pc1", "target": "10.0.0.9", "service": "Internet", "result": "Success", "actual_ssid": "Guest", "actual_vlan": 30, "actual_ip": "10.10.30.5", "ap_name": "AP1"},
            {"client": "pc1", "target": "10.0.0.8", "service": "DNS", "result": "Blocked", "actual_ssid": "Guest", "actual_vlan": 30}, {"event": "roaming", "client": "pc1", "ap_name": "AP2"}]
    tests = T.access_tests(records(spark, rows))
    done = tests.filter("result <> 'roaming'").withColumn("position", F.monotonically_increasing_id())
    s = N.lab_summary(done).first()
    assert (s["total_tests"], s["success"], s["failed"]) == (2, 1, 1) and tests.filter("result = 'roaming'").count() == 1
    m = N.client_access_matrix(done).first()
    assert (m["client"], m["ssid"], m["services_allowed"], m["services_blocked"]) == ("pc1", "Guest", "Internet", "DNS")


def test_embedded_base64_config(spark):
    import base64

    text = "hostname SW1\ninterface FastEthernet0/1\n switchport access vlan 30\n! end of the file here"
    df = spark.createDataFrame([("a", json.dumps({"blob": base64.b64encode(text.encode()).decode().rstrip("=")}))], "file_id string, j string")
    got = T.embedded_configs(T.leaves(T.walk(T.documents(df, "file_id", "j")))).first()
    assert got["encoding"] == "base64" and got["text"] == text


def test_duplicate_addresses_show_first_owners(spark):
    rows = [("10.0.0.1", f"d{i}") for i in range(9)] + [("10.0.0.2", "d1"), ("10.0.0.2", "d1"), ("224.0.0.1", "a"), ("224.0.0.1", "b")]
    got = N.duplicate_ips(spark.createDataFrame(rows, "ip string, owner string")).collect()
    assert [(r["ip"], r["owners"], r["first_owners"]) for r in got] == [("10.0.0.1", 9, [f"d{i}" for i in range(6)])]


def test_stream_dedupe_restarts(spark, tmp_path):
    """A repeated delivery after a restart is recognised from the checkpoint."""
    source, out = tmp_path / "in", tmp_path / "out"
    batch = spark.createDataFrame([("2024-01-01 00:00:01", "user=bob auth fail"), ("2024-01-01 00:00:02", "user=eve roam")], "ts string, line string").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        batch.write.mode("append").parquet(str(source))
        events = L.with_fingerprint(L.parse_syslog(spark.readStream.schema(batch.schema).parquet(str(source))))
        L.run_available(L.dedupe(events).select("fp", "client", "event_type"), str(out), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(out)).collect()
    assert sorted((r["client"], r["event_type"]) for r in rows) == [("bob", "authentication_failure"), ("eve", "roaming")]
