"""XML, CSV and JSON inputs, warnings, parser choice, and redaction before an export."""

from pyspark.sql import functions as F

from netprism.functions.redaction import redact_export, sanitized
from netprism.operators import audit as A
from netprism.operators import findings as N
from netprism.operators import merge as M
from netprism.operators import tree as T
from netprism.sources import structured as S


def test_xml_tree_and_links(spark):
    text = '<lab><device name="R1"><deviceType>Router</deviceType><interface><name>Gi0/0</name><ipAddress>10.0.0.1</ipAddress></interface></device><links><link source="R1" target="SW1" sourcePort="Gi0/0"/></links></lab>'
    docs = S.xml_documents(spark.createDataFrame([("a", text), ("b", "<oops"), ("c", None)], "f string, x string"), "f", "x")
    recs = T.records(T.walk(docs))
    assert {(r["file_id"], r["id"], r["type"]) for r in T.devices(recs).collect()} == {("a", "R1", "router")}
    assert [r["name"] for r in T.interfaces(recs, T.devices(recs)).collect()] == ["Gi0/0"]


def test_csv_cells_headers_and_gaps(spark):
    text = '﻿timestamp,event_type,client,detail,client\n2026-01-01,roaming,a,"x, ""y""",b\n\n,association\n'
    rows = S.csv_event_records(spark.createDataFrame([("f", text), ("empty", ""), ("none", None)], "f string, t string"), "f", "t")
    got = {r["source_line"]: r for r in S.imported_events(rows).collect()}
    assert sorted(got) == [2, 4]
    assert (got[2]["timestamp"], got[2]["client"], got[2]["detail"]) == ("2026-01-01", "b", 'x, "y"')
    assert (got[4]["event_type"], got[4]["client"], got[4]["result"]) == ("association", "", "")


def test_json_events_and_warnings(spark):
    texts = spark.createDataFrame([("a", '[{"client":"x","vlan":7}]'), ("b", '{"events":[{"client":"y"},{"client":"z"}]}'), ("c", "{bad"), ("d", '{"events":[]}')], "f string, t string")
    assert sorted((r["file_id"], r["source_line"], r["client"]) for r in S.imported_events(S.json_event_fields(texts, "f", "t")).collect()) == [("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z")]
    assert [(r["file_id"], r["warning"]) for r in S.import_warnings(texts, "f", "t", F.lit("json")).collect()] == [("c", "invalid JSON")]


def test_registry_gives_each_file_to_its_first_parser(spark):
    registry = S.ParserRegistry()
    registry.register("json", lambda name, head: name.endswith(".json") | head.startswith("{"), lambda df: df.select("n"))
    registry.register("text", lambda name, head: name.endswith(".txt"), lambda df: df.select("n"))
    out = registry.run(spark.createDataFrame([("a.json", "x"), ("b.txt", "{"), ("c.txt", "t"), ("d.bin", "t")], "n string, t string"), "n", "t")
    assert {k: sorted(r["n"] for r in v.collect()) for k, v in out.items()} == {"json": ["a.json", "b.txt"], "text": ["c.txt"]}


def test_redaction(spark):
    rows = [("Authorization: Basic abcdefgh1234=", "Authorization: Basic [REDACTED]"), ("enable secret 5 $1$xyz", "enable secret 5 [REDACTED]"), ("username bob password 7 0822", "username bob password 7 [REDACTED]"),
            ("snmp-server community public RO", "snmp-server community [REDACTED] RO"), ("a?token=abc&b=1", "a?token=[REDACTED]&b=1"), ("plain", "plain"), (None, None)]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, t string").select("i", redact_export(F.col("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: b for i, (_, b) in enumerate(rows)}
    df = spark.sql("select 'x' as user, named_struct('Api_Key', 5, 'n', array(named_struct('psk', 'p', 'say', 'secret=1'))) as s, map('token', 't', 'k', 'password=p') as m")
    r = sanitized(df).first()
    assert (r["user"], r["s"]["Api_Key"], r["s"]["n"][0]["psk"], r["s"]["n"][0]["say"], r["m"]) == ("x", "[REDACTED]", "[REDACTED]", "secret=[REDACTED]", {"token": "[REDACTED]", "k": "password=[REDACTED]"})


def test_missing_user_blank_update_and_gaps_without_findings(spark):
    tries = spark.createDataFrame([(1, None, "1.1.1.1", False, 10.0), (2, "Bob", None, False, 11.0), (3, "bob ", "1.1.1.1", False, 12.0)], "id int, username string, ip_address string, ok boolean, created_at double")
    got = {r["id"]: (r["by_user"], r["by_ip"], r["by_pair"], r["allowed"]) for r in A.login_allowed(tries, limit=3).collect()}
    assert got == {1: (1, 1, 1, True), 2: (1, 1, 1, True), 3: (2, 2, 1, False)}
    old = spark.createDataFrame([("a", "kept", 1)], "k string, v string, n int")
    new = spark.createDataFrame([("a", " ", None), ("b", "", 2)], "k string, v string, n int")
    assert sorted(map(tuple, M.upsert(old, new, "k", {"v": "none"}).collect())) == [("a", "kept", 1), ("b", "none", 2)]
    none = spark.createDataFrame([], "severity string, confidence double, title string, recommendation string")
    assert [r["action"][:24] for r in N.recommended_actions(none, has_rules=False, has_links=False).collect()] == ["Import ACL/firewall poli", "Import CDP/LLDP or topol"]


def test_union_compares_maps_and_variants(spark):
    df = spark.sql("select 1 as i, map('a', 1, 'b', 2) as m, parse_json('{\"x\":1,\"y\":2}') as v")
    other = spark.sql("select 1 as i, map('b', 2, 'a', 1) as m, parse_json('{\"y\":2,\"x\":1}') as v union all select 2, map('a', 1), parse_json('1')")
    assert M.union_distinct(df, other).count() == 2


def test_no_plan_pairs_everything(spark):
    import __spark_entry__ as entry

    for name in ("policy_diff", "topology_edges", "join_guest_isolation", "wireless_role_changes"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
