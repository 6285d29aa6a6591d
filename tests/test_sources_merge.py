import json

from pyspark.sql import functions as F

from netprism.operators import merge as M
from netprism.sources import connectors as K
from netprism.sources import files, sinks


def test_line_numbers_over_splits(spark, tmp_path):
    for name, n in (("a.cfg", 500), ("b.cfg", 3)):
        (tmp_path / name).write_text("\n".join(f"line {i} of {name}" for i in range(1, n + 1)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 503
    assert all(r["text"] == f"line {r['line_no']} of {r['source_file']}" for r in rows)


def test_intake_and_manifest(spark, tmp_path):
    (tmp_path / "ok.cfg").write_text("hostname R1\n")
    (tmp_path / "empty.cfg").write_text("")
    (tmp_path / "bad.exe").write_text("x")
    (tmp_path / "same.cfg").write_text("vlan 10")
    seen = files.read_binary(spark, str(tmp_path))
    # a file scan never returns empty files, so the listing that shows them comes from elsewhere
    listing = seen.select("path", "length").unionByName(spark.createDataFrame([("file:/x/empty.cfg", 0)], "path string, length long"))
    status = {r["path"].split("/")[-1]: (r["status"], r["reason"]) for r in files.validate_intake(listing).collect()}
    assert status == {"ok.cfg": ("accepted", None), "empty.cfg": ("rejected", "empty file"), "bad.exe": ("rejected", "unsupported extension"), "same.cfg": ("accepted", None)}
    manifest = sinks.write_manifest(spark, str(tmp_path), str(tmp_path.parent / "stored_manifest"))
    (tmp_path / "ok.cfg").write_text("hostname R2\n")
    (tmp_path / "bad.exe").unlink()
    now = files.file_manifest(files.read_binary(spark, str(tmp_path)))
    assert {r["name"]: r["status"] for r in files.verify_manifest(manifest, now).collect()} == {"ok.cfg": "MODIFIED", "bad.exe": "MISSING", "same.cfg": "valid"}


def test_bundles(spark):
    rows = [("b", "a.cfg", 5), ("b", "../x.cfg", 5), ("b", "c.bin", 5), ("b", "d.cfg", 50), ("b", "e.cfg", 6)]
    got = {r["member"]: r["reason"] for r in files.bundle_intake(spark.createDataFrame(rows, "bundle string, member string, length long"), 20, 10).collect()}
    assert got == {"a.cfg": None, "../x.cfg": "unsafe path", "c.bin": "unsupported member", "d.cfg": "member too large", "e.cfg": "bundle size limit reached"}


def test_format_detection(spark):
    rows = [("x.json", ""), ("x", ' {"a":1}'), ("x", "<a/>"), ("x", "a,b\n1,2"), ("x", "hostname R1"), ("lab.pkt", "")]
    df = spark.createDataFrame(rows, "n string, h string").select(files.detect_format(F.col("n"), F.col("h")).alias("f"))
    assert [r["f"] for r in df.collect()] == ["json", "json", "xml", "csv", "text_config", "native_binary"]


def test_connector_shapes(spark):
    texts = [json.dumps([{"client": "a", "message": "auth fail"}]), json.dumps({"events": [{"client": "b", "message": "roam"}, {"message": "x"}]}), json.dumps({"client": "c", "message": "dhcp"})]
    recs = K.json_records(spark.createDataFrame([(t,) for t in texts], "value string"))
    got = {r["client"]: r["event_type"] for r in K.connector_events(recs, "syslog_events").collect()}
    assert got == {"a": "authentication_failure", "b": "roaming", "unknown_syslog_client": "association", "c": "dhcp_assignment"}
    vendor = K.json_records(spark.createDataFrame([(json.dumps([{"name": "MR-01", "vlans": [10, 20]}, {"clientMac": "aa", "ip": "1.1.1.1"}]),)], "value string"))
    ap = K.connector_aps(vendor, "meraki_api").first()
    assert (ap["name"], ap["vendor"], ap["supported_vlans"]) == ("MR-01", "meraki_api", "10,20")
    assert K.connector_events(vendor, "meraki_api").first()["client"] == "aa"


def test_enrichment_is_idempotent(spark):
    rows = [("10", "VLAN_10", None, 1), ("10", "STAFF", "active", 2), (None, "loose", None, 3), (None, "loose", None, 4), ("20", "VLAN_20", None, 5)]
    df = spark.createDataFrame(rows, "id string, name string, status string, ord int")
    once = M.enrich_by_key(df, ["id"], ["ord"], placeholder="name")
    got = sorted((r["id"] or "", r["name"], r["status"]) for r in once.collect())
    assert got == [("", "loose", None), ("", "loose", None), ("10", "STAFF", "active"), ("20", "VLAN_20", None)]
    twice = M.enrich_by_key(once, ["id"], ["ord"], placeholder="name")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_upsert_versions(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, v string, version int")
    new = spark.createDataFrame([("b", None), ("c", "z")], "id string, v string")
    got = {r["id"]: (r["v"], r["version"]) for r in M.upsert(old, new, "id", {"v": "none"}, "version").collect()}
    assert got == {"a": ("x", 1), "b": ("y", 3), "c": ("z", 1)}


def test_table_sink(spark, tmp_path):
    df = spark.createDataFrame([("t1", 1), ("t2", 2)], "tenant_id string, id int")
    sinks.write_tables({"devices": df}, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out" / "devices").glob("tenant_id=*")) == ["tenant_id=t1", "tenant_id=t2"]
    manifest = sinks.write_manifest(spark, str(tmp_path / "out"), str(tmp_path / "manifest"))
    assert manifest.count() >= 2
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
