"""Live events: parse, dedupe, state, alerts, sessions and run log.

Every transformation takes a batch or a streaming DataFrame; the streaming
forms add a watermark on event time. Late rows beyond it are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import live_fingerprint, lookup, message_event_type, message_severity, rx


def parse_syslog(df: DataFrame, line: str = "line", time: str = "ts") -> DataFrame:
    """Raw lines to typed events with the fields a line may name."""
    t = F.trim(line)
    blank = lambda c: F.coalesce(c, F.lit(""))
    mac = F.replace(F.lower(F.regexp_extract(t, "([0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}", 0)), F.lit("-"), F.lit(":"))
    ssid = blank(F.get(F.split(F.trim(blank(rx(t, r"ssid[=: ]+([A-Za-z0-9_. -]+)"))), r"\s+"), F.lit(0)))
    ap = blank(rx(t, r"(?:ap|nas|radio)[=: ]+([A-Za-z0-9_.:-]+)"))
    user = blank(rx(t, r"(?:user|username|identity)[=: ]+([A-Za-z0-9_.@-]+)"))
    severity = message_severity(t)
    named = (mac != "") | (user != "") | (ssid != "") | (ap != "")
    rest = [c for c in df.columns if c not in (line, time)]
    return df.select(
        *rest, F.col(time).alias("ts"), message_event_type(t).alias("event_type"), severity.alias("severity"), lookup(severity, fv.SEVERITY_SCORE, 10).alias("severity_score"),
        F.coalesce(F.nullif(user, F.lit("")), F.nullif(mac, F.lit("")), F.lit("unknown_syslog_client")).alias("client"), user.alias("username"), mac.alias("mac"), ssid.alias("ssid"),
        ap.alias("ap"), t.alias("message"), F.length(t).alias("raw_length"), F.when(named, 0.86).otherwise(0.56).alias("confidence"))


def with_fingerprint(events: DataFrame) -> DataFrame:
    """Fingerprint on event time, so that a repeated line in the same second is a duplicate."""
    second = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return events.withColumn("fp", live_fingerprint(second, F.col("client"), F.col("event_type"), F.col("ap"), F.col("message")))


def dedupe(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First event per fingerprint; on a stream within the watermark. The raw log keeps all."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fp"])
    order = F.struct(*[c for c in ("ts", "id", "event_id") if c in events.columns])
    return events.groupBy("fp").agg(F.min_by(F.struct(*events.columns), order).alias("_first")).select("_first.*")


def threshold_alerts(events: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes",
                     auth: int = fv.AUTH_FAILURE_THRESHOLD, roam: int = fv.ROAMING_THRESHOLD) -> DataFrame:
    """Clients over a threshold per time window (tumbling, or sliding with `slide`)."""
    df = events.withWatermark("ts", delay) if events.isStreaming else events
    is_roam = F.col("type") == "roaming"
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = df.filter(F.col("type").isin("authentication_failure", "roaming")).groupBy(span.alias("w"), "type", "client").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= F.when(is_roam, roam).otherwise(auth)).select(
        F.col("w.start").alias("window_start"), "type", "client", "n", F.when(is_roam, "Medium").otherwise("High").alias("severity"))


def activity_sessions(events: DataFrame, gap: str = "6 hours", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a client: events without a pause longer than the gap."""
    df = events.withWatermark("ts", delay) if events.isStreaming else events
    return df.groupBy(F.session_window("ts", gap).alias("w"), "client").agg(F.count("*").alias("events"), F.max_by("type", F.struct("ts", "id")).alias("last_event")).select(
        "client", F.col("w.start").alias("started_at"), "events", "last_event")


# --- client state as last-write registers -----------------------------------
REGISTERS = ["status", "ssid", "vlan", "ap", "ip", "assoc"]


def register_marks(events: DataFrame, known_ssids: list[str]) -> DataFrame:
    """What each event writes to each register of its client."""
    kind = F.col("type")
    assoc = kind == "association"
    ap = F.coalesce("to_ap", "ap")
    marks: dict[str, Column] = {
        "status": F.when(assoc, "associated").when(kind == "disassociation", "disassociated"),
        "ssid": F.when(assoc & F.col("ssid").isin(*known_ssids), F.col("ssid")), "vlan": F.when(assoc | (kind == "dhcp_assignment"), F.col("vlan")),
        "ap": F.when(assoc | (kind == "roaming"), ap), "ip": F.when(assoc | (kind == "dhcp_assignment"), F.col("ip")), "assoc": F.when(assoc, "yes"),
    }
    return events.select("client", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("id").alias("i"), "type", *[c.cast("string").alias(f"m_{n}") for n, c in marks.items()])


def client_registers(marks: DataFrame) -> DataFrame:
    """Per client the newest write of every register with its time and event, and the last event.

    The maximum of a struct is the same in any order of arrival, so the form holds for a batch, a stream in update mode (one
    row per client that changed) and for `merged_registers`.
    """
    newest = lambda m: F.max(F.when(F.col(m).isNotNull(), F.struct("t", "i", F.col(m).alias("v"))))
    names = {**{r: f"m_{r}" for r in REGISTERS}, "seen": "type"}
    held = marks.groupBy("client").agg(*[newest(m).alias(f"_{n}") for n, m in names.items()])
    stamp = lambda n, c: F.coalesce(F.col(f"_{n}.{c}").cast("long"), F.lit(-1).cast("long")).alias(f"{n}_{c}")
    cols = [x for r in REGISTERS for x in (stamp(r, "t"), stamp(r, "i"), F.col(f"_{r}.v").alias(r))]
    return held.select("client", *cols, stamp("seen", "t"), stamp("seen", "i"), F.col("_seen.v").alias("last_event"))


def merged_registers(rows: DataFrame) -> DataFrame:
    """Several rows of a client to one: of each register the newest write."""
    def newest(n: str, value: str) -> Column:
        return F.max(F.struct(F.col(f"{n}_t").alias("t"), F.col(f"{n}_i").alias("i"), F.col(value).alias("v"))).alias(f"_{n}")

    held = rows.groupBy("client").agg(*[newest(r, r) for r in REGISTERS], newest("seen", "last_event"))
    cols = [F.col(f"_{r}.{c}").alias(n) for r in REGISTERS for c, n in (("t", f"{r}_t"), ("i", f"{r}_i"), ("v", r))]
    return held.select("client", *cols, F.col("_seen.t").alias("seen_t"), F.col("_seen.i").alias("seen_i"), F.col("_seen.v").alias("last_event"))


def state_versions(path: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """foreachBatch: the table of all clients after each batch, one row each, as version=<batch>; older versions are removed.

    A batch that is tried again starts from the version before it and replaces its own, so it changes nothing. Readers take
    the newest version with `read_state`.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files, root = _file_system(spark, path)
        known = sorted(_versions(files, root))
        before = [v for v in known if v < batch_id]
        rows = batch if not before else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/version={before[-1]}"))
        merged_registers(rows).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        for v in before[: 1 - keep if keep > 1 else None]:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}"), True)
    return write


def _file_system(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _versions(files, root) -> list[int]:
    """Versions whose writing ended; a few, as old ones are removed."""
    if not files.exists(root):
        return []
    done = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("version=")]
    return [int(p.getName().split("=")[1]) for p in done if files.exists(p.suffix("/_SUCCESS"))]


def read_state(spark: SparkSession, path: str) -> DataFrame:
    files, root = _file_system(spark, path)
    return spark.read.parquet(f"{path}/version={max(_versions(files, root))}")


def resolve_registers(registers: DataFrame, clients: DataFrame, ssids: DataFrame) -> DataFrame:
    """Registers, one row per client, plus the client's inventory row to the client's state."""
    latest = registers
    start = clients.select(F.col("name").alias("client"), F.struct("role", "ssid", "vlan", "ip", "ap", "status").alias("_c"))
    df = latest.join(start, "client", "left").withColumn("_ssid", F.coalesce("ssid", "_c.ssid"))
    df = df.join(ssids.select(F.lower("ssid").alias("_k"), F.struct(F.col("ssid").alias("ssid"), F.col("role").alias("role"), F.col("expected_vlan").alias("vlan")).alias("_p")), F.lower("_ssid") == F.col("_k"), "left")
    joined = F.col("assoc").isNotNull() & F.col("_p").isNotNull()
    # an association after the last explicit VLAN puts the client back on the SSID's VLAN
    reset = joined & (F.struct("assoc_t", "assoc_i") > F.struct("vlan_t", "vlan_i"))
    return df.select(
        "client", F.when(joined, F.col("_p.role")).otherwise(F.col("_c.role")).alias("role"), F.when(joined, F.col("_p.ssid")).otherwise(F.col("_c.ssid")).alias("ssid"),
        F.coalesce("ap", "_c.ap").alias("ap"), F.when(reset, F.col("_p.vlan")).otherwise(F.coalesce("vlan", "_c.vlan")).alias("vlan"), F.coalesce("ip", "_c.ip").alias("ip"),
        F.coalesce("status", "_c.status", F.lit("associated")).alias("status"), "last_event")


# --- sinks ------------------------------------------------------------------
def run_log_writer(path: str, connector: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: one row per batch with counts, duplicates and severity beside the data; a batch that is tried again replaces its row."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(F.lit(connector).alias("connector")).agg(
            F.count("*").alias("records"), (F.count("*") - F.count_distinct("fp")).alias("duplicates"), F.count_if(F.col("client").isNull()).alias("errors"),
        ).withColumn("severity", F.when(F.col("errors") > 0, "Medium").otherwise("Info")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def raw_log(events: DataFrame, connector: str) -> DataFrame:
    """Append-only raw log: message beside the normalised event."""
    return events.select("fp", F.lit(connector).alias("connector_type"), F.col("message").alias("raw_message"), F.to_json(F.struct("*")).alias("normalized_json"), "severity", "event_type", "ts")


def raw_log_writer(path: str, connector: str, counts: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch: the raw log and, in `counts`, what each batch brought; a batch that is tried again replaces its rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        raw_log(batch, connector).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if counts:
            run_log_writer(counts, connector)(batch, batch_id)
    return write


def event_stream(spark: SparkSession, folder: str, file_filter: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", file_filter).parquet(folder)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", foreach: Callable | None = None) -> None:
    """Process what is there and stop; restarts continue from the checkpoint."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    handle = writer.foreachBatch(foreach).start() if foreach else writer.format("parquet").option("path", path).start()
    handle.awaitTermination()
