"""Live event jobs: batch forms with checks, and streaming forms run to the end of the given files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..session import shared_folder
from ..sources import connectors as K
from ..streaming import live as L
from .bindings import EVENT_COLUMNS, WIRELESS_SQL, clients, shape_events, ssids, table, wireless_events
from .function_queries import _TYPE as TYPE_SQL, _sev
from .registry import query
from .wireless_queries import SESSION_CTES

_W = f"with {WIRELESS_SQL}"
_LINE = ("concat('user=u', user_id % 50, case when event_id % 3 = 0 then ' ssid=Corp WiFi' else '' end, case when event_id % 4 = 0 then concat(' ap=AP-', user_id % 9) else '' end, "
         "case event_type when 'error' then ' auth fail' when 'view' then ' roam to next' when 'signup' then ' dhcp lease' when 'purchase' then ' deauth attack' else ' joined' end)")


def syslog_lines(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.expr(_LINE.replace("user_id % 50", "cast(user_id % 50 as string)").replace(
        "user_id % 9)", "cast(user_id % 9 as string))")).alias("line"))


LINE_SQL = f"""
_l as (select event_id, ts, {_LINE} as text from events),
parsed as (
  select event_id, ts, {TYPE_SQL} as event_type, {_sev('lower(text)')} as severity, regexp_extract(text, 'user=([a-z0-9]+)', 1) as client, case when text like '%ssid=%' then 'Corp' else '' end as ssid,
    regexp_extract(text, ' ap=(AP-[0-9]+)', 1) as ap, text as message, cast(length(text) as int) as raw_length, 0.86 as confidence from _l)"""


@query("stream_syslog_parse", f"with {LINE_SQL} select *, case severity when 'Critical' then 95 when 'High' then 75 when 'Medium' then 50 else 10 end as severity_score from parsed")
def stream_syslog_parse(spark, sf):
    return L.parse_syslog(syslog_lines(spark, sf)).drop("username", "mac")


@query("stream_fingerprint_dedupe", f"""with {LINE_SQL} select distinct sha256(concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S'), client, event_type, ap, message)) as fp, client, event_type from parsed""")
def stream_fingerprint_dedupe(spark, sf):
    return L.dedupe(L.with_fingerprint(L.parse_syslog(syslog_lines(spark, sf)))).select("fp", "client", "event_type")


@query("stream_hourly_alerts", f"""{_W} select time_bucket(interval '1 hour', ts) as window_start, type, client, count(*) as n, case type when 'roaming' then 'Medium' else 'High' end as severity from wevents
where type in ('authentication_failure', 'roaming') group by 1, 2, 3 having count(*) >= case type when 'roaming' then 4 else 3 end""")
def stream_hourly_alerts(spark, sf):
    return L.threshold_alerts(wireless_events(spark, sf))


@query("stream_daily_alerts", f"""{_W} select time_bucket(interval '24 hours', ts) as window_start, type, client, count(*) as n, case type when 'roaming' then 'Medium' else 'High' end as severity from wevents
where type in ('authentication_failure', 'roaming') group by 1, 2, 3 having count(*) >= case type when 'roaming' then 4 else 3 end""")
def stream_daily_alerts(spark, sf):
    return L.threshold_alerts(wireless_events(spark, sf), "24 hours")


@query("stream_sliding_alerts", f"""{_W}, _s as (select *, unnest([0, 1, 2, 3]) as back from wevents where type in ('authentication_failure', 'roaming'))
select time_bucket(interval '6 hours', ts) - back * interval '6 hours' as window_start, type, client, count(*) as n, case type when 'roaming' then 'Medium' else 'High' end as severity
from _s group by 1, 2, 3 having count(*) >= case type when 'roaming' then 4 else 3 end""")
def stream_sliding_alerts(spark, sf):
    return L.threshold_alerts(wireless_events(spark, sf), "24 hours", "6 hours")


@query("stream_activity_sessions", f"""{_W}, _g as (select *, coalesce(ts >= lag(ts) over (partition by client order by ts, id) + interval '6 hours', true)::int as fresh from wevents),
_n as (select *, sum(fresh) over (partition by client order by ts, id) as no from _g)
select client, min(ts) as started_at, count(*) as events, arg_max(type, (ts, id)) as last_event from _n group by client, no""")
def stream_activity_sessions(spark, sf):
    return L.activity_sessions(wireless_events(spark, sf))


@query("stream_raw_log", f"with {LINE_SQL} select sha256(concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S'), client, event_type, ap, message)) as fp, message as raw_message, severity, event_type from parsed")
def stream_raw_log(spark, sf):
    return L.raw_log(L.with_fingerprint(L.parse_syslog(syslog_lines(spark, sf))), "syslog_events").select("fp", "raw_message", "severity", "event_type")


# --- streaming runs ---------------------------------------------------------
def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return L.event_stream(spark, sf, "events.parquet", schema)


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("stream_run_dedupe", f"""with {LINE_SQL} select distinct sha256(concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S'), client, event_type, ap, message)) as fp, client, event_type from parsed""")
def stream_run_dedupe(spark, sf):
    """The dedupe as a stream: the watermark spans the data, so the result equals the batch form."""
    expr = _LINE.replace("user_id % 50", "cast(user_id % 50 as string)").replace("user_id % 9)", "cast(user_id % 9 as string))")
    lines = _stream(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(expr).alias("line"))
    folder = _folder(spark, "dedupe")
    L.run_available(L.dedupe(L.with_fingerprint(L.parse_syslog(lines)), "60 days").select("fp", "client", "event_type"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("fp string, client string, event_type string").parquet(f"{folder}/out")


@query("stream_run_client_state", f"""{_W}, {SESSION_CTES}
select client, arg_max(struct_pack(v := role), (ts, id))['v'] as role, arg_max(struct_pack(v := ssid), (ts, id))['v'] as ssid, arg_max(struct_pack(v := ap), (ts, id))['v'] as ap,
  arg_max(struct_pack(v := vlan), (ts, id))['v'] as vlan, arg_max(struct_pack(v := ip), (ts, id))['v'] as ip, arg_max(status, (ts, id)) as status, arg_max(last_event, (ts, id)) as last_event from sessions group by client""")
def stream_run_client_state(spark, sf):
    """Event sourcing as a stateful stream: registers per client, resolved against the inventory."""
    events = shape_events(_stream(spark, sf).selectExpr(*[f"{e} as {n}" for n, e in EVENT_COLUMNS.items()]))
    folder = _folder(spark, "state")
    marks = L.register_marks(events, [r[0] for r in fv.SSID_ROWS])

    L.run_available(L.client_registers(marks), "", f"{folder}/checkpoint", "update", L.state_versions(f"{folder}/state"))
    return L.resolve_registers(L.read_state(spark, f"{folder}/state"), clients(spark, sf), ssids(spark))


@query("stream_run_raw_log", f"with {LINE_SQL} select sha256(concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S'), client, event_type, ap, message)) as fp, message as raw_message, severity, event_type from parsed")
def stream_run_raw_log(spark, sf):
    """The raw log as a stream writes it, every event kept."""
    expr = _LINE.replace("user_id % 50", "cast(user_id % 50 as string)").replace("user_id % 9)", "cast(user_id % 9 as string))")
    lines = _stream(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(expr).alias("line"))
    folder = _folder(spark, "rawlog")
    L.run_available(L.with_fingerprint(L.parse_syslog(lines)), "", f"{folder}/checkpoint", "append", L.raw_log_writer(f"{folder}/raw", "syslog_events", f"{folder}/log"))
    return spark.read.parquet(f"{folder}/raw").select("fp", "raw_message", "severity", "event_type")


# the events are one file, so one batch
@query("stream_run_log", f"""with {LINE_SQL}, f as (select sha256(concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S'), client, event_type, ap, message)) as fp, client from parsed)
select 'syslog_events' as connector, count(*) as records, count(*) - count(distinct fp) as duplicates, count(*) filter (client is null) as errors,
  case when count(*) filter (client is null) > 0 then 'Medium' else 'Info' end as severity, cast(0 as int) as batch_id from f""")
def stream_run_log(spark, sf):
    """One metrics row per micro-batch, written beside the data."""
    expr = _LINE.replace("user_id % 50", "cast(user_id % 50 as string)").replace("user_id % 9)", "cast(user_id % 9 as string))")
    lines = _stream(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(expr).alias("line"))
    folder = _folder(spark, "runlog")
    L.run_available(L.with_fingerprint(L.parse_syslog(lines)), "", f"{folder}/checkpoint", "append", L.run_log_writer(f"{folder}/log", "syslog_events"))
    return spark.read.parquet(f"{folder}/log")


# --- connectors -------------------------------------------------------------
_JSON = """concat('{"records":[{"username":"', c_name, '","acct_status_type":"', case when c_custkey % 3 = 0 then 'Stop' else 'Start' end, '","nas_identifier":"AP-', cast(c_custkey % 9 as string), '","vlan":', cast(c_custkey % 3 * 10 + 10 as string),
 ',"framed_ip_address":"10.0.0.', cast(c_custkey % 200 as string), '"},{"name":"MR-', cast(c_custkey as string), '","model":"X', cast(c_custkey % 5 as string), '","vlans":[10,20],"status":"Online"}]}')"""


def records(spark, sf):
    return K.json_records(table(spark, sf, "customer").select("c_custkey", F.expr(_JSON).alias("value")))


@query("connector_radius", """select c_name as client, case when c_custkey % 3 = 0 then 'disassociation' else 'association' end as event_type, concat('AP-', c_custkey % 9) as to_ap, cast(c_custkey % 3 * 10 + 10 as varchar) as vlan,
  concat('10.0.0.', c_custkey % 200) as ip, concat('RADIUS ', case when c_custkey % 3 = 0 then 'disassociation' else 'association' end, ' for ', c_name) as detail from customer""")
def connector_radius(spark, sf):
    return K.connector_events(records(spark, sf), "radius_accounting").filter("client <> ''").select("client", "event_type", "to_ap", "vlan", "ip", "detail")


@query("connector_vendor_aps", "select concat('MR-', c_custkey) as name, concat('X', c_custkey % 5) as model, '10,20' as supported_vlans, 30 as max_clients, 'online' as status, 'meraki_api' as vendor from customer")
def connector_vendor_aps(spark, sf):
    return K.connector_aps(records(spark, sf), "meraki_api").select("name", "model", "supported_vlans", "max_clients", "status", "vendor")


@query("connector_vendor_clients", "select c_name as client, 'association' as event_type, concat('AP-', c_custkey % 9) as to_ap, cast(c_custkey % 3 * 10 + 10 as varchar) as vlan, concat('10.0.0.', c_custkey % 200) as ip from customer")
def connector_vendor_clients(spark, sf):
    return K.connector_events(records(spark, sf), "aruba_central").select("client", "event_type", "to_ap", "vlan", "ip")


@query("connector_syslog", f"select role as client, {TYPE_SQL} as event_type, {_sev('lower(text)')} as severity from conversations")
def connector_syslog(spark, sf):
    raw = table(spark, sf, "conversations").select(F.to_json(F.array(F.struct(F.col("text").alias("message"), F.col("role").alias("client")))).alias("value"))
    return K.connector_events(K.json_records(raw), "syslog_events").select("client", "event_type", "severity")

