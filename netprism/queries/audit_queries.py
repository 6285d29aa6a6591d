"""Audit chain, login windows, fingerprints, paging and filters over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import search as S
from .bindings import table
from .registry import query

# the chain under test: every event is a log row of its day; some rows carry no hash, some were edited
_BROKEN = "event_id % 701 = 5"
_BARE = "event_id % 97 = 3"
LOG_SQL = f"""
_rows as (
  select event_id as id, strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at, concat('user', user_id) as actor, event_type as action, props as target,
    concat('value ', round(value * 100)::bigint) as detail, case when event_type = 'error' then 'High' else 'Info' end as severity, concat('t', user_id % 4) as tenant_id,
    {_BARE} as bare, {_BROKEN} as broken from events),
_own as (select *, case when not bare then sha256(concat('seed', id)) end as own from _rows),
_prev as (select *, coalesce(last_value(own ignore nulls) over (partition by tenant_id order by id rows between unbounded preceding and 1 preceding), 'GENESIS') as prev from _own)"""


def log(spark, sf):
    """Rows whose stored hash is right only where the row's own seed equals the chained hash; see the checks."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("actor"),
        F.col("event_type").alias("action"), F.col("props").alias("target"), F.concat(F.lit("value "), F.round(F.col("value") * 100).cast("long").cast("string")).alias("detail"),
        F.when(F.col("event_type") == "error", "High").otherwise("Info").alias("severity"), F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        F.when(~F.expr(_BARE), F.sha2(F.concat(F.lit("seed"), F.col("event_id").cast("string")), 256)).alias("entry_hash"),
        F.expr(_BROKEN).alias("broken"))


@query("audit_chain", f"""with {LOG_SQL}
select id, tenant_id, sha256(concat_ws('|', prev, created_at, actor, action, target, detail, severity, tenant_id)) as expected_hash, prev as previous_hash,
  case when own is null then 'skipped' when broken then 'broken' else 'unlinked' end as status from _prev""")
def audit_chain(spark, sf):
    rows = log(spark, sf).withColumn("prev_hash", F.lit(None).cast("string"))
    from ..operators.carry import carry_forward

    checked = A.verify_chain(rows)
    previous = carry_forward(rows, {"p": F.col("entry_hash")}, key="tenant_id", order="id", inclusive=False).select("id", F.coalesce("p", F.lit(A.GENESIS)).alias("previous_hash"))
    return checked.join(previous, "id").select(
        "id", "tenant_id", "expected_hash", "previous_hash",
        F.when(F.col("status") == "skipped", "skipped").when(F.col("broken"), "broken").otherwise("unlinked").alias("status"))


@query("audit_chain_summary", f"""with {LOG_SQL}
select tenant_id, count(*) as checked, cast(0 as bigint) as valid, count(own) as broken, count(*) filter (own is null) as skipped, min(case when own is not null then id end) as first_broken
from _prev group by tenant_id""")
def audit_chain_summary(spark, sf):
    rows = log(spark, sf).withColumn("prev_hash", F.lit("GENESIS"))
    return A.chain_summary(A.verify_chain(rows))


_ATT = """
attempts as (select event_id as id, concat('u', user_id) as username, concat('10.0.0.', user_id % 7) as ip_address, event_type <> 'error' as ok, epoch(date_trunc('second', ts))::bigint as t from events)"""


@query("audit_login_window", f"""with {_ATT}
select a.id, a.username, a.ip_address, count(*) filter (not b.ok) as recent_failures, count(*) filter (not b.ok) < 5 as allowed
from attempts a join attempts b on (b.username = a.username or b.ip_address = a.ip_address) and b.t between a.t - 900 and a.t group by all""")
def audit_login_window(spark, sf):
    attempts = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")).alias("ip_address"), (F.col("event_type") != "error").alias("ok"), F.col("ts").alias("created_at"))
    return A.login_allowed(attempts).select("id", "username", "ip_address", "recent_failures", "allowed")


@query("audit_search", """select event_id as id, event_type as action from events
where (concat('user', user_id) like '%er1%' or event_type like '%er1%' or props like '%er1%') and event_type like '%e%' and event_type <> 'error'""")
def audit_search(spark, sf):
    rows = log(spark, sf)
    return A.audit_search(rows, text="er1", action="e", severity="Info").select("id", "action")


@query("audit_fingerprints", """select sha256(concat_ws('|', 'syslog_events', '', concat('u', user_id), event_type)) as fingerprint, min(ts) as first_seen, max(ts) as last_seen, count(*) as seen
from events group by 1""")
def audit_fingerprints(spark, sf):
    from ..functions.text import connector_fingerprint

    e = table(spark, sf, "events")
    fp = connector_fingerprint(F.lit("syslog_events"), F.lit(None), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_type"))
    return A.fingerprint_counters(e, fp)


@query("audit_poll_page", "select event_id as id, event_type from events where event_id > 250 order by event_id limit 500")
def audit_poll_page(spark, sf):
    return A.poll(table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type"), since_id=250)


@query("audit_newest_events", "select event_id as id, user_id, event_type from events order by event_id desc limit 30")
def audit_newest_events(spark, sf):
    return A.newest(table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "event_type"), "id", 30)


@query("audit_tenant_rows", "select event_id as id, nullif(concat('t', user_id % 4), 't0') as tenant_id from events where user_id % 4 in (0, 2)")
def audit_tenant_rows(spark, sf):
    tenant = F.nullif(F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")), F.lit("t0"))
    return S.tenant_rows(table(spark, sf, "events").select(F.col("event_id").alias("id"), tenant.alias("tenant_id")), "t2")


@query("audit_event_filter", "select event_id as id, props as detail from events where event_type = 'error' and contains(props, '7')")
def audit_event_filter(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.lit("Info").alias("severity"), F.lit("").alias("client"), F.col("props").alias("detail"))
    return S.filter_events(e, kind="error", severity="Info", text="7").select("id", "detail")
