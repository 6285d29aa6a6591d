"""Merge, upsert, delete, back-fill and snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import merge as M
from ..session import keep, written
from .bindings import CONFIG_LINES_SQL, WIRELESS_SQL, aps, config_lines, ssids, table
from .duck import m, norm, x
from .extract_queries import BINDINGS_SQL_CDP, INTERFACE_CTES, IP_INVENTORY_CTE, STATUS_CTE, annotated
from .. import fixed_values as fv
from .registry import query


@query("merge_union_distinct", "select o_custkey, o_orderstatus from orders union select o_custkey, 'P' from orders")
def merge_union_distinct(spark, sf):
    o = table(spark, sf, "orders")
    return M.union_distinct(o.select("o_custkey", "o_orderstatus"), o.select("o_custkey", F.lit("P").alias("o_orderstatus")))


_DEV = """
_dev as (select o_orderkey as ord, concat('dev', o_custkey) as id, case when o_orderstatus = 'O' then concat('model', o_orderkey % 5) end as model,
  case when o_orderkey % 2 = 0 then concat('sn', o_orderkey % 7) else '' end as serial, case when o_totalprice > 100000 then o_orderpriority end as role from orders),
_rk as (select *, row_number() over (partition by id order by (model is not null)::int + (serial <> '')::int + (role is not null)::int desc, ord) as r from _dev)"""


def device_rows(spark, sf):
    c = F.col
    return table(spark, sf, "orders").select(
        c("o_orderkey").alias("ord"), F.concat(F.lit("dev"), c("o_custkey").cast("string")).alias("id"),
        F.when(c("o_orderstatus") == "O", F.concat(F.lit("model"), (c("o_orderkey") % 5).cast("string"))).alias("model"),
        F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("sn"), (c("o_orderkey") % 7).cast("string"))).otherwise("").alias("serial"),
        F.when(c("o_totalprice") > 100000, c("o_orderpriority")).alias("role"))


@query("merge_enrich_by_key", f"with {_DEV} select id, arg_min(ord, r) as ord, arg_min(model, r) as model, arg_min(nullif(serial, ''), r) as serial, arg_min(role, r) as role from _rk group by id")
def merge_enrich_by_key(spark, sf):
    return M.enrich_by_key(device_rows(spark, sf), ["id"], ["ord"])


@query("merge_later_wins", f"with {_DEV} select id, max(ord) as ord, arg_max(struct_pack(v := model), ord)['v'] as model, arg_max(serial, ord) as serial, arg_max(struct_pack(v := role), ord)['v'] as role from _dev group by id")
def merge_later_wins(spark, sf):
    return M.later_wins(device_rows(spark, sf), ["id"], F.col("ord"))


@query("merge_first_wins", f"with {_DEV} select id, min(ord) as ord, arg_min(struct_pack(v := model), ord)['v'] as model, arg_min(serial, ord) as serial, arg_min(struct_pack(v := role), ord)['v'] as role from _dev group by id")
def merge_first_wins(spark, sf):
    return M.first_wins_rows(device_rows(spark, sf), ["id"], F.col("ord"))


@query("merge_companion_source", f"""with {_DEV}, _b as (select *, o % 2 as src from (select *, ord as o from _dev))
select id, coalesce(max(nullif(serial, '')) filter (src = 0), max(nullif(serial, '')) filter (src = 1)) as serial from _b group by id""")
def merge_companion_source(spark, sf):
    d = device_rows(spark, sf)
    one = lambda k: d.filter(F.col("ord") % 2 == k).groupBy("id").agg(F.max(F.nullif("serial", F.lit(""))).alias("serial"))
    return M.companion_merge(one(0), one(1), ["id"])


_CHG = "concat('AP-', s_suppkey + 5) as name, concat('SW-new', s_suppkey % 3) as switch, case when s_suppkey % 2 = 0 then 99 end as max_clients"


@query("merge_upsert_aps", f"""with {WIRELESS_SQL}, chg as (select {_CHG} from supplier)
select coalesce(n.name, o.name) as name, coalesce(n.switch, o.switch) as switch, o.uplink_interface, coalesce(n.max_clients, o.max_clients, 25) as max_clients,
  case when n.name is not null then coalesce(o.version, 0) + 1 else o.version end as version
from (select *, 1 as version from aps) o full outer join chg n on n.name = o.name""")
def merge_upsert_aps(spark, sf):
    current = aps(spark, sf).drop("supported_vlans").withColumn("version", F.lit(1))
    changes = table(spark, sf, "supplier").selectExpr("concat('AP-', cast(s_suppkey + 5 as string)) as name", "concat('SW-new', cast(s_suppkey % 3 as string)) as switch",
                                                      "case when s_suppkey % 2 = 0 then 99 end as max_clients")
    return M.upsert(current, changes, "name", defaults={"max_clients": 25}, version="version")


@query("merge_delete_clients", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def merge_delete_clients(spark, sf):
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_custkey")
    return M.delete_keys(table(spark, sf, "customer").select("c_custkey", "c_name"), gone, "c_custkey", "o_custkey")


@query("merge_complete_defaults", f"with {WIRELESS_SQL}, have as (select distinct concat(c_mktsegment, 'WiFi') as ssid, 'local' as source from customer) select * from have union all select ssid, 'default' from ssids where ssid not in (select ssid from have)")
def merge_complete_defaults(spark, sf):
    have = table(spark, sf, "customer").select(F.concat("c_mktsegment", F.lit("WiFi")).alias("ssid"), F.lit("local").alias("source")).distinct()
    return M.complete_defaults(have, ssids(spark).select("ssid", F.lit("default").alias("source")), "ssid")


_L = f"with {CONFIG_LINES_SQL}"


@query("merge_inventory_backfill", f"""{_L}, {INTERFACE_CTES}, {IP_INVENTORY_CTE}
select file_id, interface, ip_address, 'show_ip_interface_brief' as source, evidence_line from ip_inventory
union all select file_id, name, ip_address, 'derived_from_interface_block', min(evidence_line) from interfaces i where ip_address is not null
  and not exists (select 1 from ip_inventory v where v.file_id = i.file_id and v.interface = i.name and v.ip_address = i.ip_address) group by 1, 2, 3""")
def merge_inventory_backfill(spark, sf):
    plain = config_lines(spark, sf)
    inventory, _ = M.backfill_inventory(X.ip_inventory(plain), X.interfaces(X.block_lines(plain, "interface"), plain))
    return inventory.select("file_id", "interface", "ip_address", "source", F.col("evidence.source_line").alias("evidence_line"))


_VBP = fv.VLAN_BRIEF_ROW
_MAC = fv.MAC_ROW
ENRICH_SQL = f"""{INTERFACE_CTES}, {STATUS_CTE},
_rows as (
  select file_id, interface as name, 0 as rank, evidence_line as line, case when regexp_full_match(vlan, '[0-9]+') then vlan end as access_vlan, ip_address, status,
    case when ip_address is not null then 'routed' when regexp_full_match(vlan, '[0-9]+') then 'access' end as mode from interface_status
  union all
  select file_id, unnest(list_filter(list_transform(string_split(trim({x(_VBP, 4)}), ','), lambda p: trim(p)), lambda p: p <> '')), 1, line_no, {x(_VBP, 1)}, null, lower({x(_VBP, 3)}), 'access'
  from config_lines where {m(_VBP)} and not {m(fv.VLAN_BRIEF_HEADER)}
  union all select file_id, {x(_MAC, 4)}, 2, line_no, {x(_MAC, 1)}, null, null, 'access' from config_lines where {m(_MAC)}),
_facts as (
  select file_id, {norm('name')} as k, arg_min(access_vlan, (rank, line)) as access_vlan, arg_min(ip_address, (rank, line)) as ip_address, arg_min(status, (rank, line)) as status, arg_min(mode, (rank, line)) as mode
  from _rows group by 1, 2),
_last as (select *, evidence_line = max(evidence_line) over (partition by file_id, normalized_name) as is_last from interfaces)"""


@query("merge_interface_enrichment", f"""{_L}, {ENRICH_SQL}
select coalesce(i.file_id, f.file_id) as file_id, coalesce(i.normalized_name, f.k) as normalized_name, coalesce(i.access_vlan, f.access_vlan) as access_vlan, coalesce(i.ip_address, f.ip_address) as ip_address,
  f.status, case when i.name is null then coalesce(f.mode, 'operational') else coalesce(nullif(i.mode, 'unknown'), f.mode, i.mode) end as mode,
  case when i.name is null then 'derived_operational_table' else i.source end as source
from _last i full outer join _facts f on f.file_id = i.file_id and i.is_last and f.k = i.normalized_name""")
def merge_interface_enrichment(spark, sf):
    plain = config_lines(spark, sf)
    a = annotated(spark, sf, "blk_interface", "vlan_header")
    out = M.enrich_interfaces(keep(X.interfaces(a, plain)), X.interface_status(plain), X.vlan_brief(a), X.mac_table(plain))
    return out.select("file_id", "normalized_name", "access_vlan", "ip_address", "status", "mode", "source")


@query("merge_inferred_devices", f"""{_L}, {BINDINGS_SQL_CDP}
select distinct file_id, neighbor as id, 'inferred_from_link' as role from cdp_links c where not exists (
  select 1 from config_lines h where h.file_id = c.file_id and {x(r'^[ ]*hostname[ ]+([^ ]+)', col='h.text')} = c.neighbor)""")
def merge_inferred_devices(spark, sf):
    plain = config_lines(spark, sf)
    return inferred(plain)[0]


def inferred(plain):
    """Over all devices, ports, links and VLANs; a port belongs to the device that its file names first."""
    named = X.devices(plain)
    host = named.filter("role = 'network_device'").groupBy("file_id").agg(F.min_by("hostname", "evidence.source_line").alias("device"))
    few = X.block_source(plain, "interface")
    ports = written(X.interfaces(X.block_lines(few, "interface"), few).join(host, "file_id", "left"))
    links = X.cdp_links(X.state_lines(plain, "cdp"), plain).join(host, "file_id", "left").select("file_id", "device", "neighbor")
    defined = plain.select("file_id", F.nullif(F.regexp_extract("text", r"(?i)^[ ]*vlan[ ]+([0-9]+)", 1), F.lit("")).alias("id")).filter("id is not null")
    return M.inferred_entities(named.filter("role = 'network_device'"), ports, links, defined)


@query("merge_inferred_vlans", f"""{_L}, {INTERFACE_CTES}, _ref as (
  select file_id, unnest([access_vlan, native_vlan, dot1q_vlan]) as id, 0 as p from interfaces union all select file_id, unnest(string_split(trunk_allowed_vlans, ',')), 1 from interfaces where trunk_allowed_vlans <> ''),
_def as (select distinct file_id, {x(r'^[ ]*vlan[ ]+([0-9]+)')} as id from config_lines where {m(r'^[ ]*vlan[ ]+[0-9]+')})
select file_id, id, case when min(p) = 0 then 'inferred_from_interface' else 'inferred_from_trunk_allowed' end as source, concat('VLAN_', id) as name from _ref r
where id is not null and regexp_full_match(id, '[0-9]+') and not exists (select 1 from _def d where d.file_id = r.file_id and d.id = r.id) group by 1, 2""")
def merge_inferred_vlans(spark, sf):
    plain = config_lines(spark, sf)
    return inferred(plain)[1]


@query("merge_snapshot_diff", """select coalesce(a.k, b.k) as object_type, coalesce(a.n, 0) as before, coalesce(b.n, 0) as after, coalesce(b.n, 0) - coalesce(a.n, 0) as delta
from (select concat(o_orderstatus, o_orderpriority) as k, count(*) as n from orders where o_orderdate < timestamp '1996-01-01' group by 1) a
full outer join (select concat(o_orderstatus, o_orderpriority) as k, count(*) as n from orders where o_orderdate >= timestamp '1996-01-01' group by 1) b on a.k = b.k""")
def merge_snapshot_diff(spark, sf):
    o = table(spark, sf, "orders").withColumn("object_type", F.concat("o_orderstatus", "o_orderpriority"))
    cut = F.lit("1996-01-01").cast("timestamp")
    return M.snapshot_diff(o.filter(F.col("o_orderdate") < cut), o.filter(F.col("o_orderdate") >= cut), "object_type")
