"""Dedupe, enrichment, upsert and back-fill of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_interface


def _empty(c: Column, kind: str) -> Column:
    if kind == "array":
        return c.isNull() | (F.size(c) == 0)
    if kind == "string":
        return c.isNull() | (c == "")
    return c.isNull()


def _kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.typeName() for f in df.schema.fields}


def union_distinct(*tables: DataFrame) -> DataFrame:
    """Full-row union without repeats; nested columns are compared by value."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    plain = [f.name for f in out.schema.fields if not _has(f.dataType, ("map", "variant"))]
    if len(plain) == len(out.columns):
        return out.dropDuplicates()
    # maps and variants have no equality of their own: they are compared as JSON with sorted keys
    rest = F.to_json(F.to_variant_object(F.struct(*[F.col(c) for c in out.columns if c not in plain])))
    return out.withColumn("_rest", rest).dropDuplicates([*plain, "_rest"]).drop("_rest")


def _has(kind, names: tuple[str, ...]) -> bool:
    if kind.typeName() in names:
        return True
    inner = [f.dataType for f in kind.fields] if kind.typeName() == "struct" else [kind.elementType] if kind.typeName() == "array" else []
    return any(_has(k, names) for k in inner)


def enrich_by_key(df: DataFrame, keys: list[str], order: list[str], placeholder: str | None = None) -> DataFrame:
    """One row per key, empty fields filled from later rows in order.

    A later row with more filled fields than the merged row replaces its
    values; here the fullest row wins per key and the others fill its gaps.
    Rows whose key is entirely empty are kept as they are. `placeholder` names
    a text column in which generated names (VLAN_n) give way to real ones.
    """
    kinds = _kinds(df)
    fields = [c for c in df.columns if c not in keys]
    filled = sum((F.when(~_empty(F.col(c), kinds[c]), 1).otherwise(0) for c in fields if c not in order), F.lit(0))
    keyless = None
    for k in keys:
        test = _empty(F.col(k), kinds[k])
        keyless = test if keyless is None else keyless & test
    ranked = df.filter(~keyless).withColumn("_rank", F.struct((-filled).alias("fill"), *order))
    merged = ranked.groupBy(*keys).agg(*[
        F.min_by(c, F.when(~_empty(F.col(c), kinds[c]), _preference(c, placeholder))).alias(c) for c in fields])
    return merged.select(*df.columns).unionByName(df.filter(keyless))


def _preference(column: str, placeholder: str | None) -> Column:
    if column != placeholder:
        return F.struct(F.lit(0).alias("p"), "_rank")
    return F.struct(F.when(F.col(column).startswith("VLAN_"), 1).otherwise(0).alias("p"), "_rank")


def later_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: the last row as a whole, empty values included."""
    fields = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("_v")).select(*keys, "_v.*").select(*df.columns)


def first_wins_rows(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: the first row as a whole."""
    fields = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("_v")).select(*keys, "_v.*").select(*df.columns)


def upsert(current: DataFrame, changes: DataFrame, key: str, defaults: dict | None = None, version: str | None = None) -> DataFrame:
    """Keyed upsert: new value, else old value, else default; blank texts are no values; `version` counts updates."""
    defaults = defaults or {}
    old, new = current.alias("o"), changes.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    cols = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in current.columns:
        if c in (key, version):
            continue
        given = lambda side, kinds, c=c: F.when(F.trim(f"{side}.{c}") != "", F.col(f"{side}.{c}")) if kinds[c] == "string" else F.col(f"{side}.{c}")
        options = ([given("n", dict(changes.dtypes))] if c in changes.columns else []) + [given("o", dict(current.dtypes))]
        if c in defaults:
            options.append(F.lit(defaults[c]))
        cols.append(F.coalesce(*options).alias(c))
    if version:
        old_version = F.coalesce(f"o.{version}", F.lit(0))
        cols.append(F.when(F.col(f"n.{key}").isNotNull(), old_version + 1).otherwise(old_version).alias(version))
    return joined.select(*cols)


def delete_keys(current: DataFrame, deletes: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key is not in the delete feed (also used for dependent tables)."""
    return current.join(deletes.select(F.col(other_key or key).alias(key)).distinct(), key, "left_anti")


def complete_defaults(current: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """Add default rows whose key is missing."""
    return current.unionByName(defaults.join(current.select(key), key, "left_anti"), allowMissingColumns=True)


def backfill_inventory(ip_rows: DataFrame, interfaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Address inventory with the interface addresses it lacks, and the endpoint inventory of the interfaces."""
    addressed = interfaces.filter("ip_address is not null").select(
        "file_id", F.col("name").alias("interface"), F.col("normalized_name").alias("normalized_interface"), "ip_address",
        F.lit("configured").alias("status"), F.lit(None).cast("string").alias("protocol"), F.lit("derived_from_interface_block").alias("source"), "evidence")
    keys = ["file_id", "interface", "ip_address"]
    once = addressed.groupBy(*keys).agg(F.min_by(F.struct("normalized_interface", "status", "protocol", "source", "evidence"), "evidence.source_line").alias("v")).select(*keys, "v.*")
    missing = once.join(ip_rows.filter("ip_address is not null").select(*keys).distinct(), keys, "left_anti")
    inventory = ip_rows.withColumn("source", F.lit("show_ip_interface_brief")).unionByName(missing)
    return inventory, once.select("file_id", "interface", "ip_address", F.lit(None).cast("string").alias("mac"), "source", "evidence")


def enrich_interfaces(interfaces: DataFrame, status: DataFrame, vlan_brief: DataFrame, macs: DataFrame) -> DataFrame:
    """Fill empty interface fields from operational tables and add interfaces only seen there.

    Operational rows are first reduced to one row per interface: status rows,
    then VLAN ports, then MAC rows, the first value of each field in that order.
    """
    digits = F.col("vlan").rlike(r"^\d+$")
    line = F.col("evidence.source_line")
    from_status = status.select(
        "file_id", F.col("interface").alias("name"), F.lit(0).alias("_rank"), line.alias("_line"), F.when(digits, F.col("vlan")).alias("access_vlan"),
        "ip_address", "status", F.when(F.col("ip_address").isNotNull(), "routed").when(digits, "access").alias("mode"), "evidence")
    from_vlans = vlan_brief.select(
        "file_id", F.explode("ports").alias("name"), F.lit(1).alias("_rank"), line.alias("_line"), F.col("vlan").alias("access_vlan"),
        F.lit(None).cast("string").alias("ip_address"), "status", F.lit("access").alias("mode"), "evidence")
    from_macs = macs.select(
        "file_id", F.col("interface").alias("name"), F.lit(2).alias("_rank"), line.alias("_line"), F.col("vlan").alias("access_vlan"),
        F.lit(None).cast("string").alias("ip_address"), F.lit(None).cast("string").alias("status"), F.lit("access").alias("mode"), "evidence")
    rows = from_status.unionByName(from_vlans).unionByName(from_macs)
    order = F.struct("_rank", "_line")
    facts = rows.groupBy("file_id", normalize_interface(F.col("name")).alias("normalized_name")).agg(
        F.min_by("name", order).alias("f_name"), F.min_by("evidence", order).alias("f_evidence"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"f_{c}") for c in ("access_vlan", "ip_address", "status", "mode")])
    # of several blocks with one name the last one is enriched
    last = interfaces.groupBy("file_id", "normalized_name").agg(F.max(line).alias("_last"))
    base = interfaces.join(last, ["file_id", "normalized_name"]).withColumn("_key", F.when(line == F.col("_last"), F.col("normalized_name")))
    f = facts.withColumnRenamed("normalized_name", "_key")
    joined = base.join(f, ["file_id", "_key"], "full_outer")
    new = F.col("name").isNull()
    old_mode = F.when(F.col("mode") != "unknown", F.col("mode"))
    special = {
        "name": F.coalesce("name", "f_name"), "normalized_name": F.coalesce("normalized_name", "_key"),
        "description": F.when(new, "derived from operational evidence").otherwise(F.col("description")),
        "mode": F.when(new, F.coalesce("f_mode", F.lit("operational"))).otherwise(F.coalesce(old_mode, "f_mode", "mode")),
        "access_vlan": F.coalesce("access_vlan", "f_access_vlan"), "ip_address": F.coalesce("ip_address", "f_ip_address"),
        "source": F.when(new, "derived_operational_table").otherwise(F.col("source")), "evidence": F.coalesce("evidence", "f_evidence"),
    }
    flags = ["port_security_enabled", "port_security_sticky", "shutdown"]
    cols = [special[c].alias(c) if c in special else F.coalesce(c, F.lit(False)).alias(c) if c in flags else F.col(c) for c in interfaces.columns]
    return joined.select(*cols, F.col("f_status").alias("status"))


def inferred_entities(devices: DataFrame, interfaces: DataFrame, links: DataFrame, vlans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Devices and VLANs that are referred to but never defined."""
    refs = (
        interfaces.filter("device is not null").select("file_id", F.col("device").alias("id"), F.lit(0).alias("_p"), F.lit("inferred_from_interface").alias("role"))
        .unionByName(links.select("file_id", F.explode(F.array("device", "neighbor")).alias("id"), F.lit(1).alias("_p"), F.lit("inferred_from_link").alias("role")).filter("id is not null"))
    )
    new_devices = refs.groupBy("file_id", "id").agg(F.min_by("role", "_p").alias("role")).join(devices.select("file_id", "id").distinct(), ["file_id", "id"], "left_anti")
    ids = interfaces.select("file_id", F.explode(F.filter(F.array("access_vlan", "native_vlan", "dot1q_vlan"), lambda v: v.isNotNull())).alias("id"),
                            F.lit(0).alias("_p"), F.lit("inferred_from_interface").alias("source"))
    trunk = interfaces.select("file_id", F.explode("trunk_allowed_vlans").alias("id"), F.lit(1).alias("_p"), F.lit("inferred_from_trunk_allowed").alias("source")).filter(F.col("id").rlike(r"^\d+$"))
    new_vlans = ids.unionByName(trunk).groupBy("file_id", "id").agg(F.min_by("source", "_p").alias("source")).join(
        vlans.select("file_id", "id").distinct(), ["file_id", "id"], "left_anti").withColumn("name", F.concat(F.lit("VLAN_"), "id"))
    return new_devices, new_vlans


def companion_merge(primary: DataFrame, companion: DataFrame, keys: list[str]) -> DataFrame:
    """Primary rows enriched by a companion source; primary values come first."""
    both = primary.withColumn("_source_rank", F.lit(0)).unionByName(companion.withColumn("_source_rank", F.lit(1)), allowMissingColumns=True)
    kinds = _kinds(both)
    fields = [c for c in both.columns if c not in keys and c != "_source_rank"]
    return both.groupBy(*keys).agg(*[F.min_by(c, F.when(~_empty(F.col(c), kinds[c]), F.col("_source_rank"))).alias(c) for c in fields])


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts per key before and after, zero where a side has none."""
    count = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    return count(before, "before").join(count(after, "after"), key, "full_outer").select(
        key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"),
        (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("delta"))
