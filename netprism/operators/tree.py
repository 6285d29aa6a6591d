"""JSON trees: walk, facts, tables, and typed rows from records of unknown schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.net import DOTTED, looks_like_ip, network_cidr
from ..functions.text import contains_any, key_token, normalize_interface, path_hint, path_key, vlan_id, vlan_tokens
from ..session import keep
from .graph import first_rows

CONTAINERS = ["object", "array"]

# fixed values: key synonyms in order of preference (compared as plain tokens)
DEVICE_KEYS = ["hostname", "displayname", "label", "name", "id", "devicename", "nodename", "sysname", "systemname", "devicelabel", "displaylabel", "caption"]
TYPE_KEYS = ["type", "devicetype", "model", "category", "class", "classname", "platform", "kind", "family"]
INTERFACE_KEYS = ["interface", "interfacename", "ifname", "portname", "port", "portid", "interfaceid", "slotport", "moduleport", "adaptername", "nicname"]
DEVICE_REF_KEYS = ["device", "devicename", "hostname", "parent", "node", "nodename", "nodeid", "deviceid", "objectid", "uuid", "guid", "owner", "host"]
SOURCE_KEYS = ["source", "src", "from", "sourcedevice", "sourcenode", "sourceid", "srcid", "fromid", "localid", "nodea", "a", "localdevice", "devicea"]
TARGET_KEYS = ["target", "dst", "to", "targetdevice", "targetnode", "targetid", "dstid", "toid", "remoteid", "nodeb", "b", "remotedevice", "neighbor", "deviceb"]
SOURCE_PORT_KEYS = ["sourceinterface", "localinterface", "fromport", "sourceport", "srcport", "porta", "interfacea", "localport"]
TARGET_PORT_KEYS = ["targetinterface", "remoteinterface", "toport", "targetport", "dstport", "destinationport", "portb", "interfaceb", "remoteport"]
IP_KEYS = ["ip", "ipaddress", "address", "ipv4", "ipv4address", "ipaddr"]
MASK_KEYS = ["mask", "subnetmask", "netmask"]
MAC_KEYS = ["mac", "macaddress", "hwaddr"]
DEVICE_HINTS = ["router", "switch", "ap", "access", "wireless", "wlc", "server", "pc", "laptop", "firewall", "asa", "cloud", "internet", "printer"]


def read_documents(spark, path: str) -> DataFrame:
    """JSON files to `file_id, v`; a file that does not parse keeps a null tree and its text."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return raw.select("file_id", F.try_parse_json("text").alias("v"), "text")


def documents(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("file_id"), F.try_parse_json(F.col(json_col)).alias("v"))


def _kind(v: Column) -> Column:
    shape = F.schema_of_variant(v)
    return (
        F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "VOID", "null").when(shape == "BOOLEAN", "boolean")
        .when(shape == "BIGINT", "integer").when(shape.startswith("DECIMAL") | (shape == "DOUBLE"), "number").otherwise("string"))


def walk(docs: DataFrame) -> DataFrame:
    """Every node of every document: `file_id, path, depth, type, v`.

    One explode per level; a level is kept only while it feeds the next, and
    the loop ends with the deepest level that holds containers.
    """
    level = docs.filter("v is not null").select("file_id", F.lit("$").alias("path"), F.lit(0).alias("depth"), "v").withColumn("type", _kind(F.col("v")))
    out = level
    while True:  # ends with the deepest level
        parents = keep(level.filter(F.col("type").isin(*CONTAINERS)))
        if parents.isEmpty():
            break
        children = parents.withColumnRenamed("v", "_v").lateralJoin(parents.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.replace("key", F.lit("."), F.lit("_")))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = children.select("file_id", F.concat("path", step).alias("path"), (F.col("depth") + 1).alias("depth"), F.col("value").alias("v")).withColumn("type", _kind(F.col("v")))
        out = out.unionByName(level)
    return out


def _text(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))


def tree_index(nodes: DataFrame) -> DataFrame:
    """Path, key, depth, type, number of children and a preview of every node."""
    v, kind = F.col("v"), F.col("type")
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    items = F.size(F.try_variant_get(v, "$", "array<variant>"))
    children = F.when(kind == "object", F.size(keys)).when(kind == "array", items).otherwise(0)
    preview = F.when(kind == "object", F.array_join(F.array_sort(keys), ", ")).when(kind == "array", F.concat(items.cast("string"), F.lit(" item(s)"))).otherwise(_text(v))
    return nodes.select("file_id", "path", path_key(F.col("path")).alias("key"), "depth", "type", children.alias("children"), preview.alias("preview"))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~F.col("type").isin(*CONTAINERS)).select("file_id", "path", path_key(F.col("path")).alias("key"), "type", _text(F.col("v")).alias("value"))


def _is_config(text: Column) -> Column:
    """Several lines, or a line that starts as a configuration command does."""
    return text.contains("\n") | text.rlike(r"(?i)^\s*(?:hostname|interface|router|vlan|access-list|ip (?:access-list|route|dhcp|nat|address))\s+\S+\s+\S")


def _fact(path: Column, key: Column, text: Column) -> Column:
    """First matching fact rule with its confidence."""
    blob = F.lower(F.concat(path, F.lit(" "), key))
    any_of = lambda words: contains_any(blob, words)
    whole_ip, whole_mac = text.rlike(DOTTED), text.rlike("^(?:" + fv.FACT_MAC + ")$")
    number = F.regexp_extract(text, r"\b\d{1,4}\b", 0).try_cast("int")
    fact = lambda name, conf: F.struct(F.lit(name).alias("fact_type"), F.lit(conf).alias("confidence"))
    return F.coalesce(
        F.when(whole_ip | (text.rlike(fv.ENTITY_IP) & any_of(fv.FACT_IP_KEYS)), fact("ip_address", 0.90)),
        F.when(text.rlike(fv.FACT_MAC), fact("mac_address", 0.88)),
        F.when((text.rlike(fv.FACT_INTERFACE) | any_of(fv.FACT_INTERFACE_KEYS)) & ~_is_config(text), fact("interface", 0.78)),
        F.when(blob.rlike(fv.FACT_VLAN_KEY) & number.between(1, 4094), fact("vlan", 0.82)),
        F.when((text.rlike(fv.FACT_CONFIG_LINE) | any_of(fv.FACT_CONFIG_KEYS)) & (F.length(text) > 8), fact("config_or_cli", 0.76)),
        F.when((key_token(key).rlike(fv.FACT_DEVICE_KEY) | any_of(fv.FACT_DEVICE_PATHS)) & ~text.contains("\n") & ~whole_ip & ~whole_mac
               & ~F.lower(text).isin(*fv.FACT_STATUS_VALUES), fact("device_candidate", 0.72)),
        F.when(blob.rlike(fv.FACT_LINK_KEY) & ~text.contains("\n"), fact("link_reference", 0.62)),
        F.when(text.rlike(fv.FACT_DOMAIN), fact("hostname_or_domain", 0.70)))


def key_values(leaf: DataFrame) -> DataFrame:
    """Leaf index with the fact class of each value."""
    t = F.trim("value")
    fact = F.when(t != "", _fact(F.col("path"), F.col("key"), t))
    # exploded, so that a filter on the class does not work it out a second time
    return leaf.select("*", F.explode(F.array(fact)).alias("_f")).select(
        "file_id", "path", "key", F.col("type").alias("value_type"), "value", F.coalesce("_f.fact_type", F.lit("generic_value")).alias("fact_type"),
        F.coalesce("_f.confidence", F.lit(0.45)).alias("confidence"))


def network_facts(kv: DataFrame) -> DataFrame:
    """Classified facts, and the addresses and interfaces inside configuration texts: each value is classed and read once."""
    def inner(kind: str, pattern: str, conf: float, lower: bool = False) -> Column:
        found = F.array_distinct(F.regexp_extract_all("value", F.lit(pattern), F.lit(0)))
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("fact_type"), (F.lower(x) if lower else x).alias("value"), F.lit(conf).alias("confidence")))

    own = F.array(F.struct("fact_type", "value", "confidence"))
    held = F.concat(own, inner("ip_address", fv.ENTITY_IP, 0.80), inner("mac_address", fv.FACT_MAC, 0.78, True), inner("interface", fv.FACT_INTERFACE, 0.72))
    facts = F.when(F.col("fact_type") == "config_or_cli", held).otherwise(own)
    return kv.filter("fact_type <> 'generic_value'").select("file_id", "path", "key", F.explode(facts).alias("_x")).select("file_id", "path", "key", "_x.*")


def payload_tables(nodes: DataFrame) -> DataFrame:
    """Arrays of objects: rows, and how many rows carry each column. The nodes are read once: a row counts under no column, too."""
    from pyspark.sql import Window

    array = F.regexp_extract(F.col("path"), r"^(.*)\[\d+\]$", 1)
    keys = F.col("keys") if "keys" in nodes.columns else F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
    rows = nodes.filter((F.col("type") == "object") & (array != "")).select("file_id", array.alias("path"), keys.alias("keys"))
    named = F.concat(F.array(F.lit(None).cast("string")), "keys")
    counted = rows.select("file_id", "path", F.explode(named).alias("column")).groupBy("file_id", "path", "column").agg(F.count("*").alias("presence"))
    total = F.max(F.when(F.col("column").isNull(), F.col("presence"))).over(Window.partitionBy("file_id", "path"))
    return counted.withColumn("rows", total).filter("column is not null")


def manifest(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Nodes, leaves and facts per document."""
    n = nodes.groupBy("file_id").agg(F.count("*").alias("total_nodes"), F.count_if(~F.col("type").isin(*CONTAINERS)).alias("leaf_values"),
                                     F.count_if(F.col("type") == "object").alias("objects"), F.count_if(F.col("type") == "array").alias("arrays"))
    f = facts.groupBy("file_id").agg(F.count("*").alias("network_facts"))
    return n.join(f, "file_id", "left").na.fill(0, ["network_facts"])


def list_contexts(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Total length of the lists under each key."""
    size = F.size(F.try_variant_get("v", "$", "array<variant>"))
    return nodes.filter("type = 'array'").groupBy(path_key(F.col("path")).alias("key")).agg(F.sum(size).alias("total")).transform(first_rows, limit, F.col("total").desc(), "key")


def schema_map(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Source paths per table by frequency with their rank, indexes removed from the path."""
    from pyspark.sql import Window

    counted = rows.groupBy("object_type", "path").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("object_type").orderBy(F.col("count").desc(), "path"))
    ranked = counted.withColumn("rank", rank)
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def embedded_configs(leaf: DataFrame) -> DataFrame:
    """Configuration texts inside values, plain or base64, as lines for the text operators."""
    t = F.trim("value")
    hint = contains_any(path_hint(F.col("path")), fv.CONFIG_KEY_WORDS)
    plain = F.when((hint | contains_any(F.lower(t), fv.CONFIG_TEXT_WORDS)) & (F.length(t) > 15), t)
    packed = F.regexp_replace(t, r"\s+", "")
    padded = F.rpad(packed, F.ceil(F.length(packed) / 4) * 4, F.lit("="))
    decoded = F.when((F.length(t) > 60) & t.rlike(r"^[A-Za-z0-9+/=\s]+$"), F.try_to_binary(padded, F.lit("base64")))
    text = F.decode(decoded, "UTF-8")
    hidden = F.when((F.length(text) > 30) & contains_any(F.lower(text), fv.CONFIG_TEXT_WORDS), text)
    return leaf.select("file_id", "path", F.when(plain.isNotNull(), "text").otherwise("base64").alias("encoding"), F.coalesce(plain, hidden).alias("text")).filter("text is not null")


# --- records ----------------------------------------------------------------
WRAPPER_LEVELS = 2


def records(nodes: DataFrame) -> DataFrame:
    """Object nodes with their scalar and list fields as token -> text, wrappers lifted into them.

    A field inside a known wrapper (attributes, ipv4, switchport ...), or inside a wrapper of a wrapper, counts as a field
    of the record after its own fields, and as `wrapper_field`. Lists of {key, value} pairs in a wrapper are fields too, and
    a record that is such a pair carries the field that it names.
    """
    objects = nodes.filter("type = 'object'")
    none = F.array().cast("array<struct<k:string,v:string>>")
    is_a = lambda v, kind: F.schema_of_variant(v).startswith(kind)
    text = lambda v: F.try_variant_get(v, "$", "string")
    entries = lambda v: F.coalesce(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    field = lambda name, value: F.struct(key_token(name).alias("k"), value.alias("v"))
    pick = lambda v, keys: F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in keys])

    def pair(v: Column) -> Column:
        name, value = pick(v, fv.PAIR_NAME_KEYS), pick(v, fv.PAIR_VALUE_KEYS)
        return F.when(name.isNotNull() & value.isNotNull(), field(name, value))

    def plain(v: Column) -> Column:
        return F.transform(F.filter(entries(v), lambda e: ~is_a(e["value"], "OBJECT")), lambda e: field(e["key"], text(e["value"])))

    def lifted(v: Column, levels: int) -> Column:
        """Fields of the wrappers of an object, by their own name and with that of the wrapper before it."""
        wraps = F.filter(entries(v), lambda e: e["key"].isin(*fv.WRAPPER_KEYS))

        def of(e: Column) -> Column:
            inner = F.transform(F.filter(entries(e["value"]), lambda x: ~is_a(x["value"], "OBJECT")), lambda x: F.array(
                field(x["key"], text(x["value"])), field(F.concat(e["key"], F.lit("_"), x["key"]), text(x["value"]))))
            deeper = lifted(e["value"], levels - 1) if levels > 1 else none
            listed = F.filter(F.transform(F.coalesce(F.try_variant_get(e["value"], "$", "array<variant>"), F.array().cast("array<variant>")), pair), lambda x: x.isNotNull())
            return F.when(is_a(e["value"], "OBJECT"), F.concat(F.flatten(inner), deeper)).when(is_a(e["value"], "ARRAY"), listed).otherwise(none)

        return F.flatten(F.transform(wraps, of))

    usable = lambda s: s["v"].isNotNull() & ~s["v"].isin("", "[]", "{}")
    v = F.col("v")
    own = F.concat(plain(v), lifted(v, WRAPPER_LEVELS), F.filter(F.array(pair(v)), lambda x: x.isNotNull()))
    # generated, so that the many readers of the fields take them and don't spell them out again
    return objects.select("file_id", "path", "depth", F.explode(F.array(F.filter(own, usable))).alias("fields"),
                          F.split(F.regexp_replace(path_hint(F.col("path")), "[^a-z0-9]+", " "), " ").alias("terms"))


def with_device(rows: DataFrame, device_rows: DataFrame, ref: str | None = None) -> DataFrame:
    """rows with `device`: the device that they name in `ref`, else the nearest device record above their path.

    Every prefix of the path is a possible owner; the longest one that is a device counts.
    """
    own = device_rows.groupBy("file_id", F.col("path").alias("up")).agg(F.min("id").alias("id"))
    ancestors = rows.select("file_id", "path", F.explode(_prefixes(F.col("path"))).alias("up")).distinct().join(own, ["file_id", "up"]).groupBy("file_id", "path").agg(
        F.max_by("id", F.length("up")).alias("_owner"))
    out = rows.join(ancestors, ["file_id", "path"], "left")
    if ref is None:
        return out.withColumnRenamed("_owner", "device")
    names = device_names(device_rows).select("file_id", F.col("ref").alias(ref), "device_name")
    return out.join(names, ["file_id", ref], "left").withColumn("device", F.coalesce("device_name", ref, "_owner")).drop(ref, "_owner", "device_name")


def first_of(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per file and key: that of the shortest, then first path. A record and the wrappers lifted into it name the same thing."""
    held = [c for c in rows.columns if c not in ("file_id", *keys)]
    best = rows.groupBy("file_id", *keys).agg(F.min_by(F.struct(*held), F.struct(F.length("path"), F.col("path"))).alias("_r"))
    return best.select("file_id", *keys, "_r.*")


def first_value(names: list[str], fields: str = "fields") -> Column:
    """Value of the first listed key that the record carries."""
    keys, values = F.col(fields)["k"], F.col(fields)["v"]
    found = F.lit(names[0]) if len(names) == 1 else F.get(F.array_intersect(F.array(*[F.lit(n) for n in names]), keys), F.lit(0))
    return F.get(values, F.array_position(keys, found).cast("int") - 1)


def _has_key(names: list[str]) -> Column:
    return F.arrays_overlap(F.col("fields")["k"], F.array(*[F.lit(n) for n in names]))


def _in_path(words: list[str]) -> Column:
    return F.arrays_overlap("terms", F.array(*[F.lit(w) for w in words]))


def _leaf_term(words: list[str]) -> Column:
    """The container that directly holds the record."""
    holder = F.filter("terms", lambda t: (t != "") & ~t.rlike(r"^\d+$"))
    return F.coalesce(F.try_element_at(holder, F.lit(-1)).isin(*words), F.lit(False))


def device_type(name: Column, kind: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", name, kind))
    return (
        F.when(blob.contains("router") | name.rlike(r"(?i)^r\d+\b"), "router").when(blob.contains("switch") | name.rlike(r"(?i)^(sw|s)\d+\b"), "switch")
        .when(blob.contains("access point") | F.concat(F.lit(" "), blob).contains(" ap") | blob.contains("wireless"), "access_point")
        .when(blob.contains("firewall") | blob.contains("asa"), "firewall").when(blob.contains("server"), "server")
        .when(blob.contains("pc") | blob.contains("laptop") | blob.contains("desktop"), "endpoint").when(blob.contains("cloud") | blob.contains("internet"), "cloud").otherwise("device"))


def _map_name() -> Column:
    """Name of a record that sits in an object map: the key of the map."""
    leaf = F.element_at(F.split("path", r"\."), -1)
    return F.when(~leaf.rlike(r"\[\d+\]$") & ~looks_like_ip(leaf) & (leaf != "$"), leaf)


def devices(recs: DataFrame) -> DataFrame:
    kind = first_value(TYPE_KEYS)
    name = F.coalesce(first_value(DEVICE_KEYS), F.when(_in_map(["devices", "device", "nodes", "node", "routers", "switches", "hosts"]), _map_name()))
    explicit = _has_key(["devicetype", "deviceclass", "devicecategory", "hostname", "devicename", "nodeid"])
    type_word = F.exists(F.split(F.lower(F.concat_ws(" ", name, kind)), "[^a-z0-9]+"), lambda t: t.isin(*DEVICE_HINTS))
    child = _in_path(["interface", "interfaces", "port", "ports", "vlan", "vlans", "link", "links", "dhcp", "acl", "route", "mac", "arp"])
    in_devices = _in_path(["device", "devices", "node", "nodes", "router", "switch"])
    is_device = name.isNotNull() & ~looks_like_ip(name) & ((in_devices & (~child | explicit)) | type_word | explicit) & ~(child & ~explicit)
    alias = F.array_distinct(F.filter(F.array(first_value(["id"]), first_value(["nodeid"]), first_value(["deviceid"]), first_value(["uuid"]), name), lambda x: x.isNotNull()))
    return recs.filter(is_device).select("file_id", "path", name.alias("id"), device_type(name, kind).alias("type"), kind.alias("model"), alias.alias("aliases"))


def device_names(device_rows: DataFrame) -> DataFrame:
    """Reference -> device name, one name per reference."""
    return device_rows.select("file_id", F.explode("aliases").alias("ref"), "id", "path").groupBy("file_id", "ref").agg(F.min_by("id", "path").alias("device_name"))


def interfaces(recs: DataFrame, device_rows: DataFrame) -> DataFrame:
    """Interface rows with the device of the nearest record above them."""
    explicit = first_value(INTERFACE_KEYS)
    in_list = _leaf_term(["interfaces", "interface", "ports", "port", "adapters", "nics"]) | _in_map(["interfaces", "interface", "ports", "port"])
    name = F.coalesce(explicit, first_value(["name", "label", "id"]), F.when(_in_map(["interfaces", "interface", "ports", "port"]), _map_name()))
    ip, mask, vlan = first_value(IP_KEYS), first_value(MASK_KEYS), first_value(["accessvlan", "vlan", "vlanid", "vid", "accessvid", "pvid"])
    allowed = first_value(["allowedvlans", "trunkallowedvlans", "allowedvlan", "allowed", "taggedvlans", "tagged"])
    listed = F.coalesce(vlan_tokens(F.regexp_replace(allowed, r'[\[\]"]', "")), F.array().cast("array<string>"))
    rows = recs.filter((in_list | explicit.isNotNull()) & name.isNotNull() & ~looks_like_ip(name) & ~_in_path(["links", "link", "connections", "edges"])).select(
        "file_id", "path", name.alias("name"), normalize_interface(name).alias("normalized_name"), first_value(DEVICE_REF_KEYS).alias("_ref"),
        F.when(looks_like_ip(ip), ip).alias("ip_address"), mask.alias("subnet_mask"), F.when(looks_like_ip(ip), network_cidr(ip, mask)).alias("cidr"),
        F.lower(F.coalesce(first_value(["mode", "switchportmode", "portmode", "linkmode"]), F.when(F.size(listed) > 0, "trunk"), F.when(vlan.isNotNull(), "access"))).alias("mode"),
        vlan_id(vlan).alias("access_vlan"), listed.alias("trunk_allowed_vlans"), vlan_id(first_value(["nativevlan", "nativevid"])).alias("native_vlan"),
        vlan_id(first_value(["dot1q", "encapsulationvlan"])).alias("dot1q_vlan"), first_value(["status", "state", "adminstatus", "operstatus"]).alias("status"), first_value(MAC_KEYS).alias("mac"))
    return with_device(rows, device_rows, "_ref")


def _in_map(words: list[str]) -> Column:
    """The record is a value of an object map of that name (an array item has an index there)."""
    parent = F.lower(F.try_element_at(F.split("path", r"\."), F.lit(-2)))
    return F.coalesce(parent.isin(*words), F.lit(False))


def _prefixes(path: Column) -> Column:
    """All proper ancestors of a path."""
    parts = F.split(F.regexp_replace(path, r"\[", "\u0001["), r"\.|\u0001")
    joined = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), n), "."), r"\.\[", "["))
    return F.filter(joined, lambda p: p != path)


def vlans(recs: DataFrame) -> DataFrame:
    value = first_value(["vlan", "vlanid", "vid", "id", "number"])
    context = _in_path(["vlan", "vlans", "vlanid", "vid"]) | _has_key(["vlan", "vlanid", "vid", "pvid"])
    name = F.coalesce(first_value(["vlanname", "label"]), F.when(_leaf_term(["vlan", "vlans"]), first_value(["name"])))
    rows = recs.filter(context & vlan_id(value).isNotNull()).select("file_id", "path", vlan_id(value).alias("id"), name.alias("_name"))
    return rows.groupBy("file_id", "id").agg(F.min_by("_name", F.when(F.col("_name").isNotNull(), F.col("path"))).alias("_name"), F.min("path").alias("path")).select(
        "file_id", "id", F.coalesce("_name", F.concat(F.lit("VLAN_"), "id")).alias("name"), "path")


def links(recs: DataFrame, device_rows: DataFrame) -> DataFrame:
    """Link rows with node ids resolved to device names on both sides."""
    context = _in_path(["link", "links", "edge", "edges", "connection", "connections", "cable", "cables"])
    raw = recs.filter(context).select(
        "file_id", "path", first_value(SOURCE_KEYS).alias("_a"), first_value(TARGET_KEYS).alias("_b"), first_value(SOURCE_PORT_KEYS).alias("local_interface"),
        first_value(TARGET_PORT_KEYS).alias("remote_interface"), first_value(["platform", "type", "media", "cable", "cabletype"]).alias("platform")).filter("_a is not null and _b is not null")
    names = device_names(device_rows)
    side = lambda col, out: names.select("file_id", F.col("ref").alias(col), F.col("device_name").alias(out))
    joined = raw.join(side("_a", "_an"), ["file_id", "_a"], "left").join(side("_b", "_bn"), ["file_id", "_b"], "left")
    return joined.select("file_id", "path", F.coalesce("_an", "_a").alias("device"), F.coalesce("_bn", "_b").alias("neighbor"), "local_interface", "remote_interface", "platform").filter("device <> neighbor")


def dhcp_scopes(recs: DataFrame) -> DataFrame:
    net, mask, gw = first_value(["network", "subnet", "cidr", "prefix"]), first_value(MASK_KEYS), first_value(["defaultrouter", "gateway", "defaultgateway", "router"])
    context = F.exists("terms", lambda t: t.contains("dhcp")) | F.exists("fields", lambda s: s["k"].contains("dhcp"))
    return recs.filter(context & F.coalesce(net, gw, first_value(["start", "startip", "rangestart"])).isNotNull()).select(
        "file_id", "path", F.coalesce(first_value(["name", "pool", "poolname", "id"]), F.lit("DHCP_POOL")).alias("name"), net.alias("network"), mask.alias("mask"),
        F.when(net.contains("/"), net).otherwise(network_cidr(net, mask)).alias("cidr"), gw.alias("default_gateway"))


def acl_rules(recs: DataFrame) -> DataFrame:
    action = first_value(["action", "permitdeny", "permission", "effect", "decision"])
    context = _in_path(["acl", "acls", "accesslist", "access", "firewallrule", "rule", "rules"]) | F.exists("terms", lambda t: t.startswith("acl"))
    return recs.filter(context & action.isNotNull()).select(
        "file_id", "path", F.coalesce(first_value(["acl", "aclname", "name", "id", "list", "policy"]), F.lit("STRUCTURED_ACL")).alias("acl_name"),
        first_value(["seq", "sequence", "line", "order"]).alias("sequence"), F.lower(action).alias("action"), F.coalesce(first_value(["protocol", "proto", "service"]), F.lit("ip")).alias("protocol"),
        F.coalesce(first_value(["source", "src", "sourceip", "srcip", "from"]), F.lit("any")).alias("source"),
        F.coalesce(first_value(["destination", "dst", "dest", "destinationip", "dstip", "to"]), F.lit("any")).alias("destination"))


def routes(recs: DataFrame) -> DataFrame:
    dest, hop, mask = first_value(["destination", "dest", "network", "prefix", "cidr", "route", "target"]), first_value(["nexthop", "gateway", "via", "router"]), first_value(MASK_KEYS)
    context = _in_path(["route", "routes", "routing"]) | _has_key(["nexthop", "gateway"])
    return recs.filter(context & F.coalesce(dest, hop).isNotNull()).select(
        "file_id", "path", F.coalesce(dest, F.lit("default")).alias("destination"), F.when(dest.contains("/"), dest).otherwise(network_cidr(dest, mask)).alias("cidr"), hop.alias("next_hop"),
        first_value(["interface", "ifname", "outinterface"]).alias("interface"), F.coalesce(first_value(["protocol", "source", "type"]), F.lit("structured")).alias("protocol"))


def nat_rules(recs: DataFrame) -> DataFrame:
    inside, outside = first_value(["inside", "insidelocal", "source"]), first_value(["outside", "insideglobal", "translated", "destination"])
    context = _in_path(["nat"]) | F.exists("fields", lambda s: s["k"].contains("nat"))
    return recs.filter(context & F.coalesce(inside, outside).isNotNull()).select("file_id", "path", inside.alias("inside"), outside.alias("outside"))


def wireless_hints(recs: DataFrame) -> DataFrame:
    ssid = first_value(["ssid", "wlan", "wlanname", "wirelessname", "networkname"])
    context = _in_path(["wireless", "wlan", "ssid", "accesspoint", "ap", "radio"])
    value = F.coalesce(ssid, F.when(context, first_value(["name", "id", "label"])))
    # a list or object under such a key holds names, and is none itself
    return recs.filter(value.isNotNull() & ~value.rlike(r"^[\[{]")).select("file_id", "path", F.when(ssid.isNotNull(), "ssid").otherwise("wireless").alias("type"), value.alias("value"),
                                                 first_value(["security", "auth", "authentication", "encryption", "wpa"]).alias("security"), vlan_id(first_value(["vlan", "vlanid"])).alias("vlan"))


def endpoints(recs: DataFrame) -> DataFrame:
    """Records that carry an address or a MAC, for the endpoint, MAC and ARP tables."""
    ip, mac = first_value(IP_KEYS), F.lower(first_value(MAC_KEYS))
    is_mac = F.coalesce(mac.rlike(r"^[0-9a-f]{2}([:.-]?[0-9a-f]{2}){5}$"), F.lit(False))
    return recs.filter(looks_like_ip(ip) | is_mac).select(
        "file_id", "path", first_value(["hostname", "name", "host", "device", "client", "label"]).alias("device"), F.when(looks_like_ip(ip), ip).alias("ip_address"), mac.alias("mac"),
        vlan_id(first_value(["vlan", "vlanid", "vid"])).alias("vlan"), first_value(["port", "interface", "ifname"]).alias("interface"), is_mac.alias("has_mac"))


def inventory_facts(recs: DataFrame) -> DataFrame:
    model, serial = first_value(["model", "platform", "partnumber", "product", "type"]), first_value(["serial", "serialnumber", "sn"])
    version = first_value(["version", "ios", "softwareversion", "firmware", "image"])
    near = F.exists("terms", lambda t: t.contains("device") | t.contains("inventory") | t.contains("node") | t.contains("equipment"))
    return recs.filter(near & F.coalesce(model, serial, version).isNotNull()).select("file_id", "path", first_value(DEVICE_KEYS).alias("device"), model.alias("model"), serial.alias("serial"), version.alias("version"))


def access_tests(recs: DataFrame) -> DataFrame:
    """Lab result rows: who reached what, from where."""
    from .findings import lab_result

    client, target, service = first_value(["client", "username", "user", "host", "station", "endpoint"]), first_value(["target", "destination", "dst", "server", "resource", "targetip"]), first_value(
        ["service", "application", "app", "protocol", "portname"])
    result = first_value(["result", "status", "outcome", "state", "reachability"])
    ssid, ip, ap = first_value(["actualssid", "ssid", "wirelessssid", "networkname"]), first_value(["actualip", *IP_KEYS]), first_value(["apname", "ap", "accesspoint", "associatedap"])
    vlan, event = vlan_id(first_value(["actualvlan", "vlan", "vlanid", "vid"])), F.lower(F.coalesce(first_value(["event", "eventtype", "type", "kind"]), F.lit("")))
    check = event.isin("acl_check", "access_check", "connectivity_check", "reachability")
    matrix = client.isNotNull() & F.coalesce(target, service, result).isNotNull() & F.coalesce(ssid, vlan, ip, ap).isNotNull()
    return recs.filter((matrix | check | (event == "roaming")) & (event.contains("roaming") | result.isNotNull() | check)).select(
        "file_id", "path", client.alias("client"), target.alias("target"), service.alias("service"), F.when(event.contains("roaming"), "roaming").otherwise(lab_result(result)).alias("result"),
        first_value(["expected", "expectedresult", "policyexpected"]).alias("expected_result"), ssid.alias("actual_ssid"), vlan.alias("actual_vlan"),
        F.when(looks_like_ip(ip), ip).alias("actual_ip"), ap.alias("ap_name"), F.when(event == "", "access_test").otherwise(event).alias("event"))


# columns of a tagged row, beside file_id, path and table
LAB_COLUMNS = ["kind", "name", "device", "ip_address", "ssid", "vlan", "ap_name", "target", "status", "detail"]


def lab_rows(recs: DataFrame) -> DataFrame:
    """What lab results say about devices, endpoints, addresses, wireless networks, VLANs, services, roaming and controls.

    One pass: a record becomes an array of rows, each tagged with its table and the key that is kept once per file (first
    path). `sources.sinks.write_tagged` writes them all at once, a folder for each table.
    """
    from .findings import lab_result

    client, target, service = first_value(["client", "username", "user", "host", "station", "endpoint"]), first_value(["target", "destination", "dst", "server", "resource", "targetip"]), first_value(
        ["service", "application", "app", "protocol", "portname"])
    result = first_value(["result", "status", "outcome", "state", "reachability"])
    ssid, address, ap = first_value(["actualssid", "ssid", "wirelessssid", "networkname"]), first_value(["actualip", *IP_KEYS]), first_value(["apname", "ap", "accesspoint", "associatedap"])
    vlan, event = vlan_id(first_value(["actualvlan", "vlan", "vlanid", "vid"])), F.lower(F.coalesce(first_value(["event", "eventtype", "type", "kind"]), F.lit("")))
    ip = F.when(looks_like_ip(address), address)
    near = F.exists("terms", lambda t: t.contains("matrix") | t.contains("result"))
    matrix = client.isNotNull() & F.coalesce(target, service, result).isNotNull() & (F.coalesce(ssid, vlan, address, ap).isNotNull() | near)
    check = event.isin("acl_check", "access_check", "connectivity_check", "reachability")
    roaming = event.contains("roaming")
    facts = recs.filter(matrix | check | (event == "roaming")).select(
        "file_id", "path", client.alias("client"), target.alias("target"), service.alias("service"), result.alias("result"), ssid.alias("ssid"), vlan.alias("vlan"), ip.alias("ip"), ap.alias("ap"),
        roaming.alias("roaming"), check.alias("check"), F.coalesce(first_value(["details", "detail", "message", "notes", "description"]), F.lit("")).alias("details"))
    c = F.col
    none = F.lit(None).cast("string")

    def row(table: str, when: Column, keys: list[str], **values: Column | str) -> Column:
        cols = {n: (F.lit(v) if isinstance(v, str) else v) for n, v in values.items()}
        key = F.to_json(F.struct(*[F.coalesce(cols.get(k, none), F.lit("")).alias(k) for k in keys]))
        return F.when(when, F.struct(F.lit(table).alias("table"), key.alias("key"), *[cols.get(n, none).alias(n) for n in LAB_COLUMNS]))

    passed = lab_result(c("result")) == "success"
    asked = c("service").isNotNull() | c("target").isNotNull()
    judged = (c("result").isNotNull() | c("check")) & ~c("roaming")
    goal = F.coalesce("service", "target")
    rows = F.array(
        row("devices", c("client").isNotNull(), ["name"], kind="endpoint", name=c("client")),
        row("devices", c("ap").isNotNull(), ["name"], kind="access_point", name=c("ap")),
        row("devices", looks_like_ip(c("target")) & ~c("roaming"), ["name"], kind="service", name=c("target"), ip_address=c("target"), detail=goal),
        row("endpoint_inventory", c("client").isNotNull(), ["name", "ip_address", "ssid", "vlan"], name=c("client"), ip_address=c("ip"), ssid=c("ssid"), vlan=c("vlan"), ap_name=c("ap")),
        row("ip_inventory", c("ip").isNotNull(), ["device", "name"], name=c("ip"), device=c("client"), ip_address=c("ip"), ssid=c("ssid"), vlan=c("vlan"), ap_name=c("ap"), status="observed"),
        row("wireless_hints", c("ap").isNotNull(), ["kind", "name", "ssid"], kind="access_point", name=c("ap"), ssid=c("ssid"), vlan=c("vlan")),
        row("wireless_hints", c("ssid").isNotNull(), ["kind", "name", "vlan"], kind="ssid", name=c("ssid"), vlan=c("vlan"), ap_name=c("ap")),
        row("vlans", c("vlan").isNotNull(), ["name"], name=c("vlan"), detail=F.coalesce("ssid", F.concat(F.lit("VLAN_"), "vlan"))),
        row("service_inventory", asked & ~c("roaming"), ["name", "target"], name=goal, target=c("target")),
        row("roaming_events", c("roaming"), ["name", "ap_name", "detail"], name=c("client"), ap_name=F.coalesce("ap", "target"), target=c("target"), detail=c("details")),
        row("policy_controls", judged, ["name", "detail"], name=F.concat(F.coalesce("client", F.lit("client")), F.lit(" to "), F.coalesce(goal, F.lit("target"))),
            kind=F.when(passed, "Info").otherwise("Medium"), status=F.when(passed, "pass").otherwise("review"), ssid=c("ssid"), vlan=c("vlan"), target=c("target"),
            detail=F.concat(F.when(passed, "reached").otherwise("did not reach"), F.lit(" "), F.coalesce("target", F.lit("an unknown target")))))
    tagged = facts.select("file_id", "path", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("file_id", "path", "r.*")
    first = tagged.groupBy("file_id", "table", "key").agg(F.min_by(F.struct("path", *LAB_COLUMNS), "path").alias("v"))
    return first.select("file_id", "table", "v.*")


def generic_entities(recs: DataFrame) -> DataFrame:
    """One entity per record with a name, typed by its keys and values."""
    name = first_value(["name", "hostname", "device", "devicename", "id", "interface", "ssid", "vlan", "ip"])
    blob = F.lower(F.array_join(F.transform("fields", lambda s: s["v"]), " "))
    has = lambda *k: _has_key(list(k))
    kind = (
        F.when(has("ssid", "security") | blob.contains("ssid"), "wireless_network").when(has("vlan", "vlanid") | blob.rlike(r"\bvlan\s*\d+"), "vlan")
        .when(has("interface", "ifname", "port"), "interface").when(has("route", "nexthop", "gateway"), "route").when(has("mac") | blob.rlike(fv.ENTITY_MAC), "mac_address")
        .when(has("ip", "ipaddress") | blob.rlike(fv.ENTITY_IP), "ip_address").when(has("password", "secret", "token", "apikey") | blob.rlike(fv.SECRET_PATTERN), "credential")
        .when(contains_any(blob, ["firewall", "acl", "access-list"]), "firewall_rule")
        .when(has("hostname", "device", "devicetype") | contains_any(blob, ["router", "switch"]), "device").otherwise("evidence"))
    conf = first_value(["confidence", "score"]).try_cast("double")
    scaled = F.coalesce(F.when(conf > 1, conf / 100).otherwise(conf), F.lit(0.74))
    return recs.filter(name.isNotNull()).select("file_id", "path", name.alias("name"), kind.alias("type"), F.greatest(F.lit(0.05), F.least(F.lit(0.99), scaled)).alias("confidence"))


def canonical_rows(docs: DataFrame, table: str, markers: list[str]) -> DataFrame:
    """Rows of an export that is normalised already, kept when a marker field is present."""
    rows = F.coalesce(F.try_variant_get("v", f"$.objects.{table}", "array<variant>"), F.try_variant_get("v", f"$.{table}", "array<variant>"))
    mark = F.coalesce(*[F.nullif(F.try_variant_get("row", f"$.{m}", "string"), F.lit("")) for m in markers])
    return docs.select("file_id", F.posexplode(rows).alias("position", "row")).filter(mark.isNotNull())
