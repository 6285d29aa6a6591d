"""Connector inputs as column mappings: one select list per source kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_nonempty, message_event_type, message_severity

# fixed values: supported kinds, list keys of wrapped exports, client markers of vendor rows
CONNECTORS = ["generic_ap_inventory", "generic_wlc_clients", "radius_accounting", "dhcp_leases", "syslog_events", "meraki_api", "unifi_controller", "aruba_central", "cisco_wlc"]
VENDOR_KINDS = ["meraki_api", "unifi_controller", "aruba_central", "cisco_wlc"]
LIST_KEYS = ["records", "events", "aps", "clients", "leases", "devices", "access_points", "data"]
CLIENT_MARKERS = ["clientMac", "username", "ipAddress", "recentDeviceName", "calling_station_id"]


def json_records(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """JSON lists, or objects that hold a list under a known key, to one variant row per record."""
    v = F.try_parse_json(F.col(text_col))
    inner = F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), *[F.try_variant_get("_v", f"$.{k}", "array<variant>") for k in LIST_KEYS], F.array(F.col("_v")))
    return texts.withColumn("_v", v).filter("_v is not null").withColumn("record", F.explode(inner)).drop("_v")


def field(*names: str, default: str = "") -> Column:
    """First non-empty of the named fields of `record` (a variant), or of plain columns by map."""
    return F.coalesce(first_nonempty(*[F.try_variant_get("record", f"$.{n}", "string") for n in names]), F.lit(default))


def map_field(*names: str, default: str = "") -> Column:
    """The same over a `fields` map, as CSV rows become."""
    return F.coalesce(first_nonempty(*[F.try_element_at("fields", F.lit(n)) for n in names]), F.lit(default))


def _ap(get, vendor: str) -> dict[str, Column]:
    return {
        "name": get("name", "apName", "hostname", "mac", "serial", "id", default=f"{vendor.upper()}-AP"), "location": get("address", "location", "site"),
        "switch": get("switch", "switchName", "uplinkSwitch"), "uplink_interface": get("uplink", "port", "uplink_interface"),
        "supported_vlans": F.regexp_replace(get("supported_vlans", "vlans", "vlan", "nativeVlanId"), r'[\[\]"\s]', ""), "max_clients": F.coalesce(get("max_clients", "clientLimit").try_cast("int"), F.lit(30)),
        "status": F.lower(get("status", "state", default="online")), "vendor": F.lit(vendor), "serial": get("serial"), "model": get("model"),
    }


def _client(get, vendor: str) -> dict[str, Column]:
    return {
        "event_type": get("event_type", default="association"), "client": get("description", "hostname", "username", "client", "mac", "clientMac"),
        "mac": get("mac", "clientMac", "calling_station_id"), "ssid": get("ssid", "network", "wirelessNetwork"), "to_ap": get("ap", "apName", "recentDeviceName", "nas_identifier"),
        "vlan": get("vlan", "vlanId", "networkVlan"), "ip": get("ip", "ipAddress", "framed_ip_address", "address"), "detail": F.lit(f"{vendor} client/session import"),
    }


def _radius(get) -> dict[str, Column]:
    event = first_nonempty(get("event_type"), F.when(F.lower(get("acct_status_type")) == "stop", "disassociation").otherwise("association"))
    who = get("username", "calling_station_id")
    return {
        "event_type": event, "client": get("username", "client", "calling_station_id"), "mac": F.lit(""), "ssid": get("ssid"), "to_ap": get("nas_identifier", "ap"), "vlan": get("vlan"),
        "ip": get("framed_ip_address", "ip"), "detail": first_nonempty(get("detail"), F.concat(F.lit("RADIUS "), event, F.lit(" for "), who)),
    }


def _dhcp(get) -> dict[str, Column]:
    return {
        "event_type": F.lit("dhcp_assignment"), "client": get("client", "hostname", "mac"), "mac": get("mac"), "ssid": get("ssid"), "to_ap": F.lit(""), "vlan": get("vlan"),
        "ip": get("ip", "address"), "detail": get("detail", default="DHCP lease assignment imported"),
    }


def _syslog(get) -> dict[str, Column]:
    message = get("message", "detail", "msg", default="syslog wireless event")
    return {
        "event_type": first_nonempty(get("event_type"), message_event_type(message)), "client": get("client", "username", "mac", default="unknown_syslog_client"), "mac": F.lit(""),
        "ssid": get("ssid"), "to_ap": get("ap"), "vlan": F.lit(""), "ip": F.lit(""), "detail": message, "severity": message_severity(message),
    }


def connector_events(records: DataFrame, kind: str, get=field) -> DataFrame:
    """Client events of a connector; for vendor kinds only the rows that look like clients."""
    if kind not in CONNECTORS:
        raise ValueError(f"unsupported connector {kind}")
    df = records
    if kind in VENDOR_KINDS:
        df = df.filter(get(*CLIENT_MARKERS) != "")
    cols = {"radius_accounting": _radius, "dhcp_leases": _dhcp, "syslog_events": _syslog}.get(kind, lambda g: _client(g, "generic_wlc" if kind == "generic_wlc_clients" else kind))(get)
    return df.select(*[c.alias(n) for n, c in cols.items()])


def connector_aps(records: DataFrame, kind: str, get=field) -> DataFrame:
    """Access points of a connector; for vendor kinds the rows that do not look like clients."""
    if kind == "generic_ap_inventory":
        cols = _ap(get, "manual") | {"name": get("ap", "name", "id"), "max_clients": F.coalesce(get("max_clients").try_cast("int"), F.lit(25))}
        return records.select(*[c.alias(n) for n, c in cols.items()])
    if kind not in VENDOR_KINDS:
        raise ValueError(f"connector {kind} holds no access points")
    return records.filter(get(*CLIENT_MARKERS) == "").select(*[c.alias(n) for n, c in _ap(get, kind).items()])
