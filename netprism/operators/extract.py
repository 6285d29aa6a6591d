"""Numbered lines to typed network tables.

`annotate` adds every carried state with one shuffle of the lines that set or use it. Each table is
then a filter and a projection of these rows, or one keyed aggregation with
map-side combine. Nothing runs as a Python function per row.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.net import network_cidr, probable_ip
from ..functions.text import (
    ci, contains_any, expand_vlans, joined_groups, joined_nonempty, match_bits, matches, may_match, normalize_interface,
    redact_command, redact_secret, rx, rx_any, stable_id, words_found,
)
from ..session import written, written_by
from .carry import CHUNK_LINES, carry_forward, first_wins, last_wins, short_files

def T() -> Column:
    return F.col("text")


def STRIPPED() -> Column:
    return F.btrim("text", F.lit(" \t\r\n\f\x0b"))



def evidence(line: Column, text: Column, confidence) -> Column:
    conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.struct(
        line.cast("long").alias("source_line"), F.lit(None).cast("string").alias("source_path"),
        text.alias("source_text"), conf.cast("double").alias("confidence"),
    )


EV = lambda confidence: evidence(F.col("line_no"), T(), confidence).alias("evidence")


def _block_mark(kind: str) -> Column:
    mine = matches(T(), fv.BLOCK_HEADERS[kind])
    return F.when(mine, F.struct(F.lit(True).alias("open"), F.col("line_no").alias("line"), T().alias("text"))).when(
        matches(T(), fv.BLOCK_CLOSER), F.struct(F.lit(False).alias("open"), F.col("line_no").alias("line"), F.lit(None).cast("string").alias("text"))
    )


def state_marks() -> dict[str, Column]:
    """What each line changes in the state that later lines depend on."""
    low = F.lower(T())
    at = lambda test, *cols: F.when(test, F.struct(F.col("line_no").alias("line"), T().alias("text"), *cols))
    marks = {f"blk_{kind}": _block_mark(kind) for kind in fv.BLOCK_HEADERS}
    marks.update(
        cdp=at(matches(T(), fv.CDP_DEVICE)),
        lldp=at(matches(T(), fv.LLDP_DEVICE) & ~T().contains("Device ID:")),
        trunk_section=F.when(low.contains("vlans allowed on trunk"), "allowed")
        .when(low.contains("vlans allowed and active"), "active")
        .when(low.contains("vlans in spanning tree forwarding"), "forwarding"),
        trunk_seen=F.when(_trunk_row(), F.lit(True)),
        inventory_name=at(matches(T(), fv.INVENTORY_NAME)),
        vlan_header=F.when(matches(T(), fv.VLAN_BRIEF_HEADER), F.lit(True)),
        acl_active=F.coalesce(rx(T(), fv.ACL_SHOW_HEADER, 2), rx(T(), fv.ACL_CONFIG_HEADER, 2)),
        counter=at(_counter_header()),
        stp=at(matches(T(), fv.STP_VLAN)),
        stp_section=F.when(matches(T(), fv.STP_SECTION), F.regexp_extract(T(), r"\d+", 0)),
        command_start=at(_command_start()),
        context=rx(STRIPPED(), fv.COMMAND_CONTEXT, 1),
        line_context=F.when(matches(STRIPPED(), r"^line\s+(vty|console|aux)\b"), STRIPPED()),
        secure_port=at(matches(T(), fv.PORT_SECURITY_PORT)),
        secure_state=F.when(matches(T(), fv.PORT_SECURITY_STATE), F.lit(True)),
    )
    return marks


def annotate(lines: DataFrame, states: list[str] | None = None, chunk: int | Column = CHUNK_LINES, uses: Column | None = None) -> DataFrame:
    """Lines with carried states; `states` limits the work to what a table needs, `uses` the lines to those it reads."""
    marks = state_marks()
    if states is not None:
        marks = {n: marks[n] for n in states}
    return carry_forward(lines, marks, chunk=chunk, uses=uses)


def block_lines(lines: DataFrame, *kinds: str, chunk: int | Column = CHUNK_LINES) -> DataFrame:
    """Headers and attribute lines of configuration blocks with their state; all other lines go before they are dealt out.

    Enough for `interfaces`, `vlans`, `dhcp_scopes` and `acl_rules`, which take the plain lines for the rest.
    """
    patterns = [p for kind in kinds for p in BLOCK_ATTRIBUTES[kind]]
    return annotate(only(lines, *kinds), [f"blk_{kind}" for kind in kinds], chunk, T().rlike(_any_of(patterns)))


def block_source(lines: DataFrame, *kinds: str) -> DataFrame:
    """The lines that blocks of these kinds and their tables read, written once: every table then reads the few instead of all."""
    return needed_lines(lines, *kinds)


AUTOMATON_FROM = 6
#: Column of `needed_lines` with a bit for each name that a line may be read for.
TAGS = "_tags"


def needed_lines(lines: DataFrame, *names: str, once: bool = True) -> DataFrame:
    """The lines that the named blocks, states and tables read, found in one pass; written, unless a single branch reads them.

    A superset: what reads them tries its own patterns. States and blocks stay as over all lines, as every line that sets one is kept.
    """
    patterns = list(dict.fromkeys(p for name in names for p in _reads(name)))
    lines = lines.select("file_id", "line_no", "text")
    # few patterns are sooner tried than a batch is sent to the automaton; exploded, as later patterns would be tried before it
    if len(patterns) <= AUTOMATON_FROM:
        few = lines.filter(T().rlike(_any_of(patterns)))
    elif len(names) == 1:
        few = _held(lines, ["file_id", "line_no"], [F.when(may_match(T(), patterns), T())], "text")
    else:
        tags = match_bits(T(), [_reads(name) for name in names])
        few = lines.select("*", F.explode(F.array(tags)).alias("_t")).filter("_t <> 0").select(
            "file_id", "line_no", "text", F.col("_t").alias(TAGS, metadata={"names": list(names)}))
    if not once:
        return few
    # short files lie in one task each already: kept together, their tables need no shuffle
    return written_by(few, "file_id") if short_files(lines) else written(few)


def only(lines: DataFrame, *names: str) -> DataFrame:
    """The lines that these blocks, states and tables read, where `needed_lines` has said which line is whose; else all lines as they are."""
    if TAGS not in lines.columns:
        return lines
    known = lines.schema[TAGS].metadata["names"]
    if not set(names) <= set(known):
        return lines.drop(TAGS)
    return lines.filter(F.col(TAGS).bitwiseAND(F.lit(sum(1 << known.index(n) for n in set(names))).cast("long")) != 0).drop(TAGS)


def _reads(name: str) -> list[str]:
    """Patterns of the lines that set or meet a state, or make rows of a table."""
    trimmed = lambda rows: [r"^\s*(?:" + r[1].removeprefix("^").replace(r"^\s*", "") + ")" for r in rows]
    header = lambda kind: [fv.BLOCK_CLOSER, fv.BLOCK_HEADERS[kind]]
    if name in BLOCK_ATTRIBUTES:
        return [*header(name), *BLOCK_ATTRIBUTES[name], *PLAIN_ROWS.get(name, [])]
    return {
        "devices": lambda: [r"^\s*hostname\s+(\S+)", fv.CDP_DEVICE],
        "static_routes": lambda: [r"^\s*ip route\s+(\S+)\s+(\S+)\s+(\S+)"],
        "networks": lambda: [r"^ network (\S+) (\S+) area"],
        "ip_inventory": lambda: [fv.IP_BRIEF_ROW],
        "interface_status": lambda: [fv.STATUS_ROW, fv.IP_BRIEF_ROW],
        "hardening": lambda: [r[1] for r in fv.HARDENING_PATTERNS],
        "cdp": lambda: [fv.CDP_DEVICE, fv.CDP_PORTS, fv.CDP_PLATFORM, fv.CDP_TABLE_ROW],
        "lldp": lambda: [fv.LLDP_DEVICE, fv.LLDP_LOCAL, fv.LLDP_REMOTE, fv.LLDP_PLATFORM, fv.LLDP_TABLE_ROW],
        "trunk_section": lambda: ["vlans (?:allowed on trunk|allowed and active|in spanning tree forwarding)", fv.TRUNK_ROW, fv.TRUNK_VLAN_ROW],
        "trunk_seen": lambda: [fv.TRUNK_ROW, fv.TRUNK_VLAN_ROW],
        "inventory_name": lambda: [fv.INVENTORY_NAME, fv.INVENTORY_PID, fv.CHASSIS_ROW],
        "vlan_header": lambda: [fv.VLAN_BRIEF_HEADER, fv.VLAN_BRIEF_ROW],
        "acl_active": lambda: [fv.ACL_SHOW_HEADER, fv.ACL_CONFIG_HEADER, fv.ACL_MATCHES],
        "counter": lambda: [fv.COUNTER_HEADER, fv.COUNTER_INPUT, fv.COUNTER_OUTPUT, fv.COUNTER_DROPS],
        "stp": lambda: [fv.STP_VLAN, fv.STP_PRIORITY, fv.STP_ADDRESS, fv.STP_COST],
        "stp_section": lambda: [fv.STP_SECTION, fv.STP_ROW],
        "secure_port": lambda: [fv.PORT_SECURITY_PORT, fv.PORT_SECURITY_STATE, fv.PORT_SECURITY_MAX, fv.PORT_SECURITY_MODE, fv.PORT_SECURITY_COUNT, fv.PORT_SECURITY_LAST],
        "secure_state": lambda: [fv.PORT_SECURITY_STATE],
        "blk_vty": lambda: [*header("vty"), "transport|telnet|login"],
        "line_context": lambda: [r"^\s*line\s+(vty|console|aux)", *trimmed(fv.MANAGEMENT_PATTERNS)],
        "blk_interface": lambda: header("interface"),
        "features": lambda: trimmed(fv.FEATURE_PATTERNS),
        "redundancy": lambda: trimmed([("", FHRP_ROW), ("", GLBP_ROW)]),
        "credential": lambda: [fv.SECRET_PATTERN.removeprefix("(?i)")],
        "access_ports": lambda: [*header("interface"), *ACCESS_PORT_LINES],
        "counted": lambda: [r"^hostname ", r"^vlan ", r"^access-list "],
    }[name]()


def _uses(state: str) -> Column | None:
    """Lines that meet a state, as far as its table reads them; None where it reads every line."""
    one = lambda *patterns: T().rlike(_any_of(list(patterns)))
    stripped = lambda rows: STRIPPED().rlike(_any_of([r[1] for r in rows]))
    return {
        "cdp": lambda: one(fv.CDP_PORTS, fv.CDP_PLATFORM),
        "lldp": lambda: one(fv.LLDP_LOCAL, fv.LLDP_REMOTE, fv.LLDP_PLATFORM),
        "trunk_section": lambda: one(fv.TRUNK_ROW, fv.TRUNK_VLAN_ROW),
        "trunk_seen": lambda: one(fv.TRUNK_ROW, fv.TRUNK_VLAN_ROW),
        "inventory_name": lambda: one(fv.INVENTORY_PID),
        "vlan_header": lambda: one(fv.VLAN_BRIEF_ROW),
        "acl_active": lambda: one(fv.ACL_MATCHES),
        "counter": lambda: one(fv.COUNTER_INPUT, fv.COUNTER_OUTPUT, fv.COUNTER_DROPS),
        "stp": lambda: one(fv.STP_PRIORITY, fv.STP_ADDRESS, fv.STP_COST),
        "stp_section": lambda: one(fv.STP_ROW),
        "secure_port": lambda: one(fv.PORT_SECURITY_STATE, fv.PORT_SECURITY_MAX, fv.PORT_SECURITY_MODE, fv.PORT_SECURITY_COUNT, fv.PORT_SECURITY_LAST),
        "secure_state": lambda: one(fv.PORT_SECURITY_STATE),
        "blk_vty": lambda: F.lower(T()).rlike("transport|telnet|login"),
        "line_context": lambda: stripped(fv.MANAGEMENT_PATTERNS),
        "features": lambda: stripped(fv.FEATURE_PATTERNS),
        "redundancy": lambda: STRIPPED().rlike(_any_of([FHRP_ROW, GLBP_ROW])),
        "access_ports": lambda: one(*ACCESS_PORT_LINES),
        "context": lambda: T().rlike(r"^\s+[A-Za-z0-9_-]") | stripped([(n, p) for n, p in fv.COMMAND_CATEGORIES]),
        "blk_router": lambda: ~STRIPPED().isin("", "!"),
    }[state]() if state not in ("blk_interface", "command_start") else None


def state_lines(lines: DataFrame, *states: str, uses: str | None = None, chunk: int | Column = CHUNK_LINES) -> DataFrame:
    """Lines that set or meet the states, with them; all other lines go before they are dealt out.

    For the table that reads these states only. `uses` names what the table reads where it isn't the state's own.
    """
    lines = only(lines, *states, *([uses] if uses else []))
    meets = None
    for name in [uses] if uses else states:
        own = _uses(name)
        meets = own if meets is None else meets | own
    return annotate(lines, list(states), chunk, meets)


# --- shared row tests -------------------------------------------------------
def _trunk_heading() -> Column:
    low = F.lower(T())
    return low.contains("vlans allowed on trunk") | low.contains("vlans allowed and active") | low.contains(
        "vlans in spanning tree forwarding")


def _trunk_row() -> Column:
    return ~_trunk_heading() & matches(T(), fv.TRUNK_ROW) & matches(rx(T(), fv.TRUNK_ROW), fv.PORT_PREFIX)


def _counter_header() -> Column:
    return matches(T(), fv.COUNTER_HEADER) & matches(rx(T(), fv.COUNTER_HEADER), fv.COUNTER_PORT_PREFIX)


def _command_start() -> Column:
    return matches(STRIPPED(), fv.MEMBER_ROW) | matches(T(), fv.PROMPT_ROW)


def _any_of(patterns: list[str]) -> str:
    """One alternation, to drop most lines before the patterns are tried one by one.

    Patterns that stand at the start share one `^`: Java would try each of them at every place of the line otherwise.
    """
    first, anywhere = [], []
    for p in patterns:
        held = p.startswith("^") and not _open_choice(p)
        (first if held else anywhere).append(p[1:] if held else p)
    if not anywhere:
        return "(?i)^(?:" + "|".join(first) + ")"
    return "(?i)(?:" + "|".join(([f"^(?:{'|'.join(first)})"] if first else []) + anywhere) + ")"


def _open_choice(pattern: str) -> bool:
    """Whether a `|` stands outside groups and classes, so that a leading `^` isn't everyone's."""
    plain = re.sub(r"\\.", "", pattern)
    plain = re.sub(r"\[\^?\]?[^\]]*\]", "", plain)
    while (shorter := re.sub(r"\([^()]*\)", "", plain)) != plain:
        plain = shorter
    return "|" in plain


def _relevant(state: Column, patterns: list[str]) -> Column:
    """The line that opened a state, and the later lines that add to it."""
    return (F.col("line_no") == state["line"]) | T().rlike(_any_of(patterns))


def _pattern_rows(df: DataFrame, rows: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """One output row per matching pattern of a line, in one pass over the lines."""
    hits = [F.when(test, F.struct(*[c.alias(n) for n, c in cols.items()])) for test, cols in rows]
    return _held(df, ["file_id", "line_no", "text"], hits, "hit").select("file_id", "line_no", "text", "hit.*")


# --- configuration tables ---------------------------------------------------
def devices(lines: DataFrame) -> DataFrame:
    name = rx(T(), r"^\s*hostname\s+(\S+)")
    lines = only(lines, "devices")
    hosts = lines.filter(name.isNotNull()).select(
        "file_id", name.alias("id"), name.alias("hostname"),
        F.when(matches(name, r"(^R\d+|router)"), "router").when(matches(name, r"(^SW\d+|switch)"), "switch")
        .otherwise("device").alias("type"),
        F.lit("network_device").alias("role"), EV(0.98),
    )
    peer = F.nullif(F.trim(rx(T(), fv.CDP_DEVICE)), F.lit(""))
    peers = (
        lines.filter(peer.isNotNull()).groupBy("file_id", peer.alias("id"))
        .agg(F.min_by(evidence(F.col("line_no"), T(), 0.82), "line_no").alias("evidence"))
        .join(hosts.select("file_id", "id").distinct(), ["file_id", "id"], "left_anti")
        .select("file_id", "id", F.col("id").alias("hostname"), F.lit("neighbor").alias("type"),
                F.lit("cdp_neighbor").alias("role"), "evidence")
    )
    return hosts.unionByName(peers)


def vlans(a: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Config block, then table row, then subinterface hint; the best source wins per VLAN."""
    plain = a if lines is None else only(lines, "vlan")
    blk = F.col("blk_vlan")
    vid = rx(blk["text"], r"^\s*vlan\s+(\d+)")
    label = F.trim(rx(T(), r"^\s*name\s+(.+)"))
    blocks = (
        a.filter(blk["open"] & _relevant(blk, [r"^\s*name\s+(.+)"])).groupBy("file_id", vid.alias("id"), blk["line"].alias("_hdr"))
        .agg(last_wins(label).alias("_name"), F.max(F.when(label.isNotNull(), F.col("line_no"))).alias("_name_line"))
        .groupBy("file_id", "id")
        .agg(F.max_by(F.struct("_hdr", "_name", "_name_line"), "_hdr").alias("b"))
        .select(
            "file_id", "id", F.coalesce("b._name", F.concat(F.lit("VLAN_"), "id")).alias("name"),
            F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("ports_hint"),
            F.lit("running-config vlan block").alias("source"),
            F.coalesce("b._name_line", "b._hdr").alias("_line"), F.lit(0.96).alias("_conf"), F.lit(0).alias("_prio"),
        )
    )
    row_id = rx(T(), fv.VLAN_ROW, 1)
    table = plain.filter(row_id.try_cast("int") <= 4094).select(
        "file_id", row_id.alias("id"), rx(T(), fv.VLAN_ROW, 2).alias("name"), rx(T(), fv.VLAN_ROW, 3).alias("status"),
        F.trim(rx_any(T(), fv.VLAN_ROW, 4)).alias("ports_hint"), F.lit("show vlan brief").alias("source"),
        F.col("line_no").alias("_line"), F.lit(0.88).alias("_conf"), F.lit(1).alias("_prio"),
    )
    tag = rx(T(), r"encapsulation\s+dot1q\s+(\d+)")
    hints = plain.filter(tag.isNotNull()).select(
        "file_id", tag.alias("id"), F.concat(F.lit("VLAN_"), tag).alias("name"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("ports_hint"),
        F.lit("dot1q subinterface hint").alias("source"),
        F.col("line_no").alias("_line"), F.lit(0.78).alias("_conf"), F.lit(2).alias("_prio"),
    )
    best = blocks.unionByName(table).unionByName(hints).groupBy("file_id", "id").agg(
        F.min_by(F.struct("name", "status", "ports_hint", "source", "_line", "_conf"), F.struct("_prio", "_line")).alias("v"))
    return best.select(
        "file_id", "id", "v.name", "v.status", "v.ports_hint", "v.source",
        evidence(F.col("v._line"), F.concat(F.lit("vlan "), F.col("id"), F.lit(" name "), F.col("v.name")), F.col("v._conf")).alias("evidence"),
    )


def interface_line_map(a: DataFrame) -> DataFrame:
    """Every body line with the interface block it belongs to."""
    blk = F.col("blk_interface")
    return a.filter(blk["open"] & (F.col("line_no") > blk["line"])).select(
        "file_id", blk["line"].alias("header_line"), rx(blk["text"], r"^\s*interface\s+(\S+)").alias("interface"),
        "line_no", "text",
    )


# fixed values: interface attribute, line pattern, value taken from the line (group numbers; none = flag)
INTERFACE_ATTRIBUTES = [
    ("description", r"^\s*description\s+(.+)", "$1"),
    ("ip", r"^\s*ip address\s+(\S+)\s+(\S+)", "$1 $2"),
    ("mode", r"^\s*switchport mode\s+(\S+)", "$1"),
    ("access_vlan", r"^\s*switchport access vlan\s+(\d+)", "$1"),
    ("trunk", r"^\s*switchport trunk allowed vlan\s+(.+)", "$1"),
    ("native_vlan", r"^\s*switchport trunk native vlan\s+(\d+)", "$1"),
    ("dot1q_vlan", r"^\s*encapsulation\s+dot1q\s+(\d+)", "$1"),
    ("acl_in", r"^\s*ip access-group\s+(\S+)\s+in", "$1"),
    ("acl_out", r"^\s*ip access-group\s+(\S+)\s+out", "$1"),
    ("nat_role", r"^\s*ip nat\s+(inside|outside)", "$1"),
    ("secure", r"^\s*switchport\s+port-security\s*$", None),
    ("secure_max", r"^\s*switchport\s+port-security\s+maximum\s+(\d+)", "$1"),
    ("secure_mode", r"^\s*switchport\s+port-security\s+violation\s+(\S+)", "$1"),
    ("sticky", r"^\s*switchport\s+port-security\s+mac-address\s+sticky", None),
    ("shutdown", r"^\s*shutdown\s*$", None),
]
# lines that say whether a port is an access port, of which VLAN, and shut down: a port without an access VLAN has this mode from its mode line alone
ACCESS_PORT_LINES = [p for n, p, _ in INTERFACE_ATTRIBUTES if n in ("mode", "access_vlan", "shutdown")]
# rows outside blocks that go into the table of a kind
PLAIN_ROWS = {
    "interface": [fv.TRUNK_ROW, r"^\s*interface\s+(\S+)"],
    "vlan": [fv.VLAN_ROW, r"encapsulation\s+dot1q\s+(\d+)"],
    "acl": [r"^\s*access-list\s+(\S+)\s+(permit|deny)\s+(.+)"],
}
FHRP_ROW = r"^(standby|vrrp)\s+(\d+)\s+(ip|priority|preempt|track)\s*(.*)"
GLBP_ROW = r"^(glbp)\s+(\d+)\s+(ip|priority|preempt|weighting)\s*(.*)"
# lines that blocks of a kind read
BLOCK_ATTRIBUTES = {
    "interface": [p for _, p, _ in INTERFACE_ATTRIBUTES],
    "vlan": [r"^\s*name\s+(.+)"],
    "dhcp": [r"^\s*network\s+(\S+)\s+(\S+)", r"^\s*default-router\s+(.+)", r"^\s*dns-server\s+(.+)", r"^\s*domain-name\s+(.+)"],
    "acl": [r"^\s*(?:(\d+)\s+)?(permit|deny)\s+(.+)"],
}


def interfaces(a: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """One row per interface block; the last line of each attribute wins.

    `lines` are the plain lines, for the part that needs no state (also in the
    other tables that take them); without them the annotated lines serve.

    Each line is reduced to one attribute and value before the aggregation, so
    its patterns run once and not once per output column.
    """
    blk = F.col("blk_interface")

    def value(pattern: str, form: str | None) -> Column:
        if form is None:
            return F.lit("true")
        return F.concat_ws(" ", *[F.regexp_extract(T(), ci(pattern), int(g[1:])) for g in form.split()])

    attribute = F.coalesce(*[
        F.when(matches(T(), p), F.struct(F.lit(n).alias("k"), value(p, form).alias("v"))) for n, p, form in INTERFACE_ATTRIBUTES])
    own = F.when(F.col("line_no") == blk["line"], F.struct(F.lit("header").alias("k"), T().alias("v")))
    body = _held(a.filter(blk["open"]), ["file_id", "line_no", blk["line"].alias("_line")], [F.coalesce(own, attribute)], "kv")
    # one aggregate over (block, attribute), then the few attributes of a block side by side
    last = body.groupBy("file_id", "_line", F.col("kv.k").alias("k")).agg(F.max(F.struct("line_no", "kv.v")).alias("m"))
    held = last.groupBy("file_id", "_line").agg(F.map_from_entries(F.collect_list(F.struct("k", "m.v"))).alias("held"))
    grouped = held.select("file_id", "_line", *[F.col("held")[n].alias(f"_{n}") for n in ["header"] + [r[0] for r in INTERFACE_ATTRIBUTES]]).withColumns({
        "_ip_address": F.split("_ip", " ").getItem(0), "_ip_mask": F.split("_ip", " ").getItem(1),
        "access_vlan": F.col("_access_vlan"), "native_vlan": F.col("_native_vlan"), "dot1q_vlan": F.col("_dot1q_vlan"),
    })
    name = rx(F.col("_header"), r"^\s*interface\s+(\S+)")
    vlans_ = F.coalesce(expand_vlans(F.col("_trunk")), F.array().cast("array<string>"))
    flag = lambda n: F.col(n).isNotNull()
    blocks = grouped.filter(
        ~F.lower(name).isin("ip-address", "name") & ~matches(F.col("_header"), r"OK\?\s+Method\s+Status\s+Protocol")
    ).select(
        "file_id", name.alias("name"), normalize_interface(name).alias("normalized_name"),
        F.coalesce(F.trim("_description"), F.lit("")).alias("description"),
        F.col("_ip_address").alias("ip_address"), F.col("_ip_mask").alias("subnet_mask"),
        network_cidr(F.col("_ip_address"), F.col("_ip_mask")).alias("cidr"),
        F.coalesce(
            F.lower("_mode"), F.when(flag("dot1q_vlan"), "routed-subinterface"), F.when(flag("access_vlan"), "access"),
            F.when(F.size(vlans_) > 0, "trunk"), F.when(flag("_ip"), "routed"), F.lit("unknown"),
        ).alias("mode"),
        "access_vlan", vlans_.alias("trunk_allowed_vlans"), "native_vlan", "dot1q_vlan", F.col("_acl_in").alias("acl_in"),
        F.col("_acl_out").alias("acl_out"), F.lower("_nat_role").alias("nat_role"),
        (flag("_secure") | flag("_sticky")).alias("port_security_enabled"), F.col("_secure_max").alias("port_security_max"),
        F.lower("_secure_mode").alias("port_security_violation"), flag("_sticky").alias("port_security_sticky"), flag("_shutdown").alias("shutdown"),
        F.lit("running-config").alias("source"), evidence(F.col("_line"), F.col("_header"), 0.95).alias("evidence"),
    )
    return blocks.unionByName(_trunk_hints(a if lines is None else only(lines, "interface")), allowMissingColumns=True)


def _trunk_hints(lines: DataFrame) -> DataFrame:
    """Trunk ports of table rows that have no interface block of the same name; one pass over plain lines."""
    header = rx(T(), r"^\s*interface\s+(\S+)")
    block = header.isNotNull() & ~F.lower(header).isin("ip-address", "name") & ~matches(T(), r"OK\?\s+Method\s+Status\s+Protocol")
    port = rx(T(), fv.TRUNK_ROW)
    row = matches(T(), fv.TRUNK_ROW) & ~T().contains("Port") & ~T().contains("Vlans") & matches(port, fv.PORT_PREFIX)
    named = lines.filter(block | row).groupBy("file_id", F.when(block, header).otherwise(port).alias("name")).agg(
        F.max(block).alias("_block"), F.min_by(evidence(F.col("line_no"), T(), 0.72), F.when(row & ~block, F.col("line_no"))).alias("evidence"))
    return named.filter(~F.col("_block")).select(
        "file_id", "name", normalize_interface(F.col("name")).alias("normalized_name"),
        F.lit("show interfaces trunk hint").alias("description"), F.lit("trunk").alias("mode"),
        F.array().cast("array<string>").alias("trunk_allowed_vlans"), F.lit(False).alias("port_security_enabled"),
        F.lit(False).alias("port_security_sticky"), F.lit(False).alias("shutdown"),
        F.lit("show interfaces trunk").alias("source"), "evidence",
    )


def dhcp_excluded(lines: DataFrame) -> DataFrame:
    p = r"^\s*ip dhcp excluded-address\s+(\S+)(?:\s+(\S+))?"
    return lines.filter(matches(T(), p)).select(
        "file_id", rx(T(), p, 1).alias("start"), F.coalesce(rx(T(), p, 2), rx(T(), p, 1)).alias("end"), EV(0.94))


def dhcp_scopes(a: DataFrame) -> DataFrame:
    blk = F.col("blk_dhcp")
    net = r"^\s*network\s+(\S+)\s+(\S+)"
    words = lambda p: F.split(F.trim(rx(T(), p)), r"\s+")
    adds = _relevant(blk, [net, r"^\s*default-router\s+(.+)", r"^\s*dns-server\s+(.+)", r"^\s*domain-name\s+(.+)"])
    grouped = a.filter(blk["open"] & adds).groupBy("file_id", blk["line"].alias("_line")).agg(
        F.max(blk["text"]).alias("_header"),
        last_wins(F.when(matches(T(), net), F.struct(rx(T(), net, 1).alias("ip"), rx(T(), net, 2).alias("mask")))).alias("_net"),
        last_wins(words(r"^\s*default-router\s+(.+)").getItem(0)).alias("default_gateway"),
        last_wins(words(r"^\s*dns-server\s+(.+)")).alias("_dns"),
        last_wins(F.trim(rx(T(), r"^\s*domain-name\s+(.+)"))).alias("domain_name"),
    )
    return grouped.select(
        "file_id", rx(F.col("_header"), r"^\s*ip dhcp pool\s+(\S+)").alias("name"),
        F.col("_net.ip").alias("network"), F.col("_net.mask").alias("mask"),
        network_cidr(F.col("_net.ip"), F.col("_net.mask")).alias("cidr"), "default_gateway",
        F.coalesce("_dns", F.array().cast("array<string>")).alias("dns_servers"), "domain_name",
        evidence(F.col("_line"), F.col("_header"), 0.95).alias("evidence"),
    )


def acl_expression(expression: Column, kind: Column) -> Column:
    """Rule text to protocol, source, destination, operator and port."""
    t = F.split(F.trim(expression), r"\s+")

    def address(at: Column) -> tuple[Column, Column, Column]:
        value, following = F.get(t, at), F.get(t, at + 1)
        is_any = F.lower(value) == "any"
        is_host = (F.lower(value) == "host") & following.isNotNull()
        wild = F.coalesce(following.rlike(rf"^{fv.IPV4}$"), F.lit(False))
        return (
            F.when(is_any, F.lit("any")).when(is_host, following).otherwise(value),
            F.when(is_any, F.lit(None)).when(is_host, F.lit("host")).when(wild, following),
            at + F.when(value.isNull(), 0).when(is_any, 1).when(is_host | wild, 2).otherwise(1),
        )

    src, src_wild, after_src = address(F.lit(1))
    dst, dst_wild, after_dst = address(after_src)
    standard = kind == "standard"
    pick = lambda std, ext: F.when(standard, std).otherwise(ext).cast("string")
    none = F.lit(None)
    return F.struct(
        pick(none, F.get(t, F.lit(0))).alias("protocol"),
        pick(F.get(t, F.lit(0)), src).alias("source"), pick(F.get(t, F.lit(1)), src_wild).alias("source_wildcard"),
        pick(none, dst).alias("destination"), pick(none, dst_wild).alias("destination_wildcard"),
        pick(none, F.get(t, after_dst)).alias("operator"), pick(none, F.get(t, after_dst + 1)).alias("port"),
        t.alias("raw_tokens"),
    )


def acl_rules(a: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    plain = a if lines is None else only(lines, "acl")
    numbered = r"^\s*access-list\s+(\S+)\s+(permit|deny)\s+(.+)"
    number = rx(T(), numbered, 1)
    n = F.when(number.rlike(r"^\d+$"), number.try_cast("long"))
    kind = F.when(~number.rlike(r"^\d+$") | n.between(100, 199) | n.between(2000, 2699), "extended").otherwise("standard")
    first = plain.filter(matches(T(), numbered)).select(
        "file_id", number.alias("acl_name"), kind.alias("type"), F.lit(None).cast("string").alias("sequence"),
        F.lower(rx(T(), numbered, 2)).alias("action"), F.trim(rx(T(), numbered, 3)).alias("expression"), EV(0.94))
    blk = F.col("blk_acl")
    header = r"^\s*ip access-list\s+(standard|extended)\s+(\S+)"
    rule = r"^\s*(?:(\d+)\s+)?(permit|deny)\s+(.+)"
    second = a.filter(blk["open"] & (F.col("line_no") > blk["line"]) & matches(T(), rule)).select(
        "file_id", rx(blk["text"], header, 2).alias("acl_name"), F.lower(rx(blk["text"], header, 1)).alias("type"),
        rx(T(), rule, 1).alias("sequence"), F.lower(rx(T(), rule, 2)).alias("action"),
        F.trim(rx(T(), rule, 3)).alias("expression"), EV(0.92))
    return first.unionByName(second).withColumn("parsed", acl_expression(F.col("expression"), F.col("type")))


def static_routes(lines: DataFrame) -> DataFrame:
    p = r"^\s*ip route\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+(.+))?"
    return only(lines, "static_routes").filter(matches(T(), p)).select(
        "file_id", F.lit("static").alias("type"), rx(T(), p, 1).alias("destination"), rx(T(), p, 2).alias("mask"),
        network_cidr(rx(T(), p, 1), rx(T(), p, 2)).alias("cidr"), rx(T(), p, 3).alias("next_hop"),
        F.coalesce(rx(T(), p, 4), F.lit("")).alias("extra"), EV(0.94))


def routing_protocols(lines: DataFrame) -> DataFrame:
    p = r"^\s*router\s+(ospf|eigrp|rip|bgp)\s+(.+)?"
    return lines.filter(matches(T(), p)).select(
        "file_id", F.lower(rx(T(), p, 1)).alias("protocol"), F.trim(F.coalesce(rx(T(), p, 2), F.lit(""))).alias("process"), EV(0.90))


def nat_rules(lines: DataFrame) -> DataFrame:
    return lines.filter(matches(T(), r"^\s*ip nat\b")).select("file_id", F.trim(T()).alias("expression"), EV(0.88))


# --- neighbours -------------------------------------------------------------
def cdp_links(a: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    plain = a if lines is None else only(lines, "cdp")
    cdp = F.col("cdp")
    detail = (
        a.filter(cdp.isNotNull() & _relevant(cdp, [fv.CDP_PORTS, fv.CDP_PLATFORM])).groupBy("file_id", cdp["line"].alias("_line")).agg(
            F.max(cdp["text"]).alias("_header"),
            last_wins(F.when(matches(T(), fv.CDP_PORTS), F.struct(
                F.trim(rx(T(), fv.CDP_PORTS, 1)).alias("l"), F.trim(rx(T(), fv.CDP_PORTS, 2)).alias("r")))).alias("_ports"),
            last_wins(F.trim(rx(T(), fv.CDP_PLATFORM))).alias("platform"),
        ).select(
            "file_id", F.trim(rx(F.col("_header"), fv.CDP_DEVICE)).alias("neighbor"),
            F.col("_ports.l").alias("local_interface"), F.col("_ports.r").alias("remote_interface"), "platform",
            F.lit(None).cast("string").alias("capabilities"), F.lit(None).cast("string").alias("source"),
            evidence(F.col("_line"), F.col("_header"), 0.82).alias("evidence"), F.lit(0).alias("_rank"))
    )
    g = lambda i: rx(T(), fv.CDP_TABLE_ROW, i)
    table = plain.filter(~matches(T(), fv.CDP_TABLE_HEADER) & matches(T(), fv.CDP_TABLE_ROW)).select(
        "file_id", g(1).alias("neighbor"), F.regexp_replace(g(2), r"\s+", "").alias("local_interface"),
        F.regexp_replace(g(5), r"\s+", "").alias("remote_interface"), g(4).alias("platform"),
        F.trim(g(3)).alias("capabilities"), F.lit("show_cdp_neighbors_table").alias("source"), EV(0.78), F.lit(1).alias("_rank"))
    rows = detail.unionByName(table)
    order = F.struct("_rank", "evidence.source_line")
    fields = ["neighbor", "local_interface", "remote_interface", "platform", "evidence"]
    return (
        rows.groupBy("file_id", F.col("neighbor").alias("_k1"), normalize_interface(F.col("local_interface")).alias("_k2"),
                     normalize_interface(F.col("remote_interface")).alias("_k3"))
        .agg(F.max_by(F.struct(*fields), order).alias("v"),
             F.max_by("capabilities", F.when(F.col("_rank") == 1, order)).alias("capabilities"),
             F.max_by("source", F.when(F.col("_rank") == 1, order)).alias("source"))
        .select("file_id", *[F.col(f"v.{f}").alias(f) for f in fields[:4]], "capabilities", "source", "v.evidence")
    )


def lldp_links(a: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    plain = a if lines is None else only(lines, "lldp")
    lldp = F.col("lldp")
    detail = (
        a.filter(lldp.isNotNull() & _relevant(lldp, [fv.LLDP_LOCAL, fv.LLDP_REMOTE, fv.LLDP_PLATFORM])).groupBy("file_id", lldp["line"].alias("_line")).agg(
            F.max(lldp["text"]).alias("_header"),
            last_wins(rx(T(), fv.LLDP_LOCAL)).alias("local_interface"),
            last_wins(rx(T(), fv.LLDP_REMOTE)).alias("remote_interface"),
            last_wins(F.trim(rx(T(), fv.LLDP_PLATFORM))).alias("platform"),
        ).select("file_id", F.trim(rx(F.col("_header"), fv.LLDP_DEVICE)).alias("neighbor"), "local_interface",
                 "remote_interface", "platform", evidence(F.col("_line"), F.col("_header"), 0.78).alias("evidence"))
    )
    g = lambda i: rx(T(), fv.LLDP_TABLE_ROW, i)
    table = plain.filter(matches(T(), fv.LLDP_TABLE_ROW) & matches(g(2), fv.PORT_PREFIX_LLDP)).select(
        "file_id", g(1).alias("neighbor"), g(2).alias("local_interface"), g(3).alias("remote_interface"),
        F.lit("lldp table").alias("platform"), EV(0.70))
    fields = ["neighbor", "local_interface", "remote_interface", "platform", "evidence"]
    return (
        detail.unionByName(table)
        .groupBy("file_id", F.col("neighbor").alias("_k1"), normalize_interface(F.col("local_interface")).alias("_k2"),
                 normalize_interface(F.col("remote_interface")).alias("_k3"))
        .agg(F.max_by(F.struct(*fields), "evidence.source_line").alias("v")).select("file_id", "v.*")
    )


# --- operational tables -----------------------------------------------------
def ip_brief_rows(lines: DataFrame, confidence: float) -> DataFrame:
    g = lambda i: rx(T(), fv.IP_BRIEF_ROW, i)
    return lines.filter(~matches(T(), fv.IP_BRIEF_HEADER) & matches(T(), fv.IP_BRIEF_ROW) & matches(g(1), fv.L3_PORT_PREFIX)).select(
        "file_id", "line_no", "text", g(1).alias("interface"), normalize_interface(g(1)).alias("normalized_interface"),
        F.when(F.lower(g(2)) != "unassigned", g(2)).alias("ip_address"), F.lower(F.trim(g(3))).alias("status"),
        F.lower(g(4)).alias("protocol"), EV(confidence))


def ip_inventory(lines: DataFrame) -> DataFrame:
    return ip_brief_rows(only(lines, "ip_inventory"), 0.86).drop("line_no", "text")


def interface_status(lines: DataFrame) -> DataFrame:
    g = lambda i: rx_any(T(), fv.STATUS_ROW, i)
    is_status = matches(T(), fv.STATUS_ROW) & matches(g(1), fv.PORT_PREFIX)
    body = lines.filter(~matches(T(), fv.STATUS_HEADER))
    status = body.filter(is_status).select(
        "file_id", "line_no", g(1).alias("interface"), normalize_interface(g(1)).alias("normalized_interface"),
        F.trim(g(2)).alias("name"), F.lower(g(3)).alias("status"), g(4).alias("vlan"), g(5).alias("duplex"),
        g(6).alias("speed"), F.trim(g(7)).alias("type"), EV(0.82))
    brief = ip_brief_rows(body.filter(~is_status), 0.76).drop("text").withColumn("name", F.lit("ip interface brief"))
    rows = status.unionByName(brief, allowMissingColumns=True)
    fields = [c for c in rows.columns if c != "file_id"]
    return (
        rows.groupBy("file_id", F.col("normalized_interface").alias("_k1"), F.col("status").alias("_k2"),
                     F.coalesce("vlan", "ip_address").alias("_k3"))
        .agg(F.max_by(F.struct(*fields), "line_no").alias("v")).select("file_id", "v.*").drop("line_no")
    )


def trunk_operational(a: DataFrame) -> DataFrame:
    """One row per port and file, and one for each further status row of it.

    A line is reduced to its port and values once; one window over the lines of a port then gives both kinds of rows, so the
    states are carried once and no row is joined with another.
    """
    g = lambda i: rx(T(), fv.TRUNK_ROW, i)
    empty = F.array().cast("array<string>")
    sections = ("allowed", "active", "forwarding")
    v = lambda i: rx(T(), fv.TRUNK_VLAN_ROW, i)
    section = F.when(F.col("trunk_section").isin("allowed", "active"), F.col("trunk_section")).otherwise("forwarding")
    of = lambda **cols: F.struct(*[cols.get(n, F.lit(None).cast("string")).alias(n) for n in ("interface", "mode", "encapsulation", "status", "native_vlan", "section", "vlans")])
    row = F.when(_trunk_row(), of(interface=g(1), mode=F.lower(g(2)), encapsulation=g(3), status=F.lower(g(4)), native_vlan=F.trim(g(5))))
    listed = ~_trunk_heading() & F.col("trunk_seen") & matches(T(), fv.TRUNK_VLAN_ROW) & matches(v(1), fv.PORT_PREFIX)
    hit = F.coalesce(row, F.when(listed, of(interface=v(1), section=section, vlans=v(2))))
    hits = _held(a, ["file_id", "line_no", "text"], [hit], "h").select("file_id", "line_no", "text", "h.*")
    port = Window.partitionBy("file_id", "interface").orderBy("line_no")
    whole = port.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_row = F.col("section").isNull()
    shown = F.when(is_row, F.struct("mode", "encapsulation", "status", "native_vlan", F.col("line_no").alias("line"), "text"))
    placed = hits.select(
        "file_id", "interface", "line_no", is_row.alias("_is_row"), shown.alias("_own"), F.row_number().over(port).alias("_nth"),
        F.first(shown, ignorenulls=True).over(whole).alias("_r"),
        F.first(F.when(~is_row, F.struct(F.col("line_no").alias("line"), "text")), ignorenulls=True).over(whole).alias("_s"),
        *[F.last(F.when(F.col("section") == s, F.col("vlans")), ignorenulls=True).over(whole).alias(f"_{s}") for s in sections])
    # the first line of a port stands for it; status rows after its first one are rows of their own
    repeat = F.when(F.col("_is_row") & (F.col("line_no") > F.col("_r.line")), F.struct(F.lit(False).alias("main"), F.col("_own").alias("r")))
    main = F.when(F.col("_nth") == 1, F.struct(F.lit(True).alias("main"), F.col("_r").alias("r")))
    out = _held(placed, ["file_id", "interface", "_s", *[f"_{s}" for s in sections]], [F.coalesce(main, repeat)], "o")
    r, first = F.col("o.r"), F.col("o.main")
    return out.select(
        "file_id", "interface", normalize_interface(F.col("interface")).alias("normalized_interface"),
        r["mode"].alias("mode"), r["encapsulation"].alias("encapsulation"), r["status"].alias("status"), r["native_vlan"].alias("native_vlan"),
        *[F.coalesce(F.when(first, expand_vlans(F.col(f"_{s}"))), empty).alias(f"{s}_vlans") for s in sections],
        evidence(F.coalesce(r["line"], F.col("_s.line")), F.coalesce(r["text"], F.col("_s.text")), F.when(r.isNotNull(), 0.86).otherwise(0.72)).alias("evidence"))


def route_table(lines: DataFrame) -> DataFrame:
    g = lambda i: rx(T(), fv.ROUTE_ROW, i)
    return lines.filter(matches(T(), fv.ROUTE_ROW)).select(
        "file_id", g(1).alias("code"), g(2).alias("network"), g(3).alias("prefix"), g(4).alias("mask"),
        g(7).alias("next_hop"), g(8).alias("out_interface"), g(5).try_cast("int").alias("administrative_distance"),
        g(6).try_cast("int").alias("metric"), EV(0.75))


def ospf_neighbors(lines: DataFrame) -> DataFrame:
    g = lambda i: rx(T(), fv.OSPF_ROW, i)
    return lines.filter(matches(T(), fv.OSPF_ROW)).select(
        "file_id", g(1).alias("neighbor_id"), g(2).try_cast("int").alias("priority"), F.upper(g(3)).alias("state"),
        g(4).alias("address"), g(5).alias("interface"), normalize_interface(g(5)).alias("normalized_interface"), EV(0.80))


def device_inventory(a: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    plain = a if lines is None else only(lines, "inventory_name")
    name = F.col("inventory_name")
    p = lambda i: F.trim(rx_any(T(), fv.INVENTORY_PID, i))
    parts = a.filter(name.isNotNull() & _relevant(name, [fv.INVENTORY_PID])).groupBy("file_id", name["line"].alias("_line")).agg(
        F.max(name["text"]).alias("_header"),
        last_wins(F.when(matches(T(), fv.INVENTORY_PID), F.struct(p(1).alias("pid"), p(2).alias("vid"), p(3).alias("serial")))).alias("p"),
    ).select(
        "file_id", rx(F.col("_header"), fv.INVENTORY_NAME, 1).alias("name"),
        rx_any(F.col("_header"), fv.INVENTORY_NAME, 2).alias("description"), "p.pid", "p.vid", "p.serial",
        evidence(F.col("_line"), F.col("_header"), 0.76).alias("evidence"))
    chassis = plain.filter(matches(T(), fv.CHASSIS_ROW) & ~matches(T(), fv.INVENTORY_NAME)).select(
        "file_id", F.lit("chassis").alias("name"), F.lit("show version model").alias("description"),
        rx(T(), fv.CHASSIS_ROW).alias("pid"), F.lit(None).cast("string").alias("vid"),
        F.lit(None).cast("string").alias("serial"), EV(0.70))
    return parts.unionByName(chassis)


def vlan_brief(a: DataFrame) -> DataFrame:
    g = lambda i: rx_any(T(), fv.VLAN_BRIEF_ROW, i)
    raw = F.trim(g(4))
    ports = F.filter(F.split(raw, r"\s*,\s*|\s{2,}"), lambda x: F.trim(x) != "")
    conf = F.when(g(1).isin("1002", "1003", "1004", "1005"), 0.55).when(F.col("vlan_header"), 0.84).otherwise(0.66)
    return a.filter(~matches(T(), fv.VLAN_BRIEF_HEADER) & matches(T(), fv.VLAN_BRIEF_ROW)).select(
        "file_id", g(1).alias("vlan"), F.trim(g(2)).alias("name"), F.lower(g(3)).alias("status"),
        F.transform(ports, lambda x: normalize_interface(x)).alias("ports"), raw.alias("raw_ports"), EV(conf))


def acl_hit_counts(a: DataFrame) -> DataFrame:
    header = matches(T(), fv.ACL_SHOW_HEADER) | matches(T(), fv.ACL_CONFIG_HEADER)
    return a.filter(~header & matches(T(), fv.ACL_MATCHES)).select(
        "file_id", F.col("acl_active").alias("acl_name"), rx(T(), r"^\s*(\d+)\s+").alias("sequence"),
        rx(T(), fv.ACL_MATCHES).try_cast("long").alias("matches"), F.trim(T()).alias("line_text"), EV(0.82))


def interface_counters(a: DataFrame) -> DataFrame:
    c = F.col("counter")
    errors = matches(T(), fv.COUNTER_INPUT) | matches(T(), fv.COUNTER_OUTPUT)
    num = lambda p, g=1: rx(T(), p, g).try_cast("long")
    grouped = a.filter(c.isNotNull() & _relevant(c, [fv.COUNTER_INPUT, fv.COUNTER_OUTPUT, fv.COUNTER_DROPS])).groupBy("file_id", c["line"].alias("_line")).agg(
        F.max(c["text"]).alias("_header"),
        last_wins(num(fv.COUNTER_INPUT)).alias("input_errors"), last_wins(num(fv.COUNTER_OUTPUT)).alias("output_errors"),
        last_wins(num(fv.COUNTER_INPUT, 2)).alias("crc"), F.sum(num(fv.COUNTER_DROPS)).alias("drops"),
        last_wins(F.when(errors, evidence(F.col("line_no"), T(), 0.80))).alias("error_evidence"),
    )
    h = lambda i: rx(F.col("_header"), fv.COUNTER_HEADER, i)
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return grouped.select(
        "file_id", h(1).alias("interface"), normalize_interface(h(1)).alias("normalized_interface"),
        F.lower(h(2)).alias("status"), F.lower(h(3)).alias("protocol"),
        zero("input_errors"), zero("output_errors"), zero("crc"), zero("drops"), "error_evidence",
        evidence(F.col("_line"), F.col("_header"), 0.78).alias("evidence"))


def stp_root(a: DataFrame) -> DataFrame:
    s = F.col("stp")
    inside = F.col("line_no") > s["line"]
    body = lambda p, g=1: F.when(inside, rx(T(), p, g))
    return a.filter(s.isNotNull() & _relevant(s, [fv.STP_PRIORITY, fv.STP_ADDRESS, fv.STP_COST])).groupBy("file_id", s["line"].alias("_line")).agg(
        F.max(s["text"]).alias("_header"),
        last_wins(body(fv.STP_PRIORITY).try_cast("int")).alias("root_priority"),
        first_wins(F.lower(body(fv.STP_ADDRESS))).alias("root_bridge"),
        last_wins(body(fv.STP_COST).try_cast("int")).alias("cost"), last_wins(body(fv.STP_COST, 2)).alias("root_port"),
    ).select("file_id", rx(F.col("_header"), fv.STP_VLAN).alias("vlan"), "root_bridge", "root_port", "cost", "root_priority",
             evidence(F.col("_line"), F.col("_header"), 0.72).alias("evidence"))


def spanning_tree(a: DataFrame) -> DataFrame:
    g = lambda i: rx(T(), fv.STP_ROW, i)
    return a.filter(matches(T(), fv.STP_ROW) & matches(g(1), fv.PORT_PREFIX)).select(
        "file_id", F.col("stp_section").alias("vlan"), g(1).alias("interface"),
        normalize_interface(g(1)).alias("normalized_interface"), g(2).alias("role"), g(3).alias("state"),
        F.trim(g(4)).alias("type"), EV(0.80))


def etherchannels(lines: DataFrame) -> DataFrame:
    g = lambda i: rx(T(), fv.ETHERCHANNEL_ROW, i)
    return lines.filter(matches(T(), fv.ETHERCHANNEL_ROW)).select(
        "file_id", g(1).alias("group"), g(2).alias("port_channel"), normalize_interface(g(2)).alias("normalized_port_channel"),
        g(3).alias("flags"), g(4).alias("protocol"),
        F.regexp_extract_all(g(5), F.lit(fv.ETHERCHANNEL_MEMBER), F.lit(0)).alias("member_ports"),
        F.trim(g(5)).alias("raw_members"), EV(0.80))


def mac_table(lines: DataFrame) -> DataFrame:
    g = lambda i: rx(T(), fv.MAC_ROW, i)
    return lines.filter(matches(T(), fv.MAC_ROW)).select(
        "file_id", g(1).alias("vlan"), F.lower(g(2)).alias("mac"), F.lower(g(3)).alias("type"), g(4).alias("interface"),
        normalize_interface(g(4)).alias("normalized_interface"), EV(0.75))


def arp_table(lines: DataFrame) -> DataFrame:
    g = lambda i: rx(T(), fv.ARP_ROW, i)
    return lines.filter(matches(T(), fv.ARP_ROW)).select(
        "file_id", g(1).alias("ip_address"), F.lower(g(2)).alias("mac"), g(3).alias("interface"),
        normalize_interface(g(3)).alias("normalized_interface"), EV(0.74))


def port_security(a: DataFrame, interface_rows: DataFrame) -> DataFrame:
    config = interface_rows.filter(
        F.col("port_security_enabled") | F.col("port_security_max").isNotNull() | F.col("port_security_violation").isNotNull()
    ).select(
        "file_id", F.col("name").alias("interface"), F.col("normalized_name").alias("normalized_interface"),
        F.col("port_security_enabled").alias("enabled"), F.col("port_security_max").alias("maximum"),
        F.col("port_security_violation").alias("violation_mode"), F.coalesce("port_security_sticky", F.lit(False)).alias("sticky"),
        F.lit(None).cast("long").alias("violation_count"), F.lit(None).cast("string").alias("last_source"),
        F.lit("running-config interface").alias("source"), "evidence")
    s = F.col("secure_port")
    adds = T().rlike(_any_of([fv.PORT_SECURITY_STATE, fv.PORT_SECURITY_MAX, fv.PORT_SECURITY_MODE, fv.PORT_SECURITY_COUNT, fv.PORT_SECURITY_LAST]))
    own = a.filter((s.isNotNull() & ((F.col("line_no") == s["line"]) | adds)) | (s.isNull() & F.col("secure_state") & adds))
    g = lambda p: rx(T(), p)
    show = own.groupBy("file_id", s["line"].alias("_line")).agg(
        F.max(s["text"]).alias("_header"), F.min_by(F.struct(F.col("line_no").alias("line"), T().alias("text")), "line_no").alias("_first"),
        last_wins(F.lower(g(fv.PORT_SECURITY_STATE)) == "enabled").alias("enabled"),
        last_wins(g(fv.PORT_SECURITY_MAX)).alias("maximum"), last_wins(F.lower(g(fv.PORT_SECURITY_MODE))).alias("violation_mode"),
        last_wins(g(fv.PORT_SECURITY_COUNT).try_cast("long")).alias("violation_count"),
        last_wins(g(fv.PORT_SECURITY_LAST)).alias("last_source"),
    )
    port = rx(F.col("_header"), fv.PORT_SECURITY_PORT)
    show = show.select(
        "file_id", F.coalesce(port, F.lit("unknown")).alias("interface"), normalize_interface(port).alias("normalized_interface"),
        "enabled", "maximum", "violation_mode", F.lit(None).cast("boolean").alias("sticky"), "violation_count", "last_source",
        F.lit("show port-security").alias("source"),
        evidence(F.coalesce("_line", "_first.line"), F.coalesce("_header", "_first.text"),
                 F.when(F.col("_line").isNotNull(), 0.82).otherwise(0.78)).alias("evidence"))
    rows = config.unionByName(show)
    later = F.col("evidence.source_line")
    keep = ["interface", "enabled", "maximum", "violation_mode", "sticky", "violation_count", "last_source"]
    always = F.col("source") == "running-config interface"   # these rows carry every field, so empty values win too
    return rows.groupBy("file_id", "normalized_interface", "source").agg(*[
        F.max_by(c, F.when(always | F.col(c).isNotNull(), later)).alias(c) for c in keep
    ], F.max_by("evidence", later).alias("evidence"))


# --- indexes and pattern tables ---------------------------------------------
def protocol_summary(lines: DataFrame) -> DataFrame:
    groups = {"ospf": 1, "eigrp": 1, "bgp": 1}
    return _pattern_rows(lines.filter(T().rlike(_any_of([p for _, p in fv.PROTOCOL_PATTERNS]))), [
        (matches(T(), p), {"protocol": F.lit(n), "value": joined_groups(T(), p, groups.get(n, 0))}) for n, p in fv.PROTOCOL_PATTERNS
    ]).select("file_id", "protocol", "value", EV(0.76))


def security_hardening(a: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    rows = _pattern_rows((a if lines is None else only(lines, "hardening")).filter(T().rlike(_any_of([r[1] for r in fv.HARDENING_PATTERNS]))), [
        (matches(T(), p), {"name": F.lit(n), "posture": F.lit(posture), "value": joined_groups(T(), p, g), "confidence": F.lit(c)})
        for n, p, g, posture, c in fv.HARDENING_PATTERNS
    ]).select("file_id", "name", "posture", "value", EV(F.col("confidence")))
    blk = F.col("blk_vty")
    low = F.lower(T())
    inside = a.filter(blk["open"] & (F.col("line_no") > blk["line"]) & low.rlike("transport|telnet|login"))
    found = inside.groupBy("file_id", blk["line"].alias("line_no")).agg(
        F.max(blk["text"]).alias("text"),
        F.max(low.contains("transport input telnet") | low.rlike(r"transport\s+input\s+all")).alias("open"),
        F.max(low.contains("transport input ssh")).alias("ssh"), F.max(low.contains("telnet")).alias("telnet"),
        F.max(low.contains("login local")).alias("local"))
    checks = _pattern_rows(found, [
        (F.col("open"), {"name": F.lit("vty_telnet_allowed"), "posture": F.lit("weak"), "confidence": F.lit(0.88)}),
        (F.col("ssh") & ~F.col("telnet"), {"name": F.lit("vty_ssh_only"), "posture": F.lit("positive"), "confidence": F.lit(0.84)}),
        (F.col("local"), {"name": F.lit("vty_login_local"), "posture": F.lit("positive"), "confidence": F.lit(0.78)}),
    ]).select("file_id", "name", "posture", F.trim(T()).alias("value"), EV(F.col("confidence")))
    return rows.unionByName(checks)


def wireless_hints(lines: DataFrame) -> DataFrame:
    return _pattern_rows(lines.filter(T().rlike(_any_of([r[1] for r in fv.WIRELESS_HINT_PATTERNS]))), [
        (matches(T(), p), {"type": F.lit(n), "value": joined_groups(T(), p, g)}) for n, p, g in fv.WIRELESS_HINT_PATTERNS
    ]).select("file_id", "type", "value", EV(0.64))


def device_facts(lines: DataFrame) -> DataFrame:
    value = lambda p, g: F.concat_ws(" | ", *[rx(T(), p, i) for i in range(1, g + 1)])
    return _pattern_rows(lines.filter(T().rlike(_any_of([r[1] for r in fv.FACT_PATTERNS]))), [
        (matches(T(), p), {"name": F.lit(n), "value": value(p, g)}) for n, p, g in fv.FACT_PATTERNS
    ]).select("file_id", "name", "value", EV(0.70))


def service_hints(lines: DataFrame) -> DataFrame:
    low = F.lower(T())
    return _pattern_rows(lines, [
        (contains_any(low, words), {"name": F.lit(n)}) for n, words in fv.SERVICE_WORDS
    ]).select("file_id", "name", F.trim(T()).alias("hint"), EV(0.65))


def command_blocks(a: DataFrame) -> DataFrame:
    start = F.col("command_start")
    header = F.trim(F.col("_header"))
    member = rx(header, fv.MEMBER_ROW)
    blocks = a.filter(start.isNotNull()).groupBy("file_id", start["line"].alias("start_line"), start["text"].alias("_header")).agg(
        F.max("line_no").alias("end_line")
    ).select(
        "file_id", F.trim(F.coalesce(member, rx(F.col("_header"), fv.PROMPT_ROW, 2))).alias("name"),
        F.when(member.isNull(), rx(F.col("_header"), fv.PROMPT_ROW, 1)).alias("device"), "start_line", "end_line",
        (F.col("end_line") - F.col("start_line")).alias("line_count"),
        evidence(F.col("start_line"), F.col("_header"), 0.70).alias("evidence"))
    whole = a.groupBy("file_id").agg(
        F.max("line_no").alias("end_line"), F.count("*").alias("line_count"),
        F.max(start.isNotNull()).alias("_any"), F.min_by(T(), "line_no").alias("_first"),
    ).filter(~F.col("_any")).select(
        "file_id", F.lit("single evidence stream").alias("name"), F.lit(None).cast("string").alias("device"),
        F.lit(1).cast(a.schema["line_no"].dataType).alias("start_line"), "end_line", "line_count",
        evidence(F.lit(1), F.col("_first"), 0.50).alias("evidence"))
    return blocks.unionByName(whole)


def raw_evidence(lines: DataFrame) -> DataFrame:
    return lines.filter(words_found(T(), [("raw", fv.RAW_EVIDENCE_WORDS)]) != "").select("file_id", "line_no", "text")


def deep_evidence_index(lines: DataFrame) -> DataFrame:
    tags = words_found(T(), fv.EVIDENCE_TAXONOMY)
    return _held(lines, ["file_id", "line_no", "text"], [F.nullif(tags, F.lit(""))], "_t").select(
        "file_id", "line_no", "text", F.split("_t", ",").alias("tags")
    ).withColumn("weight", F.least(F.lit(1.0), F.round(F.lit(0.35) + F.lit(0.12) * F.size("tags"), 2)))


def _held(df: DataFrame, columns: list[str | Column], values: list[Column], name: str) -> DataFrame:
    """The columns beside each value of a row that is not null; a value is computed once, not in a filter and again in the output.

    A single value is exploded as it is, and null goes after that: a lambda over the array would be evaluated line by line without
    generated code. Many values keep the lambda, as the generated method of them all is too long for the JVM.
    """
    each = F.array(*values)
    if len(values) > 1:
        return df.select(*columns, F.explode(F.filter(each, lambda v: v.isNotNull())).alias(name))
    return df.select(*columns, F.explode(each).alias(name)).filter(F.col(name).isNotNull())


def all_config_commands(a: DataFrame) -> DataFrame:
    cmd = F.col("_s")
    a = a.withColumn("_s", STRIPPED()).filter(~cmd.isin("", "!", "end"))
    context = F.coalesce("context", F.lit("global"))
    category = F.coalesce(
        *[F.when(matches(cmd, p), F.lit(n)) for n, p in fv.COMMAND_CATEGORIES],
        F.when((context != "global") & T().rlike(r"^\s+[A-Za-z0-9_-]"), F.lit("context_child")))
    return _held(a, ["file_id", "line_no", "_s", context.alias("context")], [category], "category").select(
        "file_id", "line_no", "context", "category", redact_command(cmd).alias("command"), F.length(cmd).alias("raw_length"),
    ).withColumn(
        "evidence", evidence(F.col("line_no"), F.col("command"), F.when(F.col("category") == "context_child", 0.68).otherwise(0.82)))


def interface_features(a: DataFrame) -> DataFrame:
    blk = F.col("blk_interface")
    body = a.filter(blk["open"] & (F.col("line_no") > blk["line"])).select(
        "file_id", "line_no", "text", blk["text"].alias("_header"), STRIPPED().alias("_s")
    ).filter(F.col("_s").rlike(_any_of([r[1] for r in fv.FEATURE_PATTERNS])))
    cmd = F.col("_s")
    hits = [F.when(matches(cmd, p), F.struct(F.lit(n).alias("feature"), joined_nonempty(cmd, p, g).alias("value"))) for n, p, g in fv.FEATURE_PATTERNS]
    name = rx(F.col("_header"), r"^\s*interface\s+(\S+)")
    return _held(body, ["file_id", "line_no", "text", name.alias("interface")], hits, "h").select(
        "file_id", "interface", normalize_interface(F.col("interface")).alias("normalized_interface"), "h.feature", "h.value",
        F.when(F.col("h.feature").isin("voice_vlan", "switchport_allowed_vlan_add"), expand_vlans(F.col("h.value"))).alias("vlans"),
        evidence(F.col("line_no"), redact_command(T()), 0.84).alias("evidence"))


def management_services(a: DataFrame) -> DataFrame:
    header = r"^line\s+(vty|console|aux)\b"
    cmd = F.col("_s")
    a = a.withColumn("_s", STRIPPED()).filter(cmd.rlike(_any_of([header] + [r[1] for r in fv.MANAGEMENT_PATTERNS])))
    is_context = matches(cmd, header)
    text = lambda x: x.cast("string")
    none = F.lit(None).cast("string")
    rows = [(is_context, {
        "service": F.lit("line_context"), "family": none, "context": cmd, "value": cmd, "command": none,
        "risk": none, "confidence": F.lit(0.78)})]
    for service, p, g, family in fv.MANAGEMENT_PATTERNS:
        value = joined_nonempty(cmd, p, g)
        if service == "snmp_community":
            value = F.concat(F.lit("<redacted>"), F.regexp_extract(cmd, ci(p), 2))
        risk = F.lit("control")
        if service == "http_server":
            risk = F.lit("weak")
        elif service == "transport_input":
            risk = F.when(F.lower(value).contains("telnet"), "weak").otherwise("control")
        rows.append((~is_context & matches(cmd, p), {
            "service": F.lit(service), "family": F.lit(family),
            "context": text(F.col("line_context")) if family == "line_access" else F.lit("global"),
            "value": value, "command": redact_command(cmd), "risk": risk, "confidence": F.lit(0.82)}))
    hits = [F.when(t, F.struct(*[c.alias(n) for n, c in cols.items()])) for t, cols in rows]
    return _held(a, ["file_id", "line_no", "_s"], hits, "h").select("file_id", "line_no", "_s", "h.*").select(
        "file_id", "service", "family", "context", "value", "command", "risk",
        evidence(F.col("line_no"), F.coalesce("command", cmd), F.col("confidence")).alias("evidence"))


def gateway_redundancy(a: DataFrame) -> DataFrame:
    blk = F.col("blk_interface")
    fhrp, glbp = FHRP_ROW, GLBP_ROW
    g = lambda i: F.coalesce(rx(STRIPPED(), fhrp, i), rx(STRIPPED(), glbp, i))
    word = F.lower(g(1))
    name = rx(blk["text"], r"^\s*interface\s+(\S+)")
    return a.filter(blk["open"] & (matches(STRIPPED(), fhrp) | matches(STRIPPED(), glbp))).select(
        "file_id", F.when(word == "standby", "hsrp").otherwise(word).alias("protocol"), name.alias("interface"),
        normalize_interface(name).alias("normalized_interface"), g(2).alias("group"), F.lower(g(3)).alias("action"),
        F.coalesce(F.nullif(F.trim(g(4)), F.lit("")), F.lit("true")).alias("value"),
        evidence(F.col("line_no"), STRIPPED(), 0.84).alias("evidence"))


def routing_protocol_details(a: DataFrame) -> DataFrame:
    blk = F.col("blk_router")
    header = r"^\s*router\s+(ospf|eigrp|rip|bgp)\s*(.*)"
    own = F.col("line_no") == blk["line"]
    kinds = [("network", r"^network\s+"), ("passive_interface", r"^passive-interface\s+"), ("redistribution", r"^redistribute\s+"),
             ("neighbor", r"^neighbor\s+"), ("default_origination", r"^default-information\s+")]
    kind = F.coalesce(F.when(own, F.lit("process")), *[F.when(matches(STRIPPED(), p), F.lit(k)) for k, p in kinds], F.lit("other"))
    return a.filter(blk["open"] & ~STRIPPED().isin("", "!")).select(
        "file_id", F.lower(rx(blk["text"], header, 1)).alias("protocol"),
        F.nullif(F.trim(rx(blk["text"], header, 2)), F.lit("")).alias("process"), kind.alias("type"), STRIPPED().alias("command"),
        evidence(F.col("line_no"), STRIPPED(), F.when(kind == "process", 0.88).when(kind == "other", 0.62).otherwise(0.80)).alias("evidence"))


# --- free text --------------------------------------------------------------
def text_credentials(lines: DataFrame) -> DataFrame:
    """The secrets of `text_entities` alone, `file_id, name, line_no, source_text`: only lines with a word for one are looked at.

    A line names a secret once, so the rows need no grouping.
    """
    names = F.array_distinct(F.regexp_extract_all(T(), F.lit(fv.SECRET_PATTERN), F.lit(1)))
    few = only(lines, "credential") if TAGS in lines.columns else needed_lines(lines, "credential", once=False)
    return few.select("file_id", "line_no", F.explode(names).alias("name"), redact_secret(F.trim(T())).alias("source_text"))


def text_entities(lines: DataFrame, source: str = "file_id") -> DataFrame:
    """Hosts, interfaces, VLANs, addresses, SSIDs and secrets named in any text."""
    host = rx(T(), fv.ENTITY_HOSTNAME)
    hosts = lines.filter(host.isNotNull()).groupBy("file_id").agg(
        F.min_by(F.struct(host.alias("name"), "line_no", T().alias("text")), "line_no").alias("h"))
    every = lambda p, g: F.regexp_extract_all(T(), F.lit(p), F.lit(g))
    found = lambda kind, p, g, conf: F.transform(every(p, g), lambda v: F.struct(
        F.lit(kind).alias("type"), v.alias("name"), F.lit(conf).alias("confidence")))
    ips = F.filter(found("ip_address", fv.ENTITY_IP, 0, 0.65), lambda s: probable_ip(s["name"]))
    vlan = F.transform(
        F.filter(every(fv.ENTITY_VLAN, 1), lambda v: v.try_cast("int").between(1, 4094)),
        lambda v: F.struct(F.lit("vlan").alias("type"), F.concat(F.lit("VLAN "), v.try_cast("int").cast("string")).alias("name"),
                           F.lit(0.76).alias("confidence")))
    ssid = F.transform(every(fv.ENTITY_SSID, 1), lambda v: F.struct(
        F.lit("wireless_network").alias("type"), F.trim(v).alias("name"), F.lit(0.70).alias("confidence")))
    hits = F.concat(
        found("interface", fv.ENTITY_INTERFACE, 1, 0.80), vlan, ips, found("mac_address", fv.ENTITY_MAC, 0, 0.70), ssid,
        found("credential", fv.SECRET_PATTERN, 1, 0.86))
    rows = lines.select("file_id", "line_no", "text", F.explode(hits).alias("e")).select(
        "file_id", "line_no", redact_secret(F.trim(T())).alias("source_text"), "e.*")
    rows = rows.unionByName(hosts.select(
        "file_id", F.col("h.line_no").alias("line_no"), F.trim("h.text").alias("source_text"), F.lit("device").alias("type"),
        F.col("h.name").alias("name"), F.lit(0.82).alias("confidence")))
    unique = rows.groupBy("file_id", "type", "name", "line_no").agg(F.min("source_text").alias("source_text"), F.max("confidence").alias("confidence"))
    owner = hosts.select("file_id", F.col("h.name").alias("hostname"))
    prefix = {"device": "dev", "interface": "if", "vlan": "vlan", "ip_address": "ip", "mac_address": "mac",
              "wireless_network": "ssid", "credential": "secret"}
    src, line, name = F.col(source), F.col("line_no"), F.col("name")
    parts = {
        "device": [src, name], "interface": [src, F.coalesce("hostname", F.lit("")), name],
        "vlan": [src, F.regexp_extract(name, r"\d+", 0)], "ip_address": [src, name, line], "mac_address": [src, name],
        "wireless_network": [src, name], "credential": [src, line, name],
    }
    ident = F.coalesce(*[F.when(F.col("type") == k, stable_id(prefix[k], *parts[k])) for k in parts])
    return unique.join(owner, "file_id", "left").withColumn("id", ident).select(
        "id", "file_id", "type", "name", "hostname", "line_no", "source_text", "confidence",
        F.when((F.col("type") == "interface") & F.col("hostname").isNull(), F.array(F.lit("No hostname found for interface owner")))
        .when(F.col("type") == "credential", F.array(F.lit("Sensitive value redacted")))
        .otherwise(F.array().cast("array<string>")).alias("warnings"))


def visible_hints(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sorted distinct addresses, interfaces, VLANs and SSIDs seen in each text."""
    t = F.col(text_col)
    every = lambda p, g=0: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(g))))
    return texts.select(
        F.col(id_col), every(fv.ENTITY_IP).alias("ips"), every(fv.ENTITY_MAC).alias("macs"),
        every(fv.FACT_INTERFACE).alias("interfaces"), every(fv.ENTITY_VLAN, 1).alias("vlans"), every(fv.ENTITY_SSID, 1).alias("ssids"))


def reconstructed_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Commands that were flattened onto one long line, cut at each command start, in order, once each."""
    starters = "|".join(sorted(fv.COMMAND_STARTERS, key=len, reverse=True))
    cut = F.regexp_replace(F.col(text_col), rf"(?i)(?<![\w-])(?=(?:{starters})\b)", "\n")
    # a longer command may hold a shorter one (ip access-list / access-list): join such pairs again
    joined = F.regexp_replace(cut, r"(?i)\b(ip|no|switchport|router|spanning-tree|encapsulation|switchport access|switchport trunk allowed"
                                   r"|switchport trunk native|switchport voice)[ \t]*\n[ \t]*", "$1 ")
    command = F.trim(F.col("_c"))
    parts = texts.select(F.col(id_col), F.posexplode(F.split(joined, r"[\r\n]+")).alias("_pos", "_c"))
    starts = parts.filter(command.rlike(rf"(?i)^(?:{starters})\b"))
    return starts.groupBy(id_col, F.lower(command).alias("_k")).agg(
        F.min("_pos").alias("position"), F.min_by(command, "_pos").alias("command")).drop("_k")


def printable_runs(files: DataFrame, id_col: str, content_col: str, min_length: int = 5) -> DataFrame:
    """Readable character runs inside binary content."""
    text = F.decode(F.col(content_col), "ISO-8859-1")
    runs = F.regexp_extract_all(text, F.lit(rf"[\x20-\x7e\t\r\n]{{{min_length},}}"), F.lit(0))
    return files.select(F.col(id_col), F.posexplode(runs).alias("position", "run"))


def byte_histogram(content: Column) -> Column:
    """How often each of the 256 bytes stands in a content: counted where the content lies, no row or string per byte."""

    @F.pandas_udf("array<bigint>")
    def counts(contents: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(np.frombuffer(c, np.uint8), minlength=256) for c in contents], dtype=object)

    return counts(F.coalesce(content, F.lit(b"")))


def byte_statistics(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Size, Shannon entropy, printable share and archive signatures per file."""
    # fixed values: first bytes of packed formats
    marks = {"zip": "PK\x03\x04", "gzip": "\x1f\x8b\x08", "bzip2": "BZh", "zlib": "x\x9c", "xz": "\xfd7zXZ\x00"}
    latin = F.decode(F.col(content_col), "ISO-8859-1")
    signs = F.filter(F.array(*[F.when(latin.contains(h), F.lit(n)) for n, h in marks.items()]), lambda x: x.isNotNull())
    held = files.select(F.col(id_col), F.coalesce(F.octet_length(content_col), F.lit(0)).cast("long").alias("bytes"), byte_histogram(F.col(content_col)).alias("_h"), signs.alias("signatures"))
    zero = F.lit(0.0)
    nlogn = F.aggregate("_h", zero, lambda a, n: a + F.when(n > 0, n * F.log2(n)).otherwise(zero))
    printable = F.aggregate(F.concat(F.slice("_h", 33, 95), F.slice("_h", 10, 2), F.slice("_h", 14, 1)), F.lit(0).cast("long"), lambda a, n: a + n)
    some = F.nullif("bytes", F.lit(0))
    return held.select(id_col, "bytes", F.round(F.log2(some) - nlogn / some, 4).alias("entropy"), F.round(printable / some, 4).alias("printable_ratio"), "signatures")
