"""Names, lists, secrets and message classes as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv


def ci(pattern: str) -> str:
    """The pattern without regard to case."""
    return pattern if pattern.startswith("(?i)") else "(?i)" + pattern


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(ci(pattern))


def rx(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; null when the pattern or the group does not match."""
    return F.nullif(F.regexp_extract(text, ci(pattern), group), F.lit(""))


def rx_any(text: Column, pattern: str, group: int = 1) -> Column:
    """Like rx, but an empty group of a matching line stays an empty text."""
    return F.when(matches(text, pattern), F.regexp_extract(text, ci(pattern), group))


def joined_groups(text: Column, pattern: str, groups: int) -> Column:
    """All non-empty groups joined with one space; the trimmed line when there are none."""
    if groups == 0:
        return F.trim(text)
    parts = [F.regexp_extract(text, ci(pattern), g) for g in range(1, groups + 1)]
    return F.trim(F.concat_ws(" ", *parts))


def joined_nonempty(text: Column, pattern: str, groups: int, empty: str = "true") -> Column:
    """Non-empty groups joined with one space; `empty` where a match carries no value."""
    if groups == 0:
        return F.lit(empty)
    parts = [rx(text, pattern, g) for g in range(1, groups + 1)]
    return F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), F.lit(empty))


def contains_any(text: Column, words: list[str]) -> Column:
    """Substring test against a word list, on text that is already lower case."""
    return reduce(lambda a, b: a | b, [text.contains(w.lower()) for w in words])


def _wide(pattern: str) -> str:
    """A pattern that an automaton finds wherever Java finds the given one, or in more places.

    Java's white space has a vertical tab, its `$` stands before a last line end, and its `\\b` depends on the version.
    """
    # inside a class the sign goes in as it is; a negated class without it only lets more through
    spaces = re.sub(r"\[[^\]]*\]|\\s", lambda m: r"[\s\v]" if m[0] == r"\s" else m[0] if m[0].startswith("[^") else m[0].replace(r"\s", r"\s\v"), pattern)
    return spaces.replace(r"\b", "").replace("$", "")


def may_match(text: Column, patterns: list[str]) -> Column:
    """False only where none of the patterns matches: one automaton over a batch of texts, to be followed by the patterns themselves."""
    any_of = "(?is)(?:" + "|".join(_wide(p) for p in patterns) + ")"

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, any_of)

    return found(text)


def match_bits(text: Column, groups: list[list[str]]) -> Column:
    """One bit for each group of patterns (63 at most) of which one may match, as `may_match` says it; each text of a batch is tried once."""
    one = lambda patterns: "(?is)(?:" + "|".join(_wide(p) for p in patterns) + ")"
    any_of, each = one([p for g in groups for p in g]), [one(g) for g in groups]

    @F.arrow_udf("long")
    def bits(texts: pa.Array) -> pa.Array:
        hit = pc.fill_null(pc.match_substring_regex(texts, any_of), False)
        coded = texts.filter(hit).dictionary_encode()
        words = coded.dictionary
        held = np.zeros(len(words), np.int64)
        for i, p in enumerate(each):
            held |= pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False).astype(np.int64) << i
        out = np.zeros(len(texts), np.int64)
        out[hit.to_numpy(zero_copy_only=False)] = held[coded.indices.to_numpy(zero_copy_only=False)]
        return pa.array(out)

    return bits(text)


def words_found(text: Column, groups: list[tuple[str, list[str]]]) -> Column:
    """Names of the groups of which a word stands in the text, joined by commas; `contains_any` for long lists, a batch at once."""
    rows = [(name, "|".join(re.sub(r"([][(){}|+*?.^$\\])", r"\\\1", w.lower()) for w in words)) for name, words in groups]

    @F.arrow_udf("string")
    def names(texts: pa.Array) -> pa.Array:
        hits = [pc.if_else(pc.fill_null(pc.match_substring_regex(texts, p), False), n + ",", "") for n, p in rows]
        joined = pc.binary_join_element_wise(*hits, "") if len(hits) > 1 else hits[0]
        return pc.utf8_rtrim(joined, ",")

    return names(F.lower(text))


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def normalize_interface(name: Column) -> Column:
    value = F.replace(F.trim(F.coalesce(name, F.lit(""))), F.lit(" "), F.lit(""))
    out = None
    for pattern, prefix in fv.INTERFACE_ALIASES:
        tail = F.concat(F.lit(prefix), F.regexp_extract(value, ci(pattern), 2))
        out = F.when(matches(value, pattern), tail) if out is None else out.when(matches(value, pattern), tail)
    return out.otherwise(value)


def expand_vlans(value: Column) -> Column:
    """`10,20-22` to a sorted list of texts; `all` and `none` stay as they are."""
    clean = F.replace(F.trim(value), F.lit("add "), F.lit(""))
    low = F.lower(clean)

    def expand(part: Column) -> Column:
        part = F.trim(part)
        a = F.regexp_extract(part, r"^(\d+)-(\d+)$", 1).try_cast("decimal(38,0)")
        b = F.regexp_extract(part, r"^(\d+)-(\d+)$", 2).try_cast("decimal(38,0)")
        # ids end at 4094: what a range holds beyond is no VLAN
        a, b = F.when(a <= 4094, a).try_cast("int"), F.least(b, F.lit(4094)).try_cast("int")
        single = F.when(part.rlike(r"^\d+$"), part.try_cast("int"))
        return (
            F.when(a <= b, F.sequence(a, b))
            .when(single.isNotNull(), F.array(single))
            .otherwise(F.array().cast("array<int>"))
        )

    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(clean, ","), expand))))
    return F.when(low.isin("all", "none"), F.array(low)).otherwise(F.transform(numbers, lambda n: n.cast("string")))


def vlan_tokens(value: Column) -> Column:
    """List form used in trees: also split at `;` and blanks, first-seen order, ids up to 4094."""
    def expand(part: Column) -> Column:
        a = F.regexp_extract(part, r"^(\d{1,9})-(\d{1,9})$", 1).try_cast("int")
        b = F.least(F.regexp_extract(part, r"^(\d{1,9})-(\d{1,9})$", 2).try_cast("int"), F.lit(4094))
        vid = vlan_id(part)
        return (
            F.when(F.lower(part) == "all", F.array(F.lit("all")))
            .when(a <= b, F.transform(F.sequence(a, b), lambda n: n.cast("string")))
            .when(~part.contains("-") & vid.isNotNull(), F.array(vid))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.array_distinct(F.flatten(F.transform(F.split(value, r"[,;\s]+"), expand)))


def vlan_id(value: Column) -> Column:
    """First run of one to four digits, when it is a possible VLAN number."""
    digits = F.regexp_extract(value, r"\d{1,4}", 0)
    return F.when(digits.try_cast("int") <= 4094, digits)


def key_token(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "")


def hint_terms(value: Column) -> Column:
    """Distinct lower-case words, also split where camel case changes."""
    spaced = F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: t != ""))


def path_hint(path: Column) -> Column:
    return F.replace(F.lower(F.regexp_replace(path, "([a-z0-9])([A-Z])", "$1 $2")), F.lit("/"), F.lit("."))


def path_key(path: Column) -> Column:
    """Last token of a path that is a name, not an index."""
    tokens = F.filter(
        F.transform(F.split(path, r"[.\[\]/]+"), lambda t: F.trim(t)),
        lambda t: (t != "") & (t != "$") & ~t.rlike(r"^\d+$"),
    )
    return F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit("$"))


def stable_id(prefix: str, *parts: Column) -> Column:
    material = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(material), 1, 10))


def connector_fingerprint(kind: Column, when: Column, client: Column, message: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (kind, when, client, message)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def live_fingerprint(when: Column, client: Column, kind: Column, ap: Column, raw: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (when, client, kind, ap, raw)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def client_slug(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "-")
    return F.concat(F.lit("client-"), F.regexp_replace(dashed, "^-+|-+$", ""))


def ap_slug(name: Column) -> Column:
    dashed = F.regexp_replace(F.upper(name), r"[^\p{L}\p{N}]", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("AP-NEW"))


def redact_command(command: Column) -> Column:
    """Mask secrets of configuration commands, keep the shape of the line."""
    out = command
    for pattern, head, tail in fv.COMMAND_REDACTIONS:
        out = F.regexp_replace(out, pattern, f"${head}<redacted>" + (f"${tail}" if tail else ""))
    # few commands hold any of the words that the patterns need
    return F.when(command.rlike("(?i)secret|password|snmp-server|radius-server|wpa-psk"), out).otherwise(command)


def redact_secret(text: Column) -> Column:
    """`key = value` secrets anywhere in a text."""
    return F.regexp_replace(text, fv.SECRET_PATTERN, "$1=<redacted>")


def message_severity(message: Column, default: str = "Info") -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    out = None
    for severity, words in fv.MESSAGE_SEVERITY:
        test = contains_any(low, words)
        out = F.when(test, F.lit(severity)) if out is None else out.when(test, F.lit(severity))
    return out.otherwise(F.lit(default))


def message_event_type(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(low.contains("auth") & contains_any(low, ["fail", "reject", "deny"]), "authentication_failure")
        .when(contains_any(low, ["roam", "handoff"]), "roaming")
        .when(contains_any(low, ["dhcp", "lease"]), "dhcp_assignment")
        .when(low.contains("rogue"), "rogue_ap")
        .when(contains_any(low, ["disassoc", "deauth"]), "disassociation")
        .otherwise("association")
    )


def lookup(column: Column, table: dict, default=None) -> Column:
    """Constant lookup as one map literal."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), column)
    return found if default is None else F.coalesce(found, F.lit(default))


def clamp_percent(value: Column, already_percent: bool = False) -> Column:
    number = value.try_cast("double")
    if not already_percent:
        number = F.when(number <= 1, number * 100).otherwise(number)
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(100), F.bround(number).cast("int"))), F.lit(0))


def short_text(value: Column, limit: int = 300) -> Column:
    text = F.trim(F.translate(F.coalesce(value, F.lit("")), "\r\n", "  "))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def now_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def device_type_guess(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(contains_any(low, ["ip routing", "router ospf", "router eigrp"]), "router_or_l3_switch")
        .when(contains_any(low, ["switchport", "spanning-tree"]), "switch")
        .when(contains_any(low, ["wlan", "ssid"]), "wireless")
        .otherwise("network_device")
    )


def wireless_mode(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.contains("wpa3"), "wpa3").when(low.contains("wpa2"), "wpa2")
        .when(low.contains("wep"), "wep").when(low.contains("open"), "open").otherwise("unknown")
    )


def interface_mode(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.contains("switchport mode trunk"), "trunk")
        .when(low.contains("switchport mode access"), "access")
        .when(low.contains("ip address"), "routed").otherwise("unknown")
    )
