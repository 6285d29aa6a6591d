"""Pieces of checking SQL in the DuckDB dialect."""

from __future__ import annotations

from .. import fixed_values as fv
from .bindings import CONFIG_LINES_SQL


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def m(pattern: str, col: str = "text") -> str:
    return f"regexp_matches({col}, {lit(pattern)}, 'i')"


def x(pattern: str, group: int = 1, col: str = "text") -> str:
    return f"nullif(regexp_extract({col}, {lit(pattern)}, {group}, 'i'), '')"


def xe(pattern: str, group: int = 1, col: str = "text") -> str:
    return f"case when {m(pattern, col)} then regexp_extract({col}, {lit(pattern)}, {group}, 'i') end"


def norm(col: str) -> str:
    """Interface name in its long form."""
    value = f"replace(trim(coalesce({col}, '')), ' ', '')"
    arms = " ".join(
        f"when {m(p, value)} then concat('{prefix}', regexp_extract({value}, {lit(p)}, 2, 'i'))" for p, prefix in fv.INTERFACE_ALIASES)
    return f"case {arms} else {value} end"


def vlan_text(col: str) -> str:
    """Expanded VLAN list, joined by commas; null stays null."""
    clean = f"replace(trim({col}), 'add ', '')"
    parts = (
        f"list_transform(string_split({clean}, ','), lambda p: case "
        "when regexp_full_match(trim(p), '[0-9]{1,5}-[0-9]{1,5}') then range(cast(split_part(trim(p), '-', 1) as bigint), cast(split_part(trim(p), '-', 2) as bigint) + 1) "
        "when regexp_full_match(trim(p), '[0-9]{1,9}') then [cast(trim(p) as bigint)] else cast([] as bigint[]) end)"
    )
    return f"case when lower({clean}) in ('all', 'none') then lower({clean}) else array_to_string(list_sort(list_distinct(flatten({parts}))), ',') end"


def carried(expr: str, name: str) -> str:
    return f"last_value({expr} ignore nulls) over w as {name}"


def with_lines(body: str, *, ctes: str = "") -> str:
    """Full statement over the configuration lines."""
    extra = f", {ctes}" if ctes else ""
    return f"with {CONFIG_LINES_SQL}{extra} {body}"


def states_cte(name: str, columns: dict[str, str]) -> str:
    cols = ", ".join(carried(e, n) for n, e in columns.items())
    return (
        f"{name} as (select file_id, line_no, text, {cols} from config_lines "
        "window w as (partition by file_id order by line_no rows between unbounded preceding and current row))"
    )


def block_cte(name: str, kind: str) -> str:
    """Lines inside open blocks of one kind: hl header line, ht header text."""
    mine, other = m(fv.BLOCK_HEADERS[kind]), m(fv.BLOCK_CLOSER)
    cols = {
        "hl": f"case when {mine} or {other} then line_no end",
        "ht": f"case when {mine} or {other} then text end",
        "ho": f"case when {mine} then true when {other} then false end",
    }
    return states_cte(f"_{name}", cols) + f", {name} as (select * from _{name} where ho)"


def redact(col: str) -> str:
    out = col
    for pattern, head, tail in fv.COMMAND_REDACTIONS:
        replacement = f"\\{head}<redacted>" + (f"\\{tail}" if tail else "")
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return out


def net_cidr(ip: str, mask: str) -> str:
    """Network of a valid dotted address and contiguous netmask."""
    def num(a: str) -> str:
        p = lambda i: f"cast(split_part({a}, '.', {i}) as bigint)"
        return f"({p(1)} * 16777216 + {p(2)} * 65536 + {p(3)} * 256 + {p(4)})"

    net = f"({num(ip)} & {num(mask)})"
    dotted = "concat(" + ", '.', ".join(f"cast(({net} >> {s}) & 255 as varchar)" for s in (24, 16, 8, 0)) + ")"
    return f"case when {ip} is not null then concat({dotted}, '/', bit_count({num(mask)})) end"
