"""Rows of whole documents in one pass: the bytes of a variant are read where they lie, and no node carries a tree of its own.

`document_nodes` and `document_records` give what `tree.walk` with `tree.leaves` or `tree.records` gives. Texts, whole numbers,
booleans and nulls are read here; a value of any other type (decimals, doubles, dates ...) goes back as a variant, and Spark writes its text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import key_token
from ..session import reach

_ROWS = 8192  # rows of a batch given to Spark
_CHARS = 1 << 23  # characters of such a batch
_PLAIN = 1 << 14  # bytes of a container up to which its JSON text is written here
_NO_NAMES = b"\x01\x00\x00"  # variant metadata without names, for single values
_INTS = {3: 1, 4: 2, 5: 4, 6: 8}
_SIZES = {0: 1, 1: 1, 2: 1, 3: 2, 4: 3, 5: 5, 6: 9, 7: 9, 8: 6, 9: 10, 10: 18, 11: 5, 12: 9, 13: 9, 14: 5, 17: 9, 18: 9, 19: 9, 20: 17}
_DIGITS = re.compile("[0-9]+(?:\r\n|[\n\r\x85  ])?")
_VARIANT = pa.struct([pa.field("value", pa.binary(), False), pa.field("metadata", pa.binary(), False, {"variant": "true"})])


class _Odd(Exception):
    """A text that Spark has to write."""


@lru_cache(4096)
def _names(metadata: bytes) -> list[str]:
    size = (metadata[0] >> 6) + 1
    n = int.from_bytes(metadata[1 : 1 + size], "little")
    at = [int.from_bytes(metadata[1 + size * (i + 1) : 1 + size * (i + 2)], "little") for i in range(n + 1)]
    start = 1 + size * (n + 2)
    return [metadata[start + a : start + b].decode() for a, b in zip(at, at[1:])]


@lru_cache(65536)
def _token(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.lower())


@lru_cache(65536)
def _step(name: str) -> str:
    return "." + name.replace(".", "_")


@lru_cache(65536)
def _path_key(path: str) -> str:
    """`functions.text.path_key` of a path."""
    for token in reversed(re.split(r"[.\[\]/]+", path)):
        token = token.strip(" ")
        if token not in ("", "$") and not _DIGITS.fullmatch(token):
            return token
    return "$"


class _Tree:
    """Reader of one variant; a node is the place of its first byte."""

    def __init__(self, value: bytes, metadata: bytes) -> None:
        self.value, self.metadata, self.names = value, metadata, _names(metadata)

    def kind(self, at: int) -> str:
        head = self.value[at]
        basic, info = head & 3, head >> 2
        if basic >= 2:
            return "object" if basic == 2 else "array"
        if basic == 1:
            return "string"
        if info in _INTS:
            return "integer"
        return "null" if info == 0 else "boolean" if info <= 2 else "number" if 7 <= info <= 10 else "string"

    def _layout(self, at: int) -> tuple[int, int, int, int, int]:
        """Number of children, size and place of their ids, size and place of their offsets."""
        info, basic = self.value[at] >> 2, self.value[at] & 3
        offset = (info & 3) + 1
        ids = ((info >> 2) & 3) + 1 if basic == 2 else 0
        count = 4 if (info >> 4 if basic == 2 else info >> 2) & 1 else 1
        n = int.from_bytes(self.value[at + 1 : at + 1 + count], "little")
        return n, ids, at + 1 + count, offset, at + 1 + count + n * ids

    def _offsets(self, n: int, size: int, at: int) -> tuple[list[int] | bytes, int]:
        """Offsets of the children, and where their bytes begin."""
        end = at + size * (n + 1)
        raw = self.value[at : end - size]
        return raw if size == 1 else [int.from_bytes(raw[i : i + size], "little") for i in range(0, n * size, size)], end

    def entries(self, at: int) -> list[tuple[str, int]]:
        n, ids, id_at, size, off_at = self._layout(at)
        offsets, base = self._offsets(n, size, off_at)
        raw = self.value[id_at : id_at + n * ids]
        which = raw if ids == 1 else [int.from_bytes(raw[i : i + ids], "little") for i in range(0, n * ids, ids)]
        names = self.names
        return [(names[k], base + o) for k, o in zip(which, offsets)]

    def items(self, at: int) -> list[int]:
        n, _, _, size, off_at = self._layout(at)
        offsets, base = self._offsets(n, size, off_at)
        return [base + o for o in offsets]

    def raw(self, at: int) -> dict:
        """The node as a variant of its own."""
        head = self.value[at]
        basic, info = head & 3, head >> 2
        if basic >= 2:
            n, _, _, size, off_at = self._layout(at)
            last = off_at + n * size
            return {"value": self.value[at : last + size + int.from_bytes(self.value[last : last + size], "little")], "metadata": self.metadata}
        if basic == 1 or info in (15, 16):
            end = at + 1 + info if basic == 1 else at + 5 + int.from_bytes(self.value[at + 1 : at + 5], "little")
        else:
            end = at + _SIZES[info] if info in _SIZES else len(self.value)
        return {"value": self.value[at:end], "metadata": _NO_NAMES}

    def plain(self, at: int):
        """The node in Python; raises where it holds what Spark has to write."""
        value = self.value
        head = value[at]
        basic, info = head & 3, head >> 2
        if basic == 1:
            return value[at + 1 : at + 1 + info].decode()
        if basic == 2:
            return {k: self.plain(x) for k, x in self.entries(at)}
        if basic == 3:
            return [self.plain(x) for x in self.items(at)]
        if info <= 2:
            return (None, True, False)[info]
        if info in _INTS:
            return int.from_bytes(value[at + 1 : at + 1 + _INTS[info]], "little", signed=True)
        if info == 16:
            return value[at + 5 : at + 5 + int.from_bytes(value[at + 1 : at + 5], "little")].decode()
        raise _Odd

    def text(self, at: int) -> str | None:
        """The node as Spark casts it to a text; raises where only Spark can say it."""
        if self.value[at] & 3 < 2:
            x = self.plain(at)
            return x if isinstance(x, str) or x is None else str(x).lower()
        if len(self.raw(at)["value"]) > _PLAIN:
            raise _Odd
        text = json.dumps(self.plain(at), ensure_ascii=False, separators=(",", ":"))
        if "\\u00" in text:  # escapes are spelled in another way there
            raise _Odd
        return text

    def cell(self, at: int) -> tuple[str | None, dict | None]:
        """Text of a node, or the node itself for Spark."""
        try:
            return self.text(at), None
        except _Odd:
            return None, self.raw(at)


def _node_rows(tree: _Tree) -> Iterator[tuple]:
    """Rows of `document_nodes` with their size; the commonest values are read in the loop itself."""
    value, entries, items, names = tree.value, tree.entries, tree.items, _step
    todo = [("$", 0, 0)]
    while todo:
        path, depth, at = todo.pop()
        head = value[at]
        basic = head & 3
        if basic == 1:
            text = value[at + 1 : at + 1 + (head >> 2)].decode()
            yield len(text), path, _path_key(path), depth, "string", text, None, None
        elif basic == 2:
            held = entries(at)
            yield 32 * len(held), path, _path_key(path), depth, "object", None, None, [k for k, _ in held]
            todo += [(path + names(k), depth + 1, x) for k, x in held]
        elif basic == 3:
            yield 0, path, _path_key(path), depth, "array", None, None, None
            todo += [(f"{path}[{i}]", depth + 1, x) for i, x in enumerate(items(at))]
        else:
            text, odd = tree.cell(at)
            yield len(text or ""), path, _path_key(path), depth, tree.kind(at), text, odd, None


_WRAPPERS = frozenset(fv.WRAPPER_KEYS)
_NOTHING = ("", "[]", "{}")


def _fields(tree: _Tree, at: int, levels: int) -> tuple[list[tuple], bool]:
    """Own fields of an object, those lifted from its wrappers, and the one that it names as a pair; and whether Spark has to write any."""
    out: list[tuple] = []
    value, cell, odd_ones = tree.value, tree.cell, 0

    def add(place: int, *tokens: str | None, name: dict | None = None) -> None:
        nonlocal odd_ones
        head = value[place]
        text, odd = (value[place + 1 : place + 1 + (head >> 2)].decode(), None) if head & 3 == 1 else cell(place)
        if odd is not None or (text is not None and text not in _NOTHING):
            odd_ones += odd is not None or name is not None
            out.extend([(k, text, odd, name) for k in tokens])

    def pair(entries: list[tuple[str, int]]) -> None:
        held = dict(entries)

        def pick(keys: list[str]) -> int | None:
            for k in keys:
                if k in held:
                    text, odd = cell(held[k])
                    if text or odd is not None:
                        return held[k]
            return None

        name = pick(fv.PAIR_NAME_KEYS)
        place = None if name is None else pick(fv.PAIR_VALUE_KEYS)
        if place is not None:
            text, odd = cell(name)
            add(place, None if odd is not None else _token(text), name=odd)

    def lift(entries: list[tuple[str, int]], left: int) -> None:
        for k, x in entries:
            if k not in _WRAPPERS:
                continue
            basic = value[x] & 3
            if basic == 2:
                inner = tree.entries(x)
                for k2, y in inner:
                    if value[y] & 3 != 2:
                        add(y, _token(k2), _token(f"{k}_{k2}"))
                if left > 1:
                    lift(inner, left - 1)
            elif basic == 3:
                for y in tree.items(x):
                    if value[y] & 3 == 2:
                        pair(tree.entries(y))

    entries = tree.entries(at)
    for k, x in entries:
        if value[x] & 3 != 2:
            add(x, _token(k))
    lift(entries, levels)
    pair(entries)
    return out, odd_ones > 0


@lru_cache(65536)
def _terms(path: str) -> list[str]:
    """Lower-case words of a path, as `functions.text.path_hint` cuts them."""
    return re.sub("[^a-z0-9]+", " ", re.sub("([a-z0-9])([A-Z])", r"\1 \2", path).lower()).split(" ")


def _record_rows(levels: int) -> Callable[[_Tree], Iterator[tuple]]:
    def rows(tree: _Tree) -> Iterator[tuple]:
        value = tree.value
        todo = [("$", 0, 0)]
        while todo:
            path, depth, at = todo.pop()
            basic = value[at] & 3
            if basic == 2:
                fields, odd = _fields(tree, at, levels)
                size = sum([len(f[1] or "") + 16 for f in fields])
                plain = None if odd else [f[:2] for f in fields]
                yield size, path, depth, plain, fields if odd else None, _terms(path)
                todo += [(path + _step(k), depth + 1, x) for k, x in tree.entries(at) if value[x] & 3 >= 2]
            elif basic == 3:
                todo += [(f"{path}[{i}]", depth + 1, x) for i, x in enumerate(tree.items(at)) if value[x] & 3 >= 2]

    return rows


def _read(docs: DataFrame, rows_of: Callable[[_Tree], Iterator[tuple]], names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    """`file_id` and the rows of each tree, in batches of bounded size whatever a document holds."""
    reach(docs.sparkSession)
    known = docs.filter("v is not null").select("file_id", "v")
    kind = known.schema["file_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, trees = batch.column(0), batch.column(1)
            values, metadata = trees.field("value"), trees.field("metadata")
            owner: list[int] = []
            rows: list[tuple] = []
            chars = 0

            def given() -> pa.RecordBatch:
                cells = list(zip(*rows))[1:]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int64())), *[pa.array(c, t) for c, t in zip(cells, types)]], ["file_id", *names])

            for i in range(batch.num_rows):
                for row in rows_of(_Tree(values[i].as_py(), metadata[i].as_py())):
                    owner.append(i)
                    rows.append(row)
                    chars += row[0] + len(row[1])
                    if len(rows) >= _ROWS or chars >= _CHARS:
                        yield given()
                        owner, rows, chars = [], [], 0
            if rows:
                yield given()

    return known.mapInArrow(read, f"file_id {kind}, {schema}")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def document_nodes(docs: DataFrame) -> DataFrame:
    """Every node of every document: `file_id, path, key, depth, type, value, keys`; leaves have a value, objects their keys."""
    names = ["path", "key", "depth", "type", "value", "x", "keys"]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), _VARIANT, pa.list_(pa.string())]
    rows = _read(docs, _node_rows, names, types, "path string, key string, depth int, type string, value string, x variant, keys array<string>")
    value = F.when(~F.col("type").isin("object", "array"), F.coalesce("value", _text(F.col("x")), F.lit("")))
    return rows.select("file_id", "path", "key", "depth", "type", value.alias("value"), "keys")


def document_leaves(docs: DataFrame) -> DataFrame:
    """`tree.leaves` of whole documents."""
    return document_nodes(docs).filter(~F.col("type").isin("object", "array")).select("file_id", "path", "key", "type", "value")


def document_records(docs: DataFrame, levels: int = 2) -> DataFrame:
    """`tree.records` of whole documents."""
    plain = pa.struct([("k", pa.string()), ("v", pa.string())])
    field = pa.struct([("k", pa.string()), ("v", pa.string()), ("x", _VARIANT), ("kx", _VARIANT)])
    names, types = ["path", "depth", "plain", "odd", "terms"], [pa.string(), pa.int32(), pa.list_(plain), pa.list_(field), pa.list_(pa.string())]
    rows = _read(docs, _record_rows(levels), names, types,
                 "path string, depth int, plain array<struct<k:string,v:string>>, odd array<struct<k:string,v:string,x:variant,kx:variant>>, terms array<string>")
    said = F.transform("odd", lambda s: F.struct(F.coalesce(s["k"], key_token(_text(s["kx"]))).alias("k"), F.coalesce(s["v"], _text(s["x"])).alias("v")))
    whole = F.filter(said, lambda s: s["v"].isNotNull() & ~s["v"].isin(*_NOTHING))
    return rows.select("file_id", "path", "depth", F.explode(F.array(F.coalesce("plain", whole))).alias("fields"), "terms")
