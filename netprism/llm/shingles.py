"""Near duplicates by shared shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Bands of min-hashes give candidates: two sets of similarity j share one of 25 bands of 5 with 1 - (1 - j^5)^25, 99.995 % at
0.8. Equal sets are one node. A candidate becomes a link only by the exact similarity of the two whole sets.

1. Bands of many nodes: each node is held against one pivot of the band, links are joined to components, and nodes that are
   still apart meet another pivot in the next round, for as long as rounds bring links. A round is linear in the rows.
2. All bands that still hold nodes of several components: their nodes are dealt to cells of a bounded number of rows, a
   large band as pairs of blocks; a component with blocks of its own is not held against itself. A cell compares every two
   nodes of different components: sizes, then the min-hashes they agree in, then the sets. Only links leave it.

With `prints`, the SimHash components of `simhash` come first (all fingerprints, every pair within its radius): they are links
like any other, and the bands then compare only what is still apart. What both methods link is one component.

So no link depends on how many documents share a band. A pair of 80 % is left out where its min-hashes agree in under 62 %,
five standard deviations below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import simhash
from .common import components, small, written

WORDS, HASH_SEED = 5, 42
#: Least similarity of a link, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 25, 5
#: Rows of a block; bands of more meet pivots first, while a round links this share of their rows.
BLOCK_ROWS, PROGRESS = 2048, 0.05
#: Least share of equal min-hashes (a byte of each is kept) for which sets are compared.
LEAST_EQUAL = 0.62
_BLOCK = 1 << 12
_DRAWN = np.random.default_rng(HASH_SEED)
_TIMES = _DRAWN.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAWN.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def hashes(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text; a shorter text is one shingle, one without words has none."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(WORDS)), strict=False)) if len(parts) >= WORDS else [b" ".join(parts)]
    return np.unique(np.array([xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles], np.uint64))


def sketched(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band of min-hashes, and a byte of each min-hash; a set without shingles has none."""
    if not len(h):
        return np.zeros(0, np.int64), b""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), _BLOCK):
        least = np.minimum(least, (h[at : at + _BLOCK, None] * _TIMES + _PLUS).min(axis=0))
    keys = np.array([xxhash.xxh64_intdigest(row.tobytes()) for row in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)
    return keys, (least >> np.uint64(40)).astype(np.uint8).tobytes()


def sketch_column(text: Column) -> Column:
    """(node, size, keys, sig): a hash of the whole set, the number of shingles, the bands, bytes of the min-hashes."""

    @F.pandas_udf("node bigint, size bigint, keys array<bigint>, sig binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            rows = []
            for t in series:
                h = hashes(t)
                rows.append((int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).astype(np.int64)), len(h), *sketched(h)))
            yield pd.DataFrame(rows, columns=["node", "size", "keys", "sig"])

    return sketch(text.cast("binary"))


def hash_column(text: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([hashes(t).view(np.int64) for t in series], dtype=object)

    return run(text.cast("binary"))


def _open(rows: DataFrame) -> DataFrame:
    """Bands that hold nodes of several components, with their number of rows; rows: band, key, node, root."""
    return rows.groupBy("band", "key").agg(F.count("*").alias("rows"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "key", "rows")


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have the least similarity or more; whole: node, h."""
    num, den = LEAST
    both = F.size(F.array_intersect("g", "h")).cast("long")
    joined = pairs.join(whole.select(F.col("node").alias("a"), F.col("h").alias("g")), "a").join(whole.select(F.col("node").alias("b"), "h"), "b")
    return joined.where(both * (num + den) >= (F.size("g") + F.size("h")) * num).select("a", "b")


def _to_pivots(rows: DataFrame, bands: DataFrame, turn: int) -> DataFrame:
    """Distinct (a, b): every node of these bands and the band's pivot of this turn, where they are apart and of like size."""
    here = rows.join(bands, ["band", "key"])
    mine = F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), F.col("node").alias("p"), F.col("size").alias("t"), F.col("root").alias("r"))
    pivots = here.groupBy("band", "key").agg(F.min(mine).alias("m")).select("band", "key", "m.p", "m.t", "m.r")
    num, den = LEAST
    met = here.join(pivots, ["band", "key"]).where((F.col("root") != F.col("r")) & (F.least("size", "t") * den >= F.greatest("size", "t") * num))
    return met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()


def linked_in_cell(rows: list[tuple], cross: bool) -> list[tuple[int, int]]:
    """Links that join components of a cell; rows: node, root, size, sig, h, side. cross: only between the two sides."""
    node, root, size, sig, h, side = zip(*rows, strict=True)
    root, size, side = np.array(root), np.array(size), np.array(side)
    sig = np.frombuffer(b"".join(sig), np.uint8).reshape(len(rows), -1)
    sets: dict[int, np.ndarray] = {}
    up = {r: r for r in set(root.tolist())}
    num, den = LEAST

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def own(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.unique(np.frombuffer(h[i], np.uint32))
        return sets[i]

    out = []
    for i in range(len(rows) - 1):
        rest = slice(i + 1, None)
        ok = (root[rest] != root[i]) & (np.minimum(size[rest], size[i]) * den >= np.maximum(size[rest], size[i]) * num)
        if cross:
            ok &= side[rest] != side[i]
        at = np.flatnonzero(ok) + i + 1
        if not len(at):
            continue
        equal = (sig[at] == sig[i]).sum(axis=1)
        order = np.argsort(-equal, kind="stable")
        for j in at[order[: int((equal >= LEAST_EQUAL * sig.shape[1]).sum())]].tolist():
            x, y = find(int(root[i])), find(int(root[j]))
            if x == y:
                continue
            # 32 bits of a hash are kept: shingles of one set that fall together are allowed for
            a, b = own(i), own(j)
            lost = int(size[i]) - len(a) + int(size[j]) - len(b)
            if (len(np.intersect1d(a, b, assume_unique=True)) + lost) * (num + den) >= (int(size[i]) + int(size[j])) * num:
                up[max(x, y)] = min(x, y)
                out.append((min(node[i], node[j]), max(node[i], node[j])))
    return out


def _by_cells(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b) of nodes in cells of the open bands that are linked; rows: band, key, node, size, root."""
    here = rows.join(_open(rows).select("band", "key"), ["band", "key"])
    parts = cut_lineage(here.groupBy("band", "key", "root").count())
    large = parts.where(F.col("count") > BLOCK_ROWS // 2).select("band", "key", "root", F.ceil(F.col("count") / BLOCK_ROWS).cast("long").alias("cuts"))
    rest = parts.where(F.col("count") <= BLOCK_ROWS // 2).groupBy("band", "key").agg(F.ceil(F.sum("count") / BLOCK_ROWS).cast("long").alias("blocks"))
    placed = here.join(large, ["band", "key", "root"], "left").join(rest, ["band", "key"], "left").select(
        "band", "key", "node", "size", "root", F.when(F.col("cuts").isNotNull(), F.col("root")).alias("alone"),
        F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("node"), "cuts")).otherwise(F.pmod(F.xxhash64("root", "band"), "blocks")).alias("block"))
    placed = cut_lineage(placed)
    blocks = placed.select("band", "key", "alone", "block").distinct()
    # every two blocks of a band, but not two of one component
    name = F.struct(F.coalesce(F.col("alone").cast("string"), F.lit("")).alias("a"), "block")
    each = blocks.withColumn("b", name).groupBy("band", "key").agg(F.sort_array(F.collect_list("b")).alias("all"))  # rows / BLOCK_ROWS of them
    first = each.select("band", "key", F.explode("all").alias("x"), "all")
    two = first.select("band", "key", "x", F.explode(F.filter("all", lambda y: (y >= F.col("x")) & ((y["a"] != F.col("x.a")) | (y["a"] == "")))).alias("y"))
    cell = two.withColumn("cell", F.xxhash64("band", "key", "x.a", "x.block", "y.a", "y.block"))
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("b")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("b")), F.struct(F.lit(1).alias("side"), F.col("y").alias("b"))))
    seats = cell.select("band", "key", "cell", (F.col("x") != F.col("y")).alias("cross"), F.explode(sides).alias("s")).select("band", "key", "cell", "cross", "s.side", "s.b")
    seated = placed.withColumn("b", name).join(seats, ["band", "key", "b"]).select("cell", "cross", "side", "node", "root", "size")
    short = whole.select("node", "sig", low_bytes("h").alias("h"))
    full = seated.join(short, "node").select("cell", "cross", "node", "root", "size", "sig", "h", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = [], None
        for pdf in batches:
            out = []
            for cell_, cross, *row in pdf.itertuples(index=False, name=None):
                if held and now[0] != cell_:
                    out += linked_in_cell(held, now[1])
                    held = []
                now = (cell_, cross)
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
        if held and (out := linked_in_cell(held, now[1])):
            yield pd.DataFrame(out, columns=["a", "b"])

    return full.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "a long, b long").distinct()


def low_bytes(h: str) -> Column:
    """The low 32 bits of each hash, one after the other."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([np.asarray(x, np.int64).astype(np.uint32).tobytes() for x in series], dtype=object)

    return run(h)


def print_links(marked: DataFrame) -> DataFrame:
    """(a, b): the nodes of each SimHash component, linked with its smallest one; marked: node, fp. Rows grow as the nodes."""
    own = cut_lineage(marked.select("fp", "node").distinct())
    prints = cut_lineage(own.select("fp").distinct())
    roots = components(simhash.links(prints, prints.count()).select("a", "b")).withColumnRenamed("node", "fp")
    grouped = own.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    hubs = grouped.groupBy("root").agg(F.min("node").alias("a"))
    return grouped.join(hubs, "root").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def links(docs: DataFrame, text: str, sets: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of like nodes that join all nodes linked through bands, or by the links found before.

    sets: node, size, keys, sig, read (hash of a text that has the set).
    """
    own = sets.select("node", "size", F.posexplode("keys").alias("band", "key"))
    shared = own.groupBy("band", "key").count().where("count > 1").select("band", "key")
    own = written(own.join(shared, ["band", "key"], "left_semi"))
    wanted = cut_lineage(sets.select("node", "read", "sig").join(own.select("node").distinct(), "node", "left_semi"))
    texts = docs.select(docs[text].alias("t")).withColumn("read", F.xxhash64("t")).join(small(wanted, wanted.count()), "read").groupBy("node").agg(F.first("t").alias("t"), F.first("sig").alias("sig"))
    whole = written(texts.select("node", "sig", hash_column(F.col("t")).alias("h")))

    def rooted(found: DataFrame | None) -> DataFrame:
        if found is None:
            return own.withColumn("root", F.col("node"))
        return own.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))

    turn = 0
    while True:
        rows = cut_lineage(rooted(found).select("band", "key", "node", "size", "root"))
        many = cut_lineage(_open(rows).where(F.col("rows") > BLOCK_ROWS))
        n = many.agg(F.sum("rows")).first()[0]
        if not n:
            break
        new = cut_lineage(_verified(cut_lineage(_to_pivots(rows, many.select("band", "key"), turn)), whole))
        found, turn = new if found is None else cut_lineage(found.union(new)), turn + 1
        if new.count() < PROGRESS * n:
            break
    rows = rooted(found).select("band", "key", "node", "size", "root")
    last = cut_lineage(_verified(cut_lineage(_by_cells(rows, whole)), whole))
    return last if found is None else found.union(last)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", prints: bool = False) -> DataFrame:
    """(key, component_id, root, read) for every row; component_id is the component's smallest non-null key, read a hash of the text.

    prints: texts within the SimHash radius are linked too. Null, empty and blank texts are duplicates of each other. Repeated rows each get a row. Other columns are not read.
    """
    fp = [simhash.fingerprint_column(F.col("t"))[0].alias("fp")] if prints else []
    marked = docs.select(docs[key].alias("id"), docs[text].alias("t")).select("id", F.xxhash64("t").alias("read"), sketch_column(F.col("t")).alias("k"), *fp)
    marked = cut_lineage(marked.select("id", "read", "k.*", *(["fp"] if prints else [])))
    first = cut_lineage(marked.groupBy("node").agg(F.min("id").alias("least"), F.first("read").alias("read"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sig").alias("sig")))
    found = cut_lineage(print_links(marked)) if prints else None
    roots = components(links(docs, text, first.select("node", "size", "keys", "sig", "read"), found))
    joined = first.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(ids, "root").select("node", "component_id", "root")
    return marked.join(named, "node").select(F.col("id").alias(key), "component_id", "root", "read")


def one_each(docs: DataFrame, key: str = "doc_id", text: str = "text", prints: bool = False) -> DataFrame:
    """docs with one row of each component: that of its smallest key (of several such rows, one); rows keep their columns as they were."""
    found = cut_lineage(near_duplicates(docs, key, text, prints).withColumnRenamed(key, "id"))
    if found.groupBy("id").count().where("id is null or count > 1").isEmpty():
        dropped = cut_lineage(found.where("id <> component_id").select(F.col("id").alias(key)))
        return docs.join(small(dropped, dropped.count()), key, "left_anti").select(*docs.columns)
    # missing or repeated keys: a row is told by key and text
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "read")).alias("first")).select(F.col("first.id").alias("one"), F.col("first.read").alias("its"))
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[key].alias("id"), F.xxhash64(docs[text]).alias("read"))
    return marked.join(first, F.col("id").eqNullSafe(F.col("one")) & (F.col("read") == F.col("its"))).dropDuplicates(["id", "read"]).select("doc.*")
