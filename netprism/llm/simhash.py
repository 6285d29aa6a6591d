"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within `radius` differing bits are linked; a component is what links reach. Candidates come from partitions
of the 64 bits: correlated bits are grouped together, so that the other partitions tell more, and every partition i gets
a threshold t_i (-1: not probed) with sum(t_i + 1) = radius + 1, so that any linked pair differs by t_i or less in some
partition. A dynamic program picks partitions and thresholds by candidate counts estimated over all fingerprints. Keys
that many fingerprints share are not paired: their fingerprints meet at neighbours of half the radius instead, of which
no key can have more than 65, so a hot key costs as much per fingerprint as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import components, small

SHINGLE_WORDS, RADIUS, HASH_SEED = 3, 2, 42
#: A key with more fingerprints is not paired but covered (see above).
PAIRED_ROWS = 64
#: Numbers of partitions that are weighed against each other.
PARTITIONS = (1, 2, 3, 4)
_BLOCK = 1 << 15
_MIX = 0xBF58476D1CE4E5B9


def fingerprints(text: bytes | None, words: int = SHINGLE_WORDS, count: int = 1) -> list[int]:
    """Unsigned 64-bit SimHashes of a whole text, 0 without words; the first is of the shingles' hashes, others of these hashes mixed."""
    parts = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not parts:
        return [0] * count
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, HASH_SEED) for s in shingles], dtype="<u8")
    ones = np.zeros((count, 64), np.int64)
    for at in range(0, len(hashes), _BLOCK):
        for k in range(count):
            h = hashes[at : at + _BLOCK]
            if k:
                h = (h ^ h >> np.uint64(31 - k)) * np.uint64(_MIX + 2 * k)
                h = (h ^ h >> np.uint64(29)) * np.uint64(_MIX)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += bits.sum(axis=0, dtype=np.int32)
    return [int(x) for x in np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8").ravel()]


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    return fingerprints(text, words)[0]


def fingerprint_column(text: Column, words: int = SHINGLE_WORDS, count: int = 1) -> Column:
    """The fingerprints as signed longs with the same bits."""

    @F.pandas_udf("array<bigint>")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            table = np.array([fingerprints(t, words, count) for t in series], dtype=np.uint64).reshape(len(series), count)
            yield pd.Series(list(table.view(np.int64)))

    return prints(text.cast("binary"))


def hexed(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(bits) -> int:
    return _signed(sum(1 << int(b) for b in bits))


def bit_counts(prints: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints have both bits; every task adds up its own, so the driver gets 4096 sums."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((64, 64))
        for pdf in batches:
            for at in range(0, len(pdf), _BLOCK):
                rows = np.ascontiguousarray(pdf["fp"].to_numpy(np.int64)[at : at + _BLOCK]).view(np.uint8).reshape(-1, 8)
                x = np.unpackbits(rows, axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
        if total.any():
            yield pd.DataFrame({"i": np.arange(4096), "c": total.ravel().astype(np.int64)})

    out = np.zeros(4096)
    for r in prints.mapInPandas(add, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).collect():
        out[r["i"]] = r["c"]
    return out.reshape(64, 64)


def grouped(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in so many groups of even width, correlated ones together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    tied = np.abs(both / max(n, 1) - np.outer(p, p)) / spread
    np.fill_diagonal(tied, 0)
    left, out = set(range(64)), []
    for g in range(parts):
        width = len(left) // (parts - g)
        first = max(left, key=lambda b: (tied[b, sorted(left)].max(), -b))
        group = [first]
        left.discard(first)
        while len(group) < width:
            b = max(left, key=lambda x: (tied[x, group].sum(), -x))
            group.append(b)
            left.discard(b)
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """The least-cost thresholds t_i with sum(t_i + 1) = radius + 1; costs[i][t] for t from 0 to radius."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, radius + 1):
                if used + t + 1 <= radius + 1:
                    now = (c + (row[t] if t >= 0 else 0.0), [*ts, t])
                    step[used + t + 1] = min(step.get(used + t + 1, now), now)
        best = step
    return best[radius + 1]


def plan(prints: DataFrame, n: int, radius: int = RADIUS, paired: int = PAIRED_ROWS) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of each partition to probe."""
    both = bit_counts(prints)
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    odds = (1 - agree) / agree
    options = {m: grouped(both, n, m) for m in PARTITIONS}
    keys = [(m, i, _mask(bits)) for m, groups in options.items() for i, bits in enumerate(groups)]
    spread = prints.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for m, i, mask in keys])).alias("k"))
    sizes = spread.groupBy("k.m", "k.i", "k.key").count()
    met = {(r["m"], r["i"]): r["pairs"] for r in sizes.groupBy("m", "i").agg(F.sum(F.least(F.col("count"), F.lit(paired)).cast("double") * F.col("count") + F.when(F.col("count") > paired, 65 * F.col("count")).otherwise(0)).alias("pairs")).collect()}
    best = None
    for m, groups in options.items():
        costs = []
        for i, bits in enumerate(groups):
            near = [1.0, odds[bits].sum()] + [sum(np.prod(odds[list(c)]) for c in combinations(bits, t)) if t == 2 else odds[bits].sum() ** t for t in range(2, radius + 1)]
            costs.append([2.0 * n * sum(comb(len(bits), k) for k in range(t + 1)) + met.get((m, i), 0.0) * sum(near[: t + 1]) for t in range(radius + 1)])
        cost, ts = allocate(costs, radius)
        if best is None or cost < best[0]:
            best = (cost, [(_mask(b), b, t) for b, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def _flips(bits, most: int) -> list[int]:
    return [_mask(c) for k in range(most + 1) for c in combinations(bits, k)]


def links(prints: DataFrame, n: int, radius: int = RADIUS, paired: int = PAIRED_ROWS) -> DataFrame:
    """(s, a, b): links that join the same fingerprints as all pairs within the radius do.

    prints: distinct fp, n of them; with a column s, fingerprints of different s don't meet, and n is the number of s = 0.
    """
    if "s" not in prints.columns:
        prints = prints.withColumn("s", F.lit(0))
    parts = plan(prints.where("s = 0"), n, radius, paired)
    own = prints.select("s", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, (m, _, _) in enumerate(parts)])).alias("k")).select("s", "fp", "k.*")
    probes = own
    if any(t for _, _, t in parts):
        masks = F.array(*[F.array(*[F.lit(x).cast("long") for x in _flips(bits, t)]) for _, bits, t in parts])
        probes = own.select("s", "fp", "i", F.explode(F.transform(masks[F.col("i")], lambda x: x.bitwiseXOR(F.col("key")))).alias("key"))
    on = ["s", "i", "key"]
    hot = cut_lineage(own.groupBy(*on).count().where(F.col("count") > paired).select(*on))
    n_hot = hot.count()
    asked = probes.join(small(hot, n_hot), on, "left_anti") if n_hot else probes
    pairs = asked.withColumnRenamed("fp", "a").join(own.withColumnRenamed("fp", "b"), on)
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    found = pairs.where(near).select("s", "a", "b")
    if not n_hot:
        return found
    many = probes.join(small(hot, n_hot), on, "left_semi").select("s", "fp").distinct()
    around = many.select("s", "fp", F.explode(F.array(*[F.lit(x).cast("long") for x in _flips(range(64), (radius + 1) // 2)])).alias("flip")).select("s", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    if radius % 2 == 0:  # all that share a key are linked: half the radius and half again
        met = around.withColumn("b", F.min("fp").over(Window.partitionBy("s", "key"))).where("fp <> b").select("s", F.col("fp").alias("a"), "b")
    else:
        met = around.withColumnRenamed("fp", "a").join(around.withColumnRenamed("fp", "b"), ["s", "key"]).where(near).select("s", "a", "b")
    return found.union(met).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, paired: int = PAIRED_ROWS, count: int = 1) -> DataFrame:
    """(key, fp, component_id, root, prints) for every row; root tells components apart, fp is the first fingerprint.

    With a count over 1, texts are linked if any of so many fingerprints are, each made of other bits of the same hashes:
    copies that one fingerprint parts by a bit too many are often kept together by another.

    Null, empty and blank texts have fingerprint 0 and are linked like any other; repeated rows each get a row. The
    component's id is its smallest non-null key (null if all are null). Empty tables give no rows. Other columns are not
    read, so their names don't matter.
    """
    marked = docs.select(docs[key].alias("id"), fingerprint_column(docs[text], words, count).alias("prints"))
    node = F.col("prints")[0] if count == 1 else F.xxhash64("prints")
    marked = cut_lineage(marked.withColumn("node", node))
    first = cut_lineage(marked.groupBy("node").agg(F.min("id").alias("least"), F.first("prints").alias("prints")))
    own = first.select("node", F.posexplode("prints").alias("s", "fp"))
    if count == 1:
        edges = links(own.select("s", "fp"), first.count(), radius, paired).select("a", "b")
    else:  # a fingerprint that is shared or linked is a node of its own, tied to the texts that have it
        sizes = cut_lineage(own.groupBy("s", "fp").agg(F.count("*").alias("texts")))
        found = cut_lineage(links(sizes.select("s", "fp"), sizes.where("s = 0").count(), radius, paired))
        useful = sizes.where("texts > 1").select("s", "fp").union(found.select("s", "a")).union(found.select("s", "b")).distinct()
        at = lambda c: F.xxhash64("s", c)
        edges = found.select(at("a").alias("a"), at("b").alias("b")).union(own.join(useful, ["s", "fp"], "left_semi").select("node", at("fp")))
    roots = components(edges)
    joined = first.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(ids, "root").select("node", "component_id", "root")
    return marked.join(named, "node").select(F.col("id").alias(key), F.col("prints")[0].alias("fp"), "component_id", "root", "prints")


def one_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, count: int = 1, **options) -> DataFrame:
    """docs with one row of each component: that of its smallest key (of several such rows, one).

    Components whose keys are all null keep one row too. Rows keep their columns as they were.
    """
    found = cut_lineage(near_duplicates(docs, key, text, words=words, count=count, **options).withColumnRenamed(key, "id"))
    if found.groupBy("id").count().where("id is null or count > 1").isEmpty():
        dropped = cut_lineage(found.where("id <> component_id").select(F.col("id").alias(key)))
        return docs.join(small(dropped, dropped.count()), key, "left_anti").select(*docs.columns)
    # missing or repeated keys: a row is told by key and fingerprints
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "prints")).alias("first")).select(F.col("first.id").alias("one"), F.col("first.prints").alias("its"))
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[key].alias("id"), fingerprint_column(docs[text], words, count).alias("prints"))
    return marked.join(first, F.col("id").eqNullSafe(F.col("one")) & (F.col("prints") == F.col("its"))).dropDuplicates(["id", "prints"]).select("doc.*")
