"""Interaction of filters by decision diagrams over masks of what each document fails.

1. Spark finds for every document the set of filters that it fails, and sums documents by part and mask: 2^k rows a part.
2. Each part's masks become a diagram: one level for each filter, edges pass and fail, each with the counts of the
   documents that go along it; equal nodes are one.
3. Two neighbouring levels are swapped in place, which touches the nodes of these two levels only; swaps of neighbours
   lead through all orders. In every order the all-pass path has the steps: what its edges carry stays, and what the fail
   edges beside it carry is removed there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD

Counts = tuple[int, int, int]
STEP = ["filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plus(a: Counts, b: Counts) -> Counts:
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2])


class Diagram:
    """A diagram of counts by mask: a node is ((counts, node) of pass, (counts, node) of fail); without documents there is none."""

    def __init__(self, masks: dict[int, Counts], width: int):
        self.nodes: dict[tuple, tuple] = {}
        self.width = width
        self.order = list(range(width))
        self.root = self._built(masks, 0)

    def node(self, low: tuple | None, high: tuple | None) -> tuple | None:
        return None if low is None and high is None else self.nodes.setdefault((low, high), (low, high))

    def _built(self, masks: dict[int, Counts], level: int) -> tuple | None:
        if not masks or level == self.width:
            return None
        sides = []
        for bit in (0, 1):
            own = {m: c for m, c in masks.items() if m >> level & 1 == bit}
            total = (0, 0, 0)
            for c in own.values():
                total = plus(total, c)
            sides.append((total, self._built(own, level + 1)) if own else None)
        return self.node(*sides)

    def swap(self, level: int) -> None:
        """Exchanges the filters of two neighbouring levels; nodes above are led to the new ones, nodes below stay."""
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        done: dict[int, tuple] = {}

        def swapped(node: tuple) -> tuple:
            grand = [[side[1][bit] if side and side[1] else None for side in node] for bit in (0, 1)]
            sides = []
            for pair in grand:
                carried = [e[0] for e in pair if e]
                sides.append((carried[0] if len(carried) == 1 else plus(*carried), self.node(*pair)) if carried else None)
            return self.node(*sides)

        def led(node: tuple | None, depth: int) -> tuple | None:
            if node is None:
                return None
            if id(node) not in done:
                done[id(node)] = swapped(node) if depth == level else self.node(*[side and (side[0], led(side[1], depth + 1)) for side in node])
            return done[id(node)]

        self.root = led(self.root, 0)
        live: dict[tuple, tuple] = {}

        def mark(node: tuple | None) -> None:
            if node is not None and node not in live:
                live[node] = node
                for side in node:
                    if side:
                        mark(side[1])

        mark(self.root)
        self.nodes = live

    def steps(self) -> list[tuple[int, Counts, Counts]]:
        """Along the all-pass path: the filter of each level, what passes and what fails there."""
        out, node = [], self.root
        for f in self.order:
            low, high = node if node is not None else (None, None)
            out.append((f, low[0] if low else (0, 0, 0), high[0] if high else (0, 0, 0)))
            node = low[1] if low else None
        return out


def neighbour_swaps(width: int) -> Iterator[int]:
    """Levels to swap, one after the other, so that every order comes once: each item goes through those of the rest and back."""
    if width < 2:
        return
    down = True
    for inner in [*neighbour_swaps(width - 1), None]:
        yield from (range(width - 2, -1, -1) if down else range(width - 1))
        if inner is not None:
            yield inner + 1 if down else inner
        down = not down


def audited(masks: dict[int, Counts], letters: str) -> pd.DataFrame:
    """The steps of every order of the filters over one part's counts (documents, good, toxic) by mask."""
    width = len(letters)
    diagram = Diagram(masks, width)
    fails = [sum(c[0] for m, c in masks.items() if m >> f & 1) for f in range(width)]
    alone = [masks.get(1 << f, (0, 0, 0))[0] for f in range(width)]
    rows, shapley = [], [0] * width

    def read() -> None:
        order = "".join(letters[f] for f in diagram.order)
        for step, (f, passed, failed) in enumerate(diagram.steps(), 1):
            shapley[f] += failed[0]
            rows.append([order, step, f, passed[0], failed[0], fails[f] - failed[0], alone[f], failed[1], failed[2]])

    read()
    for level in neighbour_swaps(width):
        diagram.swap(level)
        read()
    return pd.DataFrame([[order, step, letters[f], *rest, shapley[f]] for order, step, f, *rest in rows], columns=STEP)


def masks(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(id, part, A to E) of every document; words are maximal runs of other than ASCII white space.

    A: under 100 words; B: under 80 distinct words of 100; C: over 10 capitals A-Z of 100 code points; D: any of #$%&*|;
    E: a smaller key has the same text. Null texts are empty, null parts the empty string; a row without a key has no
    smaller one, and rows of one key aren't smaller than each other. Very long texts are judged whole.
    """
    own = docs.select(docs[key].alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text], F.lit("")).alias("t"))
    words = own.select("id", "part", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"))
    n = F.size("w").cast("long")
    judged = words.select(
        "id", "part", (n < 100).alias("A"), (F.size(F.array_distinct("w")).cast("long") * 100 < n * 80).alias("B"),
        (F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long") * 100 > F.length("t").cast("long") * 10).alias("C"),
        F.col("t").rlike("[#$%&*|]").alias("D"), F.unhex(F.sha2("t", 256)).alias("same"))
    judged = cut_lineage(judged)
    # joined by text and key, not by text: a text that a third of all rows share is no hot key
    first = judged.groupBy("same").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    met = judged.join(first, ["same", "id"], "left")
    return met.select("id", "part", "A", "B", "C", "D", (F.col("id").isNotNull() & F.col("first").isNull()).alias("E"))


def interactions(masked: DataFrame, letters: str, labels: DataFrame, key: str = "doc_id", good: Column | None = None, toxic: Column | None = None) -> DataFrame:
    """(part, filter_order, step, ...) of every order; masked: id, part and a boolean column for each letter.

    A document is good or toxic if any of its labels says so; rows of one key share them, rows without a key have none.
    An empty table gives no rows.
    """
    said = lambda c: F.max(F.coalesce(c, F.lit(False)))
    marks = labels.where(labels[key].isNotNull()).groupBy(labels[key].alias("id")).agg(
        said(labels["quality"] == 1 if good is None else good).alias("good"), said(labels["toxic"] == 1 if toxic is None else toxic).alias("toxic"))
    mask = sum((F.when(F.col(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(letters)), F.lit(0))
    # rows without a key find no label; they don't meet in one task of the join
    rows = masked.select("part", mask.alias("mask"), "id")
    labelled = rows.where("id is not null").join(marks, "id", "left").select("part", "mask", "good", "toxic")
    labelled = labelled.unionByName(rows.where("id is null").select("part", "mask", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic")))
    counts = labelled.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("g"), F.count_if("toxic").alias("t"))

    def every_order(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(pdf["mask"], pdf["n"], pdf["g"], pdf["t"], strict=True)}
        out = audited(held, letters)
        out.insert(0, "part", pdf["part"].iloc[0])
        return out

    schema = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return counts.groupBy("part").applyInPandas(every_order, schema)


def filter_interactions(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    return interactions(masks(docs, key, text, part), "ABCDE", labels, key)
