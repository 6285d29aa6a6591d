"""Best-fit packing into sequences of several permitted lengths, chosen together at the least cost."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CAPACITIES = (512, 1024, 2048, 4096)
#: Remainders that are packed together: a bounded chunk of a partition.
CHUNK_ROWS = 8192


def cost(capacity: int) -> float:
    """Cost of a sequence: a part in proportion to its length, and attention's square."""
    return capacity + capacity * capacity / 16384


def best_fit(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int]]:
    """(bin of each item, capacity of each bin): the cheapest of several best-fit-decreasing packings.

    For every least opening size, an item goes where it leaves the least room; where it fits nowhere, the bin is opened
    that costs least per place it may fill, from that size up. Bins are then cut down to the least permitted length that
    holds their contents, and the packing of the least total cost is taken (ties: the smaller opening size). Items of
    size 0 and items over the largest capacity are the caller's.
    """
    caps = sorted(capacities)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    best: tuple | None = None
    for least in caps:
        rooms: list[int] = []  # distinct room left, ascending
        by_room: dict[int, list[int]] = {}
        where, filled = [0] * len(sizes), []
        for i in order:
            s = sizes[i]
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                held = by_room[room]
                b = held.pop()
                if not held:
                    del by_room[room]
                    rooms.pop(at)
            else:
                fits = [c for c in caps if c >= s]
                room = min([c for c in fits if c >= least] or fits[-1:], key=lambda c: (cost(c) / c, c))
                b = len(filled)
                filled.append(0)
            where[i] = b
            filled[b] += s
            left = room - s
            if left:
                if left not in by_room:
                    by_room[left] = []
                    insort(rooms, left)
                by_room[left].append(b)
        cut = [caps[bisect_left(caps, f)] for f in filled]
        total = sum(map(cost, cut))
        if best is None or total < best[0]:
            best = (total, where, cut)
    return best[1:] if best else ([], [])


def pack(docs: DataFrame, key: str, length: Column, capacities: tuple[int, ...] = CAPACITIES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows (key, piece, start, length, bin_id, bin_capacity, bin_offset): where each part of a document is put.

    A document over the largest capacity fills whole sequences of its own, and its remainder is packed with others.
    Nothing is dropped: a document of length 0 or null gets one row of length 0 without a bin. Repeated rows are packed
    each. Remainders are packed in chunks of a partition, so no rows are shuffled and a task's memory is bounded; a lost
    task packs its partition again. Empty tables give no rows; other columns are not read.
    """
    caps = tuple(sorted(set(capacities)))
    top = caps[-1]
    n = F.coalesce(length, F.lit(0)).cast("long")
    kind = docs.select(docs[key].alias("id")).dtypes[0][1]
    lengths = cut_lineage(docs.select(docs[key].cast("string").alias("id"), n.alias("n")))  # the key as text: pandas has no integers with nulls

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        rest: list[pd.DataFrame] = []
        held = 0

        def out(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal number
            base = (part << 36) + (number << 18)  # a chunk opens fewer bins than it has rows
            number += 1
            left = (pdf["n"] % top).tolist()
            items = [i for i, s in enumerate(left) if s]
            where, cut = best_fit([left[i] for i in items], caps)
            used = [0] * len(cut)
            rows = {c: [] for c in ("id", "piece", "start", "length", "bin_id", "bin_capacity", "bin_offset")}
            bins = dict(zip(items, where, strict=True))
            for i, (key_, size) in enumerate(zip(pdf["id"].tolist(), pdf["n"].tolist(), strict=True)):
                if i in bins or not size:
                    b = bins.get(i)
                    for c, v in zip(rows, (key_, size // top, size // top * top, left[i], None if b is None else base + b, 0 if b is None else cut[b], 0 if b is None else used[b]), strict=True):
                        rows[c].append(v)
                    if b is not None:
                        used[b] += left[i]
            return pd.DataFrame(rows).astype({"bin_id": "Int64"})

        for pdf in batches:
            at = 0
            while at < len(pdf):
                piece = pdf.iloc[at : at + chunk_rows - held]
                rest.append(piece)
                held += len(piece)
                at += len(piece)
                if held == chunk_rows:
                    yield out(pd.concat(rest))
                    rest, held = [], 0
        if held:
            yield out(pd.concat(rest))

    packed = lengths.mapInPandas(chunks, f"id string, piece long, start long, length long, bin_id long, bin_capacity long, bin_offset long")
    # sequences that one document fills by itself: named apart, by negative numbers
    full = lengths.where(F.col("n") >= top).select("id", F.posexplode(F.sequence(F.lit(1), F.floor(F.col("n") / top).cast("int"))).alias("piece", "_"))
    full = full.select("id", F.col("piece").cast("long").alias("piece"), (F.col("piece") * F.lit(top)).cast("long").alias("start"), F.lit(top).cast("long").alias("length"), (-1 - F.monotonically_increasing_id()).alias("bin_id"), F.lit(top).cast("long").alias("bin_capacity"), F.lit(0).cast("long").alias("bin_offset"))
    return packed.union(full).select(F.col("id").cast(kind).alias(key), "piece", "start", "length", "bin_id", "bin_capacity", "bin_offset")
