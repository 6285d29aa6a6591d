"""Removal of repeated passages by prefix-free parsing.

A text is parsed where a rolling hash triggers: at the least hash of every window. Triggers depend on nothing but the
bytes of their window, so equal passages are parsed alike wherever they stand, and any 400 bytes have a trigger of their
own: that of their first window. The phrase of a trigger holds the bytes of all 400-byte strings that belong to it, so
phrases overlap, and none is the beginning of another occurrence's rest without being equal to it as far as it matters.

Dictionary: distinct phrases. A phrase that occurs twice settles all of its strings at once, however often it occurs.
Parse: where a phrase occurs once, its strings can still repeat inside other phrases, but only those whose bytes from the
trigger on are shared. For such triggers alone, once for each distinct phrase, the dictionary's suffixes (the bytes before
the trigger, read back) and the parse behind them (the bytes from it on) are combined: two phrases hold a string in common
where both sides together are long enough. The forms of a trigger with many of them are sorted: by the bytes from the trigger
on, then by those before it. What a form shares with its neighbours in either order bounds what it shares with any; strings
that these bounds leave open are named by 128-bit hashes, and equal names are equal strings. Ranges of the order are tasks of
their own, so no trigger has to be sorted in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LENGTH = 400
#: Places of a window, and bytes that a rolling hash looks at; together at most LENGTH.
WINDOW, GRAM = 240, 16
#: Phrases of one trigger that are held against each other; more are sorted, and what order leaves open is named.
PAIRED_FORMS = 64
_MULTIPLIER = 0x9E3779B97F4A7C15


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place, by doubling: 1, 2, 4, ... bytes."""
    h, power, width = data.astype(np.uint64) + np.uint64(1), _MULTIPLIER, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the last least value of each window."""
    n = len(h)
    key = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))  # ties: the last place
    low, size = key, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: n - width + 1], low[width - size :])
    return (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)


def parsed(text: bytes, length: int = LENGTH, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(trigger, first, last): the strings starting from first to last belong to the trigger."""
    if len(text) < length:
        return []
    data = np.frombuffer(text, np.uint8)
    starts = len(text) - length + 1
    owner = window_minima(rolling(data[: starts + window + GRAM - 2]), window)[:starts]
    change = np.flatnonzero(np.diff(owner)) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [starts - 1]])
    return list(zip(owner[first].tolist(), first.tolist(), last.tolist(), strict=True))


def _keyed(docs: DataFrame, key: str, text: str) -> list[Column]:
    """Rows of one key and text are judged alike, so they may share a key here."""
    return [F.coalesce(docs[key].cast("string"), F.lit("")).alias("id"), F.xxhash64(docs[text]).alias("th")]


def phrases(docs: DataFrame, key: str, text: str, length: int, window: int) -> DataFrame:
    """(id, th, first, last, phrase, follow): the name of the phrase, and a hash of the bytes that all of its strings share."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, short = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
        for pdf in batches:
            held, rows, follows = 0, [], []

            def table() -> pd.DataFrame:
                out = pd.DataFrame(rows, columns=["id", "th", "first", "last", "phrase"])
                return out.assign(follow=np.array(follows, np.uint64).view(np.int64))

            for i, th, data in zip(pdf["id"], pdf["th"], pdf["data"], strict=True):
                view = memoryview(data or b"")
                for at, first, last in parsed(data or b"", length, window):
                    rows.append((i, th, first, last, name(view[first : last + length]) + (at - first).to_bytes(2, "big")))
                    follows.append(short(view[at : at + length - window]))
                held += len(view)
                if held > 1 << 22:
                    yield table()
                    held, rows, follows = 0, [], []
            if rows:
                yield table()

    data = docs.select(*_keyed(docs, key, text), docs[text].cast("binary").alias("data"))
    return data.mapInPandas(parse, "id string, th long, first int, last int, phrase binary, follow long")


def repeated(docs: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(id, th, runs): starts (first, last) of strings that also stand elsewhere; texts: __key, id, th, data."""
    if window + GRAM - 1 > length:
        raise ValueError("a string must hold a window")
    # only phrases whose bytes after the trigger stand elsewhere too can repeat; the others are most, and go first
    every = written(phrases(docs, key, text, length, window))
    # (a table of its own, as `shared` below: only a join of two plain inputs can split a trigger that many texts share)
    again = written(every.groupBy("follow").count().where("count > 1").select("follow"))
    parse = written(every.join(again, "follow", "left_semi").select("id", "th", "first", "last", "phrase", "follow"))
    # the dictionary: one row for each distinct phrase, with one place where it stands
    words = written(parse.groupBy("phrase").agg(F.count("*").alias("n"), F.min("follow").alias("follow"), F.min(F.struct("id", "th", "first", "last")).alias("at")))
    often = parse.join(words.where("n > 1").select("phrase"), "phrase", "left_semi").select("id", "th", "first", "last")
    # triggers that several phrases share, at least one of them alone
    shared = written(words.groupBy("follow").agg(F.count("*").alias("forms"), F.min("n").alias("least")).where("forms > 1 and least = 1").select("follow", (F.col("forms") > PAIRED_FORMS).alias("hot")))
    offset = F.conv(F.hex(F.substring("phrase", -2, 2)), 16, 10).cast("int")  # from the phrase's first byte to its trigger
    open_ = words.join(shared, "follow").select("at.*", "follow", "hot", (F.col("n") == 1).alias("alone"), offset.alias("before"))
    asked = written(open_.groupBy("id", "th").agg(F.collect_list(F.struct("first", "last", "before", "follow", "hot", "alone")).alias("places")))  # bounded by the text
    named = texts.join(asked, ["id", "th"]).select("__key", "id", "th", "data", "places")

    def bytes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p["follow"], i, th, p["first"], p["last"], p["before"], p["alone"], data[p["first"] : p["last"] + length]) for i, th, data, places in zip(pdf["id"], pdf["th"], pdf["data"], pdf["places"], strict=True) for p in places if not p["hot"]]
            for lo in range(0, len(rows), 20_000):
                yield pd.DataFrame(rows[lo : lo + 20_000], columns=["follow", "id", "th", "first", "last", "before", "alone", "data"])

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    out += extended(held, length, window)
                    held = []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=["id", "th", "first", "last"])
        if out := extended(held, length, window):
            yield pd.DataFrame(out, columns=["id", "th", "first", "last"])

    forms = named.mapInPandas(bytes_of, "follow long, id string, th long, first int, last int, before int, alone boolean, data binary")
    few = forms.repartition("follow").sortWithinPartitions("follow").mapInPandas(paired, "id string, th long, first int, last int")

    single = _named(_open_strings(named, length), length)
    return often.union(few).union(single).groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("runs"))  # bounded by the text


def _common(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def _beside(batches: Iterator[pd.DataFrame], side, whole: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows, and the most bytes that the side of each has in common with its neighbours of one trigger.

    In sorted order no other row has more. The first and last row of a partition may have neighbours elsewhere: they count as `whole`.
    """
    before: tuple | None = None
    held: tuple[pd.DataFrame, list[int]] | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        keys = list(zip(pdf["follow"], map(side, pdf["data"], pdf["before"]), strict=True))
        most = [0] * len(keys)
        if before is None:
            most[0] = whole
        for i in range(len(keys)):
            last = before if i == 0 else keys[i - 1]
            if last is not None and last[0] == keys[i][0]:
                c = _common(last[1], keys[i][1])
                most[i] = max(most[i], c)
                if i:
                    most[i - 1] = max(most[i - 1], c)
                elif held is not None:
                    held[1][-1] = max(held[1][-1], c)
        if held is not None:
            yield held[0], np.array(held[1])
        held, before = (pdf, most), keys[-1]
    if held is not None:
        held[1][-1] = whole
        yield held[0], np.array(held[1])


def _open_strings(named: DataFrame, length: int) -> DataFrame:
    """Forms of triggers with many forms, as suffix order leaves them open: a string needs as many bytes on either side of the
    trigger as another form shares.

    Forms are sorted by their bytes from the trigger on, those that can't reach go, and the rest is sorted by the bytes before
    it. Ranges of the order are dealt out, so a trigger with many forms is many tasks.
    """
    schema = "follow long, id string, th long, first int, last int, before int, alone boolean, data binary, low int, high int"

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p["follow"], i, th, p["first"], p["last"], p["before"], p["alone"], data[p["first"] : p["last"] + length], 0, 0) for i, th, data, places in zip(pdf["id"], pdf["th"], pdf["data"], pdf["places"], strict=True) for p in places if p["hot"]]
            for lo in range(0, len(rows), 20_000):
                yield pd.DataFrame(rows[lo : lo + 20_000], columns=[x.split()[0] for x in schema.split(", ")])

    def right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, most in _beside(batches, lambda d, before: d[before:], length):
            # bytes of a string before the trigger: as many as its other side leaves, as many as its phrase allows
            low = np.maximum(length - most, pdf["before"].to_numpy() - (pdf["last"] - pdf["first"]).to_numpy())
            pdf = pdf.assign(low=low.astype(np.int32))
            if len(out := pdf[low <= pdf["before"].to_numpy()]):
                yield out

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, most in _beside(batches, lambda d, before: d[:before][::-1], length):
            pdf = pdf.assign(high=np.minimum(most, pdf["before"].to_numpy()).astype(np.int32))
            if len(out := pdf[pdf["low"] <= pdf["high"]]):
                yield out

    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lambda df, *by: df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    hot = written(named.where(F.exists("places", lambda p: p["hot"])).mapInPandas(forms, schema))
    after = hot.withColumn("side", F.expr("substring(data, before + 1)"))
    kept = written(ordered(after, "follow", "side", "id", "first").drop("side").mapInPandas(right, schema))
    ahead = kept.withColumn("side", F.reverse(F.hex(F.expr("substring(data, 1, before)"))))  # sorts by bytes backward: their two digits swap alike
    return ordered(ahead, "follow", "side", "id", "first").drop("side").mapInPandas(left, schema)


def _named(open_: DataFrame, length: int) -> DataFrame:
    """(id, th, first, last) of open strings of phrases that stand alone and have the name of another: equal names are equal strings."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = xxhash.xxh3_128_digest
        for pdf in batches:
            rows = []
            for i, th, first, before, alone, data, low, high in pdf[["id", "th", "first", "before", "alone", "data", "low", "high"]].itertuples(index=False, name=None):
                view = memoryview(data)
                rows += [(name(view[before - b : before - b + length]), i, th, first + before - b, alone) for b in range(low, high + 1)]
                if len(rows) > 1 << 16:
                    yield pd.DataFrame(rows, columns=["name", "id", "th", "start", "alone"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["name", "id", "th", "start", "alone"])

    strings = written(open_.mapInPandas(names, "name binary, id string, th long, start int, alone boolean"))
    # a name that no phrase alone holds isn't asked for
    twice = strings.groupBy("name").agg(F.count("*").alias("n"), F.max("alone").alias("alone")).where("n > 1 and alone").select("name")
    return strings.where("alone").join(twice, "name", "left_semi").select("id", "th", F.col("start").alias("first"), F.col("start").alias("last"))


def extended(forms: list[tuple], length: int, window: int) -> list[tuple]:
    """(id, th, first, last) of strings of phrases that stand alone and are in another phrase of the same trigger too.

    forms: follow, id, th, first, last, before, alone, data. Aligned at the trigger, two phrases share so many bytes before
    it and so many from it on; a string is in both if what it holds on either side is shared.
    """
    m = len(forms)
    if m < 2:
        return []
    left = np.tile(np.arange(256, 256 + m, dtype=np.uint16)[:, None], (1, window))  # where a phrase has no byte, no other equals it
    right = np.tile(left[:, :1], (1, length))
    for i, (_, _, _, _, _, before, _, data) in enumerate(forms):
        own = np.frombuffer(data, np.uint8)
        left[i, :before] = own[:before][::-1]
        right[i, : len(own) - before] = own[before:]
    out = []
    for i, (_, id_, th, first, last, before, alone, _) in enumerate(forms):
        if not alone:
            continue
        differs = left != left[i]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), window)
        differs = right != right[i]
        ahead = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
        low = np.maximum(length - ahead, before - (last - first))
        high = np.minimum(common, before)
        ok = low <= high
        ok[i] = False
        out += [(id_, th, first + before - int(h), first + before - int(lo)) for lo, h in {*zip(low[ok].tolist(), high[ok].tolist(), strict=True)}]
    return out


def spans(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings starting from first to last."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, text, removed) for every row: the bytes left, and the spans taken out.

    text is what is left without characters that a span cuts in two.

    Null and empty texts, and texts shorter than `length`, keep all. Rows of equal text are each other's repeats; matches
    never cross rows. Very long texts are parsed whole; an empty table gives no rows; other columns are not read.
    """
    texts = docs.select(docs[key].alias("__key"), *_keyed(docs, key, text), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("data"))

    runs = repeated(docs, texts, key, text, length, window)  # with the same texts, so that Spark deals them out once

    @F.pandas_udf("struct<n_removed:bigint,n_spans:bigint,kept:binary,text:string,removed:array<struct<start:bigint,end:bigint>>>")
    def cut(data: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for d, f in zip(data, found, strict=True):
            out = spans([(r["first"], r["last"]) for r in f], length)
            kept, at = [], 0
            for a, b in out:
                kept.append(d[at:a])
                at = b
            kept.append(d[at:])
            rows.append((sum(b - a for a, b in out), len(out), b"".join(kept), "".join(x.decode("utf-8", "ignore") for x in kept), [{"start": a, "end": b} for a, b in out]))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept", "text", "removed"])

    none = F.struct(F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("data").alias("kept"), F.col("data").cast("string").alias("text"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"))
    joined = texts.join(runs, ["id", "th"], "left")
    done = joined.withColumn("r", F.when(F.col("runs").isNull(), none).otherwise(cut(F.when(F.col("runs").isNotNull(), F.col("data")).otherwise(F.lit(b"")), F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>")))))
    return done.select(F.col("__key").alias(key), F.octet_length("data").cast("long").alias("n_bytes"), "r.*")


