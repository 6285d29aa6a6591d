"""Personal data by bootstrapped contextual extraction.

Base kinds are found by their form. They seed a graph of patterns (the words around an identifier) and instances (the
identifiers): Spark scores patterns by the share of their instances that are believed, and instances by the patterns
that hold them, a few rounds long. Patterns of high confidence then name further identifiers of the right shape that no
base form catches, such as local phone numbers after the words that precede phone numbers elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import BROADCAST_ROWS, small

KINDS = ("email", "ip", "card", "phone")
#: A pattern names new identifiers if it holds so many different seeds, and so large a share of its instances is believed.
MIN_SEEDS, MIN_SHARE, ROUNDS = 5, 0.8, 2

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Tokens that may be identifiers: no white space, quotes or brackets, with a digit or @ inside.
_TOKEN = re.compile(r"[^\s\"'<>()\[\]{},;=]*[0-9@][^\s\"'<>()\[\]{},;=]*")
_AROUND = 80


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email form, from one @ to the next: a run before it, a domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of base identifiers, leftmost and without overlap within a kind; in the order of starts."""
    out = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m.group().split("."))):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


def shape(token: str) -> int | None:
    """The kind that an unseen identifier may be of: an address with @, or digits with few separators."""
    if "@" in token and token[0] != "@" and token[-1] != "@":
        return 0
    digits = sum(c.isdigit() for c in token)
    if all(c in "0123456789-./" for c in token) and 7 <= digits <= 11 and token.count(".") != 3:
        return 3
    return None


def words_around(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The two words before and the one behind, lower case, digits as #; blank where the line or a bound ends."""
    def plain(word: str) -> str:
        return re.sub("[0-9]", "#", word.lower())

    before = text[max(0, start - _AROUND) : start].rpartition("\n")[2].split()
    after = text[end : end + _AROUND].partition("\n")[0].split()
    return (plain(before[-2]) if len(before) > 1 else "", plain(before[-1]) if before else "", plain(after[0]) if after else "")


def _patterns(kind: int, around: tuple[str, str, str]) -> list[str]:
    two, one, behind = around
    return [f"{kind} {two} {one} _"] * bool(one) + [f"{kind} {one} _ {behind}"] * bool(one and behind)


def _found(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        text = text or ""
        spans = base_spans(text)
        seen = []  # (pattern, instance, seed, start, end, kind)
        for s, e, k in spans:
            seen += [(p, text[s:e].lower(), True, s, e, k) for p in _patterns(k, words_around(text, s, e))]
        if spans or "@" in text or _DIGIT.search(text):
            held = sorted((s, e) for s, e, _ in spans)
            i = 0
            for m in _TOKEN.finditer(text):
                s, e = m.start(), m.end()
                while e > s and text[e - 1] in ".:!?-/":
                    e -= 1
                while i < len(held) and held[i][1] <= s:
                    i += 1
                if e - s < 4 or any(a < e and s < b for a, b in held[i : i + 4]):
                    continue
                k = shape(text[s:e])
                if k is not None:
                    seen += [(p, text[s:e].lower(), False, s, e, k) for p in _patterns(k, words_around(text, s, e))]
        rows.append((spans, seen))
    return pd.DataFrame({"spans": [[dict(zip(("start", "end", "kind"), x, strict=True)) for x in r[0]] for r in rows], "seen": [[dict(zip(("pattern", "instance", "seed", "start", "end", "kind"), x, strict=True)) for x in r[1]] for r in rows]})


_SPAN = "struct<start:int,end:int,kind:int>"


def scan(text: Column) -> Column:
    """struct(spans, seen) of each text: base identifiers, and what stands in which pattern."""

    @F.pandas_udf(f"struct<spans:array<{_SPAN}>,seen:array<struct<pattern:string,instance:string,seed:boolean,start:int,end:int,kind:int>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            yield _found(series)

    return run(text)


def trusted(seen: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_share: float = MIN_SHARE) -> DataFrame:
    """(pattern) of high confidence. seen: pattern, instance, kind, seed."""
    edges = cut_lineage(seen.groupBy("pattern", "kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("seed")))
    instances = edges.select("kind", "instance", "seed").distinct().groupBy("kind", "instance").agg(F.max("seed").alias("belief"))
    good = None
    for _ in range(rounds):
        scored = edges.join(instances, ["kind", "instance"]).groupBy("pattern", "kind").agg(F.avg("belief").alias("share"), F.sum("seed").alias("seeds"))
        good = cut_lineage(scored.where((F.col("seeds") >= min_seeds) & (F.col("share") >= min_share)))
        # an instance is believed unless all of its patterns are wrong about it
        doubt = edges.join(good, ["pattern", "kind"]).groupBy("kind", "instance").agg(F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-9))))).alias("doubt"))
        seeds = edges.groupBy("kind", "instance").agg(F.max("seed").alias("seed"))
        instances = cut_lineage(seeds.join(doubt, ["kind", "instance"], "left").select("kind", "instance", F.greatest("seed", 1 - F.coalesce("doubt", F.lit(1.0))).alias("belief")))
    return good.select("pattern").distinct()


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _extracted(docs: DataFrame, keep: list[Column], text: str, **options) -> DataFrame:
    """keep, spans (base) and added, one row per document."""
    marked = docs.select(*keep, F.monotonically_increasing_id().alias("__row"), scan(docs[text]).alias("__p"))
    marked = cut_lineage(marked.select("*", F.col("__p.spans").alias("spans"), F.col("__p.seen").alias("seen")).drop("__p"))  # written: row numbers stay as they are
    seen = marked.select("__row", F.explode("seen").alias("s")).select("__row", "s.*")
    good = trusted(seen, **options)
    new = seen.where("not seed").join(good, "pattern").groupBy("__row").agg(F.collect_set(F.struct("start", "end", "kind")).alias("added"))  # bounded by the document
    n = marked.agg(F.sum(F.exists("seen", lambda s: ~s["seed"]).cast("int"))).first()[0] or 0
    none = F.array().cast(f"array<{_SPAN}>")
    return marked.join(small(new, n), "__row", "left").withColumn("added", F.coalesce("added", none)).drop("seen", "__row")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_<kind> of base identifiers, base_sha256, spans of all, n_added) for every row.

    Null and empty texts have no spans (the digest is that of the empty text). Offsets are code points over whole texts,
    however long. Repeated rows each get a row and count once as instances. Equal starts are ordered by kind. An empty
    table gives no rows; other columns are not read.
    """
    rows = _extracted(docs, [docs[key].alias("__id")], text, **options)
    own = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(own, lambda x: x == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select(F.col("__id").alias(key), *counts, F.sha2(_told(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _told(F.concat("spans", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by their kind; overlapping ones as one, named after the first."""
    out, done = [], 0
    merged: list[list[int]] = []
    for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[done:s], f"<{KINDS[k].upper()}>"]
        done = e
    return "".join([*out, text[done:]])


def masked(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """docs with all identifiers in the text replaced by their kind, and n_chars (where there is one) counted anew; null stays null.

    Texts are read twice and not written: trusted patterns are few, and go to the tasks after their number is checked.
    """
    seen = docs.select(F.explode(scan(docs[text])["seen"]).alias("s")).select("s.*")
    good = trusted(seen, **options)
    n = good.count()
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("doc")
    if n <= BROADCAST_ROWS:
        names = docs.sparkSession.sparkContext.broadcast(frozenset(r["pattern"] for r in good.collect()))
        pick = lambda x: (x["start"], x["end"], x["kind"])

        @F.pandas_udf("string")
        def replaced(texts: pd.Series) -> pd.Series:
            out = []
            for t in texts:
                spans = base_spans(t or "")
                if names.value and t:
                    spans += [pick(x) for x in _found(pd.Series([t]))["seen"][0] if not x["seed"] and x["pattern"] in names.value]
                out.append(masked_text(t, spans) if spans else t)
            return pd.Series(out, dtype=object)

        return _put(docs.select(whole, replaced(docs[text]).alias("__t")), docs, text, n_chars)
    rows = _extracted(docs, [whole], text, **options)

    @F.pandas_udf("string")
    def replace(texts: pd.Series, base: pd.Series, added: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else masked_text(t, [(s["start"], s["end"], s["kind"]) for x in (b, a) if x is not None for s in x]) for t, b, a in zip(texts, base, added, strict=True)], dtype=object)

    return _put(rows.withColumn("__t", replace(F.col("doc")[text], F.col("spans"), F.col("added"))), docs, text, n_chars)


def _put(rows: DataFrame, docs: DataFrame, text: str, n_chars: str) -> DataFrame:
    """doc with the new text __t and its length."""
    kinds = dict(docs.dtypes)
    changed = ~F.col("__t").eqNullSafe(F.col("doc")[text])
    new = {text: F.col("__t"), n_chars: F.when(changed, F.char_length("__t")).otherwise(F.col("doc")[n_chars]).cast(kinds[n_chars])} if n_chars in kinds else {text: F.col("__t")}
    return rows.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
