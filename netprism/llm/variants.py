"""Spelling variants by reduced-alphabet generation.

1. Letters are hashed to a few symbols. Words at one edit have reduced words at one edit or none.
2. Each distinct reduced word generates its full neighbourhood: itself, every deletion, replacement and insertion, each
   once, as 64-bit polynomial hashes; sums before and after a place give every hash without writing the word.
3. The neighbourhoods are joined with the reduced vocabulary, and both sides with their words.
4. Only pairs of original words at exactly one edit stay. Hashes that collide bring candidates more, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small, written

SYMBOLS = 8
#: Neighbours that go to Spark at once.
CHUNK_ROWS = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 2, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def symbols(words: list[str]) -> np.ndarray:
    """The symbols (1 to SYMBOLS) of words of one length, a row each."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return ((points * np.uint64(0x9E3779B1) >> np.uint64(17)) % np.uint64(SYMBOLS) + np.uint64(1)).reshape(len(words), -1)


def reduced(words: list[str]) -> np.ndarray:
    """Hashes of the reduced words; words of one length."""
    s = symbols(words)
    return (s * _powers(s.shape[1])[: s.shape[1]]).sum(axis=1, dtype=np.uint64)


def neighbourhoods(words: list[str], rows: int = CHUNK_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the word, hash of a neighbour of its reduced word), every neighbour once; words of one length."""
    s = symbols(words)
    m, n = s.shape
    power = _powers(n)
    terms = s * power[:n]
    before = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1:]
    yield np.arange(m), whole[:, 0]
    # of equal symbols side by side one is deleted, and a symbol isn't put before its like
    gone = before[:, :-1] + (whole - before[:, 1:]) * np.uint64(_INVERSE)
    once = np.concatenate([np.ones((m, 1), bool), s[:, 1:] != s[:, :-1]], axis=1)
    i, at = np.nonzero(once)
    yield i, gone[i, at]
    step = max(1, rows // max(1, m))
    for lo in range(0, n + 1, step):
        here = slice(lo, min(n, lo + step))
        for x in range(1, SYMBOLS + 1):
            sym = np.uint64(x)
            other = s[:, here] != sym
            i, at = np.nonzero(other)
            if len(i):
                yield i, (whole + (sym - s[:, here]) * power[here])[i, at]
            wide = slice(lo, min(n + 1, lo + step))
            free = other if wide.stop <= n else np.concatenate([other, np.ones((m, 1), bool)], axis=1)
            i, at = np.nonzero(free)
            yield i, (before[:, wide] + sym * power[wide] + (whole - before[:, wide]) * np.uint64(_BASE))[i, at]


def _by_length(words: pd.Series, longest: int = CHUNK_ROWS) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places, words) of one length, few at a time when they are long."""
    lengths = words.str.len().to_numpy()
    for n in np.unique(lengths):
        places = np.flatnonzero(lengths == n)
        step = max(1, longest // int(n))
        for lo in range(0, len(places), step):
            own = places[lo : lo + step]
            yield own, words.iloc[own].tolist()


def reduced_column(word: Column) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out = np.zeros(len(series), np.uint64)
            for places, words in _by_length(series):
                out[places] = reduced(words)
            yield pd.Series(out.view(np.int64))

    return run(word)


def generated(forms: DataFrame) -> DataFrame:
    """(near, own): the neighbourhood of each reduced word; forms: own, word (any word that reduces to it)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, held, size = pdf["own"].to_numpy(), [], 0

            def table() -> pd.DataFrame:
                return pd.DataFrame({"near": np.concatenate([k for _, k in held]).view(np.int64), "own": np.concatenate([o for o, _ in held])})

            for places, words in _by_length(pdf["word"]):
                for i, keys in neighbourhoods(words):
                    held.append((own[places[i]], keys))
                    size += len(keys)
                    if size >= CHUNK_ROWS:
                        yield table()
                        held, size = [], 0
            if held:
                yield table()

    return forms.select("own", "word").mapInPandas(run, "near long, own long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, m): every word with each word at exactly one edit, in both directions; words: distinct (word, n)."""
    keyed = written(words.select("word", "n", reduced_column(F.col("word")).alias("own")))
    forms = written(keyed.groupBy("own").agg(F.min("word").alias("word"), F.count("*").alias("c")))
    count = forms.count()
    vocabulary = small(forms.select(F.col("own").alias("near"), F.col("c").alias("d")), count)
    # a reduced word meets itself only where several words share it
    met = generated(forms).join(vocabulary, "near").where("near <> own or d > 1").select("own", "near")
    left = met.join(keyed.select("own", "word", "n"), "own")
    right = keyed.select(F.col("own").alias("near"), F.col("word").alias("other"), F.col("n").alias("m"))
    close = F.abs(F.length("word") - F.length("other")) <= 1
    return left.join(right, "near").where(close & (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "m").distinct()


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = 6, least: int = 5, damaged: int = 199) -> DataFrame:
    """(word, n) of words of so many letters and occurrences; null texts have none, a null key counts as an empty text.

    Runs whose checksum with the key the number `damaged` divides lose one letter.
    """
    runs = docs.select(F.coalesce(docs[key].cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(docs[text], F.lit(f"[{_LETTERS}]{{{letters},}}"), F.lit(0))).alias("r"))
    plain = F.octet_length("r") == F.length("r")
    low = runs.select("k", F.when(plain, F.lower("r")).otherwise(F.translate("r", _UPPER, _LOWER)).alias("r"))
    hashed = low.select("r", F.crc32(F.concat("k", F.lit(":"), "r").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("r")).cast("int")
    cut = F.concat(F.substring(F.col("r"), F.lit(1), at), F.substring(F.col("r"), at + 2, F.length("r")))
    words = hashed.select(F.when(F.col("h") % damaged == 0, cut).otherwise(F.col("r")).alias("word"))
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rooted(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(word, root): from each word along its form to the last; forms: word, form, every form of a larger count than its word.

    Pointers double, so a chain of n steps takes log2(n) rounds.
    """
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(most_rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        later = cut_lineage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = later.select("word", "root")
        if later.where("moved").isEmpty():
            return now
    raise RuntimeError(f"forms did not end within {most_rounds} rounds")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of every word; words: distinct (word, n).

    form: the near word of largest n (of equal ones the first by code point) if it has `times` the word's n, else null.
    A word without near words has n_near 0. An empty table gives no rows.
    """
    pairs = near_words(words)
    best = pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("b"))
    far = -F.col("b.m") >= F.col("n") * times
    found = cut_lineage(best.select("word", "n_near", F.when(far, F.col("b.other")).alias("form"), F.when(far, -F.col("b.m")).alias("form_n")))
    roots = rooted(found.where("form is not null").select("word", "form"))
    named = words.join(found, "word", "left").join(roots, "word", "left")
    return named.select("word", "n", "form", "form_n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return variants(written(vocabulary(docs, key, text)))
