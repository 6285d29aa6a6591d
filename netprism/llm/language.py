"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Spark counts the padded n-grams of words of a bounded sample of labelled rows; the driver keeps only the model. Words
are runs of letters, lower-cased; each is read between a start and an end mark. A text's cross-entropy is the sum over
its words divided by its characters, the lowest wins, and limits learned on rows that the models have not seen say what
is none of the languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

ORDER = 4
#: Labelled rows of each language that models, and then limits, are fitted on: about so many, picked by hash.
FIT_ROWS, LIMIT_ROWS = 400, 200
#: Distinct words whose scores a Python worker remembers; bytes of text scored together.
MEMO_WORDS, BATCH_CHARS = 150_000, 1 << 20
START, END = "\x02", "\x03"
UNKNOWN = "und"
_WORD, _RUN = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)"), re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MEMO: dict[str, tuple] = {}


def words_of(text: str) -> list[str]:
    """Words of letters alone; where a text has none, the runs of letters beside digits."""
    low = text.lower()
    return _WORD.findall(low) or _RUN.findall(low)


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all windows of n codes, mixed."""
    h = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
    for i in range(n):
        h = h * _BASE + codes[i : i + len(h)]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)


@dataclass
class Model:
    """For each order: sorted hashes with a row of shares per language, and the same for contexts."""

    langs: list[str]
    base: float = 1.0
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    limit: np.ndarray | None = None
    name: str = field(default_factory=lambda: uuid4().hex)

    def score(self, words: list[str]) -> np.ndarray:
        """Negative log probability of each word by language: a row per word."""
        pad = START * (ORDER - 1)
        text = "".join(f"{pad}{w}{END}" for w in words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1  # predicted characters: the word and its end
        starts = np.cumsum(lengths + ORDER - 1) - lengths
        at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        p = np.full((len(at), len(self.langs)), self.base)
        for n in range(1, ORDER + 1):
            own = hashes(codes, n)[at - n + 1]
            if n > 1:
                p *= _lookup(self.contexts[n - 1], hashes(codes, n - 1)[at - n + 1], 1.0)
            else:
                p *= self.contexts[0][1][0]
            p += _lookup(self.grams[n - 1], own, 0.0)
        return -np.add.reduceat(np.log(p), np.cumsum(lengths) - lengths, axis=0)


def _lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    known, values = table
    out = np.full((len(keys), values.shape[1]), missing)
    if len(known):
        i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[i] == keys
        out[hit] = values[i[hit]]
    return out


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4


def _sampled(docs: DataFrame, key: str, text: str, lang: str, label_folds: dict[str, tuple], rows: dict[str, int]) -> tuple[list[str], DataFrame | None]:
    """Rows of the labelled folds, thinned by hash to about so many rows of each language."""
    labelled = docs.select(docs[key].alias("id"), docs[lang].cast("string").alias("lang"), docs[text].alias("text"), fold(docs[key]).alias("fold")).where("lang is not null")
    role = F.lit(None)
    for name, folds in label_folds.items():
        role = F.when(F.col("fold").isin(*folds), name).otherwise(role)
    labelled = labelled.withColumn("role", role).where("role is not null")
    sizes = labelled.groupBy("lang", "role").count().collect()  # a row for each language
    if not sizes:
        return [], None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (f"{r['role']} {r['lang']}", min(1.0, rows[r["role"]] / r["count"]))])
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return sorted({r["lang"] for r in sizes}), labelled.where(spot < share[F.concat_ws(" ", "role", "lang")]).select("lang", "role", "text")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_fold: int = 2) -> Model:
    """Models of all languages from labelled rows outside the held-out fold; one fold of them only sets the limits."""
    folds = [f for f in range(4) if f != held_fold]
    langs, sample = _sampled(docs, key, text, lang, {"fit": tuple(folds[:2]), "limit": (folds[2],)}, {"fit": FIT_ROWS, "limit": LIMIT_ROWS})
    model = Model(langs)
    if not langs:
        return model
    sample = sample.repartition(8)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: Counter = Counter()
            for lg, t in zip(pdf["lang"], pdf["text"], strict=True):
                held.update((lg, w) for w in words_of(t or ""))
            if held:
                yield pd.DataFrame([(lg, w, c) for (lg, w), c in held.items()], columns=["lang", "word", "c"])

    words = sample.where("role = 'fit'").mapInPandas(counted, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    padded = words.select("lang", "c", F.concat(F.lit(START * (ORDER - 1)), "word", F.lit(END)).alias("w"))
    top = padded.select("lang", "c", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - ORDER + 1), lambda i: F.substring(F.col("w"), i, F.lit(ORDER)))).alias("g"))
    counts = {ORDER: cut_lineage(top.groupBy("lang", "g").agg(F.sum("c").alias("c")))}
    for n in range(ORDER - 1, 0, -1):  # below: in how many different contexts
        counts[n] = cut_lineage(counts[n + 1].groupBy("lang", F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c")))
    place = {lg: i for i, lg in enumerate(langs)}
    model.base = 1.0 / (counts[1].select("g").distinct().count() + 1)
    for n in range(1, ORDER + 1):
        pdf = counts[n].toPandas()  # the model: bounded by the sample
        pdf["ctx"] = pdf["g"].str[:-1]
        ones = pdf[pdf["c"] == 1].groupby("lang").size().reindex(langs, fill_value=0)
        twos = pdf[pdf["c"] == 2].groupby("lang").size().reindex(langs, fill_value=0)
        off = ((ones + 0.5) / (ones + 2 * twos + 1)).clip(0.1, 0.9)
        sums = pdf.groupby(["lang", "ctx"])["c"].agg(["sum", "size"]).reset_index()
        sums["value"] = sums["lang"].map(off).astype(float) * sums["size"] / sums["sum"]
        total = pdf.merge(sums, on=["lang", "ctx"])
        total["value"] = (total["c"] - total["lang"].map(off).astype(float)) / total["sum"]
        model.grams.append(_sorted(total["g"], total["lang"].map(place), total["value"], n, len(langs), 0.0))
        if n == 1:
            row = np.ones((1, len(langs)))
            row[0, sums["lang"].map(place).to_numpy()] = sums["value"]
            model.contexts.append((np.zeros(1, np.uint64), row))
        else:
            model.contexts.append(_sorted(sums["ctx"], sums["lang"].map(place), sums["value"], n - 1, len(langs), 1.0))
    _limits(model, sample.where("role = 'limit'"))
    return model


def _sorted(grams: pd.Series, lang: pd.Series, value: pd.Series, n: int, langs: int, missing: float) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    keys, row = np.unique(hashes(codes, n)[::n] if len(codes) else np.zeros(0, np.uint64), return_inverse=True)
    table = np.full((len(keys), langs), missing)
    table[row, lang.to_numpy()] = value.to_numpy()
    return keys, table


def _limits(model: Model, sample: DataFrame) -> None:
    """A language's limit lies halfway between the highest cross-entropy of its own unseen rows and that of even chance."""
    scored = sample.select("lang", predicted(F.col("text"), model, sample).alias("p")).where("p.lang = lang").groupBy("lang").agg(F.max("p.entropy").alias("most")).collect()
    model.limit = np.full(len(model.langs), np.inf)
    for r in scored:
        model.limit[model.langs.index(r["lang"])] = max(r["most"] + 0.3, (r["most"] - np.log(model.base)) / 2)
    model.name = uuid4().hex


def predicted(text: Column, model: Model, docs: DataFrame) -> Column:
    """struct(lang, score, entropy, chars, rejected) of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on

    @F.pandas_udf("struct<lang:string,score:double,entropy:double,chars:bigint,rejected:boolean>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        if m.name not in _MEMO:
            _MEMO.clear()
            _MEMO[m.name] = ({}, [])
        memo, store = _MEMO[m.name]
        held = [np.concatenate(store)] if store else [np.zeros((0, len(m.langs)))]
        for series in batches:
            rows = []
            texts = [t or "" for t in series]
            at = 0
            while at < len(texts):
                chunk, chars = [], 0
                while at < len(texts) and (not chunk or chars < BATCH_CHARS):
                    chunk.append(words_of(texts[at]))
                    chars += len(texts[at])
                    at += 1
                new = list({w for ws in chunk for w in ws}.difference(memo))
                if len(memo) + len(new) > MEMO_WORDS:
                    memo.clear()
                    store.clear()
                    held[0] = np.zeros((0, len(m.langs)))
                    new = list({w for ws in chunk for w in ws})
                if new and m.langs:
                    first = len(held[0])
                    memo.update((w, first + i) for i, w in enumerate(new))
                    held[0] = np.concatenate([held[0], *(m.score(new[i : i + 4000]) for i in range(0, len(new), 4000))])
                    store[:] = [held[0]]
                for j, ws in enumerate(chunk):
                    if not m.langs or not ws or not any(map(str.isalpha, ws)) and not any(c.isalpha() for c in texts[at - len(chunk) + j]):
                        rows.append((UNKNOWN, 0.0, None, 0, True))
                        continue
                    n = sum(map(len, ws)) + len(ws)
                    total = held[0][np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                    entropy = total / n
                    best = int(entropy.argmin())
                    score = 1.0 / np.exp((entropy[best] - entropy) * min(n, 60)).sum()
                    over = m.limit is not None and entropy[best] > m.limit[best] + 6.0 / np.sqrt(n)
                    rows.append((m.langs[best], float(score), float(entropy[best]), n, bool(over)))
            yield pd.DataFrame(rows, columns=["lang", "score", "entropy", "chars", "rejected"])

    return predict(text)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """(key, held_out, lang_pred, score, entropy, rejected) for every row; fits a model unless one is given.

    Null texts and texts without a letter are `und`, score 0, rejected. Very long texts are scored whole. Equal
    cross-entropies go to the language first by code point. Rows with a null key are neither learned from nor held out.
    Without labelled rows all are `und`. Repeated rows each get a row; an empty table gives none; other columns are not read.
    """
    model = model or fit(docs, key, text, lang)
    rows = docs.select(docs[key].alias(key), F.coalesce(fold(docs[key]) == 2, F.lit(False)).alias("held_out"), predicted(docs[text], model, docs).alias("p"))
    return rows.select(key, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.entropy").alias("entropy"), F.col("p.rejected").alias("rejected"))


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """The rows that are not rejected, with their columns as they were."""
    model = model or fit(docs, key, text, lang)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), predicted(docs[text], model, docs).alias("p"))
    return rows.where("not p.rejected").select("doc.*")
