"""Language models against a plain Kneser-Ney, held-out accuracy; personal data against the forms as regular expressions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netprism.llm import language, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SOUNDS = {"aa": ["ka", "lo", "mi", "te", "ru"], "bb": ["sch", "ung", "ein", "der", "ö"], "cc": ["eau", "que", "lle", "é", "oi"]}


def text_in(rng, lang, words=40):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words)).capitalize() + "."


def corpus(n=240):
    rng = random.Random(1)
    return [(i, text_in(rng, lg), lg, "s", 1) for i, lg in ((i, rng.choice(list(SOUNDS))) for i in range(n))]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def plain_model(words, order, vocabulary):
    """Interpolated Kneser-Ney by its definition: probability of a character after a context."""
    counts = {order: Counter()}
    for w, c in words.items():
        p = language.START * (order - 1) + w + language.END
        for i in range(len(p) - order + 1):
            counts[order][p[i : i + order]] += c
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    off, total, types = {}, defaultdict(Counter), defaultdict(Counter)
    for n, cs in counts.items():
        ones, twos = sum(c == 1 for c in cs.values()), sum(c == 2 for c in cs.values())
        off[n] = min(0.9, max(0.1, (ones + 0.5) / (ones + 2 * twos + 1)))
        for g, c in cs.items():
            total[n][g[:-1]] += c
            types[n][g[:-1]] += 1

    def p(context, char):
        out = 1.0 / (vocabulary + 1)
        for n in range(1, order + 1):
            ctx = context[len(context) - n + 1 :] if n > 1 else ""
            if total[n][ctx]:
                out = max(counts[n][ctx + char] - off[n], 0) / total[n][ctx] + off[n] * types[n][ctx] / total[n][ctx] * out
        return out

    return p


def test_scores_are_those_of_the_definition(spark):
    rows = corpus(60)
    model = language.fit(frame(spark, rows))
    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 in (0, 1)]
    by_lang = {lg: Counter(w for r in used if r[2] == lg for w in language.words_of(r[1])) for lg in model.langs}
    vocabulary = len({c for ws in by_lang.values() for w in ws for c in w} | {language.END})
    tried = ["kalomi", "schein", "xyz", "é", "derka"]
    got = model.score(tried)
    for i, lg in enumerate(model.langs):
        p = plain_model(by_lang[lg], language.ORDER, vocabulary)
        for j, w in enumerate(tried):
            padded = language.START * (language.ORDER - 1) + w + language.END
            want = -sum(math.log(p(padded[:k], padded[k])) for k in range(language.ORDER - 1, len(padded)))
            assert got[j, i] == pytest.approx(want, rel=1e-9)


def test_held_out_accuracy_and_rejection(spark):
    rows = corpus()
    junk = [(1000, "qzxj wvvk qqqq zzzzz xkcd vvv wwwx jjjq " * 5, None, "s", 1), (1001, "12 34 -- !!", "aa", "s", 1), (1002, None, "aa", "s", 1), (1003, "", None, "s", 1), (1004, "² ³", None, "s", 1), (None, text_in(random.Random(5), "bb"), "aa", "s", 1)]
    rng = random.Random(8)
    long = [(2000, text_in(rng, "cc", 60_000), "aa" if zlib.crc32(b"2000") % 4 == 2 else "cc", "s", 1)]
    docs = frame(spark, rows + junk + long + rows[:1]).withColumn("entropy", F.lit("mine")).withColumn("score", F.lit("mine"))
    got = language.identify(docs).collect()
    assert len(got) == len(rows) + len(junk) + 2
    by_id = {r["doc_id"]: r for r in got}
    for i, _, lg, _, _ in rows:
        assert by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert by_id[i]["lang_pred"] == lg and not by_id[i]["rejected"] and 0.5 < by_id[i]["score"] <= 1
    assert by_id[2000]["lang_pred"] == "cc" and by_id[None]["lang_pred"] == "bb" and not by_id[None]["held_out"]
    assert by_id[1000]["rejected"]
    for i in (1001, 1002, 1003, 1004):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["rejected"]) == ("und", 0.0, True)
    kept = language.kept(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if not r["rejected"])


def test_nothing_labelled_or_nothing_at_all(spark):
    assert [r["lang_pred"] for r in language.identify(frame(spark, [(1, "abc", None, "s", 1)])).collect()] == ["und"]
    assert language.identify(frame(spark, [])).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    def luhn(d):
        s = 0
        for i, c in enumerate(map(int, d[::-1])):
            s += c if i % 2 == 0 else sum(divmod(2 * c, 10))
        return s % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def ours(text):
    return [(s, k, e) for s, e, k in pii.base_spans(text)]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "-", " ", "+", "1", "23", "4111", "1111", "4111111111111111", "255", "256", "(", ")", "é", "\n", "x@y.zz", "1.2.3.4", "+1 (555) 010-9999"]), max_size=24).map("".join))
def test_base_forms(text):
    assert ours(text) == brute_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000 + " a@b", "a@" * 100_000, "+1" + "(" * 300_000, "1." * 200_000, "9 " * 200_000):
        pii.base_spans(text)


def test_patterns_find_what_no_form_catches(spark):
    rng = random.Random(2)
    rows = [(i, f"Some words here. Please call us on +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} today.", "en", "s", 0) for i in range(12)]
    rows += [(100, "Some other. please call us on 555-0134 today.", "en", "s", 0), (101, "The part number is 555-0199 here.", "en", "s", 0), (102, None, "en", "s", 5), (103, "", "en", "s", 0), (104, "mail x@y.org, ip 10.0.0.1 and 999.1.1.1", "en", "s", 40), (104, "mail x@y.org, ip 10.0.0.1 and 999.1.1.1", "en", "s", 40), (None, "ok", None, None, None)]
    docs = frame(spark, rows).withColumn("spans", F.lit("mine")).withColumn("seen", F.lit(1))
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows)
    names = ("email", "ip", "card", "phone")
    for r in got:
        text = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        base = [f"{names[k]}:{s}:{e}" for s, k, e in brute_spans(text)]
        assert [r[f"n_{n}"] for n in names] == [sum(b.startswith(n) for b in base) for n in names]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        if r["doc_id"] == 100:
            start = text.index("555")
            assert r["spans"] == f"phone:{start}:{start + 8}" and r["n_added"] == 1
        else:
            assert r["spans"] == ",".join(base) and r["n_added"] == 0
    out = {r["doc_id"]: r for r in pii.masked(docs).collect()}
    assert pii.masked(docs).columns == docs.columns and out[100]["text"] == "Some other. please call us on <PHONE> today." and out[100]["n_chars"] == len(out[100]["text"])
    assert out[101]["text"] == rows[13][1] and out[102]["text"] is None and out[102]["n_chars"] == 5 and out[104]["text"] == "mail <EMAIL>, ip <IP> and 999.1.1.1" and out[104]["spans"] == "mine"
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_many_trusted_patterns_go_by_a_join(spark, monkeypatch):
    rows = [(i, f"please call us on +1 (555) 555-{1000 + i} today", "en", "s", 0) for i in range(9)] + [(100, "please call us on 555-0134 today", "en", "s", 0), (7, None, "en", "s", 0)]
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    out = {r["doc_id"]: r["text"] for r in pii.masked(frame(spark, rows)).collect()}
    assert out[100] == "please call us on <PHONE> today" and out[3] == "please call us on <PHONE> today"


def test_masks_join_overlaps():
    assert pii.masked_text("ab 12 cd", [(3, 5, 2), (4, 6, 3), (0, 2, 0)]) == "<EMAIL> <CARD>cd"
    assert np.isfinite(1.0)
