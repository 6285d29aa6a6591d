"""Page text on templates that training has not seen; repeated passages and token counts against brute force."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netprism.llm import html_text, repeats, tokens

P1 = "The council met on Tuesday to speak about the new road, which is to cross the old market square from north to south."
P2 = "Shops fear that fewer people will come, while those who live there hope for less noise at night, and for a place for trees."
P3 = "A vote is planned for May."


@pytest.fixture(scope="module")
def model():
    return html_text.train([])


UNSEEN = [
    (f"<body><nav><a href=/>Start</a></nav><div class='main-content'><h1>Road &amp; market</h1><p>{P1}<p>{P2}<br>and more.</div><div class='side-bar'><p>Most read: <a href=/1>the old square</a></p></div><footer>Imprint</footer>", f"Road & market\n{P1}\n{P2} and more."),
    (f"<html><head><title>x</title><script>if (a < b) p('<p>no</p>')</script></head><body><header><ul><li><a href='/a'>A</a><li><a href='/b'>B</a></ul></header><article><h1>Road</h1>\n<p>{P1}</p><p>  {P3} </p></article><div class='comments-area'><p>I do not want this road, and I said so at the meeting last week, to no avail.</p></div></body></html>", f"Road\n{P1}\n{P3}"),
    (f"<body><div id=cookie-banner><p>This site uses cookies so that it works, and for nothing else that we know of.</p></div><main><p>{P1}</p><!-- <p>old</p> --><p>{P2}</p></main><div class=advertisement>Cheap roads, today only.</div></body>", f"{P1}\n{P2}"),
]


@pytest.mark.parametrize(("html", "text"), UNSEEN)
def test_unseen_templates(model, html, text):
    assert model.text(html) == text


def test_marginals_are_those_of_all_labellings(model):
    nodes, _ = html_text.parse(f"<body><div class=post><p>{P1}</p><p>{P3}</p></div><nav><p>x</p></nav></body>")
    html_text.featured(nodes)
    n, total, on = len(nodes), 0.0, [0.0] * len(nodes)
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        p = 1.0
        for i, x in enumerate(nodes):
            z = max(-30.0, min(30.0, sum(model.weights[f] for f in x.features) - model.prior))
            p *= (2.718281828459045**z if y[i] else 1.0) if x.tag not in html_text.HIDDEN else 1.0 - y[i]
            if i:
                p *= model.kept[x.tag in html_text.TEXT_TAGS][y[x.parent]][y[i]]
        total += p
        for i in range(n):
            on[i] += p * y[i]
    assert model.marginals(nodes) == pytest.approx([x / total for x in on], abs=1e-9)


def test_pages_and_edge_cases(spark):
    rows = [(1, "u", UNSEEN[1][0]), (2, None, None), (3, "u", ""), (None, "u", "just text, no tags"), (5, "u", "<p>" * 3000 + "deep"), (1, "u", UNSEEN[1][0]), (6, "u", "<article>" + f"<p>{P1}</p>" * 3000 + "</article>"), (7, "u", "<a href='x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("__x", F.lit(1))
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[1] == UNSEEN[1][1] and by_id[2] == by_id[3] == "" and by_id[6] == "\n".join([P1] * 3000)
    assert html_text.extract(pages.limit(0)).count() == 0


def brute_cut(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        hit = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = [True] * length
        runs = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(t), sum(hit), runs, hashlib.sha256(bytes(b for b, h in zip(t, hit, strict=True) if not h)).hexdigest()))
    return out


def cut(spark, rows, length, window):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("data", F.lit("mine")).withColumn("runs", F.lit(1))
    found = repeats.without_repeats(docs, length=length, window=window).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    return sorted(found.collect(), key=str)


@pytest.mark.parametrize(("length", "window", "seed", "paired"), [(40, 20, 1, 64), (40, 25, 2, 2), (64, 8, 3, 0), (48, 30, 4, 5)])
def test_repeats_are_those_of_all_strings(spark, monkeypatch, length, window, seed, paired):
    monkeypatch.setattr(repeats, "PAIRED_FORMS", paired)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = []
    for _ in range(60):
        t = " ".join(word() for _ in range(rng.randint(0, 40)))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            t += " " + s[a : a + rng.randint(10, 150)] + word()
        texts.append(t)
    texts += [texts[3], texts[3], "a" * 300, "ab" * 90, "", None, texts[5] + "!", "x" * (length - 1), "x" * (length - 1)]
    rows = [*enumerate(texts), (3, texts[3]), (None, "quite alone")]
    got = cut(spark, rows, length, window)
    want = brute_cut([(t or "").encode() for _, t in rows], length)
    assert [tuple(r) for r in got] == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=lambda r: "Row(doc_id=%r, n_bytes=%r, n_removed=%r, n_spans=%r, h=%r)" % r)


def test_no_rows_no_repeats(spark):
    assert cut(spark, [], 400, 240) == []


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=0, max_size=400), st.integers(3, 30))
def test_each_string_has_one_trigger_of_its_own(data, window):
    length = window + repeats.GRAM + 4
    places = repeats.parsed(data, length, window)
    starts = [s for _, first, last in places for s in range(first, last + 1)]
    assert starts == list(range(max(0, len(data) - length + 1)))
    for at, first, last in places:
        for s in range(first, last + 1):
            alone = repeats.parsed(data[s : s + length], length, window)
            assert alone == [(at - s, 0, 0)]


ODD_TEXTS = ["", None, " \t\n", "Hello World!", "it's we're I'LL 123 4", "<|endoftext|> a<|startoftext|>b <|endoftext|>", "über ÉCOLE ß ñ é ́x", "a b c\x1cd\x85e", "word" * 3000, "日本語 テスト 🙂🙂", "x\x00y", "a b " * 20_000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(spark, monkeypatch, name):
    monkeypatch.setattr(tokens, "PIECE_BYTES", 1000)
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        own = Tokenizer.from_file(path)
        want = [len(own.encode(t or "", add_special_tokens=False)) for t in ODD_TEXTS]
    else:
        import sentencepiece

        want = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t or "")) for t in ODD_TEXTS]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(ODD_TEXTS)], "doc_id int, text string, N_TOKENS int")
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs, path, by_word=name.startswith("word")).collect()}
    assert [got[i]["n_tokens"] for i in range(len(want))] == want
    assert [got[i]["n_bytes"] for i in range(len(want))] == [len((t or "").encode()) for t in ODD_TEXTS]
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got.values())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab '\n\té1.́"), max_size=60), st.integers(1, 9))
def test_pieces_join_again_and_batches_are_balanced(text, limit):
    data = text.encode()
    parts = list(tokens.pieces(data, limit))
    assert b"".join(parts) == data and all(p[:1].isspace() for p in parts[1:])
    assert [p for batch in tokens.balanced([data, None, data], 20, limit) for _, p in batch if p] == [p for p in parts + parts if p]
