"""Archives, filter interactions and spelling variants against plain versions, on small tables and edge cases."""

import hashlib
import random
import zlib
from base64 import b32encode
from itertools import permutations

import zstandard

from netprism.llm import interaction, queries, variants, warc

PAGES = "page_id long, url string, html string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def pages_like(rng, n):
    words = [f"word{i}" for i in range(60)]
    rows = [(i, f"https://example.org/{i}?a=b c", "<html><body>" + " ".join(rng.choice(words) for _ in range(80)) + "</body></html>") for i in range(n)]
    rows += [(n, None, None), (n + 1, "x\r\ny", ""), (n + 2, "é", rows[0][2]), (n + 3, "u", rows[0][2]), (n + 3, "u", rows[0][2]), (None, "u", rows[0][2]), (None, "v", "alone é "), (n + 4, "big", "ab" * 700_000)]
    rows += [(n + 5, "sep", "x" + warc.SEPARATOR * 5 + "\x00\n\n")]
    return rows


def plain_records(rows, least=0):
    held = {}
    for k, _, h in rows:
        p = (h or "").encode()
        if len(p) >= least and k is not None:
            held[p] = max(held.get(p, k), k)
    out = []
    for k, _, h in rows:
        p = (h or "").encode()
        first = held.get(p) if len(p) >= least else None
        again = first is not None and k != first
        out.append((k, len(p), b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_archives_come_back_whole(spark, tmp_path):
    rows = pages_like(random.Random(3), 60)
    table = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as digest", "2 as first", "'x' as `key`").repartition(3)
    warc.write_archives(table, f"{tmp_path}/a")
    got = warc.read_archives(spark, f"{tmp_path}/a").collect()
    seen = sorted(((r["key"] and int(r["key"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"])) for r in got), key=str)
    assert seen == plain_records(rows)
    texts = sorted((h or "").encode() for k, _, h in rows)
    responses = {r["payload_digest"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert sorted(responses[r["payload_digest"]] for r in got) == texts
    assert all(r["payload"] is None for r in got if r["record_type"] == "revisit")
    assert {r["url"] for r in got} >= {"about:blank", "x%0D%0Ay", "https://example.org/3?a=b%20c", "é"}
    ids = {r["record_id"] for r in got if r["record_type"] == "response"}
    assert all(r["refers_to_id"] in ids for r in got if r["record_type"] == "revisit")


def test_archive_is_a_dictionary_and_frames(spark, tmp_path):
    rows = pages_like(random.Random(4), 60)
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/a")
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "a").glob("part-*")))
    assert data[:4] == warc.DICTIONARY_MAGIC and data.endswith(warc.SEPARATOR.encode())
    size = int.from_bytes(data[4:8], "little")
    own = zstandard.ZstdCompressionDict(zstandard.decompress(data[8 : 8 + size]))
    assert own.dict_id() > 0
    stream = zstandard.ZstdDecompressor(dict_data=own).stream_reader(data[8 + size :], read_across_frames=True)
    text = stream.read(1 << 26)  # any reader that knows the dictionary sees records one after the other
    assert text.count(b"WARC/1.1\r\n") == len(rows) and text.startswith(b"WARC/1.1\r\n")
    assert b"".join(warc.records_of(data)) == text


def test_payloads_under_the_least_are_responses(spark):
    rows = [(1, "u", "short"), (2, "u", "short"), (3, "u", "a longer one"), (4, "u", "a longer one")]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES), least=6).collect()
    assert sorted(((int(r["key"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"])) for r in got), key=str) == plain_records(rows, 6)


def test_damage_is_found():
    raw = warc.record("1", "u", 3, b32encode(hashlib.sha1(b"abc").digest()).decode(), b"abc", None, None, "2000-01-01T00:00:00Z")
    assert warc.parsed(raw)["payload"] == b"abc"
    for bad in (raw.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"), raw[:-3]):
        try:
            warc.parsed(bad)
        except ValueError:
            continue
        raise AssertionError("damage went unseen")


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op11_warc(spark, f"{tmp_path}").count() == 0


# --- filter interactions ------------------------------------------------------
def plain_masks(rows):
    out = {}
    for i, t, lang, *_ in rows:
        t = t or ""
        w = [x for x in "".join(c if c not in " \t\n\v\f\r" else " " for c in t).split(" ") if x]
        smaller = any(j is not None and i is not None and j < i and (u or "") == t for j, u, *_ in rows)
        fails = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), smaller)
        out.setdefault(lang or "", []).append((i, {c for c, f in zip("ABCDE", fails, strict=True) if f}))
    return out


def plain_steps(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = []
    for part, docs in plain_masks(rows).items():
        mine, sums = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                fails = sum(c in f for _, f in docs)
                sums[c] += len(gone)
                mine.append([part, order, step, len(left), len(gone), fails - len(gone), sum(f == {c} for _, f in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), c])
        out += [(*r[:-1], sums[r[-1]]) for r in mine]
    return sorted(out)


def test_steps_of_all_orders(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([20, 400])]) for _ in range(rng.choice([30, 99, 100, 101, 160]))) + rng.choice(["", " A|B", " SHOUTING" * 40]), rng.choice(["en", "de", None]), "s", 1) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1], rows[i % 5][2], "s", 1) for i in range(30)]
    rows += [(200, None, "en", None, None), (201, "", "en", None, None), (201, "", "en", None, None), (None, "", "fr", None, None), (None, rows[3][1], None, None, None), (202, "one two " * 40_000, "fr", "s", 1)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 120, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (201, 1, 0), (999, 1, 1)]
    spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as id", "'x' as part", "true as A").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op12_filter_interactions(spark, f"{tmp_path}")
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_steps(rows, labels)


def test_swaps_keep_the_diagram_small():
    rng = random.Random(6)
    held = {m: (rng.randrange(1, 5), rng.randrange(2), 0) for m in range(16) if rng.random() < 0.8}
    d = interaction.Diagram(held, 4)
    before = len(d.nodes)
    for level in [0, 1, 2, 2, 1, 0]:
        d.swap(level)
    assert d.order == [0, 1, 2, 3] and len(d.nodes) == before and d.root == interaction.Diagram(held, 4).root
    # masks that fill independently share their nodes
    even = interaction.Diagram({m: (1, 0, 0) for m in range(32)}, 5)
    assert len(even.nodes) == 5


def test_orders_come_once():
    for width in range(1, 6):
        order = list(range(width))
        seen = {tuple(order)}
        for level in interaction.neighbour_swaps(width):
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(width))))


def test_no_documents_no_steps(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert interaction.filter_interactions(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "en", "s", 1)], DOCS)
    assert {(r["kept"], r["good_lost"]) for r in interaction.filter_interactions(one, labels).where("step = 5").collect()} == {(0, 0)}


# --- spelling variants ----------------------------------------------------------
def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_words(rows):
    import re

    n = {}
    for i, t, *_ in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def plain_variants(n):
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return sorted(out, key=str)


def test_words_and_their_forms(spark, tmp_path):
    rng = random.Random(7)
    bases = ["".join(rng.choice("abcdeéÿ×") for _ in range(rng.choice([6, 7, 8, 12]))) for _ in range(12)] + ["aaaaaa", "z" * 300]
    rows, i = [], 0
    for b in bases:
        for step, times in ((b, 200), (b[:-1] + "q", 30), (b[1:-1] + "q", 5), (b + "e", 6), (b[:2].upper() + b[2:], 7), (b[:3] + "Ä" + b[3:], 5)):
            for _ in range(times):
                rows.append((i, f"{step}, x{step}9", "en", "s", 1))
                i += 1
    rows += [(None, "nothing nothing nothing nothing nothing", None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "repeated rows here", "en", "s", 0), (2, "repeated rows here", "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as word", "2 as n", "3 as own").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_spelling_variants(spark, f"{tmp_path}")
    want = plain_variants(plain_words(rows))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(form and root != form for _, form, root, *_ in want)


def test_neighbourhoods_are_whole_and_single():
    rng = random.Random(8)
    for n in (1, 2, 5, 9):
        words = sorted({"".join(rng.choice("abcdefg") for _ in range(n)) for _ in range(6)})
        for rows in (1, 1 << 18):
            held = [(int(i), int(k)) for at, keys in variants.neighbourhoods(words, rows) for i, k in zip(at, keys, strict=True)]
            assert len(held) == len(set(held))
            s = variants.symbols(words).tolist()
            for i, own in enumerate(s):
                near = {tuple(own)} | {tuple(own[:k] + own[k + 1 :]) for k in range(n)}
                near |= {tuple(own[:k] + [x] + own[k + 1 :]) for k in range(n) for x in range(1, 9)} | {tuple(own[:k] + [x] + own[k:]) for k in range(n + 1) for x in range(1, 9)}
                power = [pow(variants._BASE, p, 1 << 64) for p in range(n + 2)]
                assert {k for j, k in held if j == i} == {sum(x * p for x, p in zip(w, power, strict=False)) % (1 << 64) for w in near}


def test_no_words(spark):
    assert variants.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, "few words", "en", "s", 1)], DOCS)).count() == 0


def test_words_in_one_reduced_form(spark, monkeypatch):
    monkeypatch.setattr(variants, "SYMBOLS", 1)
    n = {"".join(w): 5 + i for i, w in enumerate(permutations("abcdef"))}
    got = variants.variants(spark.createDataFrame(list(n.items()), "word string, n long")).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect()), key=str) == plain_variants(n)
