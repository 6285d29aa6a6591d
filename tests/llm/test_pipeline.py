"""Each stage against a plain version of it, over a table with edge cases."""

import random

import corpus_pipeline as pipeline
from netprism.llm import language, mixing, pii


def brute(rows):
    """Smallest id of the group of each document: five-word shingles of a Jaccard similarity of 0.8 or more link."""
    held = {}
    for i, t in rows:
        w = (t or "").lower().split()
        held[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in held}
    for a in held:
        for b in held:
            if a < b and 5 * len(held[a] & held[b]) >= 4 * len(held[a] | held[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return group


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    return f"{tmp_path}"


def rows():
    rng = random.Random(6)
    sounds = {"aa": ["ka", "lo", "mi", "te", "ru"], "bb": ["sch", "ung", "ein", "der", "el"]}
    out = []
    for i in range(120):
        lg = rng.choice(list(sounds))
        t = " ".join("".join(rng.choice(sounds[lg]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 90)))
        out.append([i, t, lg, f"s{i % 3}", len(t)])
    out[7][1] += " mail me@here.org now"
    out += [[200 + i, out[3][1], out[3][2], "s0", len(out[3][1])] for i in range(5)] + [[300, None, "aa", "s1", None], [301, "", "aa", None, 0], [302, "12 34", "aa", "s2", 5]]
    return [tuple(r) for r in out]


def test_stages(spark, tmp_path):
    data = rows()
    docs = spark.read.parquet(table(spark, tmp_path, data) + "/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language", "near_duplicates", "personal_data", "mixing", "packing"] and pipeline.ORACLE_SQL is None
    kept = [dict(pipeline.STAGES)["language"](spark, docs, "")]
    assert sorted(r["doc_id"] for r in kept[0].collect()) == sorted(i for i, t, *_ in data if t and any(c.isalpha() for c in t))
    one = dict(pipeline.STAGES)["near_duplicates"](spark, kept[0], "")
    groups = brute([(r["doc_id"], r["text"]) for r in kept[0].collect()])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(groups.values())) and not {200, 201} & set(groups.values())
    clean = dict(pipeline.STAGES)["personal_data"](spark, one, "")
    texts = {i: t for i, t, *_ in data}
    for r in clean.collect():
        assert r["text"] == pii.masked_text(texts[r["doc_id"]], pii.base_spans(texts[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    mixed = dict(pipeline.STAGES)["mixing"](spark, clean, "")
    counts = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mixed_counts(clean).collect()}
    seen = {}
    for r in mixed.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {i: c for i, c in counts.items() if c}
    for stage in (kept[0], one, clean, mixed):
        assert stage.columns == docs.columns
    total = sum(r["length"] for r in pipeline.run(spark, str(tmp_path)).collect())
    assert total == sum(len(r["text"].split()) for r in mixed.collect())
    assert language.UNKNOWN == "und"


def test_no_documents(spark, tmp_path):
    assert pipeline.run(spark, table(spark, tmp_path, [])).count() == 0


def test_extra_columns_null_keys_and_repeated_rows(spark):
    data = [(i, f"only words of number {i} stand here and nowhere else at all", "aa", "s", 1) for i in range(6)] + [(None, "nobody knows the key of this text, mail me@here.org", "aa", "s", 1), (7, None, "aa", None, None)]
    data += [data[2], data[6], (9, data[2][1], "aa", "s", 1)]
    docs = spark.createDataFrame(data, DOCS).selectExpr("*", "1 as node", "2 as root", "3 as size", "4 as keys", "5 as h", "'k' as `key`", "6 as component_id", "7 as id", "8 as t")
    one = dict(pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert one.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in one.collect()) == [(False, i) for i in (0, 1, 2, 3, 4, 5, 7)] + [(True, 0)]
    clean = dict(pipeline.STAGES)["personal_data"](spark, docs, "")
    assert clean.columns == docs.columns and clean.count() == len(data)
    assert not any("@" in (r["text"] or "") for r in clean.collect()) and {(r["node"], r["key"], r["t"]) for r in clean.collect()} == {(1, "k", 8)}
    mixed = dict(pipeline.STAGES)["mixing"](spark, docs, "")
    assert mixed.columns == docs.columns and {r["h"] for r in mixed.collect()} == {5}
