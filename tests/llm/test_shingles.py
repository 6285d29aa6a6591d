"""The near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline as pipeline
from netprism.llm import shingles


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    held = {i: sets(t) for i, t in rows}
    up = {i: i for i in held}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in held:
        for b in held:
            if a < b and similar(held[a], held[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in held}


def graded(rng, groups=60):
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(0, 200, 5), 2 + g % 9):
            other[at] = "changed"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    return rows


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_drops_copies_of_80_percent_and_no_others(spark):
    rows = graded(random.Random(5))
    want = brute(rows)
    between = [g for g in range(60) if want[2 * g + 1] == 2 * g and len(sets(rows[2 * g][1]) & sets(rows[2 * g + 1][1])) < 0.9 * len(sets(rows[2 * g][1]) | sets(rows[2 * g + 1][1]))]
    assert len(between) > 5 and any(want[2 * g + 1] != 2 * g for g in range(60))
    kept = dict(pipeline.STAGES)["near_duplicates"](spark, documents(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_hot_bands_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK_ROWS", 4)
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    rows = []
    for i in range(60):
        other = list(base)
        for at in rng.sample(range(300), 3):
            other[at] = f"x{i}"
        rows.append((i, " ".join(other)))
    rows += [(70, None), (71, ""), (72, " \n"), (80, "just three words"), (81, "Just  three WORDS"), (90, "one two three four five six")]
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute(rows[:60]) | {70: 70, 71: 70, 72: 70, 80: 80, 81: 80, 90: 90}
    again = [*rows, (90, rows[-1][1]), (None, "quite alone here")]
    assert len(shingles.one_each(documents(spark, again)).collect()) == len(set(got.values())) + 1
    assert shingles.one_each(documents(spark, [])).count() == 0


def templated(rng, pages, words=300, alike=0.64):
    """Pages of one template that are not alike enough, among them clusters that are, bridged by single documents."""
    shared = [f"t{i}" for i in range(words)]
    rows, at = [], 0

    def page(base, changes, tag):
        out = list(base)
        for k in range(changes):
            out[rng.randrange(len(out) // 5) * 5] = f"{tag}x{k}"
        return out

    for p in range(pages):
        base = page(shared, 16, f"p{p}")
        for c in range(3):
            rows.append((at, " ".join(page(base, 1 + c, f"c{at}"))))
            at += 1
    left, right = page(shared, 4, "l"), page(shared, 4, "r")
    for i in range(8):
        rows.append((at, " ".join(page(left, 2, f"a{i}"))))
        rows.append((at + 1, " ".join(page(right, 2, f"b{i}"))))
        at += 2
    middle = left[: words // 2] + right[words // 2 :]
    rows.append((at, " ".join(middle)))
    return rows


def test_no_link_is_lost_in_hot_bands(spark, monkeypatch):
    rows = templated(random.Random(12), 25)
    want = brute(rows)
    assert 10 < len(set(want.values())) < 40 and max(list(want.values()).count(v) for v in set(want.values())) > 3
    for block in (2, 16, 512):
        monkeypatch.setattr(shingles, "BLOCK_ROWS", block)
        got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(documents(spark, rows)).collect()}
        assert got == want, block


def test_cell_joins_what_it_can():
    rng = random.Random(13)
    rows = templated(rng, 6)
    held = [shingles.hashes(t.encode()) for _, t in rows]
    cell = [(i, i, len(h), shingles.sketched(h)[1], h.astype("uint32").tobytes(), i % 2) for i, h in enumerate(held)]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in shingles.linked_in_cell(cell, False):
        assert similar(sets(rows[a][1]), sets(rows[b][1])) and find(a) != find(b)
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: find(i) for i in range(len(rows))} == brute(rows)
    assert all(a % 2 != b % 2 for a, b in shingles.linked_in_cell(cell, True))
