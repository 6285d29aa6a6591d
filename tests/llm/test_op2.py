"""SimHash: fingerprints by hand, links and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netprism.llm import simhash
from netprism.llm.common import components


def brute_print(text, words=3):
    parts = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    nodes = sorted(set(prints))
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                up[find(a)] = find(b)
    return {x: find(x) for x in nodes}


TEXTS = ["One two THREE four", "one  two\tthree\nfour", "", None, "  ", "a", "a b", "a b c", "Äpfel ÄPFEL äpfel one", "x " * 5000, "x y z " * 40_000]


def test_fingerprints(spark):
    for t in TEXTS[:-1]:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_print(t)
    got = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").select("i", simhash.hexed(simhash.fingerprint_column(F.col("text"))[0]).alias("h")).collect()
    assert {r["i"]: r["h"] for r in got} == {i: f"{simhash.fingerprint(None if t is None else t.encode()):016x}" for i, t in enumerate(TEXTS)}
    shingles = spark.sql("select xxhash64('one two three') h").first()["h"] & (2**64 - 1)
    assert shingles == xxhash.xxh64_intdigest("one two three", 42)  # the same function as Spark's


def near(rng, n, groups, spread):
    out = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(n):
            x = base
            for _ in range(rng.randrange(spread)):
                x ^= 1 << rng.randrange(64)
            out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


@pytest.mark.parametrize(("paired", "parts"), [(64, (1, 2, 3, 4)), (2, (1, 2, 3, 4)), (3, (3,)), (2, (2,)), (1000, (1,)), (2, (4,))])
@pytest.mark.parametrize("radius", [2, 1])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, paired, parts, radius):
    monkeypatch.setattr(simhash, "PARTITIONS", parts)
    prints = near(random.Random(paired + radius), 30, 4, 6) + near(random.Random(9), 1, 60, 1)
    df = spark.createDataFrame([(x,) for x in sorted(set(prints))], "fp long")
    edges = simhash.links(df, len(set(prints)), radius, paired)
    for r in edges.collect():
        assert bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= (radius if radius % 2 == 0 else radius)
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    want = brute_components(prints, radius)
    groups = lambda m: sorted(sorted(x for x in m if m[x] == r) for r in set(m.values()))
    assert groups({x: roots.get(x, x) for x in want}) == groups(want)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    nodes = list(range(300))
    rng.shuffle(nodes)
    edges = [*zip(nodes[:120], nodes[1:120], strict=False), *((nodes[150], x) for x in nodes[151:250])]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in nodes[:120]} == {min(nodes[:120])} and {got[x] for x in nodes[150:250]} == {min(nodes[150:250])}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_several_fingerprints_keep_more_copies_together(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    rows, found = [], {}
    for g in range(40):
        base = [rng.choice(words) for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(200), 2):
            other[at] = "changed"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    for count in (1, 8):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(spark, rows), count=count).collect()}
        assert all(got[2 * g] == 2 * g for g in range(40))
        found[count] = sum(got[2 * g + 1] == 2 * g for g in range(40))
    plain = sum(min(bin(a ^ b).count("1") for a, b in zip(simhash.fingerprints(rows[2 * g][1].encode(), 3, 8), simhash.fingerprints(rows[2 * g + 1][1].encode(), 3, 8), strict=True)) <= 2 for g in range(40))
    assert found[8] == plain and found[8] > 3 * found[1]
    assert len(simhash.one_each(documents(spark, rows), count=8).collect()) == 80 - plain


def test_thresholds_cost_least():
    cost, ts = simhash.allocate([[5.0, 9.0, 90.0], [4.0, 50.0, 60.0], [100.0, 200.0, 300.0]], 2)
    assert cost == 13.0 and ts == [1, 0, -1]
    both = np.zeros((64, 64))
    groups = simhash.grouped(both, 10, 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {21, 22}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, fp int")


def test_documents_and_edge_cases(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(i, " ".join(base)) for i in (9, 5, 7)] + [(11, " ".join([*base[:150], "other", *base[151:]]))] + [(20 + i, " ".join(rng.choices(words, k=80))) for i in range(30)]
    rows += [(60, None), (61, ""), (62, " \n"), (9, " ".join(base)), (None, "quite alone here")]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    roots = brute_components([brute_print(t) for _, t in rows], 2)
    by_root = {}
    for i, t in rows:
        if i is not None:
            by_root[roots[brute_print(t)]] = min(i, by_root.get(roots[brute_print(t)], i))
    want = sorted((str(i), by_root.get(roots[brute_print(t)])) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(documents(spark, rows), count=3).collect()) == want
    kept = simhash.one_each(documents(spark, rows)).collect()
    assert len(kept) == len(set(roots.values())) and all(r["fp"] == 7 for r in kept)
    plain = [(i, t) for i, t in rows[:34] if i is not None]
    assert sorted(r["doc_id"] for r in simhash.one_each(documents(spark, plain)).collect()) == sorted({min(i for i, t in plain if roots[brute_print(t)] == r) for r in {roots[brute_print(t)] for _, t in plain}})
    assert simhash.one_each(documents(spark, [])).count() == 0
