"""Mixing and packing: exact quotas and whole contents, on small tables and edge cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netprism.llm import mixing, packing
from netprism.llm.common import word_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=9), st.integers(1, 13), st.integers(0, 99))
def test_split_keeps_both_margins(quotas, shards, seed):
    total = sum(quotas)
    margins = [total // shards + (i < total % shards) for i in range(shards)]
    table = mixing.split(np.array(quotas), np.array(margins), np.random.default_rng(seed))
    assert table.sum(axis=1).tolist() == quotas and table.sum(axis=0).tolist() == margins and (table >= 0).all()


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Water filling by hand: sources by code point, null last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    out, left, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        add = {s: left * w[s] / total for s in free}
        left = 0.0
        for s in list(free):
            out[s] += add[s]
            if out[s] >= most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                free.discard(s)
    return out


def test_targets_and_taken_words(spark):
    rng = np.random.default_rng(1)
    sources = ["a", "b", "B", "é", "z", None]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), sources[min(int(rng.integers(0, 9)), 5)]) for i in range(900)]
    got = mixing.mixed_counts(make(spark, rows), shards=5).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(900))
    sizes, source = {}, {i: s for i, _, s in rows}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    again = mixing.mixed_counts(make(spark, rows[::-1]).repartition(3), shards=5).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in got}


def test_mix_holds_each_document_as_often_as_counted(spark):
    rows = [(i, f"text number {i} " + "x " * (i % 7), f"s{i % 4}") for i in range(200)]
    docs = make(spark, rows).withColumn("k", F.lit(5)).withColumn("Size", F.lit("mine"))
    counts = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mixed_counts(docs, shards=3).collect()}
    out = mixing.mixed(docs, shards=3)
    assert out.columns == docs.columns
    seen = {}
    for r in out.collect():
        assert r["k"] == 5 and r["Size"] == "mine" and r["text"] == rows[r["doc_id"]][1]
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {i: c for i, c in counts.items() if c}


def test_shards_are_mixed_alike(spark):
    rows = [(i, "a b c d", f"s{i % 3}") for i in range(3000)]
    per = mixing.mixed_counts(make(spark, rows), shards=4).select(F.expr("doc_id % 3").alias("s"), F.explode("shards").alias("shard")).groupBy("s", "shard").count().collect()
    sizes = {}
    for r in per:
        sizes.setdefault(r["shard"], {})[r["s"]] = r["count"]
    assert len(sizes) == 4 and all(len(v) == 3 for v in sizes.values())


def test_many_sources_are_split_in_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 4)
    rows = [(i, "a b c", f"s{i % 30:02d}") for i in range(300)]
    got = mixing.mixed_counts(make(spark, rows), shards=3).collect()
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * 900, abs=3 * 30)
    assert {s for r in got for s in r["shards"]} <= {0, 1, 2}


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (1, "", "a")], [(None, "x y", None), (None, "x y", None), (2, "x", "a")], [(1, "w " * 50_000, "a"), (2, "w", "a")]])
def test_mixing_edge_cases(spark, rows):
    got = mixing.mixed_counts(make(spark, rows)).collect()
    assert sorted(((r["doc_id"] or -1), r["size"]) for r in got) == sorted(((i or -1), len((t or "").split())) for i, t, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mixed(make(spark, rows)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_is_valid_and_downsized(sizes):
    where, cut = packing.best_fit(sizes, (8, 16, 32, 64))
    held = [0] * len(cut)
    for s, b in zip(sizes, where, strict=True):
        held[b] += s
    for h, c in zip(held, cut, strict=True):
        assert c == min(x for x in (8, 16, 32, 64) if x >= h > 0)


def test_best_fit_is_no_dearer_than_one_length():
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(1, 600, 400)]
    total = lambda caps: sum(map(packing.cost, packing.best_fit(sizes, caps)[1]))
    assert total((512, 1024, 2048, 4096)) <= min(total((1024,)), total((2048,)), total((4096,)))


def check_packed(rows, caps, sizes):
    bins, parts = {}, {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        if r["bin_id"] is not None:
            bins.setdefault((r["bin_id"], r["bin_capacity"]), []).append((r["bin_offset"], r["length"]))
        else:
            assert r["length"] == 0
    for (_, cap), held in bins.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at and n > 0
            at += n
        assert cap == min(c for c in caps if c >= at)
    for i, n in sizes.items():
        at = 0
        for start, length in sorted(parts[i]):
            assert start == at
            at += length
        assert at == n
    assert len({b for b, _ in bins}) == len(bins)


def test_packing_keeps_everything(spark):
    rng = np.random.default_rng(3)
    sizes = {i: int(x) for i, x in enumerate(rng.integers(0, 300, 500))} | {1000: 64 * 5, 1001: 64 * 3 + 1, 1002: 0}
    docs = spark.createDataFrame(list(sizes.items()), "doc_id long, n long").repartition(3).withColumn("bin_id", F.lit("mine"))
    rows = packing.pack(docs, "doc_id", F.col("n"), (16, 32, 64), chunk_rows=50).collect()
    check_packed(rows, (16, 32, 64), sizes)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a b"), (1, "a b"), (1, "a b")], [(None, "x " * 9000), (3, "")]])
def test_packing_edge_cases(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, "doc_id", word_count(F.col("text"))).collect()
    assert sum(r["length"] for r in got) == sum(len((t or "").split()) for _, t in rows)
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}
