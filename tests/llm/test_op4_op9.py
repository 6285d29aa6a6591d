"""Vector searches against brute force over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netprism.llm import ann, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], VECTORS).repartition(3).withColumn("v", F.lit("mine")).withColumn("norm", F.lit(1))


def ok(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, step, k, score, rank_of):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for q in sorted({i for i, _ in rows if i % step == 0}):
        own = min(v for i, v in rows if i == q)
        found = sorted((rank_of(score(own, v)), i, score(own, v)) for i, v in rows if i != q and len(v) == len(own))[:k]
        out += [(q, n + 1, i, s) for n, (_, i, s) in enumerate(found)]
    return out


def product(a, b):
    return sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b, strict=True))


def vectors(n, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.choice([0.1, 1.0, 3.0], size=(n, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n + i, x[5].tolist()) for i in range(n // 3)]  # a vector that a quarter of the rows share
    return rows


ODD = [(5000, None), (5020, [1.0, None, 2.0]), (5040, [float("nan")] * 8), (5060, [float("inf")] + [0.0] * 7), (5080, [0.0] * 8), (None, [1.0] * 8), (5100, [1.0, 2.0]), (5101, [2.0, 1.0]), (5120, []), (5121, [])]


def as_rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("seeds", [2048, 30, 0])
def test_top_products_are_exact(spark, monkeypatch, seeds):
    monkeypatch.setattr(topk, "SEED_ROWS", seeds)
    rows = vectors(400) + ODD
    got = as_rows(topk.top_products(frame(spark, rows), F.col("vec_id") % 20 == 0, block_rows=100))
    assert got == brute(rows, 20, 20, product, lambda s: -s)


def test_coordinate_ranges_keep_all_that_count():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for a in x[:40]:
        for c in (-0.5, 0.1, 0.6, 0.95):
            f = int(np.abs(a).argmax())
            low, high = topk._feasible(c, a[f])
            hit = x[x @ a >= c]
            assert ((hit[:, f] >= low) & (hit[:, f] <= high)).all()


def test_large_products_and_few_rows(spark):
    rows = [(0, [3e7, 3e7]), (1, [3e7, 2e7]), (2, [-3e7, 1e7])]
    assert as_rows(topk.top_products(frame(spark, rows), F.col("vec_id") % 20 == 0)) == brute(rows, 20, 20, product, lambda s: -s)
    assert as_rows(topk.top_products(frame(spark, []), F.col("vec_id") % 20 == 0)) == []
    assert as_rows(topk.top_products(frame(spark, [(20, [1.0])]), F.col("vec_id") % 20 == 0)) == []
    rows = [(20, [1.0]), (20, [0.5]), (3, [1.0]), (3, [1.0])]
    assert as_rows(topk.top_products(frame(spark, rows), F.col("vec_id") % 20 == 0)) == brute(rows, 20, 20, product, lambda s: -s)


def distance(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))


def test_nearest_has_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=8)).tolist()) for i in range(1500)]
    rows += [(9000 + i, rows[7][1]) for i in range(500)] + [r for r in ODD if r[0] != 5120 and r[0] != 5121]
    got = as_rows(ann.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, fit_rows=800, parts=16))
    usable = [(i, v) for i, v in rows if i is not None and ok(v) and any(v)]
    want = brute(usable, 100, 10, distance, lambda s: s)
    hits = {(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}
    assert len(hits) >= 0.9 * len(want)
    floats = {i: [float(np.float32(x)) for x in v] for i, v in usable}
    for q, _, i, s in got:
        assert s == pytest.approx(distance(floats[q], floats[i]), rel=1e-12, abs=1e-300)
    shared = [(q, r, i, s) for q, r, i, s in got if q == 9000]
    assert [i for _, _, i, _ in shared] == [7, *range(9001, 9010)] and all(s == 0 for *_, s in shared)
    assert [(i, s) for q, _, i, s in got if q == 5100] == [(5101, math.sqrt(2))]


def test_nearest_of_few_or_none(spark):
    assert as_rows(ann.nearest(frame(spark, []), F.col("vec_id") % 100 == 0)) == []
    assert as_rows(ann.nearest(frame(spark, [(100, [0.0, 0.0])]), F.col("vec_id") % 100 == 0)) == []
    assert as_rows(ann.nearest(frame(spark, [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 2.0])]), F.col("vec_id") % 100 == 0)) == [(100, 1, 1, 0.0), (100, 2, 1, math.sqrt(5))]


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(640, 5))
    part = ann.balanced_parts(ann.neighbours(x, 8), x, 16, rng)
    assert np.bincount(part, minlength=16).max() <= math.ceil(1.1 * 640 / 16)
