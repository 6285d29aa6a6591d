"""Approximate nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into balanced parts; a small classifier learns the parts of a vector's
neighbours, puts every vector into its most probable part, and sends a query to the most probable ones, as many as a
calibration on sampled queries asks for; distances are then computed on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .vectors import BLOCK_ROWS, QUERY_ROWS, finite, matrix, salted, searched

#: Bound of the sample that graph, parts and classifier are fitted on; of the queries that set the number of probes.
FIT_ROWS, PROBE_QUERIES = 6000, 600
PARTS, NEIGHBOURS, HIDDEN, EPOCHS = 32, 12, 96, 25
#: Share of a sampled query's neighbours that its probed parts must hold, on average.
TARGET = 0.97


def neighbours(x: np.ndarray, k: int, rows: np.ndarray | None = None) -> np.ndarray:
    """The k nearest others of each row (of the given rows) among x."""
    rows = np.arange(len(x)) if rows is None else rows
    square = (x * x).sum(axis=1)
    out = []
    for at in range(0, len(rows), 512):
        some = rows[at : at + 512]
        d = square[None, :] - 2 * (x[some] @ x.T)
        d[np.arange(len(some)), some] = np.inf
        out.append(np.argpartition(d, k, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.1, rounds: int = 12) -> np.ndarray:
    """A balanced partition of the graph with few cut edges: even splits along main axes, then moves to where most neighbours are."""
    n = len(graph)
    part = np.zeros(n, np.int64)
    for _ in range(int(np.log2(parts))):
        new = part * 2
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            centred = x[at] - x[at].mean(axis=0)
            axis = rng.normal(size=x.shape[1])
            for _ in range(8):  # power iteration
                axis = centred.T @ (centred @ axis)
                axis /= np.linalg.norm(axis) + 1e-12
            new[at[np.argsort(centred @ axis, kind="stable")[len(at) // 2 :]]] += 1
        part = new
    most = int(np.ceil(slack * n / parts))
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], axis=1)
    for _ in range(rounds):
        ties = np.zeros((n, parts))
        np.add.at(ties, (both[0], part[both[1]]), 1.0)
        sizes = np.bincount(part, minlength=parts)
        gain = ties - ties[np.arange(n), part][:, None]
        goal = gain.argmax(axis=1)
        moved = 0
        for i in np.argsort(-gain[np.arange(n), goal], kind="stable"):
            to = goal[i]
            if gain[i, to] <= 0:
                break
            if to != part[i] and sizes[to] < most and rng.random() < 0.7:
                sizes[part[i]] -= 1
                sizes[to] += 1
                part[i] = to
                moved += 1
        if moved < n / 200:
            break
    return part


@dataclass
class Router:
    """Standardised input, one hidden layer, softmax over parts; probes: how many parts a query is sent to."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def shares(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.shares(x), axis=1, kind="stable")


def fit(x: np.ndarray, parts: int = PARTS, seed: int = 5) -> Router:
    """Router of a sample (rows in any order give like results; equal samples give equal ones)."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    k = min(NEIGHBOURS, n - 1)
    parts = min(parts, 1 << max(0, int(np.log2(max(n // 32, 1)))))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    if parts <= 1 or k < 1:
        return Router(mean, scale, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbours(x, k)
    part = balanced_parts(graph, x, parts, rng)
    target = np.zeros((n, parts))  # a row's own part and those of its neighbours
    np.add.at(target, (np.repeat(np.arange(n), k), part[graph].ravel()), 0.5 / k)
    target[np.arange(n), part] += 0.5
    w = {"w1": rng.normal(size=(dim, HIDDEN)) * np.sqrt(2 / dim), "b1": np.zeros(HIDDEN), "w2": rng.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN), "b2": np.zeros(parts)}
    m, v, step = {c: np.zeros_like(a) for c, a in w.items()}, {c: np.zeros_like(a) for c, a in w.items()}, 0
    z = (x - mean) / scale
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 128):
            rows = order[at : at + 128]
            h = np.maximum(z[rows] @ w["w1"] + w["b1"], 0)
            out = h @ w["w2"] + w["b2"]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            d = (out / out.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (d @ w["w2"].T) * (h > 0)
            grads = {"w1": z[rows].T @ back, "b1": back.sum(axis=0), "w2": h.T @ d, "b2": d.sum(axis=0)}
            step += 1
            for c, g in grads.items():
                m[c] = 0.9 * m[c] + 0.1 * g
                v[c] = 0.999 * v[c] + 0.001 * g * g
                w[c] = w[c] - 3e-3 * (m[c] / (1 - 0.9**step)) / (np.sqrt(v[c] / (1 - 0.999**step)) + 1e-8)
    router = Router(mean, scale, w["w1"], w["b1"], w["w2"], w["b2"])
    some = rng.permutation(n)[:PROBE_QUERIES]
    home = router.shares(x).argmax(axis=1)
    near = neighbours(x, min(10, n - 1), some)
    ranked = router.ranked(x[some])
    place = np.argsort(ranked, axis=1)  # rank of each part for each query
    needed = np.take_along_axis(place, home[near], axis=1)
    router.probes = next(p for p in range(1, parts + 1) if (needed < p).mean() >= TARGET)
    return router


def cell(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of one block for each query: picked by products, measured by differences."""
    out = []
    if len(asked) and len(held):
        q, v = matrix(asked), matrix(held)
        qids, ids = asked["query_id"].to_numpy(np.int64), held["vec_id"].to_numpy(np.int64)
        square, own = (v * v).sum(axis=1), (q * q).sum(axis=1)
        for at in range(0, len(q), 256):
            table = own[at : at + 256, None] + square[None, :] - 2 * (q[at : at + 256] @ v.T)
            table[qids[at : at + 256][:, None] == ids[None, :]] = np.inf
            for i, row in enumerate(table, start=at):
                ok = int(np.isfinite(row).sum())
                if not ok:
                    continue
                bound = np.partition(row, min(k, ok) - 1)[min(k, ok) - 1]
                near = np.flatnonzero(row <= bound + 1e-9 * (own[i] + square.max()))
                near = near[ids[near] != qids[i]]
                gap = v[near] - q[i]
                d = np.sqrt((gap * gap).sum(axis=1))
                top = np.lexsort((ids[near], d))[:k]
                out.append((np.full(len(top), qids[i]), ids[near[top]], d[top]))
    if not out:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vec: str = "embedding", fit_rows: int = FIT_ROWS, parts: int = PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by Euclidean distance, ties to the smaller id.

    Rows without an id, and vectors that are null, zero or hold null or non-finite components, take no part. The router
    is fitted for the commonest dimension; each other one is a part of its own, searched whole. A query row, or another
    row of its id, is no candidate of its own; of several query rows of one id the least vector asks. With fewer
    candidates than k all found are returned; an empty table gives no rows. Other columns are not read. A part that many
    vectors share is cut into blocks by a hash of the id.
    """
    own = vectors.select(vectors[key].cast("long").alias("vec_id"), is_query.alias("asks"), vectors[vec].alias("v")).where(F.col("vec_id").isNotNull() & finite(F.col("v")))
    rows = own.select("vec_id", "asks", F.transform("v", lambda x: x.cast("double")).alias("v"), F.size("v").alias("dim")).where(F.exists("v", lambda x: x != 0))
    dims = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    dim = max(dims, key=lambda d: (dims[d], d), default=0)
    spot = F.pmod(F.xxhash64(F.lit(17), "vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where((F.col("dim") == dim) & (spot < fit_rows / max(dims.get(dim, 0), 1))).select("vec_id", "v").distinct().orderBy(F.xxhash64(F.lit(17), "vec_id"), "vec_id", "v").limit(fit_rows + fit_rows // 4).collect()
    x = np.unique(np.array([r["v"] for r in sample], np.float64).reshape(len(sample), dim), axis=0) if sample else np.ones((1, max(dim, 1)))
    router = fit(x, parts) if len(x) > 1 else fit(np.ones((1, max(dim, 1))))
    sent = vectors.sparkSession.sparkContext.broadcast(router)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = sent.value
        for pdf in batches:
            goals: list = [[-int(d)] for d in pdf["dim"]]
            usual = np.flatnonzero(pdf["dim"].to_numpy() == dim)
            for at in range(0, len(usual), 2048):
                some = usual[at : at + 2048]
                first = r.ranked(matrix(pdf.iloc[some]))[:, : r.probes]
                for i, goal in zip(some, first, strict=True):
                    goals[i] = goal.tolist()
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "asks": pdf["asks"], "v": pdf["v"], "goals": goals})

    known = cut_lineage(rows.mapInPandas(routed, "vec_id long, asks boolean, v array<double>, goals array<int>"))
    blocks = cut_lineage(salted(known.select("vec_id", "v", F.col("goals")[0].alias("part")), BLOCK_ROWS, "part", by="vec_id"))
    asks = known.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "goals")).alias("s")).select("query_id", "s.v", F.explode("s.goals").alias("part"))
    teams = salted(asks, QUERY_ROWS, "part", by="query_id").withColumnRenamed("salt", "team")
    there = blocks.groupBy("part").agg((F.max("salt") + 1).alias("blocks"))
    crews = teams.groupBy("part").agg((F.max("team") + 1).alias("crews"))
    goes = teams.join(there, "part").withColumn("salt", F.explode(F.expr("sequence(0L, blocks - 1)")))
    placed = blocks.join(crews, "part").withColumn("team", F.explode(F.expr("sequence(0L, crews - 1)")))
    return searched(placed.select("part", "salt", "team", "vec_id", "v"), goes.select("part", "salt", "team", "query_id", "v"), ["part", "salt", "team"], lambda a, h: cell(a, h, k), k, [F.asc("score"), F.asc("vec_id")], "double")
