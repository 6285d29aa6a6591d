"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are put into buckets of like length. A query's k-th best score among the longest vectors bounds its answer from
below, and gives each bucket a local cosine threshold: above 1, the bucket is skipped for the query's group; else the
bucket is cut by length (its vectors are sorted by it), or by the range that the query's largest coordinate allows,
whichever leaves fewer. What is left is multiplied out in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .vectors import BLOCK_ROWS, QUERY_ROWS, finite, matrix, salted, searched

SCALE = 64.0
#: Longest vectors that the first bound is taken from; a bucket's lengths differ by less than this factor.
SEED_ROWS, BUCKET_STEP = 2048, 2 ** (1 / 16)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact whole-number inner products; beyond what doubles hold exactly, in Python's integers, cut to 64 bits."""
    most = np.abs(queries).max(initial=0.0) * np.abs(vectors).max(initial=0.0) * max(queries.shape[-1], 1)
    if most < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(exact(queries) @ exact(vectors).T, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bound)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _feasible(cosine: float, focus: float) -> tuple[float, float]:
    """Range of a unit vector's coordinate, if its cosine to a unit vector with `focus` there is `cosine` at least."""
    a, b = np.arccos(np.clip(cosine, -1, 1)), np.arccos(np.clip(focus, -1, 1))
    return (-1.0 if a + b >= np.pi else np.cos(a + b)) - 1e-9, (1.0 if a >= b else np.cos(b - a)) + 1e-9


def cell(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of one block for each of a group of queries that may reach it."""
    if not len(asked) or not len(held):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
    held = held.sort_values("norm", ascending=False, kind="stable")
    v, ids, norms = matrix(held), held["vec_id"].to_numpy(np.int64), held["norm"].to_numpy()
    q, qids, qnorms, bounds = matrix(asked), asked["query_id"].to_numpy(np.int64), asked["norm"].to_numpy(), asked["bound"].to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where((bounds > 0) & (qnorms > 0), bounds / qnorms * (1 - 1e-9), -np.inf)  # least length that can reach the bound
    by_length = np.searchsorted(-norms, -need, side="right")
    unit = v / np.maximum(norms, 1e-300)[:, None]
    sorted_at: dict[int, np.ndarray] = {}
    parts, whole = [], []
    for i in range(len(q)):
        n = int(by_length[i])
        if not n:
            continue
        picked = None
        if need[i] > 0 and n > 8 * k:
            f = int(np.abs(q[i]).argmax())
            if f not in sorted_at:
                sorted_at[f] = np.argsort(unit[:, f], kind="stable")
            low, high = _feasible(need[i] / norms[0], q[i, f] / qnorms[i])
            column = unit[sorted_at[f], f]
            lo, hi = np.searchsorted(column, low, side="left"), np.searchsorted(column, high, side="right")
            if hi - lo < n / 4:
                picked = sorted_at[f][lo:hi]
                picked = picked[picked < n]
        if picked is None:
            whole.append(i)
        elif len(picked):
            scores = products(q[i : i + 1], v[picked])[0]
            parts.append((i, ids[picked], scores))
    for at in range(0, len(whole), 512):
        rows = whole[at : at + 512]
        n = int(by_length[rows].max())
        table = products(q[rows], v[:n])
        parts += [(i, ids[:n], s) for i, s in zip(rows, table, strict=True)]
    out = []
    for i, at, scores in parts:
        ok = np.flatnonzero((scores >= bounds[i]) & (at != qids[i]))
        if len(ok):
            top = ok[best(scores[ok], at[ok], k)]
            out.append((np.full(len(top), qids[i]), at[top], scores[top]))
    if not out:
        return cell(asked.iloc[:0], held, k)
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(64 x), ties to the smaller id.

    Rows without an id, and vectors that are null or hold null or non-finite components, take no part; vectors of another
    dimension don't meet; empty vectors meet with score 0. A query row is no candidate of its own, nor is another row of
    its id; of several query rows of one id the least vector asks. Candidates of one id each count. With fewer candidates
    all are returned; an empty table gives no rows. Scores beyond 64 bits are cut to them. Other columns are not read.
    """
    own = vectors.select(vectors[key].cast("long").alias("vec_id"), is_query.alias("asks"), vectors[vec].alias("v")).where(F.col("vec_id").isNotNull() & finite(F.col("v")))
    whole = own.select("vec_id", "asks", F.transform("v", lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = whole.select("vec_id", "asks", "v", norm.alias("norm"), F.size("v").alias("dim"))
    rows = cut_lineage(rows.withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log("norm") / float(np.log(BUCKET_STEP)))).otherwise(-1).cast("int")))
    seeds: dict[int, list] = {}
    for r in rows.orderBy(F.desc("norm"), "vec_id").limit(SEED_ROWS).select("dim", "vec_id", "v").collect():  # SEED_ROWS at most
        seeds.setdefault(r["dim"], []).append((r["vec_id"], r["v"]))
    ready = {d: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.float64).reshape(len(x), d)) for d, x in seeds.items()}
    sent = vectors.sparkSession.sparkContext.broadcast(ready)

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low = np.full(len(pdf), -np.inf)
            for d, at in pdf.groupby("dim").indices.items():
                if d in sent.value:
                    ids, m = sent.value[d]
                    for lo in range(0, len(at), 256):
                        some = at[lo : lo + 256]
                        scores = products(matrix(pdf.iloc[some]).reshape(len(some), d), m).astype(np.float64)
                        scores[pdf["query_id"].to_numpy()[some][:, None] == ids[None, :]] = -np.inf
                        if len(ids) >= k:
                            low[some] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            yield pdf.assign(bound=low)

    asks = rows.where("asks").groupBy(F.col("vec_id").alias("query_id"), "dim").agg(F.min(F.struct("v", "norm")).alias("s")).select("query_id", "dim", "s.v", "s.norm")
    asked = asks.mapInPandas(bounded, "query_id long, dim int, v array<double>, norm double, bound double")
    # queries of like reach together: the lowest bucket that any of a group needs
    reach = F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.floor(F.log(F.col("bound") / F.col("norm")) / float(np.log(BUCKET_STEP)) - 1e-6)).otherwise(-(2**30)).cast("int")
    asked = cut_lineage(asked.withColumn("reach", reach))
    blocks = salted(rows.drop("asks"), block_rows, "dim", "bucket", by="vec_id").withColumnRenamed("salt", "block")
    groups = salted(asked, QUERY_ROWS, "dim", "reach", by="query_id").withColumnRenamed("salt", "asking")
    # by dimension: the blocks there are and the groups there are; each side is sent to where it must meet the other
    there = cut_lineage(blocks.groupBy("dim", "bucket").agg((F.max("block") + 1).alias("blocks")))
    teams = cut_lineage(groups.groupBy("dim", "reach").agg((F.max("asking") + 1).alias("teams")))
    meets = teams.groupBy("dim").agg(F.collect_list(F.struct("reach", "teams")).alias("all_teams"))  # lengths differ by factors: few
    open_to = there.join(meets, "dim").select("dim", "bucket", F.expr("flatten(transform(filter(all_teams, t -> t.reach <= bucket), t -> transform(sequence(0L, t.teams - 1), a -> struct(t.reach as reach, a as asking))))").alias("to"))
    # (a bucket may be as low as a group's reach: its vectors may be longer than its lower end)
    placed = blocks.join(open_to, ["dim", "bucket"]).withColumn("t", F.explode("to")).select("dim", "bucket", "block", "t.reach", "t.asking", "vec_id", "v", "norm")
    goes = there.groupBy("dim").agg(F.collect_list(F.struct("bucket", "blocks")).alias("all_blocks"))
    goals = teams.join(goes, "dim").select("dim", "reach", F.expr("flatten(transform(filter(all_blocks, b -> b.bucket >= reach), b -> transform(sequence(0L, b.blocks - 1), x -> struct(b.bucket as bucket, x as block))))").alias("to"))
    sent_out = groups.join(goals, ["dim", "reach"]).withColumn("t", F.explode("to")).select("dim", "t.bucket", "t.block", "reach", "asking", "query_id", "v", "norm", "bound")
    return searched(placed, sent_out, ["dim", "bucket", "block", "reach", "asking"], lambda a, h: cell(a, h, k), k, [F.desc("score"), F.asc("vec_id")], "long")
