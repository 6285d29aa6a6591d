"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks of documents.

1. Every source is cut into about sqrt(rows) blocks by a hash, so neither the block table nor a block grows as the rows do.
2. A source's target is an exact number of block draws: whole passes over its permuted blocks, then a part of one more
   pass; the last block is taken only as far as the target reaches, to the nearest document.
3. The draws of all sources are parted among output shards by a tree: at every node the left half's number of draws is
   fixed and its composition is a multivariate-hypergeometric sample of the node's quotas, so shards are mixed alike and
   quotas stay exact.
4. Each shard gets the next part of every source's permuted blocks (no draw twice), and is shuffled by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import numbered, small, word_count

#: Words of an output shard, and the most shards (a longer mix has longer shards).
SHARD_WORDS, MOST_SHARDS = 1 << 20, 4096
#: Sources that one node of the tree splits at once; more sources are split in groups of groups.
FAN = 1024


def split(quotas: np.ndarray, margins: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Random table of sources x shards with these row sums (quotas) and column sums (margins), by recursive halving."""
    out = np.zeros((len(quotas), len(margins)), np.int64)

    def node(lo: int, hi: int, q: np.ndarray) -> None:
        if hi - lo == 1:
            out[:, lo] = q
            return
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(q, int(margins[lo:mid].sum()), method="marginals")
        node(lo, mid, left)
        node(mid, hi, q - left)

    node(0, len(margins), np.asarray(quotas, np.int64))
    return out


def _fill(sources: DataFrame, total: float, most: float) -> DataFrame:
    """Targets: total shared by weight, none over most times its source's size, the excess reshared until none is above."""
    cap = F.col("source_size") * F.lit(most)
    level, fixed = 0.0, -1
    first = sources.agg(F.sum("weight").alias("w")).first()
    level = total / first["w"] if first["w"] else 0.0
    while True:  # each round caps one source more at least
        above = F.col("weight") * F.lit(level) >= cap
        r = sources.agg(F.count(F.when(above, 1)).alias("n"), F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("used"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if r["n"] == fixed or not r["w"]:
            break
        fixed, level = r["n"], max(level, (total - r["used"]) / r["w"])
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap).cast("double"))


def _shard_stops(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(k, stops): the running sums of a source's draws over shards; quotas: (k, rank, quota)."""
    top, width = quotas.agg(F.max("rank")).first()[0] or 0, 1
    levels = []
    while True:  # level i groups FAN ** i sources
        levels.append(quotas.groupBy(F.floor(F.col("rank") / width).cast("long").alias("node")).agg(F.sum("quota").alias("quota")))
        if top // width == 0:
            break
        width *= FAN
    total = levels[-1].agg(F.sum("quota")).first()[0] or 0
    even = [total // shards + (i < total % shards) for i in range(shards)]
    held = levels[-1].select("node", F.array(*[F.lit(int(x)).cast("long") for x in even]).alias("margins"))
    for below in reversed(levels[:-1]):

        def part(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node")
            rng = np.random.default_rng([seed, int(pdf["parent"].iloc[0]), len(pdf)])
            rows = split(pdf["quota"].to_numpy(), np.asarray(pdf["margins"].iloc[0]), rng)
            return pd.DataFrame({"node": pdf["node"], "margins": list(rows)})

        children = below.withColumn("parent", F.floor(F.col("node") / FAN).cast("long"))
        held = children.join(held.withColumnRenamed("node", "parent"), "parent").groupBy("parent").applyInPandas(part, "node long, margins array<long>")
    stops = F.transform("margins", lambda _, i: F.aggregate(F.slice("margins", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    return quotas.select("k", F.col("rank").alias("node")).join(held, "node").select("k", stops.alias("stops"))


def decided(docs: DataFrame, key: Column, text: str = "text", source: str = "source", weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, shards: int | None = None, keep: Column | None = None) -> DataFrame:
    """One row per document: keep (as `doc`), size, source_size, target, copies (array of (epoch, shard)), h (its place).

    Weights repeat over sources by code point, null last. Texts without words count 0 and are taken whole with their
    block; a source without words has target 0 and takes nothing. Rows with equal key and text share one decision. Ties
    in a block are parted by hash. An empty table gives no rows. Reruns agree: every choice is a hash or a seeded sample.
    """
    k = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    base = docs.select((F.lit(None) if keep is None else keep).alias("doc"), k.alias("k"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), key, F.col(text)).alias("h"))
    narrow = cut_lineage(base) if keep is None or dict(base.dtypes)["doc"] in ("bigint", "int", "string") else cut_lineage(base.drop("doc"))
    stats = narrow.groupBy("k").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = numbered(stats, "rank", "k").withColumn("weight", cycle[(F.col("rank") % len(weights)).cast("int")])
    whole = ranked.agg(F.sum("source_size"), F.count("*")).first()
    total = share * (whole[0] or 0)
    sources = cut_lineage(
        _fill(ranked, total, most)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("blocks", F.ceil(F.sqrt("n")).cast("long"))
    )
    few = lambda *c: small(sources.select("k", *c), whole[1])
    placed = narrow.join(few("blocks"), "k").withColumn("block", F.pmod("h", "blocks"))
    blocks = placed.groupBy("k", "block").agg(F.sum("size").alias("words"))

    # every pass over a source deals its blocks in an order of its own
    passes = blocks.join(few("epochs", "rest"), "k").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "epochs"))).withColumn("order", F.xxhash64(F.lit(seed), "epoch", "k", "block"))
    running = Window.partitionBy("k", "epoch").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, 0)
    passes = passes.withColumn("before", F.sum("words").over(running) - F.col("words"))
    taken = passes.where("epoch < epochs or before < rest").withColumn("cut", F.expr("epoch = epochs and before + words > rest"))

    # the last block of a source is taken up to a place within it
    ends = cut_lineage(taken.where("cut").select("k", "block", (F.col("rest") - F.col("before")).alias("need")))
    inside = placed.join(small(ends, whole[1]), ["k", "block"]).groupBy("k", "block", "need", "h").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("k", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words") / 2
    limits = inside.withColumn("upto", upto).where("upto <= need").groupBy("k", "block").agg(F.max("h").alias("last"))
    draws = taken.join(limits, ["k", "block"], "left").where("not cut or last is not null").select("k", "block", "epoch", "order", F.expr("if(cut, last, null)").alias("last"))
    draws = cut_lineage(draws.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("epoch", "order", "block")) - 1))

    quotas = draws.groupBy("k").agg(F.count("*").alias("quota")).join(sources.select("k", "rank"), "k")
    n = shards or int(min(MOST_SHARDS, max(1, -(-total // SHARD_WORDS))))
    stops = _shard_stops(quotas, n, seed)
    dealt = draws.join(stops, "k").withColumn("shard", F.size(F.filter("stops", lambda x: x <= F.col("pos"))))
    by_block = cut_lineage(dealt.groupBy("k", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard", "last"))).alias("draws")))  # as many as passes, most + 1 at most

    rows = (narrow if "doc" in narrow.columns else base).join(few("blocks", "source_size", "target"), "k").withColumn("block", F.pmod("h", "blocks"))
    all_draws = F.coalesce("draws", F.array().cast("array<struct<epoch:bigint,shard:int,last:bigint>>"))
    mine = F.filter(all_draws, lambda d: d["last"].isNull() | (F.col("h") <= d["last"]))
    return rows.join(small(by_block, by_block.count()), ["k", "block"], "left").select("doc", "size", "source_size", "target", mine.alias("copies"), "h")


def mixed(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mix: the rows of docs, as often as taken, dealt to shards and shuffled within each; columns as in docs."""
    rows = decided(docs, F.col(key), keep=F.struct(*[docs[c] for c in docs.columns]), **options)
    out = rows.withColumn("copy", F.explode("copies")).withColumn("at", F.xxhash64(F.lit(11), "copy.epoch", "h"))
    shards = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return out.repartition(int(shards), F.col("copy.shard")).sortWithinPartitions("copy.shard", "at").select("doc.*")


def mixed_counts(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per document: key, size, source_size, target and taken, the words the mix takes of it."""
    rows = decided(docs, F.col(key), keep=F.col(key), **options)
    return rows.select(F.col("doc").alias(key), "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken"), F.transform("copies", lambda c: c["shard"]).alias("shards"))

