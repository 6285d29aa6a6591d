"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that go to a Python worker at once, where the session doesn't say.
ARROW_ROWS = 500
#: A side of a join is broadcast only when it has been counted and has at most so many rows.
BROADCAST_ROWS = 100_000


def reach(spark: SparkSession) -> None:
    """Lets Python workers on machines with the same folders import this package; else ship it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":  # Spark's default; ten thousand whole texts are too long for a worker
        spark.conf.set(batch, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """A large intermediate as a compressed table in the folder that all executors share; a checkpoint would be several times as long."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column | str) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int) -> DataFrame:
    """The counted side of a join: broadcast within the bound, else left to a shuffled join (split when skewed)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def numbered(df: DataFrame, name: str, *order: Column | str, parts: int = 16) -> DataFrame:
    """Adds a 0-based position in the global order: range partitions number their own rows, and add the sizes of those before."""
    cut = cut_lineage(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r["__part"], r["count"]) for r in cut.groupBy("__part").count().collect())  # a row for each partition
    before, offsets = 0, []
    for part, n in sizes:
        offsets += [F.lit(part), F.lit(before)]
        before += n
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    start = F.create_map(*offsets)[F.col("__part")] if offsets else F.lit(0)
    return cut.withColumn(name, (own + start).cast("long")).drop("__part")


#: Edges that a task of `components` takes.
EDGES_A_TASK = 100_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Alternates two steps on the edge table: every node hands its larger neighbours to its smallest one, then its smaller
    neighbours to its smallest one. Only minima are grouped, so a hub is no group; joins on a hub are split when skewed.
    Each round is written to the shared checkpoint folder. Stops when the edges form stars. Tasks are as many as the edges need
    (`EDGES_A_TASK`), as each task of each shuffle leaves files of its own: a few edges in all of a session's tasks are mostly these.
    """
    state, tasks = None, 0
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if not tasks:
            tasks = -(-now.count() // EDGES_A_TASK)
            if not tasks:
                break
            now = now.coalesce(tasks)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(tasks).distinct().coalesce(tasks)
        # here a > b in every row: each node's smaller neighbours now meet at the smallest of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(lowest, "a").coalesce(tasks)
        small_star = met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(lowest.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct()
        now = cut_lineage(small_star.coalesce(tasks))
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == state:
            break
        state = mark
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
