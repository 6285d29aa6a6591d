"""Session settings and lineage cutting shared by all jobs."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "netprism", cores: str = "*", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def reach(spark: SparkSession) -> None:
    """Lets Python workers on machines with the same folders import this package; else ship it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; set one only where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-netprism-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for streams and written tables."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """A table that several branches read, as compressed columns in the shared folder: a branch reads what it needs of it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, key: str) -> DataFrame:
    """`written`, in buckets of a key: rows of a key stay together, and what groups or windows by it needs no shuffle.

    For rows that lie by this key already, with as many partitions as the session's shuffles have: each task then writes one file.
    """
    spark = df.sparkSession
    name = f"table_{uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    _TABLES.append((spark, name))
    return spark.table(name)


_KEPT: list[DataFrame] = []
_TABLES: list[tuple[SparkSession, str]] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist a table that several branches of one plan read; lost blocks are computed again from lineage."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(df)
    return df


def release() -> None:
    """Let go of everything kept so far."""
    while _KEPT:
        _KEPT.pop().unpersist()
    while _TABLES:
        spark, name = _TABLES.pop()
        if spark.sparkContext._jsc is not None:
            spark.sql(f"drop table if exists {name}")  # the name goes, the files stay for plans that are still to run
