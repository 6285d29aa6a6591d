"""What both vector searches need: valid vectors, salted blocks, and searches cell by cell."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import small

#: Vectors and queries that meet in one task at once.
BLOCK_ROWS, QUERY_ROWS = 4096, 2048


def finite(vec: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    top = F.lit(float("inf"))
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < top)), F.lit(False))


def salted(rows: DataFrame, most: int, *keys: str, by: str) -> DataFrame:
    """Adds `salt`, so that (keys, salt) has about `most` rows: hot keys become many blocks."""
    sizes = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("__n")))
    cut = rows.join(small(sizes, sizes.count()), list(keys))
    return cut.withColumn("salt", F.pmod(F.xxhash64(F.lit(3), by), F.ceil(F.col("__n") / most).cast("long"))).drop("__n")


def matrix(pdf: pd.DataFrame, kind=np.float64) -> np.ndarray:
    return np.stack(pdf["v"].to_numpy()).astype(kind) if len(pdf) else np.zeros((0, 0), kind)


def searched(cells: DataFrame, asked: DataFrame, keys: list[str], run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], k: int, order: list[Column], score: str) -> DataFrame:
    """Best k of each query over all cells it asks: run gives a cell's best k (query_id, vec_id, score)."""
    found = asked.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInPandas(run, f"query_id long, vec_id long, score {score}")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
