"""Blocks of vectors for the two searches: what takes part, and how it is dealt.

Rows are dealt into blocks of about ``block_rows`` by a hash of their id, queries into
blocks of their own; a task gets one block of rows and one block of queries, so its
memory is bounded whatever the table. Each query meets every row exactly once.

Repeated rows of one vec_id count once (its smallest vector, if they differ)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK_ROWS, QUERY_ROWS, QUERY_EVERY = 8192, 4096, 20


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, embedding array<double>) that take part: finite, of a known id; zero vectors only if ``zero``."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(e) > 0)
    if not zero:
        fine &= F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & fine)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def search_blocks(rows: DataFrame, k: int, run: Callable, schema: str, every: int = QUERY_EVERY, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``run`` on every pair of a row block and a query block; the k best of each query,
    by score, then by smaller vec_id. Queries: rows whose vec_id is divisible by ``every``."""
    counts = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    n_blocks, n_queries = max(1, -(-counts[0] // block_rows)), max(1, -(-counts[1] // query_rows))
    part = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    dealt = rows.withColumn("block", part(n_blocks, 1)).withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("queries", part(n_queries, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    found = dealt.groupBy("block", "queries").cogroup(asked.groupBy("block", "queries")).applyInPandas(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block by ascending id; shorter vectors are filled with zeros."""
    frame = frame.sort_values("vec_id")
    wide = max(map(len, frame["embedding"]))
    if all(len(v) == wide for v in frame["embedding"]):
        return frame["vec_id"].to_numpy(), np.stack(frame["embedding"].to_numpy())
    out = np.zeros((len(frame), wide))
    for i, v in enumerate(frame["embedding"]):
        out[i, : len(v)] = v
    return frame["vec_id"].to_numpy(), out


def fitted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns as the wider one."""
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, wide - x.shape[1]))) if x.shape[1] < wide else x for x in (a, b))
