"""Exact k-nearest-neighbour search and result handling.

Many queries: queries go in blocks of a fixed size to all tasks, each task
multiplies its rows with the block and keeps k rows a query, and one window
merges these. So no more than tasks x queries x k rows move. The driver holds one block at
a time; where there are several, each one's result is written before the next one starts, so that
neither its memory nor the plan grows with the queries. One query: an expression and a top-k.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecsmith.functions.distance import metric as metric_of
from vecsmith.operators.scratch import dropped, stored, stored_parts

QUERY_BLOCK = 4096
_ROWS = 2048


def checked(k: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")


def dimension_checked(vector: Column, dim: int) -> Column:
    """The vector, or an error that stops the query if its length is not ``dim``."""
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(F.concat(F.lit(f"expected dimension {dim}, got "), F.size(vector).cast("string"))))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt over all cores where a scan gives most of them to a few tasks, as of one file with one group of rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":  # there is an exchange below, which deals them
        return rows
    sizes = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]  # one row for each task
    return rows.repartition(cores) if sum(sizes) > _ROWS * cores and max(sizes) * cores > 2 * sum(sizes) else rows


def scores(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Rows by queries; larger is better for ip and cosine."""
    dot = rows @ queries.T
    if metric == "ip":
        return dot
    if metric == "l2":
        return np.maximum((rows**2).sum(axis=1)[:, None] + (queries**2).sum(axis=1)[None, :] - 2.0 * dot, 0.0)
    norms = np.sqrt((rows**2).sum(axis=1))[:, None] * np.sqrt((queries**2).sum(axis=1))[None, :]
    cosine = np.divide(dot, norms, out=np.full_like(dot, np.nan), where=norms > 0)
    return cosine if metric == "cosine" else np.sqrt(np.maximum(0.0, 2.0 * (1.0 - cosine)))


def _local(batches, asked, k, metric, ascending, skip_self):
    best, block = None, asked.value
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            some = batch.iloc[at : at + _ROWS]
            rows, ids = matrix(some["vector"]), some["vec_id"].to_numpy()
            if block.vectors.shape[1] != rows.shape[1]:
                raise ValueError(f"expected dimension {rows.shape[1]}, got {block.vectors.shape[1]}")
            got = scores(rows, block.vectors, metric)
            key = np.where(np.isnan(got), np.inf, got if ascending else -got)
            if skip_self:
                key[ids[:, None] == block.ids[None, :]] = np.inf
            n = min(k, len(ids))
            # all up to the n-th and what rounding may hide, so that ties go by id below
            edge = np.partition(key, n - 1, axis=0)[n - 1]
            r, q = np.nonzero((key <= edge[None, :] + 1e-9 * np.maximum(1.0, np.abs(edge))[None, :]) & np.isfinite(key))
            value = ((rows[r] - block.vectors[q]) ** 2).sum(axis=1) if metric == "l2" else got[r, q]  # differences: equal vectors are at 0
            found = pd.DataFrame({"q": q, "vec_id": ids[r], "score": value, "key": value if ascending else -value})
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["q", "key", "vec_id"])
            best = best[best.groupby("q").cumcount() < k]
    if best is not None:
        yield block.named(best[["q", "vec_id", "score"]])


def nearer(best, rows: np.ndarray, ids: np.ndarray, block: np.ndarray, may: np.ndarray, k: int) -> pd.DataFrame:
    """``best`` (q, vec_id, score; or None) and the rows that each query ``may`` (queries by rows) take, cut to k by exact squared L2."""
    size = (block**2).sum(axis=1)
    key = np.where(may, scores(rows, block, "l2").T, np.inf)
    n = min(k, len(ids))
    edge = np.partition(key, n - 1, axis=1)[:, n - 1]
    slack = 1e-9 * np.maximum(1.0, size + (rows**2).sum(axis=1).max(initial=0.0))  # what rounding may hide
    q, r = np.nonzero((key <= (edge + slack)[:, None]) & np.isfinite(key))
    found = pd.DataFrame({"q": q, "vec_id": ids[r], "score": ((rows[r] - block[q]) ** 2).sum(axis=1)})
    best = (found if best is None else pd.concat([best, found])).sort_values(["q", "score", "vec_id"])
    return best[best.groupby("q").cumcount() < k]


def top_k(scored: DataFrame, k: int, ascending: bool, score: str = "score", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best rows of each query with their rank from 1, ties to the smaller id."""
    order = Window.partitionBy(*by).orderBy(F.asc(score) if ascending else F.desc(score), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class Block:
    """Some queries: a number for each, unique among all of them, their ids and their vectors."""

    numbers: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray

    def named(self, found: pd.DataFrame) -> pd.DataFrame:
        """``found`` with the number and id of the query at the place ``q`` in this block."""
        at = found["q"].to_numpy(dtype=np.int64)
        return found.drop(columns="q").assign(n=self.numbers[at], query_id=self.ids[at])


#: What tasks send of their rows.
HITS = "vec_id long, score double, n long, query_id long"


def in_blocks(rows: DataFrame, asked: DataFrame, answers: Callable, schema: str, finish: Callable[[DataFrame], DataFrame], query_block: int = QUERY_BLOCK, reached: Callable[[Block], Column] | None = None, store: bool = False) -> DataFrame:
    """``finish`` of what ``answers(batches of rows, broadcast Block)`` gives, over all queries (query_id, q) in blocks.

    Rows that repeat a query id are queries of their own. ``reached`` is a condition that all rows meet that a block's queries
    could take, so that a table written by it is read in part. With ``store``, rows are worked out once for all blocks.
    """
    spark, table = rows.sparkSession, rows
    block_of = lambda df: Block(df["n"].to_numpy(), df["query_id"].to_numpy(), matrix(df["q"]))

    def answered(block: Block) -> DataFrame:
        these = spark.sparkContext.broadcast(block)
        near = table if reached is None else table.where(reached(block))
        return finish(near.mapInPandas(lambda it: answers(it, these), schema))

    first = asked.orderBy("query_id").limit(query_block + 1).toPandas()
    if first.empty:
        return finish(spark.createDataFrame([], schema))
    if len(first) <= query_block:
        return answered(block_of(first.assign(n=np.arange(len(first)))))
    numbered = stored(asked.repartitionByRange("query_id").sortWithinPartitions("query_id").withColumn("n", F.monotonically_increasing_id()), "queries")
    table = stored(rows, "rows") if store else rows

    def parts():
        after = -1
        while not (block := numbered.where(F.col("n") > after).orderBy("n").limit(query_block).toPandas()).empty:
            after = int(block["n"].iloc[-1])
            yield answered(block_of(block))

    out = stored_parts(spark, parts(), finish(spark.createDataFrame([], schema)).schema)
    dropped(spark, numbered, *([table] if store else []))
    return out


def ranked(k: int, ascending: bool = True) -> Callable[[DataFrame], DataFrame]:
    """(query_id, rank, vec_id, score) of ``HITS``."""
    return lambda hits: top_k(hits, k, ascending, by=("n", "query_id")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def knn(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, skip_self: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) of the exact k nearest rows of each query.

    ``queries`` has the same columns as ``base``. Fewer than k rows give fewer
    results; null vectors take no part; empty inputs give an empty result.
    """
    checked(k)
    ascending = metric_of(metric).ascending
    rows = base.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).alias("q"))
    return in_blocks(rows, asked, lambda it, block: _local(it, block, k, metric, ascending, skip_self), HITS, ranked(k, ascending), query_block)


def nearest(base: DataFrame, query: list[float], k: int = 10, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One query: (vec_id, score) in order, all in generated code but the fold."""
    checked(k)
    kind = metric_of(metric)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = base.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("vec_id"), kind.expression(dimension_checked(F.col(vector), len(query)), q).alias("score"))
    return scored.orderBy(F.asc("score") if kind.ascending else F.desc("score"), "vec_id").limit(k)


def search(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", condition: Column | None = None, mode: str = "post", columns: tuple[str, ...] = (), id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """k-NN with a metadata condition: ``pre`` ranks the rows that meet it, ``post`` drops ranked rows that do not."""
    if mode not in ("pre", "post"):
        raise ValueError("mode is 'pre' or 'post'")
    rows = base.where(condition) if condition is not None and mode == "pre" else base
    found = knn(rows, queries, k, metric, id_col, vector)
    facts = base if condition is None or mode == "pre" else base.where(condition)
    # the results are the small side: k rows a query
    return found.join(facts.select(F.col(id_col).alias("vec_id"), *columns), "vec_id").select("query_id", "rank", "vec_id", "score", *columns)


def filtered_fetch(base: DataFrame, query: list[float], condition: Column, k: int = 10, factor: int = 10, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The first k rows that meet a condition among the ``factor`` x k nearest of one query."""
    near = nearest(base, query, k * factor, metric, id_col, vector)
    kind = metric_of(metric)
    return near.join(base.where(condition).select(F.col(id_col).alias("vec_id")), "vec_id").orderBy(F.asc("score") if kind.ascending else F.desc("score"), "vec_id").limit(k)


def enriched(results: DataFrame, metadata: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Results with file metadata by ``file_id`` and content by ``storage_path``; what is missing becomes null and an error text."""
    out = results.join(metadata, "file_id", "left")
    if files is None:
        return out
    out = out.join(files.select("storage_path", F.col("content").alias("file_content")), "storage_path", "left")
    return out.withColumn("file_content_error", F.when(F.col("file_content").isNull(), F.concat(F.lit("no file at "), F.coalesce("storage_path", F.lit("null")))))
