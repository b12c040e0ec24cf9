"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of partial scores over ``lists`` runs of dimensions. Phase 1
gathers each list's best entries and resolves their scores, which gives every
query a safe cutoff (its k-th best score so far). Phase 2 broadcasts cutoff /
lists: whoever reaches the cutoff in sum reaches that share in some list, so each
task collects just the entries that do. Phase 3 resolves these exactly where
the rows lie and keeps those at or above the cutoff.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecsmith.llm.common import stored, task

LISTS, SCALE = 4, 256
QUERY_BLOCK = 2048
_HITS = "query_id long, vec_id long, score long"
_EXACT, _EXACT_SINGLE = 2.0**52, 2.0**24


def quantized(column, scale: int = SCALE):
    """floor(scale * x) of each component, or null if a vector is null or has a null or non-finite component."""
    ok = column.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(len(v), width)] = v[:width]
    return out


def _stack(batch: pd.DataFrame, width: int) -> np.ndarray:
    """Row-major matrix of a batch; absent components count as 0."""
    vectors = batch["q"].to_list()
    if vectors and all(len(v) == width for v in vectors):
        return np.stack(vectors)
    return _matrix(vectors, width)


def _runs(width: int, lists: int) -> list[slice]:
    edge = np.linspace(0, width, min(lists, max(width, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer products: float32 or float64 where no sum can round, else Python integers."""
    most = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * max(rows.shape[1], 1)
    if most < _EXACT_SINGLE:
        return rows.astype(np.float32) @ queries.astype(np.float32).T
    if most < _EXACT:
        return rows @ queries.T
    return rows.astype(object).dot(queries.astype(object).T) if rows.size else np.zeros((len(rows), len(queries)))


def _scored(rows, queries):
    """Query and row index pairs to their exact scores."""
    most = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * max(rows.shape[1], 1)
    if most < _EXACT:
        return np.einsum("ij,ij->i", rows, queries)
    return np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(rows, queries, strict=True)], dtype=object)


def _hits(ids, numbers, q, r, scores) -> pd.DataFrame:
    return pd.DataFrame({"query_id": numbers[q], "vec_id": ids[r], "score": np.array([int(s) for s in scores], dtype=np.int64) if scores.dtype == object else scores.astype(np.int64)})


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    frame = frame.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return frame[frame.groupby("query_id").cumcount() < k]


@task
def _local_lists(batches, asked, lists, k):
    """Phase 1 in a task: the exact scores of each list's k best rows, and of them the k best a query."""
    (numbers, qids, queries), kept = asked.value, None
    for batch in batches:
        if batch.empty:
            continue
        ids, rows = batch["vec_id"].to_numpy(), _stack(batch, queries.shape[1])
        pairs = set()
        for run in _runs(queries.shape[1], lists):
            part = _scores(rows[:, run], queries[:, run]).T.copy()
            part[qids[:, None] == ids[None, :]] = -np.inf
            some = min(k, len(ids))
            top = np.argpartition(part.astype(float), len(ids) - some, axis=1)[:, len(ids) - some :]
            pairs.update((np.repeat(np.arange(len(qids)), some) * len(ids) + top.ravel()).tolist())
        at = np.fromiter(pairs, np.int64, len(pairs))
        q, r = at // len(ids), at % len(ids)
        other = qids[q] != ids[r]
        q, r = q[other], r[other]
        found = _hits(ids, numbers, q, r, _scored(rows[r], queries[q]))
        kept = _best(found if kept is None else pd.concat([kept, found]), k)
    if kept is not None:
        yield kept


@task
def _above(batches, asked, cutoffs, lists, k):
    """Phases 2 and 3 in a task: rows with a partial score of cutoff / lists in some list, then those whose sum reaches the cutoff.

    A row whose norm times the largest norm of a query stays below every cutoff is not looked at.
    """
    (numbers, qids, queries), cutoff, kept = asked.value, cutoffs.value, None
    runs = _runs(queries.shape[1], lists)
    longest, least = np.sqrt((queries**2).sum(axis=1).max(initial=0.0)) * (1 + 1e-9), cutoff.min(initial=np.inf)
    share = cutoff / len(runs)
    for batch in batches:
        if batch.empty:
            continue
        ids, rows = batch["vec_id"].to_numpy(), _stack(batch, queries.shape[1])
        may = np.sqrt((rows**2).sum(axis=1)) * longest >= least
        ids, rows = ids[may], rows[may]
        for at in range(0, len(ids), 1024):
            some = slice(at, at + 1024)
            reach = np.zeros((len(ids[some]), len(qids)), bool)
            for run in runs:
                reach |= np.asarray(_scores(rows[some, run], queries[:, run]) >= share[None, :], dtype=bool)
            r, q = np.nonzero(reach & (ids[some][:, None] != qids[None, :]))
            scores = _scored(rows[some][r], queries[q])
            enough = np.asarray(scores >= cutoff[q], dtype=bool)
            if enough.any():
                found = _hits(ids[some], numbers, q[enough], r[enough], scores[enough])
                kept = _best(found if kept is None else pd.concat([kept, found]), k)
    if kept is not None:
        yield kept


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk_search(base: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, lists: int = LISTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    All rows but those with the query's own id are candidates. Vectors that are
    null or hold null or non-finite components, and rows without an id, take no
    part; shorter vectors count as padded with zeros. Repeated ids are rows of
    their own, as candidates and as queries (each such query has its own k rows, under the same id).
    Queries go in blocks of ``query_block``, which with their cutoffs are the only thing broadcast;
    a query without candidates has no row, and an empty table gives an empty result.
    """
    spark = base.sparkSession
    ready = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), quantized(F.col(vector), scale).alias("q")).where("vec_id is not null and q is not null")
    rows = ready(base)
    asked = stored(ready(queries).repartitionByRange("vec_id").sortWithinPartitions("vec_id").select(F.monotonically_increasing_id().alias("n"), "vec_id", "q"), "queries")
    width = rows.agg(F.max(F.size("q"))).first()[0] or 0
    count, done, after = asked.count(), None, None
    for _ in range(0, count, query_block):
        block = (asked if after is None else asked.where(F.col("n") > after)).orderBy("n").limit(query_block).toPandas()
        after = int(block["n"].iloc[-1])
        numbers = block["n"].to_numpy()
        these = spark.sparkContext.broadcast((numbers, block["vec_id"].to_numpy(), _matrix(block["q"].to_list(), width)))
        lists_ = rows.mapInPandas(lambda it, a=these: _local_lists(it, a, lists, k), _HITS)
        safe = _ranked(lists_, k).groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("n")).toPandas()
        cut = pd.Series(safe["cutoff"].where(safe["n"] >= k, -np.inf).to_numpy(dtype=float), index=safe["query_id"]).reindex(numbers).fillna(-np.inf).to_numpy()
        # beyond 2**52 a float may have been rounded up: step below it
        cuts = spark.sparkContext.broadcast(np.where(np.abs(cut) < _EXACT, cut, np.nextafter(cut, -np.inf)))
        hits = _ranked(rows.mapInPandas(lambda it, a=these, c=cuts: _above(it, a, c, lists, k), _HITS), k)
        names = F.broadcast(asked.where(F.col("n").between(int(numbers[0]), after)).select("n", F.col("vec_id").alias("asked")))  # a block
        part = stored(hits.join(names, F.col("query_id") == F.col("n")).select(F.col("asked").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "hits")
        done = part if done is None else done.unionByName(part)
        these.unpersist()
        cuts.unpersist()
    return done if done is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
