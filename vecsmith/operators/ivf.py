"""Inverted cells: rows by nearest centroid, each compared with the queries that probe its cell.

Queries go in blocks to the rows. A task takes its rows cell by cell, multiplies those of a cell with
the block's queries that probe it, passes over what cannot be among the k rows it has of a query, and
scores the rest exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vecsmith.functions.distance import metric as metric_of
from vecsmith.operators.kmeans import kmeans, nearest_cell
from vecsmith.operators.search import HITS, Block, checked, in_blocks, matrix, scores, spread, top_k

_ROWS, _QUERIES = 1024, 256
_PAIRS = 1 << 16
#: What rounding may hide of a product of two vectors, as a share of the sum of their squared norms.
_SLACK = 1e-9


class InvertedCells:
    """``fit`` (or given centroids), ``assign`` once, ``search`` often.

    Cells are nearest centroids by squared L2. ``metric`` ranks the cells that a query probes and the rows in
    them. Tables written by ``list_id`` let the cell join prune partitions.
    """

    def __init__(self, nlist: int = 100, nprobe: int = 10, iterations: int = 25, seed: int = 42, centroids: np.ndarray | None = None, sample: int = 262_144, metric: str = "l2"):
        if nlist < 1:
            raise ValueError("nlist must be at least 1")
        self.nlist, self.iterations, self.seed, self.sample = nlist, iterations, seed, sample
        self.centroids, self.metric = centroids, metric
        metric_of(metric)
        self.set_nprobe(nprobe)

    def set_nprobe(self, nprobe: int) -> None:
        if nprobe < 1:
            raise ValueError("nprobe must be at least 1")
        self.nprobe = nprobe

    def fit(self, base: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> InvertedCells:
        self.centroids = kmeans(base, self.nlist, self.iterations, self.seed, id_col=id_col, vector=vector, sample=self.sample)
        return self

    def _trained(self) -> np.ndarray:
        if self.centroids is None:
            raise RuntimeError("the index is not trained")
        return self.centroids

    def assign(self, base: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(vec_id, vector, list_id) of each row that has a vector."""
        rows = base.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("vector"))
        return self.placed(spread(rows), "vector")

    def placed(self, rows: DataFrame, vector: str) -> DataFrame:
        """``rows`` with ``list_id``; 0 where there is no vector."""
        centroids = self._trained()

        @pandas_udf("int")
        def cell(vectors: pd.Series) -> pd.Series:
            out, some = np.zeros(len(vectors), np.int32), vectors.notna().to_numpy()
            if some.any():
                out[some] = nearest_cell(matrix(vectors[some]), centroids)
            return pd.Series(out)

        # else a condition on the cell would go below this and work it out a second time
        return rows.withColumn("list_id", cell.asNondeterministic()(vector))

    def _nearest(self, queries: np.ndarray) -> np.ndarray:
        """The ``nprobe`` nearest cells of each query, in order."""
        near = np.nan_to_num(scores(queries, self._trained(), self.metric), nan=-np.inf)
        return np.argsort(near if metric_of(self.metric).ascending else -near, axis=1, kind="stable")[:, : self.nprobe]

    def probes(self, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, q, list_id) for the ``nprobe`` nearest cells of each query."""
        n = min(self.nprobe, len(self._trained()))

        def nearest(batches):
            for b in batches:
                if len(b):
                    order = self._nearest(matrix(b["q"]))
                    yield pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), n), "q": b["q"].repeat(n).to_numpy(), "list_id": order.ravel().astype(np.int32)})

        return self._asked(queries, id_col, vector).mapInPandas(nearest, "query_id long, q array<float>, list_id int")

    def _asked(self, queries: DataFrame, id_col: str, vector: str) -> DataFrame:
        return queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).cast("array<float>").alias("q"))

    def search(self, assigned: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", written: bool = False) -> DataFrame:
        """(query_id, rank, vec_id, score): exact scores within the probed cells; tasks keep k rows a query.

        Rows that repeat a query id share its k rows. A table ``written`` by cell is read for each block of queries as it
        lies; other rows are stored before the first of several.
        """
        checked(k)
        ascending, cells = metric_of(self.metric).ascending, len(self._trained())

        def answers(batches, block):
            return _answers(batches, block.value, self._nearest(block.value.vectors), cells, k, self.metric)

        def reached(block: Block):
            some = np.unique(self._nearest(block.vectors))
            return F.lit(True) if len(some) == cells else F.col("list_id").isin(some.tolist())

        def best(hits: DataFrame) -> DataFrame:
            return top_k(hits, k, ascending).select("query_id", "vec_id", "score")

        rows = assigned.where("vector is not null").select("vec_id", "vector", "list_id")
        found = in_blocks(rows, self._asked(queries, id_col, vector), answers, HITS, best, reached=reached, store=not written)
        return top_k(found, k, ascending).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _exact(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """The score of each pair, summed in the order of the components, so that equal vectors tie wherever they lie."""

    def summed(x: np.ndarray) -> np.ndarray:
        return x.cumsum(axis=1)[:, -1]

    if metric == "l2":
        return summed((rows - queries) ** 2)
    dot = summed(rows * queries)
    if metric == "ip":
        return dot
    norms = np.sqrt(summed(rows**2)) * np.sqrt(summed(queries**2))
    cosine = np.divide(dot, norms, out=np.full_like(dot, np.nan), where=norms > 0)
    return cosine if metric == "cosine" else np.sqrt(np.maximum(0.0, 2.0 * (1.0 - cosine)))


def _cut(hits: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k first of each query of (query, key, id, score), by key, then id; in order."""
    order = np.lexsort((hits[2], hits[1], hits[0]))
    q = hits[0][order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    nth = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
    return tuple(x[order[nth < k]] for x in hits)


def _answers(batches, block: Block, probed: np.ndarray, cells: int, k: int, metric: str):
    """``HITS`` of a task's rows (vec_id, vector, list_id) with the block's queries that probe their cells."""
    ascending, queries = metric_of(metric).ascending, block.vectors
    known = ~np.isnan(queries).any(axis=1)  # others score with nothing
    probes = np.zeros((cells, len(queries)), bool)
    probes[probed, np.arange(len(queries))[:, None]] = True
    asking = [np.flatnonzero(p & known) for p in probes]
    unit = metric in ("cosine", "angular")

    def prepared(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors to multiply and their squared norms."""
        size = (x**2).sum(axis=1)
        return (x / np.sqrt(size)[:, None], np.where(size > 0, 1.0, np.nan)) if unit else (x, size)

    # with the norms as two more components, one product of queries and rows gives lower bounds of the keys (of the
    # negative cosine for angles); NaN where there are none
    times, share = (-2.0, 1 - _SLACK) if metric == "l2" else (-1.0, -_SLACK)

    def widened(x: np.ndarray, size: np.ndarray, asking: bool) -> np.ndarray:
        one, norm = np.ones(len(x)), share * size
        return np.column_stack([times * x, one, norm] if asking else [x, norm, one])

    with np.errstate(all="ignore"):
        theirs, sizes = prepared(queries)
        theirs = widened(theirs, sizes, True)
        most = np.full(len(queries), np.inf)  # the bound of each query: the key of its k-th row
        best, more, waiting = None, [], 0
        for batch in batches:
            for cell, at in batch.groupby("list_id").indices.items():
                some = asking[int(cell)]
                for of in range(0, len(at) if len(some) else 0, _ROWS):
                    rows, ids = matrix(batch["vector"].iloc[at[of : of + _ROWS]]), batch["vec_id"].to_numpy()[at[of : of + _ROWS]]
                    whole = ~np.isnan(rows).any(axis=1)
                    rows, ids = rows[whole], ids[whole]
                    if not len(ids):
                        continue
                    mine, size = prepared(rows)
                    mine, wide = widened(mine, size, False).T, 4 * _SLACK * np.fmax.reduce(size)
                    found = []
                    for i in range(0, len(some), _QUERIES):  # few enough that the bounds stay in the cache
                        part = some[i : i + _QUERIES]
                        low, bound = theirs[part] @ mine, most[part]
                        kept = ~(low > bound[:, None])
                        if len(ids) > k and len(new := np.flatnonzero(np.count_nonzero(kept, axis=1) > 2 * k)):
                            # k rows lie below this: without it, all rows of a cell nearer than those before would be scored
                            bound = np.fmin(bound[new], np.partition(low[new], k - 1, axis=1)[:, k - 1] + 4 * _SLACK * sizes[part[new]] + wide)
                            kept[new] = ~(low[new] > bound[:, None])
                        found.append(np.flatnonzero(kept) + i * len(ids))
                    q, r = np.divmod(np.concatenate(found), len(ids))
                    score = np.concatenate([np.zeros(0), *(_exact(rows[r[i : i + _PAIRS]], queries[some[q[i : i + _PAIRS]]], metric) for i in range(0, len(q), _PAIRS))])
                    there = ~np.isnan(score)
                    new = (some[q[there]], score[there] if ascending else -score[there], ids[r[there]], score[there])
                    more.append(_cut(new, k))
                    waiting += len(more[-1][0])
                    if waiting >= len(queries) * k // 2:
                        best, more, waiting = _cut(tuple(np.concatenate(x) for x in zip(*([best] if best else []), *more, strict=True)), k), [], 0
                        full = np.flatnonzero(np.bincount(best[0], minlength=len(queries)) == k)
                        last = best[1][np.searchsorted(best[0], full, side="right") - 1]
                        most[full] = last**2 / 2 - 1 if metric == "angular" else last
        if best or more:
            q, _, ids, score = _cut(tuple(np.concatenate(x) for x in zip(*([best] if best else []), *more, strict=True)), k)
            yield block.named(pd.DataFrame({"q": q, "vec_id": ids, "score": score}))[["vec_id", "score", "n", "query_id"]]
