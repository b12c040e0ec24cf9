"""Tree cells: exact search pruned by boxes or balls, and a forest of random planes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsmith.operators.scratch import stored
from vecsmith.operators.search import HITS, in_blocks, matrix, nearer, ranked, scores

_ASSIGNED = "vec_id long, vector array<float>, cell int"
_LEAVES = "vec_id long, vector array<float>, leaves array<int>"
_PLANES = "planes array<double>, offsets array<double>, trees int, depth int"


def _sampled(base: DataFrame, id_col: str, vector: str, sample: int, seed: int) -> np.ndarray:
    """Rows by a hash of the id, so that copies of a vector count as often as they occur."""
    order = F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)), F.xxhash64(vector)
    got = base.where(F.col(vector).isNotNull()).orderBy(*order).limit(sample).select(F.col(vector).alias("v")).toPandas()
    if got.empty:
        raise ValueError("the index is empty")
    return matrix(got["v"])


class PrunedCells:
    """Exact k-NN over cells with bounds.

    ``kd`` cuts at medians of the axes in turn and bounds cells by boxes; ``ball``
    cuts at the median of the axis of most variance and bounds them by balls. Cuts
    come from at most ``sample`` rows, cells and their bounds from all rows. What a task has found for a
    query bounds its k-th distance; cells beyond that are skipped.
    """

    def __init__(self, kind: str = "kd", leaf: int = 40, sample: int = 16_384, seed: int = 42, most_cells: int = 4096):
        if kind not in ("kd", "ball"):
            raise ValueError("kind is 'kd' or 'ball'")
        self.kind, self.leaf, self.sample, self.seed, self.most = kind, leaf, sample, seed, most_cells
        self.cuts: list[tuple[int, float, int, int]] = []

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "assigned"}  # tasks get the cuts, not the frame

    def _split(self, rows: np.ndarray, depth: int, leaf: float) -> int:
        """The node of ``rows``: at least 0 for a cut, else -1 - cell."""
        axis = depth % rows.shape[1] if self.kind == "kd" else int(rows.var(axis=0).argmax())
        cut = float(np.median(rows[:, axis]))
        left = rows[:, axis] <= cut
        if len(rows) <= leaf or left.all() or not left.any():
            self.cells += 1
            return -self.cells
        at = len(self.cuts)
        self.cuts.append((axis, cut, 0, 0))
        self.cuts[at] = (axis, cut, self._split(rows[left], depth + 1, leaf), self._split(rows[~left], depth + 1, leaf))
        return at

    def _cells_of(self, rows: np.ndarray) -> np.ndarray:
        node = np.full(len(rows), self.root)
        while (inner := np.flatnonzero(node >= 0)).size:
            for n in np.unique(node[inner]):
                own = inner[node[inner] == n]
                axis, cut, low, high = self.cuts[n]
                node[own] = np.where(rows[own, axis] <= cut, low, high)
        return -node - 1

    def fit(self, base: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> PrunedCells:
        rows = _sampled(base, id_col, vector, self.sample, self.seed)
        self.cuts, self.cells = [], 0
        self.root = self._split(rows, 0, max(self.leaf, len(rows) / self.most))

        def assigned(batches):
            for b in batches:
                if len(b):
                    yield b.assign(cell=self._cells_of(matrix(b["vector"])).astype(np.int32))

        slim = base.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("vector"))
        self.assigned = stored(slim.mapInPandas(assigned, _ASSIGNED), "cells")

        def bounds(batches):  # cells x dimensions numbers for each task
            low, high, total, n = {}, {}, {}, {}
            for b in batches:
                rows = matrix(b["vector"])
                for c, at in b.groupby("cell").indices.items():
                    own = rows[at]
                    low[c] = np.minimum(low.get(c, np.inf), own.min(axis=0))
                    high[c] = np.maximum(high.get(c, -np.inf), own.max(axis=0))
                    total[c], n[c] = total.get(c, 0.0) + own.sum(axis=0), n.get(c, 0) + len(own)
            for c in n:
                yield pd.DataFrame({"cell": c, "dim": range(len(low[c])), "low": low[c], "high": high[c], "total": total[c], "n": n[c]})

        got = self.assigned.mapInPandas(bounds, "cell int, dim int, low double, high double, total double, n long")
        got = got.groupBy("cell", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("cell", "dim").toPandas()
        self.ids = got["cell"].unique()
        shape = (len(self.ids), -1)
        self.low, self.high, self.count = got["low"].to_numpy().reshape(shape), got["high"].to_numpy().reshape(shape), got["n"].to_numpy().reshape(shape)[:, 0]
        if self.kind == "ball":
            self.center = got["total"].to_numpy().reshape(shape) / self.count[:, None]
            at = {int(c): i for i, c in enumerate(self.ids)}

            def reach(batches):
                most: dict = {}
                for b in batches:
                    if len(b):
                        cell = b["cell"].map(at).to_numpy()
                        d = np.sqrt(((matrix(b["vector"]) - self.center[cell]) ** 2).sum(axis=1))
                        for c, x in zip(b["cell"], d, strict=True):
                            most[c] = max(most.get(c, 0.0), x)
                yield pd.DataFrame({"cell": list(most), "radius": list(most.values())}).astype({"cell": "int32", "radius": "float64"})

            radius = self.assigned.mapInPandas(reach, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).orderBy("cell").toPandas()
            self.radius = radius["radius"].to_numpy()
        return self

    def _least(self, q: np.ndarray) -> np.ndarray:
        """Lower bound of the squared distance of queries to cells."""
        if self.kind == "ball":
            return np.maximum(0.0, np.sqrt(scores(q, self.center, "l2")) - self.radius[None, :]) ** 2
        return np.stack([(np.maximum(0.0, np.maximum(self.low - x, x - self.high)) ** 2).sum(axis=1) for x in q]) if len(q) else np.zeros((0, len(self.ids)))

    def search(self, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score), the same as the exact scan.

        Queries go in blocks to all tasks. A task skips the rows of a cell that lies farther from a query than the k rows it has seen.
        """
        if k < 1:
            raise ValueError("k must be at least 1")

        def candidates(batches, asked):
            block, best = asked.value, None
            least, bound = self._least(block.vectors), np.full(len(asked.value.ids), np.inf)
            for b in batches:
                for at in range(0, len(b), 2048):
                    some = b.iloc[at : at + 2048]
                    cell = np.searchsorted(self.ids, some["cell"].to_numpy())
                    may = least[:, cell] <= (bound * (1 + 1e-9) + 1e-12)[:, None]
                    if (hit := may.any(axis=0)).any():
                        best = nearer(best, matrix(some["vector"][hit]), some["vec_id"].to_numpy()[hit], block.vectors, may[:, hit], k)
                        last = best[best.groupby("q").cumcount() == k - 1]
                        bound[last["q"]] = last["score"]
            if best is not None:
                yield block.named(best)

        asked = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).cast("array<float>").alias("q"))
        return in_blocks(self.assigned, asked, candidates, HITS, ranked(k), 512)


class PlaneForest:
    """``trees`` trees of random planes through sampled midpoints; a leaf is a bit string.

    A query looks into its own leaf of each tree and into ``extra`` more, those
    whose crossed planes lie nearest; the union is ranked by exact squared L2 (or ``angular``
    distance). Queries go in blocks to all tasks, which compare leaves, look at the rows that share one and send k rows a query.
    """

    def __init__(self, trees: int = 10, depth: int = 6, extra: int = 3, seed: int = 42, sample: int = 4096, metric: str = "l2"):
        if metric not in ("l2", "angular"):
            raise ValueError("metric is 'l2' or 'angular'")
        self.trees, self.depth, self.extra, self.seed, self.sample, self.metric = trees, depth, extra, seed, sample, metric

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "assigned"}

    def fit(self, base: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> PlaneForest:
        rows, rng = _sampled(base, id_col, vector, self.sample, self.seed), np.random.default_rng(self.seed)
        self.planes = np.zeros((self.trees, self.depth, rows.shape[1]))
        self.offsets = np.zeros((self.trees, self.depth))
        for t in range(self.trees):
            for d in range(self.depth):
                a, b = rows[rng.integers(len(rows))], rows[rng.integers(len(rows))]
                plane = a - b if not np.array_equal(a, b) else rng.standard_normal(rows.shape[1])
                self.planes[t, d], self.offsets[t, d] = plane, np.median(rows @ plane)
        powers = 1 << np.arange(self.depth)

        def leaves(batches):
            for b in batches:
                if len(b):
                    margin = np.einsum("nd,tkd->ntk", matrix(b["vector"]), self.planes) - self.offsets
                    yield b.assign(leaves=list(((margin > 0) * powers).sum(axis=2).astype(np.int32)))

        slim = base.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("vector"))
        self.assigned = stored(slim.mapInPandas(leaves, _LEAVES), "leaves")
        return self

    def save(self, spark, folder: str) -> None:
        """The planes (one row) and the rows with their leaves, in a folder."""
        planes = [(self.planes.ravel().tolist(), self.offsets.ravel().tolist(), self.trees, self.depth)]
        spark.createDataFrame(planes, _PLANES).coalesce(1).write.parquet(f"{folder}/planes")
        self.assigned.write.parquet(f"{folder}/rows")

    def load(self, spark, folder: str) -> PlaneForest:
        row = spark.read.schema(_PLANES).parquet(f"{folder}/planes").first()
        self.trees, self.depth = row["trees"], row["depth"]
        self.planes, self.offsets = np.array(row["planes"]).reshape(self.trees, self.depth, -1), np.array(row["offsets"]).reshape(self.trees, self.depth)
        self.assigned = spark.read.schema(_LEAVES).parquet(f"{folder}/rows")
        return self

    def search(self, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score); null and, for angular distance, zero vectors take no part."""
        trees, extra, unit = self.trees, self.extra, self.metric == "angular"
        planes, offsets, powers = self.planes, self.offsets, 1 << np.arange(self.depth)

        def scaled(x: np.ndarray) -> np.ndarray:
            size = np.sqrt((x**2).sum(axis=1, keepdims=True))
            return np.divide(x, size, out=np.zeros_like(x), where=size > 0) if unit else x

        def candidates(batches, asked):
            block, best = asked.value, None
            margin = np.einsum("nd,tkd->ntk", block.vectors, planes) - offsets
            own = ((margin > 0) * powers).sum(axis=2)
            near = np.argsort(np.abs(margin), axis=2, kind="stable")[:, :, :extra]
            probes = np.concatenate([own[:, :, None], own[:, :, None] ^ powers[near]], axis=2)  # queries, trees, leaves
            theirs, queries = scaled(block.vectors), (block.vectors != 0).any(axis=1)
            for b in batches:
                for at in range(0, len(b), 2048):
                    some = b.iloc[at : at + 2048]
                    leaves, rows = np.stack(some["leaves"].to_list()), matrix(some["vector"])
                    may = np.zeros((len(own), len(some)), bool)
                    for t in range(trees):
                        for leaf in probes[:, t].T:
                            may |= leaf[:, None] == leaves[None, :, t]
                    if unit:
                        may &= queries[:, None] & (rows != 0).any(axis=1)[None, :]
                    if (hit := may.any(axis=0)).any():
                        best = nearer(best, scaled(rows[hit]), some["vec_id"].to_numpy()[hit], theirs, may[:, hit], k)
            if best is not None:
                # between unit vectors squared L2 is 2 (1 - cosine)
                yield block.named(best.assign(score=np.sqrt(best["score"])) if unit else best)

        asked = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).cast("array<float>").alias("q"))
        return in_blocks(self.assigned, asked, candidates, HITS, ranked(k), 512)
