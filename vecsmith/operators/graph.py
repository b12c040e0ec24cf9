"""A layered proximity graph for each partition; searches fan out to all and merge.

Rows are dealt into graphs of about ``rows`` nodes, so a task's
memory is bounded. Each graph is deterministic: rows in id order, levels by a seed. Built graphs are
stored as plain arrays, one row for each graph, and searched without being built again.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsmith.operators.scratch import stored
from vecsmith.operators.search import HITS, in_blocks, matrix, ranked


class Graph:
    """Nodes are rows of ``x``; ``links[level][node]`` lists neighbours."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, m: int = 16, build: int = 200, seed: int = 42):
        self.ids, self.x, self.m = ids, x.astype(np.float32), m
        rng = np.random.default_rng(seed)
        self.level = np.floor(-np.log(1.0 - rng.random(len(ids))) / np.log(max(m, 2))).astype(int)
        self.links: list[dict[int, list[int]]] = [{} for _ in range(int(self.level.max(initial=0)) + 1)]
        self.entry = -1
        for node in np.argsort(-self.level, kind="stable"):
            self._insert(int(node), build)

    def packed(self) -> dict:
        """Plain arrays: ids, vectors, levels, the entry, and for each link its level, its node and the other one."""
        links = [(lv, node, other) for lv, by in enumerate(self.links) for node, others in by.items() for other in others]
        at = np.array(links, np.int32).reshape(-1, 3)
        return {"n": len(self.ids), "ids": self.ids.astype(np.int64), "x": self.x.ravel(), "levels": self.level.astype(np.int32), "entry": self.entry, "at": at[:, 0], "node": at[:, 1], "other": at[:, 2]}

    @classmethod
    def unpacked(cls, row) -> Graph:
        g = cls.__new__(cls)
        g.ids, g.level, g.entry = np.asarray(row["ids"]), np.asarray(row["levels"]), int(row["entry"])
        g.x = np.asarray(row["x"], np.float32).reshape(len(g.ids), -1)
        g.links = [{} for _ in range(int(g.level.max(initial=0)) + 1)]
        for lv, node, other in zip(np.asarray(row["at"]).tolist(), np.asarray(row["node"]).tolist(), np.asarray(row["other"]).tolist(), strict=True):
            g.links[lv].setdefault(node, []).append(other)
        return g

    def _apart(self, q: np.ndarray, nodes) -> np.ndarray:
        return ((self.x[nodes] - q) ** 2).sum(axis=1)

    def beam(self, q: np.ndarray, starts: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes found best-first, nearest first."""
        seen, links = set(starts), self.links[level]
        first = [(float(d), n) for d, n in zip(self._apart(q, starts), starts, strict=True)]
        todo, best = list(first), [(-d, n) for d, n in first]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, node = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [n for n in links.get(node, ()) if n not in seen]
            if not new:
                continue
            seen.update(new)
            for e, n in zip(self._apart(q, new).tolist(), new, strict=True):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(todo, (e, n))
                    heapq.heappush(best, (-e, n))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, n) for d, n in best)

    def _diverse(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Nodes closer to the new one than to any kept before them; then the nearest of the others."""
        kept: list[int] = []
        for d, n in near:
            if len(kept) == most:
                break
            if not kept or (self._apart(self.x[n], kept) > d).all():
                kept.append(n)
        return kept + [n for _, n in near if n not in set(kept)][: most - len(kept)]

    def _insert(self, node: int, build: int) -> None:
        top = int(self.level[node])
        for lv in range(top + 1):
            self.links[lv].setdefault(node, [])
        if self.entry < 0:
            self.entry = node
            return
        q, starts = self.x[node], [self.entry]
        for lv in range(int(self.level[self.entry]), -1, -1):
            if lv > top:
                starts = [self.beam(q, starts, 1, lv)[0][1]]
                continue
            near = self.beam(q, starts, build, lv)
            most = 2 * self.m if lv == 0 else self.m
            self.links[lv][node] = self._diverse(near, self.m)
            for other in self.links[lv][node]:
                back = self.links[lv].setdefault(other, [])
                back.append(node)
                if len(back) > most:
                    ranked = sorted(zip(self._apart(self.x[other], back).tolist(), back, strict=True))
                    self.links[lv][other] = self._diverse(ranked, most)
            starts = [n for _, n in near]

    def search(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        starts = [self.entry]
        for lv in range(int(self.level[self.entry]), 0, -1):
            starts = [self.beam(q, starts, 1, lv)[0][1]]
        return self.beam(q, starts, max(width, k), 0)[:k]


_PACKED = "graph int, n long, ids array<long>, x array<float>, levels array<int>, entry int, at array<int>, node array<int>, other array<int>"


class ProximityGraphs:
    """``fit`` builds and stores a row for each graph; ``search`` asks all of them; ``save`` and ``load`` keep them in a folder."""

    def __init__(self, m: int = 16, build: int = 200, width: int = 64, seed: int = 42, rows: int = 20_000):
        self.m, self.build, self.width, self.seed, self.rows = m, build, width, seed, rows
        self.graphs: DataFrame | None = None

    def __getstate__(self):
        return self.__dict__ | {"graphs": None}

    def set_width(self, width: int) -> None:
        if width < 1:
            raise ValueError("the search width must be at least 1")
        self.width = width

    def built(self, base: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """A row of plain arrays for each graph, not stored yet. Rows are dealt by a hash of the id into as many graphs as ``rows`` asks for."""
        slim = base.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
        count, m, build, seed = max(1, -(-slim.count() // self.rows)), self.m, self.build, self.seed

        def packed(key, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("vec_id")
            g = Graph(group["vec_id"].to_numpy(), matrix(group["vector"]), m, build, seed).packed()
            return pd.DataFrame({"graph": [key[0]], **{c: [v] for c, v in g.items()}})

        dealt = slim.withColumn("graph", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
        return dealt.groupBy("graph").applyInPandas(packed, _PACKED)

    def fit(self, base: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> ProximityGraphs:
        self.graphs = stored(self.built(base, id_col, vector), "graphs")
        return self

    def save(self, spark, folder: str) -> None:
        self.graphs.write.parquet(folder)

    def load(self, spark, folder: str) -> ProximityGraphs:
        self.graphs = spark.read.schema(_PACKED).parquet(folder)
        return self

    def search(self, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score)."""
        if self.graphs is None:
            raise RuntimeError("the index is not built")
        asked, width = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).alias("q")), self.width

        def answers(batches, asked):
            block = asked.value
            for b in batches:
                for row in b.to_dict("records"):
                    g = Graph.unpacked(row)
                    found = [(i, int(g.ids[n]), d) for i, q in enumerate(block.vectors.astype(np.float32)) for d, n in g.search(q, k, width)]
                    yield block.named(pd.DataFrame(found, columns=["q", "vec_id", "score"]))

        return in_blocks(self.graphs, asked, answers, HITS, ranked(k))
