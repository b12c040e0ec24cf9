"""Product quantization: codes for sub-vectors, distances by table lookup, optional exact re-ranking of all that may count."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsmith.operators.kmeans import kmeans_local, nearest_cell
from vecsmith.operators.search import HITS, in_blocks, matrix, nearer, ranked


class ProductQuantizer:
    """``parts`` codebooks of ``2 ** bits`` sub-vectors, trained on at most ``sample`` rows (by a hash of the id)."""

    def __init__(self, parts: int = 8, bits: int = 8, seed: int = 42, codebooks: np.ndarray | None = None, sample: int = 16_384):
        if not 1 <= bits <= 15:
            raise ValueError("bits must lie between 1 and 15")
        self.parts, self.bits, self.seed, self.codebooks, self.sample = parts, bits, seed, codebooks, sample

    def _cut(self, rows: np.ndarray) -> np.ndarray:
        if rows.shape[1] % self.parts:
            raise ValueError(f"dimension {rows.shape[1]} is no multiple of {self.parts}")
        return rows.reshape(len(rows), self.parts, -1)

    def fit(self, base: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> ProductQuantizer:
        order = F.xxhash64(F.col(id_col).cast("long"), F.lit(self.seed)), F.xxhash64(vector)
        got = base.where(F.col(vector).isNotNull()).orderBy(*order).limit(self.sample).select(F.col(vector).alias("v")).toPandas()
        if got.empty:
            raise ValueError("training needs rows")
        cut = self._cut(matrix(got["v"]))
        self.codebooks = np.stack([kmeans_local(cut[:, m], 1 << self.bits, seed=self.seed) for m in range(self.parts)])
        return self

    def _trained(self) -> np.ndarray:
        if self.codebooks is None:
            raise RuntimeError("the quantizer is not trained")
        return self.codebooks

    def codes_of(self, rows: np.ndarray) -> np.ndarray:
        cut, books = self._cut(rows), self._trained()
        return np.stack([nearest_cell(cut[:, m], books[m]) for m in range(self.parts)], axis=1).astype(np.int16)

    def encode(self, base: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(vec_id, codes, error): a small number for each sub-vector, and how far the codes' vector lies from the row's."""
        books = self._trained()

        def coded(batches):
            for b in batches:
                if len(b):
                    rows = matrix(b["v"])
                    codes = self.codes_of(rows)
                    off = self._cut(rows) - np.stack([books[m][codes[:, m]] for m in range(self.parts)], axis=1)
                    yield pd.DataFrame({"vec_id": b["vec_id"], "codes": list(codes), "error": np.sqrt((off**2).sum(axis=(1, 2)))})

        rows = base.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"))
        return rows.mapInPandas(coded, "vec_id long, codes array<short>, error double")

    def search(self, codes: DataFrame, queries: DataFrame, k: int = 10, symmetric: bool = False, rerank: bool = False, base: DataFrame | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score): sums of table entries.

        The tables hold distances of the query's sub-vectors to the codebook, or
        with ``symmetric`` of its codes. ``rerank`` ranks by exact squared L2 from
        ``base`` instead, and gives the exact scan's rows: a row is at least as far as its
        codes' vector less the errors of the codes, and is only left out if that
        exceeds the distance of k rows that its task has seen.
        """
        books = self._trained()
        if rerank and base is None:
            raise ValueError("re-ranking needs the vectors")
        asked = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).alias("q"))
        if rerank:
            vectors = base.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"))
            codes = codes.join(vectors, "vec_id")

        def looked_up(batches, asked):
            block = asked.value
            cut, off = self._cut(block.vectors), np.zeros(len(block.ids))
            if symmetric:
                own = np.stack([books[m][self.codes_of(block.vectors)[:, m]] for m in range(self.parts)], axis=1)
                cut, off = own, np.sqrt(((cut - own) ** 2).sum(axis=(1, 2)))
            tables = np.stack([((cut[:, m, None, :] - books[m][None, :, :]) ** 2).sum(axis=2) for m in range(self.parts)])
            best, bound = None, np.full(len(block.ids), np.inf)
            for b in batches:
                for at in range(0, len(b), 2048):
                    some = b.iloc[at : at + 2048]
                    c, vec = np.stack(some["codes"].to_list()), some["vec_id"].to_numpy()
                    total = sum(tables[m][:, c[:, m]] for m in range(len(tables)))
                    if rerank:
                        least = np.sqrt(total) - off[:, None] - some["error"].to_numpy()
                        may = least <= (np.sqrt(bound) * (1 + 1e-9) + 1e-9)[:, None]
                        if (hit := may.any(axis=0)).any():
                            best = nearer(best, matrix(some["v"][hit]), vec[hit], block.vectors, may[:, hit], k)
                            last = best[best.groupby("q").cumcount() == k - 1]
                            bound[last["q"]] = last["score"]
                        continue
                    n = min(k, len(vec))
                    edge = np.partition(total, n - 1, axis=1)[:, n - 1]
                    q, r = np.nonzero(total <= edge[:, None])
                    part = pd.DataFrame({"q": q, "vec_id": vec[r], "score": total[q, r]})
                    best = (part if best is None else pd.concat([best, part])).sort_values(["q", "score", "vec_id"])
                    best = best[best.groupby("q").cumcount() < k]
            if best is not None:
                yield block.named(best)

        return in_blocks(codes, asked, looked_up, HITS, ranked(k), 512)
