"""Locality-sensitive hashing: sign or parity codes, shared bands, exact ranking of all candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecsmith.operators.search import HITS, in_blocks, matrix, nearer, ranked

BANDS, BAND_BITS = 4, 8


class HashTables:
    """Codes of ``tables`` x 32 bits.

    ``sign``: the bit of a plane is whether the product plus bias is positive.
    ``parity``: whether floor((product + bias) / r) is odd. Candidates share an
    8-bit band of a code (or one at up to ``probes`` flipped bits); all of them
    are ranked by exact squared L2.
    """

    def __init__(self, dim: int, tables: int = 1, r: float = 1.0, seed: int = 42, kind: str = "sign", planes: np.ndarray | None = None, bias: np.ndarray | None = None):
        if kind not in ("sign", "parity"):
            raise ValueError("kind is 'sign' or 'parity'")
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((tables * BANDS * BAND_BITS, dim)) if planes is None else np.asarray(planes, float)
        self.bias = (rng.uniform(0, r, len(self.planes)) if kind == "parity" else np.zeros(len(self.planes))) if bias is None else bias
        self.tables, self.r, self.kind = len(self.planes) // (BANDS * BAND_BITS), r, kind

    def codes_of(self, rows: np.ndarray) -> np.ndarray:
        """One 32-bit code for each table, as signed integers; bit i is plane i."""
        got = rows @ self.planes.T + self.bias
        bit = got > 0 if self.kind == "sign" else (np.floor(got / self.r).astype(np.int64) & 1).astype(bool)
        powers = np.uint64(1) << np.arange(32, dtype=np.uint64)
        return (bit.reshape(len(rows), self.tables, 32) * powers).sum(axis=2).astype(np.uint32).view(np.int32)

    def encode(self, base: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(vec_id, vector, codes)."""

        def coded(batches):
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"vec_id": b["vec_id"], "vector": b["vector"], "codes": list(self.codes_of(matrix(b["vector"])))})

        rows = base.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("vector"))
        return rows.mapInPandas(coded, "vec_id long, vector array<float>, codes array<int>")

    def search(self, coded: DataFrame, asked: DataFrame, k: int = 10, probes: int = 0) -> DataFrame:
        """(query_id, rank, vec_id, score); both inputs from ``encode``.

        Queries with fewer than k candidates also get those at one flipped bit of the first band.
        Queries go in blocks to all tasks, which send k rows a query of the candidates, and of these others.
        """

        def candidates(batches, asked):
            block = asked.value
            theirs, best = self.codes_of(block.vectors).astype("<i4").view(np.uint8), {False: None, True: None}
            for b in batches:
                for at in range(0, len(b), 2048):
                    some = b.iloc[at : at + 2048]
                    mine = np.stack(some["codes"].to_list()).astype("<i4").view(np.uint8)
                    may, first = np.zeros((len(theirs), len(some)), bool), np.zeros((len(theirs), len(some)), bool)
                    for i in range(mine.shape[1]):
                        apart = np.bitwise_count(theirs[:, i, None] ^ mine[None, :, i])
                        may |= apart <= probes
                        if i % BANDS == 0:
                            first |= apart <= 1
                    for more, ok in ((False, may), (True, first & ~may)):
                        if (hit := ok.any(axis=0)).any():
                            best[more] = nearer(best[more], matrix(some["vector"][hit]), some["vec_id"].to_numpy()[hit], block.vectors, ok[:, hit], k)
            for more, got in best.items():
                if got is not None:
                    yield block.named(got).assign(more=more)

        def enough(found: DataFrame) -> DataFrame:
            # a task that has fewer than k candidates sends them all, so these sums are below k exactly where all candidates are
            count = F.count(F.when(~F.col("more"), 1)).over(Window.partitionBy("n", "query_id"))
            return ranked(k)(found.withColumn("_n", count).where(~F.col("more") | (F.col("_n") < k)).drop("_n", "more"))

        return in_blocks(coded, asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")), candidates, f"{HITS}, more boolean", enough, 512)


def hamming_counts(coded: DataFrame, asked: DataFrame, code_block: int = 4096) -> DataFrame:
    """(query_id, apart, n): how many rows lie at each Hamming distance of each query; frames of (vec_id, code).

    Queries go in blocks to all tasks, which send 33 counts a query.
    """
    codes = coded.where("code is not null").select("code")
    queries = asked.where("code is not null").select(F.col("vec_id").alias("query_id"), F.array(F.col("code").cast("double")).alias("q"))

    def counted(batches, asked):
        block = asked.value
        own = block.vectors[:, 0].astype(np.int64).astype(np.uint32)
        n = np.zeros((len(own), 33), np.int64)
        for b in batches:
            values, times = np.unique(b["code"].to_numpy().astype(np.uint32), return_counts=True)
            for i, c in enumerate(own):
                n[i] += np.bincount(np.bitwise_count(values ^ c), weights=times, minlength=33).astype(np.int64)
        q, d = np.nonzero(n)
        yield pd.DataFrame({"query_id": block.ids[q], "apart": d.astype(np.int32), "rows": n[q, d]})

    summed = lambda out: out.groupBy("query_id", "apart").agg(F.sum("rows").alias("n"))
    return in_blocks(codes, queries, counted, "query_id long, apart int, rows long", summed, code_block)
