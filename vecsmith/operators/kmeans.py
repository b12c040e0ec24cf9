"""k-means by Lloyd's iterations: partial sums in tasks, centroids on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsmith.operators.search import matrix, scores, spread

#: Numbers in a packed block of vectors, and partial sums that the driver adds up itself.
_PACKED, _AT_ONCE = 1 << 20, 1 << 22
_SUMS = "cell long, dim long, total double, n long"


def first_centroids(rows: DataFrame, k: int, vector: str = "embedding", seed: int = 42) -> np.ndarray:
    """``k`` distinct rows in a hash order; an error if there are fewer rows."""
    got = rows.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v")).distinct().orderBy(F.xxhash64("v", F.lit(seed))).limit(k).toPandas()
    if len(got) < k:
        raise ValueError(f"{k} cells need at least {k} distinct rows, got {len(got)}")
    return matrix(got["v"])


def nearest_cell(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The closest centroid of each row; of equally close ones the first."""
    return scores(rows, centroids, "l2").argmin(axis=1)


def _vectors(column: pa.Array) -> np.ndarray:
    """An Arrow column of vectors, none of them null, as a matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of several dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)


def _packed(batches):
    """Vectors as blocks of bytes, which need no conversion when they are read again."""
    for batch in batches:
        if batch.num_rows:
            rows = _vectors(batch.column(0))
            step = max(1, _PACKED // max(1, rows.shape[1]))
            some = [rows[at : at + step] for at in range(0, len(rows), step)]
            yield pa.record_batch({"n": pa.array([len(x) for x in some], pa.int64()), "kind": [x.dtype.str for x in some], "vectors": pa.array([x.tobytes() for x in some], pa.binary())})


def _unpacked(batches):
    for batch in batches:
        for n, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield np.frombuffer(data, kind).reshape(n, -1)


def _rows(batches):
    """The vectors of packed blocks, one a row again."""
    for rows in _unpacked(batches):
        edge = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
        yield pa.record_batch([pa.ListArray.from_arrays(edge, pa.array(rows.ravel()))], names=["v"])


def _sums(matrices, centroids):
    n, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    for rows in matrices:
        rows = rows.astype(np.float64)
        cell = nearest_cell(rows, centroids)
        count = np.bincount(cell, minlength=len(centroids))
        some = np.flatnonzero(count)
        total[some] += np.add.reduceat(rows[np.argsort(cell, kind="stable")], (np.cumsum(count) - count)[some], axis=0)
        n += count
    cell, dim = np.nonzero(np.repeat(n[:, None] > 0, centroids.shape[1], axis=1))
    yield pa.record_batch({"cell": cell, "dim": dim, "total": total[cell, dim], "n": n[cell]})


def lloyd_step(rows: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> DataFrame:
    """(cell, dim, mean, n) of one iteration: cells x dimensions numbers for each task move."""
    part = rows.where(F.col(vector).isNotNull()).select(vector).mapInArrow(lambda it: _sums((_vectors(b.column(0)) for b in it if b.num_rows), centroids), _SUMS)
    return _added(part).select("cell", "dim", (F.col("total") / F.col("n")).alias("mean"), "n")


def _added(part: DataFrame) -> DataFrame:
    return part.groupBy("cell", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _means(blocks: DataFrame, tasks: int, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the cells of packed blocks, those of empty ones unchanged, and their sizes. A few partial sums go straight to the driver, many through a shuffle."""
    part = blocks.mapInArrow(lambda it: _sums(_unpacked(it), centroids), _SUMS)
    got = (part if tasks * centroids.size <= _AT_ONCE else _added(part)).toPandas()
    total, n = np.zeros_like(centroids), np.zeros(centroids.shape, np.int64)
    np.add.at(total, (got["cell"], got["dim"]), got["total"])
    np.add.at(n, (got["cell"], got["dim"]), got["n"])
    return np.where(n > 0, total / np.maximum(n, 1), centroids), n[:, 0]


def split_empty(centroids: np.ndarray, n: np.ndarray, shift: float = 1.0 / 1024) -> tuple[np.ndarray, np.ndarray]:
    """Give each empty cell half of the largest one: both centroids move apart a little."""
    centroids, n = centroids.copy(), n.copy()
    for cell in np.flatnonzero(n == 0):
        donor = int(n.argmax())
        sign = np.where(np.arange(centroids.shape[1]) % 2 == 0, 1.0, -1.0)
        centroids[cell] = centroids[donor] * (1 + sign * shift)
        centroids[donor] = centroids[donor] * (1 - sign * shift)
        n[cell] = n[donor] // 2
        n[donor] -= n[cell]
    return centroids, n


def kmeans(rows: DataFrame, k: int, iterations: int = 25, seed: int = 42, tolerance: float = 0.0, id_col: str = "vec_id", vector: str = "embedding", sample: int | None = None) -> np.ndarray:
    """Centroids (k x dimension). ``sample`` bounds the rows trained on (by a hash of the id); None trains on all."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if sample is not None:
        count = rows.count()
        if count > sample:
            rows = rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < F.lit(int((1 << 20) * sample / count)))
    rows = spread(rows.where(F.col(vector).isNotNull()).select(vector))
    blocks = rows.mapInArrow(_packed, "n long, kind string, vectors binary").cache()
    try:
        again = blocks.mapInArrow(_rows, T.StructType([T.StructField(vector, rows.schema[vector].dataType)]))
        centroids = first_centroids(again, k, vector, seed)
        tasks = blocks.rdd.getNumPartitions()
        for _ in range(iterations):
            new, _ = split_empty(*_means(blocks, tasks, centroids))
            moved = float(((new - centroids) ** 2).sum(axis=1).max())
            centroids = new
            if moved <= tolerance:
                break
    finally:
        blocks.unpersist()
    return centroids


def kmeans_local(rows: np.ndarray, k: int, iterations: int = 25, seed: int = 42) -> np.ndarray:
    """The same on an array (sub-vectors of a bounded sample)."""
    distinct = np.unique(rows, axis=0)
    pick = np.random.default_rng(seed).permutation(len(distinct))[: min(k, len(distinct))]
    centroids = distinct[pick]
    if len(centroids) < k:  # fewer distinct rows than codes: the rest repeat
        return np.concatenate([centroids, np.repeat(centroids[:1], k - len(centroids), axis=0)])
    for _ in range(iterations):
        cell = nearest_cell(rows, centroids)
        n = np.bincount(cell, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, cell, rows)
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
        new, _ = split_empty(new, n)
        if np.array_equal(new, centroids):
            break
        centroids = new
    return centroids
