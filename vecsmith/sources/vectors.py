"""Vector files: fvecs and ivecs records, and the native float dump."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _records(content: bytes, kind: str) -> np.ndarray:
    """Rows of (int32 dimension, payload) records."""
    if not content:
        return np.zeros((0, 0), kind)
    dim = int(np.frombuffer(content[:4], "<i4")[0])
    raw = np.frombuffer(content, "<i4")
    if dim < 1 or len(raw) % (dim + 1) or (raw.reshape(-1, dim + 1)[:, 0] != dim).any():
        raise ValueError("damaged vector file")
    return raw.reshape(-1, dim + 1)[:, 1:].copy().view(kind)


def _dump(content: bytes) -> np.ndarray:
    """Rows of a dump: dimension and count (u64 each), then float32 values; lengths are checked."""
    dim, n = (int(x) for x in np.frombuffer(content[:16], "<u8"))
    if len(content) != 16 + 4 * dim * n:
        raise ValueError(f"expected {16 + 4 * dim * n} bytes, got {len(content)}")
    return np.frombuffer(content[16:], "<f4").reshape(n, dim)


def dumped(rows: np.ndarray) -> bytes:
    """The dump of a matrix."""
    rows = np.ascontiguousarray(rows, "<f4")
    return np.array([rows.shape[1], rows.shape[0]], "<u8").tobytes() + rows.tobytes()


def _read(spark: SparkSession, path: str, parse, element: str) -> DataFrame:
    def rows(batches):
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                got = parse(content)
                for at in range(0, len(got), 4096):
                    part = got[at : at + 4096]
                    yield pd.DataFrame({"path": file, "seq": np.arange(at, at + len(part)), "vector": list(part)})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(rows, f"path string, seq long, vector array<{element}>")


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, vector) of float records."""
    return _read(spark, path, lambda c: _records(c, "<f4"), "float")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, lambda c: _records(c, "<i4"), "int")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _dump, "float")


def write_dump(df: DataFrame, path: str, vector: str = "vector", seq: str = "seq", rows: int = 65_536) -> None:
    """Dumps of at most ``rows`` rows in order of ``seq``, as binary rows (part, n, dump) in Parquet (path is a folder)."""

    def parts(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() << 32, []
        for b in batches:
            held += [np.asarray(v, np.float32) for v in b["v"]]
            while len(held) >= rows:
                yield pd.DataFrame({"part": [part], "n": [rows], "dump": [dumped(np.stack(held[:rows]))]})
                part, held = part + 1, held[rows:]
        if held:
            yield pd.DataFrame({"part": [part], "n": [len(held)], "dump": [dumped(np.stack(held))]})

    df.select(F.col(vector).alias("v"), F.col(seq).alias("s")).repartitionByRange("s").sortWithinPartitions("s").select("v").mapInPandas(parts, "part long, n long, dump binary").write.parquet(path)
