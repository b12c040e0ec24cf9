"""Shared pieces: scratch tables, words, hashes, and file access from tasks."""

from __future__ import annotations

import contextlib
import functools

import numpy as np
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vecsmith.operators.scratch import broadcast_if_small, dropped, scratch_dir, scratch_removed, stored  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
_WORDS_KEPT = 300_000


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Within it, queries send so many rows to Python at once: Arrow buffers lie outside of the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def filesystem(uri: str):
    """pyarrow's file system and path for a folder in shared storage."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text) -> F.Column:
    """``text`` with A-Z lower-cased and all else unchanged; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


class _WordHashes(dict):
    """64-bit hashes of words; forgets when it has grown, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """One hash for each run of ``width`` words (none if there are fewer).

    Doubling: the hash of 2w words comes from those of two w-word runs, so the
    cost grows with log(width), and no power of a base has to be inverted.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = _BASES[which]
    step, size = mix(words + base), 1
    out, done = None, 0
    left = width
    while left:
        if left & 1:
            part = step[done : done + n]
            out = part if out is None else mix(out * base + part)
            done += size
        left >>= 1
        if left:
            step = mix(step[:-size] * base + step[size:]) if len(step) > size else step[:0]
            size *= 2
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: What a worker process calls when a task ends, to forget what it remembered for it.
AT_TASK_END: list = [_HASHES.clear]


def task(function):
    """For functions that tasks run over batches: at a task's end their memory goes back to the system.

    Worker processes live on between tasks, and would hold it beside the next stage's.
    """

    @functools.wraps(function)
    def run(*args, **options):
        try:
            yield from function(*args, **options)
        finally:
            _relieve()

    return run


def _relieve() -> None:
    import ctypes

    import pyarrow as pa

    for forget in AT_TASK_END:
        forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batches_of_rows(batches, rows: int = 2000, size: int = 8 << 20):
    """Arrow batches cut to some rows and some bytes of text (one row at least), so that working memory stays small."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        total = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        edge, at = np.cumsum(total), 0
        while at < batch.num_rows:
            before = edge[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(edge, before + size, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def gathered(batches, size: int = 12 << 20, rows: int = 20_000):
    """Arrow batches joined until they hold ``size`` bytes (or ``rows`` rows), one at least; large ones stay as they are."""
    import pyarrow as pa

    waiting, held, n = [], 0, 0
    for batch in batches:
        if waiting and (held + batch.nbytes > size or n + batch.num_rows > rows):
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, held, n = [], 0, 0
        if batch.num_rows:
            waiting.append(batch)
            held, n = held + batch.nbytes, n + batch.num_rows
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
