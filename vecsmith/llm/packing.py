"""Packing in space-filling-curve order.

A document's token counts are projected by hashed signs to a few dimensions;
its place on the Hilbert curve through these is the sort key. After one range
sort each partition fills its sequences with neighbouring documents, cutting
freely; what is left at its end goes to sequences of powers of two, so nothing
is padded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsmith.llm.common import batches_of_rows, gathered, mix, small_batches, stored, task
from vecsmith.llm.tokenizing import segment_ids

LENGTH, DIMENSIONS, BITS = 2048, 3, 10
#: Bytes of text that a task encodes at once; its pieces and ids take several times as many.
_TEXT = 4 << 20
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), each coordinate of ``bits`` bits."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        bit, below = 1 << b, (1 << b) - 1
        for d in range(dims):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(on, below, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def projection(vocabulary: int, dims: int) -> np.ndarray:
    """A fixed pseudo-random row of ``dims`` numbers in -1 to 1 for each token id."""
    cells = mix(np.arange(1, vocabulary * dims + 1, dtype=np.uint64)).reshape(vocabulary, dims)
    return ((cells >> np.uint64(11)).astype(np.float64) / 2**52 - 1).astype(np.float32)


def curve_keys(flat: np.ndarray, sizes: np.ndarray, table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents (their ids in ``flat``, ``sizes`` of them each): the direction of their projected token counts."""
    sums, some = np.zeros((len(sizes), table.shape[1])), sizes > 0
    if some.any():
        flat, starts = flat.astype(np.intp), (np.cumsum(sizes) - sizes)[some]
        for d, column in enumerate(np.ascontiguousarray(table.T)):
            sums[some, d] = np.add.reduceat(column.take(flat), starts)
    norm = np.sqrt((sums**2).sum(axis=1, keepdims=True))
    unit = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
    return hilbert_keys(np.minimum((unit + 1) / 2 * (1 << bits), (1 << bits) - 1), bits)


_TABLES: dict = {}


@task
def _tokenized(batches, path, dims, bits):
    encode = segment_ids(path)
    if (path, dims) not in _TABLES:
        _TABLES[path, dims] = projection(encode.library.get_vocab_size(), dims)
    table = _TABLES[path, dims]
    for batch in batches_of_rows(gathered(batches, _TEXT), 20_000, _TEXT):
        ids = encode.ids(batch.column("text"))
        edge = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1).astype(np.int64) // encode.dtype.itemsize
        flat = np.frombuffer(ids.buffers()[2] or b"", encode.dtype)[: edge[-1]]
        keys = curve_keys(flat, np.diff(edge), table, bits)
        yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "key": pa.array(keys, pa.int64()), "ids": ids})


class _Packer:
    def __init__(self, part: int, length: int):
        self.length, self.next_id, self.open, self.filled, self.done = length, part << 40, [], 0, []

    def add(self, doc, ids):
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.length - self.filled)
            self.open.append((doc, at, ids[at : at + n], len(ids)))
            self.filled += n
            at += n
            if self.filled == self.length:
                self.close(self.open)
                self.open, self.filled = [], 0

    def close(self, pieces):
        offset = 0
        for doc, at, ids, total in pieces:
            self.done.append((doc, at, len(ids), ids.astype("<u4").tobytes(), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def finish(self):
        """The rest, cut into sequences whose lengths are powers of two."""
        pieces = self.open[::-1]
        for b in range(self.filled.bit_length() - 1, -1, -1):
            room, own = (1 << b) & self.filled, []
            while room:
                doc, at, ids, total = pieces.pop()
                own.append((doc, at, ids[:room], total))
                if len(ids) > room:
                    pieces.append((doc, at + room, ids[room:], total))
                room -= len(own[-1][2])
            if own:
                self.close(own)

    def batch(self):
        columns = list(zip(*self.done, strict=True))
        self.done = []
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


@task
def _packed(batches, dtype, end_id, length):
    from pyspark import TaskContext

    packer = _Packer(TaskContext.get().partitionId(), length)
    for batch in batches_of_rows(batches):
        for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            packer.add(doc, np.append(np.frombuffer(ids, dtype).astype(np.uint32), np.uint32(end_id)))
            if len(packer.done) >= 2000:
                yield packer.batch()
    packer.finish()
    if packer.done:
        yield packer.batch()


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text: str = "text", dims: int = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row for each piece.

    ``ids`` are little-endian u32. Each document's ids end with ``end_id``; a
    null or empty text has that id alone. Sequences hold ``length`` ids, or a
    power of two below it at a partition's end. Null and repeated ids are
    documents of their own; ties on the curve go by a hash of the id, so a large
    group of copies spreads over partitions. An empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):
        keyed = stored(slim.mapInArrow(lambda it: _tokenized(it, tokenizer, dims, bits), "doc_id long, key long, ids binary"), "keyed")
    dtype = segment_ids(tokenizer).dtype
    curve = keyed.repartitionByRange("key", F.xxhash64("doc_id")).sortWithinPartitions("key", F.xxhash64("doc_id"))
    return curve.mapInArrow(lambda it: _packed(it, dtype, end_id, length), _PIECES)
