"""Token ids in files: frequency-ranked, byte-aligned, with separate control bytes.

Ids are replaced by their rank in the corpus, so the 256 most frequent take one
byte. A rank takes 1 to 4 bytes; two bits in a control byte (four ranks each)
tell how many. Control and data bytes lie apart, so a block is decoded by a
table lookup on control bytes and a few numpy gathers.

File: magic, then blocks. Block: counts of documents, ids and data bytes (u64),
document ids (i64), their validity (u8), numbers of ids (u64), control, data.
``ranks.bin`` lists the ids (u32) by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsmith.llm.common import batches_of_rows, dropped, filesystem, gathered, scratch_dir, small_batches, stored, task
from vecsmith.llm.files import ShardFile, committed, file_rows, listed
from vecsmith.llm.tokenizing import segment_ids

MAGIC = b"FRCB0001"
BLOCK_IDS, FILE_BYTES = 1 << 20, 64 << 20
#: For each control byte, the bytes that its four ranks take.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes."""
    ranks = ranks.astype(np.uint32)
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = code
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    at = np.cumsum(code + np.int64(1)) - (code + np.int64(1))
    data = np.zeros(int(len(ranks) + code.sum(dtype=np.int64)), np.uint8)
    data[at] = ranks.astype(np.uint8)
    for k in range(1, int(code.max(initial=0)) + 1):
        has = np.flatnonzero(code >= k)
        data[at[has] + k] = (ranks[has] >> np.uint32(8 * k)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lengths) - lengths
    data = np.frombuffer(data, np.uint8)
    out = data[at].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        has = np.flatnonzero(lengths > k)
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_RAW = "doc_id long, tie long, ids binary, counts binary"


@task
def _tokenized(batches, path: str, end_id: int):
    """Ids of each document; the task's last row has its counts of all ids instead."""
    encode = segment_ids(path)
    end = pa.scalar(np.array([end_id], encode.dtype).tobytes(), pa.binary())
    counts = np.zeros(max(encode.library.get_vocab_size(), end_id + 1), np.int64)
    names = ["doc_id", "tie", "ids", "counts"]
    for batch in batches_of_rows(gathered(batches), 20_000, 16 << 20):
        ids = pc.binary_join_element_wise(encode.ids(batch.column("text")), end, b"")
        counts += np.bincount(np.frombuffer(ids.buffers()[2], encode.dtype), minlength=len(counts))
        yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("tie"), ids, pa.nulls(len(ids), pa.binary())], names)
    yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names)


@task
def _summed(batches):
    """(id, n): the sum of tasks' counts."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for counts in batch.column("counts").to_pylist():
            own = np.frombuffer(counts, np.int64)
            total = own.copy() if not len(total) else total + own
    ids = np.flatnonzero(total)
    yield pa.record_batch({"id": pa.array(ids, pa.int64()), "n": pa.array(total[ids], pa.int64())})


class _Shard:
    def __init__(self, folder, part, seq, rank_of, dtype):
        self.file, self.part, self.first, self.next = ShardFile(folder), part, seq, seq
        self.rank_of, self.dtype, self.docs, self.waiting, self.ids = rank_of, dtype, [], 0, 0
        self.file.write(MAGIC)

    def add(self, doc, ids):
        self.docs.append((doc, ids))
        self.next += 1
        self.waiting += len(ids) // self.dtype.itemsize
        if self.waiting >= BLOCK_IDS:
            self.block()

    def block(self):
        if not self.docs:
            return
        ids = np.frombuffer(b"".join(x for _, x in self.docs), self.dtype)
        control, data = encode_ranks(self.rank_of[ids])
        self.file.write(np.array([len(self.docs), len(ids), len(data)], "<u8").tobytes())
        self.file.write(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + np.array([d is not None for d, _ in self.docs], np.uint8).tobytes())
        self.file.write(np.array([len(x) // self.dtype.itemsize for _, x in self.docs], "<u8").tobytes())
        self.file.write(control)
        self.file.write(data)
        self.ids += len(ids)
        self.docs, self.waiting = [], 0

    def row(self):
        self.block()
        self.file.close()
        return {"temporary": self.file.temporary, "name": f"ids-{self.part:06d}-{self.first:012d}.bin", "docs": self.next - self.first, "ids": self.ids, "bytes": self.file.size}


_MANIFEST = pa.schema([("temporary", pa.string()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


@task
def _written(batches, folder, dtype, file_bytes):
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/ranks.bin") as f:
        id_of = np.frombuffer(f.read(), "<u4")
    rank_of = np.zeros(int(id_of.max(initial=0)) + 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    from pyspark import TaskContext

    shard, rows, part, seq = None, [], TaskContext.get().partitionId(), 0
    for batch in batches_of_rows(batches):
        for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if shard and shard.file.size >= file_bytes:
                rows.append(shard.row())
                shard = None
            shard = shard or _Shard(folder, part, seq, rank_of, dtype)
            shard.add(doc, ids)
            seq += 1
    if shard:
        rows.append(shard.row())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_MANIFEST)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, id_col: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> str:
    """Write the ids of all texts in ascending id order (null ids first, repeated ones by a hash of their text); the folder.

    Null texts count as empty. Each document's ids end with ``end_id``. An empty table gives a folder without
    token files. Texts are encoded where they lie; only ids are sorted.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch_dir(spark)}/ids"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with small_batches(spark):
        tied = slim.select("doc_id", F.xxhash64("text").alias("tie"), "text")
        raw = stored(tied.mapInArrow(lambda it: _tokenized(it, tokenizer, end_id), _RAW), "raw")
    dtype = segment_ids(tokenizer).dtype
    counts = raw.where("counts is not null").select("counts").mapInArrow(_summed, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]  # at most the vocabulary
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks.bin") as out:
        out.write(np.array(by_rank, "<u4").tobytes())
    schema = "temporary string, name string, docs long, ids long, bytes long"
    order = raw.where("ids is not null").drop("counts").repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    committed(order.mapInArrow(lambda it: _written(it, folder, dtype, file_bytes), schema), folder, format=MAGIC.decode(), end_id=end_id)
    dropped(spark, raw)
    return folder


def read_blocks(stream):
    """(document ids, numbers of ids, ranks) of each block."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := stream.read(24):
        docs, ids, size = (int(x) for x in np.frombuffer(head, "<u8"))
        doc = np.frombuffer(stream.read(8 * docs), "<i8")
        valid = np.frombuffer(stream.read(docs), np.uint8).astype(bool)
        counts = np.frombuffer(stream.read(8 * docs), "<u8").astype(np.int64)
        control = stream.read(-(-ids // 4))
        yield doc, valid, counts, decode_ranks(control, stream.read(size), ids)


@task
def _read(batches, folder):
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/ranks.bin") as f:
        id_of = np.frombuffer(f.read(), "<u4")
    for batch in batches:
        for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
            with fs.open_input_stream(f"{root}/{name}") as stream:
                for doc, valid, counts, ranks in read_blocks(stream):
                    ids = id_of[ranks]
                    edge = np.concatenate([[0], np.cumsum(counts)])
                    for at in range(0, len(doc), 1000):
                        k = slice(at, at + 1000)
                        own = [ids[a:b].tobytes() for a, b in zip(edge[:-1][k], edge[1:][k], strict=True)]
                        yield pa.record_batch({"doc_id": pa.array(doc[k], pa.int64(), mask=~valid[k]), "start": pa.array(base + edge[:-1][k], pa.int64()), "n_tokens": pa.array(counts[k], pa.int64()), "ids": pa.array(own, pa.binary())})
                    base += len(ids)


def read_token_files(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian u32) of every document in the folder's files."""
    rows, base = [], 0
    for f in listed(folder)["files"]:
        rows.append((f["name"], base))
        base += f["ids"]
    return file_rows(spark, rows, "name string, base long").mapInArrow(lambda it: _read(it, folder), "doc_id long, start long, n_tokens long, ids binary")
