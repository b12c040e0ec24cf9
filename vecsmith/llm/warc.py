"""WARC archives: a deterministic sharded writer and its reader.

Records are range-sorted by id; each range is a shard whose files roll at a
compressed size. The ranges depend on the table's ids and sizes alone, not on how its
rows are dealt, so one table always gives the same files. Headers (lengths, digests, ids, dates) are made anew from the
payload. Files are written under temporary names and committed by a manifest.
Every record is a gzip member of its own, so files can be cut at any record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vecsmith.llm.common import batches_of_rows, dropped, filesystem, scratch_dir, stored, task
from vecsmith.llm.files import ShardFile, committed, file_rows, listed

FILE_BYTES, SMALLEST = 64 << 20, 100
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("5b3c1c36-4c5e-5d36-9a53-2b7e3a3f5f10")
_READ = 1 << 20
#: Payload bytes of a shard, and how few and how many shards there are; ids a shard from which its bounds are taken.
SHARD_BYTES, _FEWEST, _MOST, _EACH = 256 << 20, 32, 10_000, 64


def _clean(url: str | None, page: object) -> str:
    """A header-safe target: what would end a line or a word is percent-encoded."""
    if not url:
        return f"urn:page:{page}"
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False, date: str = DATE) -> bytes:
    """One record, uncompressed. A revisit has the HTTP headers of its payload, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    own = uuid.uuid5(_SPACE, f"{page_id}:{digest}:{'revisit' if revisit else 'response'}")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url, page_id)}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}"]
        if refers_to is not None:
            lines += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, f'{refers_to}:{digest}:response')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Shard:
    def __init__(self, folder, part, seq):
        self.file, self.name, self.part, self.seq = ShardFile(folder), f"shard-{part:06d}-{seq:05d}.warc.gz", part, seq
        self.records, self.first, self.last, self.sha = 0, None, None, hashlib.sha256()

    def add(self, page, data):
        self.file.write(data)
        self.sha.update(data)
        self.first = page if not self.records else self.first
        self.last = page
        self.records += 1

    def row(self):
        self.file.close()
        return {"temporary": self.file.temporary, "name": self.name, "records": self.records, "bytes": self.file.size, "first_id": self.first, "last_id": self.last, "sha256": self.sha.hexdigest()}


_MANIFEST = pa.schema([("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("sha256", pa.string())])


@task
def _written(batches, folder, file_bytes, smallest, level, date):
    shard, rows, at = None, [], None
    for batch in batches_of_rows(batches):
        for part, page, tag, digest, refers, url, html in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "tag", "digest", "refers_to", "url", "html")), strict=True):
            if tag == 0:
                if at is None or at[0] != page:
                    at = (page, {}, set())  # this id's notes on what it revisits, and the digests it has
                at[1][digest] = refers
                continue
            payload = html.encode() if html else b""
            own = hashlib.sha256(payload).digest()
            if page is None:
                again = refers is not None
            else:
                if at is None or at[0] != page:
                    at = (page, {}, set())
                again = len(payload) >= smallest and (own in at[1] or own in at[2])
                at[2].add(own)
                refers = at[1].get(own, page)
            data = _member(record(page, url, payload, own.hex(), refers, again, date), level)
            if shard and (shard.part != part or shard.file.size + len(data) > file_bytes):
                rows.append(shard.row())
                shard = _Shard(folder, part, shard.seq + 1 if shard.part == part else 0)
            shard = shard or _Shard(folder, part, 0)
            shard.add(page, data)
    if shard:
        rows.append(shard.row())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_MANIFEST)


def _bounds(facts: DataFrame, shard_bytes: int) -> tuple[np.ndarray, int]:
    """The first ids of all shards but the first, and the number of shards for rows without an id.

    Taken from the ids whose hash is divisible by a number, which leaves some dozens of
    them a shard: a function of the table, and at most ``_MOST * _EACH`` rows or so here.
    """
    known = F.col("page_id").isNotNull()
    n, size, nulls = facts.agg(F.count("page_id"), F.coalesce(F.sum(F.when(known, F.col("bytes") + 1)), F.lit(0)), F.coalesce(F.sum(F.when(~known, F.col("bytes") + 1)), F.lit(0))).first()
    shards = min(_MOST, max(_FEWEST, -(-(size + nulls) // shard_bytes)))
    one = max(1.0, (size + nulls) / shards)
    some = facts.where(known & (F.pmod(F.xxhash64("page_id"), F.lit(max(1, n // (shards * _EACH)))) == 0)).groupBy("page_id").agg(F.sum(F.col("bytes") + 1).alias("bytes")).toPandas().sort_values("page_id")
    own = max(1, round(size / one))
    before = some["bytes"].cumsum().to_numpy(dtype=float) - some["bytes"].to_numpy(dtype=float)
    part = np.floor(before * own / max(float(some["bytes"].sum()), 1.0)).astype(np.int64)
    return some["page_id"].to_numpy(dtype=np.int64)[np.flatnonzero(np.diff(part, prepend=0) > 0)], -(-nulls // int(one))


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES, smallest: int = SMALLEST, level: int = 6, date: str = DATE, shard_bytes: int = SHARD_BYTES) -> str:
    """Write one record for each row in ascending id order; the folder, complete with its manifest.

    The payload is ``html`` in UTF-8 (null: empty). Of records with equal
    payloads of at least ``smallest`` bytes the smallest id is the response and
    the others revisit it; of repeated rows of that id the first one is. Rows
    with a null id come first, dealt to shards of their own by a hash; they revisit a row that has an id, and are all
    responses among themselves. A null url becomes ``urn:page:<id>``. An
    empty table gives an empty manifest. Files have the same names and bytes in every run.
    """
    spark = pages.sparkSession
    folder = folder or f"{scratch_dir(spark)}/warc"
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    sha, none = F.unhex(F.sha2(F.col("html").cast("binary"), 256)), lambda kind: F.lit(None).cast(kind)
    facts = stored(slim.select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.when(F.octet_length("html") >= smallest, sha).alias("digest")), "digests")
    bounds, null_shards = _bounds(facts, shard_bytes)
    first = spark.sparkContext.broadcast(bounds)

    @pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(null_shards + np.searchsorted(first.value, ids.to_numpy(), side="right"))

    shared = facts.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    notes = facts.where("page_id is not null").select("page_id", "digest").join(shared, "digest").where("page_id <> refers_to").distinct()
    notes = notes.select("page_id", F.lit(0).alias("tag"), "digest", "refers_to", none("string").alias("url"), none("string").alias("html"))
    rows = slim.where("page_id is not null").select("page_id", F.lit(1).alias("tag"), none("binary").alias("digest"), none("long").alias("refers_to"), "url", "html")
    order = notes.unionByName(rows).select(shard_of("page_id").alias("shard"), "*")
    if null_shards:  # equal rows are counted, so that they too can be dealt in one way only
        nulls = slim.where("page_id is null").groupBy(sha.alias("digest"), "url").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("n"))
        nulls = nulls.join(shared, "digest", "left").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        shard = F.pmod(F.xxhash64("digest", "url", "nth"), F.lit(null_shards)).cast("int")
        order = order.unionByName(nulls.select(shard.alias("shard"), none("long").alias("page_id"), F.lit(1).alias("tag"), "digest", "refers_to", "url", "html"))
    order = order.repartition("shard").sortWithinPartitions("shard", "page_id", "tag", "html", "url")
    schema = "temporary string, name string, records long, bytes long, first_id long, last_id long, sha256 string"
    committed(order.mapInArrow(lambda it: _written(it, folder, file_bytes, smallest, level, date), schema), folder, format="WARC/1.1", date=date)
    dropped(spark, facts)
    return folder


def _members(stream):
    """The uncompressed bytes of each gzip member, one after the other."""
    z, held, out = zlib.decompressobj(31), b"", []
    while True:
        held = held or stream.read(_READ)
        if not held:
            return
        out.append(z.decompress(held))
        held = b""
        if z.eof:
            held = z.unused_data
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []


def parsed(data: bytes) -> dict:
    """Headers, block and payload of one record; its lengths and block digest are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or hashlib.sha256(block).hexdigest() != headers["warc-block-digest"].removeprefix("sha256:"):
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if headers["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != headers["warc-payload-digest"].removeprefix("sha256:")):
        raise ValueError(f"damaged payload {headers.get('warc-record-id')}")
    return {"headers": headers, "payload": payload, "length": length}


_ROWS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
_FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string())])


@task
def _read(batches, folder, payloads):
    fs, root = filesystem(folder)
    for batch in batches:
        for name in batch.column("name").to_pylist():
            rows, size = [], 0
            with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for data in _members(stream):
                    r = parsed(data)
                    h, response = r["headers"], r["headers"]["warc-type"] == "response"
                    whole = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                    rows.append({"page_id": whole("x-page-id"), "url": h["warc-target-uri"], "payload": r["payload"] if response and payloads else None, "payload_bytes": r["length"], "payload_digest": h["warc-payload-digest"].removeprefix("sha256:"), "record_type": h["warc-type"], "refers_to": whole("x-refers-to-page-id"), "file": name})
                    size += len(data)
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)


def read_warc(spark, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files in the folder's manifest; a revisit has no payload, but its length and digest."""
    rows = [(f["name"],) for f in listed(folder)["files"]]
    return file_rows(spark, rows, "name string").mapInArrow(lambda it: _read(it, folder, payloads), _ROWS)
