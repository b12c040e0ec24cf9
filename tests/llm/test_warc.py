import gzip
import hashlib

import pytest

from vecsmith.llm.common import filesystem
from vecsmith.llm.files import listed
from vecsmith.llm.warc import read_warc, write_warc

SCHEMA = "page_id long, url string, html string"
BIG = "<p>" + "x" * 200


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<html>{i}" + "y" * (i % 150)) for i in range(300)]
    rows += [(400 - i, "http://d/ \r\nx", BIG) for i in range(9)] + [(900, None, None), (901, "u", ""), (902, "u", "é" * 120), (903, "u", "é" * 120), (904, "u", "short"), (905, "u", "short"), (902, "u2", "é" * 120), (None, "u", BIG), (None, "u", "z" * 101), (None, "u", "z" * 101), (906, "u", "long " * 400_000)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6), rows


def test_round_trip(spark, pages):
    df, rows = pages
    folder = write_warc(df, file_bytes=2000)
    got = read_warc(spark, folder).collect()
    assert len(got) == len(rows)
    first = {}
    for page, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 100 and page is not None:
            first[p] = min(first.get(p, page), page)
    want = sorted((-1 if page is None else page, len((html or "").encode()), hashlib.sha256((html or "").encode()).hexdigest()) for page, _, html in rows)
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    by_digest = {hashlib.sha256(p).hexdigest(): i for p, i in first.items()}
    seen = set()
    for r in got:
        least = by_digest.get(r.payload_digest)
        if r.record_type == "revisit":
            assert r.refers_to == least and r.payload is None and r.payload_bytes >= 100
        else:
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and r.refers_to is None
            assert least is None or r.page_id == least and r.payload_digest not in seen
            seen.add(r.payload_digest)
    assert sum(r.record_type == "revisit" for r in got) == 8 + 2 + 1  # copies of BIG and its row without id; 903 and the second 902


def test_files(spark, pages):
    df, _ = pages
    names = []
    for _ in range(2):
        folder = write_warc(df.repartition(3), file_bytes=2000)
        files = listed(folder)["files"]
        names.append([(f["name"], f["sha256"]) for f in files])
        fs, root = filesystem(folder)
        with fs.open_input_stream(f"{root}/{files[0]['name']}", compression=None) as f:
            data = f.read()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n") and hashlib.sha256(data).hexdigest() == files[0]["sha256"]
        ids = [(f["first_id"], f["last_id"]) for f in files if f["first_id"] is not None]
        assert all(a[1] <= b[0] for a, b in zip(ids, ids[1:], strict=False)) and max(f["bytes"] for f in files if f["records"] > 1) <= 2000
        assert len(files) > 10
    assert names[0] == names[1]


def test_same_files(spark):
    """Equal names and bytes in one session, on more rows than a range partitioner samples, however rows are dealt."""
    from pyspark.sql import functions as F

    body = F.concat(F.lit("<p>"), F.repeat(F.sha1(F.col("id").cast("string")), (F.col("id") % 7).cast("int")))
    page = F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 9 == 0, F.col("id") - 9).otherwise(F.col("id") * 3)
    rows = spark.range(50_000).select(page.alias("page_id"), F.concat(F.lit("http://h/"), F.col("id") % 1000).alias("url"), body.alias("html"))
    runs = []
    for n in (3, 8):
        folder = write_warc(rows.orderBy(F.rand(n)).repartition(n), file_bytes=30_000)
        files = listed(folder)["files"]
        assert sum(f["records"] for f in files) == 50_000
        runs.append([(f["name"], f["sha256"], f["records"], f["first_id"], f["last_id"]) for f in files])
    assert runs[0] == runs[1] and len(runs[0]) > 64


def test_empty_and_clashing(spark, pages):
    from pyspark.sql import functions as F

    assert read_warc(spark, write_warc(spark.createDataFrame([], SCHEMA))).count() == 0
    df, rows = pages
    assert read_warc(spark, write_warc(df.withColumns({"tag": F.lit(1), "digest": F.lit("x"), "refers_to": F.lit(3)}))).count() == len(rows)
