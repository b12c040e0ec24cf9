import io
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsmith.functions.embed import embedded
from vecsmith.operators.collection import Collections
from vecsmith.plans.ingest import ingest, text_search
from vecsmith.sources import documents as S
from vecsmith.sources import vectors as V
from vecsmith.sources.stores import MetadataStore
from vecsmith.streaming.ingest import stream_into, stream_search


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("alpha beta gamma\nsecond line", encoding="utf-8")
    (tmp_path / "in/b.md").write_text("你好 世界", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "in/c.docx", "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "in/bad.docx").write_bytes(b"no zip")
    (tmp_path / "in/e.exe").write_bytes(b"MZ")
    with wave.open(str(tmp_path / "in/w.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes((np.sin(np.arange(8000) / 10) * 20000).astype("<i2").tobytes())
    return tmp_path


def test_readers(spark, folder):
    files = S.files(spark, f"{folder}/in")
    good, bad = S.accepted_files(files)
    assert bad.count() == 1 and good.count() == 5
    text = {r.file_name: r for r in S.text_metadata(S.decoded_text(good)).collect()}
    assert text["a.txt"].word_count == 5 and text["b.md"].text == "你好 世界" and text["c.docx"].text == "one\ntwo"
    assert text["bad.docx"].text is None and "BadZip" in text["bad.docx"].error
    sound = S.audio(good).select("audio.*").first()
    assert sound.num_samples == 8000 and sound.duration == 1.0 and sound.error is None
    assert len(S.audio(good).select(embedded(F.col("audio.samples"), "spectral-audio").alias("v")).first().v) == 128


def test_frames(spark, folder):
    (folder / "in/v.mp4").write_bytes(bytes(range(30)))
    S.register_frame_decoder(lambda c: ([c[i : i + 10] for i in range(0, len(c), 10)], 20.0, 10, 1))
    rows = S.frames(S.files(spark, f"{folder}/in"), most=2).collect()
    assert [r.frame for r in sorted(rows)] == [0, 1] and rows[0].total_frames == 3


def test_vector_files(spark, tmp_path):
    x = np.random.default_rng(0).random((5, 3)).astype("<f4")
    rec = lambda a: b"".join(np.int32(3).tobytes() + r.tobytes() for r in a)
    (tmp_path / "x.fvecs").write_bytes(rec(x))
    (tmp_path / "x.ivecs").write_bytes(rec(np.arange(15, dtype="<i4").reshape(5, 3)))
    (tmp_path / "x.dump").write_bytes(V.dumped(x))
    for got in (V.read_fvecs(spark, f"{tmp_path}/x.fvecs"), V.read_dump(spark, f"{tmp_path}/x.dump")):
        assert np.allclose([r.vector for r in got.orderBy("seq").collect()], x)
    assert V.read_ivecs(spark, f"{tmp_path}/x.ivecs").orderBy("seq").first().vector == [0, 1, 2]
    (tmp_path / "y.dump").write_bytes(V.dumped(x)[:-1])
    with pytest.raises(Exception, match="expected"):
        V.read_dump(spark, f"{tmp_path}/y.dump").collect()
    V.write_dump(V.read_dump(spark, f"{tmp_path}/x.dump"), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("n")).first()[0] == 5
    assert io.BytesIO is not None


def test_ingest(spark, folder):
    c, m = Collections(spark, f"file://{folder}/store"), MetadataStore(spark, f"file://{folder}/meta")
    status = {r.path.rsplit("/", 1)[1]: r.status for r in ingest(spark, f"{folder}/in", c, m, "docs").collect()}
    assert status == {"a.txt": "ok", "b.md": "ok", "c.docx": "ok", "bad.docx": "error", "e.exe": "error", "w.wav": "error"}
    asked = spark.createDataFrame([(1, "alpha beta gamma second line")], "query_id long, text string")
    hit = text_search(c, m, "docs", asked, 1).first()
    assert hit.file_name == "a.txt" and hit.score < 1e-6 and hit.timestamp is not None and hit.chunk_id.endswith("_chunk_0")


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([("f1", "alpha beta"), ("f2", "gamma")], "file_id string, text string").write.parquet(str(src))
    c = Collections(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        stream_into(spark.readStream.schema("file_id string, text string").parquet(str(src)), c, "s", f"{tmp_path}/cp").awaitTermination()
    assert c.count("s") == 2
    base = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "vec_id long, embedding array<float>")
    base.where("vec_id = 3").write.parquet(f"{tmp_path}/q")
    got = []
    stream_search(spark.readStream.schema(base.schema).parquet(f"{tmp_path}/q"), base, lambda df, n: got.extend(df.collect()), f"{tmp_path}/cp2", k=2).awaitTermination()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [3, 2]


def test_jdbc_table(spark, tmp_path):
    """A table of an embedded database, file contents among its columns."""
    from vecsmith.sources.stores import JdbcTable

    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    except Exception:
        pytest.skip("no embedded database here")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    t = JdbcTable(spark, url, "FILES", "ID", driver="org.apache.derby.jdbc.EmbeddedDriver", createTableColumnTypes="ID VARCHAR(64), KIND VARCHAR(16)")
    t.put(spark.createDataFrame([("a", "txt", bytearray(b"one"), 3), ("b", "md", bytearray(b"two"), 4)], "ID string, KIND string, CONTENT binary, SIZE long"))
    assert t.rows().count() == 2 and bytes(t.get("a").first().CONTENT) == b"one"
    assert t.update("a", KIND="md", SIZE=9) and not t.update("x", KIND="md") and not t.update("a")
    assert t.search({"KIND": "md", "SIZE": 9}).first().ID == "a" and t.update("b", KIND=None)
    assert t.search({"KIND": None}).first().ID == "b" and t.search({"KIND": None}, null_safe=False).count() == 0 and t.search().count() == 2
    with pytest.raises(ValueError):
        t.update("a", **{"KIND = 1 --": "x"})
    assert t.delete("a") and not t.delete("a") and t.rows().count() == 1


def test_images_and_videos(spark, folder):
    df = spark.createDataFrame([("a", bytearray([1, 2, 3, 4, 5, 6]), "RGB"), ("b", bytearray([9, 200]), "L"), ("c", bytearray([1, 2, 3, 255]), "RGBA"), ("d", None, None)], "path string, pixels binary, mode string")
    got = {r.path: r for r in S.as_rgb(df).withColumn("v", embedded(F.col("pixels"), "colour-image")).collect()}
    assert [list(got[k].pixels) for k in "abc"] == [[3, 2, 1, 6, 5, 4], [9, 9, 9, 200, 200, 200], [3, 2, 1]] and got["d"].pixels is None
    assert len(got["a"].v) == 512 and got["a"].v[0] == 1.0 and np.isclose(got["b"].v[0], 2**-0.5) and set(got["d"].v) == {0.0}
    (folder / "in/v.mp4").write_bytes(bytes(range(120)))
    S.register_frame_decoder(lambda c: ([c[i : i + 10] for i in range(0, len(c), 10)], 20.0, 10, 1))
    (row,) = S.video_vectors(S.files(spark, f"{folder}/in")).collect()
    from vecsmith.functions.embed import hashed_bytes

    import pandas as pd

    want = np.mean([np.float32(v) for v in hashed_bytes(pd.Series([bytes(range(i, i + 10)) for i in range(0, 100, 10)]))], axis=0)
    assert np.allclose(row.mean_vector, want, atol=1e-6)


def test_cepstra():
    """A tone's energy lies in the band around it; loudness moves the first coefficient alone."""
    import pandas as pd

    from vecsmith.functions.embed import mel_cepstra, mel_filters

    filters = mel_filters(22_050, 2048, 128)
    assert filters.shape == (128, 1025) and (filters.sum(axis=1) > 0).sum() >= 110
    tone = np.sin(2 * np.pi * 1000 * np.arange(22_050) / 22_050)
    quiet, loud, none = mel_cepstra(pd.Series([tone, tone * 10, np.array([])]))
    assert np.allclose(quiet[1:], loud[1:], atol=1e-2) and np.isclose(loud[0] - quiet[0], 20 * np.sqrt(128), rtol=1e-3) and not none.any()
    basis = np.cos(np.pi * np.arange(128)[:, None] * (2 * np.arange(128)[None, :] + 1) / 256) * np.sqrt(2 / 128)
    basis[0] /= np.sqrt(2)
    bands = basis.T @ quiet
    centres = filters.argmax(axis=1) * 22_050 / 2048
    assert abs(centres[bands.argmax()] - 1000) < 60


def test_dumps_in_parts(spark, tmp_path):
    x = np.random.default_rng(0).random((50, 3)).astype("<f4")
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "seq long, vector array<float>").repartition(3)
    V.write_dump(df, f"{tmp_path}/out", rows=7)
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("part").collect()
    assert max(r.n for r in rows) == 7 and np.allclose(np.concatenate([V._dump(bytes(r.dump)) for r in rows]), x)
