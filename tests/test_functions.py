import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsmith.functions import distance as D
from vecsmith.functions import media, secure
from vecsmith.functions import text as T


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), rng.normal(size=8).astype(np.float32).tolist()) for i in range(20)]
    return spark.createDataFrame(rows, "id int, a array<float>, b array<float>"), rows


def test_distances(pairs):
    df, rows = pairs
    got = df.select("id", *[f("a", "b").alias(n) for n, f in (("l2", D.l2_squared), ("ip", D.inner_product), ("cos", D.cosine), ("ang", D.angular), ("l2n", D.l2_by_norms))]).collect()
    for r, (_, a, b) in zip(sorted(got), rows, strict=True):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        cos = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
        assert np.allclose([r.l2, r.ip, r.cos, r.ang, r.l2n], [((a - b) ** 2).sum(), a @ b, cos, np.sqrt(2 * (1 - cos)), ((a - b) ** 2).sum()])


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(D.cosine("a", "b").alias("c"), D.normalized("a").alias("n"), D.normalized("b").alias("m")).first()
    assert r.c is None and r.n == [0.0, 0.0] and r.m == [1.0, 0.0]


def test_hamming(spark):
    r = spark.createDataFrame([(-1, 0), (5, 6)], "a int, b int").select(D.hamming("a", "b").alias("d")).collect()
    assert [x.d for x in r] == [32, 2]


def test_metric_names():
    with pytest.raises(ValueError):
        D.metric("l7")


def test_text(spark):
    df = spark.createDataFrame([("  This is a  test  text  ",), ("",), (None,), (" " * 1000,), ("a　b c\x1cd",)], "t string")
    r = df.select(T.cleaned(F.coalesce("t", F.lit(""))).alias("c"), T.word_count(F.col("t")).alias("n"), T.chunks(F.col("t")).alias("k"), T.stripped(F.col("t")).alias("s")).collect()
    assert [x.c for x in r] == ["This is a test text", "", "", "", "a b c d"]
    assert [x.n for x in r] == [5, 0, 0, 0, 4]
    assert [x.k for x in r][1:4] == [[""], [""], [""]]
    assert r[0].s == "This is a  test  text"


def test_chunks(spark):
    df = spark.createDataFrame([(" ".join(map(str, range(250))),)], "t string")
    k = df.select(T.chunks(F.col("t")).alias("k")).first().k
    assert [len(x.split()) for x in k] == [100, 100, 50] and k[2].split()[-1] == "249"


def test_files(spark):
    df = spark.createDataFrame([("/a/b/x.PDF",), ("../../etc/..passwd",), ("dir.d/none",)], "p string")
    r = df.select(T.extension(F.col("p")).alias("e"), T.modality(T.extension(F.col("p"))).alias("m"), T.safe_name(F.col("p")).alias("s")).collect()
    assert [(x.e, x.m, x.s) for x in r] == [("pdf", "text", "x.PDF"), ("passwd", None, "passwd"), ("", None, "none")]
    with pytest.raises(Exception, match="unsupported"):
        df.select(T.accepted(T.extension(F.col("p")))).collect()


def test_secrets(spark):
    df = spark.createDataFrame([("short",), ("exactly12chr",), ("vdb_0123456789abcdef",)], "k string")
    r = df.select(secure.masked(F.col("k")).alias("m"), secure.decrypted(secure.encrypted(F.col("k"), "p"), "p").alias("d"), F.col("k")).collect()
    assert [x.m for x in r] == ["shor*", "exac********", "vdb_0123********cdef"]
    assert all(x.d == x.k for x in r)


def test_media(spark):
    df = spark.createDataFrame([([1.0, -4.0, 2.0], 1), ([0.0, 0.0], 1)], "s array<double>, rate int")
    r = df.select(media.peak_normalized(F.col("s")).alias("n"), media.segments(F.col("s"), F.col("rate"), 2).alias("g")).collect()
    assert r[0].n == [0.25, -1.0, 0.5] and r[1].n == [0.0, 0.0]
    assert r[0].g == [[1.0, -4.0], [2.0]]
