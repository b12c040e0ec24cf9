"""Boundaries of every index kind, and agreement of the exact ones with numpy."""

import numpy as np
import pytest

from vecsmith.operators import evaluate
from vecsmith.operators.search import nearest
from vecsmith.plans.index import KINDS, create_index

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(x.astype(np.float32))], SCHEMA)


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(42).random((120, 16), dtype=np.float32)
    return x, frame(spark, x)


def options(kind):
    return {"ivf": {"nlist": 4, "nprobe": 4, "iterations": 3}, "pq": {"parts": 4, "bits": 4}, "lsh": {"tables": 4}, "annoy": {"depth": 2}}.get(kind, {})


@pytest.mark.parametrize("kind", KINDS)
def test_search(spark, data, kind):
    x, df = data
    index = create_index(kind, 16, **options(kind)).train(df).add(df)
    got = index.search(df.where("vec_id < 5"), 5).toPandas()
    assert (got.groupby("query_id")["rank"].apply(list).apply(lambda r: r == list(range(1, len(r) + 1)))).all()
    ordered = got.sort_values(["query_id", "rank"]).groupby("query_id").score
    assert all((s.is_monotonic_decreasing if kind == "flat_ip" else s.is_monotonic_increasing) for _, s in ordered)
    if kind in ("flat_l2", "ivf", "kdtree", "balltree"):
        d = ((x[:5, None, :].astype(float) - x[None].astype(float)) ** 2).sum(axis=2)
        for q, g in got.groupby("query_id"):
            assert g.sort_values("rank").vec_id.tolist() == np.argsort(d[q], kind="stable")[:5].tolist()
    if kind not in ("flat_ip", "pq"):
        first = got[got["rank"] == 1]
        assert (first.vec_id == first.query_id).all() and (first.score < 1e-6).all()


def test_boundaries(spark, data):
    x, df = data
    index = create_index("flat_l2", 16)
    with pytest.raises(RuntimeError):
        index.search(df, 3)
    index.add(df.where("vec_id < 5"))
    assert index.search(df.where("vec_id = 0"), 10).count() == 5
    assert index.search(df.where("vec_id < 0"), 10).count() == 0
    index.add(df.where("vec_id >= 5"))
    assert index.size == 120
    other = frame(spark, np.zeros((1, 3)))
    for call in (lambda: index.add(other), lambda: index.search(other, 1)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError):
        index.search(df, 0)
    with pytest.raises(TypeError):
        index.set_nprobe(3)
    with pytest.raises(ValueError):
        create_index("nope", 3)
    with pytest.raises(ValueError):
        create_index("ivf", 16, nlist=500).train(df)
    with pytest.raises(RuntimeError):
        create_index("ivf", 16).add(df).search(df, 1)


def test_one_query(data):
    x, df = data
    got = nearest(df, x[7].tolist(), 3).collect()
    assert got[0].vec_id == 7 and got[0].score < 1e-9 and len(got) == 3


def test_ties(spark):
    df = frame(spark, np.ones((9, 4)))
    got = create_index("flat_l2", 4).add(df).search(df.where("vec_id = 3"), 4).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3]


def test_quality(spark):
    truth = spark.createDataFrame([(1, i, i) for i in range(1, 5)] + [(2, 1, 9)], "query_id long, rank int, vec_id long")
    got = spark.createDataFrame([(1, 1, 1), (1, 2, 7), (1, 3, 2), (1, 4, 8)], "query_id long, rank int, vec_id long")
    one = {r.query_id: r for r in evaluate.per_query(got, truth, 4).collect()}
    ideal = sum(1 / np.log2(i + 1) for i in range(1, 5))
    assert one[1].recall == 0.5 and one[1].precision == 0.5 and np.isclose(one[1].ndcg, (1 + 1 / np.log2(4)) / ideal)
    assert one[2].recall == 0 and one[2].ndcg == 0
    s = evaluate.summary(got, truth, 4).first()
    assert np.isclose(s.recall, 0.25) and np.isclose(s.f1, 0.25)


@pytest.mark.parametrize("symmetric", [False, True])
def test_pq_reranks_all(spark, symmetric):
    """Coarse codes over more rows than a task takes at once: the exact scan's rows all the same."""
    x = np.random.default_rng(3).standard_normal((6000, 8)).astype(np.float32)
    x[4000:4020] = x[0]
    df = frame(spark, x).repartition(2)
    asked = df.where("vec_id % 300 = 0")
    index = create_index("pq", 8, parts=2, bits=2).train(df).add(df)
    got = index.search(asked, 5, symmetric=symmetric, rerank=True, base=df).toPandas()
    for q, g in got.groupby("query_id"):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        assert g.sort_values("rank").vec_id.tolist() == np.argsort(d, kind="stable")[:5].tolist()
    assert len(got) == 5 * 20


@pytest.mark.parametrize("probes", [0, 2])
def test_lsh_ranks_all_candidates(spark, probes):
    """All rows that share a band are ranked, and for queries with few of them those at one bit of a first band."""
    x = np.random.default_rng(5).standard_normal((3000, 8)).astype(np.float32)
    df = frame(spark, x).repartition(2)
    index = create_index("lsh", 8).add(df)
    got = index.search(df.where("vec_id % 100 = 0"), 60, probes=probes).toPandas()
    bands = index.method.codes_of(x.astype(float)).astype("<i4").view(np.uint8)
    few = 0
    for q in range(0, 3000, 100):
        apart = np.bitwise_count(bands ^ bands[q])
        may = (apart <= probes).any(axis=1)
        if may.sum() < 60:
            few += 1
            may |= apart[:, 0] <= 1
        d = np.where(may, ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1), np.inf)
        want = np.argsort(d, kind="stable")[: min(60, may.sum())].tolist()
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == want
    assert probes or 0 < few < 30


def test_copies_in_samples(spark):
    """Copies of the vector that hashes lowest do not fill the training samples."""
    from vecsmith.operators.pq import ProductQuantizer
    from vecsmith.operators.trees import PlaneForest, PrunedCells

    x = np.random.default_rng(9).standard_normal((300, 8)).astype(np.float32)
    low = frame(spark, x).selectExpr("vec_id", "xxhash64(embedding, 42) as h").orderBy("h").first().vec_id
    df = frame(spark, np.concatenate([x, np.repeat(x[low : low + 1], 150, axis=0)]))
    assert len(np.unique(ProductQuantizer(2, 3, sample=100).fit(df).codebooks[0], axis=0)) == 8
    assert PrunedCells("kd", leaf=10, sample=100).fit(df).cells > 1
    forest = PlaneForest(4, 4, sample=100).fit(df)
    cut = np.einsum("tkd,d->tk", forest.planes, x[low].astype(float))
    assert not np.allclose(cut, forest.offsets)


def test_async(data):
    x, df = data
    index = create_index("ivf", 16, nlist=4, nprobe=4, iterations=2)
    index.train_async(df).result()
    index.add_async(df).result()
    found = [index.search_async(df.where(f"vec_id = {i}"), 1) for i in range(3)]
    assert [f.result().first().vec_id for f in found] == [0, 1, 2]
