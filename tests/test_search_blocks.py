"""Queries in several blocks, repeated query ids, and scratch tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsmith.operators import scratch
from vecsmith.operators.search import HITS, in_blocks, knn, ranked
from vecsmith.operators.trees import PrunedCells

SCHEMA = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(1).random((90, 6), dtype=np.float32)
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], SCHEMA).repartition(3)


def want(x, q, k):
    d = ((x.astype(float) - q.astype(float)) ** 2).sum(axis=1)
    return np.argsort(d, kind="stable")[:k].tolist()


@pytest.mark.parametrize("block", [1, 7, 30, 1000])
def test_blocks(data, block):
    x, df = data
    got = knn(df, df.where("vec_id < 30"), 4, query_block=block).toPandas()
    for q in range(30):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == want(x, x[q], 4)
    assert len(got) == 120


def test_repeated_queries(spark, data):
    """Two vectors under one id are two queries, in one block or in several."""
    x, df = data
    asked = spark.createDataFrame([(5, x[1].tolist()), (5, x[2].tolist()), (6, x[3].tolist())], SCHEMA)
    for block in (1, 2, 10):
        got = knn(df, asked, 3, query_block=block).toPandas()
        assert sorted(got[got.query_id == 5].vec_id) == sorted(want(x, x[1], 3) + want(x, x[2], 3))
        assert got[got.query_id == 6].sort_values("rank").vec_id.tolist() == want(x, x[3], 3)


def test_plan_does_not_grow(data):
    """One scan of the stored results, however many blocks there are."""
    _, df = data
    plan = knn(df, df, 2, query_block=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") == 1


@pytest.mark.parametrize("kind", ["kd", "ball"])
def test_cells_in_blocks(data, kind, monkeypatch):
    from vecsmith.operators import trees

    x, df = data
    monkeypatch.setattr(trees, "in_blocks", lambda *a: in_blocks(*a[:-1], 11))
    got = PrunedCells(kind, leaf=5).fit(df).search(df, 3).toPandas()
    for q in range(90):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == want(x, x[q], 3)


def test_scratch(spark, data):
    _, df = data
    with scratch.scratch_removed(spark) as keep:
        a, b = scratch.stored(df, "a"), scratch.stored(df, "b")
        parts = scratch.stored_parts(spark, [df.where("vec_id < 5"), df.where("vec_id >= 80")], df.schema)
        assert parts.count() == 15
        keep.append(b.where("vec_id > 3").select(F.col("vec_id")))
    assert b.count() == 90
    with pytest.raises(Exception):  # noqa: B017
        a.count()
    scratch.dropped(spark, b)
    with pytest.raises(Exception):  # noqa: B017
        b.count()


def test_empty(spark, data):
    _, df = data
    none = spark.createDataFrame([], SCHEMA)
    assert knn(df, none).count() == 0 and knn(none, df).count() == 0
    assert knn(df, none).columns == ["query_id", "rank", "vec_id", "score"]
    assert in_blocks(df, none.selectExpr("vec_id as query_id", "embedding as q"), lambda it, b: it, HITS, ranked(1)).count() == 0
