"""Inverted cells: searches in blocks give what a join of all queries with the rows of their cells gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vecsmith.functions.distance import metric as metric_of
from vecsmith.operators import ivf
from vecsmith.operators import search as search_module
from vecsmith.operators.collection import Collections
from vecsmith.operators.ivf import InvertedCells
from vecsmith.operators.search import Block, in_blocks, top_k

SCHEMA = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(2).normal(size=(160, 6)).astype(np.float32)
    x[40:70] = x[3]  # copies, more than k
    x[70:80] = 2 * x[3]
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    rows += [(200, [0.0] * 6), (201, [float("nan")] + [1.0] * 5), (202, [None] + [1.0] * 5), (203, [float("inf")] + [1.0] * 5), (204, [1e30] * 6), (205, None)]
    return x, spark.createDataFrame(rows, SCHEMA).repartition(3)


def joined(index, assigned, asked, k):
    kind = metric_of(index.metric)
    pairs = index.probes(asked).join(assigned, "list_id")
    if index.metric == "angular":  # a vector without a direction has no angle, as in the exact scan
        pairs = pairs.where(metric_of("cosine").expression("vector", "q").isNotNull())
    pairs = pairs.select("query_id", "vec_id", kind.expression("vector", "q").alias("score"))
    return sorted(top_k(pairs.where("score is not null and not isnan(score)"), k, kind.ascending).select("query_id", "rank", "vec_id", "score").collect())


def flat(rows):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "angular"])
@pytest.mark.parametrize(("nprobe", "block", "pieces"), [(5, 1000, 1024), (2, 1000, 7), (2, 50, 1024), (1, 1000, 3)])
def test_as_joined(data, monkeypatch, metric, nprobe, block, pieces):
    x, df = data
    monkeypatch.setattr(ivf, "in_blocks", lambda *a, **o: in_blocks(*a, **o, query_block=block))
    monkeypatch.setattr(ivf, "_ROWS", pieces)
    index = InvertedCells(5, nprobe, centroids=x[:5].astype(float), metric=metric)
    assigned = index.assign(df).cache()
    want = [tuple(r) for r in joined(index, assigned, df, 6)]
    got = flat(index.search(assigned, df, 6).collect())
    assigned.unpersist()
    assert [r[:3] for r in got] == [r[:3] for r in want]
    np.testing.assert_allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12, atol=1e-12)


def test_repeated_ids_share(spark, data):
    """Rows of one query id share its k rows, as in the SQL, in one block or in several."""
    x, df = data
    asked = spark.createDataFrame([(5, x[1].tolist()), (5, x[2].tolist()), (6, x[90].tolist())], SCHEMA)
    index = InvertedCells(5, 5, centroids=x[:5].astype(float))
    assigned = index.assign(df)
    want = [tuple(r) for r in joined(index, assigned, asked, 3)]
    assert flat(index.search(assigned, asked, 3).collect()) == want
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ivf, "in_blocks", lambda *a, **o: in_blocks(*a, **o, query_block=1))
        assert flat(index.search(assigned, asked, 3).collect()) == want


def test_no_pairs(data):
    """Vectors of a query and a row are never joined: what leaves a task is at most k rows a query."""
    x, df = data
    index = InvertedCells(5, 5, centroids=x[:5].astype(float))
    found = index.search(index.assign(df), df, 4)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_nearer_cells_later(monkeypatch, metric):
    """Where each cell is nearer than those before it, at most 2 k of a cell's rows a query are scored exactly, not all."""
    k, n, x = 3, 200, np.random.default_rng(5).normal(size=(800, 4))
    x += 40.0 * (3 - np.arange(800) // n)[:, None] * (1 if metric == "l2" else -1)
    queries = np.random.default_rng(6).normal(size=(30, 4)) + (0 if metric == "l2" else 40)
    scored, exact = [], ivf._exact
    monkeypatch.setattr(ivf, "_exact", lambda rows, *a: scored.append(len(rows)) or exact(rows, *a))
    batch = pd.DataFrame({"vec_id": np.arange(800), "vector": list(x), "list_id": np.arange(800) // n})
    found = pd.concat(ivf._answers([batch], Block(np.arange(30), np.arange(30), queries), np.tile(np.arange(4), (30, 1)), 4, k, metric))
    score = ((x[None] - queries[:, None]) ** 2).sum(axis=2) if metric == "l2" else -queries @ x.T
    assert found.groupby("query_id")["vec_id"].apply(list).tolist() == np.argsort(score, axis=1)[:, :k].tolist()
    assert sum(scored) <= 2 * k * 4 * 30


def test_stored_once(data, monkeypatch):
    """Several blocks of queries read rows that were placed once."""
    x, df = data
    names, real = [], search_module.stored
    monkeypatch.setattr(search_module, "stored", lambda table, name="table", **o: names.append(name) or real(table, name, **o))
    monkeypatch.setattr(ivf, "in_blocks", lambda *a, **o: in_blocks(*a, **o, query_block=50))
    index = InvertedCells(5, 2, centroids=x[:5].astype(float))
    index.search(index.assign(df), df, 4)
    assert names == ["queries", "rows"]
    names.clear()
    index.search(index.assign(df), df, 4, written=True)
    assert names == ["queries"]


def test_placed_once(data):
    """A condition on the cells that a block reaches does not work out a row's cell again."""
    x, df = data
    index = InvertedCells(5, 1, centroids=x[:5].astype(float))
    found = index.search(index.assign(df), df.where("vec_id = 100"), 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "list_id" in plan and plan.count("ArrowEvalPython") == 1
    assert [r.vec_id for r in found.where("rank = 1").collect()] == [100]


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_collection(spark, data, tmp_path, metric):
    """Collections search their cells so too, and read those that a block's queries probe."""
    x, _ = data
    kept = Collections(spark, f"file://{tmp_path}")
    kept.create("v", 6, metric)
    kept.insert("v", spark.createDataFrame([(r.tolist(),) for r in x], "vector array<float>"))
    kept.optimize("v", 4, nprobe=1)
    found = kept.search("v", spark.createDataFrame([(1, x[100].tolist())], "query_id long, q array<float>"), 5)
    plan = found._jdf.queryExecution()
    assert "list_id" in [s for s in plan.executedPlan().toString().split("PartitionFilters: [") if "list_id" in s.split("]")[0]][0]
    assert "zip_with" not in plan.optimizedPlan().toString().lower()
    m = kept._manifest("v")
    cells = spark.read.parquet(f"{tmp_path}/v/{m['parts'][0]}").select(F.col("seq").alias("vec_id"), "vector", "list_id")
    asked = spark.createDataFrame([(1, x[100].tolist())], SCHEMA)
    want = joined(kept._cells(m), cells, asked, 5)
    got = sorted((r["rank"], r.score) for r in found.collect())
    assert [r[0] for r in got] == [r[1] for r in want]
    np.testing.assert_allclose([r[1] for r in got], [r[3] for r in want], rtol=1e-12)


@pytest.mark.parametrize("name", ["collection_ip_search", "collection_l2_search", "ivf_full_probe", "ivf_search", "ivf_trained"])
def test_query_without_pairs(spark, name):
    """No query is joined with the rows of its cells, so that work does not go through a row for each pair."""
    from vecsmith.queries import QUERIES

    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan.lower()
    assert plan.count("ArrowEvalPython") <= 1  # rows are placed once
    assert found.count() == 250
