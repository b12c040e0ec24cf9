"""Every query with SQL gives the SQL's rows; approximate searches reach their recall."""

import pytest

from tests.conftest import DATA
from vecsmith.queries import ORACLES, QUERIES


def rows(frame, columns):
    return sorted(map(repr, frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want.astype(got.dtypes.to_dict()), columns)


@pytest.mark.parametrize("name", ["ivf_trained", "pq_reranked", "lsh_search", "annoy_search", "hnsw_search"])
def test_recall(spark, name):
    pairs = lambda n: {(r.query_id, r.vec_id) for r in QUERIES[n](spark, DATA).collect()}
    truth = pairs("flat_l2_topk")
    assert len(pairs(name) & truth) >= 0.9 * len(truth)


@pytest.mark.parametrize("name", ["pq_reranked", "lsh_search", "hnsw_search"])
def test_recall_larger(spark, name):
    larger = "/root/testdata/sf0.1"
    pairs = lambda n: {(r.query_id, r.vec_id) for r in QUERIES[n](spark, larger).collect()}
    truth = pairs("flat_l2_topk")
    assert len(pairs(name) & truth) >= 0.9 * len(truth)


def test_graphs_grow(spark, monkeypatch):
    """Graphs are bounded: a table of more rows has more of them."""
    from vecsmith import queries

    made = []

    class Small(queries.ProximityGraphs):
        def __init__(self, *args, **options):
            super().__init__(*args, **options | {"rows": 50})

        def fit(self, *args, **options):
            made.append(super().fit(*args, **options))
            return made[-1]

    monkeypatch.setattr(queries, "ProximityGraphs", Small)
    queries.hnsw_search(spark, DATA)
    assert made[0].graphs.count() == 10


def test_text_knn_by_hand(spark):
    """Word by word in plain Python."""
    import zlib

    import numpy as np

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids, x = sorted(docs), np.zeros((len(docs), 384))
    for i, d in enumerate(ids):
        for w in docs[d].split():
            h = zlib.crc32(w.encode())
            x[i, h % 384] += 1 if h >> 31 else -1
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    got = QUERIES["text_knn"](spark, DATA).toPandas()
    assert set(got.query_id) == {d for d in ids if d % 20 == 0 and norm[ids.index(d)] > 0}
    for q, own in got.groupby("query_id"):
        score = np.where(norm[:, 0] > 0, x @ x[ids.index(q)], -2)
        own = own.sort_values("rank")
        assert np.allclose(own.score, np.sort(score)[::-1][: len(own)], atol=1e-5) and np.allclose([score[ids.index(v)] for v in own.vec_id], own.score, atol=1e-5)


def test_text_queries(spark):
    assert QUERIES["text_knn"](spark, DATA).where("rank = 1 and abs(score - 1) > 1e-6").count() == 0
    assert QUERIES["process_documents"](spark, DATA).where("n_chunks < 1").count() == 0


def test_entry_without_llm(tmp_path):
    """With the subpackage, its tests and the pipeline deleted, the rest imports, lists its queries and runs one."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    left = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "*.txt", "*.md")
    shutil.copytree(top, tmp_path / "repo", ignore=left)
    code = "import sys, __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n[:2] == 'op' or n == 'pipeline'] and set(e.oracle_sql()) <= set(q); assert 'vecsmith.llm' not in sys.modules; print(len(q))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[-1]) == len(QUERIES)
    others = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "repo") for f in names if f.endswith(".py")]
    assert not [f for f in others if "vecsmith.llm" in open(f, encoding="utf-8").read() and not f.endswith(("__spark_entry__.py", "test_queries.py"))]
