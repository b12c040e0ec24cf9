import pytest
from pyspark.sql import functions as F

from vecsmith.operators.collection import Collections
from vecsmith.sources.stores import FileStore, MetadataStore, Snapshots


@pytest.fixture()
def root(tmp_path):
    return f"file://{tmp_path}"


def vectors(spark, n, dim=4):
    return spark.range(n).select(F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.col("id") * i).cast("float")).alias("vector"), F.create_map(F.lit("n"), F.col("id").cast("string")).alias("metadata"))


def test_life(spark, root):
    c = Collections(spark, root)
    assert c.create("a", 4) and not c.create("a", 4) and c.names() == ["a"]
    with pytest.raises(KeyError):
        c.insert("b", vectors(spark, 1))
    first = c.insert("a", vectors(spark, 10))
    assert first.count() == 10
    c.insert("a", vectors(spark, 10), batch_size=3)
    assert sorted(r.seq for r in c.rows("a").collect()) == list(range(20))
    assert c.count("a") == 20 and c.dimension("a") == 4
    asked = spark.createDataFrame([(1, [3.0, 6.0, 9.0, 12.0])], "query_id long, q array<float>")
    got = c.search("a", asked, 2).orderBy("rank").collect()
    assert [r.metadata["n"] for r in got] == ["3", "3"] and got[0].score == 0
    assert c.search("a", asked, 3, {"n": "9"}).count() == 0
    assert c.search("a", asked, 3, {"n": "9"}, mode="pre").count() == 2
    one = got[0].vec_id
    new = spark.createDataFrame([(one, [0.5] * 4, {"m": "x"})], "vec_id string, vector array<float>, metadata map<string,string>")
    assert c.modify("a", new) and c.get("a", one).first().metadata == {"m": "x"}
    assert c.modify("a", new.withColumn("metadata", F.create_map(F.lit("k"), F.lit("y"))).withColumn("vector", F.lit(None)), merge=True)
    r = c.get("a", one).first()
    assert r.metadata == {"m": "x", "k": "y"} and r.vector == [0.5] * 4
    assert not c.modify("a", new.withColumn("vec_id", F.lit("none")))
    assert c.delete("a", [one]) and not c.delete("a", [one]) and c.count("a") == 19
    c.rebuild("a")
    assert c.optimize("a", 3, nprobe=3) == 3
    assert c.search("a", asked, 2).count() == 2
    assert c.insert("a", vectors(spark, 0)).count() == 0
    with pytest.raises(Exception, match="dimension"):
        c.insert("a", vectors(spark, 1, 3))
    assert c.drop("a") and not c.drop("a")


def test_metadata(spark, root):
    m = MetadataStore(spark, f"{root}/meta")
    assert m.rows().count() == 0
    m.put(spark.createDataFrame([("f1", "txt", "c1", "blue"), ("f2", "md", None, "red")], "file_id string, file_type string, collection_id string, colour string"))
    assert m.get("f1").first().extra == {"colour": "blue"}
    assert m.search({"collection_id": None}).count() == 1 and m.search({"collection_id": None}, null_safe=False).count() == 0
    assert m.search().count() == 2
    assert m.update("f1", file_type="md", size_class="s") and m.get("f1").first().extra == {"colour": "blue", "size_class": "s"}
    assert not m.update("f9", file_type="md")
    assert m.search({"file_type": "md"}).count() == 2
    assert m.delete("f1") and not m.delete("f1")


def test_files_and_snapshots(spark, root):
    f = FileStore(spark, f"{root}/files")
    name = f.put(b"Test file content", "test_file.txt")
    assert name.endswith(".txt") and f.get(name) == b"Test file content" and f.list() == [name]
    assert f.rows().first().file_type == "txt"
    s = Snapshots(spark, root, ("files",))
    first = s.create()
    assert f.delete(name) and f.get(name) is None
    assert s.restore(first) and f.get(name) == b"Test file content"
    second = s.create()
    assert set(s.list()) == {first, second} and s.delete(second) and s.list() == [first]
    assert not s.restore("none")


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "angular"])
def test_metric_stays(spark, root, metric):
    """The same answers before and after ``optimize`` with all cells probed, after an insert, a change and a delete."""
    import numpy as np

    x = np.random.default_rng(4).standard_normal((60, 5)).astype(np.float32) * (1 + np.arange(60)[:, None] % 4)
    frame = lambda a, first=0: spark.createDataFrame([([float(v) for v in r], {"n": str(first + i)}) for i, r in enumerate(a)], "vector array<float>, metadata map<string,string>")
    c = Collections(spark, root)
    c.create("m", 5, metric)
    c.insert("m", frame(x))
    asked = spark.createDataFrame([(i, [float(v) for v in x[i] * 0.5]) for i in range(6)], "query_id long, q array<float>")
    answers = lambda: [(r.query_id, r["rank"], r.metadata["n"], round(r.score, 4)) for r in c.search("m", asked, 5).orderBy("query_id", "rank").collect()]
    before = answers()
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    q = x[:6] * 0.5
    score = {"l2": -((x[None] - q[:, None]) ** 2).sum(axis=2), "ip": q @ x.T, "cosine": unit(q) @ unit(x).T, "angular": unit(q) @ unit(x).T}[metric]
    assert [n for _, _, n, _ in before] == [str(i) for r in score for i in np.argsort(-r, kind="stable")[:5]]
    assert c.optimize("m", 7, nprobe=7) == 7
    assert answers() == before
    one = c.search("m", asked, 1).where("query_id = 0").first()
    c.insert("m", frame(x[:1] * 1000, 100))
    assert metric != "ip" or [n for q, k, n, _ in answers() if k == 1].count("100") > 0
    gone = c.rows("m").where("metadata['n'] = '100'").first().vec_id
    assert c.delete("m", [gone]) and answers() == before
    assert c.modify("m", spark.createDataFrame([(one.vec_id, None, {"k": "v"})], "vec_id string, vector array<float>, metadata map<string,string>"), merge=True)
    assert answers() == before
    c.rebuild("m")
    assert answers() == before


def test_versions(spark, root):
    c = Collections(spark, root)
    c.create("v", 4)
    c.insert("v", vectors(spark, 5))
    seen = c.rows("v")
    one = seen.first().vec_id
    twice = spark.createDataFrame([(one, [1.0] * 4, None)] * 2, "vec_id string, vector array<float>, metadata map<string,string>")
    with pytest.raises(ValueError, match="several"):
        c.modify("v", twice)
    assert c.delete("v", [one])
    assert seen.count() == 5 and c.count("v") == 4  # a reader of the version before still finds its parts
    c.store.write("v/manifest-000000000099.json.half", "{")  # what a writer left that died
    assert c.count("v") == 4
    assert c.insert("v", vectors(spark, 1)).count() == 1
    c.drop("v")
    assert not c.exists("v") and c.names() == []


def test_lock(spark, root, monkeypatch):
    from vecsmith.operators import collection

    c = Collections(spark, root)
    c.create("w", 4)
    assert c.store.claim("_locks/w") and not c.store.claim("_locks/w")  # another process writes
    monkeypatch.setattr(collection, "PATIENCE", 0.3)
    with pytest.raises(TimeoutError):
        c.insert("w", vectors(spark, 1))
    monkeypatch.setattr(collection, "STALE", -1.0)  # it died
    assert c.insert("w", vectors(spark, 1)).count() == 1


@pytest.mark.parametrize("kind,options", [("hnsw", {"rows": 40}), ("annoy", {"depth": 2})])
def test_built(spark, root, kind, options):
    c = Collections(spark, root)
    c.create("g", 4)
    c.insert("g", vectors(spark, 60))
    asked = spark.createDataFrame([(1, [3.0, 6.0, 9.0, 12.0])], "query_id long, q array<float>")
    names = lambda: [r.metadata["n"] for r in c.search("g", asked, 3).orderBy("rank").collect()]
    c.build("g", kind, **options)
    assert names() == ["3", "2", "4"]
    c.insert("g", vectors(spark, 4))  # beside the index
    assert names() == ["3", "3", "2"]
    first = c.search("g", asked, 1).first().vec_id
    assert c.delete("g", [first]) and names() == ["3", "2", "4"]  # ties by place
    assert Collections(spark, root).search("g", asked, 1, {"n": "9"}, mode="pre").first().metadata == {"n": "9"}
    with pytest.raises(ValueError):
        c.build("g", "other")
    c.create("h", 4, "ip")
    with pytest.raises(ValueError):
        c.build("h", kind)


def test_snapshots_by_the_clock(spark, root):
    import time

    f = FileStore(spark, f"{root}/files")
    f.put(b"x", "a.txt")
    s = Snapshots(spark, root, ("files",))
    ended = s.every(0.2, most=2)
    until = time.time() + 60
    while len(s.list()) < 2 and time.time() < until:
        time.sleep(0.2)
    ended.set()
    time.sleep(0.5)
    assert 2 <= len(s.list()) <= 3
