import pytest
from pyspark.sql import functions as F

from vecsmith.functions import generate
from vecsmith.plans.cache import ResultCache
from vecsmith.plans.config import Settings
from vecsmith.plans.service import Service
from vecsmith.sources.users import claims, token


def test_cache():
    now = [0.0]
    c = ResultCache(2, 10, lambda: now[0])
    c.set("a", 1), c.set("b", 2)
    assert c.get("a") == 1
    c.set("c", 3)
    assert "b" not in c and "a" in c and len(c) == 2
    now[0] = 9
    assert c.get("a") == 1
    now[0] = 15
    assert c.get("a") == 1 and c.get("c", "gone") == "gone"
    assert c.remove("a") and not c.remove("a")
    c.clear()
    assert len(c) == 0


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("VECSMITH_TOP_K", "7")
    assert Settings.of().top_k == 7 and Settings.of(top_k=3).top_k == 3
    spark.conf.set("vecsmith.top_k", "5")
    try:
        assert Settings.of(spark).top_k == 5
    finally:
        spark.conf.unset("vecsmith.top_k")
    with pytest.raises(ValueError):
        Settings(metric="x")
    with pytest.raises(ValueError):
        Settings(top_k=0)


def test_tokens():
    t = token({"sub": "u"}, "s", now=100)
    assert claims(t, "s", now=200)["sub"] == "u" and claims(t, "other", now=200) is None and claims(t, "s", now=100 + 3600) is None


def test_generators(spark):
    generate.register("echo", lambda prompts, p: [x + " " + p["tail"] for x in prompts], tail="a")
    df = spark.createDataFrame([("p",), (None,)], "p string")
    assert [r.t for r in df.select(generate.generated(F.col("p"), "echo").alias("t")).collect()] == ["a", "a"]
    assert generate.set_parameters("echo", tail="b") == {"tail": "b"}
    assert df.select(generate.generated(F.col("p"), "echo").alias("t")).first().t == "b"


def test_service(spark, tmp_path):
    s = Service(spark, Settings(root=f"file://{tmp_path}"))
    assert s.collections.create("c", 2)
    rows = spark.createDataFrame([([float(i), 0.0], {"n": str(i)}) for i in range(5)], "vector array<float>, metadata map<string,string>")
    s.insert("c", rows)
    got = s.search("c", [3.0, 0.0], 2)
    assert [r["metadata"]["n"] for r in got] == ["3", "2"] and s.search("c", [3.0, 0.0], 2) is got
    s.insert("c", rows)
    assert [r["metadata"]["n"] for r in s.search("c", [3.0, 0.0], 2)] == ["3", "3"]
    key = s.users.create("u", 1)
    assert s.users.create("u") is None and s.users.check("u", key) and not s.users.check("u", "x")
    assert key not in [r.api_key for r in s.users.list().collect()]
    assert s.users.set_level("u", 2) and s.users.find("u").first().level == 2 and not s.users.set_level("v", 1)
    assert s.users.delete("u") and not s.users.delete("u")
    s.use_embedder("colour-image")
    assert s.settings.embedder == "colour-image"
    with pytest.raises(ValueError):
        s.use_embedder("none")
    assert Settings().folder(spark).endswith("/warehouse/vecsmith")
    s.snapshots.create()
    assert s.status()["collections"] == {"c": 10} and s.status()["snapshots"] == 1
