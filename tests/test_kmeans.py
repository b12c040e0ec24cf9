"""k-means over packed blocks, and rows that a scan gives to one task."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vecsmith.operators import kmeans as km
from vecsmith.operators.search import spread


def one_group(path, n):
    """One file with one group of rows, which a scan gives to one task, whatever the number of its tasks."""
    x = np.random.default_rng(4).normal(size=(n, 6)).astype(np.float32)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))})
    pq.write_table(table, path, row_group_size=n)
    return x


def test_spread(spark, tmp_path):
    one_group(f"{tmp_path}/v.parquet", 30_000)
    cores = spark.sparkContext.defaultParallelism
    rows = spark.read.parquet(f"{tmp_path}/v.parquet")
    sizes = [r[1] for r in spread(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 30_000 and (30_000 <= 2048 * cores or max(sizes) * cores <= 60_000)
    few = rows.limit(10)
    assert spread(few) is few


@pytest.mark.parametrize(("block", "at_once"), [(1 << 20, 1 << 22), (50, 1 << 22), (50, 0)])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_as_plain(spark, tmp_path, monkeypatch, block, at_once, kind):
    """The centroids are those of plain iterations, whatever the blocks and wherever partial sums are added."""
    monkeypatch.setattr(km, "_PACKED", block)
    monkeypatch.setattr(km, "_AT_ONCE", at_once)
    x = one_group(f"{tmp_path}/v.parquet", 300).astype(float)
    base = spark.read.parquet(f"{tmp_path}/v.parquet").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    base = base.unionByName(base.limit(2).withColumn("embedding", F.lit(None).cast(f"array<{kind}>")))
    want = km.first_centroids(base, 7)
    for _ in range(4):
        cell = km.nearest_cell(x, want)
        want = np.stack([x[cell == c].mean(axis=0) for c in range(7)])
    np.testing.assert_allclose(km.kmeans(base, 7, 4), want, rtol=1e-9)


def test_base_is_read_once(spark):
    """What a row's vector is worked out from is read for the blocks alone, not in each iteration or for the first centroids."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def vector(i):
        calls.add(1)
        return [float(i * i % 31), float(i % 7)]

    base = spark.range(200).select(F.col("id").alias("vec_id"), vector.asNondeterministic()("id").alias("embedding"))
    blocks = base.where("embedding is not null").count()
    before = calls.value
    km.kmeans(base, 3, 4)
    assert blocks == 200 and calls.value - before <= 400  # once for the counts of its tasks, once for the blocks


def test_dimensions(spark):
    base = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="several dimensions"):
        km.kmeans(base, 1, 1)
