"""Retrieval quality: recall, precision, F1, NDCG, and reports over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hits(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, hit, wanted): results up to k beside the number of true rows up to k."""
    right = truth.where(F.col("rank") <= k).select("query_id", "vec_id").distinct().withColumn("hit", F.lit(1))
    wanted = right.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    got = results.where(F.col("rank") <= k).join(right, ["query_id", "vec_id"], "left").select("query_id", "rank", F.coalesce("hit", F.lit(0)).alias("hit"))
    return wanted.join(got, "query_id", "left")


def per_query(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, ndcg); queries without true rows are left out."""
    gain = F.sum(F.coalesce("hit", F.lit(0)) / F.log2(F.col("rank") + 1.0))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), lambda i: F.lit(1.0) / F.log2(i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    out = _hits(results, truth, k).groupBy("query_id", "wanted").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.coalesce(gain, F.lit(0.0)).alias("gain"))
    return out.select("query_id", (F.col("hits") / F.col("wanted")).alias("recall"), (F.col("hits") / F.lit(k)).alias("precision"), (F.col("gain") / ideal).alias("ndcg"))


def summary(results: DataFrame, truth: DataFrame, k: int, queries: int | None = None) -> DataFrame:
    """Mean recall, precision and NDCG, and the F1 of the means.

    With ``queries``, sums are divided by that number instead (queries without true rows count as 0).
    """
    n = F.lit(queries) if queries else F.count(F.lit(1))
    means = per_query(results, truth, k).agg((F.sum("recall") / n).alias("recall"), (F.sum("precision") / n).alias("precision"), (F.sum("ndcg") / n).alias("ndcg"))
    both = F.col("recall") + F.col("precision")
    return means.withColumn("f1", F.when(both > 0, F.lit(2.0) * F.col("recall") * F.col("precision") / both).otherwise(0.0))


def throughput(runs: DataFrame) -> DataFrame:
    """Queries a second and mean latency of (system, queries, seconds) runs."""
    return runs.groupBy("system").agg((F.sum("queries") / F.sum("seconds")).alias("qps"), (F.sum("seconds") / F.sum("queries") * 1000.0).alias("mean_ms"))


def ranking(runs: DataFrame, measure: str, ascending: bool = False) -> DataFrame:
    """Systems by the mean of a measure over all runs."""
    means = runs.groupBy("system").agg(F.avg(measure).alias(measure))
    return means.orderBy(F.asc(measure) if ascending else F.desc(measure), "system")
