"""Aggregates over vectors and usage records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecsmith.functions.distance import l2_squared


def mean_vectors(df: DataFrame, by: list[str], vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """Element-wise mean for each group: partial sums by element, then one small array."""
    rows = df if where is None else df.where(where)
    long = rows.select(*by, F.posexplode(vector).alias("dim", "x"))
    means = long.groupBy(*by, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("mean_vector"))


def dimension_variance(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(group, dim, variance) by population variance."""
    return df.select(*by, F.posexplode(vector).alias("dim", "x")).groupBy(*by, "dim").agg(F.var_pop(F.col("x").cast("double")).alias("variance"))


def widest_dimension(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """The dimension of most variance in each group, the first of equals."""
    v = dimension_variance(df, by, vector)
    return v.groupBy(*by).agg(F.max(F.struct("variance", (-F.col("dim")).alias("neg"))).alias("m")).select(*by, (-F.col("m.neg")).alias("dim"), F.col("m.variance").alias("variance"))


def radii(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """The largest distance of a group's rows to its mean, and its size."""
    means = mean_vectors(df, by, vector)
    return df.join(means, by).groupBy(*by).agg(F.sqrt(F.max(l2_squared(vector, "mean_vector"))).alias("radius"), F.count(F.lit(1)).alias("n"))


def sizes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def usage(df: DataFrame, by: list[str], seconds: str = "seconds", at: str = "used_at") -> DataFrame:
    """Calls, total time and last use."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum(seconds).alias("total_seconds"), F.max(at).alias("last_used"))


def pivot_filled(df: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """One row for each ``row`` with a column for each value of ``column``; absent ones are 0."""
    return df.groupBy(row).pivot(column, columns).agg(F.first(value)).fillna(0)


def reduced(df: DataFrame, columns: list[str], k: int, out: str = "reduced") -> DataFrame:
    """Rows projected onto the top ``k`` singular directions (uncentred); nulls count as 0.

    Tasks add up products of columns, so columns squared numbers a task move, and the driver
    solves a problem of that size.
    """

    def products(batches):
        total = np.zeros((len(columns), len(columns)))
        for b in batches:
            x = b.to_numpy(dtype=float, na_value=0.0)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    gram = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((len(columns), len(columns)))
    total[gram["i"], gram["j"]] = gram["v"]
    _, directions = np.linalg.eigh(total)
    top = directions[:, ::-1][:, :k]
    dots = [sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(x)) for c, x in zip(columns, top[:, j], strict=True)), F.lit(0.0)) for j in range(top.shape[1])]
    return df.withColumn(out, F.array(*dots))
