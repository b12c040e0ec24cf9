"""Sample arrays and pooled vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def peak_normalized(samples: Column) -> Column:
    """Divided by the largest magnitude, unless that is 0."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return F.when(peak > 0, F.transform(F.array(peak), lambda p: F.transform(samples, lambda x: x / p))[0]).otherwise(samples)


def segments(samples: Column, rate: Column, seconds: int = 30) -> Column:
    """Runs of ``seconds``; the last one may be shorter."""
    step = (rate * seconds).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(samples) - 1, F.lit(0)), step), lambda i: F.slice(samples, i + 1, step))


def pooled(vector: Column, width: int, parts: int) -> Column:
    """Means of ``parts`` runs of ``width`` elements."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.aggregate(F.slice(vector, i * width + 1, width), F.lit(0.0), lambda s, x: s + x.cast("double")) / width)
