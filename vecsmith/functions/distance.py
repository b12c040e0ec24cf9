"""Vector distances as Column expressions; elements are widened to double first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def doubles(v) -> Column:
    return _c(v).cast("array<double>")


def _folded(a, b, f) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), f), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a, b) -> Column:
    """Sum of squared differences (no root)."""
    return _folded(a, b, lambda x, y: (x - y) * (x - y))


def inner_product(a, b) -> Column:
    return _folded(a, b, lambda x, y: x * y)


def norm(v) -> Column:
    return F.sqrt(inner_product(v, v))


def cosine(a, b) -> Column:
    """Cosine similarity; null where a norm is zero."""
    return F.try_divide(inner_product(a, b), norm(a) * norm(b))


def angular(a, b) -> Column:
    """sqrt(2 (1 - cosine))."""
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) * (F.lit(1.0) - cosine(a, b))))


def l2_by_norms(a, b) -> Column:
    """Squared L2 from norms and the inner product, as a block product computes it."""
    return inner_product(a, a) + inner_product(b, b) - F.lit(2.0) * inner_product(a, b)


def normalized(v, least: float = 1e-6) -> Column:
    """Unit vector; one whose norm is ``least`` or below stays as it is."""
    # the norm is bound once, not worked out for each element
    scale = F.when(norm(v) > least, norm(v)).otherwise(1.0)
    return F.when(_c(v).isNotNull(), F.transform(F.array(scale), lambda n: F.transform(doubles(v), lambda x: x / n))[0])


def hamming(a, b) -> Column:
    """Bits in which two 32-bit codes differ."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


@dataclass(frozen=True)
class Metric:
    name: str
    ascending: bool
    expression: object


METRICS = {
    "l2": Metric("l2", True, l2_squared),
    "ip": Metric("ip", False, inner_product),
    "cosine": Metric("cosine", False, cosine),
    "angular": Metric("angular", True, angular),
}


def metric(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; one of {sorted(METRICS)}")
    return METRICS[name]
