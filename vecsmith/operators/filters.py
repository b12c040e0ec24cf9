"""Metadata predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def equals(filters: dict | None) -> Column:
    """Null-safe equality of all columns; no filters match everything."""
    return _all([F.col(k).eqNullSafe(F.lit(v)) for k, v in (filters or {}).items()])


def sql_equals(filters: dict | None) -> Column:
    """Plain equality: a null never matches."""
    return _all([F.col(k) == F.lit(v) for k, v in (filters or {}).items()])


def map_equals(metadata: Column, filters: dict | None) -> Column:
    """Equality of entries of a string map; a missing key equals None."""
    return _all([F.try_element_at(metadata, F.lit(k)).eqNullSafe(F.lit(None if v is None else str(v))) for k, v in (filters or {}).items()])


def variant_equals(metadata: Column, filters: dict | None) -> Column:
    """Equality of top-level fields of a variant, compared as the filter's type."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    return _all([F.try_variant_get(metadata, f"$.{k}", kinds.get(type(v), "string")).eqNullSafe(F.lit(v)) for k, v in (filters or {}).items()])


def contains(column: str, value) -> Column:
    """An array column that holds the value."""
    return F.array_contains(F.col(column), F.lit(value))


def in_collection(df: DataFrame, collection_id: str) -> DataFrame:
    """Rows of one collection; prunes partitions where the table is laid out by it."""
    return df.where(F.col("collection_id") == collection_id)


def live(results: DataFrame, rows: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Results whose rows still exist."""
    return results.join(rows.select(F.col(id_col).alias("vec_id")), "vec_id", "left_semi")
