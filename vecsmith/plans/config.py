"""Settings with defaults, from keyword arguments, the session or the environment."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields

from pyspark.sql import SparkSession

from vecsmith.functions.distance import METRICS


@dataclass(frozen=True)
class Settings:
    """``root`` holds all that a service keeps; empty, it is the folder ``vecsmith`` in the session's warehouse, which all executors share."""

    root: str = ""
    metric: str = "l2"
    embedder: str = "hashing-text"
    chunk_words: int = 100
    top_k: int = 10
    batch_size: int = 1000
    cache_entries: int = 1000
    cache_seconds: float = 3600.0

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")
        for name in ("chunk_words", "top_k", "batch_size", "cache_entries"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    @classmethod
    def of(cls, spark: SparkSession | None = None, **given) -> Settings:
        """``given`` before ``vecsmith.<name>`` of the session before VECSMITH_<NAME> of the environment."""
        out = {}
        for f in fields(cls):
            value = os.environ.get(f"VECSMITH_{f.name.upper()}")
            if spark is not None:
                value = spark.conf.get(f"vecsmith.{f.name}", value)
            if value is not None:
                out[f.name] = type(f.default)(value)
        return cls(**(out | given))

    def folder(self, spark: SparkSession) -> str:
        """``root``, or where it is empty its place in the warehouse."""
        return self.root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/vecsmith"

    def items(self) -> dict:
        return asdict(self)
