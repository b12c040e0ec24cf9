"""The operations of a vector service, as calls over collections, metadata, files and snapshots."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from vecsmith.functions.embed import dimension
from vecsmith.operators.collection import Collections
from vecsmith.plans.cache import ResultCache
from vecsmith.plans.config import Settings
from vecsmith.plans.ingest import ingest, process_text, text_search
from vecsmith.sources.stores import FileStore, MetadataStore, Snapshots
from vecsmith.sources.users import Users


class Service:
    """One root folder with collections, metadata, files, users and snapshots of them."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark = spark
        self.settings = settings or Settings.of(spark)
        root = self.settings.folder(spark)
        self.collections = Collections(spark, f"{root}/vectors")
        self.metadata, self.files = MetadataStore(spark, f"{root}/metadata"), FileStore(spark, f"{root}/files")
        self.users, self.snapshots = Users(spark, f"{root}/users"), Snapshots(spark, root, ("vectors", "metadata", "files"))
        self.cache = ResultCache(self.settings.cache_entries, self.settings.cache_seconds)

    def use_embedder(self, name: str) -> None:
        """Switch to another registered embedder for all later calls."""
        dimension(name)
        self.settings = replace(self.settings, embedder=name)

    def process_text(self, docs: DataFrame, file_id: str = "file_id", text: str = "text") -> DataFrame:
        return process_text(docs, file_id, text, self.settings.embedder)

    def upload(self, path: str | list[str], collection: str) -> DataFrame:
        return ingest(self.spark, path, self.collections, self.metadata, collection, self.settings.embedder)

    def insert(self, collection: str, rows: DataFrame) -> DataFrame:
        return self.collections.insert(collection, rows, batch_size=self.settings.batch_size)

    def search(self, collection: str, vector: list[float], k: int | None = None, filters: dict | None = None, mode: str = "post") -> list[dict]:
        """k results for one vector; remembered for the collection's version."""
        k = k or self.settings.top_k
        key = (collection, self.collections._manifest(collection)["version"], tuple(map(float, vector)), k, json.dumps(filters, sort_keys=True), mode)
        got = self.cache.get(key)
        if got is None:
            asked = self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, q array<float>")
            got = [r.asDict() for r in self.collections.search(collection, asked, k, filters, mode).orderBy("rank").collect()]  # at most k rows
            self.cache.set(key, got)
        return got

    def search_text(self, collection: str, queries: DataFrame, k: int | None = None, filters: dict | None = None) -> DataFrame:
        return text_search(self.collections, self.metadata, collection, queries, k or self.settings.top_k, filters, embedder=self.settings.embedder)

    def status(self) -> dict:
        return {"collections": {n: self.collections.count(n) for n in self.collections.names()}, "snapshots": len(self.snapshots.list()), "cached": len(self.cache), "settings": self.settings.items()}
