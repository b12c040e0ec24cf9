"""Streaming extension: new documents to a collection, and searches of a stream against stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecsmith.functions.embed import dimension, embedded
from vecsmith.operators.collection import Collections
from vecsmith.operators.search import knn
from vecsmith.plans.ingest import chunked


def stream_chunks(docs: DataFrame, file_id: str = "file_id", text: str = "text", embedder: str = "hashing-text") -> DataFrame:
    """Chunks with vectors of a streaming (or static) frame of documents."""
    return chunked(docs, file_id, text).withColumn("vector", embedded(F.col("chunk"), embedder))


def stream_into(docs: DataFrame, collections: Collections, collection: str, checkpoint: str, file_id: str = "file_id", text: str = "text", embedder: str = "hashing-text", trigger: dict | None = None) -> StreamingQuery:
    """Append a stream of documents to a collection; a batch that is run again is not added twice."""
    collections.create(collection, dimension(embedder))

    def add(batch: DataFrame, batch_id: int) -> None:
        mark = {"stream": checkpoint, "batch": str(batch_id)}
        seen = collections.rows(collection).where((F.col("metadata")["stream"] == mark["stream"]) & (F.col("metadata")["batch"] == mark["batch"])).limit(1).count()
        if not seen:
            facts = F.create_map(F.lit("file_id"), F.col("file_id").cast("string"), F.lit("chunk_id"), F.col("chunk_id"), *[F.lit(x) for kv in mark.items() for x in kv])
            collections.insert(collection, stream_chunks(batch, file_id, text, embedder).select("vector", facts.alias("metadata")))

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_search(queries: DataFrame, base: DataFrame, sink, checkpoint: str, k: int = 10, metric: str = "l2", trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch of queries (vec_id, embedding) against stored rows; ``sink(results, batch_id)`` takes the results."""
    return queries.writeStream.foreachBatch(lambda batch, n: sink(knn(base, batch, k, metric), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, at: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time counts with a watermark (an extension; static frames work too)."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))
