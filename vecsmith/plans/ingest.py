"""Files to searchable chunks: read, chunk, clean, embed; and text search over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsmith.functions import text as T
from vecsmith.functions.embed import dimension, embedded
from vecsmith.operators.collection import Collections
from vecsmith.operators.search import enriched
from vecsmith.sources.documents import accepted_files, decoded_text, files, text_metadata
from vecsmith.sources.stores import MetadataStore


def chunked(docs: DataFrame, file_id: str = "file_id", text: str = "text", size: int = 100) -> DataFrame:
    """(file_id, chunk_id, chunk_index, chunk_length, chunk) of each document."""
    rows = docs.select(F.col(file_id).alias("file_id"), F.posexplode(T.chunks(F.col(text), size)).alias("chunk_index", "raw"))
    rows = rows.withColumn("chunk", T.cleaned(F.col("raw")))
    return rows.select("file_id", T.chunk_id(F.col("file_id"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", F.length("raw").alias("chunk_length"), "chunk")


def process_text(docs: DataFrame, file_id: str = "file_id", text: str = "text", embedder: str = "hashing-text") -> DataFrame:
    """Chunks of each document, and the vector of its whole text."""
    return docs.select(F.col(file_id).alias("file_id"), T.chunks(F.col(text)).alias("chunks"), embedded(F.coalesce(F.col(text), F.lit("")), embedder).alias("embedding"))


def ingest(spark: SparkSession, path: str | list[str], collections: Collections, metadata: MetadataStore, collection: str, embedder: str = "hashing-text") -> DataFrame:
    """Ingest all text files under a path; (path, file_id, status, error) of every file, broken and foreign ones too.

    The file id is the hash of path and content, so a repeated run finds the same ids.
    """
    good, foreign = accepted_files(files(spark, path))
    named = decoded_text(good).withColumn("hash", T.content_hash(F.col("content"))).withColumn("file_id", F.sha2(F.concat_ws(":", "path", "hash"), 256))
    read = named.where("error is null").drop("content")
    collections.create(collection, dimension(embedder))
    chunks = chunked(read.select("file_id", "text")).join(read.select("file_id", "file_type", "hash", F.col("modified").alias("timestamp")), "file_id")
    facts = F.create_map(
        *[x for c in ("file_id", "file_type", "hash", "chunk_id") for x in (F.lit(c), F.col(c))], F.lit("collection_id"), F.lit(collection), F.lit("timestamp"), F.col("timestamp").cast("string"),
        F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("chunk_length"), F.col("chunk_length").cast("string"),
    )
    collections.insert(collection, chunks.select(embedded(F.col("chunk"), embedder).alias("vector"), facts.alias("metadata")))
    typed = text_metadata(read).select("file_id", "file_name", "file_type", "modality", "file_size", "hash", F.col("path").alias("storage_path"), F.lit(collection).alias("collection_id"), "content_length", "word_count", F.col("modified").alias("timestamp"))
    metadata.put(typed)
    done = named.select("path", "file_id", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error")
    left = foreign.unionByName(good.where("modality <> 'text'")).select("path", F.lit(None).cast("string").alias("file_id"), F.lit("error").alias("status"), F.concat(F.lit("not ingested: "), "file_type").alias("error"))
    return done.unionByName(left)


def text_search(collections: Collections, metadata: MetadataStore, collection: str, queries: DataFrame, k: int = 10, filters: dict | None = None, mode: str = "post", embedder: str = "hashing-text", contents: DataFrame | None = None) -> DataFrame:
    """Search by text (query_id, text), with each hit's file metadata, and content if ``contents`` (storage_path, content) is given."""
    asked = queries.select("query_id", embedded(F.col("text"), embedder).alias("q"))
    hits = collections.search(collection, asked, k, filters, mode)
    hits = hits.select("query_id", "rank", "vec_id", "score", F.col("metadata")["file_id"].alias("file_id"), F.col("metadata")["chunk_id"].alias("chunk_id"))
    return enriched(hits, metadata.rows(), contents)
