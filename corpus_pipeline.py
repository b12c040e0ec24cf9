"""A training corpus from ``documents``: the stages of a pipeline over the operators of ``vecsmith.llm``.

Each stage takes (spark, docs, sf_dir), with the columns of ``documents``, and
returns what it keeps with the same columns; the last one returns packed pieces. Each
result is written to shared storage and read back as the next stage's input.

Rows that repeat an id are documents of their own wherever their texts differ, and so are rows
without an id; each stage says what it does with them. An empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsmith.llm.common import ascii_lower, broadcast_if_small, dropped, scratch_removed, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learned from the labelled documents; those without a language (no letters) go.

    ``lang`` becomes the predicted language. It goes by the text alone, whatever the id.
    """
    from vecsmith.llm.language_id import identify, train

    # row by row, with the other columns (by place, whatever their names) beside the text: nothing is joined back
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(others)])
    found = identify(docs.select(rest.alias("rest"), "text"), train(docs), id_col="rest")
    column = lambda c: F.col("text") if c == "text" else F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"doc_id._{others.index(c)}").alias(c)
    return found.where("lang_pred <> 'und'").select(*[column(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the largest doc_id stays.

    Rows without an id go where their text has one, and all stay where it has none; so do rows that repeat both the largest id and the text.
    """
    from vecsmith.llm.exact_dedup import exact_dedup

    # by id and text, so that rows of one id with other texts are told apart; texts stay where they are while few rows go
    gone = exact_dedup(docs).where("not kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha")).distinct()
    gone = broadcast_if_small(stored(gone, "gone"))
    sha = F.unhex(F.sha2(ascii_lower(F.col("text")).cast("binary"), 256))
    rows = docs.select(F.col("doc_id").alias("_id"), sha.alias("_sha"), F.struct(*docs.columns).alias("row"))
    return rows.join(gone, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_sha") == F.col("sha")), "left_anti").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on shingles of five words at 0.8: of each component the smallest doc_id stays.

    Rows without an id link with nothing and stay; rows that repeat an id are one document and stay or go together.
    """
    from vecsmith.llm.jaccard_join import jaccard_join

    parts = jaccard_join(docs, width=5, percent=80)
    gone = broadcast_if_small(stored(parts.where("component_id <> doc_id").select("doc_id").distinct(), "gone"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: a document has as many rows as the mix takes copies of it.

    A document is known by its id (null or not) and a hash of its text; rows that agree in both get the same
    number of copies, the largest that the mix gives one of them.
    """
    from vecsmith.llm.mixing import mix

    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    named = docs.select(key.alias("_key"), "text", "source")
    copies = mix(named, id_col="_key", trim=False).groupBy("_key.id", F.col("_key.text").alias("_text")).agg(F.max("copies").alias("copies"))
    copies = broadcast_if_small(stored(copies, "copies"))
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.struct(*docs.columns).alias("row"))
    rows = rows.join(copies, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("_text")))
    return rows.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing along the space-filling curve into sequences of at most 2048 ids; every row is a document of its own, whatever its id."""
    import public_tokenizers

    from vecsmith.llm.packing import pack

    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixing), ("packing", packing)]

#: Prediction, entropy balancing and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the ``documents`` table of ``sf_dir``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch_removed(spark) as keep:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
            keep.append(docs)
        if last is not None:
            dropped(spark, last)
        last = docs
    return docs
