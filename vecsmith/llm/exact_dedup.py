"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

Each normalised text is cut at sentence ends (content-defined boundaries). The
64-bit identifier of a chunk is verified against the SHA-256 digests of all
chunks that have it; the rare ambiguous ones are told apart by these, with an
ordinal. Documents are then compared by their ordered identifier lists, so long
texts never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecsmith.llm.common import ascii_lower, stored

MIN_CHUNK, MAX_CHUNK = 512, 4096
_ENDS = r"[.!?\n。！？]"


def chunks(text: Column, smallest: int = MIN_CHUNK, largest: int = MAX_CHUNK) -> Column:
    """The text cut after the first sentence end that is ``smallest`` characters in; ``largest`` at most."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{smallest},{largest - 1}}}?{_ENDS}|.{{1,{largest}}}"), F.lit(0))


def _ambiguous_ids(listed: DataFrame) -> DataFrame | None:
    """Identifiers that chunks of several digests have; mostly none."""
    digests = listed.select(F.explode("_list").alias("c")).select("c.id", "c.digest").distinct()
    shared = stored(digests.groupBy("id").count().where("count > 1").select("id"), "shared")
    return None if shared.isEmpty() else shared


def recipes(docs: DataFrame, text: str = "text", identify=F.xxhash64) -> DataFrame:
    """A stored table of ``docs`` without its text, with ``_sha`` (SHA-256 of the normalised text) and ``_recipe`` (ordered chunk identifiers).

    Texts are cut and digested once. Where an identifier has several digests, its chunks get
    ordinals by digest, so that recipes are equal only for equal lists of chunks.
    """
    norm = docs.withColumn("_norm", ascii_lower(F.col(text)))
    each = lambda c: F.struct(identify(c).alias("id"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("digest"))
    listed = norm.withColumns({"_sha": F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)), "_list": F.transform(chunks(F.col("_norm")), each)})
    listed = stored(listed.drop("_norm", text), "listed", "lz4")
    shared = _ambiguous_ids(listed)
    if shared is None:
        return listed.withColumn("_recipe", F.transform("_list", lambda c: c["id"])).drop("_list")
    some = listed.select(F.explode("_list").alias("c")).select("c.id", "c.digest").join(shared, "id", "left_semi").distinct()
    some = some.withColumn("ordinal", F.row_number().over(Window.partitionBy("id").orderBy("digest")))
    # texts that hold such chunks, by place
    place = listed.select("_sha", F.posexplode("_list").alias("pos", "c")).select("_sha", "pos", "c.id", "c.digest").join(some, ["id", "digest"]).select("_sha", "pos", "ordinal").distinct()
    fixes = place.groupBy("_sha").agg(F.map_from_entries(F.collect_list(F.struct("pos", "ordinal"))).alias("_fixes"))
    ordinal = lambda i: F.coalesce(F.try_element_at("_fixes", i), F.lit(0))
    return listed.join(fixes, "_sha", "left").withColumn("_recipe", F.transform("_list", lambda c, i: F.struct(c["id"].alias("id"), ordinal(i).alias("ordinal")))).drop("_fixes", "_list")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_columns: bool = False, identify=F.xxhash64) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the largest id stays; null ids lose against any other, and a
    group that has only null ids keeps them all (keep_id null). Rows that repeat
    the largest id with an equal text count as one document and are all kept.
    An empty table gives an empty result. Other columns, whatever their names,
    come along only with ``keep_columns``, packed in the struct ``row``.
    """
    slim = docs.select(F.col(id_col).alias(id_col), F.col(text).alias("_text"), *([F.struct(*docs.columns).alias("row")] if keep_columns else []))
    listed = recipes(slim, "_text", identify).withColumn("_key", F.xxhash64("_recipe"))
    groups = listed.groupBy("_key", "_recipe").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    # stored, so that the join deals out both sides anew and a large group can be split
    found = listed.join(stored(groups, "groups"), ["_key", "_recipe"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    found = found.withColumns({"keep_id": keep_id, "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return found.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"), *(["row"] if keep_columns else []))
