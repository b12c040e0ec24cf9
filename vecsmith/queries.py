"""Queries over the vector and document operators, with DuckDB SQL where it can say the same.

Searches take every row whose id is divisible by 20 as a query, against all rows.
Vectors are scaled by 1 + id % 5, so that metrics rank differently.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsmith.functions import distance as D
from vecsmith.functions import media, secure
from vecsmith.functions import text as T
from vecsmith.functions.embed import embedded
from vecsmith.operators import aggregates as A
from vecsmith.operators import evaluate, filters
from vecsmith.operators.collection import Collections
from vecsmith.operators.graph import ProximityGraphs
from vecsmith.operators.ivf import InvertedCells
from vecsmith.operators.kmeans import lloyd_step
from vecsmith.operators.lsh import HashTables, hamming_counts
from vecsmith.operators.pq import ProductQuantizer
from vecsmith.operators.scratch import scratch_dir, stored
from vecsmith.operators.search import enriched, filtered_fetch, knn, matrix, search, top_k
from vecsmith.operators.trees import PlaneForest, PrunedCells
from vecsmith.plans.ingest import chunked, process_text

K = 10
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_BASE = "b as (select vec_id, label, list_transform(embedding, lambda x: (x::double * (1 + vec_id % 5))::float) as e from embeddings), v as (select vec_id, label, e::double[] as e from b), q as (select vec_id as query_id, label as query_label, e as qe from v where vec_id % 20 = 0)"
_L2 = "power(list_distance(e, qe), 2)"
_OUT = "select query_id, rank::int as rank, vec_id, round(score, 6) as score from r where rank <= 10"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return e.withColumn("embedding", F.transform("embedding", lambda x: (x.cast("double") * (F.lit(1) + F.col("vec_id") % 5)).cast("float")))


def _asked(base: DataFrame) -> DataFrame:
    return base.where(F.col("vec_id") % 20 == 0)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def _first_rows(base: DataFrame, n: int) -> np.ndarray:
    """A bounded training sample: the rows of the smallest ids."""
    return matrix(base.orderBy("vec_id").limit(n).select("embedding").toPandas()["embedding"])


def _ranked_sql(score: str, order: str, where: str = "true") -> str:
    return f"with {_BASE}, s as (select query_id, vec_id, {score} as score from q, v where {where}), r as (select *, row_number() over (partition by query_id order by score {order}, vec_id) as rank from s) {_OUT}"


@query(_ranked_sql(_L2, "asc"))
def flat_l2_topk(spark, sf_dir):
    base = _base(spark, sf_dir)
    return _shown(knn(base, _asked(base), K, "l2"))


@query(_ranked_sql("list_inner_product(e, qe)", "desc"))
def flat_ip_topk(spark, sf_dir):
    base = _base(spark, sf_dir)
    return _shown(knn(base, _asked(base), K, "ip"))


@query(_ranked_sql("list_cosine_similarity(e, qe)", "desc"))
def cosine_topk(spark, sf_dir):
    base = _base(spark, sf_dir)
    return _shown(knn(base, _asked(base), K, "cosine"))


@query(_ranked_sql("sqrt(greatest(0, 2 * (1 - list_cosine_similarity(e, qe))))", "asc", "query_id <> vec_id"))
def angular_topk(spark, sf_dir):
    base = _base(spark, sf_dir)
    return _shown(knn(base, _asked(base), K, "angular", skip_self=True))


@query(_ranked_sql(_L2, "asc", "query_id <> vec_id"))
def knn_self_exclude(spark, sf_dir):
    base = _base(spark, sf_dir)
    return _shown(knn(base, _asked(base), K, "l2", skip_self=True))


@query(f"with {_BASE}, s as (select query_id, query_label, v.vec_id, v.label, {_L2} as score from q, v where query_id <> v.vec_id), r as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from s), n as (select query_id, query_label, label, count(*) as votes from r where rank <= 10 group by all), t as (select *, row_number() over (partition by query_id order by votes desc, label) as nth from n) select query_id, query_label, label as voted, votes from t where nth = 1")
def knn_label_vote(spark, sf_dir):
    base = _base(spark, sf_dir)
    votes = search(base, _asked(base), K + 1, columns=("label",)).where("query_id <> vec_id")
    votes = top_k(votes.drop("rank"), K, True).groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("query_id").agg(F.min(F.struct((-F.col("votes")).alias("less"), "label")).alias("m"))
    labels = _asked(base).select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return best.join(labels, "query_id").select("query_id", "query_label", F.col("m.label").alias("voted"), (-F.col("m.less")).alias("votes"))


@query(_ranked_sql(_L2, "asc", "label = 1"))
def knn_prefilter(spark, sf_dir):
    base = _base(spark, sf_dir)
    return _shown(search(base, _asked(base), K, condition=filters.equals({"label": 1}), mode="pre"))


@query(f"with {_BASE}, s as (select query_id, vec_id, label, {_L2} as score from q, v), r as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from s) {_OUT} and label = 1")
def knn_postfilter(spark, sf_dir):
    base = _base(spark, sf_dir)
    return _shown(search(base, _asked(base), K, condition=filters.equals({"label": 1}), mode="post"))


@query(f"with {_BASE}, s as (select vec_id, label, power(list_distance(e, (select e from v order by vec_id limit 1)), 2) as score from v order by score, vec_id limit 100) select vec_id, round(score, 6) as score from s where label = 1 order by s.score, vec_id limit 10")
def overfetch_filter(spark, sf_dir):
    base = _base(spark, sf_dir)
    first = base.orderBy("vec_id").first()["embedding"]
    return filtered_fetch(base, first, filters.equals({"label": 1}), K).select("vec_id", F.round("score", 6).alias("score"))


@query("select vec_id, (unnest(range(1, len(embedding) + 1)) - 1)::int as dim, round(unnest(list_transform(embedding, lambda x: x::double / sqrt(list_inner_product(embedding::double[], embedding::double[])))), 6) as x from embeddings")
def normalize_vectors(spark, sf_dir):
    base = _t(spark, sf_dir, "embeddings")
    return base.select("vec_id", F.posexplode(D.normalized("embedding")).alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("x"))


_CENTROIDS = "c as (select row_number() over (order by vec_id) - 1 as list_id, e as ce from v order by vec_id limit 16)"
_CELL = "d as (select vec_id, list_id, power(list_distance(e, ce), 2) as cd, row_number() over (partition by vec_id order by power(list_distance(e, ce), 2), list_id) as nth from v, c)"


def _cells(base: DataFrame, nprobe: int) -> InvertedCells:
    return InvertedCells(16, nprobe, centroids=_first_rows(base, 16))


@query(f"with {_BASE}, {_CENTROIDS}, {_CELL} select vec_id, list_id::int as list_id from d where nth = 1")
def ivf_assign(spark, sf_dir):
    base = _base(spark, sf_dir)
    return _cells(base, 1).assign(base).select("vec_id", "list_id")


@query(f"with {_BASE}, {_CENTROIDS}, {_CELL}, s as (select query_id, v.vec_id, {_L2} as score from q join d as p on p.vec_id = q.query_id and p.nth <= 12 join d as m on m.list_id = p.list_id and m.nth = 1 join v on v.vec_id = m.vec_id), r as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from s) {_OUT}")
def ivf_search(spark, sf_dir):
    base = _base(spark, sf_dir)
    index = _cells(base, 12)
    return _shown(index.search(index.assign(base), _asked(base), K))


@query(_ranked_sql(_L2, "asc"))
def ivf_full_probe(spark, sf_dir):
    base = _base(spark, sf_dir)
    index = _cells(base, 16)
    return _shown(index.search(index.assign(base), _asked(base), K))


@query()
def ivf_trained(spark, sf_dir):
    """Cells trained by k-means; recall is tested against the exact scan."""
    base = _base(spark, sf_dir)
    index = InvertedCells(16, 10, iterations=5).fit(base)
    return _shown(index.search(index.assign(base), _asked(base), K))


@query(f"with {_BASE}, {_CENTROIDS}, {_CELL}, m as (select list_id, unnest(range(1, len(e) + 1)) - 1 as dim, unnest(e) as x from v join d using (vec_id) where nth = 1) select list_id::bigint as cell, dim, round(avg(x), 6) as mean, count(*) as n from m group by all")
def kmeans_lloyd_step(spark, sf_dir):
    base = _base(spark, sf_dir)
    return lloyd_step(base, _first_rows(base, 16)).select("cell", "dim", F.round("mean", 6).alias("mean"), "n")


def _quantizer(base: DataFrame) -> ProductQuantizer:
    books = _first_rows(base, 16).reshape(16, 8, -1).transpose(1, 0, 2)
    return ProductQuantizer(8, 4, codebooks=books)


_BOOKS = "k as (select row_number() over (order by vec_id) - 1 as code, e as ke from v order by vec_id limit 16), parts as (select unnest(range(0, 8)) as m)"
_SUB = "list_distance({0}[m * 8 + 1 : m * 8 + 8], {1}[m * 8 + 1 : m * 8 + 8])"
_CODES = f"pc as (select vec_id, m, arg_min(code, (power({_SUB.format('e', 'ke')}, 2), code)) as code from v, k, parts group by vec_id, m)"


@query(f"with {_BASE}, {_BOOKS}, {_CODES} select vec_id, m::int as part, code::smallint as code from pc")
def pq_encode(spark, sf_dir):
    base = _base(spark, sf_dir)
    return _quantizer(base).encode(base).select("vec_id", F.posexplode("codes").alias("part", "code"))


@query(f"with {_BASE}, {_BOOKS}, {_CODES}, t as (select query_id, m, code, power({_SUB.format('qe', 'ke')}, 2) as td from q, k, parts), s as (select query_id, vec_id, round(sum(td), 9) as score from pc join t using (m, code) group by all), r as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from s) {_OUT}")
def pq_adc_topk(spark, sf_dir):
    base = _base(spark, sf_dir)
    pq = _quantizer(base)
    # equal codes tie: all of them are fetched, then cut by the rounded score
    found = pq.search(pq.encode(base), _asked(base), 16 * K)
    return _shown(top_k(found.drop("rank").withColumn("score", F.round("score", 9)), K, True).withColumn("rank", F.col("rank").cast("int")))


@query()
def pq_reranked(spark, sf_dir):
    """Trained codebooks, exact ranking of all rows that the codes' errors cannot rule out."""
    base = _base(spark, sf_dir)
    pq = ProductQuantizer(8, 8).fit(base)
    return _shown(pq.search(pq.encode(base), _asked(base), K, rerank=True, base=base))


def _planes(dim: int) -> np.ndarray:
    i, j = np.arange(32)[:, None], np.arange(dim)[None, :]
    return ((i * 31 + j * 17 + i * j) % 7 - 3).astype(float)


_BITS = "h as (select unnest(range(0, 32)) as i), bit as (select vec_id, i, list_inner_product(e, list_transform(range(0, len(e)), lambda j: ((i * 31 + j * 17 + i * j) % 7 - 3)::double)) > 0 as on_ from v, h), w as (select vec_id, sum(case when on_ then (1::bigint << i::int) else 0 end)::bigint as code from bit group by vec_id)"


@query(f"with {_BASE}, {_BITS} select vec_id, code from w")
def lsh_codes(spark, sf_dir):
    base = _base(spark, sf_dir)
    coded = HashTables(64, planes=_planes(64)).encode(base)
    return coded.select("vec_id", (F.col("codes")[0].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("code"))


@query(f"with {_BASE}, {_BITS}, s as (select a.vec_id as query_id, b.vec_id, bit_count(xor(a.code, b.code))::int as apart from w a join w b on a.vec_id % 20 = 0) select query_id, apart, count(*) as n from s group by all")
def lsh_hamming(spark, sf_dir):
    base = _base(spark, sf_dir)
    coded = HashTables(64, planes=_planes(64)).encode(base).select("vec_id", F.col("codes")[0].alias("code"))
    return hamming_counts(coded, coded.where(F.col("vec_id") % 20 == 0))


@query()
def lsh_search(spark, sf_dir):
    """Four tables, bands at up to two flipped bits, all candidates ranked exactly; recall is tested."""
    base = _base(spark, sf_dir)
    tables = HashTables(64, tables=4)
    return _shown(tables.search(tables.encode(base), tables.encode(_asked(base)), K, probes=2))


@query(_ranked_sql(_L2, "asc"))
def kd_cell_topk(spark, sf_dir):
    base = _base(spark, sf_dir)
    return _shown(PrunedCells("kd").fit(base).search(_asked(base), K))


@query(_ranked_sql(_L2, "asc"))
def ball_cell_topk(spark, sf_dir):
    base = _base(spark, sf_dir)
    return _shown(PrunedCells("ball").fit(base).search(_asked(base), K))


@query()
def annoy_search(spark, sf_dir):
    base = _base(spark, sf_dir)
    return _shown(PlaneForest(10, 4, 3).fit(base).search(_asked(base), K))


@query()
def hnsw_search(spark, sf_dir):
    """Graphs of about 2000 rows, as many as the table needs; recall is tested on a graph of that size."""
    base = _base(spark, sf_dir)
    return _shown(ProximityGraphs(16, 100, 64, rows=2000).fit(base).search(_asked(base), K))


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')"


@query(f"with w as (select doc_id, {_WORDS} as w from documents), c as (select doc_id, w, unnest(range(0, greatest((len(w) + 99) // 100, 1)))::int as chunk_index from w), t as (select doc_id, chunk_index, array_to_string(w[chunk_index * 100 + 1 : chunk_index * 100 + 100], ' ') as chunk from c) select doc_id as file_id, doc_id || '_chunk_' || chunk_index as chunk_id, chunk_index, length(chunk)::int as chunk_length, sha256(chunk) as chunk_hash from t")
def chunk_text(spark, sf_dir):
    out = chunked(_t(spark, sf_dir, "documents"), "doc_id")
    return out.select("file_id", "chunk_id", "chunk_index", "chunk_length", T.content_hash(F.col("chunk")).alias("chunk_hash"))


@query(f"select doc_id, sha256(array_to_string({_WORDS}, ' ')) as cleaned_hash from documents")
def clean_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.content_hash(T.cleaned(F.coalesce("text", F.lit("")))).alias("cleaned_hash"))


@query(f"select doc_id, length(coalesce(text, ''))::int as content_length, len({_WORDS})::int as word_count from documents")
def word_stats(spark, sf_dir):
    from vecsmith.sources.documents import text_metadata

    return text_metadata(_t(spark, sf_dir, "documents")).select("doc_id", "content_length", "word_count")


@query("select doc_id, sha256(text) as hash from documents")
def content_hash(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("select doc_id, lang, source from documents where lang is not distinct from 'en' and source is not distinct from 'src1'")
def metadata_filter(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(filters.equals({"lang": "en", "source": "src1"})).select("doc_id", "lang", "source")


@query("select d.doc_id, source, coalesce(quality, -1)::int as quality, coalesce(toxic, -1)::int as toxic from documents d left join labels l using (doc_id)")
def metadata_lookup_join(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "source")
    labels = _t(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_id")
    return enriched(docs, labels).select(F.col("file_id").alias("doc_id"), "source", F.coalesce(F.col("quality").cast("int"), F.lit(-1)).alias("quality"), F.coalesce(F.col("toxic").cast("int"), F.lit(-1)).alias("toxic"))


def _documents_kept(spark: SparkSession, sf_dir: str) -> tuple[Collections, DataFrame]:
    """A collection of one-dimensional vectors with the documents' metadata, and (vec_id, doc_id) of its rows."""
    docs, kept = _t(spark, sf_dir, "documents"), Collections(spark, scratch_dir(spark))
    kept.create("documents", 1)
    facts = F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    kept.insert("documents", docs.select(F.array(F.lit(0.0)).alias("vector"), facts.alias("metadata")))
    return kept, kept.rows("documents").select("vec_id", F.col("metadata")["doc_id"].cast("long").alias("doc_id"))


def _kept_rows(kept: Collections, *columns: str) -> DataFrame:
    m = F.col("metadata")
    return kept.rows("documents").select(m["doc_id"].cast("long").alias("doc_id"), *[F.try_element_at(m, F.lit(c)).alias(c) for c in columns])


@query("select d.doc_id, case when l.doc_id is null then d.source else 'q' || quality end as source from documents d left join labels l using (doc_id)")
def modify_replace(spark, sf_dir):
    kept, ids = _documents_kept(spark, sf_dir)
    facts = F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("source"), F.concat(F.lit("q"), F.col("quality").cast("string")))
    kept.modify("documents", ids.join(_t(spark, sf_dir, "labels"), "doc_id").select("vec_id", F.array(F.lit(1.0)).alias("vector"), facts.alias("metadata")))
    return _kept_rows(kept, "source")


@query("select d.doc_id, d.source, d.lang, coalesce(l.quality::varchar, '-') as quality from documents d left join labels l using (doc_id)")
def modify_merge(spark, sf_dir):
    kept, ids = _documents_kept(spark, sf_dir)
    new = ids.join(_t(spark, sf_dir, "labels"), "doc_id").select("vec_id", F.lit(None).alias("vector"), F.create_map(F.lit("quality"), F.col("quality").cast("string")).alias("metadata"))
    kept.modify("documents", new, merge=True)
    return _kept_rows(kept, "source", "lang", "quality").withColumn("quality", F.coalesce("quality", F.lit("-")))


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def delete_anti(spark, sf_dir):
    kept, ids = _documents_kept(spark, sf_dir)
    kept.delete("documents", ids.join(_t(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select("vec_id"))
    return _kept_rows(kept, "source")


def _collection_search(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    """Inserted, changed to inverted cells that are all probed, then searched through the collection."""
    base, kept = _base(spark, sf_dir), Collections(spark, scratch_dir(spark))
    kept.create("vectors", 64, metric)
    ordered = base.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    kept.insert("vectors", ordered.select(F.col("embedding").alias("vector"), F.create_map(F.lit("id"), F.col("vec_id").cast("string")).alias("metadata")))
    kept.optimize("vectors", 16, nprobe=16)
    found = kept.search("vectors", _asked(base).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), K)
    return _shown(found.withColumn("vec_id", F.col("metadata")["id"].cast("long")))


@query(_ranked_sql(_L2, "asc"))
def collection_l2_search(spark, sf_dir):
    return _collection_search(spark, sf_dir, "l2")


@query(_ranked_sql("list_inner_product(e, qe)", "desc"))
def collection_ip_search(spark, sf_dir):
    return _collection_search(spark, sf_dir, "ip")


_KINDS = "['txt', 'jpg', 'mp4', 'wav', 'exe']"


@query(f"select page_id, {_KINDS}[page_id % 5 + 1] as ext, ['text', 'image', 'video', 'audio', null][page_id % 5 + 1] as modality from pages")
def file_dispatch(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("TXT", "jpg", "mp4", "wav", "exe")])
    named = F.concat(F.col("url"), F.lit("/f."), F.get(kinds, (F.col("page_id") % 5).cast("int")))
    rows = _t(spark, sf_dir, "pages").select("page_id", T.extension(named).alias("ext"))
    return rows.select("page_id", "ext", T.processor(T.modality(F.col("ext"))).alias("modality"))


@query("select page_id, replace(regexp_extract(url, '[^/]*$'), '..', '') as name from pages")
def safe_names(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("select c_custkey, case when length(c_name) <= 12 then left(c_name, 4) || repeat('*', greatest(length(c_name) - 4, 0)) else left(c_name, 8) || repeat('*', length(c_name) - 12) || right(c_name, 4) end as masked from customer")
def mask_key(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", secure.masked(F.col("c_name")).alias("masked"))


@query("select doc_id, sha256(coalesce(text, '')) as hash, true as hidden from documents")
def aes_roundtrip(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = docs.withColumn("coded", secure.encrypted(F.col("text"), "a key"))
    back = secure.decrypted(F.col("coded"), "a key")
    return coded.select("doc_id", T.content_hash(back).alias("hash"), (F.col("coded") != F.col("text")).alias("hidden"))


_TRUTH = f"s as (select query_id, vec_id, {_L2} as score, list_inner_product(e, qe) as ip from q, v), t as (select *, row_number() over (partition by query_id order by score, vec_id) as rank, row_number() over (partition by query_id order by ip desc, vec_id) as got from s), h as (select query_id, count(*) filter (rank <= 10 and got <= 10) / 10.0 as hit, coalesce(sum(1 / log2(got + 1)) filter (rank <= 10 and got <= 10), 0) / (select sum(1 / log2(i + 1)) from range(1, 11) x(i)) as ndcg from t group by query_id), z as (select avg(hit) as recall, avg(hit) as precision, avg(ndcg) as ndcg from h)"


@query(f"with {_BASE}, {_TRUTH} select round(recall, 6) as recall, round(precision, 6) as precision, round(case when recall > 0 then recall else 0 end, 6) as f1, round(ndcg, 6) as ndcg from z")
def retrieval_quality(spark, sf_dir):
    base = _base(spark, sf_dir)
    got = evaluate.summary(knn(base, _asked(base), K, "ip"), knn(base, _asked(base), K, "l2"), K)
    return got.select(*[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1", "ndcg")])


_LONG = f"with {_BASE}, x as (select label, unnest(range(1, len(e) + 1)) - 1 as dim, unnest(e) as x from v)"


@query(f"{_LONG} select label, dim::int as dim, round(avg(x), 6) as mean from x group by all")
def mean_vector(spark, sf_dir):
    got = A.mean_vectors(_base(spark, sf_dir), ["label"])
    return got.select("label", F.posexplode("mean_vector").alias("dim", "mean")).select("label", "dim", F.round("mean", 6).alias("mean"))


@query(f"{_LONG} select label, dim::int as dim, round(var_pop(x), 6) as variance from x group by all")
def dim_variance(spark, sf_dir):
    return A.dimension_variance(_base(spark, sf_dir), ["label"]).select("label", "dim", F.round("variance", 6).alias("variance"))


@query(f"{_LONG}, m as (select label, dim, avg(x) as mean from x group by all), c as (select label, list(mean order by dim) as c from m group by label) select label, round(max(list_distance(e, c)), 6) as radius, count(*) as n from v join c using (label) group by label")
def cluster_radius(spark, sf_dir):
    return A.radii(_base(spark, sf_dir), ["label"]).select("label", F.round("radius", 6).alias("radius"), "n")


@query(f"with {_BASE}, p as (select vec_id, unnest(range(0, 8)) as part, e from v) select vec_id, part::int as part, round(list_sum(e[part * 8 + 1 : part * 8 + 8]) / 8, 6) as mean from p")
def pooled_vectors(spark, sf_dir):
    got = _base(spark, sf_dir).select("vec_id", F.posexplode(media.pooled(F.col("embedding"), 8, 8)).alias("part", "mean"))
    return got.select("vec_id", "part", F.round("mean", 6).alias("mean"))


@query("select conv_id, max(case when role = 'user' then n else 0 end) as user_turns, max(case when role = 'assistant' then n else 0 end) as assistant_turns from (select conv_id, role, count(*) as n from conversations group by all) group by conv_id")
def pivot_filled(spark, sf_dir):
    counts = A.sizes(_t(spark, sf_dir, "conversations"), ["conv_id", "role"])
    got = A.pivot_filled(counts, "conv_id", "role", "n", ["user", "assistant"])
    return got.select("conv_id", F.col("user").alias("user_turns"), F.col("assistant").alias("assistant_turns"))


@query("select source, lang, count(*) as calls, round(sum(n_chars), 3) as total_seconds, max(doc_id) as last_used from documents group by all")
def usage_stats(spark, sf_dir):
    return A.usage(_t(spark, sf_dir, "documents"), ["source", "lang"], "n_chars", "doc_id").withColumn("total_seconds", F.round(F.col("total_seconds").cast("double"), 3))


@query()
def process_documents(spark, sf_dir):
    """Chunk counts and the vector of each whole text, by the hashing embedder."""
    out = process_text(_t(spark, sf_dir, "documents"), "doc_id")
    return out.select(F.col("file_id").alias("doc_id"), F.size("chunks").alias("n_chunks"), F.round(D.norm("embedding"), 4).alias("norm"))


@query()
def text_knn(spark, sf_dir):
    """Text search: hashed vectors of all texts, queries by id, cosine."""
    docs = _t(spark, sf_dir, "documents")
    base = stored(docs.select(F.col("doc_id").alias("vec_id"), embedded(F.coalesce("text", F.lit(""))).alias("embedding")), "vectors")
    return _shown(knn(base, _asked(base), K, "cosine"))
