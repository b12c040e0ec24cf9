"""The queries of this subpackage: ``opN_<name>(spark, sf_dir)``, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecsmith.llm.warc import read_warc, write_warc

    folder = write_warc(_table(spark, sf_dir, "pages"))
    return read_warc(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecsmith.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecsmith.llm.topk_search import topk_search

    base = _table(spark, sf_dir, "embeddings")
    return topk_search(base, base.where(F.pmod("vec_id", F.lit(50)) == 0))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecsmith.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecsmith.llm.language_id import held_out, identify, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecsmith.llm.substring_dedup import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecsmith.llm.token_files import read_token_files, write_token_files

    folder = write_token_files(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecsmith.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecsmith.llm.jaccard_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecsmith.llm.token_counts import token_prefixes

    return token_prefixes(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_files": op5_token_files,
    "op6_packing": op6_packing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_token_counts": op8_token_counts,
    "op9_topk_search": op9_topk_search,
    "op10_mixing": op10_mixing,
}

ORACLES = {
    "op1_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
m as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from m""",
    "op2_exact_dedup": """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)""",
    "op4_substring_dedup": """
with t as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
a as (select r, list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i : i + 34], ' '))) as hs from t where len(w) >= 35),
h as (select r, unnest(hs) as h, unnest(range(1, len(hs) + 1)) as i from a),
d as (select r, i from (select r, i, count(*) over (partition by h) as n from h) where n > 1),
g as (select distinct r, unnest(range(i, i + 35)) as i from d),
x as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from t),
k as (select x.r, string_agg(word, ' ' order by x.i) filter (g.i is null) as kept, count(g.i) as gone from x left join g on x.r = g.r and x.i = g.i group by x.r)
select doc_id, len(w)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from t left join k using (r)""",
    "op7_jaccard_join": """
with recursive t as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) between 1 and 3 then [array_to_string(w, ' ')] else list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i : i + 3], ' ')) end)) as h from t),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * i >= 85 * (a.n + b.n - i)),
r as (select doc_id as x, doc_id as y from t union select r.x, l.y from r join l on r.y = l.x)
select doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.y) as component_id from t left join n using (doc_id) join r on r.x = doc_id group by doc_id""",
    "op9_topk_search": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q::double[], b.q::double[])::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5""",
}
