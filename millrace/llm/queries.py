"""The queries ``opN_<name>``: each numbered operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, language_id, packing, perspectives, piece_codec, quality, resampling, secret_scan, simhash_dedup, substring_dedup, threshold_topk, toxicity, whitening
from ._common import make_importable, table


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_report(table(spark, sf_dir, "documents"), width=35)


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.report(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.report(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), scale=64.0, shift=1_000_000, most=16)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampling.resample(documents, target, buckets=10_000, longest=1, share=(10, 100), least_words=20, seed="2024")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            make_importable(spark)
            return query(spark, sf_dir)

        return run

    every = (
        op1_embedding_dedup, op2_threshold_topk, op3_substring_dedup, op4_piece_codec, op5_perspectives,
        op6_toxicity, op7_language_id, op8_quality, op9_simhash_dedup, op10_packing,
        op11_whitening, op12_resampling, op13_secret_scan,
    )
    return {q.__name__: ready(q) for q in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op2_threshold_topk": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op5_perspectives": perspectives.ORACLE_SQL, "op12_resampling": resampling.ORACLE_SQL, "op13_secret_scan": secret_scan.oracle_sql()}


OP1_SQL = """
with recursive good as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as materialized (
  select a.vec_id as a, b.vec_id as b from good a join good b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), named as (
  select a, min(b) as least from reach group by a
), counted as (
  select a, count(*) as n from links group by a
)
select e.vec_id, coalesce(c.n, 0) as n_links, least(e.vec_id, coalesce(n.least, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(n.least, e.vec_id)) as kept
from embeddings e left join counted c on e.vec_id = c.a left join named n on e.vec_id = n.a
"""

OP2_SQL = """
with q as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as query_id, b.vec_id, cast(list_dot_product(list_transform(a.v, lambda x: cast(x as double)), list_transform(b.v, lambda x: cast(x as double))) as bigint) as score
  from q a join q b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

OP3_SQL = r"""
with split as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), starts as (
  select r, words, unnest(range(1, len(words) - 33)) as i from split where len(words) >= 35
), windows as (
  select r, i, md5(array_to_string(words[i:i + 34], ' ')) as w from starts
), often as (
  select w from windows group by w having count(*) > 1
), hits as (
  select r, list(i) as found from windows where w in (select w from often) group by r
), gone as (
  select r, list_distinct(flatten(list_transform(found, lambda i: range(i, i + 35)))) as at from hits
), kept as (
  select s.doc_id, s.words, coalesce(len(g.at), 0) as n_removed,
    case when g.at is null then s.words else list_transform(list_filter(list_zip(s.words, range(1, len(s.words) + 1), list_transform(range(1, len(s.words) + 1), lambda i: list_contains(g.at, i))), lambda x: not x[3]), lambda x: x[1]) end as stay
  from split s left join gone g using (r)
)
select doc_id, cast(len(words) as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(array_to_string(stay, ' ')) as kept_sha256 from kept
"""
