"""Registered queries of written indexes: semantic search by cell, lexical search by postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import NEAREST_SQL, TOKENS_SQL, _distance, _query_vector
from .plans import postings, vector_index
from .registry import Tables, query
from .session import fresh_path, removed, stashed


def answered(df, name: str, path: str):
    """An index's answer, written, and the index deleted, as nothing asks it again."""
    out = stashed(df, name)
    removed(df.sparkSession, path)
    return out


@query(f"with n as ({NEAREST_SQL}) select * from n where distance <= 0.9")
def semantic_index_topk(t: Tables):
    """The nearest vectors from an inverted file: cells that can't hold one of them aren't read."""
    path = fresh_path(t.spark, "vectors")
    index = vector_index.build(t.embeddings, "vec_id", "embedding", path)
    found = index.search(_query_vector(t), 100, exact=True).select(F.col("id").alias("vec_id"), "distance").withColumn("distance", _distance())
    return answered(found.where("distance <= 0.9"), "nearest", path)


def bm25_sql(words: list[str], how: str, limit: int) -> str:
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) as f{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) filter (where f{i} > 0) as d{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (d - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / a))" for i in range(len(words)))
    hit = (" and " if how == "all_tokens" else " or ").join(f"f{i} > 0" for i in range(len(words)))
    return f"""
with t as (select doc_id, {TOKENS_SQL} as t from documents), f as (select doc_id, len(t) as n, {counts} from t),
s as (select count(*) as d, avg(n) as a, {df} from f),
scored as (select doc_id, round({score}, 12) as score from f, s where {hit} order by 2 desc, 1 limit {limit})
select doc_id, round(score, 6) as score from scored
"""


def _top(t: Tables, text: str, how: str, limit: int):
    path = fresh_path(t.spark, "postings")
    found = postings.build(t.documents, "doc_id", "text", path).search(text, limit, how)
    return answered(found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")), "top", path)


@query(bm25_sql(["the", "and", "of"], "all_tokens", 100))
def lexical_postings_all(t):
    """The best documents that have all tokens, from postings with block maxima."""
    return _top(t, "the and of", "all_tokens", 100)


@query(bm25_sql(["les", "und", "the"], "any_tokens", 50))
def lexical_postings_any(t):
    """The best documents that have any token."""
    return _top(t, "les und the", "any_tokens", 50)
