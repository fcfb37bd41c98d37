"""Inverted files and postings against scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.plans import postings, search, vector_index

VECTORS = "vec_id long, embedding array<float>"


def files_read(df):
    """How many files the scan of ``df`` opened."""
    df._jdf.collectToPython()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().get("numFiles").get().value()


def clouds(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim))
    return [(i, [float(v) for v in (centres[i % 20] + 0.4 * rng.standard_normal(dim)).astype(np.float32)]) for i in range(n)]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = clouds(3000, 16, 1)
    rows += [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0]), (5005, rows[0][1]), (None, rows[40][1])]
    df = spark.createDataFrame(rows, VECTORS).repartition(4).withColumn("id", F.lit("x")).withColumn("cell", F.lit(1))
    return df, vector_index.build(df, "vec_id", "embedding", str(tmp_path_factory.mktemp("v") / "index"), cells=40)


def test_every_row_is_indexed_and_exact_search_is_the_scan(indexed):
    df, index = indexed
    assert index.vectors.count() == df.count() == index.sizes.sum() + 5
    for k in (0, 7, 123):
        vector = df.where(F.col("vec_id") == k).first()["embedding"]
        want = [tuple(r) for r in search.nearest(df, vector, "vec_id", "embedding", 25, 0.8).collect()]
        cells = index.cells_for(vector, 25, 2, exact=True)
        got = index.search(vector, 25, probes=2, most=0.8, exact=True)
        assert [tuple(r) for r in got.collect()] == want
        # Only the cells' files are read.
        files, of = files_read(index.rows(cells)), len(index.vectors.inputFiles())
        assert len(cells) < len(index.cells) and files < of


def test_probes_recall(indexed):
    df, index = indexed
    queries = df.where(F.col("vec_id") % 100 == 0).select("vec_id", "embedding")
    asked = index.search_many(queries, "vec_id", "embedding", 10, probes=6)
    got = {(r["query_id"], r["id"]) for r in asked.collect()}
    want = set()
    for r in queries.where("size(embedding) = 16").collect():
        if r["vec_id"] not in (5000,):
            want |= {(r["vec_id"], x["vec_id"]) for x in search.nearest(df, r["embedding"], "vec_id", "embedding", 10).collect()}
    assert len(got & want) >= 0.9 * len(want) and max(r["rank"] for r in asked.collect()) == 10


def test_index_of_nothing(spark, tmp_path):
    index = vector_index.build(spark.createDataFrame([], VECTORS), "vec_id", "embedding", str(tmp_path / "none"))
    assert index.search([1.0, 2.0], 5).collect() == [] == index.search([1.0], 5, exact=True).collect()
    one = vector_index.build(spark.createDataFrame([(1, [1.0, 0.0])], VECTORS), "vec_id", "embedding", str(tmp_path / "one"))
    assert [tuple(r) for r in one.search([2.0, 0.0], 5, exact=True).collect()] == [(1, 0.0)]
    with pytest.raises(ValueError):
        one.search([1.0], 5)


def texts(seed, n):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "Énergie", "x1"], [f"w{i}" for i in range(300)]
    return [(i, " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(rng.choice([0, 3, 20, 200])))) for i in range(n)]


@pytest.fixture(scope="module")
def posted(spark, tmp_path_factory):
    rows = texts(2, 700)
    rows += [(1000, None), (1001, ""), (1002, "the of and " * 3000), (5, rows[5][1]), (None, "the of zebra"), (1003, "THE, of-and; énergie!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"id": F.lit("x"), "token": F.lit(1), "block": F.lit(2)})
    return df, postings.build(df, "doc_id", "text", str(tmp_path_factory.mktemp("p") / "index"), width=16, buckets=4)


@pytest.mark.parametrize(("query", "how"), [("the of", "all_tokens"), ("énergie w7", "any_tokens"), ("w1 w2 w3", "any_tokens"), ("the nowhere", "all_tokens"), ("the nowhere", "any_tokens"), ("zebra", "all_tokens")])
def test_postings_give_what_the_scan_gives(posted, query, how):
    df, index = posted
    scan = [(r["doc_id"], round(r["score"], 9)) for r in search.bm25(df, query, "doc_id", "text", how).collect()]
    every = [(r["id"], round(r["score"], 9)) for r in index.search(query, None, how).collect()]
    assert sorted(every, key=repr) == sorted(scan, key=repr)
    for limit in (1, 10):
        best = sorted(scan, key=lambda x: (-x[1], x[0] is not None, x[0] or 0))[:limit]
        assert [(r["id"], round(r["score"], 9)) for r in index.search(query, limit, how, first_blocks=2).collect()] == best


def test_blocks_are_skipped_and_only_the_tokens_are_read(posted):
    _, index = posted
    found, counts = index.explained("zebra w7", 1, "any_tokens", first_blocks=1)
    assert counts["scored"] < counts["with_tokens"] <= counts["blocks"]
    assert files_read(index.rows(["zebra"])) == 1 < len(index.table.inputFiles())
    with pytest.raises(ValueError):
        index.search("!!")
    with pytest.raises(ValueError):
        index.search("the of", how="phrase")


def test_postings_of_nothing(spark, tmp_path):
    for rows in ([], [(1, None)]):
        index = postings.build(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", str(tmp_path / f"p{len(rows)}"))
        assert index.search("the", 5).collect() == [] == index.search("the").collect()
