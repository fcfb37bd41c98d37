"""Embedding near-duplicates, top-k and SimHash against brute force."""

import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup, simhash_dedup, threshold_topk
from millrace.llm._common import connected_components

VECTORS = "vec_id long, embedding array<float>, label int"


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def clouds(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    return [(i, [float(x) for x in (centres[i % 6] + spread * rng.standard_normal(dim)).astype(np.float32)], int(i % 3)) for i in range(n)]


def near_by_hand(rows, threshold):
    """Row by row: rows that share an id are different vectors."""
    good = [(at, np.array(v, float), c) for at, (i, v, c) in enumerate(rows) if i is not None and v and c is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v, float))]
    links = [(a[0], b[0]) for x, a in enumerate(good) for b in good[x + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / math.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= threshold]
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    root = roots(range(len(rows)), links)
    least = {}
    for at, r in root.items():
        least[r] = min(least.get(r, rows[at][0]), rows[at][0])
    return sorted((i, count[at], least[root[at]], least[root[at]] == i) for at, (i, *_) in enumerate(rows))


@pytest.mark.parametrize(("tile", "spread"), [(4096, 0.25), (7, 0.25), (16, 0.05)])
def test_near_duplicates(spark, tile, spread):
    rows = clouds(1, 150, 16, spread)
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in (3, 3, 9)]  # copies, one with the id of another
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, rows[0][1], None), (2005, [1.0, 2.0], 0), (2006, [None] + [1.0] * 15, 1), (2007, [float("inf")] + [1.0] * 15, 1), (2008, [x * 1e30 for x in rows[0][1]], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), tile=tile)
    assert sorted(map(tuple, got.collect())) == near_by_hand(rows, 0.93)


def test_near_duplicates_of_nothing(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []
    one = embedding_dedup.near_duplicates(spark.createDataFrame([(5, [1.0, 0.0], 1)], VECTORS).withColumn("id", F.lit("x")).withColumn("block", F.lit(9)))
    assert [tuple(r) for r in one.collect()] == [(5, 0, 5, True)]


def top_by_hand(rows, every, k, scale):
    good = {i: np.floor(np.array(v, np.float64) * scale).astype(np.int64) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    out = []
    for q in (i for i in good if i % every == 0):
        scores = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize(("rows_a_block", "queries_a_block"), [(16384, 512), (20, 3)])
def test_top_k(spark, rows_a_block, queries_a_block):
    rows = [(i, [float(np.float32(round(x, 1))) for x in v], c) for i, v, c in clouds(2, 120, 8, 0.5)]  # rounded: many ties
    rows += [(200, None, 0), (201, [float("nan")] * 8, 0), (202, [0.0] * 8, 0), (203, [1.0], 0), (204, rows[4][1], 0), (200 + 50, [], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = threshold_topk.top_k(df, F.col("vec_id") % 4 == 0, k=5, rows_a_block=rows_a_block, queries_a_block=queries_a_block)
    assert sorted(map(tuple, got.collect())) == top_by_hand(rows, 4, 5, 256.0)


def test_top_k_stops_early_and_handles_few_rows(spark):
    rng = np.random.default_rng(0)
    x = np.abs(rng.standard_normal((4000, 4))) ** 6 // 0.001
    up = np.argsort(x, axis=0, kind="stable")
    best, scores, depth = threshold_topk.threshold_search(x, np.arange(4000), up, np.ones(4), -1, 3)
    assert depth < 4000 and list(best) == list(np.lexsort((np.arange(4000), -x.sum(axis=1)))[:3])
    few = threshold_topk.top_k(spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], VECTORS), F.lit(True))
    assert sorted(map(tuple, few.collect())) == [(0, 1, 1, 131072), (1, 1, 0, 131072)]
    assert threshold_topk.top_k(spark.createDataFrame([], VECTORS), F.lit(True)).collect() == []


def test_top_k_of_values_of_any_size(spark):
    rng = np.random.default_rng(8)
    sizes = [1e8, 1e8, 1.0, 3e38, -3e38, 1e20, -1e20, 2.0**40, 1e-3]
    rows = [(i, [float(np.float32(s * x)) for x in rng.uniform(-1, 1, 4)], 0) for i, s in enumerate(sizes * 4)]
    rows += [(100, [1e8, 0.0, 0.0, 0.0], 0), (101, [1e8, 0.0, 0.0, 0.0], 0), (None, [3e38] * 4, 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"id": F.lit("x"), "q": F.lit(1), "block": F.lit(2), "score": F.lit(3)})
    good = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows if i is not None}
    want = []
    for q, a in good.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q)[:5]
        want += [(q, r, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scores, 1)]
    for block in (16384, 7):
        got = threshold_topk.top_k(df, F.lit(True), rows_a_block=block, queries_a_block=3)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_of_repeated_rows(spark):
    rows = [(0, [1.0, 0.0], 0)] * 3 + [(7, [2.0, 1.0], 0)] * 50
    got = threshold_topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0, rows_a_block=10)
    assert sorted(map(tuple, got.collect())) == [(0, r, 7, 131072) for r in range(1, 6)]


def fingerprint_by_hand(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(12)]
    texts = [*base, *base[:4], *(b + f" extra{i}" for i, b in enumerate(base)), *(b.replace("w1", "W1") for b in base), None, "", "  \t ", "one two", "É é", "a b c d", "x " * 3000, "naïve word \x1f sep"]
    pairs = list(enumerate(texts, 100))
    fps = {i: fingerprint_by_hand(t) for i, t in pairs}
    links = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 4]
    assert any(fps[i] != fps[j] and fps[i].bit_count() != fps[j].bit_count() for i, j in links)
    root = roots(fps, links)
    for block in (32768, 4):
        got = simhash_dedup.report(docs(*pairs), block=block)
        assert sorted(map(tuple, got.collect())) == sorted((i, f"{fp:016x}", root[i]) for i, fp in fps.items())
    kept = simhash_dedup.one_of_each(docs(*pairs))
    assert kept.columns == docs(*pairs).columns and sorted(r.doc_id for r in kept.collect()) == sorted({*root.values()})


def test_simhash_finds_all_close_random_fingerprints():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    close = np.array([int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b, i, j in zip(base, rng.integers(0, 64, 200), rng.integers(0, 64, 200))], np.uint64)
    every = np.unique(np.concatenate([base, close]))
    at, least = simhash_dedup.linked_in_tile(every, None, 4, step=16)
    want = {int(x): min(int(y) - (1 << 64) * (int(y) >> 63) for y in every if (int(x) ^ int(y)).bit_count() <= 4) for x in every if sum((int(x) ^ int(y)).bit_count() <= 4 for y in every) > 1}
    assert set(at.view(np.uint64).tolist()) == set(want)
    assert all(m <= want[int(a)] for a, m in zip(at.view(np.uint64), least))


def test_simhash_of_nothing_and_null_ids(docs):
    assert simhash_dedup.report(docs()).collect() == []
    got = simhash_dedup.report(docs((None, "a b c d e"), (4, "a b c d e"), (None, None)))
    assert sorted(map(str, (r.component_id for r in got.collect()))) == ["4", "4", "None"]


def test_one_of_each_with_null_and_repeated_ids(docs):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (1, c), (1, d), (2, d), (None, c), (1, c), (None, b)]
    got = [(r.doc_id, r.text) for r in simhash_dedup.one_of_each(docs(*rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (1, c), (1, d)], key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}
