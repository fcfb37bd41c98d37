"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are quantised to floor(scale * x). Rows are cut into blocks of bounded size; a task sorts a block once per
dimension, and the queries stream past it, a few at a time. For a query it walks all lists downwards together, from the
end that the query's sign favours, scores every row it meets in full, and stops when the bound, the sum over
dimensions of the query times the last value seen, is below the k-th score: no row that it hasn't met can reach it,
nor tie with it. The blocks' k best rows are merged by a second top-k. Only while there are fewer blocks than tasks are
blocks repeated, each copy for a share of the queries.

Defined results: a vector that is null, empty, or holds a null or a non-finite component takes no part as query or
row; vectors of different length don't meet; ties go to the smaller id; rows that repeat the query's id are its own;
queries that share an id are one, with the best of all; fewer rows than k give all there are. Sums are exact integers
of any size and rank as such; a score beyond a long's range is given as the nearest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST = 2**63 - 1


def quantised(vec: Column, scale: float) -> Column:
    """floor(scale * x) of each component, a double of whole value; null where the vector takes no part."""
    scaled = F.transform(vec, lambda x: x.cast("double") * scale)
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Doubles from 2**52 are whole; floor would squeeze them into a long.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return F.when(F.coalesce(finite & (F.size(vec) > 0), F.lit(False)), whole)


def top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
    k: int = 5, scale: float = 256.0, rows_a_block: int = 16384, queries_a_block: int = 512, tasks: int | None = None,
) -> DataFrame:
    """query_id, rank (from 1), id, score: each query's k best rows among all others.

    ``queries_a_block`` queries are answered at a time; ``tasks`` (by default as many as shuffle partitions) are kept
    busy even where there are fewer blocks of rows.
    """
    base = vectors.select(F.col(id_col).alias("id"), quantised(F.col(vec_col), scale).alias("q"), is_query.alias("asks"))
    base = base.where("id is not null and q is not null").withColumn("dim", F.size("q"))
    blocks = max(1, -(-base.count() // rows_a_block))
    tasks = tasks or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, -(-tasks // blocks))
    deal = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")  # noqa: E731 - repeated rows too
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = base.withColumn("block", deal(blocks)).withColumn("share", every(shares)).withColumn("ask", F.lit(False))
    queries = base.where("asks").withColumn("share", deal(shares)).withColumn("block", every(blocks)).withColumn("ask", F.lit(True))
    columns = ["dim", "block", "share", "ask", "id", "q"]
    both = rows.select(columns).unionByName(queries.select(columns))
    met = both.repartitionById(blocks * shares, F.col("block") * shares + F.col("share")).sortWithinPartitions("dim", "block", "share", "ask")
    id_type = dict(base.dtypes)["id"]
    best = met.mapInArrow(_search(k, queries_a_block), f"query_id {id_type}, id {id_type}, score bigint, beyond binary")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole values: as doubles where these are exact, else as Python's integers."""
    if exact:
        return x @ q
    q = [int(v) for v in q.tolist()]
    out = np.empty(len(x), object)
    out[:] = [sum(int(a) * b for a, b in zip(row, q, strict=True)) for row in x.tolist()]
    return out


def kth_largest(scores: np.ndarray, k: int):
    if scores.dtype == object:
        return heapq.nlargest(k, scores.tolist())[-1]
    return np.partition(scores, len(scores) - k)[len(scores) - k]


def threshold_search(x: np.ndarray, ids: np.ndarray, up: np.ndarray, q: np.ndarray, own, k: int, top: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, scores, depth) of the query's k best rows; up: per dimension, row positions by rising value; top: the
    largest magnitude in x."""
    n = len(x)
    top = float(np.abs(x).max(initial=0)) if top is None else top
    exact = top * float(np.abs(q).max(initial=0)) * len(q) < 2.0**53
    dims = np.flatnonzero(q)
    scores, met, depth, block = np.full(n, -np.inf, np.float64 if exact else object), ids == own, 0, 16
    while True:
        to = min(n, depth + block)
        if len(dims):
            rising = q[dims] < 0
            part = np.where(rising[None, :], up[depth:to, dims], up[n - to : n - depth, dims][::-1])
            seen = np.zeros(n, bool)
            seen[part.ravel()] = True
            bound = products(x[part[-1], dims][None, :], q[dims], exact)[0]
        else:
            to, seen, bound = n, np.ones(n, bool), 0
        new = np.flatnonzero(seen & ~met)
        scores[new] = products(x[new], q, exact)
        met[new] = True
        depth, block = to, block * 2
        if depth == n or met.all():  # in many dimensions the lists show every row long before their ends
            break
        if met.sum() > k and bound < kth_largest(scores, k):
            break
    known = np.flatnonzero(scores > -np.inf)
    if len(known) > k:
        known = known[scores[known] >= kth_largest(scores[known], k)]
    best = np.array(sorted(known.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return best, scores[best], depth


def as_long(score: int) -> tuple[int, bytes | None]:
    """(the nearest long, for scores beyond it bytes that sort as the scores do)."""
    if -LONGEST <= score <= LONGEST:
        return score, None
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return (LONGEST, raw) if score > 0 else (-LONGEST - 1, bytes(255 - b for b in raw))


def _matrix(parts: list[pa.RecordBatch], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors)."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    ids = np.concatenate([np.asarray(p.column(4)) for p in parts])
    return ids, np.concatenate([np.asarray(p.column(5).flatten()).reshape(-1, dim) for p in parts])


def _search(k: int, at_once: int):
    def answers(x: np.ndarray, x_ids: np.ndarray, up: np.ndarray, top: float, asked: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        kind = asked.schema.field(4).type
        owns, hits, scores, beyond = [], [], [], []
        for own, q in zip(*_matrix([asked], dim), strict=True):
            best, found, _ = threshold_search(x, x_ids, up, q, own, k, top)
            owns += [own] * len(best)
            hits += x_ids[best].tolist()
            for score, rest in (as_long(int(s)) for s in found):
                scores.append(score)
                beyond.append(rest)
        return pa.RecordBatch.from_arrays([pa.array(owns, kind), pa.array(hits, kind), pa.array(scores, pa.int64()), pa.array(beyond, pa.binary())], ["query_id", "id", "score", "beyond"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, block = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i).cast(pa.int32())) for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                *here, ask = keys[first].tolist()
                if here != where:
                    where, held, block = here, [], None
                part = batch.slice(first, last - first)
                if not ask:
                    held.append(part)
                    continue
                if block is None:  # all of the block's rows come before its queries
                    ids, x = _matrix(held, here[0])
                    block, held = (x, ids, np.argsort(x, axis=0, kind="stable"), float(np.abs(x).max(initial=0))), []
                if len(block[0]):
                    for at in range(0, part.num_rows, at_once):
                        yield answers(*block, part.slice(at, at_once), here[0])

    return run
