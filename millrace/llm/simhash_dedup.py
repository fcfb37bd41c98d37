"""SimHash near-duplicates by tiled exact comparison.

A fingerprint's bits are the majorities over the 64-bit hashes of a text's word shingles. Distinct
fingerprints are laid out in blocks by population count. Two fingerprints within ``radius`` bits differ in
population count by at most ``radius``, so only blocks that close are paired; within a pair of blocks the
same holds for the two halves of the fingerprints together, which skips most sub-tiles. What is left is
compared exactly, by exclusive-or and bit counts in numpy.

A tile sends, for each fingerprint with links in it, the least one connected to it in the tile, never
its pairs; components are joined over distinct fingerprints. Blocks have a bounded size whatever the
table's: a population count with many fingerprints is cut into more blocks. Exact copies share one
fingerprint, counted before any shuffle.

The tiles compare all fingerprints, so their work grows with the square of the number of distinct
fingerprints: the method trades that for a result without misses.

Defined results: a null or empty text has fingerprint zero and links like any other; a text of fewer words
than a shingle is one shingle; only A-Z are lower-cased; a null id is never a component's name unless all of
its ids are null; repeated rows are members like others. Of each component one row is kept, whatever its id: rows
with a null id and rows that share an id go only when their texts do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, in_small_batches, join_roots, slices, stash


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for first in range(0, n, 65536):
        counts += np.unpackbits(h[first : first + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str | Column, text_col: str, shingle: int = 4) -> DataFrame:
    """(id, fp) for every row, as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select((F.col(id_col) if isinstance(id_col, str) else id_col).alias("id"), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp bigint")


def linked_in_tile(left: np.ndarray, right: np.ndarray | None, radius: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints with links, least one connected in this tile); right None: pairs within left."""
    half = np.uint64(0xFFFFFFFF)
    fps = left if right is None else np.concatenate([left, right])
    low = np.bitwise_count(fps & half).astype(np.int64)
    high = np.bitwise_count(fps).astype(np.int64) - low
    order = np.argsort(low, kind="stable")
    l_at = order[order < len(left)]
    r_at = l_at if right is None else order[order >= len(left)]
    r_fps, r_low, r_high = fps[r_at], low[r_at], high[r_at]
    parent, least = np.arange(len(fps)), None
    touched = np.zeros(len(fps), bool)
    for first in range(0, len(l_at), step):
        at = l_at[first : first + step]
        a, b = np.searchsorted(r_low, low[at[0]] - radius), np.searchsorted(r_low, low[at[-1]] + radius, side="right")
        # Population counts of both halves bound the distance from below.
        near = np.maximum(np.maximum(low[at[0]] - r_low[a:b], r_low[a:b] - low[at[-1]]), 0) + np.maximum(np.maximum(high[at].min() - r_high[a:b], r_high[a:b] - high[at].max()), 0) <= radius
        cols = np.flatnonzero(near) + a
        for c in range(0, len(cols), 8192):
            col = cols[c : c + 8192]
            i, j = np.nonzero(np.bitwise_count(fps[at][:, None] ^ r_fps[col][None, :]) <= radius)
            i, j = at[i], r_at[col[j]]
            apart = i != j
            i, j = i[apart], j[apart]
            if len(i):
                touched[i] = touched[j] = True
                parent = join_roots(parent, i, j)
    has = np.flatnonzero(touched)
    signed = fps.view(np.int64)
    least = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(least, parent, signed)
    return signed[has], least[parent[has]]


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, block: int = 32768) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``; component_id is the least id reachable by links."""
    ids = stash(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = least_of_components(ids.groupBy("fp").agg(F.min("id").alias("least")), radius, block)
    named = named.select("fp", F.col("least").alias("component_id"))
    return ids.join(named, "fp").select("id", "fp", "component_id")


def least_of_components(fingerprints: DataFrame, radius: int = 4, block: int = 32768) -> DataFrame:
    """(fp, root, least) of distinct fingerprints ``(fp, least)``: each one's component and the least of its members."""
    distinct = stash(fingerprints, "distinct")
    ones = F.bit_count("fp").cast("int")
    sizes = {p: -(-n // block) for p, n in distinct.groupBy(ones.alias("p")).count().collect()}  # 65 rows at most
    chunks = F.create_map(*(F.lit(x) for p in range(65) for x in (p, int(sizes.get(p, 1)))))
    blocks = distinct.withColumn("p", ones).groupBy("p", F.pmod(F.xxhash64("fp"), chunks[F.col("p")]).cast("int").alias("c")).agg(F.collect_list("fp").alias("fps"))
    blocks = stash(blocks, "blocks")
    # Each block meets itself, later blocks of its own count, and blocks of the next ``radius`` counts.
    def at(d: int):
        """The blocks of the population count ``d`` higher; a lambda's second argument would be Spark's index."""
        return F.transform(F.sequence(F.lit(0), chunks[F.least(F.col("p") + d, F.lit(64))] - 1), lambda c: F.struct((F.col("p") + d).alias("p"), c.alias("c")))

    meets = [at(d) for d in range(radius + 1)]
    pairs = blocks.select("p", "c", "fps", F.explode(F.flatten(F.array(*meets))).alias("to")).where("to.p <= 64 and (to.p > p or to.c >= c)")
    other = blocks.select(F.struct("p", "c").alias("to"), F.col("fps").alias("others"))
    n = max(1, sum(sizes.get(p, 0) * sum(sizes.get(p + d, 0) for d in range(radius + 1)) for p in sizes))
    tiles = pairs.join(other, "to").select((F.struct("p", "c") == F.col("to")).alias("self"), "fps", "others", F.xxhash64("p", "c", "to").alias("tile")).repartition(min(n, 10_000), "tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                left, right = (np.asarray(batch.column(k)[row].values).view(np.uint64) for k in (1, 2))
                fps, roots = linked_in_tile(left, None if batch.column(0)[row].as_py() else right, radius)
                yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(roots)], ["a", "b"])

    edges = tiles.select("self", "fps", "others").mapInArrow(compare, "a bigint, b bigint")
    roots = connected_components(edges)
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("least"))
    return named.drop("least").join(names, "root").select("fp", "root", "least")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, block: int = 32768) -> DataFrame:
    """One row, all columns, of each component of ``docs``: that of the least id, nulls last, then of the least text hash.

    Rows are told apart by id and 128 bits of their text, so rows with a null or repeated id stand for themselves."""
    keys = [F.xxhash64(text_col).alias("_k1"), F.xxhash64(F.lit(1), text_col).alias("_k2")]
    rows = docs.withColumns({"_k1": keys[0], "_k2": keys[1]})
    prints = with_fingerprints(rows, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "_k1", "_k2"), text_col, shingle)
    least = least_of_components(prints.groupBy("fp").agg(F.min("id").alias("least")), radius, block)
    kept = least.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias("_id"), F.col("least._k1").alias("_kept1"), F.col("least._k2").alias("_kept2"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_k1") == F.col("_kept1")) & (F.col("_k2") == F.col("_kept2"))
    return rows.join(kept, same, "left_semi").dropDuplicates([id_col, "_k1", "_k2"]).drop("_k1", "_k2")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every document."""
    return components(docs, **options).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
