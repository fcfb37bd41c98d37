"""Importance resampling of documents towards a target's distribution of hashed features.

Documents become blocks of a sparse matrix, a row for each document and a column for each bucket of features, kept
as CSR arrays in a written table: texts are read and cut once. Column sums of the blocks, of the documents and of
the target alike, are the two distributions; the matrix times the vector of gains gives each document's weight.
A draw without replacement proportional to the weights is a top-k of weight plus Gumbel noise, which comes from a
hash of the id, so that it is the same at every run.

A block holds the documents of about 4 MB of text, and a document has one entry a bucket at most, so a block's size is
bounded. Each block is a row group of its own, so tasks hold one at a time, however many a file has. Ranks come from ranges: rows are dealt by range of the order and written, and a row's rank is its place in
its range plus the sizes of the ranges before.

Defined results: a null or empty text, or one without words, has no features and the weight 0; a null id is drawn with
the noise of the empty id, and rows that repeat an id are documents of their own, ranked next to each other by where they lie
if all else is equal; without a target's text gains come from the smoothing alone; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Words, drop_stash, in_small_batches, stash, worded

#: Bytes of text whose documents make a block.
BLOCK = 4_000_000

#: Lower-cases A-Z and turns all other ASCII but letters and digits into spaces.
WORDS = bytes(i if i > 127 else ord(chr(i).lower()) if chr(i) in string.ascii_letters + string.digits else 32 for i in range(256))


def plain(texts: pa.Array) -> pa.Array:
    """An array of strings with its bytes translated by ``WORDS``, which leaves lengths as they are."""
    valid, offsets, data = texts.fill_null("").buffers()
    data = pa.py_buffer(data.to_pybytes().translate(WORDS)) if data is not None else data
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, data], offset=texts.offset)


def features(words: Words, longest: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(document, number among the distinct features, the distinct features) of all runs of 1 to ``longest`` words."""
    lengths = np.diff(words.offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    own = words.distinct.cast(pa.binary()).to_pylist()
    rows, codes, names = [row], [words.codes.astype(np.int64)], list(own)
    left = words.offsets[1:][row] - np.arange(len(row)) if len(row) else row  # words from here to the document's end
    before = words.codes.astype(np.int64)
    for size in range(2, longest + 1):
        start = np.flatnonzero(left >= size)
        if not len(start):
            break
        # A run is named by its beginning's number and its last word.
        pairs = np.stack([before[start], words.codes[start + size - 1]], axis=1)
        found, at = np.unique(pairs, axis=0, return_inverse=True)
        rows.append(row[start])
        codes.append(at.ravel() + len(names))
        before = np.full(len(row), -1, np.int64)
        before[start] = codes[-1]
        names += [names[a] + b" " + own[b] for a, b in found.tolist()]
    return np.concatenate(rows), np.concatenate(codes), names


def csr_blocks(docs: DataFrame, id_col: str, text_col: str, buckets: int, longest: int) -> DataFrame:
    """The matrix in blocks of rows: ids, n_words and n_features by document, where each one's entries end, their buckets and counts."""
    rows = in_small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = (pa.RecordBatch.from_arrays([b.column(0), plain(b.column(1))], ["id", "text"]) for b in batches)
        for some, words in worded(clean, "text", most):
            row, code, names = features(words, longest)
            bucket = np.fromiter((zlib.crc32(n) % buckets for n in names), np.int64, len(names))
            entry, counts = np.unique(row * buckets + bucket[code], return_counts=True)
            n = some.num_rows
            ends = np.searchsorted(entry, (np.arange(n) + 1) * buckets)
            one = lambda x, kind: pa.array([x.astype(kind)], pa.list_(pa.from_numpy_dtype(kind)))
            ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), some.column(0))
            yield pa.RecordBatch.from_arrays(
                [ids, one(np.diff(words.offsets), np.int64), one(np.bincount(row, minlength=n), np.int64), one(ends, np.int32), one(entry % buckets, np.int32), one(counts, np.int32)],
                ["ids", "n_words", "n_features", "ends", "buckets", "counts"],
            )

    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    kinds = {"ids": T.ArrayType(rows.schema["id"].dataType), "n_words": longs, "n_features": longs, "ends": ints, "buckets": ints, "counts": ints}
    return rows.mapInArrow(run, T.StructType([T.StructField(k, v) for k, v in kinds.items()]))


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """By bucket, how many features all documents have; a task sends a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, n = (np.asarray(batch.column(k).flatten()) for k in range(2))
            total += np.bincount(at, n, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    parts = blocks.select("buckets", "counts").mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():  # a row for each bucket at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, by bucket."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features and weight by document: the matrix times the gains."""
    kind = blocks.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words, n, ends, at, counts = (batch.column(c).slice(k, 1).flatten() for c in range(6))
                ends = np.asarray(ends).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(gain[np.asarray(at)] * np.asarray(counts))])
                weight = upto[ends] - upto[np.concatenate([[0], ends[:-1]])]
                yield pa.RecordBatch.from_arrays([ids, words, n, pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    fields = [T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))]
    return blocks.select("ids", "n_words", "n_features", "ends", "buckets", "counts").mapInArrow(run, T.StructType(fields))


def noise(id_col: str, seed: str):
    """floor(1000 Gumbel) of the id: the same for the same id and seed everywhere."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list, share: tuple[int, int], able) -> DataFrame:
    """``rank`` from 1 in the given order, on the first floor(a * N / b) of the N rows that are ``able``; null on the others.

    Rows are dealt by range and written in order; equal rows are told apart by where they lie, so that many of them
    are no hot range.
    """
    placed = rows.withColumn("_able", able).withColumn("_lies", F.monotonically_increasing_id())
    by = [F.desc("_able"), *order, F.asc("_lies")]
    dealt = placed.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = stash(dealt.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"), F.count_if("_able").alias("_able_n"))
    # A row for each range.
    last = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", "_first", F.coalesce(F.sum("_n").over(last), F.lit(0)).alias("_before"), F.sum("_able_n").over(Window.partitionBy()).alias("_all"))
    place = F.col("_place") - F.col("_first") + F.col("_before") + 1
    drawn = place <= F.floor(F.lit(share[0]) * F.col("_all") / F.lit(share[1]))
    out = dealt.join(F.broadcast(sizes), "_range")
    return out.select(*rows.columns, F.when(F.col("_able") & drawn, place).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = 10_000,
    longest: int = 1, share: tuple[int, int] = (10, 100), least_words: int = 20, seed: str = "2024",
) -> DataFrame:
    """id, n_features, weight, score and rank for every document; rank is null on those that aren't drawn.

    ``target`` is any table of texts in the wanted distribution.
    """
    blocks = stash(csr_blocks(docs, id_col, text_col, buckets, longest), "matrix", group=1)
    wanted = csr_blocks(target, target_text, target_text, buckets, longest).select("buckets", "counts")
    gain = gains(column_sums(blocks, buckets), column_sums(wanted, buckets))
    rows = weighed(blocks, gain).withColumn("score", F.col("weight") + noise("id", seed))
    out = ranked(rows, [F.desc("score"), F.asc("id")], share, F.col("n_words") >= least_words)
    drop_stash(blocks)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


ORACLE_SQL = r"""
with recursive bits(n, i, c) as (
  select cast(n as bigint), 0, cast(n as bigint) from range(256) r(n)
  union all select n, i + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where i < 8
), crc as (
  select list(c order by n) as crc from bits where i = 8
), split as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
), wanted as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark
), each as (
  select r, unnest(words) as w from split
), hashed as materialized (
  select w, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, octet_length(encode(w)) + 1), lambda i: cast(('0x' || substr(hex(encode(w)), 2 * i - 1, 2)) as bigint))),
    lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295) % 10000 as bucket
  from (select w from each union select w from wanted), crc
), s as (
  select bucket, count(*) as n from each join hashed using (w) group by 1
), t as (
  select bucket, count(*) as n from wanted join hashed using (w) group by 1
), gain as (
  select b.bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (select coalesce(sum(n), 0) + 10000 from s)::double
    / ((coalesce(s.n, 0) + 1)::double * (select coalesce(sum(n), 0) + 10000 from t)::double))) as bigint) as gain
  from (select distinct bucket from hashed) b left join s using (bucket) left join t using (bucket)
), sums as (
  select r, sum(gain) as weight from each join hashed using (w) join gain using (bucket) group by 1
), weighed as (
  select r, doc_id, cast(len(words) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
    cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h
  from split left join sums using (r)
), scored as (
  select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from weighed
), placed as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id, r) as place, count(*) over (partition by n_features >= 20) as n from scored
)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from placed
"""
