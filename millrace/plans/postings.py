"""Lexical search from a written table of postings, with block maxima.

Documents are taken in blocks of at most ``width``, those of a batch by their length. A row of the table is a token in a block: the documents of
the block that have it, how often, the most of these counts and the shortest document's length, which bound what the token can add to a
score there. Rows of their own say which documents a block has and how long they are. Rows are in
folders by a hash of the token and sorted by token in them, so a query reads the row groups of its own tokens and never the
texts.

A top-k search reads the maxima first, without the lists: their sum bounds every score of a block, and a block that lacks a
token that all documents must have is out at once. The blocks with the highest bounds are scored, which gives a
score that k documents reach; then only blocks whose bound reaches it are scored too. The answer is that of a scan.

Scores are those of ``search.bm25``: counts and lengths over all documents.

Defined results: a null or empty text is a document of length 0, which no query finds; documents that share an id are found each;
a null id is found as null; a query without tokens is an error; ties (to 12 digits) go to the smaller id; an empty table has no answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import K1, B, tokens, words_of

DIGITS = 12
#: The folder of the rows that say which documents a block has.
BLOCKS = -1
NAMES = ["token", "block", "at", "counts", "most", "shortest", "ids", "lengths"]


def in_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``width`` rows (id, list), each of lists of about one length, out of a batch's rows.

    What a token adds to a score falls with a document's length: apart, long documents don't hide behind short ones.
    """
    for batch in batches:
        order = np.argsort(np.asarray(batch.column(1).value_lengths()), kind="stable")
        for at in range(0, len(order), width):
            yield batch.take(pa.array(order[at : at + width]))


def block_postings(documents: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row for each token of each block: token, block, at (places in the block), counts, the most of them and the length of the
    shortest of its documents; and a row without a token for each block: the ids and lengths of its documents."""
    rows = documents.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(in_blocks(batches, width)):
            lists = batch.column(1)
            lengths = np.asarray(lists.value_lengths()).astype(np.int32)
            coded = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lengths)), lengths)
            pair, counts = np.unique(np.asarray(coded.indices).astype(np.int64) * width + row, return_counts=True)
            token, at = pair // width, (pair % width).astype(np.int32)
            starts = np.flatnonzero(np.diff(token, prepend=-1))  # every token of the block occurs, in the order of its number
            n, block = len(starts), (task << 32) + number
            offsets = pa.array(np.concatenate([starts, [len(pair)]]), pa.int32())
            lists_of = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))
            least = lambda f, values: pa.array(f.reduceat(values, starts).astype(np.int32) if n else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(token[starts])).cast(pa.string()), pa.array(np.full(n, block)), lists_of(at), lists_of(counts),
                 least(np.maximum, counts), least(np.minimum, lengths[at]), pa.nulls(n, pa.list_(batch.column(0).type)), pa.nulls(n, pa.list_(pa.int32()))], NAMES
            )
            whole = pa.array([0, len(lengths)], pa.int32())
            nothing = [pa.nulls(1, k) for k in (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([block]), *nothing, pa.ListArray.from_arrays(whole, batch.column(0)), pa.ListArray.from_arrays(whole, pa.array(lengths))], NAMES)

    ints, one = T.ArrayType(T.IntegerType()), T.IntegerType()
    kinds = (T.StringType(), T.LongType(), ints, ints, one, one, T.ArrayType(rows.schema["id"].dataType), ints)
    return rows.mapInArrow(run, T.StructType([T.StructField(k, v) for k, v in zip(NAMES, kinds, strict=True)]))


def impact(count: Column, length: Column, average: float) -> Column:
    """What a token adds to a score, without its rarity."""
    return count * (K1 + 1) / (count + K1 * (1 - B + B * length / F.lit(average)))


def build(documents: DataFrame, id_col: str, text_col: str, path: str, width: int = 256, buckets: int = 32, spread: int = 8) -> "Postings":
    """Write the postings of ``documents`` to ``path``. Texts are cut into tokens once, and rows travel once.

    The rows of a folder are dealt over up to ``spread`` tasks by their blocks, so a frequent token is no hot task.
    """
    spark = documents.sparkSession
    rows = block_postings(documents, id_col, text_col, width).withColumn("bucket", F.when(F.col("token").isNull(), BLOCKS).otherwise(bucket(F.col("token"), buckets)))
    dealt = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("block"), F.lit(spread)))
    dealt.sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.createDataFrame([], rows.schema).write.parquet(f"{path}/shape-{buckets}")
    return Postings(spark, path, buckets)


def bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


class Postings:
    """A written table of postings."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.buckets = buckets
        self.table = spark.read.schema(spark.read.parquet(f"{path}/shape-{buckets}").schema).parquet(f"{path}/postings")
        self.held = self.table.where(F.col("bucket") == BLOCKS).select("block", "ids", "lengths")
        words = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
        totals = self.held.agg(F.sum(F.size("lengths")), F.sum(words), F.count("*")).first()
        self.documents, words, self.blocks = (x or 0 for x in totals)
        self.average = words / self.documents if words else 1.0

    def rows(self, wanted: list[str]) -> DataFrame:
        """The postings of some tokens: their folders, and in them the row groups that may hold them."""
        spark = self.table.sparkSession
        asked = spark.createDataFrame([(w,) for w in wanted], "token string").select(bucket(F.col("token"), self.buckets)).distinct()
        found = self.table.where(F.col("bucket").isin([r[0] for r in asked.collect()]) & F.col("token").isin(wanted))
        return found.select("token", "block", "at", "counts", "most", "shortest")

    def search(self, query: str, limit: int | None = None, how: str = "all_tokens", first_blocks: int = 8) -> DataFrame:
        """(id, score) of the documents that have all tokens or, as ``how`` says, any; the best ``limit``, or all of them."""
        return self.explained(query, limit, how, first_blocks)[0]

    def explained(self, query: str, limit: int | None = None, how: str = "all_tokens", first_blocks: int = 8) -> tuple[DataFrame, dict[str, int]]:
        """The result of ``search``, and how many blocks hold what is asked for and how many were scored."""
        if how not in ("all_tokens", "any_tokens"):
            raise ValueError(f"postings have no {how}: ask the texts")
        wanted = list(dict.fromkeys(words_of(query)))
        if not wanted:
            raise ValueError("the query has no token")
        rows = self.rows(wanted)
        have = dict(rows.groupBy("token").agg(F.sum(F.size("at"))).collect())
        rarity = {w: log(1 + (self.documents - have.get(w, 0) + 0.5) / (have.get(w, 0) + 0.5)) for w in wanted}
        weight = F.element_at(F.create_map(*(F.lit(x) for pair in rarity.items() for x in pair)), F.col("token"))
        needed = len(wanted) if how == "all_tokens" else 1
        best = impact(F.col("most"), F.col("shortest"), self.average)  # no document of the block adds more
        bounds = rows.groupBy("block").agg(F.sum(weight * best).alias("bound"), F.count("*").alias("held")).where(F.col("held") >= needed)
        if limit is None:
            return self._scored(rows, weight, needed), {}
        highest = bounds.orderBy(F.desc("bound"), "block").limit(first_blocks).collect()
        seen = self._scored(rows.where(F.col("block").isin([r["block"] for r in highest])), weight, needed)
        kth = seen.orderBy(F.desc("score"), "id").limit(limit).agg(F.count("*"), F.min("score")).first()
        floor = kth[1] if kth[0] == limit else 0.0
        # A bound that rounding has put below the score it bounds still counts.
        left = bounds.where(F.col("bound") >= floor - 1e-9).select("block")
        found = self._scored(rows.join(left, "block", "left_semi"), weight, needed).orderBy(F.desc("score"), "id").limit(limit)
        counts = {"blocks": self.blocks, "with_tokens": bounds.count(), "scored": left.count()}
        return found, counts

    def _scored(self, rows: DataFrame, weight: Column, needed: int) -> DataFrame:
        of = lambda p: F.struct(p["at"].alias("at"), p["counts"].alias("counts"), F.get("ids", p["at"]).alias("id"), F.get("lengths", p["at"]).alias("length"))
        each = rows.join(self.held, "block").select("block", weight.alias("weight"), F.inline(F.transform(F.arrays_zip("at", "counts"), of)))
        added = F.col("weight") * impact(F.col("counts"), F.col("length"), self.average)
        sums = each.groupBy("block", "at").agg(F.first("id").alias("id"), F.sum(added).alias("score"), F.count("*").alias("held"))
        return sums.where(F.col("held") >= needed).select("id", F.round("score", DIGITS).alias("score"))
