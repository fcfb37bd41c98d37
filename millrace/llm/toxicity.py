"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained in numpy from confirmed toxic documents (P) and all unlabelled ones (U), which are
all rows that aren't held out. With class prior pi, the risk is pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)): what U
loses for being called clean, less the share of it that its own toxic documents cause, which can't fall below
zero; where it does, the step goes the other way, so that the classifier doesn't learn P by heart.

P is a sample of at most ``max_positive`` labelled documents, the only bound here. U isn't sampled: texts are cut into features
once, and of these the written table keeps the words that P has. Words weigh something if P has them more often than U by ``z``
standard errors, all documents counted. Documents that are alike in these words become one row with its count,
and each step of the descent is a pass over these rows: tasks send one number a word. The rows lie in as few
files as hold ``PER_NUMBER`` words for each number sent, so what is sent stays a small share of what is read at every size. Slopes are
summed as whole multiples of 1 / ``UNIT``, so neither the order of tasks nor a repeated one changes the model.

Defined results: a null or empty text has the score of the bias; a null doc_id is held out by nothing (the crc32 of
the empty text is 0), never joins a label and counts as unlabelled; labels other than 0 and 1 are no labels; with no positive document
every score is the prior; rows that share an id or repeat count each and are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WordHashes, crc_remainder, drop_stash, in_small_batches, stash, worded
from ._features import Beginnings, bounded_sample, labelled, logistic, plain, presence

MOD, HELD = 3, 1
#: Slopes and losses are summed in units of 1 / UNIT.
UNIT = 1 << 20
#: How many words a pass's task reads at least for each number that it sends.
PER_NUMBER = 1024
#: Bytes of text that are cut into words at a time.
RUN = 2_000_000


def beginnings() -> list[Beginnings]:
    return [Beginnings(6)]


def features(rows: DataFrame, bits: int, column: np.ndarray | None = None) -> DataFrame:
    """``positive`` and ``at``, the hashed words of ``text``, renumbered by ``column`` (words that it maps to -1 go) if it is given."""
    shared = rows.sparkSession.sparkContext.broadcast(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, starts, to = WordHashes(), beginnings(), shared.value
        for batch, words in worded(batches, "text", RUN, plain):
            offsets, at = presence(words, hashes, starts, bits)
            if to is not None:
                at = to[at]
                offsets, at = np.concatenate([[0], np.cumsum(at >= 0)])[offsets], at[at >= 0]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(at))], ["positive", "at"])

    return in_small_batches(rows.select("text", "positive")).mapInArrow(run, "positive boolean, at array<int>")


def occurrences(rows: DataFrame, columns: int) -> np.ndarray:
    """In how many rows each column is: each task sends its own counts, one number a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(columns, np.int64)
        for batch in batches:
            n += np.bincount(np.asarray(batch.column(0).flatten()), minlength=columns)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(n[there])], ["column", "n"])

    found = rows.select("at").mapInArrow(run, "column int, n long").groupBy("column").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(columns, np.int64)
    out[np.asarray(found["column"])] = np.asarray(found["n"])
    return out


def telling(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, z: float) -> np.ndarray:
    """Which columns P has more often than U, by more than ``z`` standard errors; one document is added to the variance, so what
    is next to never in U has to be in more than ``z`` documents of P."""
    rate = in_u / n_u
    return in_p - n_p * rate > z * np.sqrt(n_p * rate * (1 - rate) + 1)


def kinds(rows: DataFrame, column: np.ndarray) -> DataFrame:
    """The different rows after renumbering by ``column``: at, u (how many rows) and p (how many of these are positive)."""
    shared = rows.sparkSession.sparkContext.broadcast(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = shared.value[np.asarray(lists.flatten())]
            kept = np.concatenate([[0], np.cumsum(at >= 0)])
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(kept[ends].astype(np.int32)), pa.array(at[at >= 0]))], ["positive", "at"])

    less = rows.select("positive", "at").mapInArrow(run, "positive boolean, at array<int>")
    return less.groupBy("at").agg(F.count("*").alias("u"), F.sum(F.col("positive").cast("long")).alias("p"))


def slopes(at: np.ndarray, row: np.ndarray, u: np.ndarray, p: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    """Sums over rows, in whole units, as columns (U as clean, P as clean, P as toxic): a row for each weight, then one for the bias
    and one for the losses. ``at`` are the columns of the rows ``row``, ``u`` and ``p`` how often each row is in U and P."""
    out = logistic(bias + np.bincount(row, w[at], len(u)))
    clean = np.rint(out * UNIT).astype(np.int64)
    loss = np.rint(-np.log1p(-np.minimum(out, 1 - 1e-12)) * UNIT).astype(np.int64)
    each = np.stack([clean * u, clean * p, (clean - UNIT) * p], axis=1)
    sums = np.stack([np.bincount(at, each[row, j], len(w)).astype(np.int64) for j in range(3)], axis=1)
    return np.concatenate([sums, each.sum(axis=0)[None], [[(loss * u).sum(), (loss * p).sum(), 0]]])


def totals(rows: DataFrame, w: np.ndarray, bias: float) -> np.ndarray:
    """``slopes`` of all rows of ``kinds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(w) + 2, 3), np.int64)
        for batch in batches:
            lists = batch.column(0)
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            sums += slopes(np.asarray(lists.flatten()), row, np.asarray(batch.column(1)), np.asarray(batch.column(2)), w, bias)
        there = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *(pa.array(sums[there, j]) for j in range(3))], ["place", "a", "b", "c"])

    found = rows.select("at", "u", "p").mapInArrow(run, "place int, a long, b long, c long")
    found = found.groupBy("place").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")).toArrow()
    out = np.zeros((len(w) + 2, 3), np.int64)
    out[np.asarray(found["place"])] = np.stack([np.asarray(found[c]) for c in "abc"], axis=1)
    return out


def descend(sums, columns: int, n_p: int, n_u: int, prior: float, steps: int, rate: float, l1: float) -> tuple[np.ndarray, float]:
    """(weights, bias) by AdaGrad on the non-negative risk with the logistic loss; ``sums(w, bias)`` gives ``slopes`` of all rows."""
    w, g2 = np.zeros(columns), np.full(columns + 1, 1e-4)
    bias = float(np.log(prior / (1 - prior)))
    for _ in range(steps):
        total = sums(w, bias) / UNIT
        u, p_clean, p_toxic = total[:, 0] / n_u, prior * total[:, 1] / n_p, prior * total[:, 2] / n_p
        of_clean = u[-1] - p_clean[-1]
        grad = (p_toxic + u - p_clean if of_clean >= 0 else p_clean - u)[:-1]
        g2 += grad * grad
        step = rate / np.sqrt(g2)
        w = w - step[:-1] * grad[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - step[:-1] * l1, 0)
        bias -= float(step[-1] * grad[-1])
    return w, bias


def renumbered(chosen: np.ndarray, columns: int) -> np.ndarray:
    column = np.full(columns, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    return column


def train(
    docs: DataFrame, labels: DataFrame, prior: float | None = None, bits: int = 20, max_positive: int = 20_000, z: float = 3.0,
    steps: int = 60, rate: float = 2.0, l1: float = 1e-5,
) -> tuple[np.ndarray, float]:
    """(weights of 2**bits hashed words, bias). The prior is the share of toxic among labelled documents if it isn't given."""
    known = labelled(docs, labels, "toxic", MOD, HELD)
    if prior is None:
        toxic, n = known.agg(F.sum("y"), F.count("*")).first()
        prior = min(max((toxic or 0) / n, 1e-3), 0.5) if n else 0.5
    weights, bias = np.zeros(1 << bits, np.float32), float(np.log(prior / (1 - prior)))
    chosen = stash(bounded_sample(known.where("y = 1").select("doc_id"), max_positive).withColumnRenamed("doc_id", "_id"), "positive")
    sure = F.broadcast(chosen)  # at most ``max_positive`` ids, so no text moves
    free = docs.select("doc_id", "text").where(crc_remainder(F.col("doc_id"), MOD) != HELD)
    in_p = occurrences(features(free.join(sure, F.col("doc_id") == F.col("_id")).withColumn("positive", F.lit(True)), bits), 1 << bits)
    held = np.flatnonzero(in_p > z)
    rows = stash(features(free.join(sure, F.col("doc_id") == F.col("_id"), "left").withColumn("positive", F.col("_id").isNotNull()), bits, renumbered(held, 1 << bits)), "words")
    n_p, n_u = rows.agg(F.count_if("positive"), F.count("*")).first()
    if n_p:
        in_u = occurrences(rows, len(held))
        used = np.flatnonzero(telling(in_p[held], in_u, n_p, n_u, z))
        files = max(1, int(in_u[used].sum()) // (PER_NUMBER * max(1, len(used))))
        few = stash(kinds(rows, renumbered(used, len(held))).repartition(files), "kinds")
        w, bias = descend(lambda w, b: totals(few, w, b), len(used), n_p, n_u, prior, steps, rate, l1)
        weights[held[used]] = w
        drop_stash(few)
    drop_stash(rows)
    drop_stash(chosen)
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str]) -> DataFrame:
    weights, bias = model
    bits = int(np.log2(len(weights)))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, starts, w = WordHashes(), beginnings(), shared.value
        for batch, words in worded(batches, "text", RUN, plain):
            offsets, at = presence(words, hashes, starts, bits)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(logistic(bias + np.bincount(rows, w[at], batch.num_rows)))], ["row", "score"])

    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"))
    return in_small_batches(rows).mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    out = score(docs, train(docs, labels), ["doc_id"])
    return out.select("row.doc_id", (crc_remainder(F.col("row.doc_id"), MOD) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents, all columns, that score below ``threshold``."""
    return score(docs, train(docs, labels), docs.columns).where(F.col("score") < threshold).select("row.*")
