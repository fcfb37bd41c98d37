"""Quality by hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features are hashed words and word pairs, of the words themselves and of their shapes (case, digits, signs,
a word said again). Training takes a sample of at most ``max_rows`` labelled documents, in the order of a hash,
one update a document; the leader's closed form keeps weights at zero until their evidence exceeds the L1
term. A score is a sparse dot product; every whole text is scored.

Defined results: a null or empty text has no features and the score of the bias; a null doc_id is held out by
the crc32 of the empty text and never joins a label; labels other than 0 and 1 are no labels; with no labels
every score is 0.5; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, crc_remainder
from ._features import Shapes, labelled, logistic, ngrams, sample_features, scored

MOD, HELD = 5, 0


def fit_ftrl(at: np.ndarray, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, columns: int, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """(weights, bias): per-coordinate FTRL-proximal over the rows in order; ``bounds``: where each row's features lie."""
    z, n = np.zeros(columns), np.zeros(columns)
    bias, b2 = 0.0, 1.0

    def leader(a, m):
        return np.where(np.abs(a) <= l1, 0.0, (np.sign(a) * l1 - a) / ((beta + np.sqrt(m)) / alpha + l2))

    for _ in range(epochs):
        for (first, end), label in zip(bounds.tolist(), y.tolist(), strict=True):
            here, value = at[first:end], x[first:end].astype(np.float64)
            held = n[here]
            w = leader(z[here], held)
            g = logistic(bias + value @ w) - label
            gx = g * value
            grown = held + gx * gx
            np.add.at(z, here, gx - (np.sqrt(grown) - np.sqrt(held)) / alpha * w)
            n[here] = grown
            b2 += g * g
            bias -= g / np.sqrt(b2)
    return leader(z, n), float(bias)


def train(docs: DataFrame, labels: DataFrame, bits: int = 20, max_rows: int = 12_000) -> tuple[np.ndarray, float]:
    """(weights of 2**bits hashed n-grams, bias)"""

    def extract():
        hashes, shapes = WordHashes(), Shapes()
        return lambda text: ngrams(text, hashes, shapes, bits)

    known = labelled(docs, labels, "quality", MOD, HELD)
    bounds, values, plain = sample_features(docs, known, max_rows, extract, "at x", "array<int> array<float>")
    if not len(bounds):
        return np.zeros(1 << bits, np.float32), 0.0
    w, bias = fit_ftrl(values["at"], values["x"], bounds, np.array(plain["y"], float), 1 << bits)
    return w.astype(np.float32), bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str]) -> DataFrame:
    weights, bias = model
    bits = int(np.log2(len(weights)))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scorer():
        hashes, shapes, w = WordHashes(), Shapes(), shared.value

        def one(text: bytes) -> float:
            at, x = ngrams(text, hashes, shapes, bits)
            return float(logistic(bias + np.dot(w[at].astype(np.float64), x)))

        return one

    return scored(docs, scorer, keep)


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    out = score(docs, train(docs, labels), ["doc_id"])
    return out.select("row.doc_id", (crc_remainder(F.col("row.doc_id"), MOD) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, that score ``threshold`` or more."""
    return score(docs, train(docs, labels), docs.columns).where(F.col("score") >= threshold).select("row.*")
