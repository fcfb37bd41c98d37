"""Hashed features of whole texts, for the linear classifiers."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WordHashes, Words, crc_remainder, in_small_batches, mixed, slices

#: Lower-cases A-Z and turns ASCII punctuation into spaces.
PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))
#: Classes of bytes for word shapes: upper, lower or any other script, digit; other signs stand for themselves.
CLASSES = bytes(
    65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i > 127 else 48 if 48 <= i <= 57 else i for i in range(256)
)


class Shapes(WordHashes):
    """Hash of each word's shape: its classes of bytes, runs of one class as one."""

    def __missing__(self, word: bytes) -> int:
        shape = bytearray()
        for c in word.translate(CLASSES):
            if not shape or shape[-1] != c:
                shape.append(c)
        value = super().__missing__(bytes(shape) + b"\0shape")
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


class Beginnings(WordHashes):
    """Hash of each word's first ``size`` bytes; 0 for shorter words."""

    def __init__(self, size: int):
        super().__init__(11)
        self.size = size

    def __missing__(self, word: bytes) -> int:
        value = super().__missing__(word)
        if len(word) < self.size:
            value = 0
        elif len(word) > self.size:
            value = xxhash.xxh64_intdigest(word[: self.size], 11)
        self[word] = value
        return value


def plain(texts: pa.Array) -> pa.Array:
    """The texts with ``PLAIN`` applied to all their bytes at once; a null is the empty text."""
    texts = texts.cast(pa.string()).fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return texts
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    here = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().translate(PLAIN)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(here))


def presence(words: Words, hashes: WordHashes, starts: list[Beginnings], bits: int, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of each text, each once, and beginnings of words, each once for every time up to ``most``, as (offsets, columns).

    A different word is hashed once for all texts of a run; what each text has is sorted with its row in one number.
    """
    each = words.distinct.cast(pa.binary()).to_pylist()
    rows = len(words.offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(words.offsets))
    column = lambda h: (mixed(h) >> np.uint64(64 - bits)).astype(np.int64)
    found = [(row << bits) | column(hashes.of(each))[words.codes]]
    for start in starts:
        h, which = np.unique(start.of(each), return_inverse=True)
        at, counts = np.unique(row * len(h) + which[words.codes], return_counts=True)
        of, which = np.divmod(at, max(1, len(h)))
        for k in range(most):
            some = (counts > k) & (h[which] != 0)
            found.append((of[some] << bits) | column(h + np.uint64(k + 1))[which[some]])
    at = np.unique(np.concatenate(found))
    return np.searchsorted(at, np.arange(rows + 1) << bits), (at & ((1 << bits) - 1)).astype(np.int32)


def ngrams(text: bytes, hashes: WordHashes, shapes: Shapes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, word pairs, and the same of their shapes, with values that fall with the text's length."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    w, s = hashes.of(words), shapes.of(words)
    pair = lambda x: x[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[1:]
    # A word said again at once is a pair of its own kind.
    again = np.where(w[1:] == w[:-1], np.uint64(3), np.uint64(5)) if len(w) > 1 else w[:0]
    of_words = np.concatenate([w, pair(w)])
    of_shapes = np.concatenate([s + np.uint64(1), pair(s), again])
    out = []
    for h in (of_words, of_shapes):
        found, counts = np.unique((mixed(h) >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
        values = np.sqrt(counts / len(words))
        out.append((found, values / max(np.sqrt((values**2).sum()), 1e-9)))
    return np.concatenate([f for f, _ in out]), np.concatenate([v for _, v in out]).astype(np.float32)


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int) -> DataFrame:
    """doc_id and y of the labelled documents that are not held out; of an id's labels the least counts."""
    train = labels.where(crc_remainder(F.col("doc_id"), mod) != held).where(F.col(label).isin(0, 1))
    train = train.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    return train.join(docs.select(F.col("doc_id").alias("_there")), F.col("doc_id") == F.col("_there"), "left_semi")


def bounded_sample(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, the least by a hash of their doc_id: the same ones whatever the partitions."""
    return ids.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sample_features(docs: DataFrame, ids: DataFrame, most: int, extract, names: str, kinds: str) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, list]]:
    """Features of a bounded sample of documents: (offsets, the lists' values by name, other columns of ``ids``), in an order
    that the ids fix.

    Only ids are sampled; they are at most ``most`` small rows, which are broadcast, so texts are read and cut into
    features where they lie and only features move. Of rows that share an id the one with the least hash counts.
    """
    lists = names.split()
    chosen = bounded_sample(ids, most).withColumnRenamed("doc_id", "_id")
    others = [c for c in chosen.columns if c != "_id"]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.select("text", F.xxhash64("text").alias("_h"), "doc_id", *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = extract()
        for batch, texts in slices(batches, "text"):
            found = list(zip(*(of(t) for t in texts), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x) for x in found)], [*batch.schema.names[1:], *lists])

    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes[1:]), *(f"{n} {k}" for n, k in zip(lists, kinds.split(), strict=True))])
    found = in_small_batches(rows).mapInArrow(run, schema).groupBy("doc_id").agg(F.min(F.struct("_h", *others, *lists)).alias("r"))
    table = found.select(F.xxhash64("doc_id").alias("_order"), "doc_id", *(F.col(f"r.{c}") for c in (*others, *lists))).toArrow()
    order = np.lexsort((np.asarray(table["doc_id"]), np.asarray(table["_order"])))
    lengths = np.asarray(table[lists[0]].combine_chunks().value_lengths(), np.int64) if len(table) else np.zeros(0, np.int64)
    plain = {c: [table[c][int(i)].as_py() for i in order] for c in others}
    values = {}
    for name in lists:  # a column at a time, so that few copies stand side by side
        column = table[name]
        table = table.drop_columns([name])
        chunks = [np.asarray(c.flatten()) for c in column.chunks]
        values[name] = np.concatenate(chunks) if chunks else np.zeros(0, np.int32)
        del column, chunks
    starts = np.cumsum(lengths) - lengths
    bounds = np.stack([starts[order], (starts + lengths)[order]], axis=1)
    pa.default_memory_pool().release_unused()
    return bounds, values, plain


def scored(docs: DataFrame, scorer, keep: list[str]) -> DataFrame:
    """A struct ``row`` of the columns ``keep``, and ``score``, for every row; ``scorer()`` gives a function from a text to a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.array([score(t) for t in texts], np.float64))], ["row", "score"])

    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"))
    return in_small_batches(rows).mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
