"""What several operators share: written intermediate tables, graph components and word helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a session in one JVM may go without the setting: there a fresh local folder serves.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stash(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back: lineage ends there, lost executors or not.

    ``group`` is the most rows of a row group. A writer holds one in memory, and looks at its size only every hundred rows; a reader makes up to
    4,096 of its rows into one batch. So large rows, of which a file would be a single group, need a bound.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"parquet.block.row.count.limit": str(group)} if group else {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def drop_stash(df: DataFrame) -> None:
    """Delete a stashed table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def make_importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package, wherever the driver was started."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def crc_remainder(col: Column, mod: int) -> Column:
    """crc32 of the value's text, modulo ``mod``; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- a worker's memory ------------------------------------------------------------------------

#: What this Python worker keeps for later tasks of the same operator; ``fresh`` drops what others kept.
remembered: dict[str, object] = {}


def fresh(but: str | None = None) -> None:
    """Give back what earlier tasks left in this worker, which Spark uses again for other operators: what they remember (``but`` stays) and
    memory that is free already but still held."""
    for key in [k for k in remembered if k != but]:
        del remembered[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


#: Bytes of rows that a Python worker gets at a time: Spark's 64 MB would stand in the JVM and in the worker, for each of an executor's tasks.
BATCH = 4_000_000


def in_small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, for a function on Arrow batches; sets the session's size of batches."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return rows


# --- connected components ---------------------------------------------------------------------


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternates large-star and small-star rounds. Every round is a grouped minimum (combined before
    the shuffle, so a hub is no hot group) and an equi-join that Spark may split on a skewed key; each
    round's edges are written to the shared folder, so no lineage grows. Roots are left out as nodes.
    """
    now = stash(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = _fingerprint(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stash(small.union(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        was, state = state, _fingerprint(after)
        drop_stash(now)
        now = after
        if state == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def join_roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union the pairs (i, j) into ``parent``, an array in which every index points to its set's least index."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(parent, a, low)
        np.minimum.at(parent, b, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


# --- words ------------------------------------------------------------------------------------


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered for up to ``limit`` words."""

    def __init__(self, seed: int = 0, limit: int = 300_000):
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; a null counts as the empty text."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into runs of rows with about ``most`` bytes of text (one row at least): (rows, their texts)."""
    fresh()
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        first, size, held = 0, 0, []
        for row in range(batch.num_rows):
            raw = texts[row].as_buffer()
            held.append(b"" if raw is None else raw.to_pybytes())
            size += len(held[-1])
            if size >= most:
                yield batch.slice(first, row + 1 - first), held
                first, size, held = row + 1, 0, []
        if held:
            yield batch.slice(first), held


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, .. for ``n`` places, for each pair of ``first`` and ``n`` end to end."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


class Words:
    """The words (runs between ASCII white space) of an array of texts, each distinct one once.

    ``distinct`` are the words, ``codes`` the place of each word of the texts among them, and text i has
    the words ``offsets[i]`` to ``offsets[i + 1]``. A null text has none.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        encoded = lists.flatten().dictionary_encode()
        self.distinct: pa.Array = encoded.dictionary
        self.codes = np.asarray(encoded.indices)
        self.offsets = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        empty = pc.index(self.distinct, "").as_py()
        if empty >= 0:  # white space at a text's start or end
            there = self.codes != empty
            self.offsets = np.concatenate([[0], np.cumsum(there)])[self.offsets]
            self.codes = self.codes[there]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum over its words of ``values``, which has a row or number for each distinct word."""
        at = values[self.codes]
        out = np.zeros((len(self.offsets) - 1, *values.shape[1:]), values.dtype)
        some = np.flatnonzero(np.diff(self.offsets))
        if len(some):
            out[some] = np.add.reduceat(at, self.offsets[some], axis=0)
        return out


def worded(batches: Iterator[pa.RecordBatch], column: str, most: int = 8_000_000, form=lambda texts: texts, keep: str | None = None) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Cut Arrow batches into runs of rows with about ``most`` bytes of text (one row at least): (rows, words of their texts in ``form``).
    What is ``remembered`` as ``keep`` stays."""
    fresh(keep)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            n = max(1, int(np.searchsorted(ends, done + most, side="right")) - first)
            yield batch.slice(first, n), Words(form(texts.slice(first, n)))
            first += n
