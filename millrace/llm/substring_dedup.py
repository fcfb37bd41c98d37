"""Exact removal of repeated word windows, with a count-min prefilter.

A window is ``width`` consecutive words. Each window picks its least ``gram``-word gram (by hash, the first
if several tie); equal windows pick equal grams at equal offsets, so how often a gram is picked, at distinct
places, is at least how often any window that picks it occurs. Neighbouring windows mostly pick the same
place, so there are many times fewer picks than windows.

1. Each task counts its picks into count-min cells (several rows of cells; a count stops at two) and sends
   its sketch by shards; shards are merged into bits "two or more". The width follows the corpus up to
   ``max_cells``, which bounds what is broadcast: ``rows * max_cells / 8`` bytes. A fuller sketch only lets
   more windows through; it never loses one.
2. A second pass writes the windows whose pick is estimated repeated in all rows of the sketch, as runs of
   windows that share a pick: 128 bits (the pick and a hash of the run's windows) stand for all of them. Runs are
   grouped exactly. One that occurs twice or more is repeated as a whole, as most are; those that occur once are the
   exceptions. If no other run has an exception's pick, none of its windows is repeated. If one has (a mixed
   pick), the windows of the pick's runs are grouped exactly, by 128 bits (the pick and the window's hash). Mixed
   picks and exceptions are looked up in bitmaps bounded like the sketch, which only let more through.
3. Only exceptions, and their windows that are repeated after all, go to their documents by an equi-join. The last
   pass finds a document's runs again, leaves out the exceptions, and removes the covered words.

Counts are combined before each shuffle and hot keys meet only in equi-joins that Spark may split, so a
passage that a third of all documents share is no hot group.

Defined results: a null or empty text, or one of fewer than ``width`` words, loses nothing; words are
compared as bytes; repeated rows, with the same id or not, are other documents, so their windows repeat;
a window that recurs within a document is removed at every place; columns of other names are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WordHashes, drop_stash, in_small_batches, mixed, slices, stash

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
SHARDS = 64


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(words: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of each ``width`` consecutive word hashes, by doubling; empty if there are fewer."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    out, done, part, size, mul = None, 0, words, 1, np.array([base])
    while True:
        if width & size:
            if out is None:
                out, done, done_mul = part, size, mul
            else:  # the part that is done comes first
                n = len(words) - done - size + 1
                out, done, done_mul = out[:n] + done_mul * part[done : done + n], done + size, done_mul * mul
        size *= 2
        if size > width:
            return out[: len(words) - width + 1]
        n = len(part) - size // 2
        part = part[:n] + mul * part[size // 2 : size // 2 + n]
        mul = mul * mul


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    size, part = 1, x
    while size * 2 <= width:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    n = len(x) - width + 1
    return np.minimum(part[:n], part[width - size : width - size + n])


class Picks:
    """The runs of windows of some texts: document, first window, number, pick, and the windows' hashes."""

    def __init__(self, texts: list[bytes], hashes: WordHashes, width: int, gram: int):
        split = [t.split() for t in texts]
        lengths = np.array([len(w) for w in split], np.int64)
        self.doc = self.start = self.n = np.zeros(0, np.int64)
        self.pick = self.windows = np.zeros(0, np.uint64)
        self.split, self.lengths = split, lengths
        long = np.flatnonzero(lengths >= width)
        if not len(long):
            return
        words = mixed(np.concatenate([hashes.of(split[d]) for d in long]))
        lengths = lengths[long]
        ends = np.cumsum(lengths)
        firsts = ends - lengths
        grams = mixed(rolling(words, gram, M1))
        # The high half orders the grams, the low half is the place: the first of equal grams is least.
        keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        at = sliding_min(keyed, width - gram + 1) & np.uint64(0xFFFFFFFF)
        whole = np.zeros(len(at), bool)
        inside = np.repeat(firsts, lengths - width + 1) + ranges(lengths - width + 1)
        whole[inside] = True
        docs = np.repeat(np.arange(len(long)), lengths - width + 1)
        at = at[inside]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (docs[1:] != docs[:-1])
        self.first = np.flatnonzero(new)
        self.n = np.diff(np.append(self.first, len(at)))
        self.doc = long[docs[self.first]]
        self.start = inside[self.first] - firsts[docs[self.first]]
        self.pick = grams[at[self.first].astype(np.int64)]
        self.windows = rolling(words, width, M2)[inside]

    def run_hashes(self) -> np.ndarray:
        """A hash of each run's windows in order."""
        most = int(self.n.max(initial=0))
        return mixed(np.add.reduceat(self.windows * powers(M1, most)[ranges(self.n)], self.first)) if len(self.n) else self.windows


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. for each length, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def cells_of(picks: np.ndarray, rows: int, bits: int) -> list[np.ndarray]:
    """The cell of each pick in each row of the sketch."""
    shift = np.uint64(64 - bits)
    return [(mixed(picks * M + M) >> shift).astype(np.uint32) for M in (M1, M2, M3)[:rows]]


def sketch_bits(total_bytes: int, max_cells: int) -> int:
    """Cells a row as a power of two: about five for each pick of the corpus, within bounds."""
    return int(np.clip(np.ceil(np.log2(max(total_bytes, 1) / 16)), 16, np.log2(max_cells)))


def shard_parts(cells: list[np.ndarray], bits: int, all_count: bool = False) -> pa.RecordBatch:
    """Cells of each row by shard: those that occur once here, and those that occur more often (``all_count``: all are such)."""
    out = {"row": [], "shard": [], "once": [], "more": []}
    for row, found in enumerate(cells):
        found, counts = np.unique(found, return_counts=True)
        more = counts > (0 if all_count else 1)
        cuts = np.searchsorted(found, np.arange(SHARDS + 1, dtype=np.uint64) << np.uint64(bits - 6))
        for shard in range(SHARDS):
            part = slice(cuts[shard], cuts[shard + 1])
            if part.start < part.stop:
                out["row"].append(row)
                out["shard"].append(shard)
                out["once"].append(found[part][~more[part]].tobytes())
                out["more"].append(found[part][more[part]].tobytes())
    return pa.RecordBatch.from_pydict(out, pa.schema([("row", pa.int32()), ("shard", pa.int32()), ("once", pa.binary()), ("more", pa.binary())]))


SHARD_PARTS = "row int, shard int, once binary, more binary"


def merged_bits(parts: DataFrame, rows: int, bits: int) -> list[bytes]:
    """For each row a bit for each cell that occurs more often than once over all parts."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << (bits - 6)
        key, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_pydict(
                {"row": [key[0]], "shard": [key[1]], "bits": [np.packbits(twice, bitorder="little").tobytes()]},
                pa.schema([("row", pa.int32()), ("shard", pa.int32()), ("bits", pa.binary())]),
            )

        for batch in batches:  # sorted by row and shard: one shard's cells are held at a time
            for r, s, one, more in zip(*(batch.column(i) for i in range(4)), strict=True):
                if (r.as_py(), s.as_py()) != key:
                    if key is not None:
                        yield done()
                    key, once, twice = (r.as_py(), s.as_py()), np.zeros(size, bool), np.zeros(size, bool)
                cell = np.frombuffer(one.as_buffer(), np.uint32) - np.uint32(key[1] * size)
                twice[cell[once[cell]]] = True
                once[cell] = True
                cell = np.frombuffer(more.as_buffer(), np.uint32) - np.uint32(key[1] * size)
                twice[cell] = once[cell] = True
        if key is not None:
            yield done()

    tasks = min(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), SHARDS * rows)
    merged = parts.repartition(tasks, "row", "shard").sortWithinPartitions("row", "shard")
    merged = merged.mapInArrow(merge, "row int, shard int, bits binary")
    out = [bytearray((1 << bits) // 8) for _ in range(rows)]
    size = (1 << (bits - 6)) // 8
    for row, shard, found in merged.collect():  # at most rows * max_cells / 8 bytes
        out[row][shard * size : (shard + 1) * size] = found
    return [bytes(x) for x in out]


def repeated_cells(docs: DataFrame, width: int, gram: int, rows: int, bits: int) -> list[bytes]:
    """The merged sketch of the picks of all texts."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0
        for _, texts in slices(batches, "text"):
            held.append(Picks(texts, hashes, width, gram).pick)
            size += len(held[-1])
            if size > 2_000_000:
                yield shard_parts(cells_of(np.concatenate(held), rows, bits), bits)
                held, size = [], 0
        if size:
            yield shard_parts(cells_of(np.concatenate(held), rows, bits), bits)

    return merged_bits(in_small_batches(docs.select("text")).mapInArrow(sketch, SHARD_PARTS), rows, bits)


def member_bits(hashes: DataFrame, bits: int) -> bytes:
    """A bit for each hash of a column of longs."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(np.asarray(batch.column(0)).view(np.uint64))
            size += len(held[-1])
            if size > 1_000_000:
                yield shard_parts(cells_of(np.concatenate(held), 1, bits), bits, all_count=True)
                held, size = [], 0
        if size:
            yield shard_parts(cells_of(np.concatenate(held), 1, bits), bits, all_count=True)

    return merged_bits(hashes.mapInArrow(sketch, SHARD_PARTS), 1, bits)[0]


def found_in(bitmaps: list[bytes], hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have their bit in every bitmap."""
    out = np.ones(len(hashes), bool)
    for bitmap, cell in zip(bitmaps, cells_of(hashes, len(bitmaps), bits), strict=True):
        out &= (np.frombuffer(bitmap, np.uint8)[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return out


def exceptions(docs: DataFrame, sketch, bits: int, width: int, gram: int) -> DataFrame:
    """(k1, k2, marks) of the documents of ``docs(k1, k2, text)`` in which not all that passes the sketch is repeated:
    marks (at, gone) are runs by their first window, which are not repeated, and windows, which are."""
    spark = docs.sparkSession

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in slices(batches, "text"):
            p = Picks(texts, hashes, width, gram)
            at = np.flatnonzero(found_in(sketch.value, p.pick, bits))
            if not len(at):
                continue
            offsets = np.concatenate([[0], np.cumsum(p.n[at])]).astype(np.int32)
            values = p.windows[np.repeat(p.first[at], p.n[at]) + ranges(p.n[at])]
            doc = pa.array(p.doc[at])
            longs = lambda x: pa.array(x.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(doc), batch.column(1).take(doc), longs(p.pick[at]), longs(p.run_hashes()[at]), pa.array(p.start[at].astype(np.int32)),
                 pa.array(p.n[at].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), longs(values))],
                ["k1", "k2", "pick", "run", "start", "n", "windows"],
            )

    picked = stash(docs.select("k1", "k2", "text").mapInArrow(runs, "k1 bigint, k2 bigint, pick bigint, run bigint, start int, n int, windows array<bigint>"), "windows")
    # Of a run that occurs once the least place is its place.
    place = [F.min(c).alias(c) for c in ("k1", "k2", "start")]
    distinct = stash(picked.groupBy("pick", "run", "n").agg(F.count("*").alias("times"), *place), "runs")
    once = distinct.where("times = 1")
    several = distinct.groupBy("pick").agg(F.count("*").alias("runs")).where("runs > 1")
    key = F.xxhash64("pick", "run", "n")
    tables = spark.sparkContext.broadcast((member_bits(several.select("pick"), bits), member_bits(once.select(key), bits)))

    def of_mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixed_picks, alone = tables.value
        for batch in batches:
            batch = batch.filter(pa.array(found_in([mixed_picks], np.asarray(batch.column(0)).view(np.uint64), bits)))
            if batch.num_rows:
                rare = found_in([alone], np.asarray(batch.column(1)).view(np.uint64), bits)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rare), *batch.columns[2:]], ["pick", "rare", "k1", "k2", "start", "windows"])

    few = picked.select("pick", key.alias("key"), "k1", "k2", "start", "windows")
    few = stash(few.mapInArrow(of_mixed, "pick bigint, rare boolean, k1 bigint, k2 bigint, start int, windows array<bigint>"), "mixed")
    drop_stash(picked)
    often = few.select("pick", F.explode("windows").alias("window")).groupBy("pick", "window").agg(F.count("*").alias("times")).where("times > 1")
    windows = few.where("rare").select("k1", "k2", "start", "pick", F.posexplode("windows").alias("at", "window"))
    windows = windows.join(often, ["pick", "window"], "left_semi").select("k1", "k2", (F.col("start") + F.col("at")).alias("at"), F.lit(True).alias("gone"))
    marks = once.select("k1", "k2", F.col("start").alias("at"), F.lit(False).alias("gone")).union(windows)
    marks = stash(marks.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "gone")).alias("marks")), "marks")
    drop_stash(few)
    drop_stash(distinct)
    return marks


def without_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 35, gram: int = 8, rows: int = 2, max_cells: int = 1 << 28) -> DataFrame:
    """Every row of ``docs`` with all its columns, and: kept_text (kept words joined by one space), n_words, n_removed."""
    if width < gram + 1:
        raise ValueError("a window has to be longer than a gram")
    # A document is known by hashes of its id and text, so rows that share an id don't mix.
    text = F.col(f"`{text_col}`")
    known = [F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), text).alias("k1"), F.xxhash64(text, F.lit(35)).alias("k2")]
    keyed = docs.select(*known, text.alias("text"))
    bits = sketch_bits(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0, max_cells)
    sketch = docs.sparkSession.sparkContext.broadcast(repeated_cells(keyed, width, gram, rows, bits))
    marks = exceptions(keyed, sketch, bits, width, gram)
    names = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *known, text.alias("text"))
    joined = held.join(marks, ["k1", "k2"], "left").select("row", "text", F.col("marks.at").alias("at"), F.col("marks.gone").alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in slices(batches, "text"):
            p = Picks(texts, hashes, width, gram)
            of, at, gone = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for d, (a, g) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if a.is_valid:
                    of.append(np.full(len(a), d))
                    at.append(np.asarray(a.values).astype(np.int64))
                    gone.append(np.asarray(g.values.cast(pa.uint8())).astype(bool))
            of, at, gone = np.concatenate(of), np.concatenate(at), np.concatenate(gone)
            passed = found_in(sketch.value, p.pick, bits)
            passed &= ~np.isin((p.doc << 32) | p.start, ((of << 32) | at)[~gone])
            first = np.cumsum(p.lengths + 1) - (p.lengths + 1)
            edge = np.zeros(int((p.lengths + 1).sum()) + 1, np.int64)
            starts = np.concatenate([first[p.doc[passed]] + p.start[passed], (first[of] + at)[gone]])
            n = np.concatenate([p.n[passed], np.ones(int(gone.sum()), np.int64)])
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + n + width - 1, -1)
            stay = np.cumsum(edge) == 0
            kept, removed = [], []
            for d, words in enumerate(p.split):
                mine = stay[first[d] : first[d] + len(words)]
                left = words if mine.all() else [words[i] for i in np.flatnonzero(mine)]
                kept.append(b" ".join(left))
                removed.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).view(pa.string()), pa.array(p.lengths, pa.int64()), pa.array(removed, pa.int64())], ["row", "kept_text", "n_words", "n_removed"])

    schema = T.StructType([T.StructField("row", T.StructType([f for f in docs.schema])), T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(cut, schema)


def removal_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and the sha256 of the kept words, for every document."""
    out = without_repeats(docs.select("doc_id", "text"), **options)
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], width: int = 35) -> list[tuple[int, int, str]]:
    """What ``removal_report`` has to give, for few texts."""
    split = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for words in split:
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for words in split:
        gone = {i + j for i in range(len(words) - width + 1) if seen[tuple(words[i : i + width])] > 1 for j in range(width)}
        out.append((len(words), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()))
    return out
