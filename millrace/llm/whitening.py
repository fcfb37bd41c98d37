"""Whitening of embeddings by a covariance that is computed in tiles.

Vectors are put on a grid of integers, of which each distinct one is fitted once. Sums by dimension give the
centre. Then the fit list is cut twice: rows into blocks, columns into blocks of ``tile`` dimensions. A pair of
column blocks is a tile key; the centred column blocks of a row block travel to the tile keys that they belong to,
are multiplied there, and the products are summed for each tile. Only the assembled matrix, whose size is given
by the dimensions and not by the rows, comes to the driver, where it is decomposed. The covariance of the whitened
fit list, as a check, is made by the same tiles.

Numbers: grid values are 64-bit integers and their sums exact. A value is centred as (x - c) - (S - n c)/n with c the
whole number next to the mean, so that no digits are lost to a large offset before anything is multiplied.

Defined results: a vector that is null or empty, or holds a null or a non-finite entry, gives no row; vectors of
different length are whitened apart, each length with a fit list of its own; a null or repeated id is a row
like any other; an entry beyond 2**62 on the grid counts as 2**62 (and below alike); a deviation beyond a long is given
as the greatest long; a component without variance (its eigenvalue is rounding against the greatest) has whitened null
and isn't part of identity_error, and where no vector varies explained and identity_error are null; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_stash, stash

FAR = 2**62
LONG = 2**63 - 1


def on_grid(vec: str, scale: float, shift: int):
    """floor(scale * entry) + shift, as longs."""
    place = lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(FAR)), F.lit(-FAR)) + F.lit(shift)
    return F.transform(vec, place)


def whole(vec: str):
    """Whether a vector has entries, all of them finite."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite, F.lit(False))


def matrices(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows whose lists in ``column`` have one length, at most ``rows`` of them, with the lists as a matrix."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(lists.value_lengths())
        for dim in np.unique(lengths):
            here = np.flatnonzero(lengths == dim)
            for at in range(0, len(here), rows):
                some = batch.take(pa.array(here[at : at + rows]))
                values = some.column(some.schema.get_field_index(column)).flatten()
                yield some, np.asarray(values).reshape(-1, dim)


def column_sums(fit: DataFrame, column: str = "x") -> dict[int, tuple[int, list[int]]]:
    """For each length of the lists of longs, how many there are and the exact sums by dimension.

    A task sends a row for each dimension; the driver gets the sums alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for _, x in matrices(batches, column, 1 << 16):
            high = x >> 31  # two parts, so that a task's sums stay within 64 bits
            n, of_high, of_low = held.get(x.shape[1], (0, 0, 0))
            held[x.shape[1]] = (n + len(x), of_high + high.sum(axis=0), of_low + (x - (high << 31)).sum(axis=0))
        for dim, (n, high, low) in held.items():
            whole = np.ones(dim, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(whole * dim), pa.array(np.arange(dim)), pa.array(whole * n), pa.array(high), pa.array(low)], ["dim", "at", "n", "high", "low"])

    parts = fit.select(column).mapInArrow(run, "dim long, at long, n long, high long, low long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), exact("high"), exact("low")).collect()):
        out.setdefault(r["dim"], (r["n"], []))[1].append(int(r["high"]) * 2**31 + int(r["low"]))
    return out


def tiled_products(rows: DataFrame, column: str, made: Callable[[np.ndarray], np.ndarray], tile: int, block: int) -> dict[int, np.ndarray]:
    """For each length of the lists in ``column``, the sum over rows of outer products of ``made(list)``.

    ``made`` takes and gives a matrix, a row for each list; what it gives may have fewer columns.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for some, x in matrices(batches, column, block):
            y = np.ascontiguousarray(made(x).T)  # a row for each dimension
            blocks = [y[at : at + tile] for at in range(0, len(y), tile)]
            for at, part in enumerate(blocks):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v]) for v in (x.shape[1], n, at, len(blocks), len(part), part.tobytes())], ["dim", "n", "at", "blocks", "width", "data"]
                )
            n += 1

    blocks = rows.select(column).mapInArrow(cut, "dim long, n long, at long, blocks long, width long, data binary")
    blocks = blocks.withColumn("row_block", F.struct(F.spark_partition_id(), "n"))
    # Column block a belongs to the tiles (a, b) and (b, a); the lower number stands first.
    tiles = blocks.select("dim", "row_block", "at", "width", "data", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    left, right = F.least("at", "other"), F.greatest("at", "other")
    part = F.struct("width", "data")
    met = tiles.groupBy("dim", left.alias("i"), right.alias("j"), "row_block").agg(
        F.max_by(part, F.when(F.col("at") <= F.col("other"), F.lit(1))).alias("a"), F.max_by(part, F.when(F.col("at") >= F.col("other"), F.lit(1))).alias("b")
    )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for dim, i, j, a, b in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                of = [np.frombuffer(x["data"]).reshape(x["width"], -1) for x in (a, b)]
                product = of[0] @ of[1].T
                held[dim, i, j] = held[dim, i, j] + product if (dim, i, j) in held else product
        for (dim, i, j), product in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (dim, i, j, product.shape[1])] + [pa.array([product.ravel()], pa.list_(pa.float64()))], ["dim", "i", "j", "width", "products"])

    products = met.select("dim", "i", "j", "a", "b").mapInArrow(multiply, "dim long, i long, j long, width long, products array<double>")
    each = products.select("dim", "i", "j", "width", F.posexplode("products").alias("at", "value"))
    summed = each.groupBy("dim", "i", "j", "width", "at").agg(F.sum("value").alias("value"))
    whole = summed.groupBy("dim", "i", "j", "width").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("of"))
    out: dict[int, dict] = {}
    for r in whole.select("dim", "i", "j", "width", F.col("of.value").alias("value")).toArrow().to_pylist():
        out.setdefault(r["dim"], {})[r["i"], r["j"]] = np.array(r["value"]).reshape(-1, r["width"])
    return {dim: assembled(tiles) for dim, tiles in out.items()}


def assembled(tiles: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """The symmetric matrix whose upper tiles are given."""
    n = 1 + max(j for _, j in tiles)
    return np.block([[tiles[i, j] if i <= j else tiles[j, i].T for j in range(n)] for i in range(n)])


class Model:
    """Centre and components of the vectors of one length."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, most: int):
        self.n, self.sums = n, sums
        e, v = np.linalg.eigh(covariance)
        e, v = np.maximum(e[::-1], 0), v[:, ::-1]
        self.real = e > max(e[0], 0) * len(e) * 1e-13
        self.values, self.vectors, self.trace = e[:most], v[:, :most], float(np.trace(covariance))
        self.real = self.real[:most]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """A column for each component that has variance."""
        return centred(x, self.n, self.sums) @ (self.vectors[:, self.real] / np.sqrt(self.values[self.real]))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums over dimensions of (n x - S)**2, exact; the greatest long if beyond."""
        c = [s // self.n for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, c, strict=True)]
        y = x - np.array(c)
        if len(c) * (self.n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 <= LONG:
            return ((self.n * y - np.array(rest)) ** 2).sum(axis=1)
        far = self.n * (x.astype(object) - np.array(c, object)) - np.array(rest, object)
        return np.minimum((far * far).sum(axis=1), LONG).astype(np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    c = [s // n for s in sums]
    rest = np.array([(s - n * m) / n for s, m in zip(sums, c, strict=True)])
    return (x - np.array(c)).astype(np.float64) - rest


def fit(grid: DataFrame, column: str = "x", most: int = 16, tile: int = 32, block: int = 4096) -> dict[int, tuple[Model, float | None]]:
    """For each length, the model of the distinct lists of longs in ``column``, and the error of its identity."""
    once = stash(grid.select(column).distinct(), "fit")
    sums = column_sums(once, column)
    products = tiled_products(once, column, lambda x: centred(x, *sums[x.shape[1]]), tile, block)
    models = {dim: Model(n, of, products[dim] / n, most) for dim, (n, of) in sums.items()}
    # The whitened fit list has the mean zero, as it was centred by its own sums.
    varied = [dim for dim, m in models.items() if m.real.any()]
    checked = once.where(F.size(column).isin(varied)) if varied else once.limit(0)
    check = tiled_products(checked, column, lambda x: models[x.shape[1]].whitened(x), tile, block)
    error = {dim: float(np.abs(check[dim] / models[dim].n - np.eye(len(check[dim]))).max()) for dim in varied}
    drop_stash(once)
    return {dim: (m, error.get(dim)) for dim, m in models.items()}


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, shift: int = 1_000_000, most: int = 16, tile: int = 32) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component.

    The model (``most`` components and a centre for each length of vectors) is a bounded set of small arrays.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(whole("vec"))
    grid = rows.select("id", on_grid("vec", scale, shift).alias("x"))
    models = fit(grid, most=most, tile=tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in matrices(batches, "x", 1 << 13):
            m, error = models[x.shape[1]]
            k = len(m.values)
            out = np.full((len(x), k), np.nan)
            out[:, m.real] = m.whitened(x)
            lists = pa.ListArray.from_arrays(np.arange(0, len(x) * k + 1, k, np.int32), pa.array(out.ravel(), from_pandas=True))
            share = (m.values / m.trace).tolist() if m.trace > 0 else [None] * k
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(np.full(len(x), m.n)), pa.array(m.deviations(x)), lists, pa.array([share] * len(x), pa.list_(pa.float64())), pa.array([error] * len(x), pa.float64())],
                ["id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = dict(grid.dtypes)["id"]
    found = grid.mapInArrow(run, f"id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    each = found.select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    return each.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error")
