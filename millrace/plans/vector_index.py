"""Semantic search over an inverted file: vectors written by the cell of their nearest centroid.

Centroids are fitted on at most ``sample`` vectors, the least by a hash of their id; every vector is assigned, and
the table is partitioned by cell, so that a search reads the files of a few cells. What is read is ranked by the exact
distance. Each cell keeps the greatest angle between its centroid and a vector in it, which bounds how near a vector of
the cell can be to a query: with ``exact`` all cells that this bound can't rule out are read, and the answer is that of a
scan of all vectors; without it, the ``probes`` cells with the nearest centroids are.

A large cell is many files: rows are rebalanced by cell when they are written, which splits it.

Defined results: vectors that are null, empty or zero, hold a null or a non-finite entry, or are of another length than most of the sample,
lie in cell -1, have no distance and are never found, as in a scan; a query of another length is an error; repeated rows are
found each; ties go to the smaller id; an empty table gives an index without cells, whose answers are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine_distance
from .search import nearest

NOWHERE = -1
#: Angles and distances in double precision are off by less than this.
SLACK = 1e-7


def directions(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the lists that have a direction of length ``dim``."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    here = np.flatnonzero(lengths == dim)
    x = np.asarray(column.take(pa.array(here)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(here), dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x = x[good] / np.abs(x[good]).max(axis=1, keepdims=True)
    return here[good], x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fitted(x: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids of unit vectors by k-means on the sphere; a centroid that loses its vectors takes the worst placed one."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        at, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(best)[: len(empty)]]
        sizes = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(sizes > 1e-12, sums / np.maximum(sizes, 1e-12), c)
    return c


def build(vectors: DataFrame, id_col: str, vec_col: str, path: str, cells: int | None = None, sample: int = 20_000, rounds: int = 10, seed: int = 1) -> "VectorIndex":
    """Write the index of ``vectors`` to ``path``. ``cells``: about the root of the number of rows if it isn't given, 4,096 at most."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    chosen = rows.where(F.size("vec") > 0).orderBy(F.xxhash64("id"), F.xxhash64("vec")).limit(sample).select("vec").toArrow()["vec"]
    chosen = chosen.combine_chunks() if isinstance(chosen, pa.ChunkedArray) else chosen
    lengths = np.asarray(chosen.value_lengths().fill_null(0)) if len(chosen) else np.zeros(0, int)
    dim = int(np.bincount(lengths).argmax()) if len(lengths) else 0
    _, x = directions(chosen, dim) if dim else (None, np.zeros((0, 0)))
    if cells is None:
        cells = int(np.clip(round(rows.count() ** 0.5), 1, 4096))
    centroids = fitted(x, cells, rounds, seed) if len(x) else np.zeros((0, dim))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.full(batch.num_rows, NOWHERE), np.full(batch.num_rows, np.nan)
            if len(centroids):
                at, unit = directions(batch.column(1), dim)
                near = unit @ centroids.T
                if len(at):
                    cell[at], angle[at] = near.argmax(axis=1), np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle, from_pandas=True)], ["id", "vec", "cell", "angle"])

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    spark.createDataFrame([], schema).write.parquet(f"{path}/shape")
    rows.mapInArrow(place, schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    placed = spark.read.schema(schema).parquet(f"{path}/vectors").where(F.col("cell") != NOWHERE)
    held = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    shapes = spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(centroids)], "cell int, centroid array<double>")
    shapes.join(held, "cell").coalesce(1).write.parquet(f"{path}/cells")
    return VectorIndex(spark, path)


class VectorIndex:
    """A written index. The cells' centroids, at most as many as were asked for, are held by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        shape = spark.read.parquet(f"{path}/shape").schema
        self.vectors = spark.read.schema(shape).parquet(f"{path}/vectors")
        cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])
        self.cells = np.array([r["cell"] for r in cells], int)
        self.centroids = np.array([r["centroid"] for r in cells])
        self.sizes, self.radius = np.array([r["n"] for r in cells], int), np.array([r["radius"] for r in cells])

    def _angles(self, query: list[float]) -> np.ndarray:
        q = np.array(query, float)
        if len(self.cells) and len(q) != self.centroids.shape[1]:
            raise ValueError(f"the index is of vectors of length {self.centroids.shape[1]}, the query's is {len(q)}")
        return np.arccos(np.clip(self.centroids @ (q / np.sqrt(q @ q)), -1, 1)) if len(self.cells) else np.zeros(0)

    def rows(self, cells: list[int]) -> DataFrame:
        """The vectors of some cells: other cells' files aren't read."""
        return self.vectors.where(F.col("cell").isin([int(c) for c in cells]))

    def nearest_cells(self, query: list[float], probes: int, least_rows: int = 0) -> list[int]:
        """The ``probes`` cells with the nearest centroids, and further ones until they hold ``least_rows``."""
        order = np.argsort(self._angles(query), kind="stable")
        enough = int(np.searchsorted(np.cumsum(self.sizes[order]), least_rows)) + 1
        return self.cells[order[: max(probes, enough)]].tolist()

    def cells_within(self, query: list[float], distance: float) -> list[int]:
        """The cells that may hold a vector no farther than ``distance``: others are too far by their radius."""
        angle = np.arccos(np.clip(1 - distance, -1, 1)) + SLACK
        return self.cells[self._angles(query) - self.radius <= angle].tolist()

    def search(self, query: list[float], limit: int, probes: int = 8, most: float | None = None, exact: bool = False) -> DataFrame:
        """(id, distance) of the ``limit`` nearest, ties to the smaller id; then those beyond ``most`` go."""
        return nearest(self.rows(self.cells_for(query, limit, probes, exact)), query, "id", "vec", limit, most)

    def cells_for(self, query: list[float], limit: int, probes: int, exact: bool) -> list[int]:
        """The cells that a search reads."""
        cells = self.nearest_cells(query, probes, limit)
        if not exact or not len(self.cells):
            return cells
        found, farthest = nearest(self.rows(cells), query, "id", "vec", limit).agg(F.count("*"), F.max("distance")).first()
        return self.cells.tolist() if found < limit else self.cells_within(query, farthest + SLACK)

    def search_many(self, queries: DataFrame, id_col: str, vec_col: str, limit: int, probes: int = 8) -> DataFrame:
        """(query_id, id, distance, rank from 1) for a table of queries, each asked of its own cells by a join on the cell."""
        cells, centroids = self.cells, self.centroids

        def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, unit = directions(batch.column(1), centroids.shape[1]) if len(cells) else (np.zeros(0, int), None)
                order = cells[np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :probes]] if len(at) else np.zeros((0, 1), int)
                lists = pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), lists], ["query_id", "query", "cells"])

        asked = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("query"))
        aimed = asked.mapInArrow(aim, T.StructType([*asked.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))
        pairs = aimed.select("query_id", "query", F.explode("cells").alias("cell")).join(self.vectors, "cell")
        scored = pairs.select("query_id", "id", cosine_distance(F.col("vec"), F.col("query")).alias("distance")).where("distance is not null")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return scored.withColumn("rank", place).where(F.col("rank") <= limit)
