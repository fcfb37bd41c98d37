"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= t differ by a squared distance of at most 2 - 2t. A fixed rotation spreads
that distance over the dimensions; split into blocks, some block of a linked pair holds at most its
proportional share of it. So each block is range-joined under its share, on strips of the block's first
coordinate as wide as the share's root, and the union of the blocks' candidates is verified with the
cosine of the vectors as given, in double precision. A pair is verified in the first block that proposes
it, so the union needs no shuffle of pairs.

No pair leaves a task: a tile sends, for each vector with links in it, how many, and the tile's least
vector connected to it. Strips of many vectors are cut into tiles of bounded size, so a crowded strip (a
third of all vectors, say) is many tasks. Equal vectors are joined once, with their count.

Defined results: a vector that is null, empty, zero, or holds a null or a non-finite component, or whose
label or id is null, links with nothing (n_links 0, its own component); vectors of different length never
link; repeated rows are other vectors; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, join_roots, stash

#: The squared distances of float32 coordinates are off by less than this.
SLACK = 1e-5


def rotation(dim: int, seed: int) -> np.ndarray:
    """An orthogonal matrix, the same for the same arguments everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int) -> np.ndarray:
    return np.unique(np.linspace(0, dim, min(blocks, dim) + 1).astype(int))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def usable(vec: str):
    """Whether a vector can link at all, as a condition on the column."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.93, blocks: int = 4, tile: int = 4096, seed: int = 7,
) -> DataFrame:
    """id, n_links, component_id and kept for every row, comparing rows of equal label."""
    total = 2 - 2 * threshold
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    good = usable("vec") & F.col("id").isNotNull() & F.col("label").isNotNull()
    reps = rows.where(good).groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    placed = stash(reps.mapInArrow(_place(total, blocks, seed), _placed_schema(reps)), "vectors")

    home = placed.select("*", F.posexplode("strips").alias("block", "strip")).drop("strips")
    where = ["label", "dim", "block", "strip"]
    sides = home.withColumn("probe", F.lit(0)).union(home.withColumn("strip", F.col("strip") - 1).withColumn("probe", F.lit(1)))
    sizes = home.groupBy(*where).agg(F.count("*").alias("n"))
    nexts = sizes.select("label", "dim", "block", (F.col("strip") - 1).alias("strip"), F.col("n").alias("n_next"))
    sizes = sizes.join(nexts, where, "left").withColumns({
        "homes": F.ceil(F.col("n") / tile), "probes": F.ceil(F.coalesce("n_next", F.lit(0)) / tile),
    }).drop("n", "n_next")
    # Home chunk i meets home chunks j >= i as tile (i, j) and probe chunk k as tile (i, homes + k).
    dealt = sides.join(sizes, where).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.when(F.col("probe") == 0, F.col("homes")).otherwise(F.col("probes"))))
    i = F.col("chunk")
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    mine = F.transform(upto(F.col("homes") + F.col("probes")), lambda j: F.when(j < i, F.struct(j.alias("i"), i.alias("j"))).otherwise(F.struct(i.alias("i"), j.alias("j"))))
    met = F.transform(upto(F.col("homes")), lambda h: F.struct(h.alias("i"), (F.col("homes") + i).alias("j")))
    tiles = dealt.withColumn("at", F.explode(F.when(F.col("probe") == 0, mine).otherwise(met)))
    # In tile (i, j) with j another home chunk, chunk j plays the probe.
    tiles = tiles.withColumn("right", (F.col("probe") == 1) | (F.col("chunk") != F.col("at.i")))
    tiles = tiles.select(*where, "at.i", "at.j", "right", F.col("at.i").__eq__(F.col("at.j")).alias("self"), "rep", "copies", "vec", "rot")
    rep_type = placed.schema["rep"].dataType.simpleString()
    # Dealt by tile: a join on the strip would else leave all tiles of a crowded strip in one task.
    linked = tiles.repartition(*where, "i", "j").groupBy(*where, "i", "j").applyInArrow(_compare(total, threshold, blocks), f"rep {rep_type}, links bigint, root {rep_type}")
    linked = stash(linked, "links")

    roots = connected_components(linked.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = placed.select("label", "vec", "rep", "copies").join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    known = known.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    out = rows.withColumn("good", good).join(known, ["label", "vec"], "left")
    out = out.select(
        F.col("id").alias(id_col),
        F.when(F.col("good"), F.col("n_links")).otherwise(0).cast("bigint").alias("n_links"),
        F.when(F.col("good"), F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _placed_schema(reps: DataFrame) -> str:
    kinds = dict(reps.dtypes)
    return f"label {kinds['label']}, vec {kinds['vec']}, rep {kinds['rep']}, copies bigint, dim int, rot array<float>, strips array<int>"


def _place(total: float, blocks: int, seed: int):
    """Adds the rotated unit vector and, for each block, the strip of its first coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(1)
            lengths = np.asarray(vec.value_lengths())
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                rot = (unit(_matrix(part.column(1))) @ rotation(int(dim), seed)).astype(np.float32)
                edges = block_edges(dim, blocks)
                widths = np.sqrt(total * np.diff(edges) / dim + SLACK) * (1 + 1e-6)
                strips = np.floor(rot[:, edges[:-1]].astype(np.float64) / widths).astype(np.int32)
                lists = lambda x, kind: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(part.num_rows, dim, np.int32)), lists(rot, pa.float32()), lists(strips, pa.int32())],
                    ["label", "vec", "rep", "copies", "dim", "rot", "strips"],
                )

    return run


def _compare(total: float, threshold: float, blocks: int, step: int = 512, most: int = 100_000):
    """Links within one tile: its own pairs when i = j, else those across its two sides."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        block = key[2].as_py()
        order = np.argsort(np.asarray(group["rep"].combine_chunks()), kind="stable")
        group = group.take(pa.array(order))
        reps, copies = group["rep"].combine_chunks(), np.asarray(group["copies"].combine_chunks())
        right = np.asarray(group["right"].combine_chunks().cast(pa.uint8())).astype(bool)
        n, same = len(right), bool(group["self"][0].as_py())
        left_at = np.flatnonzero(~right)
        right_at = left_at if same else np.flatnonzero(right)
        links, parent = np.zeros(n, np.int64), np.arange(n)
        if len(left_at) and len(right_at):
            rot, vec = _matrix(group["rot"]), unit(_matrix(group["vec"]))
            dim = rot.shape[1]
            edges = block_edges(dim, blocks)
            budgets = total * np.diff(edges) / dim + SLACK
            own = rot[:, edges[block] : edges[block + 1]]
            norms = (own * own).sum(axis=1)
            for first in range(0, len(left_at), step):
                l_at = left_at[first : first + step]
                near = norms[l_at, None] + norms[None, right_at] - 2 * (own[l_at] @ own[right_at].T) <= budgets[block] + SLACK
                a, b = np.nonzero(near)
                a, b = l_at[a], right_at[b]
                if same:
                    a, b = a[a < b], b[a < b]
                for at in range(0, len(a), most):
                    p, q = a[at : at + most], b[at : at + most]
                    apart = (rot[p] - rot[q]) ** 2
                    shares = np.add.reduceat(apart, edges[:-1], axis=1)[:, : block + 1] <= budgets[: block + 1]
                    first_here = shares[:, block] & ~shares[:, :block].any(axis=1)
                    p, q = p[first_here], q[first_here]
                    hit = (vec[p] * vec[q]).sum(axis=1) >= threshold
                    p, q = p[hit], q[hit]
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    parent = join_roots(parent, p, q)
        has = np.flatnonzero(links)
        return pa.table({"rep": reps.take(pa.array(has)), "links": pa.array(links[has]), "root": reps.take(pa.array(parent[has]))})

    return run
