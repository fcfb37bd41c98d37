"""Keyed merges as new snapshots, for tables without MERGE.

``merge`` compares an old and a new snapshot in one shuffle on the key (bucket both by it and there is none).
It takes a row for each key on either side; use ``latest_by`` before it where a source repeats keys.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir


def distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], null_safe: bool) -> Column:
    pairs = [a[k].eqNullSafe(b[k]) if null_safe else a[k] == b[k] for k in keys]
    return reduce(lambda x, y: x & y, pairs)


def merge(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str], now: Column, missing: str = "deactivate", scope: Column | None = None, null_safe: bool = False) -> DataFrame:
    """The next snapshot, with ``status``: created, updated, unchanged, withdrawn or kept.

    ``old`` has keys, compared columns, ``active``, ``created_at``, ``updated_at`` and ``refreshed_at``. A row that is
    seen again takes the new values and ``refreshed_at``; ``updated_at`` moves only if a compared column differs.
    A row that is not seen stays (``missing="keep"``) or becomes inactive, within ``scope`` if that is given.
    """
    if missing not in ("keep", "deactivate"):
        raise ValueError(missing)
    a, b = old.alias("a"), new.alias("b")
    on = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if null_safe else F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys))
    both = a.withColumn("_old", F.lit(True)).alias("a").join(b.withColumn("_new", F.lit(True)).alias("b"), on, "full")
    was, seen = F.col("a._old").isNotNull(), F.col("b._new").isNotNull()
    row = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in compared))
    changed = distinct_from(row("a"), row("b")) | ~F.coalesce(F.col("a.active"), F.lit(False))
    gone = F.coalesce(F.col("a.active"), F.lit(False)) & F.lit(missing == "deactivate")
    if scope is not None:
        gone = gone & F.coalesce(scope, F.lit(False))
    status = (
        F.when(seen & ~was, "created").when(seen & changed, "updated").when(seen, "unchanged").when(gone, "withdrawn").otherwise("kept")
    )
    both = both.withColumn("status", status)
    moved = F.col("status").isin("created", "updated", "withdrawn")
    return both.select(
        *(F.when(seen, F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys),
        *(F.when(seen, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in compared),
        F.when(seen, F.lit(True)).when(F.col("status") == "withdrawn", F.lit(False)).otherwise(F.col("a.active")).alias("active"),
        F.coalesce(F.col("a.created_at"), now).alias("created_at"),
        F.when(moved, now).otherwise(F.col("a.updated_at")).alias("updated_at"),
        F.when(seen, now).otherwise(F.col("a.refreshed_at")).alias("refreshed_at"),
        "status",
    )


def guarded(new: DataFrame) -> DataFrame:
    """Fails before anything is withdrawn if a payload is empty."""
    if new.isEmpty():
        raise ValueError("the payload is empty; nothing was changed")
    return new


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], null_safe: bool = True) -> DataFrame:
    """The rows of ``new`` whose key ``old`` doesn't have."""
    return new.join(old, same_keys(new, old, keys, null_safe), "left_anti")


def not_seen(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new, same_keys(old, new, keys, False), "left_anti")


def revised(old: DataFrame, new: DataFrame, key: str, hash_col: str, last_sequence: int) -> DataFrame:
    """Each row of ``new`` with ``revision`` (one more if its content hash changed, 1 at least) and a new ``sequence``,
    which grows along the key."""
    held = old.select(F.col(key).alias("_key"), F.col(hash_col).alias("_hash"), F.col("revision").alias("_revision"))
    joined = new.join(held, F.col(key) == F.col("_key"), "left")
    same = F.col("_hash").eqNullSafe(F.col(hash_col))
    revision = F.when(same, F.greatest(F.coalesce("_revision", F.lit(0)), F.lit(1))).otherwise(F.coalesce("_revision", F.lit(0)) + 1)
    rows = joined.withColumn("revision", revision).drop("_key", "_hash", "_revision")
    return numbered(rows, [key], last_sequence, "sequence")


def numbered(df: DataFrame, order: list[str], last: int = 0, name: str = "sequence") -> DataFrame:
    """Numbers from ``last + 1`` in the given order, which has to be a total one, without a window over all rows.

    Rows are dealt by range and written to the shared folder with the number of their range; a row's number is its
    place in the range plus the sizes of the ranges before, a row for each range.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/numbered-{uuid.uuid4().hex}"
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranges = spark.read.parquet(path)
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = ranges.withColumn("_within", within).join(F.broadcast(before), "_range")
    return placed.select(*df.columns, (F.col("_before") + F.col("_within") + last).cast("bigint").alias(name))


def newer_wins(old: DataFrame, new: DataFrame, key: str, sequence: str) -> DataFrame:
    """Upserts and deletes by sequence: for each key the row with the higher one; of equal ones a new row, then the
    greater by all columns."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = F.struct(F.col(sequence), F.col("_new"), F.to_json(F.struct(*old.columns)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*old.columns), order).alias("row"))
    return best.select("row.*")


def promoted(claims: DataFrame, canonical: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Approved claims that have no canonical row yet, projected by ``columns`` (which hold the fallbacks)."""
    ready = claims.where("review_status = 'approved'")
    fresh = ready.join(canonical.select(F.col("extracted_observation_id").alias("_done")), F.col("id") == F.col("_done"), "left_anti")
    return fresh.select(F.col("id").alias("extracted_observation_id"), *(c.alias(n) for n, c in columns.items()))


def latest_decision(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Review status from an append-only log of decisions; pending without one."""
    last = decisions.groupBy("claim_id").agg(F.max_by(F.struct("decision", "decided_by", "decided_at"), F.struct("decided_at", "id")).alias("last"))
    joined = claims.join(last, claims["id"] == last["claim_id"], "left").drop("claim_id")
    return joined.withColumn("review_status", F.coalesce("last.decision", F.lit("pending"))).drop("last")
