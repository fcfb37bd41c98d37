"""Sorting, paging and the first few."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50, most: int = 100) -> DataFrame:
    """A page of rows; ``order`` ends in a unique column. Sizes are held between 1 and ``most``."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def merged_top(frames: list[DataFrame], order: list[Column], n: int = 50) -> DataFrame:
    """The first ``n`` over several tables: each is cut to its own first ``n`` before they meet."""
    cut = [f.orderBy(*order).limit(n) for f in frames]
    return reduce(lambda a, b: a.unionByName(b), cut).orderBy(*order).limit(n)


def enumerated(c: Column, names: list[str]) -> Column:
    """Place of a value in a list; what isn't in it comes last."""
    place = F.array_position(F.array(*(F.lit(n) for n in names)), c)
    return F.when(place > 0, place).otherwise(len(names) + 1)


def component_order(sort_order: str = "sort_order") -> list[Column]:
    return [F.coalesce(F.col(sort_order), F.lit(1_000_000)).asc(), F.col("code").asc_nulls_last(), F.col("name").asc_nulls_last(), F.col("id").asc()]


def claim_due(queue: DataFrame, next_run: str, now: Column, n: int, tie: str = "id") -> DataFrame:
    return queue.where(F.col(next_run) <= now).orderBy(next_run, tie).limit(n)
