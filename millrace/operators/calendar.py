"""Daily series made complete, and ranges of dates cut up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def densify(series: DataFrame, keys: list[str], date: str, values: list[str], until: Column | None = None) -> DataFrame:
    """A row for each day from a key's first to its last date (or ``until``); missing values are zero.

    ``series`` has a row for each key and date at most. Days are made by key, not by a calendar table, so the
    join meets only days of the key.
    """
    last = F.max(date) if until is None else until
    span = series.groupBy(*keys).agg(F.min(date).alias("_from"), last.alias("_to"))
    days = span.select(*keys, F.explode(F.sequence("_from", "_to", F.expr("interval 1 day"))).alias(date))
    joined = days.join(series, [*keys, date], "left")
    return joined.withColumns({v: F.coalesce(F.col(v), F.lit(0)) for v in values})


def refreshed(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New values where there are any, else the old ones, else zero, over the keys of both."""
    renamed = new.select(*keys, *(F.col(v).alias(f"_new_{v}") for v in values))
    joined = old.select(*keys, *values).join(renamed, list(keys), "full")
    return joined.select(*keys, *(F.coalesce(F.col(f"_new_{v}"), F.col(v), F.lit(0)).alias(v) for v in values))


def split_range(ranges: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """Closed ranges of dates cut into windows of at most ``days`` days: window_start, window_end."""
    starts = F.sequence(start, end, F.expr(f"interval {int(days)} day"))
    out = ranges.withColumn("window_start", F.explode(starts))
    return out.withColumn("window_end", F.least(F.date_add("window_start", days - 1), F.col(end)))


def incomplete(series: DataFrame, keys: list[str], date: str, first: Column, last: Column) -> DataFrame:
    """Keys whose dates are not exactly the days from first to last."""
    want = F.datediff(last, first) + 1
    days = series.groupBy(*keys).agg(F.countDistinct(date).alias("days"), F.min(date).alias("first"), F.max(date).alias("last"), F.count("*").alias("n"))
    return days.where((F.col("days") != want) | (F.col("n") != want) | (F.col("first") != first) | (F.col("last") != last))


def refresh_start(last: Column, earliest: Column, lookback_days: int, complete: Column) -> Column:
    """Where to fetch from: some days before the last date, or all if the history has holes."""
    return F.when(complete & last.isNotNull(), F.greatest(earliest, F.date_sub(last, lookback_days))).otherwise(earliest)
