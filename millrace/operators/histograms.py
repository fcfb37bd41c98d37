"""Histograms as stored partial states, which deltas are merged into.

A state of a key is the count, sum, least and greatest of its values and the counts by bucket: state of parts merge into the
state of the whole, in any order. A delta is merged into the stored table in one step that also records its batch, so
a delta that is sent again, or whose writer died and tries again, counts once.

Defined results: null values don't count; a key without values has no state; a value equal to a bound is in that bound's bucket;
values beyond the last bound are in one more bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import ManifestTable

# The bounds of the buckets.
BOUNDS = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1_000, 2_500, 5_000, 7_500, 10_000)
NUMBERS = ("n", "total", "least", "greatest", "buckets")


def place(value: Column, bounds: tuple) -> Column:
    """The number of the first bound that isn't below the value."""
    return F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b < value))


def partial(df: DataFrame, keys: list[str], value: str, bounds: tuple = BOUNDS) -> DataFrame:
    """The state of each key: n, total, least, greatest, buckets."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_at", place(F.col(value), bounds))
    counts = F.array(*(F.count_if(F.col("_at") == k) for k in range(len(bounds) + 1)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"), counts.alias("buckets"))


def merged(states: DataFrame, keys: list[str], buckets: int = len(BOUNDS) + 1) -> DataFrame:
    """One state a key of several."""
    counts = F.array(*(F.sum(F.get("buckets", F.lit(k))) for k in range(buckets)))
    out = states.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), counts.alias("buckets"))
    # Sums of decimals are wider than what is stored.
    return out.withColumns({c: F.col(c).cast(states.schema[c].dataType) for c in NUMBERS})


class StoredHistograms:
    """Histograms by key in a table of their own."""

    def __init__(self, spark: SparkSession, path: str, keys: str, value_type: str = "double", bounds: tuple = BOUNDS):
        """``keys``: their names and types, as ``"name string, day date"``."""
        names = spark.createDataFrame([], keys).columns
        total = "decimal(38,4)" if value_type.startswith("decimal") else value_type
        self.keys, self.bounds, self.value_type = names, bounds, value_type
        self.table = ManifestTable(spark, path, f"{keys}, n long, total {total}, least {value_type}, greatest {value_type}, buckets array<long>", names)

    def merge(self, delta: DataFrame, value: str, batch: str) -> int:
        """Add the values of ``delta``, once for each ``batch``."""
        held = self.table.schema
        state = partial(delta, self.keys, value, self.bounds)
        state = state.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in held))
        return self.table.rewrite(state, lambda old: merged(old.unionByName(state), self.keys, len(self.bounds) + 1), batch)

    def read(self) -> DataFrame:
        return self.table.read()
