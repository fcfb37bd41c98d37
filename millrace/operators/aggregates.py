"""Aggregates whose meaning is more than a sum: planned against actual, complete groups, checks, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent_change


def variance(planned: DataFrame, actual: DataFrame, on: list[str], also_by: list[str] = (), amount: str = "amount", spent: str = "actual_expenditure") -> DataFrame:
    """Planned sums beside what was spent, with difference and percent (null where the plan is zero).

    A planned row joins before it is summed, as a null part of the key never matches. Plans are summed by key
    first, so the join meets one row for each group.
    """
    planned = planned.groupBy(*on, *also_by).agg(F.sum(amount).alias("_planned"))
    spent_rows = actual.select(*(F.col(k).alias(f"_{k}") for k in on), F.col(spent))
    match = None
    for k in on:
        match = (F.col(k) == F.col(f"_{k}")) if match is None else match & (F.col(k) == F.col(f"_{k}"))
    joined = planned.join(spent_rows, match, "left").groupBy(*on, *also_by, spent).agg(F.sum("_planned").alias("consolidated_estimate"))
    return joined.select(
        *on, *also_by, "consolidated_estimate", spent,
        (F.col(spent) - F.col("consolidated_estimate")).alias("variance_amount"),
        percent_change(F.col(spent), F.col("consolidated_estimate")).alias("variance_pct"),
    )


def anomalous(deviations: DataFrame, percent: float = 20) -> DataFrame:
    return deviations.where(F.abs("variance_pct") > percent)


def severity_rank(c: Column) -> Column:
    return F.when(c == "critical", 4).when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def review_queue(claims: DataFrame, flags: DataFrame, compat: bool = True) -> DataFrame:
    """Pending claims that need review or have flags, with open flags counted and the worst named.

    With ``compat`` a claim without any flag has ``has_open_flags`` true and rank 0, as a left join makes its
    flag's ``resolved_at`` null; without it, false and null. Flags are summed before the join: one row for each claim meets it.
    """
    is_open = F.col("resolved_at").isNull()
    rank = severity_rank(F.col("severity"))
    of = flags.groupBy("claim_id").agg(
        F.count_if(is_open).alias("open_flag_count"),
        F.max(F.when(is_open, rank)).alias("highest_open_severity_rank"),
        F.max_by(F.when(is_open, F.col("severity")), F.when(is_open, F.struct(rank, "flag_id"))).alias("highest_open_severity"),
        F.bool_or(is_open).alias("has_open_flags"),
    )
    joined = claims.where("review_status = 'pending'").join(of, claims["id"] == of["claim_id"], "left")
    joined = joined.where(F.col("needs_review") | F.col("claim_id").isNotNull())
    none = F.col("claim_id").isNull()
    return joined.withColumns({
        "open_flag_count": F.coalesce("open_flag_count", F.lit(0).cast("bigint")),
        "highest_open_severity_rank": F.when(none, 0).otherwise(F.col("highest_open_severity_rank")) if compat else F.col("highest_open_severity_rank"),
        "has_open_flags": F.coalesce("has_open_flags", F.lit(compat)),
    }).drop("claim_id")


def complete_groups(df: DataFrame, keys: list[str], member: str, members: int, value: str, how: str = "avg") -> DataFrame:
    """Mean or sum of groups in which every one of ``members`` members reports."""
    total = F.sum(value) if how == "sum" else F.sum(value) / F.count(value)
    out = df.groupBy(*keys).agg(F.countDistinct(member).alias("_members"), total.alias(value))
    return out.where(F.col("_members") == members).drop("_members")


def pivoted_ratio(df: DataFrame, keys: list[str], series: str, value: str, names: list, formula) -> DataFrame:
    """``formula(*columns)`` over the named series of each key; keys that lack one, or give null, have no row."""
    parts = [F.max(F.when(F.col(series) == n, F.col(value))).alias(f"_{i}") for i, n in enumerate(names)]
    wide = df.groupBy(*keys).agg(*parts)
    return wide.select(*keys, formula(*(F.col(f"_{i}") for i in range(len(names)))).alias("value")).where("value is not null")


def with_total(df: DataFrame, keys: list[str], category: Column, value: Column, total: str = "total") -> DataFrame:
    """Sums by category and over all, in one pass; rows without a category count in the total only."""
    each = df.select(*keys, F.explode(F.array_compact(F.array(category, F.lit(total)))).alias("category"), value.alias("value"))
    return each.groupBy(*keys, "category").agg(F.sum("value").alias("value"))


def composition_check(parts: DataFrame, slice_keys: list[str], expect_100: Column) -> DataFrame:
    """Do a slice's components add up to its total row, or to 100?

    ``parts``: component_id, is_total, value, approved_at. A row for each check that applies; within 0.5 % or 0.01
    is ok, from 2 % high, from 10 % critical.
    """
    component = ~F.col("is_total") & F.col("component_id").isNotNull()
    of = parts.groupBy(*slice_keys).agg(
        F.coalesce(F.sum(F.when(component, F.col("value"))), F.lit(0.0)).alias("actual"),
        F.bool_or("is_total").alias("_has_total"),
        F.max_by(F.when(F.col("is_total"), F.coalesce("value", F.lit(0.0))), F.when(F.col("is_total"), F.col("approved_at"))).alias("_total"),
        F.bool_or(expect_100).alias("_hundred"),
    )
    checks = F.array_compact(F.array(
        F.when(F.col("_has_total"), F.struct(F.lit("components_sum_to_total").alias("validation_type"), F.col("_total").alias("expected"))),
        F.when(F.col("_hundred"), F.struct(F.lit("components_sum_to_100").alias("validation_type"), F.lit(100.0).alias("expected"))),
    ))
    out = of.select(*slice_keys, "actual", F.inline(checks)).withColumn("difference", F.col("actual") - F.col("expected"))
    size = F.abs("difference")
    ratio = F.when(F.col("expected") == 0, size).otherwise(size / F.abs("expected"))
    fine = size <= F.greatest(F.abs("expected") * 0.005, F.lit(0.01))
    return out.withColumns({
        "status": F.when(fine, "ok").when(ratio >= 0.02, "fail").otherwise("warn"),
        "severity": F.when(fine, F.lit(None).cast("string")).when(ratio >= 0.1, "critical").when(ratio >= 0.02, "high").otherwise("medium"),
    })


def paid_split(df: DataFrame, total: str, breakdown: str) -> DataFrame:
    """``paid`` and ``organic`` rows beside the combined one, from an array of (dimension, value).

    Without a breakdown a zero total splits into zeros, any other total doesn't.
    """
    paid = F.aggregate(F.filter(breakdown, lambda x: x["dimension"].contains("AD")), F.lit(0).cast("double"), lambda s, x: s + x["value"])
    split = (F.size(breakdown) > 0) | (F.col(total) == 0)
    row = lambda kind, value: F.struct(F.lit(kind).alias("paid"), value.cast("double").alias("value"))
    rows = F.when(split, F.array(row(None, F.col(total)), row(True, paid), row(False, F.col(total) - paid))).otherwise(F.array(row(None, F.col(total))))
    return df.select(*(c for c in df.columns if c not in (total, breakdown)), F.inline(rows))


def histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Count, sum, least, greatest and the counts of values up to each bound (the last bucket has none)."""
    bucket = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col(value) <= bounds[i], i).otherwise(bucket)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, bucket.cast("int").alias("bucket"))
    return counts.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def suppressed(cells: DataFrame, keys: list[str], column: str, base: int = 50) -> DataFrame:
    """Cells of long tables (``kind``, ``value``) without the columns whose unweighted base is small or missing.

    All values of such a column become null; columns called unknown go.
    """
    known = cells.where(F.lower(column) != "unknown")
    bases = known.where("kind = 'unweighted-sample-size'").groupBy(*keys, column).agg(F.max("value").alias("_base"))
    joined = known.join(bases, [*keys, column], "left")
    shown = F.coalesce(F.col("_base") >= base, F.lit(False))
    return joined.withColumn("value", F.when(shown, F.col("value"))).withColumn("suppressed", ~shown).drop("_base")


def arms_as_tables(cells: DataFrame, breakdown: str = "breakdown", column: str = "column") -> DataFrame:
    """Columns of the breakdown ``arm`` as tables of their own."""
    return cells.where(F.col(breakdown) == "arm").withColumnRenamed(column, "arm").drop(breakdown)


def tally(df: DataFrame, answers: str) -> DataFrame:
    """How often each answer was given to each question of a map of answers."""
    return df.select(F.explode(answers).alias("question", "answer")).groupBy("question", "answer").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def facets(df: DataFrame, field: str) -> DataFrame:
    """Counts by value of a field, each value of an array field once a row."""
    is_array = dict(df.dtypes)[field].startswith("array")
    values = df.select(F.explode(F.array_distinct(field)).alias("value")) if is_array else df.select(F.col(field).alias("value"))
    return values.groupBy("value").agg(F.count("*").alias("n"))
