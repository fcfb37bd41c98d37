"""What the series endpoint asks: checkpoints, counted pages, grains, canonical measures, regions, audits, open questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpoints(rows: DataFrame, keys: list[str], at: str, sequence: str, overlap: str = "10 minutes") -> DataFrame:
    """For each key the last time, the greatest sequence, and the least sequence of the stretch of ``overlap`` before the last time.

    Two sums that combine before the shuffle; rows without a time count for the sequence alone.
    """
    last = rows.groupBy(*keys).agg(F.max(at).alias("last_at"), F.max(sequence).alias("checkpoint"))
    held = rows.join(last.select(*keys, "last_at"), keys)
    from_sequence = held.where(F.col(at) >= F.col("last_at") - F.expr(f"interval {overlap}")).groupBy(*keys).agg(F.min(sequence).alias("from_sequence"))
    return last.join(from_sequence, keys, "left")


def counted_page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50, most: int = 100) -> DataFrame:
    """A page of rows with ``total``, the number of all rows; sizes are held between 1 and ``most``."""
    from .topk import page

    total = df.agg(F.count("*").alias("total"))  # one row
    return page(df, order, number, size, most).join(F.broadcast(total))


def grain_date(platform: Column, at: Column, weekly: tuple[str, ...] = ("instagram",)) -> Column:
    """The day of a metric, or the Monday of its week on platforms that report by week."""
    return F.when(platform.isin(*weekly), F.to_date(F.date_trunc("week", at))).otherwise(F.to_date(at))


def canonical_measure(rows: DataFrame, equivalences: DataFrame, measure: str = "measure_id") -> DataFrame:
    """``rows`` with ``canonical_id``: the measure that an organization's own is equivalent to, else itself.

    ``equivalences``: measure_id, canonical_id; of several the least counts, and chains aren't followed.
    """
    one = equivalences.groupBy(F.col("measure_id").alias("_measure")).agg(F.min("canonical_id").alias("_canonical"))
    joined = rows.join(one, F.col(measure) == F.col("_measure"), "left")
    return joined.select(*rows.columns, F.coalesce("_canonical", measure).alias("canonical_id"))


def in_region(given: Column, derived: Column, region: str) -> Column:
    """Rows of a region: the one given, or where none is the one derived."""
    return F.coalesce(given, derived) == region


def audit_groups(facts: DataFrame, measures: DataFrame, units: DataFrame, organizations: DataFrame) -> DataFrame:
    """How many facts each unit symbol and scale has, by organization: a star of three look-ups, counted."""
    joined = facts.join(measures, "measure_id").join(units, "unit_id", "left").join(organizations, "organization_id", "left")
    return joined.groupBy("organization", "symbol", "scale").agg(F.count("*").alias("n"), F.count_distinct("measure_id").alias("measures"))


def unanswered(questions: Column, answers: Column) -> Column:
    """Ids of questions without an answer, in order: answers is a map by id, in which null and blank texts are none."""
    given = F.map_keys(F.map_filter(answers, lambda _, v: v.isNotNull() & (F.trim(v) != "")))
    return F.array_sort(F.array_except(questions, F.coalesce(given, F.array().cast("array<string>"))))


def unknown_keys(known: Column, answers: Column) -> Column:
    """Keys of answers that no question has, in order."""
    return F.array_sort(F.array_except(F.map_keys(answers), known))


def merged_metrics(left: Column, right: Column) -> Column:
    """Two maps of texts as one: names in both are added where both are numbers, else the right one's value counts."""

    def one(_: Column, a: Column, b: Column) -> Column:
        x, y = (v.try_cast("decimal(38,6)") for v in (a, b))
        both = F.regexp_replace(F.regexp_replace((x + y).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.when(x.isNotNull() & y.isNotNull(), both).otherwise(F.coalesce(b, a))

    return F.map_zip_with(left, right, one)
