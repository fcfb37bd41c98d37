"""Which of several versions of a record counts.

Spark pushes filters on the partition keys below the window, and ``row_number() = 1`` becomes a group limit
before the shuffle, so a key with many versions sends few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACT_KEYS = ["measure_id", "measurement_year", "value_type", "period_basis", "period_start", "observed_organization_id", "geo_boundary_id", "jurisdiction_id"]


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should end in a unique column; null keys are a key."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", first).where("_place = 1").drop("_place")


def measure_facts(observations: DataFrame) -> DataFrame:
    """The latest vintage of each fact. Components and totals share a slot here: read those from ``observations``."""
    order = [F.desc_nulls_last("vintage_date"), F.desc_nulls_first("approved_at"), F.desc_nulls_first("id")]
    return latest_by(observations, FACT_KEYS, order)


def canonical_versions(awards: DataFrame, order: list[Column], key: str = "canonical_key", id_col: str = "id", state: str = "state") -> DataFrame:
    """``is_canonical`` of every published row anew, and ``changed`` where it differs from what it was."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order, F.desc(id_col))) == 1
    ranked = awards.where(F.col(state) == "published").withColumn("_now", first)
    return ranked.withColumn("changed", ~F.col("is_canonical").eqNullSafe(F.col("_now"))).withColumn("is_canonical", F.col("_now")).drop("_now")


def contract_order(metadata: str = "metadata") -> list[Column]:
    """Reporting periods and reference numbers are compared as text."""
    at = lambda k: F.coalesce(F.get_json_object(metadata, f"$.{k}"), F.lit(""))
    return [at("reporting_period").desc(), at("reference_number").desc()]


def grant_order(metadata: str = "metadata") -> list[Column]:
    """Amendments are compared as numbers; what is none comes last."""
    at = lambda k: F.coalesce(F.get_json_object(metadata, f"$.{k}"), F.lit(""))
    number = F.when(at("amendment_number").rlike(r"^\d+$"), at("amendment_number").try_cast("int")).otherwise(-1)
    return [F.coalesce(number, F.lit(-1)).desc(), at("amendment_date").desc(), at("reference_number").desc()]


def current_flags(df: DataFrame, keys: list[str], order: list[Column], flag: str = "current_value") -> DataFrame:
    """All rows, with a flag on the newest of each key."""
    return df.withColumn(flag, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def highest_priority(df: DataFrame, keys: list[str], priority: Column, ordinal: Column) -> DataFrame:
    """Among rows of a key the highest priority wins, then the one that came last."""
    return latest_by(df, keys, [priority.desc(), ordinal.desc()])


def first_wins(df: DataFrame, keys: list[str], ordinal: Column) -> DataFrame:
    return latest_by(df, keys, [ordinal.asc()])
