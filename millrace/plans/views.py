"""The standing views over facts, as functions of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import review_queue, variance
from ..operators.crosswalk import weight_checks
from ..operators.joins import star
from ..operators.latest import measure_facts


def spending_deviations(authorities: DataFrame, expenditures: DataFrame) -> DataFrame:
    """Estimates against spending by organisation, fiscal year and vote; a null vote number never matches."""
    return variance(authorities, expenditures, ["organization_id", "fiscal_year", "vote_number"], ["vote_type"])


def dashboard_observations(observations: DataFrame, measures: DataFrame, units: DataFrame, organizations: DataFrame, jurisdictions: DataFrame, boundaries: DataFrame, documents: DataFrame) -> DataFrame:
    """Observations with the names of all their dimensions; only the measure has to exist."""
    named = lambda df, columns: df.select("id", *(F.col(old).alias(new) for old, new in columns.items()))
    return star(observations, [
        (named(measures, {"slug": "measure_slug", "canonical_name": "measure_name", "category": "measure_category", "aggregation_type": "aggregation_type"}), "measure_id", "id", "inner"),
        (named(units, {"symbol": "unit_symbol"}), "unit_id", "id", "left"),
        (named(organizations, {"slug": "observed_organization_slug", "canonical_name": "observed_organization_name"}), "observed_organization_id", "id", "left"),
        (named(jurisdictions, {"slug": "jurisdiction_slug", "name": "jurisdiction_name"}), "jurisdiction_id", "id", "left"),
        (named(boundaries, {"geo_uid": "geo_uid", "boundary_type": "boundary_type", "code_system": "geo_code_system"}), "geo_boundary_id", "id", "left"),
        (named(documents, {"doc_url": "doc_url", "doc_title": "doc_title", "fiscal_year": "document_fiscal_year", "published_at": "document_published_at"}), "document_id", "id", "left"),
    ])


def g7_rows(rows: DataFrame, members: list, g7_id) -> DataFrame:
    """A mean row for each measure, year and period that all members report."""
    from ..operators.aggregates import complete_groups

    kept = rows.where(F.col("jurisdiction_id").isin(members))
    out = complete_groups(kept, ["measure_id", "measurement_year", "period_start"], "jurisdiction_id", len(members), "value_numeric")
    return out.withColumn("jurisdiction_id", F.lit(g7_id)).withColumn("status", F.lit("estimated"))


def series_points(facts: DataFrame, conditions: list[Column], jurisdiction: str = "jurisdiction_id") -> DataFrame:
    """Points by jurisdiction; filters on keys of the facts go below their window into the scan."""
    found = measure_facts(facts)
    for c in conditions:
        found = found.where(c)
    return found.groupBy(jurisdiction).agg(F.array_sort(F.collect_list(F.struct("period_start", "value_numeric"))).alias("points"))


__all__ = ["dashboard_observations", "g7_rows", "measure_facts", "review_queue", "series_points", "spending_deviations", "weight_checks"]
