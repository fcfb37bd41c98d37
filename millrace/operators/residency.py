"""Does a postal code lie in a city? A cascade of rules, each with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import postal_code, present

# The reasons of a residency decision.
REASONS = (
    "no_rule", "no_postal_code", "malformed_postal_code", "fsa_match", "inside_boundary", "city_match", "outside_boundary", "city_mismatch",
    "unknown_postal_code", "postal_data_unavailable",
)


def matches_prefix(code: Column, pattern: Column, exceptions: Column) -> Column:
    """A rule without a pattern agrees with any code."""
    fits = code.rlike(pattern) if isinstance(pattern, str) else F.expr("true") & F.regexp_like(code, pattern)
    excluded = F.coalesce(F.array_contains(exceptions, F.left(code, F.lit(3))), F.lit(False))
    return F.when(pattern.isNull(), True).otherwise(fits & ~excluded)


def eligible(requests: DataFrame, rules: DataFrame, postal: DataFrame, inside: DataFrame) -> DataFrame:
    """``requests(city, postal_code)`` with eligible and reason.

    ``rules``: city, province, prefix, exceptions, prefix_decides, cities, has_boundary, for each city that has rules.
    ``postal``: postal_code, city_name, province_code. ``inside``: (city, postal_code) of codes whose point lies in a
    city's boundary, edges included, as ``geometry.locate`` finds them. Where the prefix decides nothing else is asked.
    """
    rows = requests.withColumn("_raw", present(F.col("postal_code"))).withColumn("_code", postal_code(F.col("postal_code")))
    rules = rules.withColumn("_rule", F.lit(True))
    known = postal.select(F.col("postal_code").alias("_code"), "city_name", "province_code")
    loaded = postal.select(F.upper("province_code").alias("_province")).distinct()
    hits = inside.select("city", F.col("postal_code").alias("_code"), F.lit(True).alias("_inside")).distinct()
    joined = rows.join(rules, "city", "left").join(known, "_code", "left").join(hits, ["city", "_code"], "left").join(loaded, F.upper("province") == F.col("_province"), "left")
    prefix = matches_prefix(F.col("_code"), F.col("prefix"), F.col("exceptions"))
    has_prefix = F.col("prefix").isNotNull()
    named = F.array_contains(F.transform("cities", lambda c: F.upper(c)), F.upper("city_name")) & (F.col("province").isNull() | (F.upper("province_code") == F.upper("province"))) & prefix
    reason = (
        F.when(F.col("_rule").isNull(), "no_rule")
        .when(F.col("_raw").isNull(), "no_postal_code")
        .when(F.col("_code").isNull(), "malformed_postal_code")
        .when(F.col("prefix_decides") & has_prefix & prefix, "fsa_match")
        .when(F.col("city_name").isNull() & has_prefix & prefix, "fsa_match")
        .when(F.col("city_name").isNull() & F.col("_province").isNull(), "postal_data_unavailable")
        .when(F.col("city_name").isNull(), "unknown_postal_code")
        .when(F.col("_inside") & F.col("has_boundary"), "inside_boundary")
        .when(F.coalesce(named, F.lit(False)), "city_match")
        .when(F.col("has_boundary"), "outside_boundary")
        .otherwise("city_mismatch")
    )
    yes = ("no_rule", "no_postal_code", "fsa_match", "postal_data_unavailable", "inside_boundary", "city_match")
    out = joined.withColumn("reason", reason)
    return out.select(*requests.columns, F.col("reason").isin(*yes).alias("eligible"), "reason")


def ward_lookup(requests: DataFrame, postal: DataFrame, located: DataFrame, any_boundaries: bool) -> DataFrame:
    """``requests(postal_code)`` with the boundary that holds the code's point, and why there is none.

    ``located``: (postal_code, boundary_id), one a code, from ``geometry.locate`` and ``newest_boundary``.
    """
    rows = requests.withColumn("_code", postal_code(F.col("postal_code")))
    known = postal.select(F.col("postal_code").alias("_code"), F.lit(True).alias("_known"))
    found = located.select(F.col("postal_code").alias("_code"), "boundary_id")
    joined = rows.join(known, "_code", "left").join(found, "_code", "left")
    reason = (
        F.when(F.col("_code").isNull(), "malformed_postal_code")
        .when(F.col("_known").isNull(), "unknown_postal_code")
        .when(F.col("boundary_id").isNotNull(), "found")
        .otherwise("outside_boundary" if any_boundaries else "boundary_data_unavailable")
    )
    return joined.select(*requests.columns, "boundary_id", reason.alias("reason"))
