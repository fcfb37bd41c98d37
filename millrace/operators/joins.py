"""Joins with rules: prioritised look-ups, suffixes, semi- and anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def star(facts: DataFrame, dimensions: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """``facts`` with (dimension, fact key, dimension key, how) joined in order; Spark broadcasts those it knows to be small."""
    out = facts
    for dimension, fact_key, key, how in dimensions:
        renamed = dimension.withColumnRenamed(key, f"_{key}")
        out = out.join(renamed, F.col(fact_key) == F.col(f"_{key}"), how).drop(f"_{key}")
    return out


def name_dictionary(canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name_key, id): lower-cased names; an alias beats a canonical name, a later row an earlier one."""
    both = canonical.select(F.lower("name").alias("name_key"), "id", F.lit(0).alias("_rank")).unionByName(aliases.select(F.lower("name").alias("name_key"), "id", F.lit(1).alias("_rank")))
    return both.where("name_key is not null").groupBy("name_key").agg(F.max_by("id", F.struct("_rank", "id")).alias("id"))


def look_up(rows: DataFrame, name: str, dictionary: DataFrame, as_name: str = "resolved_id") -> DataFrame:
    held = dictionary.select(F.col("name_key").alias("_key"), F.col("id").alias(as_name))
    return rows.join(held, F.lower(name) == F.col("_key"), "left").drop("_key")


def cascade(rows: DataFrame, steps: list[tuple[Column, DataFrame, str, str]], as_name: str = "resolved_id", step_name: str = "resolved_by") -> DataFrame:
    """The id of the first step that finds one; a step is (key expression, table with unique ``key``, id column, name)."""
    out, found = rows, []
    for i, (key, table, id_col, name) in enumerate(steps):
        held = table.select(F.col("key").alias(f"_key{i}"), F.col(id_col).alias(f"_id{i}"))
        out = out.join(held, key == F.col(f"_key{i}"), "left")
        found.append((F.col(f"_id{i}"), name))
    by = None
    for column, name in found:
        by = F.when(column.isNotNull(), name) if by is None else by.when(column.isNotNull(), name)
    out = out.withColumn(as_name, F.coalesce(*(c for c, _ in found))).withColumn(step_name, by)
    return out.drop(*(f"_key{i}" for i in range(len(steps))), *(f"_id{i}" for i in range(len(steps))))


def by_domain(rows: DataFrame, host: str, feeds: DataFrame, domain: str = "domain") -> DataFrame:
    """Rows joined with the longest domain that their host is or lies under: an equi-join on the suffixes of distinct hosts."""
    hosts = rows.select(F.col(host).alias("_host")).where("_host is not null").distinct()
    labels = F.split(F.lower("_host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = hosts.select("_host", F.explode(suffixes).alias("_suffix")).join(feeds, F.col("_suffix") == F.lower(domain))
    best = hits.groupBy("_host").agg(F.max_by(F.struct(*feeds.columns), F.length("_suffix")).alias("_feed"))
    return rows.join(best, F.col(host) == F.col("_host"), "left").select(*rows.columns, "_feed.*")


def either(rows: DataFrame, key: str, left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Rows whose key occurs in either table."""
    keys = left.select(F.col(column).alias("_k")).union(right.select(F.col(column).alias("_k")))
    return rows.join(keys, F.col(key) == F.col("_k"), "left_semi")


def resolve_reference(rows: DataFrame, reference: str, documents: DataFrame) -> DataFrame:
    """``type:id`` references joined with the documents they name."""
    kind = F.substring_index(reference, ":", 1)
    ident = F.expr(f"substring({reference}, instr({reference}, ':') + 1)")
    held = documents.withColumnsRenamed({"record_type": "_type", "record_id": "_id"})
    return rows.join(held, (kind == F.col("_type")) & (ident == F.col("_id").cast("string")), "left").drop("_type", "_id")


def updated_from(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` with the columns of ``new`` where it has the key."""
    held = new.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = old.join(held, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).select(*old.columns)
