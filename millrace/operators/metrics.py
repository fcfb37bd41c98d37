"""Metrics of many sources as one long table of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metrics with a unit of their own.
CURRENCY_METRICS = ("spend", "conversion_value", "cpc", "cpm", "cost_per_conversion", "estimated_value")
RATE_METRICS = ("ctr", "cpc", "cpm", "roas", "cost_per_conversion")


def unified(wide: DataFrame, keys: list[str], metrics: dict[str, str], kind: str = "double") -> DataFrame:
    """(keys, source_metric_name, metric_name, value) of columns: one scan, nulls dropped."""
    rows = F.array(*(F.struct(F.lit(source).alias("source_metric_name"), F.lit(name).alias("metric_name"), F.col(source).cast(kind).alias("value")) for source, name in metrics.items()))
    return wide.select(*keys, F.inline(rows)).where("value is not null")


def metric_name(platform: Column, source_metric: Column) -> Column:
    impressions = (source_metric == "impressions") & platform.isin("twitter", "linkedin", "facebook")
    views = (source_metric == "views") & platform.isin("tiktok", "instagram")
    return F.when(impressions | views, "content_views").when(source_metric == "reach", "content_reach").otherwise(source_metric)


def metric_unit(metric: Column) -> Column:
    return (
        F.when(metric.isin(*CURRENCY_METRICS), "currency")
        .when(metric.contains("rate") | metric.isin(*RATE_METRICS), "ratio")
        .when(metric == "video_duration_seconds", "seconds")
        .when(metric.contains("watch_time"), "milliseconds")
        .otherwise("count")
    )


def entity_id(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *(p.cast("string") for p in parts))


def observation_id(record_type: Column, record_id: Column, entity: Column, source_metric: Column, metric: Column) -> Column:
    return F.sha2(F.concat_ws(":", record_type, record_id.cast("string"), entity, source_metric, metric), 256)


def content_views(observations: DataFrame, since: Column, metric: str = "content_views", grain: str = "account_day") -> DataFrame:
    """Reported, current, not cumulative, not paid values of one grain, by platform and account."""
    kept = observations.where(F.col("active") & F.col("current_value") & F.col("reporting_source") & ~F.coalesce(F.col("paid"), F.lit(False)) & ~F.col("cumulative"))
    kept = kept.where((F.col("metric_name") == metric) & (F.col("grain") == grain) & (F.col("period_start") >= since))
    return kept.groupBy("platform", "account_key").agg(F.sum("value").alias(metric))


def series(facts: DataFrame, group: str, start: str = "period_start", value: str = "value_numeric") -> DataFrame:
    """Points of each group in order, as an array."""
    return facts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(start, value))).alias("points"))


def filled(wide: DataFrame, metrics: list[str], but: tuple[str, ...] = ()) -> DataFrame:
    """Missing counts are zero; durations and rates stay missing."""
    return wide.withColumns({m: F.coalesce(F.col(m), F.lit(0)) for m in metrics if m not in but})


def snapshots(rows: DataFrame, parents: DataFrame, key: str, names: DataFrame, source: str, grain: str, reporting: Column, cumulative: bool) -> DataFrame:
    """Observations of a source that names its metrics in rows: (record id, ``key``, insight, value, observed_at).

    ``parents``: ``key``, platform, account_key, entity_id, published_at. ``names``: insight, metric_name; an insight that
    isn't there is dropped. A daily value belongs to the day before ``observed_at``, a cumulative one to all since
    publication; of cumulative values the newest of an entity, source and metric is current.
    """
    from .latest import current_flags

    joined = rows.where("value is not null").join(names, "insight").join(parents, key)
    start = F.coalesce("published_at", "observed_at") if cumulative else F.col("observed_at") - F.make_interval(days=F.lit(1))
    out = joined.select(
        observation_id(F.lit(source), F.col("record_id"), F.col("entity_id"), F.col("insight"), F.col("metric_name")).alias("id"),
        "entity_id", "platform", "account_key", F.lit(source).alias("source"), F.lit(grain).alias("grain"), "metric_name",
        F.col("insight").alias("source_metric_name"), "value", metric_unit(F.col("insight")).alias("unit"), start.alias("period_start"),
        F.col("observed_at").alias("period_end"), "observed_at", F.lit(cumulative).alias("cumulative"), reporting.alias("reporting_source"),
    )
    if not cumulative:
        return out.withColumn("current_value", F.lit(True))
    return current_flags(out, ["entity_id", "source", "metric_name"], [F.desc("observed_at"), F.desc("id")])


def counted_transitions(events: DataFrame, key: str, state: str = "state", counted: str = "approved") -> DataFrame:
    """How many of each key's children are in a state now: recomputed, so that no counter can drift."""
    return events.groupBy(key).agg(F.count_if(F.col(state) == counted).alias("n"))
