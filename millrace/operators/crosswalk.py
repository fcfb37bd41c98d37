"""Population-weighted crosswalks between geographies, and values carried over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stashed

ADDITIVE = ("additive", "semi_additive")


TASK_PAIRS = 1_000_000  # pairs that a task holds on average
MARKS = 1 << 16  # marks under which pairs are first counted, to find the parents with many
HELD = 500_000  # totals that are broadcast, some 100 bytes each


def areas(sources: DataFrame, targets: DataFrame, populations: DataFrame) -> DataFrame:
    """A row for each area (``child_id``) that has parents on both sides and a population, which is ``people``.

    ``sources`` and ``targets`` are its different parents, ``source_times`` and ``target_times`` how often each is listed (null: all once).
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        each = df.select("child_id", "parent_id").where("child_id is not null").repartition("child_id").groupBy("child_id", "parent_id").agg(F.count("*").alias("_n"))
        lists = each.groupBy("child_id").agg(F.collect_list(F.struct("parent_id", "_n")).alias("_all"))
        return lists.select("child_id", F.col("_all.parent_id").alias(f"{name}s"), F.when(F.exists("_all", lambda x: x["_n"] > 1), F.col("_all._n")).alias(f"{name}_times"))

    people = populations.where("child_id is not null").groupBy("child_id").agg(F.sum(F.coalesce("population", F.lit(0))).alias("people"))
    return side(sources, "source").join(people, "child_id").join(side(targets, "target"), "child_id").drop("child_id")


def overlaps(sources: DataFrame, targets: DataFrame, populations: DataFrame) -> DataFrame:
    """Population and number of areas that each pair of parents shares; pairs without population go.

    ``sources`` and ``targets`` have child_id and parent_id, ``populations`` child_id and population. An area that is listed twice
    counts once, with its population each time.
    """
    return area_overlaps(areas(sources, targets, populations))


def area_overlaps(listed: DataFrame) -> DataFrame:
    """``overlaps`` of ``areas``.

    Pairs are many more than the rows they come from, so they are counted first and dealt to a partition for each ``TASK_PAIRS``. An
    area's parents travel as one list to each of the parents on the other side, and become pairs there, which don't move any more.
    """
    known = stashed(listed, "areas")
    pairs, _, _ = _pairs(known, _met(known), "target")
    return pairs.drop("_deal")


def area_weights(listed: DataFrame, digits: int = 8) -> DataFrame:
    """``weights`` of the pairs of ``areas``, which are dealt by the side with more parents and stay there.

    Totals come from the areas: a pair that goes for want of population adds nothing. Where a population is below zero that isn't so, and
    totals come from the pairs. The other side's totals are broadcast up to ``HELD``; with more, pairs move once more.
    """
    known = stashed(listed, "areas")
    met = _met(known)
    if (known.agg(F.min("people")).first()[0] or 0) < 0:
        return weights(_pairs(known, met, "target")[0].drop("_deal"), digits)
    kinds = {k: known.select(F.explode(f"{k}s").alias("k")).agg(F.approx_count_distinct("k")).first()[0] for k in ("source", "target")}
    few, many = sorted(kinds, key=lambda k: kinds[k])
    pairs, by, large = _pairs(known, met, many)
    out = _shares(pairs, many, few, by, large, digits).drop("_deal")
    wholes = _each(known, few).groupBy("_parent").agg(F.sum("_part").alias("_whole"), F.ceil(F.sum("_pairs") / TASK_PAIRS).cast("int").alias("_deals"))
    wholes = stashed(wholes, "totals")
    if wholes.count() <= HELD:
        out = _with_share(out.join(F.broadcast(wholes.drop("_deals")), F.col(f"{few}_id").eqNullSafe(F.col("_parent")), "left"), few, many, F.col("_whole"), digits).drop("_whole", "_parent")
    else:
        out = _dealt_shares(out, few, many, wholes.where("_deals > 1"), _parts(known, met), digits)
    return out.select(*COLUMNS)


COLUMNS = ("source_id", "target_id", "overlap_population", "da_count", "weight_source_to_target", "weight_target_to_source")


def _parts(df: DataFrame, pairs: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))


def _met(known: DataFrame) -> int:
    """Pairs of parents that meet in an area, counted in each."""
    return known.agg(F.sum(F.size("sources").cast("long") * F.size("targets"))).first()[0] or 0


def _each(known: DataFrame, side: str) -> DataFrame:
    """_parent, _pairs, _part: each area's parents on one side, with the pairs that it gives them and the population of these."""
    other = "target" if side == "source" else "source"
    both = F.when(F.col(f"{other}_times").isNull(), F.size(f"{other}s")).otherwise(F.aggregate(f"{other}_times", F.lit(0).cast("long"), lambda x, y: x + y))
    each = known.select(F.posexplode(f"{side}s").alias("_i", "_parent"), f"{side}_times", F.size(f"{other}s").alias("_pairs"), (F.col("people") * both).alias("_part"))
    return each.select("_parent", "_pairs", (F.col("_part") * _times(f"{side}_times")).alias("_part"))


def _times(column: str):
    return F.coalesce(F.get(F.col(column), F.col("_i")), F.lit(1))


def _large(known: DataFrame, side: str) -> DataFrame:
    """_parent, _whole, _deals of the parents with more than ``TASK_PAIRS`` pairs. All parents are first counted under few marks."""
    each, mark = _each(known, side), F.pmod(F.xxhash64("_parent"), F.lit(MARKS))
    full = each.groupBy(mark.alias("_mark")).agg(F.sum("_pairs").alias("_n")).where(F.col("_n") > TASK_PAIRS).select("_mark")  # one for each TASK_PAIRS at most
    found = each.join(F.broadcast(full), mark == F.col("_mark"), "left_semi").groupBy("_parent")
    found = found.agg(F.sum("_part").alias("_whole"), F.ceil(F.sum("_pairs") / TASK_PAIRS).cast("int").alias("_deals"))
    return stashed(found.where("_deals > 1"), "large")


def _pairs(known: DataFrame, met: int, side: str) -> tuple[DataFrame, list[str], DataFrame | None]:
    """(pairs, the columns that they are dealt by, ``_large`` of them): all pairs of a parent on ``side`` are in one partition, those of a large
    one in several, by their other parent (``_deal``)."""
    other = "target" if side == "source" else "source"
    rows = known.select(F.posexplode(f"{side}s").alias("_i", f"{side}_id"), f"{side}_times", F.col(f"{other}s").alias("_others"), F.col(f"{other}_times").alias("_often"), "people")
    rows = rows.select(f"{side}_id", (F.col("people") * _times(f"{side}_times")).alias("_people"), "_others", "_often")
    large = _large(known, side) if met > TASK_PAIRS else None
    if large is not None and large.isEmpty():
        large = None
    by = [f"{side}_id"]
    if large is not None:
        by.append("_deal")
        whole = F.array(F.struct(F.lit(0).alias("_deal"), "_others", "_often"))
        often = lambda i: F.when(F.col("_often").isNotNull(), F.array(F.get("_often", i))).alias("_often")
        singly = F.transform("_others", lambda x, i: F.struct(F.pmod(F.xxhash64(x), "_deals").cast("int").alias("_deal"), F.array(x).alias("_others"), often(i)))
        rows = rows.join(F.broadcast(large), F.col(f"{side}_id").eqNullSafe(F.col("_parent")), "left")
        rows = rows.select(f"{side}_id", "_people", F.inline(F.when(F.col("_deals").isNull(), whole).otherwise(singly)))
    pairs = rows.repartition(_parts(known, met), *by).select(*by, "_people", "_often", F.posexplode("_others").alias("_i", f"{other}_id"))
    pairs = pairs.select(*by, f"{other}_id", (F.col("_people") * _times("_often")).alias("_people"))
    out = pairs.groupBy("source_id", "target_id", *by[1:]).agg(F.sum("_people").alias("overlap_population"), F.count("*").alias("da_count"))
    return out.where("overlap_population > 0"), by, large


def _with_share(pairs: DataFrame, side: str, other: str, whole, digits: int) -> DataFrame:
    share = F.when(whole > 0, F.round(F.col("overlap_population").cast("double") / whole, digits)).otherwise(0.0)
    return pairs.withColumn(f"weight_{side}_to_{other}", share)


def _shares(pairs: DataFrame, side: str, other: str, by: list[str], large: DataFrame | None, digits: int) -> DataFrame:
    """Shares of a parent's total, which is in its partition, or in ``large``."""
    whole = F.sum("overlap_population").over(Window.partitionBy(*by))
    if large is None:
        return _with_share(pairs, side, other, whole, digits)
    pairs = pairs.join(F.broadcast(large.drop("_deals")), F.col(f"{side}_id").eqNullSafe(F.col("_parent")), "left")
    return _with_share(pairs, side, other, F.coalesce("_whole", whole), digits).drop("_parent", "_whole")


def _dealt_shares(pairs: DataFrame, side: str, other: str, large: DataFrame, parts: int, digits: int) -> DataFrame:
    """``_shares`` of pairs that aren't dealt by ``side`` yet."""
    deals = F.broadcast(large.select(F.col("_parent").alias("_of"), "_deals"))
    dealt = pairs.join(deals, F.col(f"{side}_id").eqNullSafe(F.col("_of")), "left")
    dealt = dealt.withColumn("_deal", F.pmod(F.xxhash64(f"{other}_id"), F.coalesce("_deals", F.lit(1))).cast("int")).drop("_of", "_deals")
    by = [f"{side}_id", "_deal"]
    return _shares(dealt.repartition(parts, *by), side, other, by, large, digits).drop("_deal")


def weights(pairs: DataFrame, digits: int = 8) -> DataFrame:
    """Each pair's share of its source's and of its target's total, over the pairs that there are; ``area_weights`` moves less where the areas are known.

    Pairs are written once and read three times. They are dealt by each side in turn, to a partition for each ``TASK_PAIRS``, where they are
    summed; those of a parent with more, of which there can be no more than partitions, are dealt to several by their other parent, so a
    parent with a third of all pairs is no hot group.
    """
    known = stashed(pairs, "pairs")
    out, parts = known, _parts(known, known.count())
    for side, other in (("source", "target"), ("target", "source")):
        whole = known.groupBy(F.col(f"{side}_id").alias("_parent")).agg(F.sum("overlap_population").alias("_whole"), F.ceil(F.count("*") / TASK_PAIRS).cast("int").alias("_deals"))
        out = _dealt_shares(out, side, other, stashed(whole.where("_deals > 1"), "large"), parts, digits)
    return out


def weight_checks(entries: DataFrame) -> DataFrame:
    return entries.groupBy("crosswalk_set_id", "from_geo_id").agg(F.sum("weight").alias("total_weight"), F.count("*").alias("target_count"))


def lookup(crosswalk: DataFrame, source_id, least: float = 0.01) -> DataFrame:
    found = crosswalk.where((F.col("source_id") == source_id) & (F.col("weight_source_to_target") >= least))
    return found.orderBy(F.desc("weight_source_to_target"), "target_id")


def allocate(observations: DataFrame, entries: DataFrame, compatibility: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(values carried over, refused observations with a reason).

    ``observations``: measure_id, aggregation_type, geo_id, value. An explicit rule for a measure wins: not_allowed
    refuses, recommended, acceptable and risky permit; without one only additive measures go over.
    """
    rules = observations.withColumn("_rule", F.lit(None).cast("string")) if compatibility is None else observations.join(
        compatibility.select("measure_id", F.col("compatibility").alias("_rule")), "measure_id", "left"
    )
    may = F.when(F.col("_rule") == "not_allowed", False).when(F.col("_rule").isin("recommended", "acceptable", "risky"), True).otherwise(F.coalesce(F.col("aggregation_type").isin(*ADDITIVE), F.lit(False)))
    judged = rules.withColumn("_may", may)
    reason = F.when(F.col("_rule") == "not_allowed", "not_allowed").otherwise("aggregation_type")
    refused = judged.where(~F.col("_may")).withColumn("reason", reason).drop("_may", "_rule")
    to = entries.select(F.col("from_geo_id").alias("geo_id"), "to_geo_id", "weight", "confidence")
    carried = judged.where("_may").drop("_may", "_rule").join(to, "geo_id")
    carried = carried.withColumn("value", F.col("value").cast("double") * F.col("weight").cast("double")).withColumn("derivation_method", F.lit("crosswalk_allocation"))
    return carried, refused
