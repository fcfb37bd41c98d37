"""Names resolved to entities: exact, then looser, then by similarity with an injected judge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_quotes, trigram_similarity, trigrams
from ..session import stashed
from ..sources.manifest import ManifestTable
from .merge import insert_ignore


def resolve_names(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """entity_id, confidence and method: exact alias 1.0, same letters in any case 0.99, plain quotes 0.95, else null.

    ``aliases``: alias_name, entity_id. Ties go to the smaller id. Aliases are made unique for each spelling
    first, so no join multiplies rows.
    """
    spelled = lambda c: aliases.groupBy(c.alias("_key")).agg(F.min("entity_id").alias("_id"))
    out = names
    plain = F.lower(plain_quotes(F.col("alias_name")))
    steps = [
        (F.col(name), spelled(F.col("alias_name")), "exact", 1.0),
        (F.lower(F.col(name)), spelled(F.lower("alias_name")), "case", 0.99),
        (F.lower(plain_quotes(F.col(name))), spelled(plain), "encoding", 0.95),
    ]
    for i, (key, table, _, _) in enumerate(steps):
        out = out.join(table.withColumnsRenamed({"_key": f"_key{i}", "_id": f"_id{i}"}), key == F.col(f"_key{i}"), "left")
    pick = lambda values: F.coalesce(*(F.when(F.col(f"_id{i}").isNotNull(), F.lit(v)) for i, v in enumerate(values)))
    return out.select(
        *names.columns, F.coalesce(*(F.col(f"_id{i}") for i in range(3))).alias("entity_id"),
        pick([c for *_, c in steps]).alias("confidence"), pick([m for *_, m, _ in steps]).alias("method"),
    )


_LEVELS = ((85, 2), (70, 2), (50, 1))  # hundredths of the index, and how many rare trigrams pairs of that index surely share


def packed_trigrams(c: Column) -> Column:
    """The distinct trigrams of a lower-cased text in order, each as one number: its three characters at 21 bits."""
    at = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("bigint")
    return F.array_sort(F.transform(trigrams(F.lower(c)), lambda g: at(g, 1) * (1 << 42) + at(g, 2) * (1 << 21) + at(g, 3)))


def _rare_keys(grams: Column, n: Column, least: int, share: int) -> Column:
    """Keys of which two sets have one in common if their Jaccard index is ``least`` hundredths or more.

    Such sets share at least that part of the larger, so of all but the last of each, rarest first, they share ``share``. A set of fewer is equal to the other
    and its own key.
    """
    rarest = F.least(n, n - F.ceil(n * least / 100) + share).cast("int")
    if share == 1:
        return F.transform(F.slice(grams, F.lit(1), rarest), lambda g: F.array(g))
    first = F.sequence(F.lit(1), F.greatest(rarest - 1, F.lit(1)))
    pairs = F.flatten(F.transform(first, lambda i: F.transform(F.slice(grams, i + 1, F.greatest(rarest - i, F.lit(0))), lambda g: F.array(F.get(grams, i - 1), g))))
    return F.when(n < 2, F.array(grams)).otherwise(pairs)


def similar(names: DataFrame, entities: DataFrame, name: str = "name", other: str = "canonical_name", other_id: str = "entity_id", top: int = 5) -> DataFrame:
    """For each name the ``top`` entities that share a trigram, by Jaccard index, ties to the smaller id.

    Texts are compared in lower case, and those with the same trigrams are one set: it is looked up once, with its first ``top`` entities. Sets are
    asked for others of an index of 0.85 or more, which share two of their rarest trigrams, so they meet by these; a set that finds ``top`` entities so is done, the
    others go on to a lower index, and what is left after 0.5 counts the trigrams it shares with all. No pair within a level is left out, so
    the result is that of all pairs. Work follows the number of names where most have close neighbours; names without any meet all entities that share a trigram.
    """
    asked = names.select(F.col(name).alias("_name")).where("_name is not null").distinct().withColumn("_set", packed_trigrams(F.col("_name"))).where("size(_set) > 0")
    known = entities.select(F.col(other_id).alias("_id"), F.col(other).alias("_other")).withColumn("_set", packed_trigrams(F.col("_other"))).where("size(_set) > 0")
    order = F.row_number().over(Window.partitionBy("_set").orderBy("_id", "_other"))
    members = known.withColumn("_r", order).where(F.col("_r") <= top).drop("_r")
    held = members.groupBy("_set").agg(F.count("*").alias("_held"), F.min("_id").alias("_first"))
    sets = asked.select("_set").distinct().withColumn("_asked", F.lit(True)).join(held, "_set", "full").withColumn("_sid", F.monotonically_increasing_id())
    sets = stashed(sets, "sets")
    each = sets.select("_sid", F.explode("_set").alias("_gram"))
    often = each.groupBy("_gram").agg(F.count("*").alias("_often"))
    rare = each.join(often, "_gram").groupBy("_sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_often", "_gram"))), lambda g: g["_gram"]).alias("_grams"))
    ready = stashed(sets.drop("_set").join(rare, "_sid").withColumn("_n", F.size("_grams")), "rare-sets")
    here = ready.where("_held is not null").select(F.col("_sid").alias("_to"), F.col("_grams").alias("_theirs"), F.col("_n").alias("_m"), "_held", "_first")
    open_, found = ready.where("_asked").select("_sid", "_grams", "_n"), []
    close = F.row_number().over(Window.partitionBy("_sid").orderBy(F.desc("_score"), "_first"))
    for least, share in (*_LEVELS, (0, 0)):
        if least:
            left = open_.withColumn("_key", F.explode(_rare_keys(F.col("_grams"), F.col("_n"), least, share)))
            right = here.withColumn("_key", F.explode(_rare_keys(F.col("_theirs"), F.col("_m"), least, share)))
            may = left.join(right, "_key").where((F.col("_n") * 100 >= F.col("_m") * least) & (F.col("_m") * 100 >= F.col("_n") * least))
            met = may.withColumn("_both", F.size(F.array_intersect("_grams", "_theirs"))).where(F.col("_both") * 100 >= (F.col("_n") + F.col("_m") - F.col("_both")) * least)
            met = met.select("_sid", "_n", "_to", "_m", "_held", "_first", "_both").distinct()
        else:
            left, right = open_.select("_sid", "_n", F.explode("_grams").alias("_gram")), here.select("_to", "_m", "_held", "_first", F.explode("_theirs").alias("_gram"))
            met = left.join(right, "_gram").groupBy("_sid", "_n", "_to", "_m", "_held", "_first").agg(F.count("*").alias("_both"))
        # The first ``top`` sets have the first ``top`` entities: each has one at least, and none of a later set comes before it.
        met = met.withColumn("_score", F.col("_both") / (F.col("_n") + F.col("_m") - F.col("_both"))).withColumn("_r", close).where(F.col("_r") <= top)
        met = met.select("_sid", "_to", "_score", "_held")
        if least:
            met = stashed(met, "similar-sets")
            done = met.groupBy("_sid").agg(F.sum("_held").alias("_n")).where(F.col("_n") >= top).select("_sid")
            found.append(met.join(done, "_sid", "left_semi"))
            open_ = stashed(open_.join(done, "_sid", "left_anti"), "open-sets")
            if open_.isEmpty():
                break
        else:
            found.append(met)
    pairs = reduce(DataFrame.unionByName, found)
    belongs = sets.select(F.col("_sid").alias("_to"), "_set").join(members, "_set").select("_to", "_id", "_other")
    rank = F.row_number().over(Window.partitionBy("_sid").orderBy(F.desc("_score"), "_id", "_other"))
    best = pairs.join(belongs, "_to").withColumn("rank", rank).where(F.col("rank") <= top)
    out = asked.join(sets.select("_set", "_sid"), "_set").join(best, "_sid")
    return out.select(F.col("_name").alias(name), "rank", F.col("_id").alias(other_id), F.col("_other").alias(other), F.col("_score").alias("score"))


def judged(candidates: DataFrame, name: str = "name", judge: Column | None = None) -> DataFrame:
    """A decision for each name from its candidates; ``judge`` gives a candidate's confidence (default: its score).

    Below 0.1: a new entity to review; from 0.8 the name becomes an alias; between, linked without one.
    """
    confidence = F.col("score") if judge is None else judge
    best = candidates.withColumn("confidence", confidence).groupBy(name).agg(F.max_by(F.struct("entity_id", "canonical_name", "confidence"), F.struct("confidence", -F.col("rank"))).alias("best"))
    out = best.select(name, "best.*")
    low = F.coalesce(F.col("confidence") < 0.1, F.lit(True))
    return out.select(
        name, F.when(~low, F.col("entity_id")).alias("entity_id"), F.when(low, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(low, "auto_created_for_review").otherwise("fuzzy").alias("transformation_type"), (~low & (F.col("confidence") >= 0.8)).alias("keep_alias"),
    )


def lineage(decisions: DataFrame, name: str, now: Column) -> DataFrame:
    """A provenance row for each decision."""
    return decisions.select(
        F.lit("organization_name").alias("source_field"), F.col(name).alias("source_value"), F.lit("organization_id").alias("target_field"),
        F.col("entity_id").cast("string").alias("target_value"), "transformation_type", "confidence", now.alias("created_at"),
    )


def name_id(normal: Column, salt: Column | int = 0, bits: int = 60) -> Column:
    """A number that the name alone gives: the first ``bits`` (60 at most) of its digest."""
    salt = F.lit(salt) if isinstance(salt, int) else salt
    head = F.conv(F.substring(F.sha2(F.concat_ws(chr(31), normal, salt.cast("string")), 256), 1, 15), 16, 10).cast("bigint")
    return F.shiftright(head, 60 - bits)


def normal_name(name: Column) -> Column:
    """What spellings of one name share: plain quotes, lower case, single blanks."""
    return F.lower(F.trim(F.regexp_replace(plain_quotes(name), r"\s+", " ")))


def created(names: DataFrame, entities: DataFrame, name: str = "name", bits: int = 60, rounds: int = 20) -> DataFrame:
    """(entity_id, canonical_name, normal_name) of the names that ``entities`` (the same columns) doesn't have yet.

    Ids come from the names, so a batch that is tried again, or another that shares a name, gives the same ones. An id that
    another name has, there or among the new ones, is given to the lesser name; the other takes the next salt.
    Of several spellings the least is the canonical one; blank and null names give none.
    """
    normal = normal_name(F.col(name))
    wanted = names.select(normal.alias("normal_name"), F.col(name).alias("_spelled")).where("normal_name <> ''").groupBy("normal_name").agg(F.min("_spelled").alias("canonical_name"))
    left = stashed(wanted.join(entities.select("normal_name"), "normal_name", "left_anti").withColumn("_salt", F.lit(0)), "new-names")
    taken, done = entities.select("entity_id"), None
    for _ in range(rounds):
        tried = left.withColumn("entity_id", name_id(F.col("normal_name"), F.col("_salt"), bits))
        first = tried.groupBy("entity_id").agg(F.min("normal_name").alias("_first"))
        won = tried.join(first.withColumnRenamed("entity_id", "_id"), (F.col("entity_id") == F.col("_id")) & (F.col("normal_name") == F.col("_first")), "left_semi")
        won = stashed(won.join(taken, "entity_id", "left_anti").select("entity_id", "canonical_name", "normal_name"), "new-entities")
        done = won if done is None else done.union(won)
        left = stashed(left.join(won.select("normal_name"), "normal_name", "left_anti").withColumn("_salt", F.col("_salt") + 1), "new-names")
        if left.isEmpty():
            return done
        taken = taken.union(won.select("entity_id"))
    raise RuntimeError(f"names without an id after {rounds} salts")


def create_absent(table: ManifestTable, aliases: ManifestTable, names: DataFrame, batch: str, name: str = "name", bits: int = 60) -> None:
    """Create the entities that ``names`` needs, then an alias for each spelling, each in one step that happens once a batch.

    ``table``: entity_id, canonical_name, normal_name; ``aliases``: alias_name, entity_id. A writer that dies between the two steps is finished by trying its batch again.
    """
    known = names.where(normal_name(F.col(name)) != "").select(F.col(name).alias("alias_name"), normal_name(F.col(name)).alias("normal_name")).distinct()

    table.append(lambda old: created(names, old, name, bits), batch)
    spelled = known.join(table.read(), "normal_name").select("alias_name", "entity_id")
    aliases.append(lambda old: insert_ignore(old, spelled, ["alias_name"], null_safe=False), batch)


__all__ = ["create_absent", "created", "name_id", "normal_name", "judged", "lineage", "resolve_names", "similar", "trigram_similarity"]
