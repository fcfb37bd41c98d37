"""Checks and repairs between download and load."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.merge import numbered


def plain_header(name: str) -> str:
    """Letters and digits of a header, without accents, in lower case."""
    return re.sub(r"[^a-z0-9]", "", unicodedata.normalize("NFKD", name).lower())


def renamed(df: DataFrame) -> DataFrame:
    return df.toDF(*(plain_header(c) for c in df.columns))


def stable_ids(rows: DataFrame, ident: Column, line_no: str, columns: list[str]) -> DataFrame:
    """``stable_id``: an id that occurs once as it is; a repeated one with 16 digits of its row's digest; equal rows
    numbered from -2 in file order; rows without an id by digest."""
    digest = F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    marked = rows.withColumns({"_id": ident, "_digest": F.left(digest, F.lit(16))})
    # Only repeated ids are joined with; rows without an id go by their digests, so that they spread over tasks.
    repeated = marked.where("_id is not null").groupBy(F.col("_id").alias("_known")).agg(F.count("*").alias("_n")).where("_n > 1")
    joined = marked.join(repeated, F.coalesce("_id", "_digest") == F.col("_known"), "left")
    base = F.when(F.col("_id").isNull(), F.col("_digest")).when(F.col("_n").isNull(), F.col("_id")).otherwise(F.concat_ws("-", "_id", "_digest"))
    based = joined.withColumn("_base", base)
    place = F.row_number().over(Window.partitionBy("_base").orderBy(line_no))
    named = based.withColumn("_place", place)
    return named.withColumn("stable_id", F.when(F.col("_place") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_place").cast("string")))).drop("_id", "_digest", "_known", "_n", "_base", "_place")


def require_numeric(df: DataFrame, ident: str, line_no: str) -> DataFrame:
    """Fails, naming the line, if an id is not a number."""
    wrong = F.concat(F.lit("id is not numeric on line "), F.col(line_no).cast("string"))
    return df.withColumn(ident, F.when(F.col(ident).rlike(r"^\d+$"), F.col(ident)).otherwise(F.raise_error(wrong).cast("string")))


def page_faults(pages: DataFrame) -> DataFrame:
    """(fault, n) for records (page, total, id) fetched by page: totals that change, ids that don't rise, a count
    that isn't the total. No row: all is well. Records are numbered by ranges of their place, and neighbours meet in a join."""
    placed = numbered(pages.select("page", "position", "id"), ["page", "position", "id"], name="_place")
    before = placed.select((F.col("_place") + 1).alias("_place"), F.col("id").alias("_before"))
    disorder = placed.join(before, "_place").where(F.col("id") <= F.col("_before")).agg(F.lit("disorder").alias("fault"), F.count("*").alias("n"))
    totals = pages.agg(F.lit("totals").alias("fault"), (F.countDistinct("total") - 1).alias("n"))
    count = pages.agg(F.lit("count").alias("fault"), F.abs(F.count("*") - F.max("total")).alias("n"))
    return disorder.union(totals).union(count).where("n > 0")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def sum_in_one_currency(transactions: DataFrame, key: str, kind: str) -> DataFrame:
    """Value by key of one type of transaction; fails if a key's transactions are in several currencies."""
    of = transactions.where(F.col("type") == kind).groupBy(key).agg(F.sum("value").alias("amount"), F.countDistinct("currency").alias("_n"), F.max("currency").alias("currency"))
    fine = F.when(F.col("_n") <= 1, F.col("amount")).otherwise(F.raise_error(F.concat(F.lit("several currencies: "), F.col(key).cast("string"))).cast("double"))
    return of.withColumn("amount", fine).drop("_n")


def actual_or_planned(dates: Column, actual: str, planned: str) -> Column:
    """From an array of (type, date): the actual date, else the planned one."""
    of = lambda kind: F.get(F.filter(dates, lambda d: d["type"] == kind), F.lit(0))["date"]
    return F.coalesce(of(actual), of(planned))


def latest_ingestions(ingestions: DataFrame, sources: DataFrame) -> DataFrame:
    last = ingestions.groupBy("source_id").agg(F.max_by(F.struct("id", "status", "created_at"), F.struct("created_at", "id")).alias("latest"))
    return sources.join(last, sources["id"] == last["source_id"], "left").drop("source_id")


def busiest_state(jobs: DataFrame) -> DataFrame:
    """A state for each source; running beats queued, these beat others, of which the last by name counts."""
    rank = F.when(F.col("state") == "running", 2).when(F.col("state") == "queued", 1).otherwise(0)
    return jobs.groupBy("source_id").agg(F.max_by("state", F.struct(rank, "state")).alias("state"))


def roster(df: DataFrame) -> DataFrame:
    """Candidates (office, district, name, status) of a nested election list: mayor, councillors by ward, trustees by
    board and ward; the list of the withdrawn overrides a status."""
    flat = lambda office, district, people: F.transform(people, lambda p: F.struct(F.lit(office).alias("office"), district.cast("string").alias("district"), p["name"].alias("name"), p["status"].alias("status")))
    mayor = F.coalesce(flat("mayor", F.lit(None), F.col("mayor")), F.array())
    wards = F.flatten(F.transform("wards", lambda w: flat("councillor", w["ward"], w["candidates"])))
    boards = F.flatten(F.flatten(F.transform("boards", lambda b: F.transform(b["wards"], lambda w: flat("trustee", F.concat_ws(" ", b["board"], w["ward"].cast("string")), w["candidates"])))))
    rows = df.select(F.inline(F.concat(mayor, F.coalesce(wards, F.array()), F.coalesce(boards, F.array()))), F.col("withdrawn").alias("_gone"))
    return rows.withColumn("status", F.when(F.array_contains("_gone", F.col("name")), "withdrawn").otherwise(F.coalesce("status", F.lit("active")))).drop("_gone")


def low_confidence(lineage: DataFrame, most: float = 0.8, n: int = 50) -> DataFrame:
    return lineage.where((F.col("confidence") < most) & ~F.coalesce(F.col("overridden"), F.lit(False))).orderBy("confidence", "id").limit(n)
