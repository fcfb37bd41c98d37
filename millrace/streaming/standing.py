"""Structured Streaming forms of the periodic jobs: standing queries, late data, windows, merges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import insert_ignore, numbered


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def match_key(definition_id: Column, document_id: Column, content_hash: Column, on_update: Column) -> Column:
    """What makes a match new: the document, or the document as it reads now."""
    return F.concat_ws(":", definition_id.cast("string"), document_id.cast("string"), F.when(on_update, content_hash))


def matches(documents: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(saved_search, id, content_hash, index_sequence) for each standing query and document that meet: one scan for all queries."""
    hits = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in conditions.items())))
    return documents.select(F.explode(hits).alias("saved_search"), "id", "content_hash", "index_sequence")


def new_matches(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose match was never recorded: a batch may read an overlap again without repeating any."""
    once = candidates.dropDuplicates(["saved_search", "match_key"])
    return insert_ignore(known.select("saved_search", "match_key"), once, ["saved_search", "match_key"], null_safe=False)


def run_standing(documents: DataFrame, conditions: dict[str, Column], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each batch's new matches to the table at ``path``.

    The record of matches never expires, so it is no state of the stream but a table that each batch is
    compared with; a batch that runs again finds its matches there.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        found = matches(df, conditions).withColumn("match_key", F.concat_ws(":", F.col("id").cast("string"), "content_hash"))
        try:
            known = spark.read.schema("saved_search string, match_key string").parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], "saved_search string, match_key string")
        new_matches(found, known).write.mode("append").parquet(path)

    writer = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events once, within the time that late ones may take."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, ts: str, size: str, keys: list[str], late: str, *aggregates: Column) -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *(c for c in out.columns if c != "_w"))


def sessioned(events: DataFrame, ts: str, gap: str, keys: list[str], late: str, *aggregates: Column) -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *(c for c in out.columns if c != "_w"))


def new_caption_lines(cues: DataFrame, track: str = "track_id") -> DataFrame:
    """(track, cue, start_seconds, lines): the lines of each cue that the roll-up before it didn't show.

    The state of a track is its last cue's lines. Cues of a batch are taken in order; cues have to arrive in order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before: list[str] = list(state.get[0]) if state.exists else []
        for row in pd.concat(batches).sort_values(["start_seconds", "cue"]).itertuples():
            lines = [x.replace("\\h", " ").strip() for x in row.text.split("\n")]
            lines = [x for x in lines if x]
            overlap = next((n for n in range(min(len(before), len(lines)), 0, -1) if before[-n:] == lines[:n]), 0)
            before = lines
            if lines[overlap:]:
                yield pd.DataFrame({track: [key[0]], "cue": [row.cue], "start_seconds": [row.start_seconds], "lines": [lines[overlap:]]})
        state.update((before,))

    kind = dict(cues.dtypes)[track]
    return cues.groupBy(track).applyInPandasWithState(run, f"{track} {kind}, cue int, start_seconds double, lines array<string>", "lines array<string>", "append", GroupStateTimeout.NoTimeout)


def merged_each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], Any], checkpoint: str) -> StreamingQuery:
    """Hand each batch to ``apply`` (a merge that is the same when it runs twice)."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def digests(matches: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    """Open matches by saved search with the time at which their digest is due: the interval, between an hour and a week.

    ``subscriptions``: saved_search, digest_interval_seconds (null: an hour).
    """
    seconds = F.least(F.greatest(F.coalesce("digest_interval_seconds", F.lit(3600)), F.lit(3600)), F.lit(7 * 86_400))
    due = F.timestamp_micros(F.unix_micros(now) + seconds.cast("bigint") * 1_000_000)
    counted = matches.groupBy("saved_search").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return counted.join(subscriptions, "saved_search").select("saved_search", "n", "first_id", "last_id", due.alias("scheduled_for"))


def sequence_slices(documents: DataFrame, last: int, upto: int, most: int = 500) -> DataFrame:
    """(from_sequence, to_sequence, n): half-open ranges of the sequence after ``last`` with at most ``most`` rows each,
    for consumers that take bounded results; no row lies between two ranges.

    Cut by row numbers, however unevenly the sequence is spread. Rows that share a sequence stay together; more than
    ``most`` of them are an error.
    """
    rows = documents.where((F.col("index_sequence") > last) & (F.col("index_sequence") <= upto)).select("index_sequence")
    values = numbered(rows, ["index_sequence"], name="_number").groupBy("index_sequence").agg(F.min("_number").alias("_first"), F.count("*").alias("_n"))
    alike = values.agg(F.max("_n")).first()[0] or 1
    if alike > most:
        raise ValueError(f"{alike} rows share a sequence; a slice has {most} at most")
    # The last sequence of a slice may bring ``alike`` rows.
    cut = values.groupBy(F.floor((F.col("_first") - 1) / (most - alike + 1)).alias("_slice"))
    out = cut.agg((F.min("index_sequence") - 1).alias("from_sequence"), F.max("index_sequence").alias("to_sequence"), F.sum("_n").alias("n"))
    return out.drop("_slice")
