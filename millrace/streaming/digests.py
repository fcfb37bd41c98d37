"""Digests of matches, kept open over time by a stream's state.

A saved search's first match opens a batch and sets when it is due: the search's interval later, an hour at least and a week
at most. Matches that come before that join the batch. When it is due a timer closes the batch and sends it: a row for each
match with the batch's number, so that no row grows with a digest. The first match of after that opens the next one. All of this is state of the
stream, so a restart loses nothing and sends nothing twice.

Time is the matches' own (the watermark): a batch is sent once matches of after its due time, and ``late`` more, have been seen.

Defined results: matches that lack a search or a time are left out; a match that comes twice into one open batch is sent
once; a match behind the watermark joins the batch that is open, or opens one that is due at once; a null interval is an hour.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR, WEEK = 3_600, 7 * 86_400
OUT = "saved_search string, batch long, match_id string, matched_at timestamp, opened_at timestamp, scheduled_for timestamp, sent_at timestamp"


def interval_seconds(c):
    return F.least(F.greatest(F.coalesce(c.cast("bigint"), F.lit(HOUR)), F.lit(HOUR)), F.lit(WEEK))


class Digests(StatefulProcessor):
    """State of a saved search: the open batch, its matches, and how many batches there were."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "opened_ms long, due_ms long, seconds long")
        self.matches = handle.getMapState("matches", "match_id string", "at_ms long")
        self.sent = handle.getValueState("sent", "batches long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            ordered = pdf.sort_values(["at_ms", "match_id"], kind="stable")
            for match, at, seconds in zip(ordered["match_id"], ordered["at_ms"], ordered["seconds"], strict=True):
                if not self.open.exists():
                    self._opened(int(at), int(seconds))
                if not self.matches.containsKey((match,)):
                    self.matches.updateValue((match,), (int(at),))
        return iter([])

    def _opened(self, at: int, seconds: int) -> None:
        self.open.update((at, at + seconds * 1000, seconds))
        self.handle.registerTimer(at + seconds * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened, due, seconds = self.open.get()
        number = (self.sent.get()[0] if self.sent.exists() else 0) + 1
        every, now = sorted((at, match) for (match,), (at,) in self.matches.iterator()), timerValues.getCurrentWatermarkInMs()
        held, next_ones = [x for x in every if x[0] < due], [x for x in every if x[0] >= due]
        self.sent.update((number,))
        self.open.clear()
        for _, match in held:
            self.matches.removeKey((match,))
        if next_ones:  # came with the news that the batch was due
            self._opened(next_ones[0][0], seconds)
        time = lambda ms: pd.Timestamp(ms, unit="ms")
        for at in range(0, len(held), 10_000):
            some = held[at : at + 10_000]
            yield pd.DataFrame({
                "saved_search": [key[0]] * len(some), "batch": number, "match_id": [m for _, m in some], "matched_at": [time(a) for a, _ in some],
                "opened_at": time(opened), "scheduled_for": time(due), "sent_at": time(now),
            })

    def close(self) -> None:
        pass


def buffered(matches: DataFrame, subscriptions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The matches of digests that are sent. ``matches``: a stream of saved_search, match_id, matched_at; ``subscriptions``: a
    table of saved_search, digest_interval_seconds."""
    held = subscriptions.select("saved_search", interval_seconds(F.col("digest_interval_seconds")).alias("seconds"))
    rows = matches.where("saved_search is not null and matched_at is not null").withWatermark("matched_at", late)
    rows = rows.join(held, "saved_search", "left").select(
        "saved_search", F.col("match_id").cast("string").alias("match_id"), "matched_at", F.unix_millis("matched_at").alias("at_ms"), F.coalesce("seconds", F.lit(HOUR)).alias("seconds")
    )
    return rows.groupBy("saved_search").transformWithStateInPandas(Digests(), OUT, "Append", "EventTime")


def settings(spark) -> None:
    """State with timers needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
