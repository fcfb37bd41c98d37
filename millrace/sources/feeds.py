"""Polling of feeds as a stream.

``spark.readStream.format("polled_feeds").option("path", ..)``: a row for each poll of a feed, with its outcome and, where
it brought something new, the body, which ``files.feed_entries`` reads. What has to outlive a run is in the stream's offsets: of
each feed the tag of the body it last brought, how often in a row it failed, how often it was asked and when it
is due again. A restarted stream goes on from there, and a batch that is run again gives the same rows.

A feed is due at once, then a cadence after a poll that worked; after n failures in a row the wait is the cadence times 2**n,
a day at most. An answer 304, or one with the tag held, is not modified; 200 to 299 brings a body; others are failures.

Input is injected, as this engine doesn't open connections: a folder for each feed, in it the answers in order,
``000001.json`` (status, etag) and its body ``000001.body``; a poll takes the next one, and a feed without one isn't asked. The driver
looks at answers' heads only; tasks read bodies. Both see the folder at the same path.

The offset grows with the number of feeds, not of polls.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

SCHEMA = "feed string, poll long, polled_at double, status int, outcome string, failures int, etag string, body string"
DAY = 86_400.0


def after(state: dict, head: dict, now: float, cadence: float) -> tuple[dict, str]:
    """(the feed's next state, the outcome) of an answer."""
    status, etag = int(head["status"]), head.get("etag") or ""
    polls = state["polls"] + 1
    if status == 304 or 200 <= status < 300 and etag and etag == state["etag"]:
        return {"polls": polls, "etag": state["etag"], "failures": 0, "next": now + cadence, "at": now}, "not_modified"
    if 200 <= status < 300:
        return {"polls": polls, "etag": etag, "failures": 0, "next": now + cadence, "at": now}, "succeeded"
    failures = state["failures"] + 1
    wait = min(cadence * 2.0 ** min(failures, 40), DAY)
    return {"polls": polls, "etag": state["etag"], "failures": failures, "next": now + wait, "at": now}, "failed"


NEW = {"polls": 0, "etag": "", "failures": 0, "next": 0.0, "at": 0.0}


def _text(state: dict) -> dict:
    """Offsets hold whole numbers and texts: times as microseconds."""
    return {k: round(v * 1e6) if k in ("next", "at") else v for k, v in state.items()}


def _state(text: dict | None) -> dict:
    return NEW if text is None else {k: v / 1e6 if k in ("next", "at") else v for k, v in text.items()}


class Answers:
    """The injected answers."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file:")

    def feeds(self) -> list[str]:
        return sorted(f for f in os.listdir(self.folder) if os.path.isdir(os.path.join(self.folder, f)))

    def head(self, feed: str, poll: int) -> dict | None:
        try:
            with open(os.path.join(self.folder, feed, f"{poll:06d}.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def body(self, feed: str, poll: int) -> str:
        with open(os.path.join(self.folder, feed, f"{poll:06d}.body"), encoding="utf-8", errors="replace") as f:
            return f.read()


@dataclass
class Polls(ds.InputPartition):
    """(feed, its state before, its state after) of some feeds."""

    of: list


class FeedReader(ds.DataSourceStreamReader):
    def __init__(self, options: dict):
        self.answers = Answers(options["path"])
        self.cadence, self.per_task = float(options.get("cadence_seconds", 900)), int(options.get("feeds_per_task", 16))
        self.clock = options.get("clock")  # a file that holds the time, for tests
        self.held: dict | None = None

    def now(self) -> float:
        if self.clock:
            with open(self.clock) as f:
                return float(f.read())
        return time.time()

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.held is None:
            self.held = {}
        now, out = self.now(), dict(self.held)
        for feed in self.answers.feeds():
            state = _state(out.get(feed))
            head = self.answers.head(feed, state["polls"] + 1) if state["next"] <= now else None
            if head is not None:
                out[feed] = _text(after(state, head, now, self.cadence)[0])
        self.held = out
        return out

    def partitions(self, start: dict, end: dict) -> list[ds.InputPartition]:
        # A batch that is planned again after a restart tells how far its stream was.
        self.held = self.held if self.held is not None else end
        moved = [(feed, start.get(feed), state) for feed, state in sorted(end.items()) if state != start.get(feed)]
        return [Polls(moved[at : at + self.per_task]) for at in range(0, len(moved), self.per_task)]

    def commit(self, end: dict) -> None:
        self.held = self.held if self.held is not None else end

    def read(self, partition: Polls) -> Iterator[tuple]:
        for feed, before, end in partition.of:
            state, last = _state(before), _state(end)
            while state["polls"] < last["polls"]:
                poll = state["polls"] + 1
                head = self.answers.head(feed, poll)
                state, outcome = after(state, head, last["at"], self.cadence)
                body = self.answers.body(feed, poll) if outcome == "succeeded" else None
                yield feed, poll, state["at"], int(head["status"]), outcome, state["failures"], state["etag"], body


class FeedSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "polled_feeds"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> ds.DataSourceStreamReader:
        return FeedReader(dict(self.options))


def polled(spark: SparkSession, path: str, **options) -> DataFrame:
    """The stream of polls of the feeds under ``path``."""
    spark.dataSource.register(FeedSource)
    reader = spark.readStream.format("polled_feeds").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
