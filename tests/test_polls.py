"""Streams with a memory: feeds that are polled, digests that are kept open."""

import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.session import make_importable
from millrace.sources import feeds, files
from millrace.streaming import digests, standing

RSS = "<rss><channel>{}</channel></rss>"
ITEM = "<item><title>{0}</title><link>https://example.org/{0}</link></item>"


def answer(folder, feed, poll, status, etag=None, *titles):
    os.makedirs(f"{folder}/{feed}", exist_ok=True)
    with open(f"{folder}/{feed}/{poll:06d}.body", "w") as f:
        f.write(RSS.format("".join(map(ITEM.format, titles))))
    with open(f"{folder}/{feed}/{poll:06d}.json", "w") as f:
        json.dump({"status": status, "etag": etag}, f)


def test_feeds_are_polled_when_due_and_remember_across_restarts(spark, tmp_path):
    make_importable(spark)
    folder, clock, out, state = (str(tmp_path / x) for x in ("feeds", "clock", "out", "state"))

    def run(now):
        with open(clock, "w") as f:
            f.write(str(now))
        stream = feeds.polled(spark, folder, cadence_seconds=100, clock=clock, feeds_per_task=1)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(feeds.SCHEMA).parquet(out).orderBy("polled_at", "feed").collect()
        return [(r.feed, r.poll, r.polled_at, r.status, r.outcome, r.failures, r.etag) for r in rows if r.polled_at == now]

    answer(folder, "a", 1, 200, "v1", "one", "two")
    answer(folder, "b", 1, 503)
    assert run(1000) == [("a", 1, 1000, 200, "succeeded", 0, "v1"), ("b", 1, 1000, 503, "failed", 1, "")]
    answer(folder, "a", 2, 304)
    answer(folder, "b", 2, 500)
    assert run(1050) == []  # neither is due
    assert run(1100) == [("a", 2, 1100, 304, "not_modified", 0, "v1")]  # b waits twice the cadence
    assert run(1200) == [("b", 2, 1200, 500, "failed", 2, "")]
    answer(folder, "a", 3, 200, "v1", "one", "two")  # the tag is the one held, though the answer says otherwise
    answer(folder, "b", 3, 200, "w1", "three")
    assert run(1599) == [("a", 3, 1599, 200, "not_modified", 0, "v1")]
    assert run(1600) == [("b", 3, 1600, 200, "succeeded", 0, "w1")]  # four times the cadence after the second failure
    answer(folder, "c", 1, 404)
    answer(folder, "a", 4, 200, "v2", "four")
    assert run(1700) == [("a", 4, 1700, 200, "succeeded", 0, "v2"), ("c", 1, 1700, 404, "failed", 1, "")]
    every = spark.read.schema(feeds.SCHEMA).parquet(out)
    assert every.count() == 8 and every.where("body is not null").count() == 3
    entries = files.feed_entries(every.where("body is not null").select("feed", "body"))
    assert sorted((r.feed, r.title) for r in entries.collect()) == [("a", "four"), ("a", "one"), ("a", "two"), ("b", "three")]


def test_a_batch_that_runs_again_gives_the_same_polls(tmp_path):
    folder, clock = str(tmp_path / "feeds"), str(tmp_path / "clock")
    answer(folder, "a", 1, 500)
    answer(folder, "a", 2, 200, "v", "x")
    reader = lambda: feeds.FeedReader({"path": folder, "clock": clock, "cadence_seconds": "10"})
    with open(clock, "w") as f:
        f.write("50")
    first = reader()
    start, end = first.initialOffset(), first.latestOffset()
    rows = [list(first.read(p)) for p in first.partitions(start, end)]
    again = reader()
    assert [list(again.read(p)) for p in again.partitions(start, end)] == rows and again.latestOffset() == end
    assert json.loads(json.dumps(end)) == end
    with open(clock, "w") as f:
        f.write("1e12")
    later = again.latestOffset()
    assert [r[1:6] for p in again.partitions(end, later) for r in again.read(p)] == [(2, 1e12, 200, "succeeded", 0)]
    assert feeds.after(feeds.NEW | {"failures": 60}, {"status": 500}, 0.0, 900.0)[0]["next"] == feeds.DAY


def test_digests_stay_open_and_are_sent_once(spark, tmp_path):
    make_importable(spark)
    digests.settings(spark)
    schema = "saved_search string, match_id long, matched_at timestamp"
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    t0 = datetime(2024, 1, 1)
    at = lambda minutes: t0 + timedelta(minutes=minutes)
    searches = spark.createDataFrame([("hourly", 60), ("two", 7200), ("weekly", 10**9), ("null", None)], "saved_search string, digest_interval_seconds long")

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        matches = standing.read_stream(spark, source, schema)
        sent = digests.buffered(matches, searches).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        sent.trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(digests.OUT).parquet(out).collect() if os.path.isdir(out) else []
        return sorted((r.saved_search, r.batch, int(r.match_id), r.opened_at, r.scheduled_for) for r in rows)

    assert run(("hourly", 1, at(0)), ("hourly", 2, at(30)), ("two", 3, at(10)), ("weekly", 4, at(0)), ("null", 5, at(5)), (None, 6, at(0)), ("hourly", 7, None)) == []
    # A restart; the hourly batch is due at 60, and the watermark stays ten minutes behind.
    assert run(("two", 8, at(65)), ("hourly", 2, at(45))) == []
    first = [("hourly", 1, 1, at(0), at(60)), ("hourly", 1, 2, at(0), at(60)), ("null", 1, 5, at(5), at(65))]
    assert run(("two", 9, at(90)))[: len(first)] == first
    got = run(("hourly", 10, at(95)), ("nobody", 11, at(96)))
    assert got == first
    # The next batches: 'hourly' anew from 95, 'two' from 10 with all three; each is sent once.
    got = run(("weekly", 12, at(400)))
    assert got == sorted([*first, ("hourly", 2, 10, at(95), at(155)), ("nobody", 1, 11, at(96), at(156)), *(("two", 1, i, at(10), at(130)) for i in (3, 8, 9))])
    assert run(("weekly", 13, at(500))) == got
    got = run(("weekly", 14, at(8 * 24 * 60)))
    assert [r for r in got if r[0] == "weekly"] == [("weekly", 1, i, at(0), at(7 * 24 * 60)) for i in (4, 12, 13)]
    got = run(("weekly", 15, at(16 * 24 * 60)))
    assert [r for r in got if r[0] == "weekly" and r[1] == 2] == [("weekly", 2, 14, at(8 * 24 * 60), at(15 * 24 * 60))]
    assert spark.read.parquet(out).where(F.col("sent_at") < F.col("scheduled_for")).count() == 0
