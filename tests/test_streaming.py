"""Streams over files, run until they have read them all."""

from pyspark.sql import functions as F

from millrace.streaming import standing


def test_standing_query_finds_each_match_once(spark, tmp_path):
    schema = "id int, text string, content_hash string, index_sequence long"
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    conditions = {"energy": F.col("text").contains("energy"), "all": F.lit(True)}
    spark.createDataFrame([(1, "energy", "h1", 1), (2, "x", "h2", 2)], schema).write.parquet(source)
    standing.run_standing(standing.read_stream(spark, source, schema), conditions, out, state).awaitTermination()
    # The overlap comes again, one document reads differently now, one is new.
    spark.createDataFrame([(1, "energy", "h1", 1), (2, "energy", "h2b", 3), (3, "x", "h3", 4)], schema).write.mode("append").parquet(source)
    standing.run_standing(standing.read_stream(spark, source, schema), conditions, out, state).awaitTermination()
    got = sorted((r.saved_search, r.id, r.match_key) for r in spark.read.parquet(out).collect())
    assert got == [("all", 1, "1:h1"), ("all", 2, "2:h2"), ("all", 2, "2:h2b"), ("all", 3, "3:h3"), ("energy", 1, "1:h1"), ("energy", 2, "2:h2b")]


def test_roll_up_captions_keep_state_between_batches(spark, tmp_path):
    schema = "track_id int, cue int, start_seconds double, text string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1)
    df((1, 0, 0.0, "a"), (1, 1, 5.0, "a\nb")).write.parquet(source)

    def run():
        lines = standing.new_caption_lines(standing.read_stream(spark, source, schema))
        lines.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).trigger(availableNow=True).start().awaitTermination()

    run()
    df((1, 2, 10.0, "b\nc"), (1, 3, 35.0, "a")).write.mode("append").parquet(source)
    run()
    assert sorted((r.cue, r.lines) for r in spark.read.parquet(out).collect()) == [(0, ["a"]), (1, ["b"]), (2, ["c"]), (3, ["a"])]
