"""What Python workers keep between tasks, and how much they get at a time."""

import pyarrow as pa

from millrace.llm import _common


def test_other_operators_tasks_drop_what_a_worker_remembers():
    texts = lambda: iter([pa.RecordBatch.from_arrays([pa.array(["x y", None])], ["text"])])
    _common.remembered.update(a=1, b=2)
    list(_common.worded(texts(), "text", keep="a"))
    assert list(_common.remembered) == ["a"]
    list(_common.slices(texts(), "text"))
    assert not _common.remembered


def test_small_batches(spark):
    rows = spark.range(0, 12, 1, 1).selectExpr("repeat('x', 1000000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    found = [r["n"] for r in _common.in_small_batches(rows).mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 12 and max(found) <= 5


def test_blocks_of_resampling_are_held_one_at_a_time(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    from millrace.llm import resampling

    monkeypatch.setattr(resampling, "worded", lambda batches, column, *_: _common.worded(batches, column, 2_000))
    written, kept = [], resampling.stash
    monkeypatch.setattr(resampling, "stash", lambda df, name, *args, **options: written.append(kept(df, name, *args, **options)) or written[-1])
    monkeypatch.setattr(resampling, "drop_stash", lambda df: None)
    docs = spark.range(0, 400, 1, 1).selectExpr("id as doc_id", "repeat(concat('word', id % 7, ' '), 30) as text")
    got = {r["doc_id"]: r for r in resampling.resample(docs, docs.select("text")).collect()}
    assert len(got) == 400 and all(r["n_features"] == 30 for r in got.values()) and sum(r["rank"] is not None for r in got.values()) == 40
    (path,) = [df._stash_path for df in written if "/matrix-" in df._stash_path]
    groups = [f.metadata.row_group(g).num_rows for f in map(pq.ParquetFile, glob.glob(path.removeprefix("file://") + "/*.parquet")) for g in range(f.metadata.num_row_groups)]
    assert sum(groups) > 30 and max(groups) == 1  # all blocks of a file were one group before
