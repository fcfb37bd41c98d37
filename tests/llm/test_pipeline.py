"""The stages of the pipeline, each against its operator by hand."""

import os

import pytest

from millrace.llm import simhash_dedup, substring_dedup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        held[name] = {r.doc_id: r for r in docs.collect()}
        assert set(held[name]) <= set(before)
        if name == "simhash_dedup":
            fp = {i: simhash_dedup.fingerprint((r.text or "").encode()) for i, r in held[name].items()}
            assert not [1 for i in fp for j in fp if i < j and (fp[i] ^ fp[j]).bit_count() <= 4]
        elif name == "substring_dedup":
            want = substring_dedup.brute_force([before[i].text for i in sorted(before)])
            for i, (n, gone, _) in zip(sorted(before), want, strict=True):
                assert (held[name][i].text == before[i].text) if not gone else len(held[name][i].text.split()) == n - gone
                assert held[name][i].n_chars == len(held[name][i].text) or not gone
        else:
            assert all(held[name][i] == before[i] for i in held[name])
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == set(held["substring_dedup"])
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 4096)


def test_run(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_odd_rows_and_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, row string"
    say = lambda word: " ".join(f"{word}{i * i % 17}" for i in range(30))
    texts = [(None, say("alpha")), (None, say("beta")), (5, say("gamma")), (5, say("delta")), (6, None), (7, "")]
    for name, rows in (("odd", texts), ("none", [])):
        spark.createDataFrame([(i, x, "en", "s", len(x or ""), "x", "y") for i, x in rows], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    # Without labels all are kept; the two empty texts are near copies; ids that are null or repeat are rows of their own.
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "6", "None", "None"]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
