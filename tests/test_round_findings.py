"""What the third round's findings claimed: each test failed before, or is bounded by what it measures."""

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import catalog, catalog_more  # noqa: F401


def against_sql(spark, tmp_path, name, **tables):
    """Sorted rows of a query and of its SQL over the given tables."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    result = con.execute(catalog.SQL[name])
    names = [c[0] for c in result.description]
    return sorted((tuple(r) for r in got.select(*names).collect()), key=repr), sorted(result.fetchall(), key=repr)


def test_caption_passages_of_broken_lines_blanks_and_nulls(spark, tmp_path):
    talk = [
        (0, 0, "One. Two\nthree."), (0, 1, "three. Four"), (0, 2, None), (0, 3, "Four. Five"), (1, 0, "a\\hb. \t. c"), (1, 1, "c. \x0b d"),
        (2, 0, None), (3, 0, "x. y\n"), (3, 1, "y. z"), (4, None, "late. word"), (4, 5, "late"),
    ]
    got, want = against_sql(spark, tmp_path, "caption_passages", conversations=spark.createDataFrame([(c, n, "user", x) for c, n, x in talk], "conv_id long, turn int, role string, text string"))
    assert got == want and len(got) == 6


def test_trigram_top5_of_close_far_equal_and_short_names(spark, tmp_path, monkeypatch):
    names = ["ab", "", None, "abc", "ABC", "abcd", "xİ\U0001d11ez", "aaaa", "aaaaaa", "lone whale", "whale song", "Ministry of Health", "Ministry of Wealth", "ministry of health"]
    names += [f"Supplier#{n:09d}" for n in (*range(40), *range(1000, 1030), 111111, 222222)] + [f"office {a}{b}" for a in "abc" for b in ("", " of", " of it", " of it all")]
    rows = [(i, n) for i, n in enumerate([*names, *names[::3]])]
    got, want = against_sql(spark, tmp_path, "trigram_top5", supplier=spark.createDataFrame(rows, "s_suppkey long, s_name string"))
    assert got == want and len(got) > 300


def test_similar_names_meet_few(spark):
    from millrace.operators import resolve

    for least, share in resolve._LEVELS:  # the keys lose no pair of the level
        sets = [[a, *range(10, b)] for a in range(4) for b in range(10, 22)] + [[1], [2], [1, 2], [1, 2, 3]]
        df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, s array<bigint>").select("i", "s", F.explode(resolve._rare_keys(F.col("s"), F.size("s"), least, share)).alias("k"))
        met = {(r.i, r.j) for r in df.join(df.select(F.col("i").alias("j"), "k"), "k").select("i", "j").distinct().collect()}
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(set(a) & set(b))
                assert 100 * both < least * (len(a) + len(b) - both) or (i, j) in met


def test_crosswalk_deals_pairs_by_their_number(spark, monkeypatch):
    from millrace.operators import crosswalk

    monkeypatch.setattr(crosswalk, "TASK_PAIRS", 50)
    listed = [(c, p) for c in range(60) for p in {c % 7, c % 3, 0}] + [(1, 1), (None, 1)]
    other = [(c, q) for c in range(60) for q in range(c % 5 + 10)]
    sources, targets = (spark.createDataFrame(x, "child_id int, parent_id int") for x in (listed, other))
    people = [(c, c % 4 if c % 9 else None) for c in range(60)] + [(3, 5)]
    got = crosswalk.overlaps(sources, targets, spark.createDataFrame(people, "child_id int, population int"))
    want = {}
    for c, p in listed:
        for d, q in other:
            for e, n in people:
                if c == d == e:
                    was = want.setdefault((p, q), [0, set()])
                    was[0], was[1] = was[0] + (n or 0), was[1] | {c}
    want = {k: (n, len(of)) for k, (n, of) in want.items() if n > 0}
    assert {(r.source_id, r.target_id): (r.overlap_population, r.da_count) for r in got.collect()} == want
    assert got.rdd.getNumPartitions() > 30  # 4 before, whatever the number of pairs
    weighed = crosswalk.weights(got).collect()
    assert len(weighed) == len(want)
    for r in weighed:
        total = sum(n for (p, _), (n, _) in want.items() if p == r.source_id)
        assert r.weight_source_to_target == pytest.approx(r.overlap_population / total, abs=1e-8)


def test_the_search_for_packings_holds_little():
    import tracemalloc

    packing = pytest.importorskip("millrace.llm.packing")
    counts = {s: 1 + s * 7919 % 3 for s in range(1100, 1800)}
    assert sum(n for _, n in packing.best_fit_decreasing(counts, 4096)) > packing.fewest_sequences(counts, 4096)
    tracemalloc.start()
    plan = packing.bin_completion(counts, 4096, steps=300)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {s: sum(fill.count(s) * n for fill, n in plan) for s in counts} == counts
    assert most < 10e6  # 25 to 30 MB before


def test_canonical_json_at_any_depth(spark):
    from millrace.functions import canonical

    texts = ['{"b": {"c": {"d": {"e": [100.0, 1e2, -0.0, 1.5e0, 12345678.0, 1E15]}}}, "a": "1.0, 1e2 \\" 2.0", "x 1e3": -0.0}', '[1.0,"]2.0",3.50]', "7.0", '"7.0"', "1e2", '{"a":1,"a":2}', "nope", None, '{"é":null,"z":[],"y":{}}', "-0.0"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, j string")
    got = [r[1] for r in sorted(df.select("i", canonical.canonical_json("j")).collect())]
    assert got == ['{"a":"1.0, 1e2 \\" 2.0","b":{"c":{"d":{"e":[100,100,0,1.5,12345678,1.0E15]}}},"x 1e3":0}', '[1,"]2.0",3.5]', "7", '"7.0"', "100", None, None, None, '{"y":{},"z":[],"é":null}', "0"]


def test_pages_are_read_in_small_slices(spark):
    import pyarrow as pa

    from millrace.sources import files

    texts = ["<p>a</p>", None, "", "<title>é</title><p>" + "x" * 50, "<b id='k'>v</b>"] * 3
    batch = pa.RecordBatch.from_pydict({"html": texts, "n": list(range(len(texts)))})
    parts = list(files._pieces(batch, "html", rows=4, most=60))
    assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist() and max(p.num_rows for p in parts) <= 4
    assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column("html").to_pylist()) <= 60 for p in parts)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "n int, html string")
    got = sorted(map(tuple, files.page_text(df, ids=("k",)).collect()))
    assert got[:5] == [(0, "", "a", {}), (1, "", "", {}), (2, "", "", {}), (3, "é", "é " + "x" * 50, {}), (4, "", "v", {"k": "v"})] and len(got) == 15


def test_highlights_of_a_text_full_of_matches(spark, capsys):
    from millrace.plans import search

    df = spark.createDataFrame([(1, "The end. " * 3000), (2, None), (3, "")], "id int, text string")
    found = search.highlight_batch(df, {"a": ["the", "end"], "b": ["end the"]})
    found.explain()
    assert "array_contains" not in capsys.readouterr().out  # it walked all marks of a text for each of its words
    got = {(r.id, r.query): r.segments for r in found.collect()}
    assert sum(s.match for s in got[1, "a"]) == 6000 and sum(s.match for s in got[1, "b"]) == 5998
    assert got[2, "a"] is None and got[3, "b"] == []


def test_crosswalk_pairs_stay_where_they_are_made(spark, monkeypatch):
    from millrace import catalog
    from millrace.operators import crosswalk

    moves = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert moves(catalog.QUERIES["crosswalk_weights"](spark, "/root/testdata/sf0.001")) == 1  # 4 before: pairs to each side, and the totals that they met; and one of pairs in a job of its own
    rows = spark.createDataFrame([(i % 7 or None, i, 1 + i % 3, 1) for i in range(90)], "source_id int, target_id int, overlap_population long, da_count long")
    assert moves(crosswalk.weights(rows)) == 2

    sides = {c: ([c % 3, c % 5 or None, c % 3], list(range(c % 4, 6))) for c in range(40)}
    listed = [spark.createDataFrame([(c, p) for c, of in sides.items() for p in of[k]], "child_id int, parent_id int") for k in range(2)]
    for lowest, task, held in ((0, 10**6, 10), (0, 9, 10), (0, 9, 1), (-2, 9, 10)):
        monkeypatch.setattr(crosswalk, "TASK_PAIRS", task)
        monkeypatch.setattr(crosswalk, "HELD", held)
        people = {c: (c + 3) % 6 + lowest if c % 8 else None for c in sides if c != 4}
        for swap in (False, True):
            want = {}
            for c in people:
                a, b = sides[c][::-1] if swap else sides[c]
                for p in set(a):
                    for q in set(b):
                        n, d = want.get((p, q), (0, 0))
                        want[p, q] = n + (people[c] or 0) * a.count(p) * b.count(q), d + 1
            want = {k: v for k, v in want.items() if v[0] > 0}
            given = spark.createDataFrame(list(people.items()), "child_id int, population int")
            got = {tuple(r)[:2]: r for r in crosswalk.area_weights(crosswalk.areas(*(listed[::-1] if swap else listed), given)).collect()}
            assert {k: (r.overlap_population, r.da_count) for k, r in got.items()} == want
            for (p, q), r in got.items():
                assert r.weight_source_to_target == pytest.approx(r.overlap_population / sum(n for k, (n, _) in want.items() if k[0] == p), abs=1e-8)
                assert r.weight_target_to_source == pytest.approx(r.overlap_population / sum(n for k, (n, _) in want.items() if k[1] == q), abs=1e-8)


def test_highlights_are_marked_in_one_walk(spark, capsys):
    from millrace import catalog_more
    from millrace.plans import search
    from millrace.registry import QUERIES

    QUERIES[catalog_more.batch_highlights.__name__](spark, "/root/testdata/sf0.001").explain()
    shown = capsys.readouterr().out
    assert "MapInArrow" in shown and "regexp_extract_all" not in shown and "lambdafunction" not in shown  # words were cut, folded and joined one by one in Spark's interpreter
    texts = ["The Énergie board, THE  energie: board", None, "", "energie", " board_the ", "x\ny the", "İx ix \U0002ebf0the the\U0001d400", "the the energie board board", "energie", "é É1 e"] + ["the board " * 50_000] * 3
    df = spark.createDataFrame([(i, x, -i) for i, x in enumerate(texts)], "id int, text string, other int").repartition(2)
    queries = {"words": ["the", "É"], "phrases": ["energie board", "the energie", "the the"], "none": [], "both": ["board", "the energie board", "ix"]}
    found = search.marked_batch(df, queries, before="[", after="]")
    assert found.columns == ["id", "other", "position", "query", "matches", "marked"]
    got = {(r.id, r.query): r for r in found.collect()}
    want = {(r.id, r.query): r for r in search.highlight_batch(df, queries).collect()}
    assert got.keys() == want.keys() and len(got) == len(texts) * len(queries)
    for k, r in want.items():
        segments = r.segments
        assert (got[k].position, got[k].other) == (r.position, r.other)
        assert got[k].marked == (None if segments is None else "".join(f"[{s.text}]" if s.match else s.text for s in segments))
        assert got[k].matches == (None if segments is None else sum(s.match for s in segments))
    assert got[0, "phrases"].marked == "[The] [Énergie] [board], [THE]  [energie]: [board]" and got[7, "phrases"].marked == "[the] [the] [energie] [board] board"
    assert got[4, "words"].marked == " board_[the] " and got[6, "words"].marked == "İx ix \U0002ebf0[the] the\U0001d400" and got[6, "both"].marked == "İx [ix] \U0002ebf0the the\U0001d400"
    assert got[9, "words"].marked == "[é] É1 [e]" and got[10, "words"].matches == 50_000
    # The empty list of queries, and an empty table.
    assert search.marked_batch(df, {}).collect() == search.marked_batch(df.limit(0), queries).collect() == []
