"""Tables that change all at once, what is kept in them, and one text for all JSON that means the same."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import canonical
from millrace.operators import histograms, resolve
from millrace.plans import search
from millrace.session import make_importable
from millrace.sources.manifest import PASSAGES, Conflict, ManifestTable, replace_passages


def passages(spark, *rows):
    return spark.createDataFrame(list(rows), "media_track_id long, window_key string, starts_at double, ends_at double, text string")


def spans(spark, *rows):
    return spark.createDataFrame(list(rows), "media_track_id long, starts_at double, ends_at double")


def held(table, version=None):
    return sorted((r.media_track_id, r.window_key, r.text, r.state) for r in table.read(version).collect())


@pytest.fixture
def table(spark, tmp_path):
    out = ManifestTable(spark, str(tmp_path / "passages"), PASSAGES, ["media_track_id"], buckets=4)
    replace_passages(out, passages(spark, (1, "a", 0.0, 30.0, "one"), (1, "b", 30.0, 60.0, "two"), (2, "c", 0.0, 30.0, "other")), spans(spark, (1, 0.0, 60.0)))
    return out


def test_passages_are_replaced_at_once(spark, table):
    assert held(table) == [(1, "a", "one", "published"), (1, "b", "two", "published"), (2, "c", "other", "published")]
    replace_passages(table, passages(spark, (1, "b", 30.0, 58.0, "two again"), (1, "d", 10.0, 30.0, "new")), spans(spark, (1, 10.0, 60.0)), "batch 2")
    after = [(1, "a", "one", "withdrawn"), (1, "b", "two again", "published"), (1, "d", "new", "published"), (2, "c", "other", "published")]
    assert held(table) == after and [r[3] for r in held(table, 1)] == ["published"] * 3
    # The same batch again changes nothing, a span that only touches withdraws nothing.
    assert replace_passages(table, passages(spark, (1, "z", 0.0, 1.0, "z")), spans(spark, (1, 0.0, 99.0)), "batch 2") == 2 and held(table) == after
    replace_passages(table, passages(spark), spans(spark, (2, 30.0, 60.0), (3, 0.0, 1.0)))
    assert held(table) == after


def test_a_writer_that_dies_leaves_the_old_table(spark, table, monkeypatch):
    before = held(table)
    with monkeypatch.context() as m:
        m.setattr(ManifestTable, "commit", lambda *_: (_ for _ in ()).throw(OSError("the driver is gone")))
        with pytest.raises(OSError):
            replace_passages(table, passages(spark, (1, "x", 0.0, 9.0, "lost")), spans(spark, (1, 0.0, 60.0)), "b")
    assert held(table) == before and table.version() == 1
    replace_passages(table, passages(spark, (1, "x", 0.0, 9.0, "kept")), spans(spark, (1, 0.0, 60.0)), "b")
    assert (1, "x", "kept", "published") in held(table)
    assert table.vacuum(keep=1) >= 1 and (1, "x", "kept", "published") in held(table)


def test_two_writers(spark, table, monkeypatch):
    other = ManifestTable(spark, table.path, PASSAGES, ["media_track_id"], buckets=4)
    real, first = ManifestTable.commit, [True]

    def commit(self, manifest):
        if first.pop() if first else False:  # the other one is faster
            replace_passages(other, passages(spark, (1, "e", 90.0, 99.0, "faster")), spans(spark, (1, 90.0, 99.0)))
        return real(self, manifest)

    monkeypatch.setattr(ManifestTable, "commit", commit)
    replace_passages(table, passages(spark, (1, "f", 100.0, 110.0, "slower")), spans(spark, (1, 100.0, 110.0)))
    assert {"e", "f", "a", "b", "c"} == {r[1] for r in held(table)} and table.version() == 3
    with pytest.raises(Conflict):
        real(table, table.manifest(2))


def test_histograms_merge_in_any_order_and_once(spark, tmp_path):
    values = [(f"m{i % 3}", float(i * 7 % 12000) - 3) for i in range(600)] + [("m0", None), ("m9", None), ("m1", 5.0), ("m1", 10000.0)]
    whole = histograms.partial(spark.createDataFrame(values, "name string, v double"), ["name"], "v")
    want = sorted((r["name"], r["n"], r["total"], r["least"], r["greatest"], tuple(r["buckets"])) for r in whole.collect())
    for order in ((0, 1, 2, 1), (2, 2, 0, 1)):
        stored = histograms.StoredHistograms(spark, str(tmp_path / f"h{order[0]}"), "name string")
        for k in order:
            stored.merge(spark.createDataFrame(values[k::3], "name string, v double"), "v", f"part {k}")
        assert sorted((r["name"], r["n"], r["total"], r["least"], r["greatest"], tuple(r["buckets"])) for r in stored.read().collect()) == want
    assert sum(want[1][5]) == want[1][1] and all(len(r[5]) == 16 for r in want)
    one = histograms.partial(spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 5.1), ("a", 10001.0)], "name string, v double"), ["name"], "v").first()
    assert (one["buckets"][0], one["buckets"][1], one["buckets"][2], one["buckets"][15]) == (1, 1, 1, 1)


@pytest.mark.parametrize("bits", [60, 5])
def test_entities_are_created_once(spark, tmp_path, bits):
    """With 5 bits most ids collide."""
    entities = ManifestTable(spark, str(tmp_path / "e"), "entity_id long, canonical_name string, normal_name string", ["entity_id"], buckets=4)
    aliases = ManifestTable(spark, str(tmp_path / "a"), "alias_name string, entity_id long", ["alias_name"], buckets=4)
    batch = lambda names, b: resolve.create_absent(entities, aliases, spark.createDataFrame([(n,) for n in names], "name string"), b, bits=bits)
    first = [f"Office {i}" for i in range(12)] + ["Health  Canada", "health canada", "Santé “X”", 'santé "x"', None, "  "]
    batch(first, "one")
    batch(first, "one")
    state = lambda: ({r.normal_name: (r.entity_id, r.canonical_name) for r in entities.read().collect()}, {r.alias_name: r.entity_id for r in aliases.read().collect()})
    a, named = state()
    assert entities.read().count() == len(a) == 14 == len({i for i, _ in a.values()}) and len(named) == aliases.read().count() == 16
    assert a["health canada"][1] == "Health  Canada" and named["health canada"] == named["Health  Canada"] == a["health canada"][0]
    batch(["Office 3", "OFFICE 3", "Brand new"], "two")
    batch(["Brand New", "Office 12"], "three")
    b, named = state()
    assert {k: b[k] for k in a} == a and len(b) == 16 == len({i for i, _ in b.values()}) and named["OFFICE 3"] == a["office 3"][0] and named["Brand New"] == named["Brand new"]


def test_batch_highlights_are_the_single_ones(spark):
    make_importable(spark)
    texts = [(1, "The Énergie board, the ENERGIE bill."), (2, None), (3, ""), (4, "no match; but_the x2 X2"), (5, "le conseil de l'énergie")]
    df = spark.createDataFrame(texts, "id int, text string").repartition(2)
    queries = {"a": ["energie", "the"], "b": ["x2"], "none": ["zebra"], "empty": [], "c": ["the", "conseil"]}
    got = {(r.id, r.query): (r.position, r.segments) for r in search.highlight_batch(df, queries).collect()}
    assert len(got) == len(texts) * len(queries) and {k[1]: v[0] for k, v in got.items()} == {q: i for i, q in enumerate(queries, 1)}
    for name, words in queries.items():
        one = df.select("id", search.highlighted(F.col("text"), words).alias("s")) if words else df.select("id", F.transform(search.highlighted(F.col("text"), ["zebra"]), lambda x: x).alias("s"))
        assert {r.id: r.s for r in one.collect()} == {i: got[i, name][1] for i, _ in texts}
    phrase = search.highlight_batch(df, {"p": ["energie board", "the energie"]}).where("id = 1").first().segments
    assert [s.text for s in phrase if s.match] == ["The", "Énergie", "board", "the", "ENERGIE"]
    assert search.highlight_batch(df.limit(0), queries).collect() == []


def test_canonical_json(spark):
    alike = ['{"b": 1.50, "a": [1, {"z": null, "y": "é\\n"}], "n": 1e2}', '{"n":100.0,"a":[1.0,{"y":"\\u00e9\\n","z":null}],"b":1.5}', ' {"a":[1,{"y":"é\\n","z":null}],"b":15e-1,"n":100}']
    other = ['{"b": 1.5, "a": [{"z": null, "y": "é\\n"}, 1], "n": 100}', '{"b": "1.5", "a": [1, {"z": null, "y": "é\\n"}], "n": 100}']
    df = spark.createDataFrame([(x,) for x in [*alike, *other, None, "nope", '{"a":1,"a":2}', "[]", "{}", '"t"']], "j string")
    got = [r[0] for r in df.select(canonical.canonical_json("j")).collect()]
    assert got[0] == got[1] == got[2] == '{"a":[1,{"y":"é\\n","z":null}],"b":1.5,"n":100}' and len(set(got[:5])) == 3
    assert got[5:] == [None, None, None, "[]", "{}", '"t"']
    row = (1, datetime.datetime(2024, 1, 1, 5), datetime.date(2024, 1, 2), decimal.Decimal("12.500"), decimal.Decimal("100"), {"b": 1, "a": None}, [("x", 1.5)], None)
    typed = spark.createDataFrame([row], "z int, at timestamp, day date, money decimal(10,3), whole decimal(10,0), m map<string,int>, l array<struct<b:string,a:double>>, n string")
    text = typed.select(F.struct("*").alias("s")).select(canonical.canonical(F.col("s"), typed.schema)).first()[0]
    assert text == '{"at":"2024-01-01T05:00:00.000000Z","day":"2024-01-02","l":[{"a":1.5,"b":"x"}],"m":{"a":null,"b":1},"money":"12.5","n":null,"whole":"100.0","z":1}'
