"""Operators on tables small enough to work out by hand."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, text
from millrace.operators import aggregates, calendar, crosswalk, geometry, intervals, joins, latest, merge, metrics, resolve, topk
from millrace.plans import filters, search, views


def test_crosswalk_weights(spark, rows):
    sources = spark.createDataFrame([(1, "M5V"), (2, "M5V"), (3, "M5H")], "child_id int, parent_id string")
    targets = spark.createDataFrame([(1, "001"), (2, "002"), (3, "002")], "child_id int, parent_id string")
    pops = spark.createDataFrame([(1, 600), (2, 400), (3, 500)], "child_id int, population int")
    got = {(r.source_id, r.target_id): r for r in crosswalk.weights(crosswalk.overlaps(sources, targets, pops)).collect()}
    assert got["M5V", "001"].overlap_population == 600 and got["M5V", "001"].weight_source_to_target == 0.6 and got["M5V", "001"].da_count == 1
    assert got["M5V", "002"].weight_target_to_source == round(400 / 900, 8)
    assert [r.target_id for r in crosswalk.lookup(crosswalk.weights(crosswalk.overlaps(sources, targets, pops)), "M5V").collect()] == ["001", "002"]


def test_crosswalk_weights_of_null_and_empty_parents(spark):
    df = spark.createDataFrame([(None, 1, 3), (None, 2, 1), (5, 1, 0), (5, None, 0), (6, 2, None), (7, 2, 3)], "source_id int, target_id int, overlap_population long")
    got = {(r[0], r[1]): (r[3], r[4]) for r in crosswalk.weights(df).collect()}
    want = {(None, 1): (0.75, 1.0), (None, 2): (0.25, 0.25), (5, 1): (0.0, 0.0), (5, None): (0.0, 0.0), (6, 2): (0.0, None), (7, 2): (1.0, 0.75)}
    assert got == want


def test_pairs_without_population_go(spark):
    side = spark.createDataFrame([(1, "a")], "child_id int, parent_id string")
    assert crosswalk.overlaps(side, side, spark.createDataFrame([(1, None)], "child_id int, population int")).count() == 0


def test_allocation(spark):
    obs = spark.createDataFrame([(1, "additive", "A", 100.0), (2, "ratio", "A", 5.0), (3, "ratio", "A", 7.5), (4, "additive", "A", 1.0)], "measure_id int, aggregation_type string, geo_id string, value double")
    rules = spark.createDataFrame([(3, "risky"), (4, "not_allowed")], "measure_id int, compatibility string")
    entries = spark.createDataFrame([("A", "B", 0.7, None), ("A", "C", 0.3, None)], "from_geo_id string, to_geo_id string, weight double, confidence double")
    carried, refused = crosswalk.allocate(obs, entries, rules)
    got = {(r.measure_id, r.to_geo_id): r.value for r in carried.collect()}
    assert got[1, "B"] == pytest.approx(70) and got[3, "B"] == pytest.approx(5.25) and len(got) == 4
    assert {(r.measure_id, r.reason) for r in refused.collect()} == {(2, "aggregation_type"), (4, "not_allowed")}


def test_deviations(spark):
    plan = spark.createDataFrame([(1, "2023-24", "1", "operating", Decimal(100)), (1, "2023-24", "1", "operating", Decimal(50)), (2, "2023-24", None, "statutory", Decimal(5)), (3, "2023-24", "1", "operating", Decimal(0))], "organization_id int, fiscal_year string, vote_number string, vote_type string, amount decimal(15,2)")
    spent = spark.createDataFrame([(1, "2023-24", "1", Decimal(180)), (2, "2023-24", None, Decimal(9)), (3, "2023-24", "1", Decimal(4))], "organization_id int, fiscal_year string, vote_number string, actual_expenditure decimal(15,2)")
    got = {r.organization_id: r for r in views.spending_deviations(plan, spent).collect()}
    assert got[1].variance_amount == 30 and got[1].variance_pct == 20
    assert got[2].variance_amount is None and got[3].variance_pct is None
    assert aggregates.anomalous(views.spending_deviations(plan, spent)).count() == 0


def test_measure_facts_order(spark):
    base = dict.fromkeys(["measurement_year", "value_type", "period_basis", "period_start", "observed_organization_id", "geo_boundary_id", "jurisdiction_id"])
    schema = "measure_id int, measurement_year int, value_type string, period_basis string, period_start date, observed_organization_id int, geo_boundary_id int, jurisdiction_id int, vintage_date date, approved_at timestamp, id int"
    row = lambda i, vintage, at=None, m=1: {**base, "measure_id": m, "vintage_date": vintage, "approved_at": at, "id": i}
    df = spark.createDataFrame([row(1, None), row(2, date(2024, 1, 1)), row(3, date(2024, 1, 1)), row(4, date(2023, 1, 1)), row(5, None, m=2)], schema)
    assert sorted(r.id for r in latest.measure_facts(df).collect()) == [3, 5]


def test_grant_amendments(spark):
    df = spark.createDataFrame([(1, "k", '{"amendment_number":"0"}', "published", True), (2, "k", '{"amendment_number":"1"}', "published", False), (3, "k", '{"amendment_number":"x"}', "published", None), (4, "k", '{"amendment_number":"9"}', "withdrawn", True)], "id int, canonical_key string, metadata string, state string, is_canonical boolean")
    got = {r.id: (r.is_canonical, r.changed) for r in latest.canonical_versions(df, latest.grant_order()).collect()}
    assert got == {1: (False, True), 2: (True, True), 3: (False, True)}


@pytest.fixture
def snapshots(spark):
    t = datetime(2024, 1, 1)
    old = spark.createDataFrame([(1, "a", True, t, t, t), (2, "b", True, t, t, t), (3, "c", True, t, t, t), (4, None, False, t, t, t)], "k int, v string, active boolean, created_at timestamp, updated_at timestamp, refreshed_at timestamp")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, None), (5, "n")], "k int, v string")
    return old, new


def test_merge_and_again(spark, snapshots):
    old, new = snapshots
    now, later = F.lit(datetime(2024, 2, 1)), F.lit(datetime(2024, 3, 1))
    once = merge.merge(old, new, ["k"], ["v"], now)
    got = {r.k: r for r in once.collect()}
    assert {k: r.status for k, r in got.items()} == {1: "unchanged", 2: "updated", 3: "withdrawn", 4: "updated", 5: "created"}
    assert got[1].updated_at == datetime(2024, 1, 1) and got[1].refreshed_at == datetime(2024, 2, 1) and not got[3].active and got[5].created_at == datetime(2024, 2, 1)
    again = merge.merge(once.drop("status"), new, ["k"], ["v"], later)
    assert {r.status for r in again.collect()} == {"unchanged", "kept"}
    assert max(r.updated_at for r in again.collect()) == datetime(2024, 2, 1)
    kept = merge.merge(old, new, ["k"], ["v"], now, missing="keep")
    assert {r.k: r.status for r in kept.collect()}[3] == "kept"
    with pytest.raises(ValueError):
        merge.guarded(new.where("false"))


def test_null_safe_insert(spark):
    old = spark.createDataFrame([(None, 1)], "a int, b int")
    new = spark.createDataFrame([(None, 1), (None, 2)], "a int, b int")
    assert merge.insert_ignore(old, new, ["a", "b"]).count() == 1 and merge.insert_ignore(old, new, ["a", "b"], null_safe=False).count() == 2


def test_numbers_and_newer(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k"))
    assert [r.sequence for r in merge.numbered(df, ["k"], 5).orderBy("k").collect()] == list(range(6, 106))
    a = spark.createDataFrame([(1, "old", 5)], "k int, v string, s int")
    b = spark.createDataFrame([(1, "late", 4), (2, "new", 6)], "k int, v string, s int")
    assert {(r.k, r.v) for r in merge.newer_wins(a, b, "k", "s").collect()} == {(1, "old"), (2, "new")}


def test_decisions_and_promotion(spark):
    claims = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "id int, value double")
    log = spark.createDataFrame([(1, 1, "approved", "a", datetime(2024, 1, 1)), (2, 2, "approved", "a", datetime(2024, 1, 1)), (3, 2, "rejected", "b", datetime(2024, 1, 2))], "id int, claim_id int, decision string, decided_by string, decided_at timestamp")
    state = merge.latest_decision(claims, log)
    assert {r.id: r.review_status for r in state.collect()} == {1: "approved", 2: "rejected", 3: "pending"}
    done = spark.createDataFrame([], "extracted_observation_id int")
    fresh = merge.promoted(state, done, {"value": F.col("value")})
    assert [tuple(r) for r in fresh.collect()] == [(1, 5.0)] and merge.promoted(state, fresh, {"value": F.col("value")}).count() == 0


def test_complete_groups_and_g7(spark):
    rows = [(1, 2019, date(2019, 1, 1), j, 99.0 + j) for j in range(1, 8)] + [(1, 2020, date(2020, 1, 1), j, 1.0) for j in (1, 2)]
    df = spark.createDataFrame(rows, "measure_id int, measurement_year int, period_start date, jurisdiction_id int, value_numeric double")
    assert [(r.measurement_year, r.value_numeric, r.status) for r in views.g7_rows(df, list(range(1, 8)), 100).collect()] == [(2019, 103.0, "estimated")]


def test_vector_ratio(spark):
    df = spark.createDataFrame([("2026-01-01", 1, -538133.0), ("2026-01-01", 2, 951885.0), ("2026-01-01", 3, 3321588.0), ("2025-10-01", 1, 1.0), ("2025-10-01", 2, 1.0)], "p string, v int, value double")
    got = aggregates.pivoted_ratio(df, ["p"], "v", "value", [1, 2, 3], lambda nfw, cpp, gdp: F.when(gdp != 0, -(nfw - cpp) / gdp * 100)).collect()
    assert len(got) == 1 and got[0].value == pytest.approx(44.859, abs=1e-3)


def test_admissions_total(spark):
    df = spark.createDataFrame([("Economic", "545"), ("Economic", "2300"), ("Economic", "150"), ("Family", "800"), ("Odd", "5"), ("Family", "--")], "c string, n string")
    category = F.when(F.col("c").isin("Economic", "Family"), F.col("c"))
    got = {r.category: r.value for r in aggregates.with_total(df, [], category, F.coalesce(F.col("n").try_cast("int"), F.lit(0))).collect()}
    assert got == {"Economic": 2995, "Family": 800, "total": 3800}


@pytest.mark.parametrize(("total", "parts", "expected"), [(100.0, 27.0, ("fail", "critical", -73.0)), (100.0, 95.0, ("fail", "high", -5.0)), (100.0, 99.6, ("ok", None, -0.4)), (100.0, 99.0, ("warn", "medium", -1.0)), (0.0, 0.0, ("ok", None, 0.0))])
def test_composition(spark, total, parts, expected):
    df = spark.createDataFrame([(1, None, True, total, datetime(2024, 1, 1)), (1, None, True, 5.0, datetime(2023, 1, 1)), (1, 7, False, parts, None)], "s int, component_id int, is_total boolean, value double, approved_at timestamp")
    (r,) = aggregates.composition_check(df, ["s"], F.lit(False)).collect()
    assert (r.status, r.severity) == expected[:2] and r.difference == pytest.approx(expected[2])
    kinds = {r.validation_type for r in aggregates.composition_check(df, ["s"], F.lit(True)).collect()}
    assert kinds == {"components_sum_to_total", "components_sum_to_100"}


def test_paid_split(spark):
    kind = "array<struct<dimension:string,value:double>>"
    df = spark.createDataFrame([(1, 100.0, [("AD", 10.0), ("POST", 90.0)]), (2, 0.0, []), (3, 5.0, [])], f"id int, total double, parts {kind}")
    got = sorted((r.id, str(r.paid), r.value) for r in aggregates.paid_split(df, "total", "parts").collect())
    assert got == [(1, "False", 90.0), (1, "None", 100.0), (1, "True", 10.0), (2, "False", 0.0), (2, "None", 0.0), (2, "True", 0.0), (3, "None", 5.0)]


def test_suppression(spark):
    df = spark.createDataFrame([("unweighted-sample-size", "a", 50.0), ("unweighted-sample-size", "b", 49.0), ("answer", "a", 1.0), ("answer", "b", 2.0), ("answer", "c", 3.0), ("answer", "unknown", 4.0)], "kind string, col string, value double")
    once = aggregates.suppressed(df, [], "col")
    assert {(r.col, r.value) for r in once.where("kind = 'answer'").collect()} == {("a", 1.0), ("b", None), ("c", None)}
    assert sorted(map(str, aggregates.suppressed(once.drop("suppressed"), [], "col").collect())) == sorted(map(str, once.collect()))


def test_review_queue(spark):
    claims = spark.createDataFrame([(1, "pending", False), (2, "pending", True), (3, "pending", False), (4, "approved", True), (5, "pending", False)], "id int, review_status string, needs_review boolean")
    flags = spark.createDataFrame([(3, 1, "critical", None), (3, 2, "low", None), (5, 3, "high", datetime(2024, 1, 1))], "claim_id int, flag_id int, severity string, resolved_at timestamp")
    got = {r.id: r for r in aggregates.review_queue(claims, flags).collect()}
    assert set(got) == {2, 3, 5}
    assert (got[3].open_flag_count, got[3].highest_open_severity, got[3].highest_open_severity_rank) == (2, "critical", 4)
    assert got[2].has_open_flags and got[2].open_flag_count == 0 and got[5].open_flag_count == 0 and not got[5].has_open_flags
    assert not {r.id: r for r in aggregates.review_queue(claims, flags, compat=False).collect()}[2].has_open_flags


def test_densify_and_ranges(spark):
    df = spark.createDataFrame([("a", date(2024, 1, 1), 5), ("a", date(2024, 1, 4), 7)], "k string, d date, n int")
    full = calendar.densify(df, ["k"], "d", ["n"])
    assert [r.n for r in full.orderBy("d").collect()] == [5, 0, 0, 7]
    assert calendar.incomplete(df, ["k"], "d", F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 4))).count() == 1
    assert calendar.incomplete(full, ["k"], "d", F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 4))).count() == 0
    spans = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 10))], "a date, b date")
    assert [(r.window_start.day, r.window_end.day) for r in calendar.split_range(spans, "a", "b", 4).collect()] == [(1, 4), (5, 8), (9, 10)]


def test_intervals(spark):
    parts = spark.createDataFrame([("r", 0.0, 60.0), ("r", 70.0, 130.0)], "k string, start double, end double")
    span = spark.createDataFrame([("r", -10.0, 130.0)], "k string, span_start double, span_end double")
    assert sorted((r.gap_start, r.gap_end) for r in intervals.gaps(parts, ["k"], "start", "end", span).collect()) == [(-10.0, 0.0), (60.0, 70.0)]
    assert intervals.overlapping_parts(parts.union(spark.createDataFrame([("r", 59.0, 65.0)], parts.schema)), ["k"], "start", "end").count() == 1
    inner = parts.union(spark.createDataFrame([("r", 5.0, 6.0)], parts.schema))
    assert [(r.gap_start, r.gap_end) for r in intervals.coverage_gaps(inner, ["k"], "start", "end").collect()] == [(60.0, 70.0)]
    windows = spark.createDataFrame([("r", 0.0, 60.0), ("r", 50.0, 80.0), ("r", 70.2, 130.0)], "k string, window_start double, window_end double")
    assert [r.covered for r in intervals.covered(windows, parts, ["k"], 30).orderBy("window_start").collect()] == [True, False, True]
    cut = intervals.clip(parts, F.lit(50.0), F.lit(75.0))
    assert sorted((r.start, r.end) for r in cut.collect()) == [(0.0, 10.0), (20.0, 25.0)]


def test_overlaps_are_half_open_and_whole(spark):
    a = [(i, float(i * 7 % 50), float(i * 7 % 50 + i % 9)) for i in range(60)]
    b = [(i, float(i * 11 % 50), float(i * 11 % 50 + i % 13)) for i in range(60)]
    want = sorted((i, j) for i, s, e in a for j, bs, be in b if s < be and e > bs and s < e and bs < be)
    got = intervals.overlap_join(spark.createDataFrame(a, "i int, start double, end double"), spark.createDataFrame(b, "j int, b_start double, b_end double"), 5)
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_caption_passages(spark):
    cues = [("t", 0, 0.0, "The chair calls"), ("t", 1, 5.0, "The chair calls\nthe meeting to order."), ("t", 2, 10.0, "the meeting to order.\nWelcome everyone."), ("t", 3, 35.0, "The chair calls")]
    df = spark.createDataFrame(cues, "track string, cue int, start double, text string")
    got = [(r.start_seconds, r.end_seconds, r.text) for r in intervals.passages(df, "track", "start", "text", F.lit(60.0)).orderBy("start_seconds").collect()]
    assert got == [(0.0, 30.0, "The chair calls the meeting to order. Welcome everyone."), (30.0, 60.0, "The chair calls")]


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    kind = "array<array<struct<x:double,y:double>>>"
    shapes = spark.createDataFrame([("donut", [ring, hole])], f"name string, rings {kind}")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 4.0, 2.0), (4, 9.0, 9.0)], "id int, x double, y double")
    assert [r.id for r in geometry.locate(points, shapes, 1.5).collect()] == [1]
    assert sorted(r.id for r in geometry.locate(points, shapes, 1.5, edge_counts=True).collect()) == [1, 3]
    c = shapes.select(geometry.centroid(F.element_at("rings", 1)).alias("c")).first()["c"]
    assert (c.x, c.y) == (2.0, 2.0)


def test_names(spark):
    aliases = spark.createDataFrame([("Health Canada", 1), ("Statistics Canada's Office", 2)], "alias_name string, entity_id int")
    names = spark.createDataFrame([("Health Canada",), ("HEALTH CANADA",), ("Statistics Canada’s Office",), ("Helth Canada",)], "name string")
    got = {r.name: (r.entity_id, r.confidence, r.method) for r in resolve.resolve_names(names, aliases).collect()}
    assert got["Health Canada"] == (1, 1.0, "exact") and got["HEALTH CANADA"] == (1, 0.99, "case") and got["Statistics Canada’s Office"] == (2, 0.95, "encoding")
    assert got["Helth Canada"] == (None, None, None)
    entities = spark.createDataFrame([(1, "Health Canada"), (2, "Transport Canada"), (3, "Xyz")], "entity_id int, canonical_name string")
    found = resolve.similar(names.where("name = 'Helth Canada'"), entities)
    assert [r.entity_id for r in found.orderBy("rank").collect()] == [1, 2]
    (d,) = resolve.judged(found).collect()
    assert d.entity_id == 1 and d.transformation_type == "fuzzy" and not d.keep_alias
    (d,) = resolve.judged(found, judge=F.lit(0.05)).collect()
    assert d.entity_id is None and d.transformation_type == "auto_created_for_review"
    assert resolve.lineage(resolve.judged(found), "name", F.lit(datetime(2024, 1, 1))).count() == 1


def test_domains_and_cascade(spark):
    rows = spark.createDataFrame([(1, "www.cbc.ca"), (2, "notcbc.ca"), (3, "news.bbc.co.uk")], "id int, host string")
    feeds = spark.createDataFrame([("cbc.ca",), ("bbc.co.uk",), ("news.bbc.co.uk",)], "domain string")
    assert {r.id: r.domain for r in joins.by_domain(rows, "host", feeds).collect()} == {1: "cbc.ca", 2: None, 3: "news.bbc.co.uk"}
    table = lambda *r: spark.createDataFrame(list(r), "key string, id int")
    got = joins.cascade(rows, [(F.col("host"), table(("www.cbc.ca", 9)), "id", "alias"), (F.upper("host"), table(("NOTCBC.CA", 8), ("WWW.CBC.CA", 7)), "id", "name")])
    assert {r.host: (r.resolved_id, r.resolved_by) for r in got.collect()} == {"www.cbc.ca": (9, "alias"), "notcbc.ca": (8, "name"), "news.bbc.co.uk": (None, None)}
    d = joins.name_dictionary(spark.createDataFrame([("Ottawa", 1)], "name string, id int"), spark.createDataFrame([("OTTAWA", 2)], "name string, id int"))
    assert joins.look_up(rows.select(F.lit("ottawa").alias("n")).limit(1), "n", d).first().resolved_id == 2


def test_observation_names(spark):
    df = spark.createDataFrame([("linkedin", "impressions"), ("tiktok", "views"), ("x", "reach"), ("x", "ctr"), ("x", "spend")], "p string, m string")
    got = [(r.n, r.u) for r in df.select(metrics.metric_name(F.col("p"), F.col("m")).alias("n"), metrics.metric_unit(F.col("m")).alias("u")).collect()]
    assert got == [("content_views", "count"), ("content_views", "count"), ("content_reach", "count"), ("ctr", "ratio"), ("spend", "currency")]


def test_text_functions(spark):
    one = lambda c, v, kind="string": spark.createDataFrame([(v,)], f"v {kind}").select(c(F.col("v")).alias("r")).first().r
    assert one(text.amount, "($1,234.50)") == Decimal("-1234.50") and one(text.amount, " - ") is None and one(text.amount, "CA$ 7") == 7
    assert one(text.clean, " <b>a</b>\n  b ") == "a b" and one(text.clean, "<p> </p>") is None
    assert one(text.year_in, "FY 2019-20") == 2019 and one(text.whole_number, "1,234") == 1234 and one(text.whole_number, "12x") is None
    assert one(text.postal_code, "k1a-0b1") == "K1A 0B1" and one(text.postal_code, "K1A 0B") is None
    assert one(text.postal_province, "X0A 1A1") == "NU" and one(text.postal_province, "M5V") == "ON"
    assert one(text.province_code, "Ontario") == "ON" and one(text.province_code, "on") == "ON" and one(text.country_code, "Canada") == "CA"
    assert one(text.english, "Health | Santé") == "Health" and one(text.without_parenthetical, "Rate (per 1000)") == "Rate"
    assert one(text.ward_number, "toronto-ward-08") == 8 and one(text.vote_type, "10") == "grants_and_contributions" and one(text.vote_type, None) == "operating"
    assert one(lambda c: text.slug(text.nfkc(c)), "Ｆire & Rescue!") == "fire-rescue"
    assert one(text.canonical_url, "HTTP://Example.COM:80//a//b?z=1&a=2#f") == "http://example.com/a/b?a=2&z=1"
    cut = one(lambda c: text.truncate_middle(c, 80), "A" + "m" * 198 + "Z")
    assert len(cut) == 80 and cut[0] == "A" and cut[-1] == "Z"
    assert one(text.seconds_of, "01:02:03.500") == 3723.5 and one(lambda c: text.clock_of(text.seconds_of(c)), "02:03.500") == "00:02:03.500"
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(text.trigram_similarity(F.col("a"), F.col("b")).alias("r")).first().r
    assert pair("ab", "ab") == 1 and pair("ab", "abc") == 0 and pair("abcd", "abce") == pytest.approx(1 / 3)


def test_dates(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first().r
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(dates.fiscal_year(F.lit("2024-03-31").cast("date"))) == 2023 and one(dates.fiscal_label(F.lit(2023))) == "2023-2024"
    p = one(dates.period(F.lit("monthly"), F.lit(None), F.lit("2025-12-01")))
    assert (p.period_end, p.measurement_year, p.period_type) == (date(2025, 12, 31), 2025, "month")
    assert one(dates.period(F.lit("monthly"), F.lit("2025"), F.lit("nonsense"))) is None
    assert one(dates.period(F.lit("annual"), F.lit("2025"), F.lit(None))).period_end == date(2025, 12, 31)
    assert one(dates.next_checkpoint(ts("2024-01-01"), ts("2024-01-05"))) == datetime(2024, 1, 6)
    assert one(dates.next_checkpoint(ts("2024-01-01"), ts("2024-02-05"))) == datetime(2024, 2, 7)
    assert one(dates.next_checkpoint(ts("2020-01-01"), ts("2024-02-05"))) is None
    assert one(dates.valid_on(F.lit(None).cast("date"), F.lit("2024-01-01").cast("date"), F.lit("2024-01-01").cast("date")))
    assert one(dates.compact_date(F.lit("202403"))) == date(2024, 3, 1) and one(dates.any_date(F.lit("03/31/2024"), "yyyy-MM-dd", "MM/dd/yyyy")) == date(2024, 3, 31)


def test_definitions():
    c = filters.Contract("media", {"lang": "string", "tags": "array", "n": "number"})
    good = {"version": 1, "realm": "media", "filters": {"all": [{"field": "lang", "op": "eq", "value": "en"}]}}
    assert filters.errors_of(good, c) == []
    assert filters.errors_of({**good, "x": 1, "version": 2}, c) == ["contains unknown keys: x", "version must be 1"]
    assert "operator gt is not allowed for lang" in filters.errors_of({**good, "filters": {"field": "lang", "op": "gt", "value": 1}}, c)
    deep = {"field": "lang", "op": "eq", "value": 1}
    for _ in range(5):
        deep = {"not": deep}
    assert "filter nesting is too deep" in filters.errors_of({**good, "filters": deep}, c)
    assert "text is required for ranked modes" in filters.errors_of({**good, "mode": "lexical"}, c)
    assert "semantic_max_distance must be numeric" in filters.errors_of({**good, "mode": "hybrid", "text": "x"}, c)
    assert "filter group cannot be empty" in filters.errors_of({**good, "filters": {"any": []}}, c)
    with pytest.raises(filters.InvalidDefinition):
        filters.compiled({}, c, datetime(2024, 1, 1))


def test_filters_on_arrays(spark):
    c = filters.Contract("media", {"tags": "array", "at": "datetime"})
    df = spark.createDataFrame([(1, ["a", "b"], "media", "public", 5), (2, ["b"], "media", "public", 6), (3, ["a", "b"], "media", "private", 7)], "id int, tags array<string>, realm string, visibility string, index_sequence long")
    run = lambda f, **k: [r.id for r in df.where(filters.compiled({"version": 1, "realm": "media", "filters": f}, c, datetime(2024, 1, 1), **k)).collect()]
    assert run({"field": "tags", "op": "contains_all", "value": ["a", "b"]}) == [1]
    assert run({"field": "tags", "op": "contains_any", "value": ["b"]}) == [1, 2] and run({"field": "tags", "op": "contains_any", "value": ["b"]}, from_sequence=5, to_sequence=6) == [2]


def test_search(spark):
    docs = spark.createDataFrame([(1, "energy policy energy", [1.0, 0.0], 1), (2, "energy policy and more words", [0.0, 1.0], 2), (3, "nothing", [1.0, 0.1], 3)], "id int, content_en string, embedding array<double>, index_sequence int")
    assert [r.id for r in search.bm25(docs, "ENERGY policy", "id", "content_en", limit=9).collect()] == [1, 2]
    assert [r.id for r in search.nearest(docs, [1.0, 0.0], "id", "embedding", 2, 0.001).collect()] == [1]
    got = search.hybrid(docs, "energy", [1.0, 0.0], "id", "content_en", "embedding", 0.5, 10)
    assert [r.id for r in got.collect()] == [1, 2, 3]
    parts = spark.createDataFrame([("Clean ENERGY powers clean industry.",)], "t string").select(search.highlighted(F.col("t"), ["energy", "industry"]).alias("p")).first().p
    assert "".join(p.text for p in parts) == "Clean ENERGY powers clean industry." and [p.text for p in parts if p.match] == ["ENERGY", "industry"]


def test_transcripts(spark):
    tracks = spark.createDataFrame([(1, "captions", "fr", 1), (2, "captions", "en", 1)], "id int, kind string, language string, media_stream_id int")
    rows = [(1, 1, "Le comite parle de logement abordable.", "published", 20, 30), (2, 2, "Affordable housing", "published", 20, 30), (3, 1, "Le comité parle de logement", "withdrawn", 20, 30), (4, 1, "Le comité parle de logements", "published", 180, 190)]
    df = spark.createDataFrame(rows, "id int, media_track_id int, text string, state string, starts_at int, ends_at int")
    query = {"and": ["comité parle", "logement"]}
    assert [r.id for r in search.transcripts(df, tracks, query, language="fr", ends_at=100).collect()] == [1]
    assert sorted(r.id for r in search.transcripts(df, tracks, "logement*").collect()) == [1, 4]
    assert sorted(r.id for r in search.transcripts(df, tracks, {"and": ["logement*", {"not": "abordable"}]}).collect()) == [4]


def test_top_and_pages(spark):
    df = spark.range(30).select("id", (F.col("id") % 3).alias("g"))
    assert [r.id for r in topk.page(df, [F.desc("id")], 2, 5).collect()] == [24, 23, 22, 21, 20]
    assert topk.top_per_group(df, ["g"], [F.desc("id")], 2).count() == 6
    assert [r.id for r in topk.merged_top([df.select("id"), df.select((F.col("id") + 100).alias("id"))], [F.desc("id")], 2).collect()] == [129, 128]
