"""Documents, residency, sinks, digests and the rest of the functions, by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import merge, metrics, residency
from millrace.plans import documents
from millrace.sources import checks, sinks
from millrace.streaming import standing


def test_documents(spark):
    awards = spark.createDataFrame(
        [(1, "contract", "published", True, "T", "Dept", "Acme", None, "d", 5.0, 2024, "https://A.ca/x", None, datetime(2024, 1, 1), datetime(2024, 1, 2), "en", "CAD", False, "ON", None),
         (2, "gift", "published", True, None, "Dept", None, None, None, None, None, None, None, datetime(2024, 1, 1), datetime(2024, 1, 2), "fr", None, False, None, None)],
        "id int, award_type string, state string, is_canonical boolean, title string, payer_name string, recipient_name string, program_name string, description string, amount double, fiscal_year int, source_url string, occurred_at timestamp, first_seen_at timestamp, last_seen_at timestamp, language string, currency string, is_aggregated boolean, province_code string, country_code string",
    )
    docs = documents.with_errors(documents.award_documents(awards), documents.AWARDS)
    got = {r.id: r for r in docs.collect()}
    one = got["award:1"]
    assert one.errors == [] and one.content == "Dept — Acme — d — 5.0 — 2024" and one.title_en == "T" and one.title_fr is None and one.source_domain == "a.ca" and one.province_codes == ["ON"] and one.country_codes == []
    assert got["award:2"].errors == ["record_type is not supported", "title is required for publication"]
    again = {r.id: r.content_hash for r in documents.award_documents(awards.withColumn("is_canonical", F.lit(False))).collect()}
    assert again["award:1"] == one.content_hash
    measures = spark.createDataFrame([(1, "Rate", "x", "health", None, "annual", "%")], "id int, canonical_name string, description string, category string, slug string, frequency string, unit_symbol string")
    made = documents.measure_documents(measures)
    assert documents.with_errors(made, documents.MEASURES).first().errors == ["kpi_measure_slug is required"]
    articles = spark.createDataFrame([(1, "T", "s", "deux mots l'été", "fr-CA", "Live-Blog", "http://x.ca", datetime(2024, 1, 1), "P", ["a", "a", None], 0)], "id int, title string, summary string, content string, language string, content_type string, url string, published_at timestamp, publisher_name string, authors array<string>, word_count int")
    a = documents.with_errors(documents.article_documents(articles), documents.ARTICLES).first()
    assert (a.record_type, a.language, a.word_count, a.authors, a.errors, a.content_fr) == ("live_blog", "fr", 3, ["a"], [], "deux mots l'été")
    assert documents.united([documents.award_documents(awards), made]).count() == 3


def test_residency(spark):
    rules = spark.createDataFrame([("toronto", "ON", "^M", ["M0R"], True, ["Toronto", "York"], True), ("brampton", "ON", None, None, False, ["Brampton"], True), ("nowhere", "ZZ", None, None, False, ["X"], False)], "city string, province string, prefix string, exceptions array<string>, prefix_decides boolean, cities array<string>, has_boundary boolean")
    postal = spark.createDataFrame([("L6T 1A1", "BRAMPTON", "ON"), ("L6T 1A2", "CALEDON", "ON"), ("M0R 1A1", "TORONTO", "ON"), ("L6T 1A3", "CALEDON", "ON")], "postal_code string, city_name string, province_code string")
    inside = spark.createDataFrame([("brampton", "L6T 1A3")], "city string, postal_code string")
    asks = [("toronto", "m5v1a1", True, "fsa_match"), ("toronto", "M0R 1A1", False, "outside_boundary"), ("toronto", "x", False, "malformed_postal_code"), ("toronto", " ", True, "no_postal_code"),
            ("ottawa", "K1A0B1", True, "no_rule"), ("brampton", "L6T1A1", True, "city_match"), ("brampton", "L6T1A2", False, "outside_boundary"), ("brampton", "L6T1A3", True, "inside_boundary"),
            ("brampton", "L9Z9Z9", False, "unknown_postal_code"), ("nowhere", "L9Z9Z9", True, "postal_data_unavailable"), ("nowhere", "L6T1A1", False, "city_mismatch")]
    got = residency.eligible(spark.createDataFrame([a[:2] for a in asks], "city string, postal_code string"), rules, postal, inside)
    assert sorted((r.city, r.postal_code, r.eligible, r.reason) for r in got.collect()) == sorted(asks)
    assert {a[3] for a in asks} == set(residency.REASONS)
    found = spark.createDataFrame([("L6T 1A1", 7)], "postal_code string, boundary_id int")
    codes = spark.createDataFrame([("L6T1A1",), ("L6T1A2",), ("Z",), ("K1A0B1",)], "postal_code string")
    assert {r.postal_code: r.reason for r in residency.ward_lookup(codes, postal, found, True).collect()} == {"L6T1A1": "found", "L6T1A2": "outside_boundary", "Z": "malformed_postal_code", "K1A0B1": "unknown_postal_code"}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark.range(3), path)
    sinks.replace(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2] and [p.name for p in tmp_path.iterdir()] == ["t"]
    sinks.write_csv(spark.range(1), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id"]
    rows = spark.createDataFrame([(1, datetime(2024, 1, 2)), (2, datetime(2024, 1, 1)), (3, datetime(2023, 1, 1))], "id int, updated_at timestamp")
    assert [r.id for r in sinks.changed_since(rows, F.lit(datetime(2023, 6, 1))).collect()] == [2, 1]


def test_digests_and_slices(spark):
    found = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "saved_search string, id int")
    subs = spark.createDataFrame([("a", 60), ("b", None)], "saved_search string, digest_interval_seconds int")
    got = {r.saved_search: r for r in standing.digests(found, subs, F.lit(datetime(2024, 1, 1))).collect()}
    assert got["a"].n == 2 and got["a"].scheduled_for == datetime(2024, 1, 1, 1) and got["b"].scheduled_for == datetime(2024, 1, 1, 1)
    docs = spark.range(10_001, 30_001).select(F.col("id").alias("index_sequence"))
    parts = sorted(tuple(r) for r in standing.sequence_slices(docs, 10_000, 30_000, 500).collect())
    assert sum(n for *_, n in parts) == 20_000 and parts[0][0] == 10_000 and parts[-1][1] == 30_000 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and max(n for *_, n in parts) <= 1000


def test_slices_hold_no_more_than_they_may(spark):
    ids = [*range(1, 2001), 10**12, *([2500] * 7)]
    docs = spark.createDataFrame([(i,) for i in ids], "index_sequence long")
    parts = sorted(tuple(r) for r in standing.sequence_slices(docs, 0, 10**12, 50).collect())
    assert sum(n for *_, n in parts) == len(ids) and max(n for *_, n in parts) <= 50
    assert all(sum(a < i <= b for i in ids) == n for a, b, n in parts) and all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
    with pytest.raises(ValueError):
        standing.sequence_slices(docs, 0, 3000, 6)
    assert standing.sequence_slices(docs, 5000, 6000).collect() == []


def test_ties_of_newer_rows(spark):
    old = spark.createDataFrame([(1, 5, "b"), (2, 7, "a")], "k int, seq int, v string")
    new = spark.createDataFrame([(1, 5, "a"), (2, 6, "z"), (3, 1, "x"), (3, 1, "y")], "k int, seq int, v string")
    assert sorted(map(tuple, merge.newer_wins(old, new, "k", "seq").collect())) == [(1, 5, "a"), (2, 7, "a"), (3, 1, "y")]


def test_ids_of_rows_without_one(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else str(i // 4), "x" if i % 2 else "y") for i in range(24)], "line int, id string, v string")
    got = {r.line: r.stable_id for r in checks.stable_ids(rows, F.col("id"), "line", ["id", "v"]).collect()}
    assert len(set(got.values())) == 24 and {k for k, v in got.items() if "-" not in v and len(v) < 16} == {k for k in range(24) if k % 3 and sum(j % 3 > 0 and j // 4 == k // 4 for j in range(24)) == 1}


def test_snapshots(spark):
    rows = spark.createDataFrame([(1, "p", "views", 5.0, datetime(2024, 1, 2)), (2, "p", "views", 9.0, datetime(2024, 1, 3)), (3, "p", "odd", 1.0, datetime(2024, 1, 3)), (4, "p", "reach", None, datetime(2024, 1, 3))], "record_id int, post string, insight string, value double, observed_at timestamp")
    parents = spark.createDataFrame([("p", "tiktok", "k", "content:tiktok:p", datetime(2024, 1, 1))], "post string, platform string, account_key string, entity_id string, published_at timestamp")
    names = spark.createDataFrame([("views", "content_views"), ("reach", "content_reach")], "insight string, metric_name string")
    got = sorted((r.value, r.current_value, r.period_start) for r in metrics.snapshots(rows, parents, "post", names, "meta_api", "content_snapshot", F.lit(False), True).collect())
    assert got == [(5.0, False, datetime(2024, 1, 1)), (9.0, True, datetime(2024, 1, 1))]
    daily = metrics.snapshots(rows, parents, "post", names, "meta_api", "account_day", F.lit(True), False)
    assert {r.period_start for r in daily.collect()} == {datetime(2024, 1, 1), datetime(2024, 1, 2)} and metrics.counted_transitions(spark.createDataFrame([(1, "approved"), (1, "draft")], "memo int, state string"), "memo").first().n == 1


def test_more_text(spark):
    one = lambda c, v, kind="string": spark.createDataFrame([(v,)], f"v {kind}").select(c(F.col("v")).alias("r")).first().r
    assert one(text.generic_procurement_id, "N/A") and one(text.generic_procurement_id, None) and one(text.generic_procurement_id, "Acquisition-Card 12") and not one(text.generic_procurement_id, "W123")
    assert one(text.province_of_organization, "University of X, British Columbia") == "BC" and one(text.province_of_organization, "X") is None
    pay = lambda r, t, a: spark.createDataFrame([(r, t, a)], "r string, t double, a double").select(text.payment_amount(F.col("r"), F.col("t"), F.col("a")).alias("x")).first().x
    assert pay(None, 0.0, 7.0) == 7 and pay("Acme", 5.0, 0.0) == 5 and pay("Payments under $100", 3.0, 9.0) == 3 and pay("Acme", 5.0, 9.0) == 9
    assert one(text.display_labels, [("A", None, 40), (None, "", None), (None, "B", None)], "array<struct<name:string,code:string,percentage:int>>") == ["A 40%", "B"]
    assert one(text.language_code, "FR_ca") == "fr" and one(text.language_code, "de") == "und"


def test_expenditure_documents(spark):
    common = "organization_id int, organization_name string, jurisdiction_id int, jurisdiction_code string, jurisdiction_level string, default_currency string, created_at timestamp, updated_at timestamp"
    own = (7, "Dept", 3, "ca", "federal", "CAD", datetime(2024, 1, 1), datetime(2024, 1, 2))
    votes = spark.createDataFrame([(1, "grants_contributions", "5", None, None, 9.0, "2023-24", *own)], f"id int, vote_type string, vote_number string, description string, actual_expenditure double, pa_voted_ceiling double, fiscal_year string, {common}")
    r = documents.with_errors(documents.fiscal_expenditure_documents(votes), documents.EXPENDITURES).first()
    assert (r.id, r.title, r.content, r.fiscal_year, r.amount, r.dataset_key, r.errors) == ("fiscal-expenditure:1", "Dept Grants contributions expenditure", "Dept — grants_contributions — 5 — 9.0 — 2023-24", 2023, 9.0, "fiscal_expenditures", [])
    objects = spark.createDataFrame([(2, "Personnel", 4.0, "n/a", *own)], f"id int, standard_object string, amount double, fiscal_year string, {common}")
    r = documents.with_errors(documents.standard_object_documents(objects), documents.EXPENDITURES).first()
    assert (r.id, r.title, r.summary, r.fiscal_year, r.payer_names, r.jurisdiction_levels, r.errors) == ("standard-object-expenditure:2", "Dept — Personnel", "n/a standard-object expenditure", None, ["Dept"], ["federal"], [])


def test_playlists(spark):
    from millrace.operators.intervals import playlists

    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    parts = spark.createDataFrame([(1, 1, t(2), t(10), "a"), (1, 2, t(9.98), t(20), "b"), (1, 3, t(25), t(30), "c"), (2, 4, t(0), t(9), "d"), (2, 5, t(5), t(12), "e")], "recording_id int, id int, starts_at timestamp, ends_at timestamp, url string")
    spans = spark.createDataFrame([(1, t(0), t(33)), (2, t(0), t(12)), (3, t(0), t(1))], "recording_id int, starts_at timestamp, ends_at timestamp")
    got = {r.recording_id: r for r in playlists(parts, spans, "gap").collect()}
    assert set(got) == {1, 2} and got[2].playlist is None and got[2].error == "overlapping parts"
    assert [x for x in got[1].playlist.split("\n") if "DATE-TIME" not in x] == [
        "#EXTM3U", "#EXT-X-VERSION:6", "#EXT-X-TARGETDURATION:11", "#EXT-X-MEDIA-SEQUENCE:0", "#EXT-X-PLAYLIST-TYPE:VOD",
        "#EXT-X-GAP", "#EXTINF:2.000000,", "gap", "#EXT-X-DISCONTINUITY", "#EXTINF:7.980000,", "a", "#EXT-X-DISCONTINUITY", "#EXTINF:10.020000,", "b",
        "#EXT-X-GAP", "#EXTINF:5.000000,", "gap", "#EXT-X-DISCONTINUITY", "#EXTINF:5.000000,", "c", "#EXT-X-GAP", "#EXTINF:3.000000,", "gap", "#EXT-X-ENDLIST", "",
    ]
    assert "#EXT-X-PROGRAM-DATE-TIME:2024-01-01T00:00:09.980000Z" in got[1].playlist
