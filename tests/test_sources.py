"""Readers and checks on files made here."""

import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from millrace.sources import captions, checks, files


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿"fy","org"\r\n"2023-24","A, ""quoted"""\r\n'.encode())
    df = files.read_csv(spark, str(p))
    assert df.columns == ["fy", "org"] and df.first().org == 'A, "quoted"'
    t = tmp_path / "b.txt"
    t.write_text("x\ty\n1\t2\n")
    assert files.read_sniffed(spark, str(t)).columns == ["x", "y"]
    assert files.sniffed_encoding("é".encode("cp1252") + b" and more text") == "windows-1252" and files.sniffed_encoding("é".encode()) == "UTF-8" and files.sniffed_encoding(b"\xff\xfea\0") == "UTF-16LE"


def test_ndjson_and_vectors(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    fine, bad = files.read_ndjson(spark, str(p), "id int")
    assert fine.count() == 2 and [r.line for r in bad.collect()] == ["broken"]
    kind = "status string, object struct<vectorId:bigint, vectorDataPoint:array<struct<refPer:string,value:double>>>"
    df = spark.createDataFrame([("SUCCESS", (7, [("2026-01-01", 1.5)]))], kind)
    assert [tuple(r) for r in files.vectors(df).collect()] == [(7, "2026-01-01", 1.5)]
    with pytest.raises(Exception, match="series failed"):
        files.vectors(spark.createDataFrame([("FAILED", (7, []))], kind)).collect()


def test_zip_xml_html_feed(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x_metadata.csv", "no")
        z.writestr("x.csv", "a,b\n1,2\n")
    assert [r.line for r in files.unzipped(spark, str(tmp_path / "*.zip")).orderBy("line_no").collect()] == ["a,b", "1,2"]
    (tmp_path / "a.xml").write_text("<all><project><id>1</id><title>T</title></project></all>")
    assert [tuple(r) for r in files.read_xml(spark, str(tmp_path / "a.xml"), "project", "id int, title string").collect()] == [(1, "T")]
    pages = spark.createDataFrame([(1, "<html><title>T</title><script>no</script><p id='amt'>5 <b>000</b></p><br></html>"), (2, None)], "page_id int, html string")
    got = {r.page_id: r for r in files.page_text(pages, ids=("amt",)).collect()}
    assert (got[1].title, got[1].text, got[1].fields) == ("T", "T 5 000", {"amt": "5 000"}) and got[2].text == ""
    feed = "<rss><item><title>A</title><link>http://a</link></item><item><title><![CDATA[B]]></title><guid>g</guid>"
    got = files.feed_entries(spark.createDataFrame([(1, feed)], "id int, body string")).collect()
    assert [(r.title, r.guid) for r in got] == [("A", "http://a"), ("B", "g")]


def test_estimates(spark):
    assert files.estimate_columns(["Org", "2023-24 Expenditures", "2024-25 Main Estimates", "2024-25 Supplementary Estimates (B)"]) == {
        "2023-24 Expenditures": ("2023-24", "expenditures"), "2024-25 Main Estimates": ("2024-25", "main"), "2024-25 Supplementary Estimates (B)": ("2024-25", "supp_b"),
    }
    df = spark.createDataFrame([("A", "5", "(7)", "-")], ["Org", "2023-24 Expenditures", "2024-25 Main Estimates", "2025-26 Main Estimates"])
    assert [(r.fiscal_year, r.document_type, float(r.amount)) for r in files.estimates_long(df, ["Org"]).collect()] == [("2024-25", "main", -7.0)]


def test_fresh_payloads(spark):
    bodies = spark.createDataFrame([(1, "a"), (1, "b")], "source_id int, body string")
    log = bodies.where("body = 'a'").select("source_id", F.sha2(F.col("body").cast("binary"), 256).alias("checksum"), F.lit("done").alias("status"))
    assert [r.body for r in files.fresh_payloads(bodies, log).collect()] == ["b"]
    assert files.fresh_payloads(bodies, log.withColumn("status", F.lit("failed"))).count() == 2


VTT = """WEBVTT

NOTE a remark
over two lines

one
00:00.000 --> 00:05.000 align:left

The chair calls

00:00:05.000 --> 00:00:10.000
The chair calls
the meeting to order.

00:00:12.000 --> 00:00:11.000
backwards
"""


def test_captions(spark):
    got = captions.cues(spark.createDataFrame([(1, VTT)], "track int, body string")).orderBy("cue").collect()
    assert [(r.start_seconds, r.end_seconds, r.text, r.identifier, r.settings) for r in got] == [(0.0, 5.0, "The chair calls", "one", "align:left"), (5.0, 10.0, "The chair calls\nthe meeting to order.", None, "")]
    again = captions.rendered(captions.cues(spark.createDataFrame([(1, VTT)], "track int, body string")), ["track"]).first().body
    assert captions.cues_of(again)[1][2] == got[1].text
    with pytest.raises(ValueError):
        captions.cues_of("no")


def test_playlists(spark):
    text = "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:5\n#EXT-X-PROGRAM-DATE-TIME:2024-01-01T00:00:00Z\n#EXTINF:4.0,\na.ts\n#EXTINF:4.0,\nb.ts\n"
    got = captions.segments(spark.createDataFrame([(1, text)], "stream int, body string")).orderBy("sequence").collect()
    assert [(r.sequence, r.uri, r.starts_at) for r in got] == [(5, "a.ts", datetime(2024, 1, 1)), (6, "b.ts", datetime(2024, 1, 1, 0, 0, 4))]
    with pytest.raises(ValueError):
        captions.segments_of("#EXTM3U\n#EXTINF:4.0,\na.ts\n")
    assert captions.segments_of("#EXTM3U\n#EXTINF:4.0,\na.ts\n#EXT-X-ENDLIST", datetime(2024, 1, 1, tzinfo=timezone.utc))


def test_checks(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("b", "y", 3), (None, "z", 4)], "id string, v string, line int")
    got = [r.stable_id for r in checks.stable_ids(df, F.col("id"), "line", ["id", "v"]).orderBy("line").collect()]
    assert got[0] == "a" and got[1].startswith("b-") and got[2] == f"{got[1]}-2" and len(got[3]) == 16
    pages = spark.createDataFrame([(1, 0, 3, 1), (1, 1, 3, 2), (2, 0, 3, 2)], "page int, position int, total int, id int")
    assert {r.fault for r in checks.page_faults(pages).collect()} == {"disorder"}
    many = spark.range(0, 3000, 1, 7).select(F.floor(F.col("id") / 100).cast("int").alias("page"), (F.col("id") % 100).cast("int").alias("position"), F.lit(3000).alias("total"), F.col("id").alias("id"))
    assert checks.page_faults(many).count() == 0
    swapped = many.withColumn("id", F.when(F.col("id") == 1500, 1600).otherwise(F.col("id")))
    assert [(r.fault, r.n) for r in checks.page_faults(swapped).collect()] == [("disorder", 1)]
    assert [(r.fault, r.n) for r in checks.page_faults(many.where("id <> 7")).collect()] == [("count", 1)]
    with pytest.raises(Exception, match="line 2"):
        checks.require_numeric(df.withColumn("id", F.when(F.col("line") == 2, "x").otherwise("1")), "id", "line").collect()
    roster = spark.createDataFrame([([("M", None)], [(1, [("C", "active")])], [("TDSB", [(2, [("T", None)])])], ["C"])],
        "mayor array<struct<name:string,status:string>>, wards array<struct<ward:int,candidates:array<struct<name:string,status:string>>>>, boards array<struct<board:string,wards:array<struct<ward:int,candidates:array<struct<name:string,status:string>>>>>>, withdrawn array<string>")
    assert {(r.office, r.district, r.name, r.status) for r in checks.roster(roster).collect()} == {("mayor", None, "M", "active"), ("councillor", "1", "C", "withdrawn"), ("trustee", "TDSB 2", "T", "active")}
    money = spark.createDataFrame([("p", "D", 5.0, "CAD"), ("p", "D", 6.0, "CAD"), ("p", "C", 9.0, "USD")], "id string, type string, value double, currency string")
    assert checks.sum_in_one_currency(money, "id", "D").first().amount == 11.0
    with pytest.raises(Exception, match="several currencies"):
        checks.sum_in_one_currency(money.withColumn("type", F.lit("D")), "id", "D").collect()
    assert checks.plain_header("Année d’élection ") == "anneedelection"
