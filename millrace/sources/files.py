"""Delimited, JSON, XML, zipped and markup sources, read by Spark.

Text formats go through Spark's own readers with explicit schemas. Formats that Spark lacks are read as binary
files and parsed one file per row, so a file is the unit of work.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import present
from ..session import file_system

BOM = "﻿"


def without_bom(df: DataFrame) -> DataFrame:
    """Column names without a byte order mark, a carriage return or blanks around them."""
    return df.toDF(*(c.replace(BOM, "").strip() for c in df.columns))


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None, encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """Delimited text with a header, all columns text unless a schema is given; bad rows keep what they have."""
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("encoding", encoding)
    reader = reader.option("multiLine", multi_line).option("escape", '"').option("inferSchema", False)
    return without_bom((reader.schema(schema) if schema else reader).csv(path))


def first_line(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).first()[0].replace(BOM, "")


def sniffed_separator(spark: SparkSession, path: str) -> str:
    """Tab if the first line has one, else comma."""
    return "\t" if "\t" in first_line(spark, path) else ","


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, sep=sniffed_separator(spark, path))


def sniffed_encoding(head: bytes) -> str:
    """From the first 64 KB: by byte order mark, else UTF-8 if they are that, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if head.startswith(mark):
            return name
    try:
        head[:65536].decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < min(len(head), 65536) - 4:
            return "windows-1252"
    return "UTF-8"


def head_of(spark: SparkSession, path: str, most: int = 65_536) -> bytes:
    """The first bytes of a file, wherever Spark reads it."""
    system, there = file_system(spark, path)
    stream = system.open(there)
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def read_detected(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text of one file in whatever encoding and with whichever separator its head shows."""
    head = head_of(spark, path)
    encoding = sniffed_encoding(head)
    first = head.decode(encoding, "ignore").split("\n", 1)[0]
    return read_csv(spark, path, sep="\t" if "\t" in first else ",", encoding=encoding)


# The formats that sources name.
READERS: dict[str, Callable[..., DataFrame]] = {}


def reader_of(kind: str) -> Callable[..., DataFrame]:
    """The reader (spark, path, ..) of a source's format; an unknown one is an error that names those there are."""
    from . import shapefile, sqlite

    if not READERS:
        READERS.update(csv=read_csv, tsv=lambda spark, path: read_csv(spark, path, sep="\t"), detected=read_detected, json=read_json, ndjson=read_ndjson, xml=read_xml, zip=unzipped, sqlite=sqlite.snapshot, shapefile=shapefile.shapes)
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}: {', '.join(sorted(READERS))}")
    return READERS[kind]


def fourth_column_value(df: DataFrame) -> DataFrame:
    """(entity, code, year, value) of files in which only the place of the value is fixed."""
    entity, code, year, value = df.columns[:4]
    return df.select(F.col(f"`{entity}`").alias("entity"), present(F.col(f"`{code}`")).alias("code"), F.col(f"`{year}`").try_cast("int").alias("year"), F.col(f"`{value}`").try_cast("double").alias("value")).where("value is not null")


def either_area(df: DataFrame, *names: str) -> Column:
    """The first of several columns that the file has and that isn't blank."""
    return F.coalesce(*(present(F.col(n)) for n in names if n in df.columns))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_ndjson(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, lines that are no JSON object of the schema)."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    lines = spark.read.text(path).where("value <> ''").select("value", parsed.alias("r"))
    return lines.where("r._bad is null").select("r.*").drop("_bad"), lines.where("r._bad is not null").select(F.col("value").alias("line"))


def from_envelope(df: DataFrame, path: str) -> DataFrame:
    """The records of an array within an answer: ``response.docs``, say."""
    return df.select(F.inline(F.col(path)))


def vectors(df: DataFrame) -> DataFrame:
    """(vector_id, ref_per, value) of a batch of series; fails as a whole if any has no success."""
    fine = F.when(F.col("status") == "SUCCESS", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("series failed: "), F.col("object.vectorId").cast("string"))).cast("boolean"))
    points = df.where(fine).select(F.col("object.vectorId").alias("vector_id"), F.inline("object.vectorDataPoint"))
    return points.select("vector_id", F.col("refPer").alias("ref_per"), F.col("value").cast("double").alias("value"))


def table_rows(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows of a JSON array of arrays by place."""
    rows = df.select(F.explode(F.from_json(column, "array<array<string>>")).alias("_r"))
    return rows.select(*(F.get("_r", F.lit(i)).alias(n) for i, n in enumerate(names)))


def json_cells(c: Column, schema: str) -> Column:
    """A cell that holds JSON; null where it holds none."""
    return F.from_json(present(c), schema)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def unzipped(spark: SparkSession, path: str, suffix: str = ".csv", exclude: str = "metadata") -> DataFrame:
    """(path, name, line_no, line) of the first member with the suffix of each archive, read as a stream of lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = next((n for n in z.namelist() if n.lower().endswith(suffix) and exclude not in n.lower()), None)
                    if name is None:
                        continue
                    held: list[str] = []
                    first = 0
                    with z.open(name) as raw:
                        for line in io.TextIOWrapper(raw, "utf-8-sig", "replace"):
                            held.append(line.rstrip("\r\n"))
                            if len(held) == 10_000:
                                yield pd.DataFrame({"path": where, "name": name, "line_no": range(first, first + len(held)), "line": held})
                                first, held = first + len(held), []
                    if held:
                        yield pd.DataFrame({"path": where, "name": name, "line_no": range(first, first + len(held)), "line": held})

    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInPandas(run, "path string, name string, line_no bigint, line string")


class _Page(HTMLParser):
    """Text of a page, of its title and of the elements with given ids."""

    def __init__(self, ids: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.ids, self.text, self.title, self.fields = ids, [], [], {}
        self.stack: list[tuple[str, str | None]] = []

    VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}

    def handle_starttag(self, tag, attrs):
        if tag not in self.VOID:
            self.stack.append((tag, dict(attrs).get("id")))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        tags = [t for t, _ in self.stack]
        if "script" in tags or "style" in tags:
            return
        self.text.append(data)
        if "title" in tags:
            self.title.append(data)
        for _, ident in self.stack:
            if ident in self.ids:
                self.fields.setdefault(ident, []).append(data)


def _pieces(batch: pa.RecordBatch, column: str, rows: int = 256, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and about ``most`` bytes of ``column``; a larger row is one by itself."""
    first = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > first and (i - first == rows or held + size > most):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < batch.num_rows:
        yield batch.slice(first)


def page_text(pages: DataFrame, html: str = "html", ids: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``pages`` but the markup, with title, text and a map of the text of the elements of ``ids``.

    A worker holds the texts of one slice at a time beside the batch that it is given, so its memory doesn't grow with the table.
    """
    keep = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole, html):
                titles, texts, fields = [], [], []
                for markup in batch.column(html):
                    p = _Page(frozenset(ids))
                    p.feed(markup.as_py() or "")
                    p.close()
                    titles.append(" ".join("".join(p.title).split()))
                    texts.append(" ".join(" ".join(p.text).split()))
                    fields.append([(k, " ".join(" ".join(v).split())) for k, v in p.fields.items()])
                found = [pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(fields, pa.map_(pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [*keep, "title", "text", "fields"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pages.dtypes if c != html)
    return pages.mapInArrow(run, f"{kinds}, title string, text string, fields map<string,string>")


def feed_entries(df: DataFrame, body: str = "body") -> DataFrame:
    """Entries (title, link, published, guid) of RSS and Atom documents, by pattern, so that broken XML still gives what it holds."""
    entry = F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?s)<(?:item|entry)\b.*?(?:</(?:item|entry)>|\z)"), F.lit(0))).alias("_e")
    rows = df.select(*(c for c in df.columns if c != body), entry)

    def tag(*names: str) -> Column:
        text = F.regexp_extract("_e", rf"(?s)<(?:{'|'.join(names)})\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</", 1)
        return present(F.regexp_replace(text, r"&amp;", "&"))

    link = F.coalesce(tag("link"), present(F.regexp_extract("_e", r'<link\b[^>]*href="([^"]*)"', 1)))
    guid = F.coalesce(tag("guid", "id"), link)
    return rows.select(*(c for c in df.columns if c != body), tag("title").alias("title"), link.alias("link"), tag("pubDate", "published", "updated", "dc:date").alias("published"), guid.alias("guid"))


def fresh_payloads(payloads: DataFrame, log: DataFrame) -> DataFrame:
    """Payloads (source_id, body) whose checksum no ingestion that didn't fail has."""
    summed = payloads.withColumn("checksum", F.sha2(F.col("body").cast("binary"), 256))
    return summed.join(log.where("status <> 'failed'"), ["source_id", "checksum"], "left_anti")


def first_in_file(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row of each key, in the order of the file."""
    columns = df.columns
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(ordinal)).alias("_r")).select("_r.*")


# How the headers of estimates name a year and a kind of document.
ESTIMATE_KINDS = {"main": r"Main Estimates", "expenditures": r"Expenditures", "to_date": r"Estimates To Date"}


def estimate_columns(names: list[str]) -> dict[str, tuple[str, str]]:
    """Column -> (fiscal year, kind) for headers such as ``2024-25 Main Estimates``; supplements by their letter."""
    import re

    out = {}
    for name in names:
        year = re.search(r"\b(\d{4}-\d{2})\b", name)
        if not year:
            continue
        supplement = re.search(r"Supplementary.*\b([ABC])\b", name)
        if supplement:
            out[name] = (year[1], f"supp_{supplement[1].lower()}")
        elif found := next((k for k, p in ESTIMATE_KINDS.items() if re.search(p, name, re.I)), None):
            out[name] = (year[1], found)
    return out


def estimates_long(df: DataFrame, keys: list[str], kinds: tuple[str, ...] = ("main", "supp_a", "supp_b", "supp_c")) -> DataFrame:
    """Wide estimates as rows (keys, fiscal_year, document_type, amount): one scan, blanks dropped."""
    from ..functions.text import amount

    wanted = {c: x for c, x in estimate_columns(df.columns).items() if x[1] in kinds}
    rows = F.array(*(F.struct(F.lit(y).alias("fiscal_year"), F.lit(k).alias("document_type"), amount(F.col(f"`{c}`")).alias("amount")) for c, (y, k) in wanted.items()))
    return df.select(*keys, F.inline(rows)).where("amount is not null")
