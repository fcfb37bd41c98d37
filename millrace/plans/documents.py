"""Records of many kinds as rows of one search table, with the errors that keep a row out."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, present, url_host

ONTOLOGY = (
    "jurisdiction_ids", "jurisdiction_codes", "jurisdiction_levels", "organization_ids", "organization_names", "geo_boundary_ids", "province_codes",
    "country_codes", "tags", "categories",
)
#: What a document's hash covers; a change of anything else is none.
HASHED = ("realm", "record_type", "visibility", "canonical_url", "source_url", "title", "summary", "content", "language", "published_at", "source_updated_at")
MAX_ID_BYTES, MAX_STRING_BYTES = 64, 16_384


@dataclass(frozen=True)
class Realm:
    """Record types of a realm, its own fields by kind, and which of them are required."""

    key: str
    record_types: tuple[str, ...]
    kinds: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()


def to_documents(df: DataFrame, realm: Realm, columns: dict[str, Column], ontology: dict[str, Column] | None = None) -> DataFrame:
    """Rows of a source as documents: ``columns`` gives common and realm fields, ``ontology`` the arrays of it that it has.

    Text goes to the columns of its language; a host is taken from the canonical link; the hash covers fixed fields.
    """
    given = {c: columns.get(c, F.lit(None).cast("string")) for c in ("id", *HASHED, "state")} | {k: v for k, v in columns.items()}
    given |= {"realm": F.lit(realm.key), "visibility": columns.get("visibility", F.lit("public"))}
    own = {k: given.get(k, F.lit(None).cast("string")) for k in realm.kinds}
    arrays = {k: F.array_compact(F.coalesce((ontology or {}).get(k, F.array().cast("array<string>")).cast("array<string>"), F.array().cast("array<string>"))) for k in ONTOLOGY}
    rows = df.select(*(c.alias(k) for k, c in (given | own | arrays).items()))
    of = lambda language, c: F.when(F.col("language") == language, F.col(c))
    rows = rows.withColumns({f"{c}_{x}": of(x, c) for x in ("en", "fr") for c in ("title", "content")} | {"source_domain": url_host(F.col("canonical_url"))})
    return rows.withColumn("content_hash", content_hash(*HASHED, *ONTOLOGY, *realm.kinds))


def united(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def kind_fits(c: Column, kind: str, have: str) -> Column:
    """Whether a value is of a contract's kind; ``have`` is the column's Spark type."""
    if kind.startswith("[]"):
        return F.lit(have.startswith("array"))
    if kind.startswith("[") and "]" in kind:
        size = int(kind[1 : kind.index("]")])
        return F.lit(have.startswith("array")) & (F.size(c) == size) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    whole = have in ("tinyint", "smallint", "int", "bigint")
    if kind == "uint":
        return F.lit(whole) & (c >= 0)
    if kind == "int":
        return F.lit(whole)
    if kind == "float":
        number = whole or have in ("float", "double") or have.startswith("decimal")
        return F.lit(number) & ~F.isnan(c.cast("double")) if number else F.lit(False)
    return F.lit({"bool": have == "boolean", "string": have == "string", "uuid": have == "string", "datetime": have in ("string", "timestamp", "timestamp_ntz", "date")}.get(kind, False))


def with_errors(documents: DataFrame, realm: Realm) -> DataFrame:
    """``errors``: an array of texts, empty for a row that may be published."""
    have = dict(documents.dtypes)
    published = F.coalesce("state", F.lit("published")) == "published"
    blank = lambda c: present(F.col(c).cast("string")).isNull()
    found = [
        F.when(~F.coalesce(F.col("record_type").isin(*realm.record_types), F.lit(False)), "record_type is not supported"),
        F.when(published & blank("title"), "title is required for publication"),
        F.when(published & blank("content"), "content is required for publication"),
        F.when(F.octet_length(F.col("id").cast("string")) > MAX_ID_BYTES, "id is too long"),
    ]
    for name in realm.required:
        empty = F.col(name).isNull() | (F.size(name) == 0) if have[name].startswith("array") else blank(name)
        found.append(F.when(empty, f"{name} is required"))
    for name, kind in realm.kinds.items():
        found.append(F.when(F.col(name).isNotNull() & ~kind_fits(F.col(name), kind, have[name]), f"{name} must be {kind}"))
        if have[name] == "string":
            found.append(F.when(F.octet_length(name) > MAX_STRING_BYTES, f"{name} exceeds the filterable string size limit"))
    return documents.withColumn("errors", F.array_compact(F.array(*found)))


# Fields and kinds of the realms.
AWARDS = Realm("government_spending", ("contract", "grant", "transfer_payment"), {"recipient_name": "string", "program_name": "string", "fiscal_year": "int", "amount": "float", "currency": "string", "is_aggregated": "bool"})
EXPENDITURES = Realm(
    "government_spending", ("fiscal_expenditure", "standard_object_expenditure"),
    {"award_type": "string", "payer_organization_ids": "[]int", "payer_names": "[]string", "program_name": "string", "fiscal_year": "int", "amount": "float", "currency": "string", "is_aggregated": "bool", "dataset_key": "string"},
    ("award_type", "dataset_key"),
)
MEASURES = Realm("kpi", ("measure",), {"kpi_measure_slug": "string", "kpi_category": "string", "kpi_frequency": "string", "kpi_unit_symbol": "string"}, ("kpi_measure_slug",))
ARTICLES = Realm("media", ("article", "opinion", "editorial", "column", "live_blog"), {"publisher_name": "string", "authors": "[]string", "word_count": "uint"}, ("publisher_name",))


def award_documents(awards: DataFrame) -> DataFrame:
    """Awards that are published and canonical are published; others are withdrawn."""
    shown = (F.col("state") == "published") & F.coalesce(F.col("is_canonical"), F.lit(False))
    content = F.array_join(F.array_compact(F.array(*(present(F.col(c).cast("string")) for c in ("payer_name", "recipient_name", "program_name", "description", "amount", "fiscal_year")))), " — ")
    columns = {
        "id": F.concat(F.lit("award:"), F.col("id").cast("string")), "record_type": F.col("award_type"), "state": F.when(shown, "published").otherwise("withdrawn"),
        "title": F.col("title"), "summary": F.col("description"), "content": content, "language": F.coalesce("language", F.lit("en")),
        "canonical_url": F.col("source_url"), "source_url": F.col("source_url"), "published_at": F.coalesce("occurred_at", "first_seen_at").cast("string"), "source_updated_at": F.col("last_seen_at").cast("string"),
        "recipient_name": F.col("recipient_name"), "program_name": F.col("program_name"), "fiscal_year": F.col("fiscal_year"), "amount": F.col("amount").cast("double"),
        "currency": F.coalesce("currency", F.lit("CAD")), "is_aggregated": F.col("is_aggregated"),
    }
    ontology = {"organization_names": F.array("payer_name"), "province_codes": F.array("province_code"), "country_codes": F.array("country_code")}
    return to_documents(awards, AWARDS, columns, ontology)


def _expenditure_documents(rows: DataFrame, kind: str, title: Column, summary: Column, content: list[Column], program: Column, amount: Column) -> DataFrame:
    year = F.regexp_extract(F.coalesce(F.col("fiscal_year").cast("string"), F.lit("")), r"\d{4}", 0)
    columns = {
        "id": F.concat(F.lit(kind.replace("_", "-") + ":"), F.col("id").cast("string")), "record_type": F.lit(kind), "title": title, "summary": summary,
        "content": F.concat_ws(" — ", *(c.cast("string") for c in content)), "language": F.lit("und"),
        "published_at": F.col("created_at").cast("string"), "source_updated_at": F.col("updated_at").cast("string"), "award_type": F.lit(kind),
        "payer_organization_ids": F.array("organization_id"), "payer_names": F.array("organization_name"), "program_name": program,
        "fiscal_year": F.when(year != "", year.cast("int")), "amount": amount.cast("double"), "currency": F.col("default_currency"), "is_aggregated": F.lit(True),
        "dataset_key": F.lit(kind + "s"),
    }
    ontology = {
        "organization_ids": F.array("organization_id"), "organization_names": F.array("organization_name"), "jurisdiction_ids": F.array("jurisdiction_id"),
        "jurisdiction_codes": F.array("jurisdiction_code"), "jurisdiction_levels": F.array("jurisdiction_level"),
    }
    return to_documents(rows, EXPENDITURES, columns, ontology)


def fiscal_expenditure_documents(rows: DataFrame) -> DataFrame:
    """Expenditures by vote, with their organization and its jurisdiction joined; what was spent, else the ceiling."""
    vote = F.translate("vote_type", "_", " ")
    title = F.concat(F.col("organization_name"), F.lit(" "), F.upper(F.substring(vote, 1, 1)), F.lower(F.substring(vote, 2, 1_000)), F.lit(" expenditure"))
    amount = F.coalesce("actual_expenditure", "pa_voted_ceiling")
    content = [F.col(c) for c in ("organization_name", "vote_type", "vote_number", "description")] + [amount, F.col("fiscal_year")]
    return _expenditure_documents(rows, "fiscal_expenditure", title, F.col("description"), content, F.col("description"), amount)


def standard_object_documents(rows: DataFrame) -> DataFrame:
    """Expenditures by standard object, with their organization and its jurisdiction joined."""
    title = F.concat_ws(" — ", "organization_name", "standard_object")
    summary = F.concat(F.col("fiscal_year").cast("string"), F.lit(" standard-object expenditure"))
    content = [F.col(c) for c in ("organization_name", "standard_object", "amount", "fiscal_year")]
    return _expenditure_documents(rows, "standard_object_expenditure", title, summary, content, F.col("standard_object"), F.col("amount"))


def measure_documents(measures: DataFrame) -> DataFrame:
    columns = {
        "id": F.concat(F.lit("measure:"), F.col("id").cast("string")), "record_type": F.lit("measure"), "title": F.col("canonical_name"), "summary": F.col("description"),
        "content": F.concat_ws(" — ", "canonical_name", "description", "category"), "language": F.lit("en"),
        "kpi_measure_slug": F.col("slug"), "kpi_category": F.col("category"), "kpi_frequency": F.col("frequency"), "kpi_unit_symbol": F.col("unit_symbol"),
    }
    return to_documents(measures, MEASURES, columns)


def article_documents(articles: DataFrame) -> DataFrame:
    kind = F.translate(F.lower("content_type"), " -", "__")
    language = F.substring_index(F.translate(F.lower("language"), "_", "-"), "-", 1)
    words = F.when(F.col("word_count") > 0, F.col("word_count")).otherwise(F.regexp_count("content", F.lit(r"\p{L}[\p{L}\p{M}'’-]*")))
    columns = {
        "id": F.concat(F.lit("article:"), F.col("id").cast("string")), "record_type": F.when(kind.isin(*ARTICLES.record_types), kind).otherwise("article"),
        "title": F.col("title"), "summary": F.col("summary"), "content": F.col("content"), "language": F.when(language.isin("en", "fr"), language).otherwise("und"),
        "canonical_url": F.col("url"), "source_url": F.col("url"), "published_at": F.col("published_at").cast("string"), "publisher_name": F.col("publisher_name"),
        "authors": F.array_distinct(F.array_compact(F.col("authors"))), "word_count": words.cast("int"),
    }
    return to_documents(articles, ARTICLES, columns)
