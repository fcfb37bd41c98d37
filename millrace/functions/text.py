"""Text, money, keys and names as column expressions. Nulls give nulls unless a function says otherwise."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT_SEPARATOR = "\u001f"

# The provinces and territories of Canada with their postal codes.
PROVINCES = {
    "alberta": "AB", "british columbia": "BC", "manitoba": "MB", "new brunswick": "NB", "newfoundland and labrador": "NL",
    "northwest territories": "NT", "nova scotia": "NS", "nunavut": "NU", "ontario": "ON", "prince edward island": "PE",
    "quebec": "QC", "québec": "QC", "saskatchewan": "SK", "yukon": "YT",
}
# First letter of a postal code -> province.
POSTAL_PROVINCES = {
    "A": "NL", "B": "NS", "C": "PE", "E": "NB", "G": "QC", "H": "QC", "J": "QC", "K": "ON", "L": "ON", "M": "ON", "N": "ON",
    "P": "ON", "R": "MB", "S": "SK", "T": "AB", "V": "BC", "X": "NT", "Y": "YT",
}
# The vote codes of the public accounts.
VOTE_TYPES = {"1": "operating", "5": "capital", "10": "grants_and_contributions", "S": "statutory"}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def squish(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def present(c: Column) -> Column:
    """The value, or null where it is blank."""
    return F.when(c.rlike(r"[^\s\p{Z}]"), c)


def clean(c: Column) -> Column:
    """Without tags, white space squished, null if nothing is left."""
    return F.nullif(squish(F.regexp_replace(c, r"<[^>]*>", "")), F.lit(""))


def clean_list(c: Column) -> Column:
    """An array's values joined by ``; ``, cleaned."""
    return clean(F.array_join(c, "; "))


def first_present(*columns: Column) -> Column:
    """The first value that is not blank: for headers that changed over the years."""
    return F.coalesce(*(present(c) for c in columns))


def amount(c: Column, kind: str = "decimal(20,2)") -> Column:
    """Money in any spelling; parentheses are negative; without digits: null."""
    text = F.trim(c.cast("string"))
    number = F.regexp_extract(F.regexp_replace(text, r"[^\d.\-]", ""), r"^-?\d*\.?\d*", 0).try_cast(kind)
    return F.when(text.startswith("(") & text.endswith(")"), -F.abs(number)).otherwise(number)


def whole_number(c: Column) -> Column:
    """A whole number with thousands commas; null for anything else, so that errors can be routed away."""
    return F.when(F.trim(c).rlike(r"^-?(\d+|\d{1,3}(,\d{3})+)$"), F.regexp_replace(F.trim(c), ",", "").try_cast("bigint"))


def year_in(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def english(c: Column) -> Column:
    """What stands before `` | `` in a bilingual value."""
    return F.substring_index(clean(c), " | ", 1)


def stable_key(*parts: Column) -> Column:
    """Hex sha256 of the cleaned parts; null parts count as empty ones."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *(F.coalesce(clean(p.cast("string")), F.lit("")) for p in parts)), 256)


def content_hash(*columns: Column | str) -> Column:
    """Hex sha256 of a canonical JSON object: the order of names is given, nulls are kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def province_code(c: Column) -> Column:
    text = clean(c)
    known = F.array(*(F.lit(x) for x in sorted(set(PROVINCES.values()))))
    return F.when(F.array_contains(known, F.upper(text)), F.upper(text)).otherwise(F.try_element_at(literal_map(PROVINCES), F.lower(text)))


def country_code(c: Column) -> Column:
    text = clean(c)
    return F.when(text.rlike("^[A-Za-z]{2}$"), F.upper(text)).when(F.lower(text) == "canada", "CA")


def postal_code(c: Column) -> Column:
    """``A1A 1A1``, or null."""
    bare = F.regexp_replace(F.upper(c), r"[\s-]", "")
    return F.when(bare.rlike(r"^[A-Z]\d[A-Z]\d[A-Z]\d$"), F.concat_ws(" ", F.left(bare, F.lit(3)), F.right(bare, F.lit(3))))


def postal_province(c: Column) -> Column:
    """By first letter; X0A, X0B and X0C lie in Nunavut."""
    bare = F.upper(F.trim(c))
    return F.when(bare.rlike("^X0[ABC]"), "NU").otherwise(F.try_element_at(literal_map(POSTAL_PROVINCES), F.left(bare, F.lit(1))))


def vote_type(c: Column, blank: str = "operating") -> Column:
    """The type of a vote; sources differ in what a blank means, so it is a parameter."""
    code = F.upper(F.trim(c))
    return F.when(present(c).isNull(), blank).otherwise(F.coalesce(F.try_element_at(literal_map(VOTE_TYPES), code), F.lit("operating")))


def plain_quotes(c: Column) -> Column:
    """Curly quotes and the stray Windows-1252 one as plain quotes."""
    return F.trim(F.translate(c, "‘’“”\u0092", "''\"\"'"))


def without_parenthetical(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\([^()]*\)\s*$", "")


def ward_number(c: Column) -> Column:
    """The last part between hyphens, where it is a number."""
    return F.element_at(F.split(c, "-"), -1).try_cast("int")


def contains_ignoring_case(c: Column, wanted: str) -> Column:
    """A substring test in which nothing is a wildcard."""
    return F.contains(F.lower(c), F.lit(wanted.lower()))


def whole_word(c: Column, *words: str) -> Column:
    return c.rlike(r"(?i)\b(" + "|".join(words) + r")\b")


def truncate_middle(c: Column, limit: int, marker: str = "\n\n[…]\n\n", head: float = 0.75) -> Column:
    """At most ``limit`` characters: the start and the end around a marker."""
    room = limit - len(marker)
    if room <= 0:
        raise ValueError("the limit is too small for the marker")
    first = int(room * head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.left(c, F.lit(first)), F.lit(marker), F.right(c, F.lit(room - first))))


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.ceil(F.length(c) / 4), F.lit(1)).cast("bigint")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+")).cast("bigint")


def url_host(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, no fragment or default port, slashes of the path collapsed; null if there is no host."""
    part = lambda name: F.try_parse_url(c, F.lit(name))
    scheme = F.lower(part("PROTOCOL"))
    authority = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    path = F.regexp_replace(F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/")), "/{2,}", "/")
    query = F.array_join(F.array_sort(F.split(part("QUERY"), "&")), "&")
    return F.when(part("HOST").isNotNull(), F.concat(scheme, F.lit("://"), authority, path, F.coalesce(F.concat(F.lit("?"), query), F.lit(""))))


@F.pandas_udf(T.StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark lacks."""
    return c.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def slug(c: Column, limit: int = 200) -> Column:
    """Lower case letters and digits joined by hyphens, of a text that ``nfkc`` has composed if it needs it."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(limit))


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters; none for shorter texts."""
    n = F.length(c)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(c, i, 3))
    return F.when(n >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard index of the trigrams; 1 for equal texts, 0 if either has none."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(a == b, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def added(*columns: Column) -> Column:
    """The sum of columns in which a null is nothing."""
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0)) for c in columns))


def percent_change(new: Column, old: Column, digits: int = 2) -> Column:
    """Change in percent of the old value's size; null if that is zero."""
    return F.when(old != 0, F.round((new - old) / F.abs(old) * 100, digits))


def seconds_of(c: Column) -> Column:
    """Seconds of ``HH:MM:SS.mmm`` or ``MM:SS.mmm``."""
    part = F.reverse(F.split(c, ":"))
    at = lambda i: F.coalesce(F.get(part, F.lit(i)).cast("double"), F.lit(0.0))
    return F.when(c.isNotNull(), at(0) + 60 * at(1) + 3600 * at(2))


def clock_of(seconds: Column) -> Column:
    """``HH:MM:SS.mmm`` of seconds."""
    ms = F.round(seconds * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(F.pmod(ms, F.lit(3_600_000)) / 60_000), F.floor(F.pmod(ms, F.lit(60_000)) / 1000), F.pmod(ms, F.lit(1000)))


def merged_metadata(*maps: Column) -> Column:
    """Maps in one, without nulls; later keys win (``spark.sql.mapKeyDedupPolicy=LAST_WIN``)."""
    return F.map_filter(F.map_concat(*maps), lambda _, v: v.isNotNull())


def searchable_text(values: Column) -> Column:
    """A map's values as one text."""
    return F.array_join(F.map_values(values), " ")


# Procurement ids that name no procurement.
GENERIC_PROCUREMENT_IDS = ("null", "na", "n a", "none", "unknown", "not applicable")


def generic_procurement_id(c: Column) -> Column:
    plain = squish(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    return (plain == "") | plain.isin(*GENERIC_PROCUREMENT_IDS) | plain.contains("acquisition card")


def payment_amount(recipient: Column, total: Column, aggregate: Column) -> Column:
    """What a transfer paid: rows without a recipient, or of payments under a limit, are sums, the others single
    payments; a zero counts as missing, and then the other amount stands."""
    summed = present(recipient).isNull() | recipient.rlike("(?i)payments under")
    return F.when(F.coalesce(summed, F.lit(True)), F.coalesce(F.nullif(total, F.lit(0)), aggregate)).otherwise(F.coalesce(F.nullif(aggregate, F.lit(0)), total))


def display_labels(elements: Column, qualifier: str | None = None) -> Column:
    """Labels of an array of structs (name, code, percentage, ..): ``Name 40% (kind: x)``; those without a name or code go."""

    def label(e: Column) -> Column:
        out = F.coalesce(present(e["name"]), present(e["code"]))
        share = F.coalesce(F.concat(F.lit(" "), e["percentage"].cast("string"), F.lit("%")), F.lit(""))
        more = F.lit("") if qualifier is None else F.coalesce(F.concat(F.lit(f" ({qualifier}: "), present(e[qualifier]), F.lit(")")), F.lit(""))
        return F.concat(out, share, more)

    return F.array_compact(F.transform(elements, label))


def province_of_organization(c: Column) -> Column:
    """The province that an organisation's name ends in, after a comma or in parentheses."""
    names = "|".join(sorted(PROVINCES, key=len, reverse=True))
    return F.try_element_at(literal_map(PROVINCES), F.nullif(F.regexp_extract(F.lower(c), rf"[,(]\s*({names})\s*\)?\s*$", 1), F.lit("")))


def language_code(c: Column) -> Column:
    code = F.substring_index(F.translate(F.lower(c), "_", "-"), "-", 1)
    return F.when(code.isin("en", "fr"), code).otherwise("und")
