"""One text for all JSON that means the same, and its digest.

``canonical`` writes columns of known types: names in order, times with six digits and a Z, days as such, decimals as plain
text. ``canonical_json`` takes JSON of any shape as text, by way of VARIANT: names in order at every depth, no white space, numbers in one
form whether they were written 100, 100.0 or 1e2. Both are column expressions.

Defined results: null columns are null in an object and a null text gives null; text that is no JSON, and an object that names
something twice, gives null; numbers beyond 38 digits stay as their parser has them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(c: Column) -> Column:
    """A text as JSON."""
    inner = F.to_json(F.array(c))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def decimal_text(c: Column) -> Column:
    """Plain digits with one behind the point at least."""
    text = F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1")
    text = F.regexp_replace(text, r"\.$", ".0")
    return F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0")))


def canonical(c: Column, kind: T.DataType) -> Column:
    """JSON of a column of the given type."""
    null = F.lit("null")
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode())
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical(c[f.name], f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("k"), e["value"].alias("v"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(quoted(e["k"]), F.lit(":"), canonical(e["v"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.TimestampType):
        text = quoted(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    elif isinstance(kind, T.TimestampNTZType):
        text = quoted(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    elif isinstance(kind, T.DateType):
        text = quoted(F.date_format(c, "yyyy-MM-dd"))
    elif isinstance(kind, T.DecimalType):
        text = quoted(decimal_text(c))
    else:
        text = quoted(c)
    return F.coalesce(text, null)


_TOKENS = r'"(?:[^"\\]|\\.)*+"|-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|[^"\d-]+'  # strings, numbers, what is between


def canonical_json(column: str) -> Column:
    """The normal text of JSON of any shape in a column of texts.

    A VARIANT as text has its names in order and no white space, so only its numbers are left: 100.0 becomes 100 by one pattern, which steps over strings;
    only where a number has an exponent or may be -0.0 are all numbers looked at one by one.
    """
    text = F.to_json(F.try_parse_json(F.col(column)))
    whole = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|(-?\d+)\.0(?=[,\]}]|$)', "$1$2")
    number = lambda x: x.try_cast("double")
    one = lambda x: F.when(~x.startswith('"') & x.rlike(r"^-?\d+(\.0|.*[eE].*)$") & (number(x) == F.floor(number(x))) & (F.abs(number(x)) < 1e15), number(x).cast("bigint").cast("string")).otherwise(F.regexp_replace(x, r"^(-?\d+)\.0$", "$1"))
    each = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), one), "")
    return F.when(text.rlike(r"\dE|\de|-0\.0"), each).when(text.contains(".0"), whole).otherwise(text)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)
