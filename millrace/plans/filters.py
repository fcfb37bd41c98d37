"""A validated filter language as Spark conditions.

A definition is a nested dict: ``{"all": [..]}``, ``{"any": [..]}``, ``{"not": ..}`` or a leaf ``{"field", "op", "value"}``.
A contract says which fields there are, with their kind and the operators they allow.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("filter_only", "lexical", "semantic", "hybrid")
KEYS = {"version", "realm", "language", "text", "mode", "lexical_match", "semantic_max_distance", "filters"}
MAX_DEPTH, MAX_VALUES = 4, 100


class InvalidDefinition(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__(", ".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class Contract:
    """Fields of a realm: name -> kind (string, number, datetime, array, ..) and name -> allowed operators."""

    realm: str
    kinds: dict[str, str]
    operators: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def allowed(self, name: str) -> tuple[str, ...] | None:
        if name not in self.kinds:
            return None
        by_kind = {"array": ("contains_any", "contains_all"), "string": ("eq", "in"), "bool": ("eq",)}
        return self.operators.get(name) or by_kind.get(self.kinds[name], ("eq", "in", "gt", "gte", "lt", "lte"))


def errors_of(definition: Any, contract: Contract) -> list[str]:
    if not isinstance(definition, dict):
        return ["must be an object"]
    found = []
    if unknown := sorted(set(definition) - KEYS):
        found.append(f"contains unknown keys: {', '.join(unknown)}")
    if definition.get("version") != 1:
        found.append("version must be 1")
    if definition.get("realm") != contract.realm:
        found.append("realm must match the saved search")
    mode = definition.get("mode") or "filter_only"
    if mode not in MODES:
        found.append("mode is invalid")
    if mode in MODES[1:] and not str(definition.get("text") or "").strip():
        found.append("text is required for ranked modes")
    if mode in ("semantic", "hybrid") and not _is_number(definition.get("semantic_max_distance")):
        found.append("semantic_max_distance must be numeric")
    if definition.get("filters"):
        _check(definition["filters"], contract, 0, found)
    return found


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _check(node: Any, contract: Contract, depth: int, found: list[str]) -> None:
    if depth > MAX_DEPTH:
        found.append("filter nesting is too deep")
    elif not isinstance(node, dict):
        found.append("filter group must be an object")
    elif "field" in node:
        allowed, op = contract.allowed(node["field"]), node.get("op")
        if allowed is None:
            found.append(f"filter field {node['field']} is not allowed")
        elif op not in allowed:
            found.append(f"operator {op} is not allowed for {node['field']}")
        if isinstance(node.get("value"), list) and len(node["value"]) > MAX_VALUES:
            found.append(f"filter value arrays cannot exceed {MAX_VALUES} items")
    elif len(node) != 1 or not set(node) <= {"all", "any", "not"}:
        found.append("filter group must contain exactly one of all, any, or not")
    else:
        (kind, children), = node.items()
        children = [children] if kind == "not" else children
        if not isinstance(children, list) or not children:
            found.append("filter group cannot be empty")
        else:
            for child in children:
                _check(child, contract, depth + 1, found)


def condition(node: dict, contract: Contract, evaluated_at: datetime) -> Column:
    """A filter tree as one condition, which Spark pushes into the scan as far as it can."""
    if "all" in node:
        return reduce(lambda a, b: a & b, (condition(n, contract, evaluated_at) for n in node["all"]))
    if "any" in node:
        return reduce(lambda a, b: a | b, (condition(n, contract, evaluated_at) for n in node["any"]))
    if "not" in node:
        return ~condition(node["not"], contract, evaluated_at)
    column, op, value = F.col(node["field"]), node["op"], node.get("value")
    if contract.kinds.get(node["field"]) == "datetime" and value == "now":
        value = evaluated_at
    many = value if isinstance(value, list) else [value]
    if op == "contains_all":
        return reduce(lambda a, b: a & b, (F.array_contains(column, v) for v in many))
    if op == "contains_any":
        return F.arrays_overlap(column, F.array(*(F.lit(v) for v in many)))
    if op == "in":
        return column.isin(many)
    compare = {"eq": column.__eq__, "gt": column.__gt__, "gte": column.__ge__, "lt": column.__lt__, "lte": column.__le__}
    return compare[op](value)


def compiled(definition: dict, contract: Contract, evaluated_at: datetime, from_sequence: int | None = None, to_sequence: int | None = None) -> Column:
    """The whole condition of a definition: realm, visibility, the half-open range of sequences, its filters."""
    if found := errors_of(definition, contract):
        raise InvalidDefinition(found)
    parts = [F.col("realm") == contract.realm, F.col("visibility") == "public"]
    if from_sequence is not None:
        parts.append(F.col("index_sequence") > from_sequence)
    if to_sequence is not None:
        parts.append(F.col("index_sequence") <= to_sequence)
    if definition.get("filters"):
        parts.append(condition(definition["filters"], contract, evaluated_at))
    return reduce(lambda a, b: a & b, parts)


def optional(given: dict[str, Any], known: dict[str, Any]) -> list[Column]:
    """Conditions of those request parameters that are present; ``known`` maps a name to a function of its value."""
    return [known[k](v) for k, v in given.items() if k in known and v not in (None, "")]


def year_range(column: str, first: int | None, last: int | None) -> list[Column]:
    return [c for c in (F.col(column) >= first if first is not None else None, F.col(column) <= last if last is not None else None) if c is not None]


# What a request may hand through to the search, and how many rows it may ask for.
PASSED, MOST_ROWS = ("rank_by", "filters", "limit", "top_k", "include_attributes"), 250


def passed_through(raw: dict[str, Any], contract: Contract, evaluated_at: datetime) -> tuple[Column, int]:
    """(condition, rows) of a request that brings its own filter: AND-ed with the scope, at most ``MOST_ROWS`` rows (10 if it doesn't say).

    Parameters that may not be passed are an error.
    """
    if unknown := sorted(set(raw) - set(PASSED)):
        raise InvalidDefinition([f"parameters not allowed: {', '.join(unknown)}"])
    found: list[str] = []
    if raw.get("filters"):
        _check(raw["filters"], contract, 0, found)
    if found:
        raise InvalidDefinition(found)
    rows = max(1, min(int(raw.get("limit") or raw.get("top_k") or 10), MOST_ROWS))
    scope = (F.col("realm") == contract.realm) & (F.col("visibility") == "public")
    return (scope & condition(raw["filters"], contract, evaluated_at) if raw.get("filters") else scope), rows


def preview_rows(asked: Any, least: int = 1, most: int = 100) -> int:
    """How many rows a preview gives: what is asked for, held between ``least`` and ``most``; ``most`` if it isn't a number."""
    try:
        return max(least, min(int(asked), most))
    except (TypeError, ValueError):
        return most


def prefixed(column: Column, prefix: str) -> Column:
    """Names with a beginning, letter by letter: ``_`` and ``%`` stand for themselves."""
    return column.startswith(prefix)


def ilike(column: Column, text: str) -> Column:
    """Texts with ``text`` anywhere, case aside, in which ``%`` and ``_`` are wildcards as they were typed."""
    return column.ilike(f"%{text}%")
