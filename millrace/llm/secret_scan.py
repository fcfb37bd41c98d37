"""Secrets in texts, found by one automaton for all rules.

Each rule's expression becomes positions (a position for each set of bytes, copies for counted repeats); sets of positions
become states by subset construction, oldest beginning first, so that a state knows which match a leftmost search would
go on with; the rules' automata are combined into one by their reachable tuples, and states that nothing
tells apart are merged. What is left is an array of transitions. A scan steps through a text's bytes once, for all rules
at once, and only looks up when a state says so: a match has grown long enough, or a long enough match has ended.

A rule's matches are leftmost, as long as possible, and don't overlap each other, and those that aren't long enough are consumed like
the others but not reported. One pass suffices for rules that, once met, stay met until the first byte that
doesn't fit, and where no later beginning is met before an earlier one is given up. Rules for which that is untrue are
refused with an error when they are compiled.

Rules say what to find in ASCII; other characters never belong to a match. Spans count code points.

Defined results: a null text counts as empty and has no spans; a span touches others of other kinds freely; null and
repeated ids are rows of their own; texts of any length are scanned whole; other columns pass through; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import slices

parser = re._parser


@dataclass(frozen=True)
class Rule:
    """``pattern`` is to be met for ``least`` bytes on end: from the first byte at which it is, that one included, to the match's last."""

    kind: str
    pattern: str
    least: int = 1


# The three kinds that every scan has, and the lengths that they need.
BASE = (
    # eight or more characters of a value
    Rule("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8),
    # AKIA and twelve or more
    Rule("access", r"AKIA[A-Z0-9]+", 12),
    Rule("hex", r"[0-9a-f]+", 32),
)
# Public formats of further credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 10),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 35),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", 1),
)


# --- from an expression to positions --------------------------------------------------------------


class Positions:
    """The expression as positions: the bytes that each one takes, which may come first and last, and which follow which."""

    def __init__(self, pattern: str):
        self.takes: list[frozenset[int]] = []
        self.follow: list[set[int]] = []
        self.first, self.last, empty = self._of_all(parser.parse(pattern))
        if empty:
            raise ValueError(f"{pattern!r} matches the empty text")

    def _one(self, takes) -> tuple[set[int], set[int], bool]:
        takes = frozenset(takes)
        if not takes or max(takes) > 127:
            raise ValueError("rules are of ASCII characters")
        self.takes.append(takes)
        self.follow.append(set())
        at = {len(self.takes) - 1}
        return at, at, False

    def _joined(self, a, b):
        """``a`` and then ``b``"""
        for p in a[1]:
            self.follow[p] |= b[0]
        return a[0] | (b[0] if a[2] else set()), b[1] | (a[1] if b[2] else set()), a[2] and b[2]

    def _of_all(self, items):
        out = (set(), set(), True)
        for item in items:
            out = self._joined(out, self._of(*item))
        return out

    def _of(self, op, value):
        name = str(op)
        if name == "LITERAL":
            return self._one({value})
        if name == "IN":
            return self._one({c for kind, v in value for c in self._range(str(kind), v)})
        if name == "SUBPATTERN":
            return self._of_all(value[-1])
        if name == "BRANCH":
            parts = [self._of_all(p) for p in value[1]]
            return set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)), any(p[2] for p in parts)
        if name == "MAX_REPEAT":
            least, most, what = value
            out = (set(), set(), True)
            for _ in range(least):
                out = self._joined(out, self._of_all(what))
            if most == parser.MAXREPEAT:
                more = self._of_all(what)
                out = self._joined(out, (*self._joined(more, more)[:2], True))
            else:
                for _ in range(most - least):
                    out = self._joined(out, (*self._of_all(what)[:2], True))
            return out
        raise ValueError(f"{name} has no automaton here")

    @staticmethod
    def _range(kind: str, value):
        if kind == "LITERAL":
            return [value]
        if kind == "RANGE":
            return range(value[0], value[1] + 1)
        raise ValueError(f"{kind} has no automaton here")


# --- from positions to the automaton of one rule ----------------------------------------------------


class Machine:
    """Subset construction of one rule. A state is (beginnings, oldest first, as (age, positions); how long it has been met; ended).

    Ages are counted to just past ``mark`` only, the least number of bytes with which the rule is met, and lengths to just past ``count``.
    """

    def __init__(self, rule: Rule):
        self.rule, self.of = rule, Positions(rule.pattern)
        depth, seen, now = 1, set(), self.of.first
        while not now & self.of.last:
            seen, now, depth = seen | now, set().union(*(self.of.follow[p] for p in now)), depth + 1
        self.mark = depth
        # A rule that is met at once is met everywhere, so its length is counted in states; others are rare, and measured.
        self.count = rule.least if depth == 1 else 1
        self.start = ((), 0, False)

    def step(self, state, byte: int):
        groups, met, _ = state
        new, held = [], set()
        for age, positions in groups:
            after = frozenset(q for p in positions for q in self.of.follow[p] if byte in self.of.takes[q]) - held
            if after:
                new.append((min(age + 1, self.mark + 1), after))
                held |= after
        if met:
            if new:
                if not new[0][1] & self.of.last:
                    raise ValueError(f"{self.rule.kind}: once met, it is to stay met")
                return (new[0],), min(met + 1, self.count + 1), False
        fresh = frozenset(q for q in self.of.first if byte in self.of.takes[q]) - held
        if fresh:
            new.append((1, fresh))
        done = [k for k, (_, positions) in enumerate(new) if positions & self.of.last]
        if any(done) or any(age == self.mark > 1 for age, _ in new[1:]):
            raise ValueError(f"{self.rule.kind}: a later beginning is met before an earlier one is given up")
        return (tuple(new[:1]), 1, met >= self.count) if done else (tuple(new), 0, met >= self.count)

    def says(self, state) -> tuple[bool, bool, bool]:
        """(a match has ended, the oldest beginning is ``mark`` bytes old, the match is long enough from now on)"""
        groups, met, ended = state
        return ended, self.mark > 1 and bool(groups) and groups[0][0] == self.mark, met == self.count

    def live(self, state) -> bool:
        return state[1] >= self.count


class Automaton:
    """All rules in one: ``next[state, byte class]``, the class of each byte, and what each state says of each rule."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        machines = [Machine(r) for r in rules]
        self.marks, self.counts = [m.mark for m in machines], [m.count for m in machines]
        # Bytes that no position tells apart are one class.
        kinds: dict[tuple, int] = {}
        self.classes = np.array([kinds.setdefault(tuple(b in t for m in machines for t in m.of.takes), len(kinds)) for b in range(256)], np.uint8)
        bytes_of = [int(np.flatnonzero(self.classes == c)[0]) for c in range(len(kinds))]
        memo: list[dict] = [{} for _ in machines]
        start = tuple(m.start for m in machines)
        number, queue, rows = {start: 0}, [start], []
        for state in queue:
            row = []
            for c, byte in enumerate(bytes_of):
                after = []
                for m, known, s in zip(machines, memo, state, strict=True):
                    if (s, c) not in known:
                        known[s, c] = m.step(s, byte)
                    after.append(known[s, c])
                after = tuple(after)
                if after not in number:
                    number[after] = len(queue)
                    queue.append(after)
                row.append(number[after])
            rows.append(row)
        says = [(tuple(m.says(s) for m, s in zip(machines, state, strict=True)), tuple(m.live(s) for m, s in zip(machines, state, strict=True))) for state in queue]
        self.next, self.says = minimised(np.array(rows, np.int32), says)

    def linked(self) -> list:
        """The states as lists that hold the next state by byte, then what happens, then what is open at a text's end."""
        states = [[] for _ in self.says]
        for state, row, (says, live) in zip(states, self.next[:, self.classes].tolist(), self.says, strict=True):
            state += [states[k] for k in row]
            events = tuple((r, *what) for r, what in enumerate(says) if any(what))
            state += [events or None, tuple(r for r, on in enumerate(live) if on)]
        return states


def minimised(rows: np.ndarray, says: list) -> tuple[np.ndarray, list]:
    """Merge states that say the same and go to the same, by splitting classes of states until none splits; state 0 stays first."""
    kinds: dict = {}
    label = np.array([kinds.setdefault(s, len(kinds)) for s in says])
    while True:
        _, first, after = np.unique(np.column_stack([label, label[rows]]), axis=0, return_index=True, return_inverse=True)
        if len(first) == label.max() + 1:
            break
        label = after.ravel()
    order = np.argsort(first)
    place = np.empty(len(first), np.int64)
    place[order] = np.arange(len(first))
    keep = first[order]
    return place[after.ravel()][rows[keep]].astype(np.int32), [says[k] for k in keep]


# --- scanning ---------------------------------------------------------------------------------------


def spans_of(text: bytes, states: list, automaton: Automaton) -> list[tuple[int, int, int]]:
    """(first byte, end, rule) of every reported match, by first byte and then by rule."""
    least = [r.least for r in automaton.rules]
    begun, met, out = [0] * len(least), [0] * len(least), []

    def close(rule: int, end: int) -> None:
        if end - met[rule] >= least[rule]:
            out.append((opened[rule], end, rule))

    opened = [0] * len(least)
    state = states[0]
    for at, byte in enumerate(text):
        state = state[byte]
        if state[256]:
            for rule, ended, marked, enough in state[256]:
                if ended:
                    close(rule, at)
                if marked:
                    begun[rule] = at + 1 - automaton.marks[rule]
                if enough:
                    met[rule] = at + 1 - automaton.counts[rule]
                    opened[rule] = begun[rule] if automaton.marks[rule] > 1 else met[rule]
    for rule in state[257]:
        close(rule, len(text))
    return sorted(out, key=lambda x: (x[0], x[2]))


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), int(before[b]), r) for a, b, r in spans]


def masked(text: bytes, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> bytes:
    """Spans, or spans that overlap taken together, as [kind] of the first of them."""
    out, at = [], 0
    for first, end, rule in spans:
        if first >= at:
            out += [text[at:first], f"[{rules[rule].kind}]".encode()]
        at = max(at, end)
    return b"".join([*out, text[at:]])


SECRETS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE, keep: list[str] | None = None) -> DataFrame:
    """A struct ``row`` of the columns ``keep`` (all), ``secrets``, by start and then in the order of the rules, and ``masked``, the
    text with secrets masked, null where there are none."""
    automaton = Automaton(tuple(rules))
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # its size is given by the rules
    kinds = pa.array([r.kind for r in rules])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        states = of.linked()
        for batch, texts in slices(batches, "text"):
            found = [spans_of(t, states, of) for t in texts]
            n = np.cumsum([0, *map(len, found)])
            flat = np.array([s for t, spans in zip(texts, found, strict=True) for s in in_code_points(t, spans)], np.int64).reshape(-1, 3)
            each = pa.StructArray.from_arrays([kinds.take(pa.array(flat[:, 2])), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["kind", "start", "end"])
            hidden = pa.array([masked(t, s, of.rules) if s else None for t, s in zip(texts, found, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(n, pa.int32()), each), hidden.cast(pa.string())], ["row", "secrets", "masked"])

    columns = docs.columns if keep is None else keep
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("secrets", SECRETS), T.StructField("masked", T.StringType())]))


def redacted(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """The documents, all columns, with their secrets masked."""
    found = scan(docs, text_col, rules)
    return found.select(*((F.coalesce("masked", F.col(f"row.`{c}`")) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def written(secrets: str) -> Column:
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """id, the number of spans of each base kind, the base spans' digest and all spans for every document."""
    base = F.array(*(F.lit(r.kind) for r in BASE))
    found = scan(docs, text_col, rules, [id_col]).select(F.col(f"row.`{id_col}`").alias(id_col), "secrets")
    found = found.withColumn("base", F.filter("secrets", lambda s: F.array_contains(base, s["kind"])))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *(count(r.kind) for r in BASE), F.sha2(written("base"), 256).alias("base_sha256"), written("secrets").alias("spans"))


def _kind_sql(rule: Rule, order: int, group: str) -> str:
    """A kind's spans: what lies between matches and the matches themselves, laid end to end. ``group``: the pattern's counted part."""
    p, counted = rule.pattern.replace("'", "''"), group.replace("'", "''")
    return f"""
  select r, {order} as k, '{rule.kind}' as kind, s from (select r, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
    a := length(array_to_string(gaps[1:i], '')) + length(array_to_string(m[1:i - 1], '')), n := length(m[i]), tail := length(tails[i])))) as s
  from (select r, string_split_regex(text, '{p}') as gaps, regexp_extract_all(text, '{p}') as m, regexp_extract_all(text, '{counted}', 1) as tails from split where regexp_matches(text, '{p}')))
  where s.tail >= {rule.least}"""


def oracle_sql() -> str:
    # The counted part of each pattern as its only group; of hex and of fixed texts it is enough to look for matches that are long enough.
    groups = {"pem": "(-)----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", "hex": "([0-9a-f]{32,})"}
    parts = []
    for order, rule in enumerate(BASE + MORE):
        pattern = "[0-9a-f]{32,}" if rule.kind == "hex" else rule.pattern
        head, bracket, tail = rule.pattern.rpartition("[")
        parts.append(_kind_sql(Rule(rule.kind, pattern, rule.least), order, groups.get(rule.kind, f"{head}({bracket}{tail})")))
    every = "\n  union all".join(parts)
    return f"""
with split as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), found as ({every}
), told as (
  select r, list(kind || ':' || s.a || ':' || (s.a + s.n) order by s.a, k) as spans, list(kind || ':' || s.a || ':' || (s.a + s.n) order by s.a, k) filter (where k < {len(BASE)}) as base,
    count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex
  from found group by r
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(array_to_string(base, ','), '')) as base_sha256, coalesce(array_to_string(spans, ','), '') as spans
from split left join told using (r)
"""
