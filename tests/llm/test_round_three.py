"""Whitening, resampling and secret scans against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import resampling, secret_scan, whitening
from millrace.llm._common import Words, stash

VECTORS = "vec_id long, embedding array<float>, label int"


def whitened_by_hand(rows, most=16):
    """(id, component) -> (n, deviation, |whitened|, explained), of the rows of one length."""
    good = [(i, [math.floor(64 * float(np.float32(v))) + 1_000_000 for v in e]) for i, e in rows]
    once = sorted({tuple(x) for _, x in good})
    n, sums = len(once), [sum(c) for c in zip(*once, strict=True)]
    y = np.array([[(n * v - s) / n for v, s in zip(x, sums, strict=True)] for x in once])
    e, vectors = np.linalg.eigh(y.T @ y / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    out = {}
    for at, (i, x) in enumerate(good):
        off = np.array([(n * v - s) / n for v, s in zip(x, sums, strict=True)])
        for k in range(min(most, len(sums))):
            out[at, i, k + 1] = n, sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)), abs(off @ vectors[:, k]) / math.sqrt(e[k]), e[k] / e.sum()
    return out


@pytest.mark.parametrize(("dim", "tile"), [(7, 3), (20, 32), (20, 6)])
def test_whitening(spark, dim, tile):
    rng = np.random.default_rng(dim)
    mixed = rng.standard_normal((200, dim)) @ rng.standard_normal((dim, dim)) + 3 * rng.standard_normal(dim)
    rows = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(mixed)]
    rows += [(1000, rows[3][1]), (3, rows[3][1]), (None, rows[5][1])]
    odd = [(2000, None, 1), (2001, [], 1), (2002, [float("nan")] * dim, 1), (2003, [None] + [1.0] * (dim - 1), 1), (2004, [float("inf")] * dim, 1)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows] + odd, VECTORS).withColumns({"id": F.lit("x"), "x": F.lit(1), "n": F.lit(2)})
    got = whitening.whiten(df.repartition(3), tile=tile).collect()
    want = whitened_by_hand(rows)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    found = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=key)
    hand = sorted(((i, k, *v) for (_, i, k), v in want.items()), key=key)
    assert len(found) == len(hand) == len(rows) * min(16, dim)
    assert [r[:4] for r in found] == [r[:4] for r in hand]
    np.testing.assert_allclose([r[4:] for r in found], [r[4:] for r in hand], rtol=1e-7, atol=1e-9)
    assert {r["identity_error"] for r in got}.__len__() == 1 and got[0]["identity_error"] < 1e-9
    # One sign for each component: the same vector has the same numbers.
    of = {}
    for r in got:
        of.setdefault((r["vec_id"], r["component"]), set()).add(r["whitened"])
    assert all(of[3, k] == of[1000, k] and len(of[3, k]) == 1 for k in range(1, min(16, dim) + 1))


def test_whitening_of_few_and_odd_vectors(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert make([]) == [] and make([(1, None, 0)]) == []
    alone = make([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(alone)] == [(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]
    flat = {(r["vec_id"], r["component"]): r for r in make([(i, [float(i), 5.0], 0) for i in range(4)] + [(9, [1.0], 0), (10, [2.0], 0), (11, [4.0], 0)])}
    assert flat[0, 2]["whitened"] is None and abs(flat[0, 1]["whitened"]) == pytest.approx(1.5 / math.sqrt(1.25)) and flat[0, 1]["explained"] == 1
    assert flat[9, 1]["n"] == 3 and flat[0, 1]["n"] == 4 and flat[9, 1]["identity_error"] < 1e-9
    far = make([(i, [3e38 * (-1) ** i, float(i)], 0) for i in range(3)])
    assert len(far) == 6 and {r["deviation"] for r in far} == {2**63 - 1}


def test_column_sums_are_exact(spark):
    rows = [([2**62 - i, -(2**61) + i],) for i in range(50)]
    assert whitening.column_sums(spark.createDataFrame(rows, "x array<long>").repartition(4)) == {2: (50, [sum(r[0][k] for r in rows) for k in range(2)])}


def resampled_by_hand(docs, target, buckets, longest, share, least, seed):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    of = lambda t: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for w in [words(t)] for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    s, t = ([0] * buckets for _ in range(2))
    for _, text in docs:
        for b in of(text):
            s[b] += 1
    for text in target:
        for b in of(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in of(text))
        rows.append((i, len(of(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(text))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {}
    for k, r in enumerate(able[: share[0] * len(able) // share[1]], 1):
        rank.setdefault(r[:4], []).append(k)
    return sorted((*r[:4], rank[r[:4]].pop(0) if r[4] >= least and rank.get(r[:4]) else None) for r in rows if r[0] is not None), sum(map(len, rank.values()))


@pytest.mark.parametrize(("buckets", "longest"), [(10_000, 1), (50, 1), (97, 3)])
def test_resampling(spark, docs, buckets, longest):
    rng = np.random.default_rng(4)
    vocabulary = ["apple", "Été", "x1", "42", "don't", "naïve", "a-b", "ΩΣ", "zebra", "ÀÉ", "l m", "\0nul"]
    rows = [(i, "  ".join(rng.choice(vocabulary, int(rng.integers(0, 12))))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "apple " * 5000), (7, rows[7][1]), (7, rows[7][1])]
    target = ["apple Zebra zebra", None, "", "Été x1", "novel words"]
    share, least = (25, 100), 4
    got = resampling.resample(docs(*rows).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), buckets=buckets, longest=longest, share=share, least_words=least)
    want, _ = resampled_by_hand(rows, target, buckets, longest, share, least, "2024")
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], repr(r))) == sorted(want, key=lambda r: (r[0], repr(r)))


def test_resampling_of_odd_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs(), none).collect() == []
    rows = [(None, "one two three"), (None, "one two three"), (1, "one")]
    got = resampling.resample(docs(*rows), none, share=(1, 1), least_words=2).collect()
    assert sorted((r["doc_id"] is None, r["rank"] or 0) for r in got) == [(False, 0), (True, 1), (True, 2)]


def test_features_of_runs(spark):
    import pyarrow as pa

    words = Words(pa.array(["a b a b", "", "b a"]))
    row, code, names = resampling.features(words, 3)
    found = sorted((int(r), names[c]) for r, c in zip(row, code, strict=True))
    assert found == sorted([(0, b"a"), (0, b"b"), (0, b"a"), (0, b"b"), (0, b"a b"), (0, b"b a"), (0, b"a b"), (0, b"a b a"), (0, b"b a b"), (2, b"b"), (2, b"a"), (2, b"b a")])


# --- secrets ------------------------------------------------------------------------------------


def secrets_by_hand(text, rules):
    """Leftmost matches by the library's own search, a rule at a time; the counted part is the longest end of the pattern's last piece."""
    out = []
    for k, rule in enumerate(rules):
        head, bracket, tail = rule.pattern.rpartition("[")
        counted = rule.pattern if rule.kind == "pem" else f"{head}({bracket}{tail})"
        for m in re.finditer(counted, text):
            if rule.kind == "pem" or len(m[1]) >= rule.least:
                out.append((m.start(), k, f"{rule.kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


PIECES = [
    "password", "PassWd", "secret", "TOKEN", "api_key", "ApiKey", "\"", "'", " ", "  ", ":", "=", "==", "abcdefg", "abcdefgh", "a1+/_.=-", "AKIA", "AKIA0123456789AB", "0123456789AB",
    "0123456789abcdef" * 2, "deadbeef" * 5, "\n", "é", "ſ", "K", "ghp_", "A" * 36, "xoxb-", "12345-67890", "AIza", "x_-" * 12, "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-", "passw", "tok", "\0", "日本",
]


def test_secrets_of_random_texts():
    rng = np.random.default_rng(13)
    rules = secret_scan.BASE + secret_scan.MORE
    automaton = secret_scan.Automaton(rules)
    states = automaton.linked()
    found = 0
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES, int(rng.integers(1, 14))))
        raw = text.encode()
        got = [f"{rules[r].kind}:{a}:{b}" for a, b, r in secret_scan.in_code_points(raw, secret_scan.spans_of(raw, states, automaton))]
        assert got == secrets_by_hand(text, rules), text
        found += len(got)
    assert found > 5_000


def test_contract_pattern_is_the_rule():
    """The dealt expression, letters of its key words in either case, finds what the rule finds."""
    dealt = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    rng = np.random.default_rng(14)
    for _ in range(5_000):
        text = "".join(rng.choice(PIECES, int(rng.integers(1, 10)))).replace("ſ", "").replace("K", "")
        want = [f"assign:{m.start()}:{m.end()}" for m in dealt.finditer(text) if len(m[2]) >= 8]
        assert secrets_by_hand(text, secret_scan.BASE[:1]) == want


def test_minimised_automaton_is_smaller_and_the_same():
    machine = secret_scan.Machine(secret_scan.BASE[0])
    automaton = secret_scan.Automaton(secret_scan.BASE[:1])
    text = "a token = 'abc' secret:abcdefgh9 tokentoken=xyz_xyz_xyz password "
    state, at = machine.start, 0
    for byte in text.encode():
        state, at = machine.step(state, byte), automaton.next[at, automaton.classes[byte]]
        assert automaton.says[at] == ((machine.says(state),), (machine.live(state),))
    assert len(automaton.next) < 120


@pytest.mark.parametrize("pattern", ["a*", "ab(?:cd)*", "(?:ab|b*c)d", "é", "[^a]", "a(?=b)", r"\d"])
def test_rules_that_one_pass_cannot_scan(pattern):
    if pattern == "(?:ab|b*c)d":
        secret_scan.Automaton((secret_scan.Rule("x", pattern),))
        return
    with pytest.raises(ValueError):
        secret_scan.Automaton((secret_scan.Rule("x", pattern),))


def test_secret_report(spark, docs):
    rules = secret_scan.BASE + secret_scan.MORE
    rng = np.random.default_rng(15)
    rows = [(i, "".join(rng.choice(PIECES, 12))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "token=abcdefgh"), (7, rows[7][1]), (102, "é" * 70_000 + " secret: 'abcdefgh'" + "f" * 70_000), (103, "no secrets here")]
    got = sorted(map(tuple, secret_scan.report(docs(*rows).repartition(3)).collect()), key=repr)
    want = []
    for i, text in rows:
        spans = secrets_by_hand(text or "", rules)
        base = [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")]
        counts = [sum(s.startswith(f"{k}:") for s in spans) for k in ("assign", "access", "hex")]
        want.append((i, *counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spans)))
    assert got == sorted(want, key=repr)
    assert secret_scan.report(docs()).collect() == []


def test_redacted(spark, docs):
    rows = [(1, "é token = 'abcdefgh' and " + "0" * 40), (2, None), (3, "clean"), (4, "secret=" + "a" * 32)]
    got = {r["doc_id"]: r for r in secret_scan.redacted(docs(*rows)).collect()}
    assert got[1]["text"] == "é [assign]' and [hex]" and got[2]["text"] is None and got[3]["text"] == "clean" and got[4]["text"] == "[assign]"
    assert got[1]["row"] == "own" and got[1]["id"] == 7


# --- packing and bytes ----------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "low", "high", "most"), [(900, 1100, 1800, 345), (1500, 900, 2100, 576)])
def test_packing_beats_best_fit_where_that_misses_the_bound(n, low, high, most):
    import random
    from collections import Counter

    from millrace.llm import packing

    rng = random.Random(1)
    counts = dict(Counter(rng.randint(low, high) for _ in range(n)))
    plan = packing.bin_completion(counts, 4096)
    used = Counter()
    for fill, times in plan:
        assert sum(fill) <= 4096
        for size in fill:
            used[size] += times
    sequences = sum(times for _, times in plan)
    assert used == Counter(counts)
    assert packing.fewest_sequences(counts, 4096) <= sequences <= most < sum(t for _, t in packing.best_fit_decreasing(counts, 4096))


def test_equal_pieces_are_dealt_apart_and_options_reach_the_search(spark):
    from millrace.llm import packing

    rows = [(None, 0, 0, 1, 7)] * 300 + [(i, 0, 0, 5, i) for i in range(40)]
    pieces = spark.createDataFrame(rows, "id long, piece int, start long, length int, ids_crc32 long").repartition(4).withColumn("_deal", F.monotonically_increasing_id())
    out = packing.pack(stash(pieces, "pieces"), 16, "_deal", steps=None).collect()
    assert len(out) == 340 and "_deal" not in out[0].asDict()
    taken = {}
    for r in out:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in taken.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 16
    assert len(taken) == math.ceil((300 + 200) / 16)


def test_kept_words_keep_their_bytes(spark):
    from millrace.llm import substring_dedup

    raw = [b"ok " + bytes([0xFF, 0xC3]) + b" w", b"plain words"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    got = {r["doc_id"]: r["kept_sha256"] for r in substring_dedup.removal_report(df).collect()}
    assert got == {i: hashlib.sha256(b).hexdigest() for i, b in enumerate(raw)}
