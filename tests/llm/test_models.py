"""The trained operators: held-out accuracy, defined results, no use of what is held out."""

import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import _common, _features, language_id, quality, toxicity

SF = "/root/testdata/sf0.1"
rng = np.random.default_rng(11)


def auc(y, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    values = np.asarray(score)[order]
    starts = np.searchsorted(values, values, "left")
    ends = np.searchsorted(values, values, "right")
    rank[order] = (starts + ends + 1) / 2
    y = np.asarray(y)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def remainder(i, mod):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod


def corpus(n, sign, every=2):
    """One in ``every`` texts holds a few words of its own."""
    rng = np.random.default_rng(11)
    pairs, of = [], []
    for i in range(n):
        w = [f"w{x}" for x in rng.integers(0, 400, 40)]
        if i % every == 1:
            w[int(rng.integers(0, 40))] = sign[i % len(sign)]
            w[int(rng.integers(0, 40))] = sign[(i // 2) % len(sign)]
        pairs.append((i, " ".join(w)))
        of.append(int(i % every == 1))
    return pairs, of


def test_toxicity(docs, labels):
    pairs, toxic = corpus(2000, ["vile", "scum"], 6)
    df = docs(*pairs, (5000, None), (5001, ""), (None, "vile scum"), (7, "repeated id"), (5002, "vile " * 40_000), (5003, "one row twice"), (5003, "one row twice"))
    marks = labels(*((i, 1, t) for (i, _), t in zip(pairs, toxic, strict=True)), (7, 1, None), (8, 1, 9), (None, 1, 1))
    got = toxicity.report(df, marks).collect()
    assert len(got) == len(pairs) + 7 and all(r.held_out == (remainder(r.doc_id, 3) == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = {r.doc_id: r.score for r in got if r.held_out and r.doc_id is not None and r.doc_id < 5000}
    assert auc([toxic[i] for i in held], list(held.values())) > 0.98
    other = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {(r.doc_id, r.score) for r in toxicity.report(df.withColumns({"lang": F.lit("zz"), "source": F.lit("zz")}), other).collect()}
    assert again == {(r.doc_id, r.score) for r in got}  # held-out labels, lang and source don't matter
    kept = toxicity.clean(df, marks)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in got)


def test_quality(docs, labels):
    pairs, good = corpus(700, ["Indeed,", "therefore"])
    df = docs(*pairs, (5000, None), (5001, ""), (None, "x"), (5002, "BUY NOW " * 40_000), (3, "an id again"), (5003, "one row twice"), (5003, "one row twice"))
    marks = labels(*((i, g, 0) for (i, _), g in zip(pairs, good, strict=True)), (None, 1, 1), (3, None, 0))
    got = quality.report(df, marks).collect()
    assert len(got) == len(pairs) + 7 and all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = {r.doc_id: r.score for r in got if r.held_out and r.doc_id is not None and r.doc_id < 5000}
    assert auc([good[i] for i in held], list(held.values())) > 0.95
    kept = quality.good(df, marks)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)


def presence(text, bits, size=6, most=3):
    """The columns of one text, word by word."""
    words = [w for w in text.translate(_features.PLAIN).split()]
    starts = Counter(w[:size] for w in words if len(w) >= size)
    hashes = [xxhash.xxh64_intdigest(w) for w in set(words)]
    hashes += [(xxhash.xxh64_intdigest(w, 11) + k + 1) % 2**64 for w, n in starts.items() for k in range(min(n, most))]
    return np.unique((_common.mixed(np.array(hashes, np.uint64)) >> np.uint64(64 - bits)).astype(np.int32))


def test_words_of_a_run_of_texts_as_one_by_one():
    texts = ["", None, "One, two; ONE two-three", " \t\x0b", "signs signing signed signature signet", "Straße straßen-bahn \u00a0 é É", "a" * 9, "word " * 5000, "ünlösbar! x"]
    texts += [" ".join(rng.choice(["alphas", "alphabet", "beta", "Beta.", "gammas", "\n"], int(n))) for n in rng.integers(0, 60, 50)]
    for of in (pa.array(texts), pa.array(["cut off", *texts]).slice(1), pa.array(texts, pa.large_string()), pa.array([None, ""], pa.string()), pa.array([], pa.string())):
        offsets, at = _features.presence(_common.Words(_features.plain(of)), _common.WordHashes(), toxicity.beginnings(), 20)
        want = [presence((t or "").encode(), 20) for t in of.to_pylist()]
        assert [list(at[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)] == [list(w) for w in want]


def test_toxicity_as_by_a_dense_matrix(docs, labels):
    """The risk and its steps written out over a dense matrix of all rows: as many columns as there are, no counts of alike rows."""
    pairs, toxic = corpus(900, ["vilest", "scummy", "rotten"], 5)
    pairs += [(2000, None), (None, "vilest w1"), (3, "vilest under a repeated id"), (4, pairs[4][1])]
    marks = [(i, 1, t) for (i, _), t in zip(pairs, toxic, strict=False)]
    weights, bias = toxicity.train(docs(*pairs).repartition(5), labels(*marks), bits=16)
    label = {i: t for i, _, t in marks}
    rows = [(i, t) for i, t in pairs if remainder(i, 3) != 1]
    x = np.zeros((len(rows), 1 << 16))
    for row, (_, t) in zip(x, rows, strict=True):
        row[presence((t or "").encode(), 16)] = 1
    p = np.array([label.get(i) == 1 for i, _ in rows])
    known = [t for i, t in label.items() if remainder(i, 3) != 1]
    prior, often = np.mean(known), x.mean(axis=0)
    used = (x[p].sum(axis=0) > 3) & (x[p].sum(axis=0) - p.sum() * often > 3 * np.sqrt(p.sum() * often * (1 - often) + 1))
    x, w, g2 = np.c_[x[:, used], np.ones(len(rows))], np.r_[np.zeros(used.sum()), np.log(prior / (1 - prior))], 1e-4
    for _ in range(60):
        out = 1 / (1 + np.exp(-x @ w))
        of_clean = np.mean(-np.log(1 - out)) - prior * np.mean(-np.log(1 - out[p]))
        grad = (out @ x) / len(x) - prior * (out[p] @ x[p]) / p.sum()
        grad = grad - prior * ((1 - out[p]) @ x[p]) / p.sum() if of_clean >= 0 else -grad
        g2 = g2 + grad**2
        w = w - 2 / np.sqrt(g2) * grad
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - 2 / np.sqrt(g2[:-1]) * 1e-5, 0)
    assert used.sum() > 2 and set(np.flatnonzero(weights)) <= set(np.flatnonzero(used))
    assert np.allclose(weights[used], w[:-1], atol=1e-3) and bias == pytest.approx(w[-1], abs=1e-3)


def test_toxicity_is_the_same_model_however_rows_lie(docs, labels):
    pairs, toxic = corpus(400, ["vile"], 4)
    marks = labels(*((i, 1, t) for (i, _), t in zip(pairs, toxic, strict=True)))
    a, b = (toxicity.train(docs(*pairs).repartition(n), marks) for n in (2, 9))
    assert a[1] == b[1] and np.array_equal(a[0], b[0]) and a[0].any()


def test_quality_as_by_a_plain_loop(docs, labels):
    """FTRL-proximal as published, a weight at a time in dictionaries, over the rows in the order of the sample."""
    pairs, good = corpus(120, ["Indeed,"])
    known = [(i, g) for (i, _), g in zip(pairs, good, strict=True) if remainder(i, 5)]
    weights, bias = quality.train(docs(*pairs), labels(*((i, g, 0) for (i, _), g in zip(pairs, good, strict=True))), bits=16)
    spark = docs().sparkSession
    order = [r[0] for r in spark.createDataFrame(known, "doc_id long, y int").orderBy(F.xxhash64("doc_id")).collect()]
    z, n, bias_plain, b2, label = {}, {}, 0.0, 1.0, dict(known)

    def weight(i):
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= 0.5 else (np.sign(a) * 0.5 - a) / ((1.0 + n.get(i, 0.0) ** 0.5) / 2.0 + 1.0)

    for _ in range(3):
        for doc in order:
            at, x = quality.ngrams(pairs[doc][1].encode(), quality.WordHashes(), quality.Shapes(), 16)
            g = 1 / (1 + np.exp(-(bias_plain + sum(weight(i) * float(v) for i, v in zip(at.tolist(), x, strict=True))))) - label[doc]
            ws = {i: weight(i) for i in at.tolist()}
            before = dict(n)
            for i, v in zip(at.tolist(), x, strict=True):
                step = (g * float(v)) ** 2
                n[i] = max(n.get(i, 0.0), before.get(i, 0.0) + step)
                z[i] = z.get(i, 0.0) + g * float(v) - ((before.get(i, 0.0) + step) ** 0.5 - before.get(i, 0.0) ** 0.5) / 2.0 * ws[i]
            b2 += g * g
            bias_plain -= g / b2**0.5
    # A word and a shape that share a bucket are two values of one weight; 16 bits and 40 words leave few of them.
    wanted = np.zeros(1 << 16)
    for i in z:
        wanted[i] = weight(i)
    assert np.count_nonzero(wanted) > 10 and np.allclose(weights, wanted, atol=1e-2) and bias == pytest.approx(bias_plain, abs=1e-2)


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_no_labels_and_no_rows(docs, labels, operator):
    scores = [r.score for r in operator.report(docs((1, "a b"), (2, None)), labels()).collect()]
    assert scores == [0.5, 0.5]
    assert operator.report(docs(), labels((1, 1, 1))).collect() == []


def test_sample_bound_takes_the_same_documents(docs, labels):
    pairs, y = corpus(200, ["vile"])
    marks = labels(*((i, t, t) for (i, _), t in zip(pairs, y, strict=True)))
    a = quality.train(docs(*pairs).repartition(7), marks, max_rows=50)
    b = quality.train(docs(*pairs).repartition(2), marks, max_rows=50)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_languages(spark):
    def text(letters, n):
        return " ".join("".join(rng.choice(list(letters), int(k))) for k in rng.integers(2, 8, n))

    kinds = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "éèàçabc"}
    rows = [(i, text(kinds[lang], 30), lang) for i, lang in enumerate(list(kinds) * 60)]
    rows += [(1000, None, "aa"), (1001, "123 !?", "bb"), (1002, "", None), (1003, "had " * 50_000, None), (None, "abcabc", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("word", F.lit(1))
    got = language_id.report(df).collect()
    assert len(got) == len(rows) and all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)
    assert np.mean([by[i].lang_pred == lang for i, _, lang in rows[:180] if by[i].held_out]) > 0.95
    assert language_id.report(df.limit(0)).collect() == []
    assert {r.lang_pred for r in language_id.report(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    far = language_id.identify(spark.createDataFrame([(1, "zzzz qqqq xxxx wwww")], "doc_id long, text string"), language_id.train(df), ["doc_id"]).first()
    assert not far.accepted  # rejection: nothing like it was learned


def test_kneser_ney_is_a_distribution(spark):
    rows = [(i, "abab abba baba cab", "aa") for i in range(4)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), hash_bits=30)
    m = model["models"]["aa"]
    alphabet = ["a", "b", "c", language_id.END]
    for context in ("", "a", "ab", "ba"):
        word, place, orders = language_id.spelled([context + x.replace(language_id.END, "") for x in alphabet], 4)
        logs = m.log_probs(orders, model["mask"])
        total = sum(np.exp(logs[(word == i) & (place == len(context) + 1)][0]) for i in range(len(alphabet)))
        assert total == pytest.approx(1, abs=0.06)  # what is missing lies with characters never seen


def plain_kneser_ney(texts, order=4):
    """ln p(character | word so far) of interpolated Kneser-Ney from the formulas, with n-grams as strings in dictionaries."""
    seen, counts = Counter(w for t in texts for w in language_id.words_of(t.encode())), [Counter() for _ in range(order + 1)]
    for w, n in seen.items():
        w = language_id.START + w + language_id.END
        for k in range(1, order + 1):
            for i in range(max(1, k - 1), len(w)):
                counts[k][w[i - k + 1 : i + 1]] += n
    used = [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        before = Counter(gram[1:] for gram in counts[k + 1]) if k < order else {}
        for gram, n in counts[k].items():
            used[k][gram] = n if k == order or gram[0] == language_id.START else before.get(gram, n)

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(used[1]) + 1)
        ones, twos = (sum(c == x for c in used[k].values()) for x in (1, 2))
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        of = [c for g, c in used[k].items() if g[:-1] == gram[:-1]]
        if not of:
            return p(gram[1:])
        return max(used[k][gram] - discount, 0) / sum(of) + min(1, discount * len(of) / sum(of)) * p(gram[1:])

    return lambda word: [np.log(p((language_id.START + word + language_id.END)[max(0, i - order + 1) : i + 1])) for i in range(1, len(word) + 2)]


def test_kneser_ney_as_by_the_formulas(spark):
    rng = np.random.default_rng(8)
    make = lambda letters: " ".join("".join(letters[j] for j in rng.integers(0, len(letters), int(rng.integers(1, 7)))) for _ in range(12))
    rows = [(i, make("abcdé" if i % 2 else "cdefg"), "xy"[i % 2]) for i in range(30)] + [(None, "abba 12 abba", "x"), (3, "", "y"), (4, None, "x")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = ["a", "abcd", "gggggggg", "zabz", "édcba", "cdefgcd", "q"]
    word, _, orders = language_id.spelled(asked, 4)
    logs = model["models"].log_probs(orders, model["mask"])
    for i, lang in enumerate(model["langs"]):
        plain = plain_kneser_ney([t or "" for _, t, own in rows if own == lang])
        for j, w in enumerate(asked):
            assert np.allclose(logs[word == j, i], plain(w), atol=1e-9)


def test_kneser_ney_of_many_ngrams_as_in_production(spark):
    rng = np.random.default_rng(5)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    rows = [(i, " ".join("".join(letters[j] for j in rng.integers(0, 3000, 4)) for _ in range(250)), "zz") for i in range(80)]
    rows += [(1000 + i, "abab abba baba cab", "aa") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    m = model["models"]["zz"]
    assert len(m.grams[3][0]) > 50_000
    # Each n-gram is over its own context: no probability above one, and those of a context sum to one less its mass.
    assert all(p.max() <= 1 for _, p in m.grams)
    word, place, orders = language_id.spelled([w for _, t, lang in rows if lang == "zz" for w in t.split()], 4)
    for (gram, context, _, there), (g_at, g_p), (c_at, c_w) in zip(orders, m.grams, m.contexts, strict=True):
        found, first = np.unique(gram[there].view(np.int64), return_index=True)
        assert np.array_equal(found, g_at)
        _, inverse = np.unique(context[there].view(np.int64)[first], return_inverse=True)
        assert np.allclose(np.bincount(inverse, g_p) + c_w, 1)
    unseen = language_id.spelled(["".join(letters[j] for j in rng.integers(0, 3000, 4)) for _ in range(2000)], 4)[2]
    assert np.isin(unseen[3][0].view(np.int64), m.grams[3][0]).mean() < 0.6 and not np.isin(unseen[2][0][unseen[2][3]].view(np.int64), m.grams[2][0]).all()


def test_languages_by_joins_as_by_broadcast(spark):
    rng = np.random.default_rng(6)
    make = lambda letters: " ".join("".join(letters[j] for j in rng.integers(0, len(letters), int(rng.integers(1, 8)))) for _ in range(20))
    rows = [(i, make("abcde" if i % 2 else "cdefg"), "xy"[i % 2]) for i in range(120)]
    rows += [(None, rows[0][1], "x"), (0, "other text of a repeated id", None), (500, None, "x"), (501, "12 !", "y"), (502, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    broadcast, joined = language_id.train(df), language_id.train(df, most=10)
    assert joined["models"] is None and joined["sharpness"] == broadcast["sharpness"] and np.allclose(joined["limits"], broadcast["limits"])
    order = lambda out: sorted(((str(r.doc_id), r.lang_pred, round(r.score, 9), r.accepted) for r in out.collect()))
    got = order(language_id.identify(df, joined, ["doc_id"]))
    assert len(got) == len(rows) and got == order(language_id.identify(df, broadcast, ["doc_id"]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out_accuracy_on_the_tables(spark):
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r for r in marks.collect()}
    for operator, name, least in ((toxicity, "toxic", 0.97), (quality, "quality", 0.99)):
        held = [r for r in operator.report(docs, marks).collect() if r.held_out and r.doc_id in known]
        assert auc([known[r.doc_id][name] for r in held], [r.score for r in held]) > least
