"""Lexical, semantic and hybrid ranking over a table of documents.

Scores come from joins and sums on tokens, so a query meets only documents that have its tokens; document
frequencies and lengths are counted over all documents. BM25 takes k1 = 1.2 and b = 0.75.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import squish
from ..functions.vectors import cosine_distance
from ..session import stashed
from ..sources.files import _pieces

K1, B, RRF = 1.2, 0.75, 60
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def tokens(c: Column, fold: bool = False) -> Column:
    """Lower-cased runs of letters and digits in order; ``fold``: without accents."""
    text = F.lower(F.coalesce(c, F.lit("")))
    text = F.translate(text, *ACCENTS) if fold else text
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def has_tokens(c: Column, query: str, how: str = "all_tokens") -> Column:
    """All tokens, any token, or the phrase (the tokens one after the other), on a column of ``tokens``."""
    wanted = words_of(query)
    if how == "any_tokens":
        return F.arrays_overlap(c, F.array(*(F.lit(w) for w in wanted)))
    if how == "phrase":
        return F.contains(F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" ")), F.lit(f" {' '.join(wanted)} "))
    return F.size(F.array_except(F.array(*(F.lit(w) for w in dict.fromkeys(wanted))), c)) == 0


def bm25(documents: DataFrame, query: str, id_col: str, text_col: str, how: str = "all_tokens", limit: int | None = None) -> DataFrame:
    """(id, score) of the documents that match, best first, ties to the smaller id.

    Counts of the query's tokens are taken per document in the scan: no token table is shuffled, and only one
    row of totals is aggregated. The scan's few numbers a document are written, so texts are cut into tokens once.
    For many queries of one corpus, or large ones, ``postings`` has a table that never reads texts again.
    """
    wanted = list(dict.fromkeys(words_of(query)))
    if not wanted:
        raise ValueError("the query has no token")
    held = documents.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("_t"))
    counts = [F.size(F.filter("_t", _equals(w))).alias(f"_f{i}") for i, w in enumerate(wanted)]
    rows = stashed(held.select("id", F.size("_t").alias("_len"), has_tokens(F.col("_t"), query, how).alias("_hit"), *counts), "bm25")
    totals = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_df{i}") for i in range(len(wanted))))
    joined = rows.where("_hit").join(F.broadcast(totals))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        score = score + idf * F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    ranked = joined.select(F.col("id").alias(id_col), score.alias("score"))
    return ranked if limit is None else ranked.orderBy(F.desc("score"), id_col).limit(limit)


def _equals(word: str):
    return lambda t: t == word


def nearest(documents: DataFrame, query: list[float], id_col: str, vec_col: str, limit: int, most: float | None = None) -> DataFrame:
    """(id, distance): the ``limit`` nearest by cosine, ties to the smaller id; then those beyond ``most`` go.

    The threshold comes after the limit, so fewer rows may be left. Rows without a distance have none.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = documents.select(F.col(id_col), cosine_distance(F.col(vec_col), q).alias("distance")).where("distance is not null")
    cut = rows.orderBy("distance", id_col).limit(limit)
    return cut if most is None else cut.where(F.col("distance") <= most)


def fused(rankings: list[DataFrame], id_col: str, limit: int) -> DataFrame:
    """Reciprocal ranks of rankings (id, rank from 1) added up; ties to the smaller id."""
    every = rankings[0].select(id_col, "rank")
    for r in rankings[1:]:
        every = every.union(r.select(id_col, "rank"))
    scores = every.groupBy(id_col).agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"))
    return scores.orderBy(F.desc("score"), id_col).limit(limit)


def hybrid(documents: DataFrame, text: str, vector: list[float], id_col: str, text_col: str, vec_col: str, most: float, limit: int, how: str = "all_tokens", digits: int = 12) -> DataFrame:
    """The two rankings, each cut to ``limit``, fused. Scores and distances that agree to ``digits`` digits are ties."""
    lexical = bm25(documents, text, id_col, text_col, how).withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), id_col).limit(limit)
    semantic = nearest(documents, vector, id_col, vec_col, limit).withColumn("distance", F.round("distance", digits)).where(F.col("distance") <= most)
    # A ranking has ``limit`` rows at most, so one task ranks it.
    place = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return fused([place(lexical, F.desc("score"), id_col), place(semantic, "distance", id_col)], id_col, limit)


def filter_only(documents: DataFrame, where: Column, limit: int) -> DataFrame:
    return documents.where(where).orderBy("index_sequence").limit(limit)


def run(documents: DataFrame, definition: dict, where: Column, limit: int, embed=None, how: str | None = None) -> DataFrame:
    """A definition in its mode, over ``documents`` (id, content_en, content_fr, embedding, index_sequence, ..)."""
    mode, text = definition.get("mode") or "filter_only", str(definition.get("text") or "").strip()
    column = "content_fr" if definition.get("language") == "fr" else "content_en"
    how = how or definition.get("lexical_match") or "all_tokens"
    found = documents.where(where)
    if mode == "filter_only":
        return filter_only(found, F.lit(True), limit)
    if mode == "lexical":
        return bm25(found, text, "id", column, how, limit)
    if mode == "semantic":
        return nearest(found, embed(text), "id", "embedding", limit, definition["semantic_max_distance"])
    return hybrid(found, text, embed(text), "id", column, "embedding", definition["semantic_max_distance"], limit, how)


def embedding_text(*parts: Column) -> Column:
    """Title, fields, summary and content as one text."""
    return F.concat_ws("\n\n", *(F.when(squish(p) != "", p) for p in parts))


def highlighted(text: Column, words: list[str]) -> Column:
    """A text as segments (text, match): runs of letters and digits that equal one of ``words``, accents and case aside."""
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    wanted = F.transform(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.translate(w, *ACCENTS))
    return F.transform(parts, lambda p: F.struct(p.alias("text"), F.array_contains(wanted, F.translate(F.lower(p), *ACCENTS)).alias("match")))


#: Runs of letters and digits. Ideographs newer than Unicode 15.0, which other engines don't have as letters yet, are none.
WORD = re.compile("([^\\W_\U0002ebf0-\U0002ee5d]+)")


class _Forms(dict):
    """Words as texts have them to the folded word, if a query has it, else None; remembered for up to ``limit`` words."""

    def __init__(self, wanted: set[str], limit: int = 200_000):
        self.wanted, self.limit, self.fold = wanted, limit, str.maketrans(*ACCENTS)

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.limit:
            self.clear()
        folded = word.lower().translate(self.fold)
        value = self[word] = folded if folded in self.wanted else None
        return value


class _Matcher:
    """Finds the words and phrases of all queries in one walk over a text's words: entries are a tree by word, which is
    gone down only from words that some query has. An entry of several words is a phrase, whatever stands between them."""

    def __init__(self, queries: dict[str, list[str]]):
        self.count, self.tree, wanted = len(queries), {}, set()
        for number, words in enumerate(queries.values()):
            for entry in words:
                folded = [w for w in re.split(r"[\W_]+", entry.lower().translate(str.maketrans(*ACCENTS))) if w]
                node = self.tree
                for word in folded:
                    node = node.setdefault(word, {})
                if folded:
                    node.setdefault("", set()).add(number)  # no word is empty
                wanted.update(folded)
        # Lower case and folding leave lengths as they are, but for a letter that becomes one with a mark, which no entry's word has.
        self.forms, self.lengths = _Forms(wanted), {len(w) for w in wanted}

    def __call__(self, text: str) -> tuple[list[str], list[list[int]]]:
        """(parts: every second one, from the second, is a word; by query, the places of its words among them)."""
        parts = WORD.split(text)
        forms, lengths = self.forms, self.lengths
        folded = [forms[word] if len(word) in lengths else None for word in parts[1::2]]
        found: list[set[int]] = [set() for _ in range(self.count)]
        for first, word in enumerate(folded):
            if word is None:
                continue
            node, at = self.tree.get(word), first
            while node is not None:
                for number in node.get("", ()):
                    found[number].update(range(2 * first + 1, 2 * at + 2, 2))
                at += 1
                node = node.get(folded[at]) if at < len(folded) else None
        return parts, [sorted(of) for of in found]


def marked_batch(passages: DataFrame, queries: dict[str, list[str]], text: str = "text", before: str = "<", after: str = ">") -> DataFrame:
    """Each passage's other columns and each query (``position``, from 1 in the order of ``queries``, and ``query``), with the number of words that
    match and the text with marks around each (``matches``, ``marked``): ``highlight_batch`` written out. A null text gives nulls."""
    rows = passages.select(F.struct(*(c for c in passages.columns if c != text)).alias("row"), F.col(text).alias("text"))
    names = list(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _Matcher(queries)
        for batch in (piece for whole in batches for piece in _pieces(whole, "text")):
            matches, marked = [], []
            for given in batch.column(1).to_pylist():
                parts, found = ([], [()] * len(names)) if given is None else match(given)
                for places in found:
                    shown = list(parts) if places else ()
                    for at in places:
                        shown[at] = f"{before}{shown[at]}{after}"
                    matches.append(None if given is None else len(places))
                    marked.append("".join(shown) if places else given)
            n, every = batch.num_rows, np.arange(batch.num_rows * len(names))
            columns = [batch.column(0).take(pa.array(every // max(len(names), 1))), pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), n)), pa.array(names * n, pa.string()), pa.array(matches, pa.int64()), pa.array(marked, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "position", "query", "matches", "marked"])

    fields = [rows.schema["row"], T.StructField("position", T.IntegerType()), T.StructField("query", T.StringType()), T.StructField("matches", T.LongType()), T.StructField("marked", T.StringType())]
    return rows.mapInArrow(run, T.StructType(fields)).select("row.*", "position", "query", "matches", "marked")


def highlight_batch(passages: DataFrame, queries: dict[str, list[str]], text: str = "text") -> DataFrame:
    """Each passage and query (columns ``position``, from 1 in the order of ``queries``, and ``query``) with its segments: what
    ``highlighted`` gives query by query, and phrases. A null text gives null segments."""
    rows = passages.select(F.struct(*passages.columns).alias("row"), F.col(text).alias("text"))
    count = len(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _Matcher(queries)
        for batch in (piece for whole in batches for piece in _pieces(whole, "text")):
            pieces, marks, sizes = [], [np.zeros(0, bool)], []
            for given in batch.column(1).to_pylist():
                parts, found = ([], [()] * count) if given is None else match(given)
                flags = np.zeros((count, len(parts)), bool)
                for number, places in enumerate(found):
                    flags[number, places] = True
                kept = [k for k, part in enumerate(parts) if part]  # a text may begin or end with a word
                pieces.append(None if given is None else [parts[k] for k in kept])
                marks.append(flags[:, kept].ravel())
                sizes += [len(kept)] * count
            flags = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(marks)))
            each = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * count, pa.int32()), flags)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.list_(pa.string())), each], ["row", "pieces", "marks"])

    fields = [rows.schema["row"], T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("marks", T.ArrayType(T.ArrayType(T.BooleanType())))]
    each = rows.mapInArrow(run, T.StructType(fields)).select("row", "pieces", F.posexplode("marks").alias("_k", "_at"))
    segments = F.transform("pieces", lambda p, i: F.struct(p.alias("text"), F.get("_at", i).alias("match")))
    names = F.array(*(F.lit(q) for q in queries))
    return each.select("row.*", (F.col("_k") + 1).alias("position"), F.get(names, F.col("_k")).alias("query"), segments.alias("segments"))


def passage_condition(query: dict | str, c: Column) -> Column:
    """A transcript query on a column of folded ``tokens``: nested ``{"and"|"or": [..]}``, ``{"not": ..}``, or a text:
    one word (a trailing ``*`` matches its continuations) or a phrase."""
    if isinstance(query, dict):
        ((op, children),) = query.items()
        if op == "not":
            return ~passage_condition(children, c)
        out = None
        for child in children:
            part = passage_condition(child, c)
            out = part if out is None else out & part if op == "and" else out | part
        return out
    folded = query.lower().translate(str.maketrans(*ACCENTS))
    if folded.endswith("*"):
        prefix = folded[:-1]
        return F.exists(c, lambda t: t.startswith(prefix))
    return F.contains(F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" ")), F.lit(f" {' '.join(words_of(folded))} "))


def transcripts(passages: DataFrame, tracks: DataFrame, query: dict | str, language: str | None = None, stream_id=None, starts_at=None, ends_at=None) -> DataFrame:
    """Published caption passages that match, with their track, in no order."""
    kept = tracks.where("kind = 'captions'")
    kept = kept if language is None else kept.where(F.col("language") == language)
    kept = kept if stream_id is None else kept.where(F.col("media_stream_id") == stream_id)
    rows = passages.where("state = 'published'").where(passage_condition(query, tokens(F.col("text"), fold=True)))
    rows = rows if starts_at is None else rows.where(F.col("ends_at") > starts_at)
    rows = rows if ends_at is None else rows.where(F.col("starts_at") < ends_at)
    return rows.join(kept.select(F.col("id").alias("media_track_id"), "language", "media_stream_id"), "media_track_id")
