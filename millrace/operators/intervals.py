"""Half-open intervals: overlaps, gaps, sessions and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overlap_join(a: DataFrame, b: DataFrame, bucket: float, start: str = "start", end: str = "end", other_start: str = "b_start", other_end: str = "b_end", on: list[str] = ()) -> DataFrame:
    """All pairs with ``a.start < b.end and a.end > b.start``.

    Numbers are cut into buckets of about an interval's length and joined on them; a pair is kept in the first
    bucket that both touch, so nothing has to be made distinct.
    """
    at = lambda c: F.floor(c / bucket).cast("bigint")
    spread = lambda df, s, e: df.where(F.col(s) < F.col(e)).withColumn("_bucket", F.explode(F.sequence(at(F.col(s)), at(F.col(e)))))
    pairs = spread(a, start, end).join(spread(b, other_start, other_end), [*on, "_bucket"])
    meets = (F.col(start) < F.col(other_end)) & (F.col(end) > F.col(other_start))
    return pairs.where(meets & (F.col("_bucket") == at(F.greatest(start, other_start)))).drop("_bucket")


def clip(cues: DataFrame, begin: Column, finish: Column, start: str = "start", end: str = "end", rebase: bool = True) -> DataFrame:
    """Cues cut to ``[begin, finish)``; what has no length left goes."""
    cut = cues.withColumns({start: F.greatest(F.col(start), begin), end: F.least(F.col(end), finish)}).where(F.col(end) > F.col(start))
    return cut.withColumns({start: F.col(start) - begin, end: F.col(end) - begin}) if rebase else cut


def gaps(parts: DataFrame, keys: list[str], start: str, end: str, span: DataFrame | None = None, tolerance: float = 0.05) -> DataFrame:
    """gap_start and gap_end between consecutive parts and, with ``span`` (keys, span_start, span_end), before and after them."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    between = parts.select(*keys, F.col(end).alias("gap_start"), F.lead(start).over(w).alias("gap_end"))
    if span is not None:
        edges = parts.groupBy(*keys).agg(F.min(start).alias("_first"), F.max_by(end, F.struct(start, end)).alias("_last")).join(span, list(keys))
        head = edges.select(*keys, F.col("span_start").alias("gap_start"), F.col("_first").alias("gap_end"))
        between = between.union(head).union(edges.select(*keys, F.col("_last").alias("gap_start"), F.col("span_end").alias("gap_end")))
    return between.where(F.col("gap_end") - F.col("gap_start") > tolerance)


def overlapping_parts(parts: DataFrame, keys: list[str], start: str, end: str, tolerance: float = 0.05) -> DataFrame:
    """Parts that begin before the one before them ends: they have to be processed anew."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    return parts.withColumn("previous_end", F.lag(end).over(w)).where(F.col(start) - F.col("previous_end") < -tolerance)


def coverage_gaps(parts: DataFrame, keys: list[str], start: str, end: str, tolerance: float = 0.25) -> DataFrame:
    """Gaps behind the furthest end so far, so that parts inside longer ones open none."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reached = parts.withColumn("gap_start", F.max(end).over(w))
    return reached.where(F.col(start) - F.col("gap_start") > tolerance).select(*keys, "gap_start", F.col(start).alias("gap_end"))


def sessions(events: DataFrame, keys: list[str], start: str, end: str, tolerance: float, also_breaks: Column | None = None) -> DataFrame:
    """``session`` (from 0 for each key): a new one after a gap beyond the tolerance, or where ``also_breaks`` says so."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    after_gap = F.coalesce(F.col(start) - F.lag(end).over(w) > tolerance, F.lit(False))
    cut = after_gap if also_breaks is None else after_gap | F.coalesce(also_breaks, F.lit(False))
    marked = events.withColumn("_cut", (cut & F.lag(F.lit(1)).over(w).isNotNull()).cast("int"))
    return marked.withColumn("session", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def changed(column: str, keys: list[str], order: list[str]) -> Column:
    """True where a column differs from the row before."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))
    return ~F.col(column).eqNullSafe(before)


def year_rollover(rows: DataFrame, keys: list[str], ordinal: str, month: str, first_year: Column) -> DataFrame:
    """``year`` of rows that state only months: one more whenever the month falls."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    fell = rows.withColumn("_fell", F.coalesce((F.col(month) < F.lag(month).over(w)).cast("int"), F.lit(0)))
    return fell.withColumn("year", (first_year + F.sum("_fell").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("int")).drop("_fell")


def greedy_windows(objects: DataFrame, key: str, start: str, end: str, target: float, session: str = "session") -> DataFrame:
    """``window`` within each key and session: it closes once it lasts ``target``.

    Where a window closes depends on all before it, which no Spark window expresses: each key and session is
    walked in order, batch by batch, after one sort; only a running start is held.
    """
    schema = T.StructType([*objects.schema.fields, T.StructField("window", T.LongType())])
    k, s, e, g = key, start, end, session

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, began, number = None, None, 0
        for pdf in batches:
            out = []
            for row_key, row_session, begins, ends in zip(pdf[k], pdf[g], pdf[s], pdf[e], strict=True):
                if (row_key, row_session) != current:
                    current, began, number = (row_key, row_session), None, 0
                began = begins if began is None else began
                out.append(number)
                if ends - began >= target:
                    began, number = None, number + 1
            yield pdf.assign(window=out)

    return objects.repartition(key, session).sortWithinPartitions(key, session, start, end).mapInPandas(run, schema)


def covered(windows: DataFrame, parts: DataFrame, keys: list[str], bucket: float, tolerance: float = 0.25) -> DataFrame:
    """Windows (window_start, window_end) that parts (start, end) cover without a hole beyond the tolerance."""
    pairs = overlap_join(windows, parts.withColumnsRenamed({"start": "b_start", "end": "b_end"}), bucket, "window_start", "window_end", on=keys)
    by = [*keys, "window_start", "window_end"]
    w = Window.partitionBy(*by).orderBy("b_start", "b_end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("b_end").over(w), F.col("window_start"))
    holes = pairs.withColumn("_hole", F.greatest(F.col("b_start") - F.greatest(reached, F.col("window_start")), F.lit(0.0)))
    of = holes.groupBy(*by).agg(F.max("_hole").alias("_hole"), F.max("b_end").alias("_last"))
    out = windows.join(of, by, "left")
    fine = F.coalesce((F.col("_hole") <= tolerance) & (F.col("_last") >= F.col("window_end") - tolerance), F.lit(False))
    return out.withColumn("covered", fine).drop("_hole", "_last")


def caption_lines(text: str) -> Column:
    """Lines of a caption's text that aren't blank, without the white space around them."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"\\h", " "), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def passages(cues: DataFrame, track: str, start: str, text: str, duration: Column, seconds: int = 30, lines: Column | None = None, blank: str = r"\s+") -> DataFrame:
    """Search text of roll-up captions, by window of ``seconds``.

    Only the lines of a cue beyond the longest end of the previous cue's lines that it begins with are new. A
    window's new lines are joined in the order of cues and clipped to ``duration``. Cues need ``cue``, their number; one
    without text adds nothing. ``lines`` are a cue's lines where they aren't those of ``text``; runs of ``blank`` become one space.
    """
    w = Window.partitionBy(track).orderBy(F.col(start).asc_nulls_last(), F.col("cue").asc_nulls_last())
    lines = caption_lines(text) if lines is None else lines
    seen = cues.withColumn("_lines", F.coalesce(lines, F.array().cast("array<string>"))).withColumn("_before", F.coalesce(F.lag("_lines").over(w), F.array().cast("array<string>")))
    most = F.least(F.size("_lines"), F.size("_before"))
    same = lambda n: F.slice("_before", F.size("_before") - n + 1, n) == F.slice("_lines", F.lit(1), n)
    overlap = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), most), lambda n: (n == 0) | same(F.greatest(n, F.lit(1))))), F.lit(0))
    fresh = F.slice("_lines", overlap + 1, F.greatest(F.size("_lines") - overlap, F.lit(0)))
    window = F.floor(F.col(start) / seconds).cast("bigint")
    rows = seen.select(track, window.alias("window"), F.col(start).alias("_start"), "cue", fresh.alias("_fresh"), duration.alias("_duration"))
    joined = rows.groupBy(track, "window").agg(F.array_sort(F.collect_list(F.struct("_start", "cue", "_fresh"))).alias("_all"), F.max("_duration").alias("_duration"))
    body = F.trim(F.regexp_replace(F.array_join(F.flatten(F.transform("_all", lambda x: x["_fresh"])), " "), blank, " "))
    out = joined.select(track, (F.col("window") * seconds).cast("double").alias("start_seconds"), F.least((F.col("window") + 1) * seconds, F.col("_duration")).cast("double").alias("end_seconds"), body.alias("text"))
    return out.where("text <> '' and not coalesce(end_seconds <= start_seconds, false)")


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], *aggregates: Column) -> DataFrame:
    out = events.groupBy(*keys, F.window(ts, size).alias("_w")).agg(*aggregates)
    return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *(c for c in out.columns if c not in (*keys, "_w")))


def playlists(parts: DataFrame, spans: DataFrame, gap_url: str, by: str = "recording_id", tolerance: int = 50_000) -> DataFrame:
    """(by, playlist, error): an M3U8 text of the parts ``(by, id, starts_at, ends_at, url)`` of each of ``spans(by, starts_at, ends_at)``.

    Holes of more than ``tolerance`` microseconds become gap entries; a part that ends so close to the next one's start
    lasts until that. Parts that overlap by more give an error instead of a text; a span without parts gives no row.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = lambda c: F.format_string("#EXTINF:%.6f,", c / 1e6)
    gap = lambda c: F.when(c > tolerance, F.concat_ws("\n", F.lit("#EXT-X-GAP"), seconds(c), F.lit(gap_url)))
    w = Window.partitionBy(by).orderBy("a", "id")
    rows = parts.select(by, "id", "url", F.col("starts_at").cast("timestamp").alias("at"), micros("starts_at").alias("a"), micros("ends_at").alias("b"))
    rows = rows.join(spans.select(by, micros("starts_at").alias("_from"), micros("ends_at").alias("_to")), by)
    rows = rows.withColumn("from", F.least("_from", F.min("a").over(Window.partitionBy(by)))).withColumn("next", F.lead("a").over(w))
    rows = rows.withColumn("finish", F.when(F.abs(F.col("next") - F.col("b")) <= tolerance, F.col("next")).otherwise(F.col("b")))
    rows = rows.withColumn("cursor", F.coalesce(F.lag("finish").over(w), "from")).withColumn("gap", F.col("a") - F.col("cursor"))
    date = F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "'#EXT-X-PROGRAM-DATE-TIME:'yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    broken = F.when((F.col("cursor") > F.col("from")) | (F.col("gap") > tolerance), F.lit("#EXT-X-DISCONTINUITY"))
    entry = F.concat_ws("\n", gap(F.col("gap")), broken, date, seconds(F.col("finish") - F.col("a")), F.col("url"))
    out = rows.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("a", "id", entry.alias("entry")))).alias("entries"), (F.max("_to") - F.max_by("finish", F.struct("a", "id"))).alias("tail"),
        F.max(F.greatest(F.col("b") - F.col("a"), F.when(F.col("gap") > tolerance, F.col("gap")))).alias("longest"), F.min("gap").alias("least"),
    )
    longest = F.ceil(F.greatest("longest", F.when(F.col("tail") > tolerance, F.col("tail"))) / 1e6).cast("string")
    head = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:6\n#EXT-X-TARGETDURATION:"), longest, F.lit("\n#EXT-X-MEDIA-SEQUENCE:0\n#EXT-X-PLAYLIST-TYPE:VOD"))
    text = F.concat(F.concat_ws("\n", head, F.transform("entries", lambda e: e["entry"]), gap(F.col("tail")), F.lit("#EXT-X-ENDLIST")), F.lit("\n"))
    overlap = F.col("least") < -tolerance
    return out.select(by, F.when(~overlap, text).alias("playlist"), F.when(overlap, F.lit("overlapping parts")).alias("error"))
