"""Captions and playlists: one document a row, parsed in tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The forms of WebVTT.
CLOCK = r"(?:\d{2}:)?\d{2}:\d{2}\.\d{3}"
TIMING = re.compile(rf"({CLOCK})\s+-->\s+({CLOCK})(?:\s+(.*))?")
METADATA = re.compile(r"(?:NOTE|STYLE|REGION)(?:\s|$)")


def seconds(clock: str) -> float:
    out = 0.0
    for part in clock.split(":"):
        out = out * 60 + float(part)
    return out


def cues_of(source: str) -> list[tuple[float, float, str, str | None, str]]:
    """(start, end, text, identifier, settings) of the cues of a WebVTT text.

    A blank line ends a cue only if a cue or a metadata block follows: some encoders put one between the timing
    and its text.
    """
    lines = source.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if not lines[0].startswith("WEBVTT"):
        raise ValueError("not a WebVTT document")
    timings = [TIMING.fullmatch(line) for line in lines]
    starts = [i for i, t in enumerate(timings) if t]
    blocks = [i for i, line in enumerate(lines) if METADATA.match(line) and i and not lines[i - 1]]
    found = []
    for n, at in enumerate(starts):
        end = starts[n + 1] if n + 1 < len(starts) else len(lines)
        if n + 1 < len(starts) and lines[end - 1] and not lines[end - 2]:
            end -= 1  # the next cue's identifier
        end = min([end, *(b for b in blocks if at < b < end)])
        begins, ends, settings = timings[at].groups()
        has_name = at > 1 and lines[at - 1] and not lines[at - 2] and not timings[at - 1]
        if seconds(ends) > seconds(begins):
            found.append((seconds(begins), seconds(ends), "\n".join(x for x in lines[at + 1 : end] if x), lines[at - 1] if has_name else None, settings or ""))
    return found


def cues(documents: DataFrame, body: str = "body") -> DataFrame:
    """A row for each cue: cue (its number), start_seconds, end_seconds, text, identifier and settings."""
    keep = [c for c in documents.columns if c != body]
    names = ["cue", "start_seconds", "end_seconds", "text", "identifier", "settings"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in range(len(pdf)):
                rows = [(i, *c) for i, c in enumerate(cues_of(pdf[body].iloc[row] or "WEBVTT"))]
                out = pd.DataFrame(rows, columns=names)
                for c in keep:
                    out[c] = [pdf[c].iloc[row]] * len(rows)
                yield out[[*keep, *names]]

    kinds = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes if c != body)
    head = f"{kinds}, " if kinds else ""
    return documents.mapInPandas(run, f"{head}cue int, start_seconds double, end_seconds double, text string, identifier string, settings string")


def rendered(cues: DataFrame, keys: list[str]) -> DataFrame:
    """WebVTT text of each key's cues, in order."""
    from ..functions.text import clock_of

    timing = F.concat(clock_of(F.col("start_seconds")), F.lit(" --> "), clock_of(F.col("end_seconds")), F.when(F.col("settings") != "", F.concat(F.lit(" "), "settings")).otherwise(""))
    block = F.concat_ws("\n", F.when(F.col("identifier") != "", F.col("identifier")), timing, F.col("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_seconds", "cue", block.alias("b")))), lambda x: x["b"]), "\n\n")
    return cues.groupBy(*keys).agg(F.concat(F.lit("WEBVTT\n\n"), body, F.lit("\n")).alias("body"))


def segments_of(text: str, anchor: datetime | None = None) -> list[tuple]:
    """(sequence, uri, starts_at, ends_at, duration, discontinuity) of a media playlist, on a running clock.

    A segment needs a time: its own tag, the end of the one before, or ``anchor`` plus its offset in a finished list.
    """
    lines = [x.strip() for x in text.splitlines()]
    tag = lambda name, other: next((x[len(name) :] for x in lines if x.startswith(name)), other)
    sequence, break_no = int(tag("#EXT-X-MEDIA-SEQUENCE:", 0)), int(tag("#EXT-X-DISCONTINUITY-SEQUENCE:", 0))
    finished, clock, duration, offset, broken, out = "#EXT-X-ENDLIST" in lines, None, None, 0.0, False, []
    for line in lines[1:]:
        if line.startswith("#EXTINF:"):
            duration = float(line[8:].split(",")[0])
            if duration <= 0:
                raise ValueError("segment duration must be positive")
        elif line.startswith("#EXT-X-KEY:") and "METHOD=NONE" not in line:
            raise ValueError("encrypted playlists are not supported")
        elif line.startswith("#EXT-X-PROGRAM-DATE-TIME:"):
            clock = datetime.fromisoformat(line[25:].replace("Z", "+00:00")).astimezone(timezone.utc)
        elif line == "#EXT-X-DISCONTINUITY":
            broken, clock, break_no = True, None, break_no + 1
        elif line and not line.startswith("#") and duration is not None:
            if clock is None:
                if anchor is None or not finished:
                    raise ValueError(f"segment {sequence} has no time")
                clock = anchor + timedelta(seconds=offset)
            ends = clock + timedelta(seconds=duration)
            out.append((sequence, line, clock, ends, duration, broken))
            clock, offset, sequence, duration, broken = ends, offset + duration, sequence + 1, None, False
    return out


def segments(playlists: DataFrame, body: str = "body") -> DataFrame:
    """A row for each segment of each playlist, with the other columns of ``playlists``."""
    keep = [c for c in playlists.columns if c != body]
    names = ["sequence", "uri", "starts_at", "ends_at", "duration", "discontinuity"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in range(len(pdf)):
                rows = segments_of(pdf[body].iloc[row] or "")
                out = pd.DataFrame(rows, columns=names)
                for c in keep:
                    out[c] = [pdf[c].iloc[row]] * len(rows)
                yield out[[*keep, *names]]

    kinds = ", ".join(f"`{c}` {t}" for c, t in playlists.dtypes if c != body)
    head = f"{kinds}, " if kinds else ""
    return playlists.mapInPandas(run, f"{head}sequence bigint, uri string, starts_at timestamp, ends_at timestamp, duration double, discontinuity boolean")
