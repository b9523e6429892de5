"""Subtitles (SRT, WebVTT, ASS and SSA) to time-stamped Markdown lines.

A cue of SRT is a block between blank lines: number, time line, text; its lines are joined by spaces, tags go.  A block
whose second line isn't a time line keeps its text without a stamp (the lines from the third on, or the second if it is
the last).  Times count minutes on past the hour.  Null and blank texts have no cues.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCKS = re.compile(r"\n\s*\n")
_TIMES = re.compile(r"(\d{2}):(\d{2}):(\d{2})[,.]\d{3}\s*-->")
_START = re.compile(r"(\d+):(\d{2}):(\d{2})")


def _stamped(h: str, m: str, s: str, text: str) -> tuple[int, str]:
    at = int(h) * 3600 + int(m) * 60 + int(s)
    return at, f"[{at // 60:02d}:{at % 60:02d}] {text}"


def srt(raw: str, stamps: bool = True) -> list[tuple[int | None, str]]:
    """(seconds or None, line) of every cue with text."""
    out: list[tuple[int | None, str]] = []
    for block in _BLOCKS.split(raw.strip()):
        lines = block.strip().split("\n")
        if len(lines) < 2:
            continue
        text = re.sub(r"<[^>]+>", "", " ".join(x.strip() for x in lines[2:] or lines[1:] if x.strip()))
        time = _TIMES.match(lines[1])
        if text:
            out.append(_stamped(*time.groups(), text) if stamps and time else (None, text))
    return out


def vtt(raw: str, stamps: bool = True) -> list[tuple[int | None, str]]:
    """As SRT, the header and notes left out."""
    return srt(re.sub(r"NOTE\s*\n.*?\n\n", "", re.sub(r"^WEBVTT\s*\n", "", raw.strip()), flags=re.DOTALL), stamps)


def ass(raw: str, stamps: bool = True) -> list[tuple[int | None, str]]:
    """Dialogue lines, formatting left out."""
    out: list[tuple[int | None, str]] = []
    for line in raw.split("\n"):
        fields = line.split(",", 9)
        if not line.startswith("Dialogue:") or len(fields) < 10:
            continue
        text = re.sub(r"\{\\[^}]*\}", "", fields[9].strip()).replace("\\N", " ").strip()
        time = _START.match(fields[1].strip())
        if text:
            out.append(_stamped(*time.groups(), text) if stamps and time else (None, text))
    return out


_READERS = {"srt": srt, "vtt": vtt, "ass": ass, "ssa": ass}


def cues(files: DataFrame, key: str, text: str = "raw", kind: str | None = None, stamps: bool = True) -> DataFrame:
    """key, cue (from 0), start_seconds and line of every cue of each file.  kind: a column with srt, vtt, ass or ssa
    (SRT if there is none); other kinds have no cues."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, rows = [], []
            for r, (raw, how) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                read = _READERS.get((how or "").lower())
                found = read(raw, stamps) if raw and read else []
                rows += [(i, *c) for i, c in enumerate(found)]
                own += [r] * len(found)
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), *(pa.array(list(c), k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.string())))], [key, "cue", "start_seconds", "line"])

    how = F.col(kind) if kind else F.lit("srt")
    return files.select(key, F.col(text), how).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, cue int, start_seconds long, line string")


def transcript(cued: DataFrame, key: str) -> DataFrame:
    """key and markdown: all lines of a file in order under a heading."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("cue", "line"))), lambda x: x["line"])
    return cued.groupBy(key).agg(F.concat(F.lit("## Transcript\n\n"), F.array_join(lines, "\n\n")).alias("markdown"))


def language_in_name(path: Column) -> Column:
    """Language code in a subtitle's name (``film.ja.srt``); empty if there is none."""
    code = F.regexp_extract(path, "\\.([A-Za-z-]{2,10})\\.[^./]+$", 1)
    return F.when(code.rlike("[A-Za-z]"), code).otherwise("")


def subtitle_of(media: DataFrame, files: DataFrame) -> DataFrame:
    """media (path) with the subtitle file beside it, if any: SRT before VTT, ASS and SSA, a plain name before one with a
    language."""
    parts = F.regexp_extract(F.col("path"), "^(.*?)(?:\\.([A-Za-z-]{2,10}))?\\.(srt|vtt|ass|ssa)$", 1)
    subs = files.filter(F.lower("path").rlike("\\.(srt|vtt|ass|ssa)$")).select(F.col("path").alias("subtitle"), F.lower(F.regexp_extract("path", "\\.([^.]+)$", 1)).alias("kind"), F.regexp_replace("path", "\\.[^./]+$", "").alias("plain"), parts.alias("bare"))
    named = subs.select("subtitle", "kind", F.explode(F.array_distinct(F.array("plain", "bare"))).alias("stem"), "plain")
    rank = F.array_position(F.array(*map(F.lit, ("srt", "vtt", "ass", "ssa"))), F.col("kind"))
    best = named.groupBy("stem").agg(F.min(F.struct(rank.alias("r"), (F.col("plain") != F.col("stem")).alias("tagged"), "subtitle")).alias("b"))
    return media.withColumn("stem", F.regexp_replace("path", "\\.[^./]+$", "")).join(best.select("stem", F.col("b.subtitle").alias("subtitle")), "stem", "left").drop("stem")
