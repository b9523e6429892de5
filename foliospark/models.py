"""The boundary to models: chains with a fallback, limits of answers, prompts, keys, batches and usage.

No model is part of this library: calls are functions that the caller gives, from a request to an answer.  Everything
about a call but the call itself is a column or a table, so it is planned, cached and counted by Spark.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import labels as L
from foliospark.functions import text as X

MOST_TOKENS, RETRIES = 8192, 2
NOTHING = "(no additional visual content)"
WHOLE = "Write all that the page shows as Markdown. Text found so far:\n{text}\n\nCertain data:\n{data}\n"
REST = "Write only what the text leaves out, or " + NOTHING + ". Text:\n{text}\n\nCertain data:\n{data}\n"


@dataclass(frozen=True)
class Answer:
    text: str
    prompt_tokens: int = 0
    answer_tokens: int = 0
    ended: str = "stop"


class TextModel(Protocol):
    def __call__(self, prompt: str, most_tokens: int) -> Answer: ...


class PictureModel(Protocol):
    def __call__(self, pictures: list[bytes], prompt: str, most_tokens: int) -> Answer: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Transcriber(Protocol):
    def __call__(self, sound: bytes) -> list[tuple[float, str]]: ...


def chain(task: dict[str, Any] | None) -> list[dict[str, Any]]:
    """Models to try in order: primary, then fallback, or the entry itself.  Each needs a provider and a model."""
    found = [task[k] for k in ("primary", "fallback") if task and k in task] or ([task] if task and "provider" in task else [])
    if not found:
        raise ValueError("no model is configured for this task: it needs a primary entry")
    for entry in found:
        if not isinstance(entry, dict) or not entry.get("provider") or not entry.get("model"):
            raise ValueError(f"a model needs both provider and model: {entry!r}")
    return found


def setting(task: dict[str, Any] | None, name: str, fallback: int, explicit: int | None = None) -> int:
    """A limit: as given, as the task says, as its defaults say, or the last resort."""
    defaults = (task or {}).get("_defaults") or {}
    return int(next(v for v in (explicit, (task or {}).get(name), defaults.get(name), fallback) if v is not None))


def for_format(settings: dict[str, Any], format_: str | None) -> dict[str, Any]:
    """Settings of describing pages, those of the format over the general ones (model, tokens, resolution, rest_only)."""
    own = (settings.get("formats") or {}).get((format_ or "").lower()) or {}
    return {**settings, **{k: own[k] for k in ("model", "max_response_tokens", "image_dpi", "rest_only") if own.get(k) is not None}}


def complete(models: list[TextModel], prompt: str, most_tokens: int = MOST_TOKENS, longer: int | None = None, retries: int = RETRIES, wait: float = 0.5) -> Answer:
    """The first model's answer, each tried ``retries`` times more; one that was cut off is asked once more with
    ``longer`` tokens.  Raises RuntimeError if all fail."""
    last: Exception | None = None
    for model in models:
        for attempt in range(retries + 1):
            try:
                got = model(prompt, most_tokens)
                return model(prompt, longer) if got.ended == "length" and longer and longer > most_tokens else got
            except Exception as e:  # noqa: BLE001 - whatever a model's client raises
                last = e
                time.sleep(wait * attempt)
    raise RuntimeError(f"no model answered: {last}")


def page_prompt(text: Column, data: Column, rest_only: bool = False) -> Column:
    """The prompt for one page."""
    filled = F.replace(F.lit(REST if rest_only else WHOLE), F.lit("{text}"), F.when(F.length(X.stripped(text)) > 0, text).otherwise("(empty)"))
    return F.replace(filled, F.lit("{data}"), F.when(F.length(X.stripped(data)) > 0, data).otherwise("(none)"))


def page_key(model: Column, picture_hash: Column, text: Column, data: Column, rest_only: bool = False) -> Column:
    """Key of a page's description: another picture, prompt or data (and, if only the rest is asked for, text) is
    another call."""
    mode = f"{'rest' if rest_only else 'whole'}-"
    own = L.structure_tag(text) if rest_only else F.lit("-")
    return L.call_key(model, picture_hash, F.concat_ws("|", F.lit("page"), F.concat(F.lit(mode), L.prompt_tag(F.lit(REST if rest_only else WHOLE))), own, L.structure_tag(data)))


def batch_requests(pages: DataFrame, most: int = 20) -> DataFrame:
    """doc_id, batch, hashes, pictures and text of each run of at most ``most`` pages (doc_id, page, picture, text) in
    order."""
    from foliospark.operators.shapes import page_batches

    one = F.struct("page", F.sha2("picture", 256).alias("h"), "picture", F.concat(F.format_string("[page %d]\n", "page"), F.coalesce("text", F.lit("(empty)"))).alias("t"))
    held = page_batches(pages, most).groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(one)).alias("p"))
    part = lambda k: F.transform("p", lambda x: x[k])
    return held.select("doc_id", "batch", F.sha2(F.array_join(part("h"), "|"), 256).alias("hash"), part("picture").alias("pictures"), F.array_join(part("t"), "\n\n").alias("text"))


def batched(pages: int, sheets: int | None, least_ratio: float = 1.5) -> bool:
    """Whether a workbook's pages go to the describer in batches: two or more, and many a sheet."""
    return bool(sheets) and pages >= 2 and pages / sheets >= least_ratio


_CALLED = "key string, answer string, prompt_tokens long, answer_tokens long, ended string, error string"


def called(requests: DataFrame, models: list[TextModel], most_tokens: int = MOST_TOKENS, longer: int | None = None) -> DataFrame:
    """key, answer, tokens, how it ended and error of requests (key, prompt): a failed one has an error and no answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _CALLED.split(", ")]
        for b in batches:
            rows = []
            for key, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    a = complete(models, prompt, most_tokens, longer)
                    rows.append((key, a.text, a.prompt_tokens, a.answer_tokens, a.ended, None))
                except RuntimeError as e:
                    rows.append((key, None, 0, 0, None, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _CALLED.split(", ")])

    return requests.select("key", "prompt").mapInArrow(run, _CALLED)


def usage(calls: DataFrame) -> DataFrame:
    """Per model of a log of calls (model, prompt_tokens, answer_tokens, hit), and of all (model null): calls, hits of
    the cache, tokens."""
    fresh = ~F.coalesce("hit", F.lit(False))
    count = lambda c: F.coalesce(F.sum(F.when(fresh, F.col(c))), F.lit(0)).cast("long")
    rolled = calls.rollup("model").agg(F.count_if(fresh).alias("calls"), F.count_if(~fresh).alias("cache_hits"), count("prompt_tokens").alias("prompt_tokens"), count("answer_tokens").alias("answer_tokens"), (F.grouping("model") == 1).alias("total"))
    return rolled.withColumn("total_tokens", F.col("prompt_tokens") + F.col("answer_tokens"))


def transcribed(media: DataFrame, hear: Transcriber) -> DataFrame:
    """path, cue, start_seconds and line of sound files (path, content), for files without subtitles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                heard = hear(content.as_py()) if content.is_valid else []
                if heard:
                    lines = [f"[{int(at) // 60:02d}:{int(at) % 60:02d}] {text.strip()}" for at, text in heard]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(heard)), pa.array(range(len(heard)), pa.int32()), pa.array([int(at) for at, _ in heard], pa.int64()), pa.array(lines)], ["path", "cue", "start_seconds", "line"])

    return media.select("path", "content").mapInArrow(run, "path string, cue int, start_seconds long, line string")


def sound_spans(seconds: float, most: float = 600.0) -> list[tuple[float, float]]:
    """Spans of at most ``most`` seconds that cover a sound file."""
    n = max(1, -int(-seconds // most))
    return [(k * most, min(seconds, (k + 1) * most)) for k in range(n)] if seconds > 0 else []
