"""Steps around reading files, by extension and phase: what they change is recorded, what they don't isn't.

A step before reading takes (extension, bytes) and returns bytes or None; the first that returns some counts.  A step
after reading takes (extension, text) and returns text; all of a phase run in the order of their registration, those
of the extension before those of all.  A step that raises is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Before = Callable[[str, bytes], bytes | None]
After = Callable[[str, str], str]
PHASES = ("post_parse", "pre_write")


class Steps:
    """A registry of steps; sent to executors with the plan."""

    def __init__(self) -> None:
        self._before: dict[str, list[tuple[str, Before]]] = {}
        self._after: dict[tuple[str, str], list[tuple[str, After]]] = {}

    def before(self, name: str, extensions: list[str], step: Before) -> Steps:
        for e in extensions:
            self._before.setdefault(e.lower(), []).append((name, step))
        return self

    def after(self, name: str, extensions: list[str], step: After, phase: str = "post_parse") -> Steps:
        if phase not in PHASES:
            raise ValueError(f"phase {phase!r} isn't one of {', '.join(PHASES)}")
        for e in extensions:
            self._after.setdefault((phase, e.lower()), []).append((name, step))
        return self

    def open(self, extension: str, raw: bytes) -> tuple[bytes, str | None]:
        """Bytes to read and the step that made them."""
        for name, step in self._before.get(extension, []) + self._before.get("*", []):
            try:
                made = step(extension, raw)
            except Exception:  # noqa: BLE001, S112 - a step that fails doesn't stop the others
                continue
            if made is not None:
                return made, name
        return raw, None

    def close(self, extension: str, text: str, phase: str) -> tuple[str, list[str]]:
        """Text after all steps of a phase and the names of those that changed it."""
        used = []
        for name, step in self._after.get((phase, extension), []) + self._after.get((phase, "*"), []):
            try:
                new = step(extension, text)
            except Exception:  # noqa: BLE001, S112
                continue
            if new != text:
                used.append(name)
                text = new
        return text, used


def applied(texts: DataFrame, steps: Steps, phase: str = "post_parse") -> DataFrame:
    """texts (format, text, transformations and others) after a phase, with what changed each appended to its array of
    transformations (phase:name)."""
    if "transformations" not in texts.columns:
        texts = texts.withColumn("transformations", F.array().cast("array<string>"))
    at = {c: texts.columns.index(c) for c in ("format", "text", "transformations")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, trail = [], []
            for kind, text, before in zip(*(b.column(at[c]).to_pylist() for c in ("format", "text", "transformations"))):
                changed, used = steps.close((kind or "").lower(), text, phase) if text is not None else (None, [])
                new.append(changed)
                trail.append((before or []) + [f"{phase}:{u}" for u in used])
            columns = list(b.columns)
            columns[at["text"]], columns[at["transformations"]] = pa.array(new, pa.string()), pa.array(trail, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return texts.mapInArrow(run, texts.schema)


def lineage(chunks: DataFrame) -> DataFrame:
    """chunks (source, original_file, strategy, transformations) with a struct ``lineage``: where each comes from and,
    in order, what shaped it."""
    steps = F.array_append(F.coalesce("transformations", F.array().cast("array<string>")), F.concat(F.lit("chunker:"), "strategy"))
    return chunks.withColumn("lineage", F.struct(F.col("source").alias("source_markdown"), F.struct(F.col("original_file").alias("filename")).alias("original_input"), steps.alias("transformations")))
