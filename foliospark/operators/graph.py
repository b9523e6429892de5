"""A graph of entities over a collection's chunks, built in steps: only new and changed chunks are extracted.

The extractor is a function from a text to entities (name, description) and relations (source, target, description).
A build is a folder of tables and a manifest, written last: a build that fails leaves the one before.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import state

Extractor = Callable[[str], tuple[list[tuple[str, str]], list[tuple[str, str, str]]]]
LANGUAGES = {"ja": "Japanese", "zh": "Chinese", "zh-cn": "Chinese", "zh-tw": "Chinese", "en": "English", "ko": "Korean", "fr": "French", "de": "German", "es": "Spanish", "ru": "Russian"}
MODES = {"vector_only": ("naive", "local"), "full": ("naive", "local", "global", "hybrid", "mix")}
_FOUND = "chunk_id string, content_hash string, kind string, name string, target string, description string, pos int"


def query_mode(built: str, asked: str) -> str:
    """The asked mode in lower case; ValueError if the build doesn't have it."""
    mode = asked.strip().lower()
    if mode not in MODES[built]:
        raise ValueError(f"mode {asked!r} isn't one of {', '.join(MODES[built])} (built as {built})")
    return mode


def model_hash(settings: dict[str, Any]) -> str:
    return hashlib.md5(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def language_name(setting: str | None, entries: DataFrame | None = None) -> str | None:
    """Name of the language to write in: a tag's name, the text as given, or for ``auto`` that of most files (ties by
    path)."""
    if not setting or setting.strip().lower() in ("", "default"):
        return None
    if setting.strip().lower() != "auto":
        return LANGUAGES.get(setting.strip().lower(), setting.strip())
    tag = F.lower(F.trim("language"))
    most = entries.filter(F.length(tag) > 0).groupBy(tag.alias("t")).agg(F.count("*").alias("n"), F.min("path").alias("p")).orderBy(F.desc("n"), "p").first() if entries is not None else None
    return None if most is None else LANGUAGES.get(most["t"], most["t"].capitalize())


def extracted(chunks: DataFrame, extract: Extractor) -> DataFrame:
    """A row for every entity and relation of chunks (chunk_id, text), and one for each chunk, with the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = hashlib.md5((text or "").encode()).hexdigest()
                things, links = extract(text or "")
                rows.append((key, h, "chunk", None, None, None, 0))
                rows += [(key, h, "entity", n, None, d, i) for i, (n, d) in enumerate(things) if n]
                rows += [(key, h, "relation", s, t, d, i) for i, (s, t, d) in enumerate(links) if s and t]
            if rows:
                kinds = [pa.int32() if x.endswith("int") else pa.string() for x in _FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _FOUND.split(", ")])

    return chunks.select("chunk_id", "text").mapInArrow(run, _FOUND)


def _manifest(folder: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(folder)
    return store, f"{root}/manifest.json"


def manifest(folder: str) -> dict[str, Any]:
    """What the last build wrote of itself; empty if there is none."""
    store, path = _manifest(folder)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def build(chunks: DataFrame, extract: Extractor, folder: str, settings: dict[str, Any] | None = None, force: bool = False) -> dict[str, Any]:
    """Extract what isn't in the last build with this text and these settings, take over what is, and write the build.
    The manifest is returned."""
    spark, last, own = chunks.sparkSession, manifest(folder), model_hash(settings or {})
    n = int(last.get("build", 0)) + 1
    at = f"{folder.rstrip('/')}/found/build={n}"
    hashed = chunks.select("chunk_id", "text").dropDuplicates(["chunk_id"]).withColumn("content_hash", F.md5(F.coalesce("text", F.lit(""))))
    old = spark.read.schema(_FOUND).parquet(f"{folder.rstrip('/')}/found/build={n - 1}") if last and not force and last["model_hash"] == own else spark.createDataFrame([], _FOUND)
    kept = old.join(hashed.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi").select(*[x.split()[0] for x in _FOUND.split(", ")])
    new = hashed.join(old.filter("kind = 'chunk'").select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")
    kept.write.mode("overwrite").parquet(at)
    extracted(new, extract).write.mode("append").parquet(at)
    found = spark.read.schema(_FOUND).parquet(at)
    total = found.agg(F.count_if(F.col("kind") == "chunk").alias("c"), F.countDistinct(F.when(F.col("kind") == "entity", F.col("name"))).alias("e"), F.countDistinct(F.when(F.col("kind") == "relation", F.struct("name", "target"))).alias("r")).first()
    cached = kept.filter("kind = 'chunk'").count()
    made = {"version": state.VERSION, "build": n, "model_hash": own, "chunks": total["c"], "chunks_extracted": total["c"] - cached, "chunks_cached": cached, "entities": total["e"], "relations": total["r"]}
    store, path = _manifest(folder)
    with store.open_output_stream(path + ".new") as f:
        f.write(json.dumps(made).encode())
    store.move(path + ".new", path)
    return made


def status(folder: str) -> dict[str, Any]:
    """built, and the counts of the last build."""
    return {"built": bool(manifest(folder)), **{k: v for k, v in manifest(folder).items() if k not in ("version", "model_hash")}}


def _found(spark: SparkSession, folder: str) -> DataFrame:
    last = manifest(folder)
    if not last:
        raise ValueError(f"{folder} holds no graph")
    return spark.read.schema(_FOUND).parquet(f"{folder.rstrip('/')}/found/build={last['build']}")


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, name, description and exclusive of every entity in every chunk, as ``entities.top`` takes them; the
    description is that of the entity's first chunk.  No entity's chunks are put into one row."""
    e = _found(spark, folder).filter("kind = 'entity'")
    of_name = e.groupBy("name").agg(F.min_by("description", F.struct("chunk_id", "pos")).alias("description"), (F.min("chunk_id") == F.max("chunk_id")).alias("exclusive"))
    return e.select("chunk_id", "name").distinct().join(of_name, "name").select("chunk_id", "name", "description", "exclusive")


def neighbours(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """source, target, description and number of chunks of the relations that touch any of the names."""
    r = _found(spark, folder).filter("kind = 'relation'").filter(F.col("name").isin(names) | F.col("target").isin(names))
    return r.groupBy(F.col("name").alias("source"), "target").agg(F.min_by("description", F.struct("chunk_id", "pos")).alias("description"), F.countDistinct("chunk_id").alias("chunks"))
