"""State of earlier runs: which files and chunks can be used again, and the union of old and new.

Metas are rows (cache_key, version, config_hash, source_md, assets, chunk_ids); a file table has path and cache_key.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 1


def config_hash(settings: dict[str, Any], relevant: list[str]) -> str:
    """Sixteen characters of the MD5 of the settings at the dotted paths."""
    return hashlib.md5(json.dumps({p: nested(settings, p) for p in relevant}, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:16]


def nested(settings: dict[str, Any], path: str, default: Any = None) -> Any:
    """The setting at a dotted path."""
    for step in path.split("."):
        if not isinstance(settings, dict) or step not in settings:
            return default
        settings = settings[step]
    return settings


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Settings with others over them; tables are merged, all else replaced."""
    return {**base, **{k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def validity(metas: DataFrame, config: str, existing: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """metas with ``reason``: empty if what they name can be used again, else the first check that fails.  existing:
    path of every file of the output; chunk_ids: id of every chunk of the output."""
    paths = existing.select(F.col("path").alias("p")).distinct()
    md = metas.select("cache_key", "source_md").join(paths, F.col("source_md") == F.col("p"), "left_semi").select("cache_key", F.lit(True).alias("md")).distinct()
    asset = metas.select("cache_key", F.posexplode("assets").alias("at", "asset")).join(paths, F.col("asset") == F.col("p"), "left_anti")
    asset = asset.groupBy("cache_key").agg(F.min_by("asset", "at").alias("asset"))
    ids = chunk_ids.select(F.col("id").alias("i")).distinct()
    lost = metas.select("cache_key", F.posexplode("chunk_ids").alias("at", "chunk")).join(ids, F.col("chunk") == F.col("i"), "left_anti")
    lost = lost.groupBy("cache_key").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "chunk"))), 1, 3)["chunk"].alias("lost"))
    held = metas.join(md, "cache_key", "left").join(asset, "cache_key", "left").join(lost, "cache_key", "left")
    reason = (
        F.when(~F.col("version").eqNullSafe(VERSION), F.concat(F.lit("meta schema version mismatch (got "), F.coalesce(F.col("version").cast("string"), F.lit("None")), F.lit(")")))
        .when(~F.col("config_hash").eqNullSafe(config), "config changed").when(F.length(F.coalesce("source_md", F.lit(""))) == 0, "meta missing source_md")
        .when(F.col("md").isNull(), F.concat(F.lit("source markdown missing: "), "source_md")).when(F.col("asset").isNotNull(), F.concat(F.lit("asset missing: "), "asset"))
        .when(F.col("lost").isNotNull(), F.concat(F.lit("chunks missing from chunks.jsonl: "), F.array_join("lost", ", "))).otherwise("")
    )
    return held.withColumn("reason", reason).drop("md", "asset", "lost")


def partition(files: DataFrame, judged: DataFrame) -> DataFrame:
    """files with status: cached, updated (with the reason) or added."""
    both = files.join(judged.select("cache_key", "reason"), "cache_key", "left")
    status = F.when(F.col("reason").isNull(), "added").when(F.col("reason") == "", "cached").otherwise("updated")
    return both.withColumn("status", status).withColumn("reason", F.coalesce("reason", F.lit("")))


def reused_chunks(cached: DataFrame, old: DataFrame) -> DataFrame:
    """old (id, …) chunks that cached metas (pos, chunk_ids) name, in their order (file_pos, pos)."""
    named = cached.select(F.col("pos").alias("file_pos"), F.posexplode("chunk_ids").alias("pos", "id"))
    return named.join(old, "id")


def reused_and_new(reused: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks: the reused ones (rank 0), then the new ones (rank 1)."""
    return reused.withColumn("rank", F.lit(0)).unionByName(new.withColumn("rank", F.lit(1)), allowMissingColumns=True)


def uncached_chunks(chunks: DataFrame, entries: DataFrame, llm_hash: str) -> DataFrame:
    """chunks (chunk_id, text) that were not extracted before with this text and model."""
    known = entries.filter(F.col("llm_config_hash") == llm_hash).select("chunk_id", "content_hash")
    return chunks.withColumn("content_hash", F.md5("text")).join(known, ["chunk_id", "content_hash"], "left_anti")


def marked(entries: DataFrame, extracted: DataFrame, llm_hash: str) -> DataFrame:
    """entries with those of the extracted chunks replaced; of a repeated id the least hash stays."""
    new = extracted.groupBy("chunk_id").agg(F.min(F.md5("text")).alias("content_hash")).withColumn("llm_config_hash", F.lit(llm_hash))
    return entries.select("chunk_id", "content_hash", "llm_config_hash").join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def answered(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (key, …) with the cache's answers (key, answer), and those that must be asked, each key once."""
    hits = requests.join(cache.select("key", "answer").dropDuplicates(["key"]), "key")
    return hits, requests.join(cache, "key", "left_anti").dropDuplicates(["key"])


def valid_and_invalid(requested: DataFrame, found: DataFrame) -> DataFrame:
    """requested (input) inputs with success: those that exist, and the others as failures with a reason."""
    ok = requested.join(found.select("input").distinct(), "input", "left_semi").select("input", F.lit(True).alias("success"), F.lit("").alias("error_type"), F.lit("").alias("error"))
    lost = requested.join(found.select("input").distinct(), "input", "left_anti").select("input", F.lit(False).alias("success"), F.lit("io_error").alias("error_type"), F.lit("not_found").alias("error"))
    return ok.unionByName(lost)


def needed_outputs(wanted: set[str], requires: dict[str, set[str]]) -> set[str]:
    """Outputs with all that they need, directly or by way of others."""
    todo, out = list(wanted), set(wanted)
    while todo:
        more = requires.get(todo.pop(), set()) - out
        out |= more
        todo += more
    return out
