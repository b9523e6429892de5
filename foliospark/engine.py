"""The engine's entry points: ingest, inspect, refine, enrich, ask, list and summarise collections.

A collection is a folder of tables, one set a run (``sources``, ``chunks``, ``metas``, ``results``), and a pointer to the
last whole run: a run that fails leaves the one before in place.  Model calls go through functions that the caller
gives; their answers are kept by key and asked for once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import headers as H
from foliospark.functions import labels as L
from foliospark.functions import tables as T
from foliospark.functions import text as X
from foliospark.operators import budget, chunking, cleaning, corpus, entities, knowledge, state
from foliospark.sources import files as sources
from foliospark.sources import office, output, subtitles

RELEVANT = ["limits", "sanitize", "strip_repeating"]
DEFAULTS: dict[str, Any] = {"limits": {"most": chunking.MOST, "least": chunking.LEAST, "overlap": chunking.OVERLAP}, "sanitize": False, "strip_repeating": False, "safety": "strict", "path_headers": True}
_MODES = ("naive",)
#: formats whose bytes aren't text and that nothing here reads
UNREAD = ("pdf", "doc", "xls", "ppt", "zip", *(k for k, how in chunking.STRATEGIES.items() if how in ("whole", "timestamp")))


class BudgetExceeded(ValueError):
    """A strict budget that the inputs exceed; ``violations`` has the rows."""

    def __init__(self, violations: list):
        self.violations = violations
        super().__init__("; ".join(f"{v['path'] or 'run'}: {v['metric']}={v['value']:g} > {v['threshold']:g}" for v in violations[:20]))


@dataclass
class Collection:
    """Tables of a collection's last whole run."""

    spark: SparkSession
    folder: str
    settings: dict[str, Any] = field(default_factory=dict)

    def _pointer(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.folder)
        return store, f"{root}/current.json"

    @property
    def run(self) -> int:
        """Number of the last whole run; 0 for none."""
        store, path = self._pointer()
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return 0
        with store.open_input_stream(path) as f:
            return int(json.loads(f.read())["run"])

    def point(self, run: int) -> None:
        store, path = self._pointer()
        with store.open_output_stream(path + ".new") as f:
            f.write(json.dumps({"run": run}).encode())
        store.move(path + ".new", path)

    def at(self, name: str, run: int) -> str:
        return f"{self.folder.rstrip('/')}/{name}/run={run}"

    def table(self, name: str) -> DataFrame:
        if not self.run:
            raise ValueError(f"{self.folder} holds no collection")
        return self.spark.read.parquet(self.at(name, self.run))

    def entries(self) -> DataFrame:
        return knowledge.index_entries(self.table("sources").withColumn("path", F.concat(F.lit("sources/"), "name")), self.table("chunks"))

    def summary(self) -> dict[str, Any]:
        """Totals, quality and statuses of the last run."""
        stats = knowledge.index_stats(self.entries()).first().asDict()
        marks = corpus.quality_report(self.table("sources").withColumn("source", F.lit("all"))).first()
        totals = knowledge.run_totals(self.table("results")).first()
        return {**stats, "quality_score": marks["score"] if marks else 1.0, **({k: totals[k] for k in ("added", "updated", "cached", "failed")} if totals else {})}

    def knowledge_map(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Top keywords of each file, the inverted index, and the files' keyword tags."""
        entries = self.entries()
        counts = knowledge.keyword_counts(knowledge.keyword_texts(entries, self.table("chunks")))
        top, index = knowledge.top_keywords(counts), knowledge.keyword_index(counts, entries)
        return top, index, knowledge.keyword_tags(top, index)

    def export(self, folder: str) -> None:
        """Markdown files with front matter, chunk records as JSON lines and a guide."""
        output.write_files(output.marked_down(self.table("sources")), f"{folder}/sources").write.format("noop").mode("overwrite").save()
        output.write_chunks(self.table("chunks"), f"{folder}/chunks")
        entries = self.entries()
        output.write_lines(output.guide_lines(entries, self.knowledge_map()[1], knowledge.index_stats(entries)), f"{folder}/guide")


def inspect(spark: SparkSession, paths: list[str], per_call: float = 0.0002) -> DataFrame:
    """What is known of the files before any work, with the cost of describing their pages and a recommendation."""
    found = sources.discover(spark, paths).withColumn("format", sources.sniffed_format(F.col("content"), F.col("path")))
    infos = office.inspected(found).withColumn("est_cost_usd", F.round(budget.describing_cost(F.col("pages"), per_call), 4))
    reasons = budget.file_violations(infos).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("metric", "value", "threshold"))).alias("reasons"))
    said = F.concat_ws("; ", L.violation_phrase(F.col("reasons")), F.concat(F.lit("Inspection error: "), F.col("error")))
    ready = F.when(F.col("note").isNotNull(), F.concat(F.lit("Ready ("), "note", F.lit(")"))).otherwise("Ready")
    return infos.join(reasons, "path", "left").withColumn("recommendation", F.when(said == "", ready).otherwise(said)).drop("reasons")


def parsed(spark: SparkSession, paths: list[str], settings: dict[str, Any]) -> DataFrame:
    """A row a file (archives expanded): path, original_file, format, cache_key, text (cleaned), error."""
    found = sources.expanded(sources.discover(spark, paths)).withColumn("format", sources.sniffed_format(F.col("content"), F.col("name")))
    found = found.withColumn("path", F.concat_ws("!", "path", "name")).withColumn("cache_key", L.cache_key(F.col("content"), F.col("name")))
    other = F.col("format").isin(*office.READERS, *UNREAD)
    plain = sources.texts(found.filter(~other)).select("path", "text", F.when(F.col("encoding") == "binary", "parse_error: binary file").alias("why"))
    unread = found.filter(F.col("format").isin(*UNREAD)).select("path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("parse_error: nothing reads "), "format").alias("why"))
    read = plain.unionByName(unread).unionByName(office.parsed(found.filter(F.col("format").isin(*office.READERS))).withColumnRenamed("error", "why"))
    cued = subtitles.transcript(subtitles.cues(read.join(found.select("path", "format"), "path"), "path", "text", "format"), "path")
    both = found.drop("content").join(read, "path").join(cued, "path", "left").withColumn("text", F.coalesce("markdown", "text")).drop("markdown")
    text = F.when(F.col("format").isin("xlsx", "csv"), T.clean_sheets(F.col("text"))).when(F.contains(F.col("text"), F.lit("|")), T.denoised(F.col("text"))).otherwise(F.col("text"))
    both = both.withColumn("text", text)
    if settings["strip_repeating"]:
        both = cleaning.map_text(both, cleaning.strip_pages)
    if settings["sanitize"]:
        both = both.withColumn("text", X.sanitized(F.col("text")))
    why = F.coalesce("why", F.nullif("error", F.lit("")))
    return both.select("path", F.col("name").alias("original_file"), "format", "cache_key", "text", why.alias("error"))


def ingest(spark: SparkSession, paths: list[str], folder: str, settings: dict[str, Any] | None = None, acknowledged: bool = False, force: bool = False) -> Collection:
    """Bring files into a collection: only new and changed ones are chunked, the others' chunks are used again."""
    chosen = state.merged(DEFAULTS, settings or {})
    if chosen["safety"] != "off":
        over = [] if acknowledged else budget.check(inspect(spark, paths)).collect()  # a row an exceeded limit
        if over and chosen["safety"] == "strict":
            raise BudgetExceeded(over)
    made = Collection(spark, folder, chosen)
    before, run = made.run, made.run + 1
    files = parsed(spark, paths, chosen)
    files.write.mode("overwrite").parquet(made.at("parsed", run))
    files = spark.read.parquet(made.at("parsed", run))
    config = state.config_hash(chosen, RELEVANT)
    named = knowledge.source_names(files.filter("error is null").select(F.col("path").alias("pos"), F.col("original_file").alias("path"))).select(F.col("pos").alias("path"), "name")
    language = X.detect_language(F.col("text"))
    good = files.filter("error is null").join(named, "path").withColumns({"language": language, "title": L.stem(F.col("original_file"))})
    good = good.withColumns({"tags": knowledge.derived_tags(F.col("format"), F.col("language")), "aliases": knowledge.aliases(F.col("title"), F.lit(None).cast("string"), F.col("original_file"))})
    if before and not force:
        old = spark.read.parquet(made.at("metas", before))
        judged = old.withColumn("reason", F.when(F.col("config_hash") == config, "").otherwise("config changed"))
        good = state.partition(good, judged.select("cache_key", "reason").dropDuplicates(["cache_key"]))
    else:
        good = good.withColumns({"status": F.lit("forced" if force else "added"), "reason": F.lit("")})
    good.write.mode("overwrite").parquet(made.at("sources", run))
    good = spark.read.parquet(made.at("sources", run))
    limits = chunking.Limits(**chosen["limits"])
    new = chunking.chunk_auto(good.filter("status <> 'cached'"), "path", "text", "format", limits, keep=("name", "original_file", "format", "language", "cache_key"))
    source = F.concat(F.lit("sources/"), "name")
    text = H.with_path(F.col("text"), source, F.col("title_path")) if chosen["path_headers"] else F.col("text")
    new = new.withColumns({"id": L.chunk_id(F.col("original_file"), F.col("chunk_index")), "source": source, "text": text})
    if before and not force:
        kept = spark.read.parquet(made.at("chunks", before)).drop("path", "rank").join(good.filter("status = 'cached'").select("cache_key", "path"), "cache_key")
        new = state.reused_and_new(kept, new)
    new.write.mode("overwrite").parquet(made.at("chunks", run))
    good.select("cache_key", F.lit(state.VERSION).alias("version"), F.lit(config).alias("config_hash"), "name").write.mode("overwrite").parquet(made.at("metas", run))
    n = spark.read.parquet(made.at("chunks", run)).groupBy("path").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    fine = good.join(n, "path", "left").select("path", "status", F.lit(True).alias("success"), F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"), F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"), "reason", F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("error_type"))
    bad = files.filter("error is not null").select("path", F.lit("failed").alias("status"), F.lit(False).alias("success"), F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("tokens"), F.lit("").alias("reason"), "error", F.lit("parse_error").alias("error_type"))
    fine.unionByName(bad).withColumn("run_id", F.lit(run)).write.mode("overwrite").parquet(made.at("results", run))
    made.point(run)
    return made


def collections(spark: SparkSession, root: str) -> list[Collection]:
    """Collections directly below a folder; names that begin with an underscore are left out."""
    store, path = fs.FileSystem.from_uri(root)
    found = (Collection(spark, f"{root.rstrip('/')}/{x.base_name}") for x in store.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.Directory and not x.base_name.startswith("_"))
    return sorted((c for c in found if c.run), key=lambda c: c.folder)


# --- models ----------------------------------------------------------------------------------------------------


def answers(requests: DataFrame, ask: Callable[[str], str], cache: str | None = None) -> DataFrame:
    """key and answer of requests (key, prompt), each key asked for once; cache: a folder whose answers are used and to
    which new ones are added before they are returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ask(p) for p in b.column(1).to_pylist()], pa.string())], ["key", "answer"])

    once = requests.dropDuplicates(["key"]).select("key", "prompt")
    if cache is None:
        return once.mapInArrow(run, "key string, answer string")
    spark = requests.sparkSession
    store, path = fs.FileSystem.from_uri(cache)
    known = spark.read.schema("key string, answer string").parquet(cache) if store.get_file_info(path).type == fs.FileType.Directory else spark.createDataFrame([], "key string, answer string")
    once.join(known, "key", "left_anti").mapInArrow(run, "key string, answer string").write.mode("append").parquet(cache)
    return spark.read.schema("key string, answer string").parquet(cache).join(once.select("key"), "key", "left_semi").dropDuplicates(["key"])


def refine(made: Collection, ask: Callable[[str], str], prompt: str = "{text}", model: str = "model", target: int = 8000, most: int = 50_000, cache: str | None = None) -> DataFrame:
    """path and refined text of every source: long ones in pieces that begin at headings, put together again in order."""
    long = X.estimate_tokens(F.col("text")) > most
    docs = made.table("sources").select("path", "text")
    pieces = chunking.refine_split(docs.filter(long), "path", "text", target).select("path", "chunk_index", "text").unionByName(docs.filter(~long).select("path", F.lit(0).alias("chunk_index"), "text"))
    asked = pieces.withColumn("prompt", F.replace(F.lit(prompt), F.lit("{text}"), F.col("text"))).withColumn("key", L.call_key(F.lit(model), F.sha2("prompt", 256), F.lit("")))
    got = asked.join(answers(asked, ask, cache), "key")
    return got.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "answer"))), lambda x: x["answer"]), "\n\n").alias("text"))


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], id_: str = "id") -> DataFrame:
    """id and embedding of texts, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(embed(b.column(1).to_pylist()), pa.list_(pa.float32()))], ["id", "embedding"])

    return texts.select(F.col(id_).alias("id"), "text").mapInArrow(run, "id string, embedding array<float>")


def ask(made: Collection, question: str, embed: Callable[[list[str]], list[list[float]]], k: int = 10, mode: str = "naive") -> DataFrame:
    """The k chunks nearest to a question.  Only the mode without a graph is there."""
    if mode not in _MODES:
        raise ValueError(f"mode {mode!r} needs a graph store; there is {', '.join(_MODES)}")
    chunks = made.table("chunks").withColumn("vec_id", F.xxhash64("path", "chunk_index"))
    vectors = embedded(chunks.select(F.col("vec_id").cast("string").alias("id"), "text"), embed).select(F.col("id").cast("long").alias("vec_id"), "embedding")
    probe = made.spark.createDataFrame([(-1, [float(x) for x in embed([question])[0]])], "vec_id long, embedding array<float>")
    return corpus.vector_topk(vectors, probe, k).join(chunks, "vec_id").select("place", "similarity", "id", "source", "text")


def enrich(made: Collection, hits: DataFrame, most: int = 5) -> DataFrame:
    """The collection's chunks with their entities (of ``entities.inverted`` or ``graph.hits``); the collection itself
    stays as it is."""
    return entities.enriched(made.table("chunks").withColumnRenamed("id", "chunk_id"), entities.top(hits, most))


def sourced(spark: SparkSession, folder: str) -> Callable[[], Iterator[dict[str, Any]]]:
    """A loader of records for other libraries: yields id, text and metadata one by one."""
    return partial(_records, spark, folder)


def _records(spark: SparkSession, folder: str) -> Iterator[dict[str, Any]]:
    for r in output.loaded(output.read_chunks(spark, folder)).toLocalIterator():
        yield {"id": r["id"], "page_content": r["text"], "metadata": r["metadata"]}
