"""What a collection is written as and read back from: Markdown files with front matter, chunk records, guides.

Tables are written by Spark's own sinks; single files are written by the tasks that hold their rows, under a name of
the attempt first and moved when whole, so a repeated attempt replaces what a lost one left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import headers as H
from foliospark.functions import labels as L
from foliospark.functions import text as X

FRONT_FIELDS = ("format", "title", "language", "pages", "mimetype", "binary_hash", "author", "created", "created_source")
CHUNK_SCHEMA = "id string, text string, metadata map<string,string>"


# --- front matter ----------------------------------------------------------------------------------------------


def front_matter(original: Column, fields: dict[str, Column], lists: dict[str, Column] | None = None, warnings: Column | None = None, extra: Column | None = None) -> Column:
    """YAML between two lines of dashes: source, the fields that aren't null, lists that aren't empty as blocks,
    warnings, and a map of extra fields as a nested block."""
    item = lambda v: F.concat(F.lit("  - "), L.yaml_scalar(v))
    lines = [F.lit("---"), F.concat(F.lit("source: "), L.yaml_scalar(L.basename(original)))]
    lines += [F.when(c.isNotNull(), F.concat(F.lit(f"{n}: "), L.yaml_scalar(c.cast("string")))) for n, c in fields.items()]
    lines += [F.when(F.size(c) > 0, F.concat(F.lit(f"{n}:\n"), F.array_join(F.transform(c, item), "\n"))) for n, c in (lists or {}).items()]
    if warnings is not None:
        lines.append(F.when(F.size(warnings) > 0, F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("warning: "), L.yaml_scalar(w))), "\n")))
    if extra is not None:
        pairs = F.transform(F.map_entries(extra), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), L.yaml_scalar(e["value"])))
        lines.append(F.when(F.size(extra) > 0, F.concat(F.lit("exif:\n"), F.array_join(pairs, "\n"))))
    return F.concat_ws("\n", *lines, F.lit("---"))


def front_of(text: Column) -> Column:
    """The YAML at a text's head, without its lines of dashes; empty if there is none."""
    return F.regexp_extract(text, "(?s)^---\n(.*?)\n---\n", 1)


def body_of(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)^---\n.*?\n---\n", "")


def unquoted(value: Column) -> Column:
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    return F.when(value.rlike('(?s)^".*"$'), F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))).otherwise(value)


def front_fields(text: Column) -> Column:
    """Map of the front matter's plain fields."""
    lines = F.filter(F.split(front_of(text), "\n"), lambda x: x.rlike("^[A-Za-z_]\\w*: ."))
    pair = lambda x: F.struct(F.regexp_extract(x, "^(\\w+): ", 1).alias("key"), unquoted(F.regexp_extract(x, "^\\w+: (.*)$", 1)).alias("value"))
    named = F.filter(F.transform(lines, pair), lambda p: p["key"] != "warning")
    once = F.aggregate(named, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, p: F.when(F.exists(acc, lambda q: q["key"] == p["key"]), acc).otherwise(F.array_append(acc, p)))
    return F.map_from_entries(once)


def front_tags(text: Column, name: str = "tags") -> Column:
    """The front matter's list of that name; empty if there is none."""
    block = F.regexp_extract(front_of(text), f"(?s)(?:^|\n){name}:\n((?:  - [^\n]*\n?)+)", 1)
    return F.transform(F.filter(F.split(block, "\n"), lambda x: x.startswith("  - ")), lambda x: unquoted(F.substring(x, 5, 1_000_000)))


def with_tags(text: Column, tags: Column) -> Column:
    """Text with its front matter's tags replaced (put last, if there were none); without front matter as it is."""
    front = F.regexp_replace(front_of(text), "(?:^|\n)tags:\n(?:  - [^\n]*(?:\n|$))+", "\n")
    front = F.regexp_replace(F.regexp_replace(front, "\n{2,}", "\n"), "^\n|\n$", "")
    block = F.when(F.size(tags) > 0, F.concat(F.lit("\ntags:\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), L.yaml_scalar(t))), "\n"))).otherwise("")
    return F.when(front_of(text) == "", text).otherwise(F.concat(F.lit("---\n"), front, block, F.lit("\n---\n"), body_of(text)))


def marked_down(sources: DataFrame) -> DataFrame:
    """name and content of each source (name, original_file, text, any of the front fields, tags, aliases)."""
    there = set(sources.columns)
    front = front_matter(F.col("original_file"), {c: F.col(c) for c in FRONT_FIELDS if c in there}, {c: F.col(c) for c in ("tags", "aliases") if c in there})
    return sources.select("name", F.concat(front, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("content"))


# --- files -----------------------------------------------------------------------------------------------------


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write every row (name, content) as a file in the folder; name and bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            sizes = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw, part = (content or "").encode(), f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(raw)
                store.move(part, f"{root}/{name}")
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return files.select("name", "content").mapInArrow(run, "name string, bytes long")


def read_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """path, name, front (map), tags, text of the Markdown files in a folder."""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value")
    return raw.select("path", "name", front_fields(F.col("value")).alias("front"), front_tags(F.col("value")).alias("tags"), F.regexp_replace(body_of(F.col("value")), "^\n", "").alias("text"))


# --- chunk records ---------------------------------------------------------------------------------------------


def chunk_records(chunks: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """id, text and metadata (a struct of all other columns) of chunks."""
    rest = [c for c in chunks.columns if c not in (id_, text)]
    return chunks.select(F.col(id_).alias("id"), F.col(text).alias("text"), F.struct(*rest).alias("metadata"))


def write_chunks(chunks: DataFrame, folder: str, append: bool = False) -> None:
    chunk_records(chunks).write.mode("append" if append else "overwrite").json(folder)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """id, text and metadata of JSON lines; lines that can't be read are left out."""
    raw = spark.read.text(path).select(F.from_json(F.trim("value"), CHUNK_SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).filter("r is not null")
    return raw.select("r.*").filter("id is not null or text is not null")


def chunks_by_id(records: DataFrame) -> DataFrame:
    """One record an id; of several the greatest text."""
    return records.filter(F.length("id") > 0).groupBy("id").agg(F.max_by(F.struct("text", "metadata"), "text").alias("r")).select("id", "r.text", "r.metadata")


def loaded(records: DataFrame, formats: list[str] | None = None, least: int = 0) -> DataFrame:
    """Records for a reader of texts: those with an id and text, of the formats, of ``least`` tokens or more; under a
    header of file and title unless they have one."""
    m = lambda k: F.col("metadata")[k]
    kept = records.filter((F.length("id") > 0) & (F.length(X.stripped(F.col("text"))) > 0))
    if formats:
        kept = kept.filter(F.lower(F.coalesce(m("format"), F.lit(""))).isin([f.lower() for f in formats]))
    if least > 0:
        kept = kept.filter(X.loader_tokens(F.col("text")) >= least)
    source = F.coalesce(m("source"), m("original_file"), F.lit(""))
    return kept.select("id", H.with_title(F.col("text"), m("original_file"), m("source"), m("title_path")).alias("text"), F.col("text").alias("original_text"), source.alias("source_file"), "metadata")


# --- guides ----------------------------------------------------------------------------------------------------


def guide_lines(entries: DataFrame, index: DataFrame, stats: DataFrame, summary: str = "") -> DataFrame:
    """part, pos and line of a guide to a collection: its summary, a table of files, keywords and totals."""
    sections = F.concat(F.array_join(F.slice("sections", 1, 4), ", "), F.when(F.size("sections") > 4, F.concat(F.lit(" … (+"), (F.size("sections") - 4).cast("string"), F.lit(")"))).otherwise(""))
    cell = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("original_file")), "format", "language", F.col("chunks_count").cast("string"), cell(sections)), F.lit(" |"))
    files = entries.select(F.lit(2).alias("part"), F.col("path").alias("pos"), row.alias("line"))
    words = index.select(F.lit(4).alias("part"), F.format_string("%012d %s", 10**12 - F.col("df"), F.col("keyword")).alias("pos"), F.concat(F.lit("- **"), "keyword", F.lit("**: "), F.col("df").cast("string"), F.lit(" files")).alias("line"))
    total = stats.select(F.lit(6).alias("part"), F.lit("").alias("pos"), F.format_string("- %d files, %d chunks, %s tokens; languages: %s", "total_files", "total_chunks", F.format_number("total_tokens", 0), F.array_join("languages", ", ")).alias("line"))
    fixed = [(0, "", "# Collection\n" + (f"\n{summary.strip()}\n" if summary else "")), (1, "", "## Files\n\n| file | format | language | chunks | sections |\n| --- | --- | --- | --- | --- |"), (3, "", "\n## Keywords\n"), (5, "", "\n## Totals\n")]
    head = entries.sparkSession.createDataFrame(fixed, "part int, pos string, line string")
    return head.unionByName(files).unionByName(words).unionByName(total)


def write_lines(lines: DataFrame, folder: str) -> None:
    """One text file of all lines in order of part and pos: for people, so for as many as people read."""
    lines.orderBy("part", "pos").coalesce(1).select("line").write.mode("overwrite").text(folder)
