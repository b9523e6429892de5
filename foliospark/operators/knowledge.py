"""The map of a collection: its index, keywords, tags, aliases and report of a run.

Files are rows (path, original_file, format, title, language, text); chunks rows with source (a file's path) and any of
title_path, sheet_name, language.  Keywords come from sections, title paths and sheet names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import labels as L
from foliospark.functions import text as X

_NOISE = "(?i)^(group|slide-\\d+|list)$"


def sections_of(text: Column) -> Column:
    """Titles of second-level headings, or of first-level ones if there are none."""
    lines = F.transform(F.split(text, "\n"), X.stripped)
    at = lambda mark: F.transform(F.filter(lines, lambda x: x.startswith(mark)), lambda x: X.stripped(F.substring(x, len(mark) + 1, 1_000_000)))
    second = at("## ")
    return F.when(F.size(second) > 0, second).otherwise(at("# "))


def index_entries(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row a file: path, original_file, format, title, language, tokens of its text, number of chunks, sections."""
    n = chunks.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("chunks_count"))
    blank = lambda c, other: F.coalesce(F.col(c), other)
    entry = files.select(
        "path", L.basename(F.col("original_file")).alias("original_file"), blank("format", F.lit("unknown")).alias("format"), blank("title", L.stem(F.col("original_file"))).alias("title"),
        blank("language", F.lit("")).alias("language"), X.estimate_tokens(F.col("text")).alias("tokens_estimated"), sections_of(F.col("text")).alias("sections"),
    )
    return entry.join(n, "path", "left").withColumn("chunks_count", F.coalesce("chunks_count", F.lit(0).cast("long")))


def index_stats(entries: DataFrame) -> DataFrame:
    """One row: files, chunks, tokens, and the languages and formats in order."""
    return entries.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("chunks_count"), F.lit(0)).alias("total_chunks"), F.coalesce(F.sum("tokens_estimated"), F.lit(0)).alias("total_tokens"), F.array_sort(F.collect_set(F.when(F.col("language") != "", F.col("language")))).alias("languages"), F.array_sort(F.collect_set("format")).alias("formats"))


def keyword_texts(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, pos, text: sections in order, then distinct title paths, then distinct sheet names, parsers' names left out."""
    own = entries.select("path", F.posexplode("sections").alias("at", "text")).select("path", F.struct(F.lit(0).alias("kind"), F.col("at").cast("string").alias("k"), "at").alias("pos"), "text")
    kinds = [own]
    for kind, column in ((1, "title_path"), (2, "sheet_name")):
        if column in chunks.columns:
            named = chunks.select(F.col("source").alias("path"), F.col(column).alias("text")).filter(F.length("text") > 0).distinct()
            named = named.join(entries.select("path"), "path", "left_semi")
            kinds.append(named.select("path", F.struct(F.lit(kind).alias("kind"), F.col("text").alias("k"), F.lit(0).alias("at")).alias("pos"), "text"))
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    # sections go by number, names in their own order
    return out.filter((F.col("text") != "") & (F.col("pos.kind").isin(2) | ~F.col("text").rlike(_NOISE))).select("path", F.struct(F.col("pos.kind"), F.when(F.col("pos.kind") == 0, F.lpad("pos.k", 12, "0")).otherwise(F.col("pos.k")).alias("k")).alias("pos"), "text")


def keyword_counts(texts: DataFrame) -> DataFrame:
    """path, keyword, times and first place of every keyword of each file."""
    each = texts.select("path", "pos", F.posexplode(X.keywords_in(F.col("text"))).alias("at", "keyword"))
    return each.groupBy("path", "keyword").agg(F.count("*").alias("times"), F.min(F.struct("pos", "at")).alias("first"))


def top_keywords(counts: DataFrame, most: int = 15) -> DataFrame:
    """The ``most`` frequent keywords of each file (a top-k report); ties by first place."""
    w = Window.partitionBy("path").orderBy(F.desc("times"), "first")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("path", "keyword", "times", "place")


def keyword_index(counts: DataFrame, files: int | DataFrame, share: float = 0.7, most: int = 50) -> DataFrame:
    """keyword and df of the keywords to find files by: those in at most ``share`` of three or more files, the ``most`` of
    greatest document frequency (a top-k report)."""
    df = counts.groupBy("keyword").agg(F.count("*").alias("df"))
    n = files if isinstance(files, int) else files.count()
    if n >= 3 and 0 < share < 1:
        df = df.filter(F.col("df") <= max(1, int(n * share)))
    return df.orderBy(F.desc("df"), "keyword").limit(most)


def postings(counts: DataFrame, index: DataFrame) -> DataFrame:
    """keyword, df and path: a row for each file of each keyword of the index, so that no keyword's files are one row."""
    return counts.select("keyword", "path").join(F.broadcast(index), "keyword")  # the index is a top-k report


def language_of(chunks: DataFrame) -> DataFrame:
    """source and language: the most frequent of its chunks, ties by the first chunk."""
    n = chunks.filter(F.length("language") > 0).groupBy("source", "language").agg(F.count("*").alias("n"), F.min("chunk_index").alias("first"))
    return n.groupBy("source").agg(F.max_by("language", F.struct("n", F.negate("first"))).alias("language"))


def keyword_tags(top: DataFrame, index: DataFrame, most: int = 5) -> DataFrame:
    """path and tags ``kw/…``: the first ``most`` of a file's keywords that the index has, or of all if it has none."""
    marked = top.join(F.broadcast(index.select("keyword", F.lit(True).alias("known"))), "keyword", "left")  # the index is a top-k report
    w = Window.partitionBy("path")
    some = marked.withColumn("any", F.max(F.coalesce("known", F.lit(False))).over(w)).filter(F.col("known").isNotNull() | ~F.col("any"))
    kept = some.withColumn("k", F.row_number().over(w.orderBy("place"))).filter(F.col("k") <= most)
    slugs = F.transform(F.array_sort(F.collect_list(F.struct("k", "keyword"))), lambda x: L.slug(x["keyword"]))
    return kept.groupBy("path").agg(F.transform(F.array_compact(slugs), lambda s: F.concat(F.lit("kw/"), s)).alias("tags"))


def merged_tags(existing: Column, more: Column) -> Column:
    """Tags with more of them behind, each once whatever its case."""
    both = F.concat(F.coalesce(existing, F.array().cast("array<string>")), F.coalesce(more, F.array().cast("array<string>")))
    low = F.transform(both, lambda t: F.lower(F.trim(t)))
    pairs = F.transform(F.arrays_zip(both.alias("t"), low.alias("k")), lambda z, i: F.struct(z["t"].alias("t"), z["k"].alias("k"), i.alias("i")))
    return F.aggregate(pairs, F.array().cast("array<struct<t:string,k:string,i:int>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.array_append(acc, x)), lambda acc: F.transform(acc, lambda x: x["t"]))


def derived_tags(format_: Column, language: Column) -> Column:
    """``format/…`` and ``lang/…`` of a file, those that it has."""
    tag = lambda head, c: F.when(F.length(X.stripped(c)) > 0, F.concat(F.lit(head), F.lower(X.stripped(c))))
    return F.array_compact(F.array(tag("format/", format_), tag("lang/", language)))


_GARBAGE = "(?i)^untitled\\d*$|^document\\d*$|^microsoft word - |^slide\\d+$|^\\s*$|^[0-9a-f]{64}$"
_PASSING = "(?i)\\bv\\d+\\b|\\bfinal\\b|_copy$|\\(\\d+\\)$|^tmp[_-]|副本|复件"


def is_garbage(name: Column, pattern: str = _GARBAGE) -> Column:
    return name.rlike(pattern)


def alias_key(name: Column) -> Column:
    """What two aliases are compared by: white space collapsed, lower case."""
    return F.lower(X.stripped(F.regexp_replace(name, f"{X.SPACE}+", " ")))


def aliases(title: Column, embedded_title: Column, path: Column, most: int = 5) -> Column:
    """Names of a file: its title, the embedded title, its stem; meaningless ones out, passing ones (copies, versions)
    last, each once."""
    one = lambda c, passing: F.when(F.length(X.stripped(c)) > 0, F.struct(X.stripped(c).alias("n"), passing.alias("p"), alias_key(c).alias("k")))
    no = F.lit(False)
    every = F.filter(F.array_compact(F.array(one(title, no), one(embedded_title, no), one(L.stem(path), L.stem(path).rlike(_PASSING)))), lambda x: ~is_garbage(x["n"]))
    once = F.aggregate(every, F.array().cast("array<struct<n:string,p:boolean,k:string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.array_append(acc, x)))
    names = lambda passing: F.transform(F.filter(once, lambda x: x["p"] == passing), lambda x: x["n"])
    return F.slice(F.concat(names(False), names(True)), 1, most)


def guide_entries(guide: DataFrame) -> DataFrame:
    """Rows of a search guide (query_type, strategy, target_files, examples) that lack nothing."""
    text = [F.length(F.coalesce(c, F.lit(""))) > 0 for c in ("query_type", "strategy")]
    lists = [F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0 for c in ("target_files", "examples")]
    return guide.filter(text[0] & text[1] & lists[0] & lists[1])


# --- runs ------------------------------------------------------------------------------------------------------


def run_totals(results: DataFrame) -> DataFrame:
    """Per run of file results (run_id, status, success, chunks, tokens): counts by status and sums of what succeeded."""
    ok = F.col("success")
    sums = [F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("long").alias(f"total_{c}") for c in ("chunks", "tokens")]
    states = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "cached", "forced")]
    return results.groupBy("run_id").agg(F.count("*").alias("total_files"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), *sums, *states)


def run_lines(results: DataFrame) -> DataFrame:
    """run_id, status and line of every file that a run changed or failed on (cached files are only counted)."""
    line = L.file_line(F.col("status"), F.col("path"), F.col("chunks"), F.col("reason"), F.col("error"), F.col("error_type"))
    return results.filter(F.col("status").isin("added", "updated", "forced", "failed")).select("run_id", "status", "path", line.alias("line"))


def run_headers(results: DataFrame, forced: bool = False) -> DataFrame:
    """run_id and the phrase of its counts."""
    n = run_totals(results)
    return n.select("run_id", F.concat(F.col("total_files").cast("string"), F.lit(" files ("), L.counts_phrase(F.col("cached"), F.col("added"), F.col("updated"), F.col("failed"), forced), F.lit(")")).alias("header"))


def source_names(files: DataFrame) -> DataFrame:
    """files (pos, path) with the name of each one's Markdown: ``stem.md``, or the first free ``stem_1.md``, ``stem_2.md``,
    … if an earlier file took it.  Stems that can meet share what is left without trailing numbers; of one such family
    names only are held at once, row by row in order of pos."""

    import pandas as pd

    family = F.regexp_replace(L.stem(F.col("path")), "(_\\d+)+$", "")

    def named(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        after: dict[str, int] = {}
        names = []
        for stem in pdf.sort_values("pos")["stem"]:
            name = stem
            while name in taken:
                after[stem] = after.get(stem, 0) + 1
                name = f"{stem}_{after[stem]}"
            taken.add(name)
            names.append(f"{name}.md")
        return pdf.sort_values("pos").assign(name=names)[["pos", "path", "name"]]

    kind = files.schema["pos"].dataType.simpleString()
    return files.select("pos", "path", L.stem(F.col("path")).alias("stem"), family.alias("family")).groupBy("family").applyInPandas(named, f"pos {kind}, path string, name string")
