"""Cleaning of whole texts and of texts across a corpus: repeated lines, descriptions of pages, page marks.

Folds over one text run on Arrow batches without a shuffle.  Defined results: null texts stay null, texts without what
is cleaned stay as they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import SPACE, stripped
from foliospark.operators.chunking import PAGE_BREAK

_STRUCTURE = ("#", "|", ">", "*", "-", "```", "<!--")
_STAMP = re.compile(r"\[(\d{1,2}):(\d{2})(?::(\d{2}))?\]")
DESCRIBED = "<!-- vision-enriched -->"


def map_text(df: DataFrame, change: Callable[[str], str], text: str = "text") -> DataFrame:
    """df with a function applied to its text column, batch by batch; other columns pass through."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if t is None else change(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return df.mapInArrow(run, df.schema)


def is_furniture(line: str, longest: int = 120) -> bool:
    """Whether a line can be a page's furniture: some text, no Markdown structure, not too long."""
    bare = line.strip()
    return bool(bare) and not bare.startswith(_STRUCTURE) and len(bare) <= longest


def strip_pages(text: str, least: int = 3, longest: int = 120, numbers: bool = False) -> str:
    """Lines that stand on ``least`` or more pages left out but for the first time; numbers: lines of up to three digits
    as well.  White space doesn't count.  A text of fewer pages stays."""
    lines = text.splitlines()
    if sum(PAGE_BREAK in x for x in lines) + 1 < least or PAGE_BREAK not in text:
        return text
    pages: dict[str, set[int]] = defaultdict(set)
    keys: list[str | None] = []
    page = 0
    for x in lines:
        broken = PAGE_BREAK in x
        keys.append(re.sub(r"\s+", "", x) if not broken and is_furniture(x, longest) else None)
        if keys[-1]:
            pages[keys[-1]].add(page)
        page += broken
    seen: set[str] = set()
    out = []
    for x, key in zip(lines, keys):
        if key and len(pages[key]) >= least:
            if key in seen:
                continue
            seen.add(key)
        elif numbers and re.match(r"\s*\d{1,3}\s*$", x):
            continue
        out.append(x)
    return "\n".join(out) if len(out) < len(lines) else text


def strip_repeating(docs: DataFrame, least: int = 3, longest: int = 120) -> DataFrame:
    """docs (doc_id, source, text) with each line that ``least`` or more documents of a source have kept in the first
    of them only; ``removed`` counts the lines left out.  Short lines and places are shuffled, texts aren't unless many
    documents lose lines; rows of one id count as one document, rows of null id stay as they are."""
    name = stripped(F.col("line"))
    fit = (name != "") & (F.length(name) <= longest) & ~name.rlike("^(?:[#|>*-]|```|<!--)")
    lines = docs.filter("doc_id is not null").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(fit)
    lines = lines.select("source", "doc_id", "at", F.regexp_replace("line", f"{SPACE}+", "").alias("key"))
    first = F.min(F.struct("doc_id", "at")).alias("first")
    held = lines.groupBy("source", "key").agg(F.countDistinct("doc_id").alias("docs"), first).filter(F.col("docs") >= least)
    a, b = lines.alias("a"), held.alias("b")
    later = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.key") == F.col("b.key"))).filter(F.struct("a.doc_id", "a.at") != F.col("b.first"))
    gone = later.groupBy(F.col("a.doc_id").alias("gone_id")).agg(F.collect_set("a.at").alias("gone"))
    both = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", i)), "\n")
    return both.select(*[F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns], F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))


# --- pages and their descriptions ------------------------------------------------------------------------------


def splice_frames(text: str, times: list[float]) -> str:
    """A page break in front of the first time-stamped line that isn't before each frame; frames left over go last."""
    out, k = [], 0
    for line in text.split("\n"):
        m = _STAMP.match(line.strip())
        if m:
            a, b, c = m.groups()
            at = int(a) * 60 + int(b) if c is None else int(a) * 3600 + int(b) * 60 + int(c)
            while k < len(times) and times[k] <= at:
                out.append(PAGE_BREAK)
                k += 1
        out.append(line)
    return "\n".join(out + [PAGE_BREAK] * (len(times) - k)) if times else text


def inject_descriptions(text: Column, pages: Column) -> Column:
    """Descriptions (array of (page, text), pages from 0) behind their pages' sections; those beyond the last section go
    to the end, as all do if the text has no page breaks."""
    parts = F.split(text, PAGE_BREAK)
    end = lambda s: F.regexp_replace(s, "(?U)\\s+$", "")
    own = lambda i: F.try_element_at(F.filter(pages, lambda p: p["page"] == i), F.lit(1))
    over = F.array_sort(F.filter(pages, lambda p: p["page"] >= F.size(parts)))
    extra = F.array_join(F.transform(over, lambda p: F.concat(F.lit("<!-- vision-enriched page="), (p["page"] + 1).cast("string"), F.lit(" (overflow) -->\n"), p["text"])), "\n\n")
    filled = F.transform(parts, lambda s, i: F.when(own(i).isNotNull(), F.concat(end(s), F.lit(f"\n\n{DESCRIBED}\n"), own(i)["text"], F.lit("\n"))).otherwise(s))
    tailed = F.transform(filled, lambda s, i: F.when((i == F.size(filled) - 1) & (F.size(over) > 0), F.concat(end(s), F.lit("\n\n"), extra, F.lit("\n"))).otherwise(s))
    listed = F.array_join(F.transform(F.array_sort(pages), lambda p: F.concat(F.lit("<!-- vision-enriched page="), (p["page"] + 1).cast("string"), F.lit(" -->\n"), p["text"])), "\n\n")
    appended = F.when(F.size(pages) > 0, F.concat(end(text), F.lit("\n\n"), listed, F.lit("\n"))).otherwise(text)
    return F.when(F.size(parts) > 1, F.array_join(tailed, PAGE_BREAK)).otherwise(appended)


def described_only(text: str, ratio: float = 0.7, least: int = 200) -> str:
    """In each section with a description that is long enough, the description alone (front matter stays)."""

    def one(section: str) -> str:
        before, mark, after = section.partition(DESCRIBED)
        if not mark:
            return section
        before, after = before.strip(), after.strip()
        front = ""
        if before.startswith("---\n") and "\n---" in before[4:]:
            end = before.index("\n---", 4) + 4
            front, before = before[:end] + "\n\n", before[end:].strip()
        return front + after if not before or (len(after) >= ratio * len(before) and len(after) >= least) else section

    return PAGE_BREAK.join(map(one, text.split(PAGE_BREAK)))


def name_sections(text: str, names: list[str]) -> str:
    """Each section's name as a heading over it, unless its first line is that heading."""

    def headed(section: str, name: str) -> bool:
        first = next((x.strip() for x in section.split("\n") if x.strip()), "")
        return first.startswith("#") and first.lstrip("#").lstrip() == name

    if PAGE_BREAK not in text:
        return text if not names or not names[0] or headed(text, names[0].strip()) else f"## {names[0]}\n\n{text}"
    out = text.split(PAGE_BREAK)
    for i, name in enumerate(n.strip() for n in names[: len(out)]):
        body = out[i].strip()
        if name and not (body and headed(body, name)):
            out[i] = f"\n## {name}\n\n{body}\n" if body else f"\n## {name}\n"
    return PAGE_BREAK.join(out)


def is_generated_name(name: str) -> bool:
    """Whether a group's name looks like a parser's: lower-case ASCII letters, digits, dashes and underscores."""
    return bool(re.fullmatch(r"[a-z0-9_-]+", name))


def add_sections(text: Column, extras: Column) -> Column:
    """Texts (array of (page, text)) behind their pages' sections; those of no section are left out, and without page
    breaks all go to the end."""
    parts = F.split(text, PAGE_BREAK)
    own = lambda i: F.array_join(F.transform(F.filter(extras, lambda p: p["page"] == i), lambda p: p["text"]), "\n\n")
    put = lambda s, more: F.when(more != "", F.concat(F.regexp_replace(s, "(?U)\\s+$", ""), F.lit("\n\n"), more, F.lit("\n"))).otherwise(s)
    every = F.array_join(F.transform(F.array_sort(extras), lambda p: p["text"]), "\n\n")
    return F.when(F.size(parts) > 1, F.array_join(F.transform(parts, lambda s, i: put(s, own(i))), PAGE_BREAK)).otherwise(put(text, every))
