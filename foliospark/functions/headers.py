"""Column expressions for the lines in front of a chunk: its path, and the entities that it speaks of.

All are idempotent: a header that is there already isn't put there again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import basename

PATH_MARK, PATH_MARK_EN, ENTITY_MARK = "[来源:", "[Source:", "[关键实体: "
SEPARATOR = "<SEP>"


def with_path(text: Column, source: Column, title: Column) -> Column:
    """Text under a line of its source and title; without a source as it is."""
    line = F.concat(F.lit(PATH_MARK + " "), source, F.when(F.length(title) > 0, F.concat(F.lit(" > "), title)).otherwise(""), F.lit("]\n"))
    return F.when((F.length(source) > 0) & ~text.startswith(PATH_MARK), F.concat(line, text)).otherwise(text)


def with_title(text: Column, original: Column, source: Column, title: Column) -> Column:
    """Text under ``[file > title]``, unless a header of either kind is there."""
    named = F.when(F.length(original) > 0, basename(original)).when(F.length(source) > 0, basename(source))
    bits = F.concat_ws(" > ", named, F.when(F.length(title) > 0, title))
    line = F.concat(F.lit("["), bits, F.lit("]\n"))
    there = F.regexp_replace(text, "(?U)^\\s+", "").startswith(PATH_MARK) | F.regexp_replace(text, "(?U)^\\s+", "").startswith(PATH_MARK_EN) | text.startswith(line)
    return F.when(there | (bits == ""), text).otherwise(F.concat(line, text))


def fields_of(joined: Column) -> Column:
    """Parts between separators, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(joined, F.lit("")), SEPARATOR), lambda x: F.trim(x)), lambda x: x != "")


def description_of(content: Column) -> Column:
    """First description of an entity's ``name, line break, descriptions``."""
    tail = F.when(F.instr(content, "\n") > 0, F.substring(content, F.instr(content, "\n") + 1, F.length(content))).otherwise("")
    return F.coalesce(F.try_element_at(fields_of(tail), F.lit(1)), F.trim(tail))


def shortened(text: Column, most: int = 100) -> Column:
    """At most ``most`` characters, the last of them an ellipsis if some are cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most - 1), "(?U)\\s+$", ""), F.lit("…")))


def entity_line(entities: Column, most: int = 100) -> Column:
    """``[关键实体: A — what it is; B]`` of an array of (name, description); empty for none."""
    one = lambda e: F.concat(e["name"], F.when(F.length(e["description"]) > 0, F.concat(F.lit(" — "), shortened(e["description"], most))).otherwise(""))
    return F.when(F.size(entities) > 0, F.concat(F.lit(ENTITY_MARK), F.array_join(F.transform(entities, one), "; "), F.lit("]"))).otherwise("")


def without_entities(text: Column) -> Column:
    """Text without an entity line among its first three."""
    lines = F.split(text, "\n", 4)
    marked = F.transform(lines, lambda x, i: F.struct(x.alias("x"), ((i < 3) & F.ltrim(x).startswith(ENTITY_MARK)).alias("hit"), i.alias("i")))
    first = F.array_min(F.transform(F.filter(marked, lambda m: m["hit"]), lambda m: m["i"]))
    kept = F.transform(F.filter(marked, lambda m: ~m["i"].eqNullSafe(first)), lambda m: m["x"])
    return F.when(first.isNull(), text).otherwise(F.array_join(kept, "\n"))


def with_entities(text: Column, line: Column) -> Column:
    """Text with the entity line behind its path header, or in front."""
    at = F.when(text.startswith(PATH_MARK) | text.startswith(PATH_MARK_EN), F.instr(text, "\n")).otherwise(F.lit(-1))
    head = F.when(at > 0, F.substring(text, F.lit(1), at)).otherwise("")
    rest = F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text)
    put = F.when(at == 0, F.concat(text, F.lit("\n"), line, F.lit("\n"))).otherwise(F.concat(head, line, F.lit("\n"), rest))
    return F.when((line == "") | rest.startswith(line), text).otherwise(put)
