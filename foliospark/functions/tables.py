"""Column expressions over lines of Markdown tables, and over whole texts line by line.

A table row is a line whose first character, white space aside, is a bar.  Other lines stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, stripped

PAGE_BREAK = "<!-- pagebreak -->"
_RULE = "^\\s*\\|[-:\\s|]+\\|\\s*$"


def is_row(line: Column) -> Column:
    return stripped(line).startswith("|")


def is_rule(line: Column) -> Column:
    """Whether a row holds bars, dashes, colons and white space only."""
    return line.rlike(_RULE)


def parts(line: Column) -> Column:
    """What stands between the bars, trimmed, the two ends included."""
    return F.transform(F.split(line, "\\|"), stripped)


def cells(line: Column) -> Column:
    """Cells that aren't empty."""
    return F.filter(parts(line), lambda c: c != "")


def cell_count(line: Column) -> Column:
    """Cells of a row, escaped bars left out; 0 for other lines."""
    s = F.replace(stripped(line), F.lit("\\|"), F.lit(""))
    row = stripped(line).startswith("|") & stripped(line).endswith("|")
    return F.when(row, F.greatest(F.lit(0), F.length(s) - F.length(F.replace(s, F.lit("|"))) - 1)).otherwise(0)


def joined(found: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(found, " | "), F.lit(" |"))


def _runs(found: Column) -> Column:
    """An array without items that equal the one before."""
    return F.filter(found, lambda c, i: (i == 0) | ~c.eqNullSafe(F.get(found, i - 1)))


def without_repeats(line: Column) -> Column:
    """A row of more than two cells with runs of equal neighbours as one cell, if that takes half of them or more."""

    def shorter(row: Column, found: Column, kept: Column) -> Column:
        fewer = (F.size(found) > 2) & (F.size(kept) < F.size(found)) & (F.size(kept) * 2 <= F.size(found))
        return F.when(fewer, joined(kept)).otherwise(row)

    return let(line, lambda x: F.when(is_row(x), let(cells(x), lambda f: let(_runs(f), lambda k: shorter(x, f, k)))).otherwise(x))


def without_empty(line: Column) -> Column:
    """A row without its empty and ``none`` cells if they are more than half (the ends count); empty if all are."""

    def fuller(row: Column, every: Column, kept: Column) -> Column:
        return F.when(F.size(kept) == 0, "").when(F.size(kept) * 2 < F.size(every), joined(kept)).otherwise(row)

    some = lambda every: F.filter(every, lambda c: (c != "") & (F.lower(c) != "none"))
    return let(line, lambda x: F.when(~is_row(x) | is_rule(x), x).otherwise(let(parts(x), lambda e: let(some(e), lambda k: fuller(x, e, k)))))


def by_line(text: Column, change: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), change), "\n")


def denoised(text: Column) -> Column:
    """A text with runs of equal cells collapsed in each row."""
    return by_line(text, without_repeats)


def _sheet(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: without_empty(without_repeats(x)))
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), lines), F.lit(1), F.size(lines))
    pairs = F.zip_with(lines, before, lambda x, p: F.struct(x.alias("x"), p.alias("p")))
    single = lambda z: is_row(z["x"]) & ~is_rule(z["x"]) & (F.size(cells(z["x"])) <= 1) & stripped(z["x"]).eqNullSafe(stripped(z["p"]))
    kept = F.transform(F.filter(pairs, lambda z: ~single(z)), lambda z: z["x"])
    return F.regexp_replace(F.array_join(kept, "\n"), "\n{4,}", "\n\n\n")


def clean_sheets(text: Column) -> Column:
    """A workbook's text, sheet by sheet: repeated and empty cells out, rows of one cell that repeat the row before
    out, at most two blank lines together."""
    return F.array_join(F.transform(F.split(text, PAGE_BREAK), _sheet), PAGE_BREAK)


def pairs_of(text: Column, rows: int = 20) -> Column:
    """Map of label to value from the first rows that have exactly two cells; a label's last value counts."""
    lines = F.filter(F.slice(F.split(text, "\n"), 1, rows), is_row)
    two = F.filter(F.transform(lines, lambda x: F.filter(parts(x), lambda c: (c != "") & (F.lower(c) != "none"))), lambda c: F.size(c) == 2)
    return F.aggregate(two, F.create_map().cast("map<string,string>"), lambda m, c: F.map_concat(F.map_filter(m, lambda k, _: k != F.element_at(c, 1)), F.create_map(F.element_at(c, 1), F.element_at(c, 2))))


def cell_text(value: Column) -> Column:
    """A number without a fraction of zero, a text trimmed; null is empty; bars are escaped."""
    whole = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "^(-?[0-9]+)\\.0+$", "$1")
    return F.replace(stripped(whole), F.lit("|"), F.lit("\\|"))
