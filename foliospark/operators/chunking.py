"""Chunkers: one row of Markdown to many token-bounded chunks.

The folds depend on order, so each is a plain function over one text, applied to Arrow batches; rows never meet and
nothing is shuffled.  ``Limits`` holds all settings.  Defined results: null and blank texts have no chunks; adjacent
equal chunks count once; rows with equal keys are chunked each for itself; rows of null key stay; very long texts are
folded whole, in time linear in their length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, LEAST, OVERLAP = 512, 100, 50
PAGE_BREAK = "<!-- pagebreak -->"
_WIDE = re.compile("[⺀-鿿豈-﫿︰-﹏가-힯\U00020000-\U0002fa1f]")
_SENTENCE = re.compile(r"(?<=[。．.!！?？])\s+")
_STAMP = re.compile(r"^\[(\d{1,2}):(\d{2})(?::(\d{2}))?\]\s*(.+)", re.MULTILINE)
_HEADING = re.compile(r"(#{1,6})\s+(.+)$")
_FENCE, _PIPES, _ITEM, _QUOTE = (re.compile(p) for p in (r"\s*`{3}", r"\s*\|.*\|\s*$", r"\s*(?:[-*+]|\d+\.)\s", r"\s*>"))
_THREE, _TWO = re.compile(r"^#{1,3}\s+.+$", re.MULTILINE), re.compile(r"^(#{1,2}\s+.+)$", re.MULTILINE)
_ROW, _RULE = re.compile(r"\s*\|.+\|\s*$"), re.compile(r"\s*\|[-:| ]+\|\s*$")
_COMMENT = re.compile(r"<!--.*?-->", re.DOTALL)
_SLIDE_STARTS = [
    re.compile(r"<!-- pagebreak\s*-->", re.IGNORECASE), re.compile(r"<!-- slide\b", re.IGNORECASE), re.compile(r"\s*[-*_]{3,}\s*$"),
    re.compile(r"#{1,2}\s+(?:slide|スライド|page|ページ)\s*\d+", re.IGNORECASE),
]
_PICTURES = re.compile(r"(<!--\s*image\s*-->\s*){2,}")
_PICTURE = re.compile(r"\s*<!--\s*image\s*-->\s*")


@dataclass(frozen=True)
class Limits:
    """Settings of all chunkers.  overflow: how far a block of a kind may pass ``most``; split_rows: kinds that are cut
    by rows beyond that (others stay whole)."""

    most: int = MOST
    least: int = LEAST
    overlap: int = OVERLAP
    overflow: dict[str, float] = field(default_factory=lambda: {"text": 1.5, "table": 2.0, "code": 3.0, "list": 1.5, "quote": 1.5})
    protect: tuple[str, ...] = ("code", "table", "list", "quote")
    split_rows: tuple[str, ...] = ("table",)
    rows_most: int | None = None
    repeat_header: bool = True
    levels: tuple[int, ...] = (1, 2, 3)
    prelude: str = "attach"  # or drop, alone
    lone_heading: str = "forward"  # or keep
    merge_small: bool = True
    cut_large: bool = True  # sections over ``most``; else they stay whole
    title: str = "deepest"  # or first, all

    def ceiling(self, kind: str) -> int:
        return int(self.most * self.overflow.get(kind, self.overflow["text"]))


DEFAULT = Limits()


@dataclass
class Piece:
    """A chunk on its way: text and where it comes from."""

    text: str
    title_path: str | None = None
    sheet_name: str | None = None
    slide_index: int | None = None
    start_seconds: int | None = None
    end_seconds: int | None = None


def tokens_of(text: str) -> int:
    wide = 0 if text.isascii() else len(_WIDE.findall(text))
    return max(1, int(wide * 1.5 + (len(text) - wide) * 0.25))


# --- protected blocks and greedy packing -----------------------------------------------------------------------


def protected(lines: list[str], kinds: Iterable[str] = DEFAULT.protect) -> list[tuple[int, int, str]]:
    """(first line, last line, kind) of code fences, tables, lists and quotes, in order; an open fence runs to the end."""
    kinds, out, i = set(kinds), [], 0

    def run(start: int, member: Callable[[str], object]) -> int:
        end = start + 1
        while end < len(lines) and member(lines[end]):
            end += 1
        return end

    while i < len(lines):
        line = lines[i]
        if "code" in kinds and _FENCE.match(line):
            end = min(run(i, lambda x: not _FENCE.match(x)) + 1, len(lines))
            out.append((i, end - 1, "code"))
        elif "table" in kinds and _PIPES.match(line):
            end = run(i, _PIPES.match)
            out.append((i, end - 1, "table"))
        elif "list" in kinds and _ITEM.match(line):
            end = run(i, lambda x: _ITEM.match(x) or (x.startswith("  ") and x.strip()))
            out.append((i, end - 1, "list"))
        elif "quote" in kinds and _QUOTE.match(line):
            end = run(i, _QUOTE.match)
            out.append((i, end - 1, "quote"))
        else:
            end = i + 1
        i = end
    return out


def segments(text: str, kinds: Iterable[str] = DEFAULT.protect) -> list[tuple[str, str]]:
    """(kind, text) of the protected blocks and of the runs of text between them that aren't blank."""
    lines, out, at = text.split("\n"), [], 0
    for first, last, kind in [*protected(lines, kinds), (len(lines), len(lines), "")]:
        between = "\n".join(lines[at:first])
        if between.strip():
            out.append(("text", between))
        if kind:
            out.append((kind, "\n".join(lines[first : last + 1])))
        at = last + 1
    return out


def by_budget(text: str, most: int = MOST) -> list[str]:
    """Longest pieces of at most ``most`` tokens each: for text without sentence ends."""
    if not text:
        return []
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = ((code >= 0x2E80) & (code <= 0x9FFF)) | ((code >= 0xF900) & (code <= 0xFAFF)) | ((code >= 0xFE30) & (code <= 0xFE4F)) | ((code >= 0xAC00) & (code <= 0xD7AF)) | ((code >= 0x20000) & (code <= 0x2FA1F))
    quarters = np.cumsum(np.where(wide, 6, 1))
    out, at = [], 0
    while at < len(text):
        used = int(quarters[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(quarters, used + 4 * (most + 1), "left")))
        out.append(text[at:to])
        at = to
    return out


def sentences(paragraph: str, most: int = MOST) -> list[str]:
    parts = _SENTENCE.split(paragraph)
    return [p.strip() for p in parts if p.strip()] if len(parts) > 1 else by_budget(paragraph, most)


def is_row(line: str) -> bool:
    return line.lstrip().startswith("|")


def is_rule(line: str) -> bool:
    """A line of a table that holds only dashes, colons and bars."""
    body = line.strip().strip("|")
    return is_row(line) and bool(body.strip()) and not body.strip(" :-|")


def split_table(text: str, most: int = MOST, repeat_header: bool = True, rows_most: int | None = None) -> list[str]:
    """A table cut between rows under a repeated header; lines before and behind it go with the first and last piece."""
    lines = text.split("\n")
    top = next((i for i, x in enumerate(lines) if is_row(x)), None)
    if top is None:
        return [text]
    first = top + (2 if top + 1 < len(lines) and is_rule(lines[top + 1]) else 1)
    last = first
    while last < len(lines) and is_row(lines[last]):
        last += 1
    if first == last:
        return [text]
    header = lines[top:first]
    budget = max(1, most - tokens_of("\n".join(header))) if repeat_header else most
    groups: list[list[str]] = [[]]
    held = 0
    for row in lines[first:last]:
        n = tokens_of(row)
        if groups[-1] and (held + n > budget or (rows_most is not None and len(groups[-1]) >= rows_most)):
            groups.append([])
            held = 0
        groups[-1].append(row)
        held += n
    pieces = [(header if repeat_header or not i else []) + g for i, g in enumerate(groups)]
    pieces[0] = lines[:top] + pieces[0]
    pieces[-1] = pieces[-1] + lines[last:]
    return ["\n".join(p) for p in pieces]


class _Pack:
    """Greedy accumulation; a held part under ``least`` tokens waits for what follows as far as a ceiling allows."""

    def __init__(self, limits: Limits):
        self.limits, self.done, self.parts, self.held = limits, [], [], 0

    def room(self, n: int, ceiling: int, joint: str) -> None:
        """Emit what is held if n more tokens don't fit."""
        if self.parts and self.held + n > self.limits.most and (self.held >= self.limits.least or self.held + n > ceiling):
            self.flush(joint)

    def add(self, piece: str, n: int) -> None:
        self.parts.append(piece)
        self.held += n

    def flush(self, joint: str) -> None:
        if self.parts:
            self.done.append(joint.join(self.parts))
        self.parts, self.held = [], 0

    def block(self, kind: str, text: str) -> None:
        n, ceiling = tokens_of(text), self.limits.ceiling(kind)
        if n <= ceiling:
            self.room(n, ceiling, "\n")
            self.add(text, n)
            return
        lead = ""
        if self.parts and self.held < self.limits.least:
            lead = "\n".join(self.parts) + "\n"
            self.parts, self.held = [], 0
        self.flush("\n")
        pieces = split_table(text, self.limits.most, self.limits.repeat_header, self.limits.rows_most) if kind == "table" and kind in self.limits.split_rows else [text]
        self.done += [lead + pieces[0], *pieces[1:]]

    def text(self, text: str) -> None:
        ceiling = self.limits.ceiling("text")
        for paragraph in filter(None, (p.strip() for p in text.split("\n\n"))):
            n = tokens_of(paragraph)
            self.room(n, ceiling, "\n\n")
            if n <= self.limits.most or self.held + n <= self.limits.most:
                self.add(paragraph, n)
                continue
            for s in sentences(paragraph, self.limits.most):
                n = tokens_of(s)
                self.room(n, ceiling, "\n\n")
                self.add(s, n)


def tail(text: str, target: int) -> str:
    """Whole blocks from the end of a chunk, up to ``target`` tokens, one at least."""
    kept, held = [], 0
    for block in reversed(text.split("\n\n")):
        n = tokens_of(block)
        if kept and held + n > target:
            break
        kept.append(block)
        held += n
        if held >= target:
            break
    return "\n\n".join(reversed(kept))


def recursive(text: str, limits: Limits = DEFAULT) -> list[str]:
    """Protected blocks, paragraphs, then sentences, packed greedily; each chunk begins with the last one's tail."""
    if not text.strip():
        return []
    pack = _Pack(limits)
    for kind, body in segments(text, limits.protect):
        pack.text(body) if kind == "text" else pack.block(kind, body)
    pack.flush("\n\n")
    found = pack.done
    if limits.overlap > 0:
        found = [c if not i else "\n\n".join(filter(None, (tail(pack.done[i - 1], limits.overlap), c))) for i, c in enumerate(found)]
    return [c for i, c in enumerate(found) if not i or c != found[i - 1]]


# --- headings --------------------------------------------------------------------------------------------------


def _headings(text: str) -> Iterator[tuple[int, str, str]]:
    """(level or 0, title, line) of each line."""
    for line in text.split("\n"):
        m = _HEADING.match(line)
        yield (len(m.group(1)), m.group(2).strip(), line) if m else (0, "", line)


def outlined(text: str, levels: Iterable[int] = DEFAULT.levels) -> list[tuple[str, int, str]]:
    """Sections by headings of the levels: path of titles, level (0 before the first heading) and text."""
    out: list[tuple[str, int, str]] = []
    stack: list[tuple[int, str]] = []
    held: list[str] = []
    path, own = "", 0

    def close() -> None:
        body = "\n".join(held).strip()
        if body:
            out.append((path, own, body))

    for level, title, line in _headings(text):
        if level and level in levels:
            close()
            held = []
            stack = [x for x in stack if x[0] < level] + [(level, title)]
            path, own = " > ".join(t for _, t in stack), level
        held.append(line)
    close()
    return out


def section_kind(text: str, path: str) -> str:
    """prelude (before any heading), heading (without a body) or normal."""
    lines = text.strip().split("\n")
    headed = [bool(_HEADING.match(x)) for x in lines]
    body = any(x.strip() and not h and not x.strip().startswith("<!--") for x, h in zip(lines, headed))
    if not any(headed) and not path:
        return "prelude"
    return "heading" if any(headed) and not body else "normal"


def title_of(paths: Iterable[str], how: str = "deepest") -> str:
    """The title of joined sections: that of most steps (then the longest, then the first), the first, or all."""
    named = [p for p in paths if p]
    if not named:
        return ""
    if how == "first":
        return named[0]
    if how == "all":
        return " | ".join(dict.fromkeys(named))
    return max(named, key=lambda p: (p.count(" > "), len(p)))


def headed(text: str, limits: Limits = DEFAULT) -> list[Piece]:
    """A chunk a section; preludes, lone headings and small sections wait for the next, large ones are cut if so set."""
    found = outlined(text, limits.levels)
    if not found:
        return []
    out: list[Piece] = []
    queue: list[tuple[str, str]] = []

    def joined() -> tuple[str, str]:
        return "\n\n".join(t for t, _ in queue if t.strip()), title_of((p for _, p in queue), limits.title)

    def emit(body: str, title: str) -> None:
        if limits.cut_large and tokens_of(body) > limits.most:
            out.extend(Piece(c, title) for c in recursive(body, limits))
        else:
            out.append(Piece(body, title))

    for path, _, body in found:
        kind = section_kind(body, path)
        if kind == "prelude" and limits.prelude == "drop":
            continue
        if (kind == "prelude" and limits.prelude == "alone") or (kind == "heading" and limits.lone_heading == "keep"):
            out.append(Piece(body, path))
            continue
        queue.append((body, path))
        if kind != "normal":
            continue
        body, title = joined()
        if limits.merge_small and tokens_of(body) < limits.least:
            queue = [(body, title)]
            continue
        queue = []
        emit(body, title)
    if queue:
        body, title = joined()
        if out and tokens_of(body) <= limits.most - limits.least:
            out[-1].text += "\n\n" + body
            out[-1].title_path = title_of((out[-1].title_path or "", title), limits.title)
        else:
            emit(body, title)
    return out


# --- sheets and slides -----------------------------------------------------------------------------------------


def cells_in(line: str) -> int:
    """Cells of a table row, escaped bars left out; 0 for other lines."""
    s = line.strip()
    return max(0, s.replace("\\|", "").count("|") - 1) if s.startswith("|") and s.endswith("|") else 0


def caption_rows(table: list[str]) -> int:
    """2 if a single-cell title and its rule stand over a wider header that the rows agree with, else 0."""
    if len(table) < 4 or cells_in(table[0]) != 1 or not _RULE.match(table[1]) or _RULE.match(table[2]):
        return 0
    width, sample = cells_in(table[2]), table[3:8]
    alike = sum(abs(cells_in(x) - width) <= 2 for x in sample)
    return 2 if width > 1 and alike >= max(1, len(sample) // 2) else 0


def table_pieces(header: str, rows: Iterable[str], most: int = MOST) -> list[str]:
    """Groups of table rows under a repeated header; a budget too small for rows is 200."""
    budget = most - tokens_of(header)
    budget = 200 if budget < 50 else budget
    out: list[str] = []
    held: list[str] = []
    n = 0
    for r in rows:
        t = tokens_of(r)
        if held and n + t > budget:
            out.append("\n".join([header, *held]))
            held, n = [], 0
        held.append(r)
        n += t
    return [*out, "\n".join([header, *held])] if held else out


def table_chunks(table: list[str], most: int = MOST) -> list[str]:
    """Row groups of a sheet's table, its caption kept with the header; none if it has no rows."""
    head = 3 if caption_rows(table) else 2
    return table_pieces("\n".join(table[:head]), table[head:], most)


def sheets(text: str) -> list[tuple[str, str]]:
    """(name, content) of each sheet: by page breaks (named by their first heading), else by headings of two levels."""
    if PAGE_BREAK in text:
        found = []
        for i, part in enumerate(text.split(PAGE_BREAK), 1):
            if part.strip():
                title = next((x.strip().lstrip("#").strip() for x in part.split("\n") if x.strip().startswith("#")), "")
                found.append((title or f"Sheet {i}", part.strip()))
        if found:
            return found
    lead, *rest = _TWO.split(text)
    named = [(h.strip().lstrip("#").strip(), body) for h, body in zip(rest[::2], rest[1::2])]
    return [("", lead)] * bool(lead.strip() or not named) + named


def tables_and_text(text: str) -> list[tuple[str, list[str]]]:
    """Runs of lines: tables (a row with a rule under it, and the rows that follow) and text."""
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        if i + 1 < len(lines) and _ROW.match(lines[i]) and _RULE.match(lines[i + 1]):
            end = i + 2
            while end < len(lines) and _ROW.match(lines[end]):
                end += 1
            out.append(("table", lines[i:end]))
            i = end
            continue
        if not out or out[-1][0] != "text":
            out.append(("text", []))
        out[-1][1].append(lines[i])
        i += 1
    return out


def sheeted(text: str, limits: Limits = DEFAULT) -> list[Piece]:
    out: list[Piece] = []
    for name, content in sheets(text):
        for kind, lines in tables_and_text(content):
            body = "\n".join(lines).strip()
            found = (table_chunks(lines, limits.most) if kind == "table" else []) or recursive(body, limits)
            out += [Piece(c, name or None, name or None) for c in found]
    return out


def slides(text: str) -> list[str]:
    """Slides by the first kind of mark that occurs: page break (left out), slide comment, rule, slide heading."""
    lines = text.split("\n")
    for mark in _SLIDE_STARTS:
        at = [i for i, x in enumerate(lines) if mark.match(x)]
        if at:
            spans = [(0, at[0]), *((i + bool(_SLIDE_STARTS[0].match(lines[i])), j) for i, j in zip(at, [*at[1:], len(lines)]))]
            return [s for s in ("\n".join(lines[i:j]).strip() for i, j in spans) if s]
    return []


def slide_title(slide: str) -> str:
    seen = (x.strip() for x in slide.split("\n"))
    return next((x.lstrip("#").strip() for x in seen if x and not x.startswith("<!--")), "")


def slided(text: str, limits: Limits = DEFAULT) -> list[Piece]:
    found = slides(text)
    if not found:
        return [Piece(c) for c in recursive(text, limits)]
    return [Piece(c, slide_title(s), slide_index=i) for i, s in enumerate(found) for c in ([s] if tokens_of(s) <= limits.most else recursive(s, limits))]


# --- transcripts -----------------------------------------------------------------------------------------------


def timestamped(text: str, most: int = MOST) -> list[tuple[str, int, int]]:
    """Chunks of transcript lines with their first and last seconds; text before the first line heads the first."""
    found = list(_STAMP.finditer(text))
    if not found:
        return []
    head = text[: found[0].start()].strip()
    out: list[tuple[str, int, int]] = []
    lines: list[str] = []
    held = start = end = 0
    for m in found:
        a, b, c = m.group(1), m.group(2), m.group(3)
        at = int(a) * 60 + int(b) if c is None else int(a) * 3600 + int(b) * 60 + int(c)
        n = tokens_of(m.group(0))
        if lines and held + n > most:
            out.append(("\n\n".join(lines), start, end))
            lines, held = [], 0
        if not lines:
            start = at
        lines.append(m.group(0))
        held += n
        end = at
    out.append(("\n\n".join(lines), start, end))
    if head:
        out[0] = (head + "\n\n" + out[0][0], *out[0][1:])
    return out


def timed(text: str, limits: Limits = DEFAULT) -> list[Piece]:
    """Transcript chunks; a text without time marks is cut like any other."""
    return [Piece(c, None, None, None, a, b) for c, a, b in timestamped(text, limits.most)] or [Piece(c) for c in recursive(text, limits)]


# --- routing ---------------------------------------------------------------------------------------------------

STRATEGIES = {
    **dict.fromkeys(("png", "jpg", "jpeg", "tiff", "bmp", "webp", "gif"), "whole"),
    **dict.fromkeys(("mp3", "wav", "m4a", "flac", "aac", "ogg", "wma", "opus", "mp4", "avi", "mkv", "webm", "mov", "wmv", "flv", "ts", "m4v"), "timestamp"),
    "pptx": "slide", "xlsx": "sheet", "csv": "sheet",
}


def structure_score(text: str, headings_least: int = 3, jump_most: int = 2) -> int:
    """0 to 3: enough headings of three levels; no jump down of more than ``jump_most`` levels; half of the sections or
    more of 100 to 2000 tokens (four characters each)."""
    levels = [len(x) for x in re.findall(r"^(#{1,6})\s+", text, re.MULTILINE)]
    sizes = [len(x.strip()) // 4 for x in _THREE.split(text)[1:]]
    fair = sum(100 <= n <= 2000 for n in sizes)
    return (len(sizes) >= headings_least) + all(b - a <= jump_most for a, b in zip(levels, levels[1:])) + (bool(sizes) and 2 * fair >= len(sizes))


def strategy_of(text: str, format_: str | None, headed_from: int = 2) -> str:
    """whole, timestamp, slide or sheet by format; else heading or recursive by structure."""
    return STRATEGIES.get((format_ or "").lower()) or ("heading" if structure_score(text) >= headed_from else "recursive")


_BY_NAME: dict[str, Callable[[str, Limits], list[Piece]]] = {
    "heading": headed, "sheet": sheeted, "slide": slided, "timestamp": timed,
    "whole": lambda t, _: [Piece(t)], "recursive": lambda t, limits: [Piece(c) for c in recursive(t, limits)],
}


def pieces_by(strategy: str, text: str, limits: Limits = DEFAULT) -> list[Piece]:
    return _BY_NAME[strategy](text, limits) if text.strip() else []


# --- after chunking --------------------------------------------------------------------------------------------


def without_picture_noise(text: str) -> str:
    """Picture marks left out where they were described, runs of them as one, at most two blank lines in a row."""
    if "<!-- vision-enriched -->" in text:
        text = _PICTURE.sub("\n\n", text)
    return re.sub(r"\n{4,}", "\n\n\n", _PICTURES.sub("<!-- image -->\n\n", text)).strip()


def is_fragment(text: str, least: int = LEAST) -> bool:
    """Under ``least`` tokens without comments and marks of headings."""
    return tokens_of(re.sub(r"^#{1,6}\s+", "", _COMMENT.sub("", text).strip(), flags=re.MULTILINE).strip()) < least


def same_section(a: Piece, b: Piece) -> bool:
    """Whether the first of sheet, title and slide that both have is equal; true if they have none."""
    for key in ("sheet_name", "title_path", "slide_index"):
        x, y = getattr(a, key), getattr(b, key)
        if x is not None and y is not None:
            return x == y
    return True


def settled(found: list[Piece], least: int = LEAST) -> list[Piece]:
    """Picture noise gone; fragments joined to the chunk before, else to the one behind, of the same section."""
    back: list[Piece] = []
    for p in found:
        p.text = without_picture_noise(p.text)
        if back and is_fragment(p.text, least) and same_section(back[-1], p):
            back[-1].text += "\n\n" + p.text
        else:
            back.append(p)
    out: list[Piece] = []
    for p, after in zip(back, [*back[1:], None]):
        if after is not None and is_fragment(p.text, least) and same_section(p, after):
            after.text = p.text + "\n\n" + after.text
        else:
            out.append(p)
    return out


def has_table(text: str) -> bool:
    return "|" in text and "---" in text


def has_picture(text: str) -> bool:
    return "<!-- image" in text or "<!-- vision" in text


def refine_pieces(text: str, target: int) -> list[str]:
    """Pieces of about ``target`` tokens, each but the first beginning at a heading outside protected blocks.  The
    tokens of a heading count before its test only."""
    lines = text.split("\n")
    spans = protected(lines)
    starts = [a for a, _, _ in spans]
    out, first, held = [], 0, 0
    for i, line in enumerate(lines):
        held += tokens_of(line)
        bare = line.lstrip()
        k = bisect_right(starts, i) - 1
        inside = k >= 0 and i <= spans[k][1]
        if i and held >= target and not inside and bare.startswith("#") and " " in bare:
            out.append("\n".join(lines[first:i]).strip())
            first, held = i, 0
    return [p for p in [*out, "\n".join(lines[first:]).strip()] if p]


# --- tables of chunks ------------------------------------------------------------------------------------------

_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_FIXED = "chunk_index int, total_chunks int, tokens int, text string"
_HELD, _ROWS = 1 << 20, 2048  # characters and rows that leave as one batch, so that a task holds no batch of texts twice


def _apply(docs: DataFrame, text: str, fold: Callable[..., list[tuple]], extra: str, keep: list[str], inputs: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``fold(text, *inputs)`` (text first, then ``extra``), numbered, beside the columns to keep."""
    fields = _FIXED + (", " + extra if extra else "")
    made = [x.split()[0] for x in fields.split(", ")]
    clash = {k.lower() for k in keep} & set(made)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")

    def made_of(batch: pa.RecordBatch, rows: list[tuple], own: list[int]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(made)
        taken = [batch.column(i).take(pa.array(own, pa.int64())) for i in range(len(keep))]
        return pa.RecordBatch.from_arrays([*taken, *(pa.array(list(c), _KINDS[x.split()[1]]) for c, x in zip(cols, fields.split(", ")))], [*keep, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, own, held = [], [], 0
            texts = batch.column(len(keep))
            given = [batch.column(len(keep) + 1 + i) for i in range(len(inputs))]
            for r in range(batch.num_rows):
                if not texts[r].is_valid:
                    continue
                chunks = fold(texts[r].as_py(), *(g[r].as_py() for g in given))
                rows += [(i, len(chunks), tokens_of(c[0]), *c) for i, c in enumerate(chunks)]
                own += [r] * len(chunks)
                held += sum(len(c[0]) for c in chunks)
                if held >= _HELD or len(rows) >= _ROWS:
                    yield made_of(batch, rows, own)
                    rows, own, held = [], [], 0
            yield made_of(batch, rows, own)

    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), fields])
    return docs.select(*[F.col(f"`{k}`") for k in keep], F.col(text).alias("fold_text"), *[F.col(c).alias(f"fold_{i}") for i, c in enumerate(inputs)]).mapInArrow(run, schema)


def chunk_recursive(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    return _apply(docs, text, lambda t: [(c,) for c in recursive(t, limits)], "", [key, *keep])


def chunk_timestamps(docs: DataFrame, key: str, text: str = "markdown", keep: tuple[str, ...] = ()) -> DataFrame:
    return _apply(docs, text, timestamped, "start_seconds long, end_seconds long", [key, *keep])


def chunk_outline(docs: DataFrame, key: str, text: str = "markdown", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a section, as it is."""
    return _apply(docs, text, lambda t: [(body, path, level) for path, level, body in outlined(t)], "title_path string, level int", [key, *keep])


def chunk_headings(docs: DataFrame, key: str, text: str = "markdown", limits: Limits = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    return _apply(docs, text, lambda t: [(p.text, p.title_path) for p in headed(t, limits)], "title_path string", [key, *keep])


def chunk_sheets(docs: DataFrame, key: str, text: str = "markdown", limits: Limits = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    return _apply(docs, text, lambda t: [(p.text, p.sheet_name) for p in sheeted(t, limits)], "sheet_name string", [key, *keep])


def chunk_slides(docs: DataFrame, key: str, text: str = "markdown", limits: Limits = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    return _apply(docs, text, lambda t: [(p.text, p.title_path, p.slide_index) for p in slided(t, limits)], "title_path string, slide_index int", [key, *keep])


def split_tables(tables: DataFrame, key: str, text: str = "markdown", most: int = MOST) -> DataFrame:
    """Sheets' tables (header, rule, rows) cut into groups of rows that fit."""
    return _apply(tables, text, lambda t: [(c,) for c in table_chunks(t.split("\n"), most)], "", [key])


def split_long_tables(tables: DataFrame, key: str, text: str = "markdown", most: int = MOST, rows_most: int | None = None) -> DataFrame:
    """Tables amid text cut between rows; lines around them stay."""
    return _apply(tables, text, lambda t: [(c,) for c in split_table(t, most, True, rows_most)], "", [key])


def refine_split(docs: DataFrame, key: str, text: str = "text", target: int = 8000) -> DataFrame:
    return _apply(docs, text, lambda t: [(c,) for c in refine_pieces(t, target)], "", [key])


_ALL = "strategy string, title_path string, sheet_name string, slide_index int, start_seconds long, end_seconds long, has_table boolean, has_image_ref boolean"


def chunk_auto(docs: DataFrame, key: str, text: str = "markdown", format_: str = "format", limits: Limits = DEFAULT, settle: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row by the strategy of its format or structure, fragments joined (``settle``)."""

    def fold(t: str, kind: str | None) -> list[tuple]:
        how = strategy_of(t, kind)
        found = pieces_by(how, t, limits)
        found = settled(found, limits.least) if settle else found
        return [(p.text, how, p.title_path, p.sheet_name, p.slide_index, p.start_seconds, p.end_seconds, has_table(p.text), has_picture(p.text)) for p in found]

    return _apply(docs, text, fold, _ALL, [key, *keep], (format_,))


def postprocess(sectioned: DataFrame, key: str, limits: Limits = DEFAULT) -> DataFrame:
    """Chunks of other chunkers (key, chunk_index, text and any of title_path, sheet_name, slide_index), fragments
    joined.  A document's chunks meet in one group: no more than its text."""
    given = [c for c in ("title_path", "sheet_name", "slide_index") if c in sectioned.columns]
    kinds = {c: sectioned.schema[c].dataType.simpleString() for c in given}
    fields = f"{key} {sectioned.schema[key].dataType.simpleString()}, chunk_index int, total_chunks int, tokens int, text string, " + ", ".join([*(f"{c} {kinds[c]}" for c in given), "has_table boolean, has_image_ref boolean"])

    def one(t: pa.Table) -> pa.Table:
        rows = t.sort_by("chunk_index").to_pylist()
        found = settled([Piece(r["text"] or "", **{c: r[c] for c in given}) for r in rows], limits.least)
        own = rows[0][key]
        cols = [[own] * len(found), range(len(found)), [len(found)] * len(found), [tokens_of(p.text) for p in found], [p.text for p in found], *([getattr(p, c) for p in found] for c in given), [has_table(p.text) for p in found], [has_picture(p.text) for p in found]]
        types = [t.schema.field(key).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), *(t.schema.field(c).type for c in given), pa.bool_(), pa.bool_()]
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, types)], names=[x.split()[0] for x in fields.split(", ")])

    return sectioned.select(key, "chunk_index", "text", *given).groupBy(key).applyInArrow(one, fields)
