"""Office files (DOCX, XLSX, PPTX) by their XML: text as Markdown, counts before work, drawings and charts.

Only what the formats' XML says is read; nothing is rendered.  A damaged file gives no text and an error.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.operators.chunking import PAGE_BREAK
from foliospark.sources import equations

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
_X = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def cell_text(value: object) -> str:
    """A number without a fraction of zero, a text trimmed; None is empty; bars are escaped."""
    if value is None:
        return ""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return str(value).strip().replace("|", "\\|")


def table(rows: list[list[str]]) -> str:
    """A Markdown table, its first row as the header."""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets by id of a part's relations, as paths in the archive."""
    folder, name = posixpath.split(part)
    try:
        root = ET.fromstring(z.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    target = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return {r.get("Id", ""): target(r.get("Target", "")) for r in root.iter(f"{_REL}Relationship") if r.get("TargetMode") != "External"}


# --- DOCX ------------------------------------------------------------------------------------------------------


def _paragraph(p: ET.Element) -> str:
    """Text of a paragraph, its equations as LaTeX."""
    if p.tag in (f"{equations.M}oMath", f"{equations.M}oMathPara"):
        return equations.inline(p)
    own = (p.text or "") if p.tag == f"{_W}t" else "\t" if p.tag == f"{_W}tab" else "\n" if p.tag == f"{_W}br" else ""
    return own + "".join(map(_paragraph, p))


def docx(content: bytes) -> str:
    """Headings, paragraphs, list items and tables in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}tbl":
            rows = [[cell_text(" ".join(_paragraph(p) for p in c.iter(f"{_W}p"))) for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            if any(rows):
                out.append(table(rows))
        elif node.tag == f"{_W}p" and (text := _paragraph(node).strip()):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"(?i)heading\s*([1-6])", style.get(f"{_W}val", "") if style is not None else "")
            item = node.find(f"{_W}pPr/{_W}numPr") is not None
            out.append("#" * int(level.group(1)) + " " + text if level else "- " + text if item else text)
    return "\n\n".join(out)


# --- XLSX ------------------------------------------------------------------------------------------------------


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of every sheet that isn't hidden, in order."""
    book, found = ET.fromstring(z.read("xl/workbook.xml")), relations(z, "xl/workbook.xml")
    return [(s.get("name", ""), found[s.get(f"{_R}id", "")]) for s in book.iter(f"{_S}sheet") if s.get("state", "visible") == "visible" and s.get(f"{_R}id", "") in found]


def sheet_rows(z: zipfile.ZipFile, part: str, strings: list[str]) -> list[list[str]]:
    """Rows of cells; a merged range has its value in each of its cells."""
    root, rows = ET.fromstring(z.read(part)), {}
    for c in root.iter(f"{_S}c"):
        where, v = c.get("r", "A1"), c.find(f"{_S}v")
        row = int(re.sub(r"\D", "", where) or 1)
        if c.get("t") == "s":
            value: object = strings[int(v.text)] if v is not None and v.text else None
        elif c.get("t") == "inlineStr":
            value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
        else:
            value = v.text if v is not None else None
            if value and c.get("t") in (None, "n"):
                value = float(value) if re.fullmatch(r"-?\d+(\.\d+)?([eE][-+]?\d+)?", value) else value
        rows.setdefault(row, {})[column_number(where)] = cell_text(value)
    for m in root.iter(f"{_S}mergeCell"):
        a, _, b = m.get("ref", "").partition(":")
        if b:
            top, left, bottom, right = int(re.sub(r"\D", "", a)), column_number(a), int(re.sub(r"\D", "", b)), column_number(b)
            value = rows.get(top, {}).get(left, "")
            for r in range(top, bottom + 1):
                for k in range(left, right + 1):
                    rows.setdefault(r, {})[k] = value
    return [[cells.get(k, "") for k in range(max(cells) + 1)] for _, cells in sorted(rows.items()) if any(cells.values())]


def _strings(z: zipfile.ZipFile) -> list[str]:
    try:
        root = ET.fromstring(z.read("xl/sharedStrings.xml"))
    except KeyError:
        return []
    return ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in root.iter(f"{_S}si")]


def xlsx(content: bytes) -> str:
    """Each sheet's name and table, page breaks between."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = _strings(z)
        parts = [(name, sheet_rows(z, part, strings)) for name, part in sheets(z)]
    return f"\n\n{PAGE_BREAK}\n\n".join(f"## {name}" + ("\n\n" + table(rows) if rows else "") for name, rows in parts)


def drawing(xml: bytes) -> tuple[list[dict], list[dict]]:
    """Boxes (name, text, x, y, w, h) and connectors (name, sx, sy, ex, ey) of a sheet's drawing."""
    boxes, connectors = [], []
    for anchor in ET.fromstring(xml).iter(f"{_X}twoCellAnchor"):
        for kind in ("sp", "cxnSp"):
            shape = anchor.find(f"{_X}{kind}")
            frame = shape.find(f".//{_A}xfrm") if shape is not None else None
            off, ext = (frame.find(f"{_A}off"), frame.find(f"{_A}ext")) if frame is not None else (None, None)
            if off is None or ext is None:
                continue
            x, y, w, h = (int(e.get(k) or 0) for e, k in ((off, "x"), (off, "y"), (ext, "cx"), (ext, "cy")))
            about = shape.find(f".//{_X}cNvPr")
            name = (about.get("name") if about is not None else "") or ""
            if kind == "sp":
                boxes.append({"name": name, "text": "".join(t.text or "" for t in shape.iter(f"{_A}t")).strip(), "x": x, "y": y, "w": w, "h": h})
                continue
            across, down = frame.get("flipH") == "1", frame.get("flipV") == "1"
            connectors.append({"name": name, "sx": x + w * across, "sy": y + h * down, "ex": x + w * (not across), "ey": y + h * (not down)})
    return boxes, connectors


def drawings(content: bytes) -> dict[str, int]:
    """Number of the sheet that each drawing of a workbook belongs to."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        found = {}
        for name in z.namelist():
            m = re.fullmatch(r"xl/worksheets/_rels/sheet(\d+)\.xml\.rels", name)
            for target in relations(z, f"xl/worksheets/sheet{m.group(1)}.xml").values() if m else ():
                if "drawing" in target.lower() and target.endswith(".xml"):
                    found[posixpath.basename(target)] = int(m.group(1))
        return found


def sheet_images(content: bytes) -> list[tuple[str, int, int, str, bytes]]:
    """Sheet, row and column (from 1), name and bytes of every picture that stands in a visible sheet."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        for sheet, part in sheets(z):
            for drawn in (t for t in relations(z, part).values() if "drawing" in t.lower() and t in names and t.endswith(".xml")):
                found = relations(z, drawn)
                for anchor in ET.fromstring(z.read(drawn)):
                    start = anchor.find(f"{_X}from")
                    for blip in anchor.iter(f"{_A}blip") if start is not None else ():
                        media = found.get(blip.get(f"{_R}embed", ""), "")
                        if media in names:
                            row, column = (int(start.findtext(f"{_X}{k}") or 0) + 1 for k in ("row", "col"))
                            out.append((sheet, row, column, posixpath.basename(media), z.read(media)))
    return out


# --- PPTX ------------------------------------------------------------------------------------------------------


def slide_parts(z: zipfile.ZipFile) -> list[str]:
    deck, found = ET.fromstring(z.read("ppt/presentation.xml")), relations(z, "ppt/presentation.xml")
    return [found[s.get(f"{_R}id", "")] for s in deck.iter(f"{_P}sldId") if s.get(f"{_R}id", "") in found]


def _place(shape: ET.Element) -> tuple[int, int]:
    off = shape.find(f".//{_A}off")
    return (int(off.get("y") or 0), int(off.get("x") or 0)) if off is not None else (0, 0)


def chart_table(xml: bytes) -> str | None:
    """A chart's title and data as Markdown; None if it has no categories or series."""
    chart = ET.fromstring(xml).find(f".//{_C}chart")
    plots = chart.find(f"{_C}plotArea") if chart is not None else None
    series = list(plots.iter(f"{_C}ser")) if plots is not None else []
    values = lambda s, tag: [v.text for v in s.iterfind(f"{_C}{tag}//{_C}pt/{_C}v")]
    categories = values(series[0], "cat") if series else []
    if not categories:
        return None
    names = [" ".join(values(s, "tx")).strip() or f"Series {i}" for i, s in enumerate(series, 1)]
    data = [values(s, "val") for s in series]
    number = lambda x: cell_text(float(x)) if re.fullmatch(r"-?\d+(\.\d+)?", x or "") else cell_text(x)
    rows = [[number(c), *(number(d[i]) if i < len(d) else "" for d in data)] for i, c in enumerate(categories)]
    title = "".join(t.text or "" for t in chart.iterfind(f"{_C}title//{_A}t")).strip()
    about = [f"type: {k.tag.removeprefix(_C).removesuffix('Chart')}" for k in plots if k.tag.endswith("Chart")][:1]
    about += ["legend: yes"] if chart.find(f"{_C}legend") is not None else []
    return "\n".join([f"### Chart{': ' + title if title else ''}", *([f"> {' · '.join(about)}"] if about else []), "", table([["Category", *names], *rows])])


def pptx(content: bytes) -> str:
    """Each slide's texts, tables and charts from top to bottom, page breaks between; its title as a heading."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for part in slide_parts(z):
            found, blocks = relations(z, part), []
            tree = ET.fromstring(z.read(part)).find(f".//{_P}spTree")
            shapes = [s for s in tree if s.tag in (f"{_P}sp", f"{_P}graphicFrame", f"{_P}grpSp")] if tree is not None else []
            for s in sorted(shapes, key=_place):
                grid, chart = s.find(f".//{_A}tbl"), s.find(f".//{_C}chart")
                if grid is not None:
                    blocks.append(table([[cell_text(" ".join(t.text or "" for t in c.iter(f"{_A}t"))) for c in r.iter(f"{_A}tc")] for r in grid.iter(f"{_A}tr")]))
                elif chart is not None and chart.get(f"{_R}id", "") in found:
                    blocks.append(chart_table(z.read(found[chart.get(f"{_R}id", "")])) or "<!-- image -->")
                else:
                    text = "\n".join(x for x in ("".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in s.iter(f"{_A}p")) if x)
                    kind = s.find(f".//{_P}ph")
                    if text:
                        blocks.append("# " + text.replace("\n", " ") if kind is not None and kind.get("type") in ("title", "ctrTitle") else text)
            out.append("\n\n".join(blocks))
    return f"\n\n{PAGE_BREAK}\n\n".join(out)


# --- tables of files -------------------------------------------------------------------------------------------

READERS: dict[str, Callable[[bytes], str]] = {"docx": docx, "xlsx": xlsx, "pptx": pptx}


def counts(kind: str, content: bytes) -> dict[str, int]:
    """pages, chars_est and total_rows of a file, as far as its kind tells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if kind == "zip":
            inside = [m for m in z.infolist() if not m.is_dir()]
            return {"files_inside": len(inside), "chars_est": sum(m.file_size for m in inside)}
        if kind == "docx":
            texts = [_paragraph(p) for p in ET.fromstring(z.read("word/document.xml")).iter(f"{_W}p")]
            words = sum(len(t.split()) for t in texts)
            return {"pages": max(1, words // 300), "chars_est": sum(map(len, texts)), "words": words}
        if kind == "xlsx":
            rows = [sum(1 for _ in ET.fromstring(z.read(part)).iter(f"{_S}row")) for _, part in sheets(z)]
            return {"pages": len(rows), "total_rows": sum(rows)}
        slides = slide_parts(z)
        return {"pages": len(slides), "chars_est": sum(len(t.text or "") for s in slides for t in ET.fromstring(z.read(s)).iter(f"{_A}t"))}


_INFO = "path string, format string, size_mb double, pages long, chars_est long, total_rows long, note string, error string"
_BAD = (zipfile.BadZipFile, KeyError, ValueError, ET.ParseError, OSError, IndexError)


def inspected(files: DataFrame) -> DataFrame:
    """What is known of files (path, format, content) before any work: one row each, one pass, no shuffle."""

    def one(path: str, kind: str, raw: bytes) -> tuple:
        found: dict[str, int] = {}
        note = error = None
        if kind in ("docx", "xlsx", "pptx", "zip"):
            try:
                found = counts(kind, raw)
            except _BAD as e:
                error = str(e)
        elif kind in ("doc", "xls", "ppt"):
            note = f"legacy binary .{kind}: counts are unknown until it is converted to .{kind}x"
        elif kind in ("txt", "md", "csv", "tsv", "log"):
            found = {"chars_est": len(raw)} | ({"total_rows": raw.count(b"\n") + (not raw.endswith(b"\n") and bool(raw))} if kind in ("csv", "tsv") else {})
        elif kind == "pdf":
            pages = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", raw))
            found = {"pages": pages} if pages else {}
        return path, kind, round(len(raw) / (1 << 20), 2), found.get("pages"), found.get("chars_est"), found.get("total_rows"), note, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [{"string": pa.string(), "double": pa.float64(), "long": pa.int64()}[x.split()[1]] for x in _INFO.split(", ")]
        for b in batches:
            rows = [one(p, k or "", c.as_py() or b"") for p, k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], [x.split()[0] for x in _INFO.split(", ")])

    return files.select("path", "format", "content").mapInArrow(run, _INFO)


def parsed(files: DataFrame) -> DataFrame:
    """path, text and error of office files (path, format, content); other formats have neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, kind, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                try:
                    rows.append((path, READERS[kind](content.as_py()) if kind in READERS and content.is_valid else None, None))
                except _BAD as e:
                    rows.append((path, None, f"parse_error: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, ["path", "text", "error"])

    return files.select("path", "format", "content").mapInArrow(run, "path string, text string, error string")
