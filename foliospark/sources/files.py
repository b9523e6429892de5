"""Files as rows: discovery, formats by content, decoding of text, members of ZIP archives.

Files are read where they are, by Spark's binary source; folders are searched, hidden files and folders are left out.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import labels as L

ENCODINGS = ("utf-8", "utf-8-sig", "cp932", "shift_jis", "euc-jp", "latin-1")
NAME_ENCODINGS = ("utf-8", "cp932", "shift_jis", "euc-jp")
#: archives in form, documents in use
_KEPT_WHOLE = "docx docm dotx dotm pptx pptm ppsx ppsm xlsx xlsm xltx xltm xls odt ods odp epub jar".split()
WEAK = ("", "txt", "log", "dat", "bin", "data")


def discover(spark: SparkSession, paths: list[str], content: bool = True) -> DataFrame:
    """path, length, modificationTime (and content) of every file at or below the paths, hidden ones left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).filter(~F.col("path").rlike("/\\.[^/]+(/|$)"))
    return found if content else found.drop("content")


def sniffed_format(content: Column, path: Column, correct_strong: bool = False) -> Column:
    """Format by content where the extension says little (or always, if asked), else by extension; txt for none."""
    by_suffix = L.suffix(path)
    starts = lambda m: F.startswith(content, F.lit(m))
    found = (
        F.when(starts(b"%PDF-"), "pdf").when(starts(b"\x89PNG\r\n\x1a\n"), "png").when(starts(b"\xff\xd8\xff"), "jpg").when(starts(b"GIF8"), "gif")
        .when(starts(b"PK\x03\x04"), F.when(F.locate("word/", F.decode(F.substring(content, 1, 4096), "iso-8859-1")) > 0, "docx").when(F.locate("xl/", F.decode(F.substring(content, 1, 4096), "iso-8859-1")) > 0, "xlsx").when(F.locate("ppt/", F.decode(F.substring(content, 1, 4096), "iso-8859-1")) > 0, "pptx").otherwise("zip"))
        .when(starts(b"RIFF"), "wav").when(starts(b"OggS"), "ogg").when(starts(b"fLaC"), "flac").when(starts(b"ID3"), "mp3")
    )
    weak = by_suffix.isin(*WEAK) | F.lit(correct_strong)
    return F.coalesce(F.when(weak, found), F.nullif(by_suffix, F.lit("")), F.lit("txt"))


def decoded(raw: bytes) -> tuple[str | None, str]:
    """Text and the encoding that reads it; (None, reason) for bytes with nulls at the start."""
    if b"\0" in raw[:8192]:
        return None, "binary"
    for name in ENCODINGS:
        try:
            return raw.decode(name), name
        except UnicodeError:
            continue
    return raw.decode("utf-8", "replace"), "utf-8 (lossy)"


def texts(files: DataFrame) -> DataFrame:
    """path, text and encoding of every file (path, content); text is null and encoding ``binary`` for bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(None, None) if not c.is_valid else decoded(c.as_py()) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["path", "text", "encoding"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, encoding string")


# --- archives --------------------------------------------------------------------------------------------------


def member_name(name: str, encodings: tuple[str, ...] = NAME_ENCODINGS) -> str:
    """A member's name as it was meant: names without the UTF-8 flag are read by the first encoding that fits."""
    if name.isascii() and name.isprintable():
        return name
    try:
        raw = name.encode("cp437")
    except UnicodeEncodeError:
        return name
    for e in encodings:
        try:
            return raw.decode(e)
        except UnicodeError:
            continue
    return name


def refusal(members: list[zipfile.ZipInfo], most_bytes: int, most_files: int) -> str:
    """Why an archive isn't expanded; empty if it may be."""
    whole = [m for m in members if not m.is_dir()]
    total = sum(m.file_size for m in whole)
    if len(members) > most_files:
        return f"archive contains {len(members)} entries (limit {most_files})"
    if total > most_bytes:
        return f"archive expands to {total} bytes (limit {most_bytes})"
    dense = next((m for m in whole if m.compress_size and m.file_size > 10 << 20 and m.file_size > 1000 * m.compress_size), None)
    return "" if dense is None else f"entry {dense.filename!r} is compressed more than a thousandfold"


def can_expand(path: str, content: bytes) -> bool:
    return path.rsplit(".", 1)[-1].lower() not in _KEPT_WHOLE and zipfile.is_zipfile(io.BytesIO(content))


def _flat(stem: str, inner: str) -> str:
    folder, _, name = inner.rpartition("/")
    dot = name.rfind(".")
    body, end = (name, "") if dot <= 0 else (name[:dot], name[dot:])
    return stem + "__" + "".join("_" if c in '/<>:"|?*' else c for c in (folder + "/" if folder else "") + body) + end


def members(path: str, content: bytes, depth: int = 0, deepest: int = 3, most_bytes: int = 500 << 20, most_files: int = 10_000) -> Iterator[tuple[str, str, bytes | None, str]]:
    """(archive, member's flat name, bytes, error) of an archive's files, archives inside expanded as well; one that
    can't be expanded stays as it is, with the reason."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            why = refusal(z.infolist(), most_bytes, most_files) if depth < deepest else "archives nested too deep"
            if why:
                yield path, path.rsplit("/", 1)[-1], content, why
                return
            for m in z.infolist():
                name = member_name(m.filename)
                if m.is_dir() or name.startswith("__MACOSX/") or "/.DS_Store" in name or name.rsplit("/", 1)[-1].startswith("._"):
                    continue
                flat, raw = _flat(stem, name), z.read(m)
                if can_expand(flat, raw):
                    yield from ((path, *rest) for _, *rest in members(flat, raw, depth + 1, deepest, most_bytes, most_files))
                else:
                    yield path, flat, raw, ""
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError) as e:
        yield path, path.rsplit("/", 1)[-1], content, f"damaged archive: {e}"


def expanded(files: DataFrame, **limits: int) -> DataFrame:
    """files (path, content) with archives replaced by what is in them: path, name, content, error; an archive's members
    stay in the task that read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                raw = content.as_py()
                rows = members(path, raw, **limits) if raw is not None and can_expand(path, raw) else [(path, path.rsplit("/", 1)[-1], raw, "")]
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.string(), pa.string(), pa.binary(), pa.string()))], ["path", "name", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, content binary, error string")
