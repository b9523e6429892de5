"""Media columns: signature sniffing, type correction and carving of embedded media.

An Aho-Corasick automaton of magic bytes finds all places where a known format may begin; each format's validator
then walks the structure from there (chunks and their checksums, blocks, boxes, directories) and gives the object's
length, or nothing.  What is valid at the start is the column's type, which corrects the declared one; what is valid
further on, outside an object carved already, is carved: behind the main object, inside text, and in base64 data
addresses, which are decoded and sniffed themselves.

Defined results: null content has null type and nothing carved; empty content is ``application/x-empty``; content
that no validator accepts is ``text/html`` or ``text/plain`` if it is UTF-8 text without the control characters 0, 1, 2,
8 and 26, else ``application/octet-stream``; a declared type stays where nothing contradicts it (a type of text for text
that isn't a page, a type without a validator for other bytes); a null declared type is corrected by any; very long
contents are searched whole, one at a time; of two objects that begin at one place the first signature of the list that
is valid counts; equal rows give equal rows; an empty table gives an empty table; other columns, whatever their names,
are not read.  Objects inside a valid container (a picture in an archive) belong to it and aren't carved.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def png(d: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, p)
        end = p + 12 + n
        if first != (kind == b"IHDR") or (first and n != 13) or end > len(d):
            return None
        if zlib.crc32(memoryview(d)[p + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end - at
        p, first = end, False
    return None


def gif(d: bytes, at: int) -> int | None:
    if at + 13 > len(d):
        return None
    flags = d[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    while p < len(d):
        mark = d[p]
        if mark == 0x3B:
            return p + 1 - at
        if mark == 0x21:
            p += 2
        elif mark == 0x2C and p + 10 < len(d):
            own = d[p + 9]
            p += 10 + (3 << ((own & 7) + 1) if own & 128 else 0) + 1
        else:
            return None
        while p < len(d) and d[p]:
            p += d[p] + 1
        p += 1
    return None


def jpeg(d: bytes, at: int) -> int | None:
    p, framed = at + 2, False
    while p + 4 <= len(d):
        if d[p] != 0xFF:
            return None
        mark = d[p + 1]
        if mark == 0xFF:
            p += 1
            continue
        if mark == 0xD9:
            return p + 2 - at if framed else None
        if mark in (0x00, 0x01) or 0xD0 <= mark <= 0xD8:
            return None
        n = struct.unpack_from(">H", d, p + 2)[0]
        if n < 2:
            return None
        framed |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if mark == 0xDA:  # entropy-coded data: up to a marker that isn't a stuffed byte or a restart
            while True:
                p = d.find(b"\xff", p)
                if p < 0 or p + 1 >= len(d):
                    return None
                if d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
    return p + 2 - at if framed and d[p : p + 2] == b"\xff\xd9" else None


_RIFF = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


def riff(d: bytes, at: int) -> int | None:
    if at + 12 > len(d) or d[at + 8 : at + 12] not in _RIFF:
        return None
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    if end > len(d):
        return None
    p = at + 12
    while p + 8 <= end:
        n = struct.unpack_from("<I", d, p + 4)[0]
        p += 8 + n + (n & 1)
    return end - at if p in (end, end + 1) and p > at + 12 else None


def bmp(d: bytes, at: int) -> int | None:
    if at + 30 > len(d):
        return None
    size, reserved, pixels, head = struct.unpack_from("<IIII", d, at + 2)
    if reserved or head not in (12, 40, 52, 56, 64, 108, 124) or not 14 + head <= pixels <= size or at + size > len(d):
        return None
    return size if head == 12 or struct.unpack_from("<H", d, at + 26)[0] == 1 else None


def pdf(d: bytes, at: int) -> int | None:
    if not (d[at + 5 : at + 6].isdigit() and d[at + 6 : at + 7] == b"."):
        return None
    stop = d.find(b"%PDF-", at + 5)
    end = d.rfind(b"%%EOF", at, stop if stop >= 0 else len(d))
    if end < 0 or d.find(b"startxref", at, end) < 0:
        return None
    end += 5
    while end < len(d) and d[end] in b"\r\n":
        end += 1
    return end - at


def archive(d: bytes, at: int) -> int | None:
    p = d.find(b"PK\x05\x06", at)
    while p >= 0:
        if p + 22 <= len(d):
            size, offset, note = struct.unpack_from("<IIH", d, p + 12)
            if at + offset + size == p and p + 22 + note <= len(d) and (not size or d[at + offset : at + offset + 4] == b"PK\x01\x02"):
                return p + 22 + note - at
        p = d.find(b"PK\x05\x06", p + 4)
    return None


def gzipped(d: bytes, at: int) -> int | None:
    todo = zlib.decompressobj(31)
    view, p = memoryview(d), at
    try:
        while not todo.eof and p < len(d):
            todo.decompress(view[p : p + 65536])  # checks the trailer's checksum and length
            p += 65536
    except zlib.error:
        return None
    return min(p, len(d)) - len(todo.unused_data) - at if todo.eof else None


def ogg(d: bytes, at: int) -> int | None:
    p = at
    while d[p : p + 5] == b"OggS\0" and p + 27 <= len(d):
        n = d[p + 26]
        if p + 27 + n > len(d):
            return None
        last = d[p + 5] & 4
        p += 27 + n + sum(d[p + 27 : p + 27 + n])
        if p > len(d):
            return None
        if last:
            return p - at
    return None


def boxes(d: bytes, at: int) -> int | None:
    p, seen = at, set()
    while p + 8 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, p)
        if n == 1 and p + 16 <= len(d):
            n = struct.unpack_from(">Q", d, p + 8)[0]
        if not all(97 <= c < 123 or 65 <= c < 91 or 48 <= c < 58 or c == 32 for c in kind) or n < 8 or p + n > len(d):
            break
        seen.add(kind)
        p += n
    return p - at if b"ftyp" in seen and seen & {b"moov", b"mdat", b"meta"} else None


def flac(d: bytes, at: int) -> int | None:
    p, first = at + 4, True
    while p + 4 <= len(d):
        kind, n = d[p] & 127, int.from_bytes(d[p + 1 : p + 4], "big")
        if first != (kind == 0) or (first and n != 34) or p + 4 + n > len(d):
            return None
        last, first = d[p] & 128, False
        p += 4 + n
        if last:  # frames have no lengths: the stream takes the rest
            return len(d) - at if p == len(d) or d[p : p + 1] == b"\xff" else None
    return None


_WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}


def tiff(d: bytes, at: int) -> int | None:
    """Directories, the values they point to and the strips or tiles; the object ends where the last of them does."""
    order = "<" if d[at : at + 2] == b"II" else ">"
    if at + 8 > len(d):
        return None
    here, end, seen = struct.unpack_from(order + "I", d, at + 4)[0], 8, set()
    while here:
        if here < 8 or here in seen or at + here + 2 > len(d):
            return None
        seen.add(here)
        count = struct.unpack_from(order + "H", d, at + here)[0]
        after = here + 2 + 12 * count
        if not count or at + after + 4 > len(d):
            return None
        parts: dict[int, tuple] = {}
        for i in range(count):
            p = at + here + 2 + 12 * i
            tag, kind, n = struct.unpack_from(order + "HHI", d, p)
            if kind not in _WIDTHS:
                return None
            size = _WIDTHS[kind] * n
            spot = p + 8 if size <= 4 else at + struct.unpack_from(order + "I", d, p + 8)[0]
            if spot + size > len(d):
                return None
            end = max(end, spot + size - at if size > 4 else 0)
            if tag in (273, 279, 324, 325) and kind in (3, 4):
                parts[tag] = struct.unpack_from(f"{order}{n}{'H' if kind == 3 else 'I'}", d, spot)
        for where, sizes in ((273, 279), (324, 325)):
            for o, n in zip(parts.get(where, ()), parts.get(sizes, ())):
                if at + o + n > len(d):
                    return None
                end = max(end, o + n)
        end = max(end, after + 4)
        here = struct.unpack_from(order + "I", d, at + after)[0]
    return end if seen else None


_RATES = {
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _mp3_frame(d: bytes, p: int) -> int | None:
    """Length of the layer III frame at p."""
    if p + 4 > len(d) or d[p] != 0xFF or d[p + 1] & 0xE6 != 0xE2:
        return None
    version, rate, hertz = (d[p + 1] >> 3) & 3, d[p + 2] >> 4, (d[p + 2] >> 2) & 3
    if version == 1 or rate in (0, 15) or hertz == 3:
        return None
    n = (144 if version == 3 else 72) * 1000 * _RATES[3 if version == 3 else 2][rate] // _HERTZ[version][hertz] + ((d[p + 2] >> 1) & 1)
    return n if p + n <= len(d) else None


def mp3(d: bytes, at: int) -> int | None:
    """A tag in front, two frames or more, a tag behind."""
    p, frames = at, 0
    if d[p : p + 3] == b"ID3":
        if p + 10 > len(d) or any(x & 128 for x in d[p + 6 : p + 10]):
            return None
        p += 10 + (d[p + 6] << 21 | d[p + 7] << 14 | d[p + 8] << 7 | d[p + 9])
    while (n := _mp3_frame(d, p)) is not None:
        p += n
        frames += 1
    if frames < 2:
        return None
    return p + (128 if d[p : p + 3] == b"TAG" and p + 128 <= len(d) else 0) - at


def _ebml_size(d: bytes, p: int) -> tuple[int, int] | None:
    """Value and width of the variable-length number at p; None if unknown or cut off."""
    if p >= len(d) or not d[p]:
        return None
    width = 9 - d[p].bit_length()
    if p + width > len(d):
        return None
    value = int.from_bytes(d[p : p + width], "big") & ((1 << 7 * width) - 1)
    return None if value == (1 << 7 * width) - 1 else (value, width)


def matroska(d: bytes, at: int) -> int | None:
    head = _ebml_size(d, at + 4)
    if head is None:
        return None
    p = at + 4 + head[1] + head[0]
    size = _ebml_size(d, p + 4) if d[p : p + 4] == b"\x18\x53\x80\x67" else None
    end = 0 if size is None else p + 4 + size[1] + size[0]
    return end - at if p < end <= len(d) else None


def icon(d: bytes, at: int) -> int | None:
    count = struct.unpack_from("<H", d, at + 4)[0] if at + 6 <= len(d) else 0
    end = 6 + 16 * count
    if not 0 < count <= 256 or at + end > len(d):
        return None
    for i in range(count):
        zero, size, where = d[at + 9 + 16 * i], *struct.unpack_from("<II", d, at + 14 + 16 * i)
        image = d[at + where : at + where + 8]
        if zero or where < 6 + 16 * count or at + where + size > len(d) or not (image == b"\x89PNG\r\n\x1a\n" or image[:4] == b"\x28\0\0\0"):
            return None
        end = max(end, where + size)
    return end


_BRANDS = {b"avif": "image/avif", b"avis": "image/avif", b"heic": "image/heic", b"heix": "image/heic", b"mif1": "image/heif", b"M4A ": "audio/mp4", b"M4B ": "audio/mp4", b"qt  ": "video/quicktime"}

#: magic bytes, where they stand in the object, type, validator
SIGNATURES: list[tuple[bytes, int, str, Callable[[bytes, int], int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", png),
    (b"GIF87a", 0, "image/gif", gif),
    (b"GIF89a", 0, "image/gif", gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", jpeg),
    (b"RIFF", 0, "", riff),
    (b"BM", 0, "image/bmp", bmp),
    (b"%PDF-", 0, "application/pdf", pdf),
    (b"PK\x03\x04", 0, "application/zip", archive),
    (b"\x1f\x8b\x08", 0, "application/gzip", gzipped),
    (b"OggS\0", 0, "audio/ogg", ogg),
    (b"fLaC", 0, "audio/flac", flac),
    (b"ftyp", 4, "", boxes),
    (b"II*\0", 0, "image/tiff", tiff),
    (b"MM\0*", 0, "image/tiff", tiff),
    (b"ID3", 0, "audio/mpeg", mp3),
    *((bytes([0xFF, x]), 0, "audio/mpeg", mp3) for x in (0xFB, 0xFA, 0xF3, 0xF2, 0xE3, 0xE2)),
    (b"\x1aE\xdf\xa3", 0, "", matroska),
    (b"\0\0\1\0", 0, "image/vnd.microsoft.icon", icon),
]
#: types that a validator would have confirmed
_KNOWN = {k for _, _, k, _ in SIGNATURES if k} | {"video/mp4", "video/webm", "video/x-matroska", "image/x-icon", *_RIFF.values(), *_BRANDS.values()}
_DATA = b";base64,"
#: a page's first tag, behind white space and comments
_PAGE = re.compile(rb"(?:\xef\xbb\xbf|\s|<!--.*?-->|<\?xml.*?\?>)*(?:<!doctype html|<html)", re.IGNORECASE | re.DOTALL)
_BASE64 = re.compile(rb"[A-Za-z0-9+/=]*")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (magic, _, _, _) in enumerate(SIGNATURES):
        a.add_word(magic.decode("latin-1"), (i, len(magic)))
    a.add_word(_DATA.decode(), (-1, len(_DATA)))
    a.make_automaton()
    return a


def _kind(content: bytes, at: int, i: int) -> str:
    magic, _, kind, _ = SIGNATURES[i]
    if magic == b"RIFF":
        return _RIFF[content[at + 8 : at + 12]]
    if magic == b"ftyp":
        return _BRANDS.get(content[at + 8 : at + 12], "video/mp4")
    return kind or ("video/webm" if b"webm" in content[at : at + 64] else "video/x-matroska")


def objects(content: bytes) -> list[tuple[str, int, int, bytes]]:
    """Type, offset, length and bytes of the outermost valid objects, in order.  An object in a data address has the
    place of its base 64 text, and its decoded bytes."""
    found, free = [], 0
    hits = sorted((end + 1 - n - (SIGNATURES[i][1] if i >= 0 else 0), i, end + 1) for end, (i, n) in _automaton().iter(content.decode("latin-1")))
    for at, i, after in hits:
        if at < free or at < 0:
            continue
        if i >= 0:
            n = SIGNATURES[i][3](content, at)
            if n:
                found.append((_kind(content, at, i), at, n, content[at : at + n]))
                free = at + n
            continue
        end = _BASE64.match(content, after).end()
        try:
            raw = base64.b64decode(content[after:end], validate=True)
        except binascii.Error:
            continue
        kind, n = main_type(raw)
        if n:
            found.append((kind, after, end - after, raw[:n]))
            free = end
    return found


def main_type(content: bytes) -> tuple[str, int]:
    """Type of what starts the content, and the length of that object (0 for text and unknown bytes)."""
    if not content:
        return "application/x-empty", 0
    for i, (magic, at, _, valid) in enumerate(SIGNATURES):
        if content[at : at + len(magic)] == magic:
            n = valid(content, 0)
            if n:
                return _kind(content, 0, i), n
    if not any(c in content for c in (b"\0", b"\x01", b"\x02", b"\x08", b"\x1a")):
        try:
            content.decode("utf-8")
        except UnicodeDecodeError:
            return "application/octet-stream", 0
        return ("text/html" if _PAGE.match(content) else "text/plain"), 0
    return "application/octet-stream", 0


def sniff(content: bytes | None) -> tuple[str | None, int, list[tuple[str, int, int, str]]]:
    """Type, length of the main object, and type, offset, length and MD5 of what is carved."""
    if content is None:
        return None, 0, []
    found = objects(content)
    if found and found[0][1] == 0:
        kind, n = found[0][0], found[0][2]
        found = found[1:]
    else:
        kind, n = main_type(content)
        if not n and kind == "application/octet-stream" and found:
            # text with media behind or inside it is text
            text, free = [], 0
            for _, at, size, _ in found:
                text.append(content[free:at])
                free = at + size
            kind = main_type(b" ".join([*text, content[free:]]))[0]
    return kind, n, [(k, at, size, hashlib.md5(raw).hexdigest()) for k, at, size, raw in found]


def agrees(found: str | None, declared: str) -> bool:
    """Whether a declared type says no more than what was found allows: text of some kind, bytes of no known kind."""
    if found == "text/plain":
        return (declared.startswith("text/") and declared != "text/html") or declared.endswith(("json", "xml", "javascript", "yaml", "csv")) and declared not in _KNOWN
    if found == "text/html":
        return declared == "application/xhtml+xml"
    if found == "image/vnd.microsoft.icon":
        return declared == "image/x-icon"
    return found == "application/octet-stream" and "/" in declared and declared not in _KNOWN and not declared.startswith("text/")


_SCHEMA = "media_id long, declared string, type string, corrected boolean, main_length long, carved array<struct<type:string,offset:long,length:long,md5:string>>"
_CARVED = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("md5", pa.string())]))


def _sniffed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds, sizes, carved = [], [], []
        for content in b.column(2):  # one content at a time as bytes
            kind, n, found = sniff(content.as_py())
            kinds.append(kind)
            sizes.append(n)
            carved.append([dict(zip(("type", "offset", "length", "md5"), x)) for x in found])
        plain = [(d or "").split(";")[0].strip().lower() for d in b.column(1).to_pylist()]
        kinds = [d if agrees(k, d) else k for k, d in zip(kinds, plain)]
        fixed = [k is not None and k != d for k, d in zip(kinds, plain)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.string()), pa.array(fixed), pa.array(sizes, pa.int64()), pa.array(carved, _CARVED)], ["media_id", "declared", "type", "corrected", "main_length", "carved"])


def sniffed(media: DataFrame) -> DataFrame:
    """Types and carved objects of the table (media_id, declared, content): one pass, no shuffle."""
    return media.select(F.col("media_id").cast("long").alias("media_id"), F.col("declared").cast("string").alias("declared"), "content").mapInArrow(_sniffed, _SCHEMA)


def carved(media: DataFrame) -> DataFrame:
    """The carved objects themselves: media_id, offset, type, md5 and content (decoded), a row an object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, content in zip(b.column(0).to_pylist(), b.column(1)):
                found = [x for x in objects(content.as_py()) if x[1]] if content.is_valid else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[0] for x in found]), pa.array([hashlib.md5(x[3]).hexdigest() for x in found]), pa.array([x[3] for x in found], pa.binary())], ["media_id", "offset", "type", "md5", "content"])

    return media.select(F.col("media_id").cast("long").alias("media_id"), "content").mapInArrow(run, "media_id long, offset long, type string, md5 string, content binary")


# --- a media column made of web pages -------------------------------------------------------------------------


def make_png(note: bytes) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"page\0" + note) + chunk(b"IDAT", zlib.compress(b"\0\x7f")) + chunk(b"IEND", b"")


def make_gif(note: bytes) -> bytes:
    blocks = b"".join(bytes([len(note[i : i + 255])]) + note[i : i + 255] for i in range(0, len(note), 255))
    return b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff!\xfe" + blocks + b"\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"


def make_wav(samples: bytes) -> bytes:
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def make_gzip(body: bytes) -> bytes:
    todo = zlib.compressobj(1, zlib.DEFLATED, 31)
    return todo.compress(body) + todo.flush()


def make_zip(body: bytes) -> bytes:
    crc, name = zlib.crc32(body), b"page.html"
    common = struct.pack("<HHHHHIII", 20, 0, 0, 0, 33, crc, len(body), len(body)) + struct.pack("<HH", len(name), 0)
    local = b"PK\x03\x04" + common + name + body
    entry = b"PK\x01\x02" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, 0) + name
    return local + entry + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(entry), len(local), 0)


def make_jpeg(note: bytes) -> bytes:
    def part(mark: int, body: bytes) -> bytes:
        return bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body

    notes = b"".join(part(0xFE, note[i : i + 60_000]) for i in range(0, len(note), 60_000))
    frame = part(0xC0, b"\x08\0\1\0\1\1\1\x11\0")
    return b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + notes + frame + part(0xDA, b"\1\1\0\0\x3f\0") + b"\x7f\xff\0\x12\xff\xd9"


def _riff(kind: bytes, *parts: tuple[bytes, bytes]) -> bytes:
    body = kind + b"".join(n + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1) for n, x in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def make_webp(note: bytes) -> bytes:
    return _riff(b"WEBP", (b"VP8L", b"\x2f\0\0\0\0"), (b"EXIF", note))


def make_avi(note: bytes) -> bytes:
    return _riff(b"AVI ", (b"LIST", b"INFO" + note))


def make_bmp(note: bytes) -> bytes:
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(note), 0, 54, 40, 1, 1, 1, 8, 0, len(note), 0, 0, 0, 0) + note


def make_pdf(note: bytes) -> bytes:
    body = b"%PDF-1.4\n1 0 obj\n<< /Length " + str(len(note)).encode() + b" >>\nstream\n" + note.replace(b"%", b"#") + b"\nendstream\nendobj\n"
    return body + b"trailer\n<< /Root 1 0 R >>\nstartxref\n" + str(len(body)).encode() + b"\n%%EOF\n"


def make_ogg(note: bytes) -> bytes:
    pages = [note[i : i + 255 * 254] for i in range(0, len(note), 255 * 254)] or [b""]
    out = b""
    for k, body in enumerate(pages):
        laced = bytes([255] * (len(body) // 255) + [len(body) % 255])
        out += b"OggS\0" + bytes([4 * (k == len(pages) - 1)]) + struct.pack("<QIIIB", 0, 1, k, 0, len(laced)) + laced + body
    return out


def make_flac(note: bytes) -> bytes:
    return b"fLaC\0\0\0\x22" + b"\0" * 34 + b"\x82" + len(note).to_bytes(3, "big") + note


def make_mp4(note: bytes, brand: bytes = b"isom") -> bytes:
    return b"".join(struct.pack(">I", 8 + len(x)) + k + x for k, x in ((b"ftyp", brand + b"\0\0\2\0" + brand), (b"moov", b""), (b"mdat", note)))


def make_tiff(note: bytes) -> bytes:
    head = b"II*\0" + struct.pack("<I", 8 + len(note) + (len(note) & 1)) + note + b"\0" * (len(note) & 1)
    entries = [(256, 4, 1, 1), (257, 4, 1, 1), (273, 4, 1, 8), (279, 4, 1, len(note))]
    return head + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0\0\0\0"


def make_mp3(note: bytes) -> bytes:
    n = len(note)
    frame = b"\xff\xfb\x10\xc0" + b"\0" * 100  # 32 kbit/s at 44.1 kHz: 104 bytes
    return b"ID3\4\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + note + frame * 3


def make_webm(note: bytes) -> bytes:
    head = b"\x42\x82\x84webm"
    return b"\x1aE\xdf\xa3" + bytes([0x80 | len(head)]) + head + b"\x18\x53\x80\x67" + (len(note) | 1 << 28).to_bytes(4, "big") + note


def make_icon(note: bytes) -> bytes:
    image = make_png(note)
    return b"\0\0\1\0\1\0" + struct.pack("<BBBBHHII", 1, 1, 0, 0, 1, 32, len(image), 22) + image


MAKERS: dict[str, Callable[[bytes], bytes]] = {
    "image/png": make_png, "image/gif": make_gif, "audio/wav": make_wav, "application/gzip": make_gzip, "application/zip": make_zip, "image/jpeg": make_jpeg,
    "image/webp": make_webp, "video/x-msvideo": make_avi, "image/bmp": make_bmp, "application/pdf": make_pdf, "audio/ogg": make_ogg, "audio/flac": make_flac,
    "video/mp4": make_mp4, "image/heic": lambda x: make_mp4(x, b"heic"), "image/tiff": make_tiff, "audio/mpeg": make_mp3, "video/webm": make_webm, "image/vnd.microsoft.icon": make_icon,
}
_FORMS = ("text/html", *MAKERS, "text/html", "image/png")


def payload(page_id: int, html: bytes) -> bytes:
    """A page in one of 21 forms: plain, in each container, with media inside and behind, damaged."""
    form = page_id % len(_FORMS)
    if form == len(_FORMS) - 2:
        picture = base64.b64encode(make_png(html[:400]))
        return html.replace(b"</body>", b'<img src="data:image/png;base64,' + picture + b'"></body>') + make_gif(html[:300]) + make_wav(html[:200])
    if form == len(_FORMS) - 1:
        return make_png(html)[:-9]
    return MAKERS[_FORMS[form]](html) if form else html


def page_media(pages: DataFrame) -> DataFrame:
    """A media column of every page: media_id, a declared type (wrong for some) and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            body = [None if h is None or i is None else payload(i, h.encode()) for i, h in zip(ids, b.column(1).to_pylist())]
            declared = [None if i is None else _FORMS[(i * 5 + i // 21) % 21] if i % 4 == 0 else _FORMS[i % 21] for i in ids]
            for at in range(0, len(ids), 500):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 500], k) for x, k in ((ids, pa.int64()), (declared, pa.string()), (body, pa.binary()))], ["media_id", "declared", "content"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "media_id long, declared string, content binary")
