"""WARC archives: revisit resolution by payload digest and deduplicated archives with fresh headers.

Archives stay where they are: what is shuffled is an index row per record (file, offset, length and headers).  Index
rows meet by payload digest; the earliest response of each digest is its original (ties: least record id, then URL,
file and offset).  A revisit is joined to its original whatever it referred to before; a later response of the
same digest becomes a revisit of the original.  Writers then take ranges of the source files, fetch each record by
offset and write it, one gzip member a record, with a new record id, new lengths and digests and new references.

Defined results: a response without a body has the digest of no bytes; a revisit whose digest no response has stays
a revisit without references (``refers_to`` null); a record without a digest (warcinfo, request, metadata) is copied
under a fresh header; missing dates sort first and missing fields are left out of headers; line breaks in a URL are
written percent-encoded; repeated records are records of their own, so the second copy of a response is a revisit; ties of
date go by record id; a very long block is one record, held whole by one task; other columns, whatever their names, are
not read; an empty table gives an empty archive index; a damaged or cut-off archive raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fragments, materialise, new_path

LEVEL = 3
RANGE_BYTES = 8_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 20
_STEP = 1 << 12
_INDEX = "file string, offset long, length long, record_id string, type string, url string, date string, digest string, block_length long"
_RESULT = _INDEX + ", fresh_id string, refers_to string"
_EMPTY = hashlib.sha1(b"").hexdigest()


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], _names(schema))


def labelled(digest: str | None) -> str | None:
    """A SHA-1 as headers have it."""
    return None if digest is None else "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def unlabelled(field: str | None) -> str | None:
    """The hexadecimal SHA-1 of a digest field; None for other algorithms and damaged fields."""
    kind, _, value = (field or "").partition(":")
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return raw.hex() if kind.lower() == "sha1" and len(raw) == 20 else None


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload."""
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    clean = [f"{k}: {v.replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *clean, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(raw: bytes, level: int = LEVEL) -> bytes:
    todo = zlib.compressobj(level, zlib.DEFLATED, 31)
    return todo.compress(raw) + todo.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one whole record."""
    head, block = split_http(raw)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
    n = int(fields.get("content-length", "-1"))
    if not 0 <= n <= len(block):
        raise ValueError("a WARC record is cut off")
    return fields, block[:n]


def members(source) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and bytes of each record of an open archive of gzip members, or of plain records."""
    at, held, pos = 0, b"", 0

    def more() -> bool:
        """Read on behind what isn't used yet."""
        nonlocal held, pos
        got = source.read(_READ)
        held, pos = held[pos:] + got, 0
        return bool(got)

    while pos < len(held) or more():
        if len(held) - pos < 2:
            more()
        if held[pos : pos + 2] == b"\x1f\x8b":
            todo, parts, used = zlib.decompressobj(31), [], 0
            while not todo.eof:
                if pos == len(held) and not more():
                    raise ValueError(f"the archive is cut off at {at}")
                piece = held[pos : pos + _STEP]  # what is left over of a piece is copied: small ones cost less
                try:
                    parts.append(todo.decompress(piece))
                except zlib.error as e:
                    raise ValueError(f"damaged archive at {at}") from e
                n = len(piece) - len(todo.unused_data)
                pos, used = pos + n, used + n
            yield at, used, b"".join(parts)
            at += used
            continue
        while (head := held.find(b"\r\n\r\n", pos)) < 0 and more():
            pass
        if head < 0 or not held.startswith(b"WARC/", pos):
            raise ValueError(f"damaged archive at {at}")
        sizes = [x.split(b":")[1] for x in held[pos:head].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if not sizes:
            raise ValueError(f"damaged archive at {at}")
        size = head - pos + 4 + int(sizes[0]) + 4
        while len(held) - pos < size and more():
            pass
        if len(held) - pos < size:
            raise ValueError(f"the archive is cut off at {at}")
        yield at, size, held[pos : pos + size]
        pos, at = pos + size, at + size


def _entry(file: str, offset: int, length: int, raw: bytes) -> tuple:
    fields, block = parse(raw)
    kind = fields.get("warc-type")
    digest = unlabelled(fields.get("warc-payload-digest"))
    if kind == "response":
        digest = hashlib.sha1(split_http(block)[1]).hexdigest()
    elif kind != "revisit":
        digest = None
    return file, offset, length, fields.get("warc-record-id", "").strip("<>") or None, kind, fields.get("warc-target-uri"), fields.get("warc-date"), digest, len(block)


def headers(spark: SparkSession, files: list[str]) -> DataFrame:
    """The index of archives, one task a file, read as a stream.  Responses' digests are computed anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                rows = []
                with store.open_input_stream(path, compression=None) as source:
                    for offset, length, raw in members(source):
                        rows.append(_entry(file, offset, length, raw))
                        if len(rows) == 10_000:
                            yield _batch(rows, _INDEX)
                            rows = []
                yield _batch(rows, _INDEX)

    named = spark.createDataFrame([(f,) for f in files], "file string")
    return (named.coalesce(1).repartition(len(files)) if files else named).mapInArrow(run, _INDEX)


class _Archive:
    """One output file of a task's attempt; made when its first record comes."""

    def __init__(self, folder: str):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        self.path, self.folder, self.sink, self.at = f"{root}/data/{self.name}", f"{root}/data", None, 0

    def add(self, fields: list[tuple[str, str | None]], block: bytes) -> tuple[str, int, int]:
        if self.sink is None:
            self.store.create_dir(self.folder, recursive=True)
            self.sink = self.store.open_output_stream(self.path, compression=None)
            about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._write(record(about, b"format: WARC File Format 1.1\r\n"))
        at = self.at
        return f"data/{self.name}", at, self._write(record(fields, block))

    def _write(self, raw: bytes) -> int:
        data = member(raw)
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()


def _fields(kind: str | None, record_id: str | None, url: str | None, date: str | None, digest: str | None, block: bytes, content: str | None = None) -> list[tuple[str, str | None]]:
    return [
        ("WARC-Type", kind), ("WARC-Record-ID", None if record_id is None else f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("Content-Type", content or ("application/http; msgtype=response" if kind in ("response", "revisit") else None)),
        ("WARC-Payload-Digest", labelled(digest)), ("WARC-Block-Digest", labelled(hashlib.sha1(block).hexdigest())),
    ]


def _indexed(rows: DataFrame, folder: str, schema: str) -> DataFrame:
    rows.write.parquet(f"{folder}/index")
    return rows.sparkSession.read.schema(schema).parquet(f"{folder}/index").withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def write(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the table (record_id, type, url, date, digest, block) as archives, one a task; their index."""
    folder = folder or new_path(records.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Archive(folder)
        try:
            for batch in batches:
                rows = []
                for i in range(batch.num_rows):
                    key, kind, url, date, digest, block = (c[i].as_py() for c in batch.columns)
                    block = block or b""
                    if kind == "response":
                        digest = hashlib.sha1(split_http(block)[1]).hexdigest()
                    elif kind != "revisit":
                        digest = None
                    rows.append((*out.add(_fields(kind, key, url, date, digest, block), block), key, kind, url, date, digest, len(block)))
                yield _batch(rows, _INDEX)
        finally:
            out.close()

    return _indexed(records.select("record_id", "type", "url", "date", "digest", "block").mapInArrow(run, _INDEX), folder, _INDEX)


def fresh(record_id: str) -> str:
    return f"urn:uuid:{uuid.UUID(hashlib.md5((record_id + '#deduplicated').encode()).hexdigest())}"


def resolved(index: DataFrame) -> DataFrame:
    """The index with each record's new type and the original that it refers to.  Originals are partial minima, so a
    digest that very many records share is no large task; the join's other side has one row a digest."""
    first = index.filter("type = 'response' and digest is not null").groupBy("digest").agg(F.min(F.struct("date", "record_id", "url", "file", "offset")).alias("o"))
    # records without a digest (requests, metadata) don't meet in one place
    named, rest = index.filter("digest is not null"), index.filter("digest is null").withColumn("o", F.lit(None).cast(first.schema["o"].dataType))
    held = named.join(first, "digest", "left").unionByName(rest)
    itself = (F.col("type") == "response") & (F.col("o.file") == F.col("file")) & (F.col("o.offset") == F.col("offset"))
    refers = F.col("o").isNotNull() & ~itself
    return held.select(
        *[c for c in _names(_INDEX) if c != "type"], "type", F.when(refers, F.lit("revisit")).otherwise(F.col("type")).alias("new_type"),
        F.when(refers, F.col("o.record_id")).alias("refers_to"), F.when(refers, F.col("o.url")).alias("refers_url"), F.when(refers, F.col("o.date")).alias("refers_date"),
    )


def deduplicate(index: DataFrame, folder: str | None = None) -> DataFrame:
    """Write deduplicated archives of all records that the index names; the new archives' index."""
    folder = folder or new_path(index.sparkSession, "deduplicated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Archive(folder)
        source, opened = None, None
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if r["file"] != opened:
                        if source is not None:
                            source.close()
                        store, path = fs.FileSystem.from_uri(r["file"])
                        source, opened = store.open_input_file(path), r["file"]
                    raw = source.read_at(r["length"], r["offset"])
                    if raw[:2] == b"\x1f\x8b":
                        try:
                            raw = zlib.decompress(raw, 31)
                        except zlib.error as e:
                            raise ValueError(f"damaged archive {opened} at {r['offset']}") from e
                    fields, block = parse(raw)
                    kind = r["new_type"]
                    if kind == "revisit":
                        block = split_http(block)[0]
                    new = None if r["record_id"] is None else fresh(r["record_id"])
                    head = _fields(kind, new, r["url"], r["date"], r["digest"], block, fields.get("content-type"))
                    if kind == "revisit":
                        to = r["refers_to"]
                        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", None if to is None else f"<{fresh(to)}>"), ("WARC-Refers-To-Target-URI", r["refers_url"]), ("WARC-Refers-To-Date", r["refers_date"])]
                    rows.append((*out.add(head, block), r["record_id"], kind, r["url"], r["date"], r["digest"], len(block), new, r["refers_to"]))
                yield _batch(rows, _RESULT)
        finally:
            out.close()
            if source is not None:
                source.close()

    ranges = resolved(index).repartition(fragments(index.sparkSession), "file", F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("file", "offset")
    return _indexed(ranges.mapInArrow(run, _RESULT), folder, _RESULT)


# --- a crawl made of web pages ---------------------------------------------------------------------------------

_START = datetime(2024, 1, 1)
_RECORDS = "record_id string, type string, url string, date string, digest string, block binary"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def captures(page_id: int, url: str | None, html: str | None) -> list[tuple]:
    """The page's response; for every third page a later revisit, for every fifth a mirror with the same payload, for
    every seventh a revisit of a payload that nobody has."""
    body = (html or "").encode()
    head = http_head(len(body))

    def one(k: int, kind: str, where: str | None, digest: str | None, block: bytes) -> tuple:
        date = (_START + timedelta(days=k, seconds=page_id)).strftime("%Y-%m-%dT%H:%M:%SZ")
        return f"urn:page:{page_id}:{k}", kind, where, date, digest, block

    out = [one(0, "response", url, None, head + body)]
    if page_id % 3 == 0:
        out.append(one(1, "revisit", url, hashlib.sha1(body).hexdigest(), head))
    if page_id % 5 == 0:
        out.append(one(2, "response", None if url is None else url + "#mirror", None, head + body))
    if page_id % 7 == 0:
        out.append(one(3, "revisit", url, hashlib.sha1(body + b"~").hexdigest(), head))
    return out


def crawl(pages: DataFrame) -> DataFrame:
    """Captures of every page (page_id, url, html) with an id; a null page is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield _batch([x for p in zip(*(c.to_pylist() for c in part.columns)) for x in captures(*p)], _RECORDS)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").filter("page_id is not null").mapInArrow(run, _RECORDS)


def resolve_pages(pages: DataFrame) -> DataFrame:
    """Archive a crawl of the pages, read the archives' headers, resolve the revisits and write new archives."""
    spark = pages.sparkSession
    files = [r["file"] for r in write(crawl(pages)).select("file").distinct().collect()]  # one a task that wrote
    index = materialise(headers(spark, files).filter("type <> 'warcinfo'"), "headers")
    return deduplicate(index).select("record_id", "fresh_id", "type", "url", "date", "digest", "refers_to", "block_length")


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
c AS (
  SELECT page_id, 0 AS k, 'response' AS kind, url, html FROM p
  UNION ALL SELECT page_id, 1, 'revisit', url, html FROM p WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, 2, 'response', url || '#mirror', html FROM p WHERE page_id % 5 = 0
  UNION ALL SELECT page_id, 3, 'revisit', url, html || '~' FROM p WHERE page_id % 7 = 0),
r AS (
  SELECT 'urn:page:' || page_id || ':' || k AS record_id, kind, url, sha1(html) AS digest, strlen(html) - CASE WHEN k = 3 THEN 1 ELSE 0 END AS size,
         strftime(TIMESTAMP '2024-01-01' + to_days(k::INTEGER) + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS date FROM c),
f AS (
  SELECT digest, record_id AS first_id FROM r WHERE kind = 'response'
  QUALIFY row_number() OVER (PARTITION BY digest ORDER BY date, record_id, url NULLS FIRST) = 1),
j AS (SELECT r.*, first_id, CASE WHEN first_id IS NOT NULL AND (kind = 'revisit' OR record_id <> first_id) THEN first_id END AS refers_to
      FROM r LEFT JOIN f USING (digest)),
t AS (SELECT *, CASE WHEN refers_to IS NOT NULL THEN 'revisit' ELSE kind END AS new_kind FROM j)
SELECT record_id, 'urn:uuid:' || md5(record_id || '#deduplicated')::UUID::VARCHAR AS fresh_id, new_kind AS type, url, date, digest, refers_to,
       (77 + length(size::VARCHAR) + CASE WHEN new_kind = 'response' THEN size ELSE 0 END)::BIGINT AS block_length
FROM t
"""
