"""Token ids by a public byte-level BPE, one lookup per distinct word of a slice, and their binary records.

A text is cut where the tokenizer's own pattern always cuts: before the white space of a word.  One space joins
the word after it; of a longer run of white space all but its last character is one piece and the last joins the
word if it is a space.  Equal pieces have equal ids, so only a slice's distinct pieces that the worker hasn't met
are encoded, and ids are gathered with numpy.  Texts with white space beyond ASCII are encoded whole.  The result
equals encoding whole texts (tested on made-up ones of all kinds of white space).

Binary output: every record is ``u64 length, u32 masked CRC-32C of those 8 bytes, payload, u32 masked CRC-32C of the
payload``, little endian, the framing public record readers know.  The payload is ``i64 doc_id, u32 n, n ids`` of two
bytes (four if the vocabulary needs them).  Each task writes one file in the shared folder under a name of its own
attempt; the index, a separate Parquet table, names file, offset and length of every record, so a lost or repeated
attempt leaves at most a file that no index row names, and readers fetch records in any order.

Defined results: a null text is a record of no ids, as an empty one; a null id is written as -1 in the payload and
null in the index; rows with equal ids or texts are records of their own; a very long text is one record, encoded
in one slice of its own; an empty table gives an empty index; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path
from .textkernel import WHITE, column_bytes, hash_spans, release

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE = 2_000_000
KNOWN_MOST = 1_000_000


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the pieces that tile all texts.  Texts must have no white space beyond ASCII (see ``Encoder``)."""
    size = len(data)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = WHITE[data]
    cut = np.zeros(size + 1, np.bool_)
    cut[offsets] = True
    head = np.zeros(size, np.bool_)
    head[offsets[:-1][offsets[:-1] < size]] = True
    before = np.zeros(size, np.bool_)
    before[1:] = white[:-1]
    before &= ~head
    after_ink = np.zeros(size, np.bool_)  # the next byte of the same text is not white
    after_ink[:-1] = ~white[1:] & ~head[1:]
    cut[:-1] |= white & ~before  # a run of white space starts
    cut[:-1] |= white & before & after_ink  # its last character, a word behind it
    not_space = np.zeros(size, np.bool_)
    not_space[1:] = data[:-1] != 32
    cut[:-1] |= ~white & before & not_space  # a word that no space joins
    # between letters and punctuation that are surely such (ASCII, Latin-1 letters); an apostrophe may be part of either
    kind = _SORT[data]
    latin = np.flatnonzero(data[:-1] == 0xC3)
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    kind[latin] = 1
    kind[latin + 1] = 1
    cut[1:-1] |= (kind[:-1] + kind[1:] == 3) & ~head[1:]
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


_SORT = np.full(256, 9, np.uint8)  # 1 letter, 2 punctuation, 9 neither or unsure
_SORT[65:91] = _SORT[97:123] = 1
for _c in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~":
    _SORT[_c] = 2


class Encoder:
    """Ids of texts, with a worker's memory of pieces met before (bounded; forgotten when full)."""

    def __init__(self, path: str = VOCABULARY):
        self.bpe = encoding(path)
        self.wide = self.bpe.n_vocab > 65536
        (self.newline,) = self.bpe.encode_ordinary("\n")
        self._forget()

    def _learn(self, h: np.ndarray, texts: list[bytes]) -> None:
        """Encode new pieces, those without a line break all in one call: each followed by a break, whose id ends it."""
        plain = self.bpe.encode_ordinary
        lines = [i for i, x in enumerate(texts) if b"\n" not in x and b"\r" not in x and x.strip()]
        rest = sorted(set(range(len(texts))) - set(lines))
        got = np.array(plain(b"\n".join([texts[i] for i in lines] + [b""]).decode("utf-8", "replace")), np.uint32)
        ends = np.flatnonzero(got == self.newline)
        if len(ends) != len(lines):
            raise ValueError("a piece took its line break along: it holds white space that pieces() doesn't know")
        other = [np.array(plain(texts[i].decode("utf-8", "replace")), np.uint32) for i in rest]
        n = np.empty(len(texts), np.int64)
        start = np.empty(len(texts), np.int64)
        n[lines] = np.diff(ends, prepend=-1) - 1
        start[lines] = ends - n[lines]
        n[rest] = [len(x) for x in other]
        start[rest] = len(got) + np.cumsum(n[rest]) - n[rest]
        self.ids = np.concatenate([self.ids, got, *other])
        h2 = np.concatenate([self.hash, h])
        o = np.argsort(h2, kind="stable")
        self.hash = h2[o]
        self.start = np.concatenate([self.start, start + len(self.ids) - len(got) - sum(map(len, other))])[o]
        self.size = np.concatenate([self.size, n])[o]

    def _forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the number of each text's."""
        s, e = pieces(data, offsets)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        distinct, first, back = np.unique(hash_spans(data, s, e), return_index=True, return_inverse=True)
        if len(self.hash) + len(distinct) > KNOWN_MOST:
            self._forget()
        at = np.searchsorted(self.hash, distinct)
        new = np.flatnonzero(self.hash[np.minimum(at, len(self.hash) - 1)] != distinct) if len(self.hash) else np.arange(len(distinct))
        if len(new):
            raw = data.tobytes()
            self._learn(distinct[new], [raw[a:b] for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist())])
            at = np.searchsorted(self.hash, distinct)
        which = at[back]
        n = self.size[which]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.start[which] - total[:-1], n)]
        return ids, np.diff(total[np.searchsorted(s, offsets)])


def _odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F,
    U+3000), which ends a word for the pattern but not for ``pieces``; they are encoded whole."""
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[np.isin(data[two + 1], (0x85, 0xA0))]
    three = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)) if len(data) > 2 else np.zeros(0, np.int64)
    code = data[three].astype(np.int64) << 16 | data[three + 1].astype(np.int64) << 8 | data[three + 2]
    three = three[(code == 0xE19A80) | (code >= 0xE28080) & (code <= 0xE2808A) | np.isin(code, (0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080))]
    return np.unique(np.searchsorted(offsets, np.concatenate([two, three]), "right") - 1)


def encoded(batches: Iterator[pa.RecordBatch], path: str, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with all ids and the number of each row's."""
    encode = Encoder(path)
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = column_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = min(max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1), batch.num_rows)
            part, own = data[off[at] : off[to]], off[at : to + 1] - off[at]
            odd = _odd_rows(part, own)
            if len(odd):
                keep = np.ones(len(part), np.bool_)
                for r in odd:
                    keep[own[r] : own[r + 1]] = False
                whole = {int(r): np.array(encode.bpe.encode_ordinary(part[own[r] : own[r + 1]].tobytes().decode()), np.uint32) for r in odd}
                size = np.diff(own)
                size[odd] = 0
                ids, n = encode(part[keep], np.append(0, np.cumsum(size)))
                lists = np.split(ids, np.cumsum(n)[:-1])
                for r, own_ids in whole.items():
                    lists[r], n[r] = own_ids, len(own_ids)
                ids = np.concatenate(lists)
            else:
                ids, n = encode(part, own)
            yield batch.slice(at, to - at), ids, n
            at = to
    release()


def token_counts(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """doc_id and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, n in encoded(batches, path):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n_tokens long")


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0x82F63B78), t >> np.uint32(1)).astype(np.uint32)
    # effect of BLOCK zero bytes on each byte of a state
    move = np.zeros((4, 256), np.uint32)
    for k in range(4):
        v = (np.arange(256, dtype=np.uint32) << np.uint32(8 * k)).astype(np.uint32)
        for _ in range(_BLOCK):
            v = t[v & np.uint32(255)] ^ (v >> np.uint32(8))
        move[k] = v
    return t, move


_BLOCK = 128
_TABLE, _MOVE = _crc_tables()


def crc32c(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32C of byte ranges.  Ranges are padded in front to whole blocks, whose states are computed side by side
    and then joined; the pad has no effect as the all-ones start is folded into the first four bytes."""
    size = end - start
    blocks = np.maximum(1, -(-(size + 4) // _BLOCK))  # four bytes for folding short ranges
    total = int(blocks.sum())
    out = np.zeros(len(size), np.uint32)
    if not len(size):
        return out
    edge = np.concatenate([[0], np.cumsum(blocks)]) * _BLOCK
    flat = np.zeros(total * _BLOCK, np.uint8)
    spot = np.arange(int(size.sum())) + np.repeat(edge[1:] - size - (np.cumsum(size) - size), size)
    take = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    flat[spot] = data[take]
    long = size >= 4
    for j in range(4):
        flat[(edge[1:] - size + j)[long]] ^= 0xFF
    state = np.zeros(total, np.uint32)
    columns = np.ascontiguousarray(flat.reshape(total, _BLOCK).T)
    for c in columns:
        state = _TABLE[(state & np.uint32(255)) ^ c] ^ (state >> np.uint32(8))
    # join the blocks of each range, longest ranges first so that the active ones are a prefix
    order = np.argsort(-blocks, kind="stable")
    first = edge[:-1] // _BLOCK
    run = np.zeros(len(size), np.uint32)
    many = blocks[order]
    for k in range(int(blocks.max())):
        live = order[: int(np.searchsorted(-many, -k, "left"))]
        v = run[live]
        moved = _MOVE[0][v & np.uint32(255)] ^ _MOVE[1][(v >> np.uint32(8)) & np.uint32(255)] ^ _MOVE[2][(v >> np.uint32(16)) & np.uint32(255)] ^ _MOVE[3][v >> np.uint32(24)]
        run[live] = moved ^ state[first[live] + k]
    out = run ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(~long):  # ranges under four bytes
        v = 0xFFFFFFFF
        for b in data[start[i] : end[i]]:
            v = int(_TABLE[(v ^ int(b)) & 255]) ^ (v >> 8)
        out[i] = v ^ 0xFFFFFFFF
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """The usual mask for checksums stored beside their data."""
    return (((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)).astype(np.uint32)


def frame(doc_ids: np.ndarray, ids: np.ndarray, n: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all records, with each one's offset, length and masked payload checksum."""
    width = 4 if wide else 2
    payload = 12 + n * width
    length = payload + 16
    off = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)

    def put(at: np.ndarray, values: np.ndarray) -> None:
        raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
        for j in range(raw.shape[1]):
            out[at + j] = raw[:, j]

    put(off, payload.astype("<u8"))
    put(off + 12, doc_ids.astype("<i8"))
    put(off + 20, n.astype("<u4"))
    raw = ids.astype("<u4" if wide else "<u2").view(np.uint8)
    size = n * width
    out[np.arange(len(raw)) + np.repeat(off + 24 - (np.cumsum(size) - size), size)] = raw
    put(off + 8, masked(crc32c(out, off, off + 8)))
    check = masked(crc32c(out, off + 12, off + 12 + payload))
    put(off + 12 + payload, check)
    return out, off, length, check


_INDEX = "doc_id long, file string, offset long, length long, n_tokens long, checksum long"


def write_records(docs: DataFrame, path: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """Write the records of every row of docs; the index, written beside them, is returned."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.records"
        store.create_dir(f"{root}/data", recursive=True)
        at, sink = 0, None
        try:
            for part, ids, n in encoded(batches, path):
                sink = sink or store.open_output_stream(f"{root}/data/{name}")
                keys = part.column(0)
                raw, off, length, check = frame(keys.fill_null(-1).to_numpy(zero_copy_only=False), ids, n, encoding(path).n_vocab > 65536)
                sink.write(raw.tobytes())
                arrays = [keys, pa.array([f"data/{name}"] * len(n)), pa.array(off + at), pa.array(length), pa.array(n), pa.array(check.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "file", "offset", "length", "n_tokens", "checksum"])
                at += len(raw)
        finally:
            if sink is not None:
                sink.close()

    index = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(_INDEX).parquet(f"{folder}/index").withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def read_records(index: DataFrame) -> DataFrame:
    """doc_id and ids of the index's records, fetched by offset in whatever order the index has; both checksums of
    each record are verified and a damaged record raises.  A record's length and its number of ids give their width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            keys, lists = [], []
            for file, off, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if file not in opened:
                    store, path = fs.FileSystem.from_uri(file)
                    opened[file] = store.open_input_file(path)
                raw = np.frombuffer(opened[file].read_at(length, off), np.uint8)
                head, tail = raw[8:12].view("<u4")[0], raw[-4:].view("<u4")[0]
                one = np.array([0])
                if raw[:8].view("<u8")[0] != length - 16 or masked(crc32c(raw, one, one + 8))[0] != head or masked(crc32c(raw, one + 12, one + length - 4))[0] != tail:
                    raise ValueError(f"damaged record at {off} of {file}")
                keys.append(int(raw[12:20].view("<i8")[0]))
                n = int(raw[20:24].view("<u4")[0])
                lists.append(raw[24 : length - 4].view("<u4" if length - 28 == 4 * n else "<u2").astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return index.select("file", "offset", "length").mapInArrow(run, "doc_id long, ids array<int>")
