"""Sequence packing: bounded-space online best fit per packer, then one merge of what the packers leave open.

Documents are cut at ``window`` tokens; a hash of the id and of the row's place deals them to packers (so that an id
with very many rows, or null, doesn't fill one packer), each of which sees its pieces in order of id and keeps a fixed number of windows open.  A piece goes to the open window with the least room that
still takes it (ties: the oldest).  When none does and all places are in use, the fullest is emitted (ties: the
oldest) and a fresh window takes the piece.  Windows still open at the end are merged whole, fullest first, by best
fit; up to ``MERGE`` packers share a merger, so no task grows with the data.  Only ids and lengths are shuffled.

Defined results: texts without tokens (null, empty) are in no window; a text of n tokens gives n // window full
windows of its own and a piece of the rest; rows with equal ids are placed each for itself, in order of length; rows
of null id too; a very long text fills windows of its own first; other columns, whatever their names, are not
read; an empty table gives no windows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fragments, materialise
from .tokens import VOCABULARY, token_counts

MERGE = 256
_PACKED = "packer long, seq long, open boolean, fill int, doc_ids array<long>, starts array<long>, lengths array<int>"
_NAMES = ["packer", "seq", "open", "fill", "doc_ids", "starts", "lengths"]


class Packer:
    """The online algorithm for one stream of pieces (doc_id, start, length)."""

    def __init__(self, window: int, places: int):
        self.window, self.places, self.born = window, places, 0
        self.room: list[tuple[int, int]] = []  # (room, birth) ascending
        self.held: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> list[tuple] | None:
        """Place a piece; the pieces of the window that this emits, if any."""
        need, out = piece[2], None
        if need == self.window:
            return [piece]
        at = bisect_left(self.room, (need, -1))
        if at < len(self.room):
            room, birth = self.room.pop(at)
        else:
            if len(self.room) == self.places:
                _, gone = self.room.pop(0)
                out = self.held.pop(gone)
            room, birth = self.window, self.born
            self.born += 1
            self.held[birth] = []
        self.held[birth].append(piece)
        insort(self.room, (room - need, birth))
        return out

    def rest(self) -> list[list[tuple]]:
        return [self.held[b] for _, b in sorted(self.room, key=lambda x: x[1])]


def merge(open_windows: list[tuple], window: int) -> list[list[tuple]]:
    """Best fit of whole windows (fill, key, pieces), fullest first, ties by key."""
    room: list[tuple[int, int]] = []
    out: list[list[tuple]] = []
    for fill, _, held in sorted(open_windows, key=lambda x: (-x[0], x[1])):
        at = bisect_left(room, (fill, -1))
        left, k = room.pop(at) if at < len(room) else (window, len(out))
        if k == len(out):
            out.append([])
        out[k].extend(held)
        insort(room, (left - fill, k))
    return out


def _rows(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*((p, s, o, sum(x[2] for x in held), [x[0] for x in held], [x[1] for x in held], [x[2] for x in held]) for p, s, o, held in found))) or [[]] * 7
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], _NAMES)


def pack(counts: DataFrame, window: int = 2048, places: int = 64, packers: int | None = None) -> DataFrame:
    """Windows of the table (doc_id, n_tokens): window_id, fill and, per piece, doc_id, first token and length."""
    packers = packers or fragments(counts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer, seq, found = None, None, 0, []

        def close() -> None:
            nonlocal seq
            for held in packer.rest() if packer else []:
                found.append((now, seq, True, held))
                seq += 1

        for batch in batches:
            for who, doc, n in zip(*(c.to_pylist() for c in batch.columns)):
                if who != now:
                    close()
                    now, packer, seq = who, Packer(window, places), 0
                for start in range(0, n, window):
                    held = packer.add((doc, start, min(window, n - start)))
                    if held:
                        found.append((who, seq, False, held))
                        seq += 1
            yield _rows(found)
            found = []
        close()
        yield _rows(found)

    def join_up(key: tuple, got: pa.Table) -> pa.Table:
        todo = [(r["fill"], (r["packer"], r["seq"]), list(zip(r["doc_ids"], r["starts"], r["lengths"]))) for r in got.to_pylist()]
        done = [(packers + key[0].as_py(), i, False, held) for i, held in enumerate(merge(todo, window))]
        return pa.Table.from_batches([_rows(done)])

    place = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(packers))
    dealt = counts.filter("n_tokens > 0").select(place.alias("packer"), "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))
    streams = dealt.repartition(packers, "packer").sortWithinPartitions("packer", "doc_id", "n_tokens")
    packed = materialise(streams.mapInArrow(run, _PACKED), "packed")
    merged = packed.filter("open").groupBy(F.floor(F.col("packer") / MERGE).cast("long").alias("merger")).applyInArrow(join_up, _PACKED)
    return packed.filter("not open").unionByName(merged).select((F.col("packer") * (1 << 32) + F.col("seq")).alias("window_id"), "fill", "doc_ids", "starts", "lengths")


def pack_documents(docs: DataFrame, window: int = 2048, places: int = 64, packers: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Windows of the documents' token ids (see ``tokens`` for how a text becomes ids)."""
    return pack(token_counts(docs, vocabulary), window, places, packers)
