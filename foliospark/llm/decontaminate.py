"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are compared as hashes of their lower-case letters and digits, so punctuation and case don't hide a copy.
Every word n-gram of a test item is a seed; the corpus frequency of each is counted over all documents, and an item
keeps its rare ones: those no more frequent than its median seed, or than twice its lower quartile.
A document that holds a rare seed of an item is aligned with it around the seed's diagonal: local alignment of
words with match 2, mismatch -1 and gap -1, over a window that reaches the item's length beyond the seeds.  The
score is divided by the best the item could have (2 x its words); at ``threshold`` or above it is a leak.

The test set is the small side: its seeds are sent to executors in chunks of at most ``CHUNK_WORDS`` words, one pass
over the documents a chunk, so what is broadcast is bounded however large the test set is.  No text is shuffled.

Defined results: null, empty and blank texts match nothing, on either side; items of one or two words are compared
as one seed of all their words; an item that occurs in a document more than once gives one row, its best score;
a tie between windows goes to the first; repeated rows count once; rows of null id are searched and lose their leaks
like others; very long texts are searched whole; empty tables give no rows; other columns are not read and may have
any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small
from .textkernel import Words, grams, sliced

SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
CHUNK_WORDS = 2_000_000

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_DROP = np.zeros(256, np.bool_)
_DROP[33:48] = _DROP[58:65] = _DROP[91:97] = _DROP[123:127] = True


def plain(words: Words) -> Words:
    """The texts in lower case (ASCII and Latin-1) with ASCII punctuation blanked; byte positions stay."""
    data = _LOW[words.data]
    at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[at] += 32
    data[_DROP[data]] = 32
    return Words(data, words.offsets)


class Items:
    """Word hashes and seeds of a chunk of test items; small enough to broadcast."""

    def __init__(self, ids: list[int], hashes: list[np.ndarray], seeds: np.ndarray, item: np.ndarray, at: np.ndarray):
        self.ids, self.hashes = ids, hashes
        o = np.argsort(seeds, kind="stable")
        self.seed, self.item, self.at = seeds[o], item[o], at[o]
        self.distinct = np.unique(self.seed)

    def keep(self, mask: np.ndarray) -> Items:
        return Items(self.ids, self.hashes, self.seed[mask], self.item[mask], self.at[mask])


def _items(bench: DataFrame) -> Iterator[Items]:
    """Chunks of the test set, in order of id; the driver holds one at a time."""
    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in rows.toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"].split())
        if size >= CHUNK_WORDS:
            yield items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield items(ids, texts)


def items(ids: list[int], texts: list[str]) -> Items:
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    hashes: list[np.ndarray] = []
    seeds, item, at = [], [], []
    for _, raw in sliced(iter([batch])):
        w = plain(raw)
        g, row, first = grams(w, SEED, short=True)
        seeds.append(g)
        item.append(row + len(hashes))
        at.append(first - w.first[row])
        hashes.extend(w.hash[w.first[r] : w.first[r + 1]] for r in range(len(w.offsets) - 1))
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return Items(ids, hashes, join(seeds, np.uint64), join(item, np.int64), join(at, np.int64))


def align(a: np.ndarray, b: np.ndarray) -> int:
    """Best Smith-Waterman score of two word sequences.  A row's gaps along it are a running maximum, as the gap
    cost is linear."""
    best = 0
    prev = np.zeros(len(b) + 1, np.int64)
    slope = np.arange(len(b) + 1) * -GAP
    for x in a:
        row = np.maximum(prev + GAP, 0)
        row[1:] = np.maximum(row[1:], prev[:-1] + np.where(b == x, MATCH, MISMATCH))
        row = np.maximum.accumulate(row + slope) - slope
        best = max(best, int(row.max()))
        prev = row
    return best


def frequencies(docs: DataFrame, chunk: Items) -> np.ndarray:
    """Occurrences in the corpus of each of the chunk's distinct seeds."""
    shared = docs.sparkSession.sparkContext.broadcast(chunk.distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for _, raw in sliced(batches):
            g, _, _ = grams(plain(raw), SEED, short=True)
            spot = np.searchsorted(known, g)
            spot[spot == len(known)] = 0
            total += np.bincount(spot[known[spot] == g], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(total[some])], ["seed", "n"])

    found = docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    got = found.toArrow()  # no more rows than the chunk has seeds
    total = np.zeros(len(chunk.distinct), np.int64)
    total[np.searchsorted(chunk.distinct, got["seed"].to_numpy().view(np.uint64))] = got["n"].to_numpy()
    return total


def rare(chunk: Items, counts: np.ndarray) -> Items:
    """Seeds no more frequent than their item's median seed, or than twice its lower quartile."""
    n = counts[np.searchsorted(chunk.distinct, chunk.seed)] if len(chunk.seed) else np.zeros(0, np.int64)
    size = np.bincount(chunk.item, minlength=len(chunk.ids))
    held = n[np.lexsort((n, chunk.item))]
    first = np.cumsum(size) - size
    most = np.zeros(len(size))
    some = np.flatnonzero(size)
    at, m = first[some], size[some]
    most[some] = np.maximum((held[at + (m - 1) // 2] + held[at + m // 2]) / 2, 2 * np.maximum(1, held[at + m // 4]))
    return chunk.keep(n <= most[chunk.item])


def leaks_of(w: Words, chunk: Items, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end word) of each item that leaks into each text of a slice."""
    g, row, first = grams(w, SEED, short=True)
    if not len(g) or not len(chunk.seed):
        return
    spot = np.searchsorted(chunk.distinct, g)
    spot[spot == len(chunk.distinct)] = 0
    hit = np.flatnonzero(chunk.distinct[spot] == g)
    lo = np.searchsorted(chunk.seed, g[hit], "left")
    n = np.searchsorted(chunk.seed, g[hit], "right") - lo
    each = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
    where, item, at = first[np.repeat(hit, n)], chunk.item[each], chunk.at[each]
    groups: dict[tuple[int, int], list[int]] = defaultdict(list)
    for r, i, d in zip(w.row[where].tolist(), item.tolist(), (where - at).tolist()):
        groups[r, i].append(d)
    h = w.hash
    for (r, i), diagonals in groups.items():
        own = chunk.hashes[i]
        m, best = len(own), (0.0, 0, 0)
        diagonals.sort()
        at = 0
        while at < len(diagonals):
            # seeds whose diagonals are within a third of the item are one passage
            to = at + 1
            while to < len(diagonals) and diagonals[to] - diagonals[to - 1] <= max(2, m // 3):
                to += 1
            lo = max(w.first[r], diagonals[at] - m // 2)
            hi = min(w.first[r + 1], diagonals[to - 1] + m + m // 2)
            near = h[lo:hi]
            # words in common bound the score: most chance hits end here
            if MATCH * np.isin(own, near).sum() >= threshold * MATCH * m:
                s = align(own, near) / (MATCH * m)
                best = max(best, (s, int(lo - w.first[r]), int(hi - w.first[r])))
            at = to
        if best[0] >= threshold:
            yield r, i, best[0], best[1], best[2]


_TYPES = {"score": "double", "first_word": "int", "end_word": "int"}


def leaks(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, by_text: bool = False) -> DataFrame:
    """doc_id, item_id, score and the aligned window (first_word, end_word) of every leak; by_text: with sig, the
    hash of the text, and a row for each text of an id."""
    spark = docs.sparkSession
    names = ["doc_id", *["sig"] * by_text, "item_id", "score", "first_word", "end_word"]
    schema = ", ".join(f"{x} {_TYPES.get(x, 'long')}" for x in names)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.xxhash64("text").alias("sig")] * by_text, "text")
    out = None
    for chunk in _items(bench):
        shared = spark.sparkContext.broadcast(rare(chunk, frequencies(docs, chunk)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, raw in sliced(batches):
                w = plain(raw)
                found = list(leaks_of(w, shared.value, threshold))
                if found:
                    r, i, s, lo, hi = zip(*found)
                    ids = [shared.value.ids[x] for x in i]
                    row = [part.column(i).take(pa.array(r)) for i in range(1 + by_text)]
                    yield pa.RecordBatch.from_arrays([*row, pa.array(ids, pa.int64()), pa.array(s, pa.float64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names)

        one = texts.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("score", F.negate("first_word").alias("k"), F.negate("end_word").alias("e"))).alias("b")
    keys = [x for x in names if x in ("doc_id", "sig", "item_id")]
    return out.groupBy(*keys).agg(best).select(*keys, "b.score", F.negate("b.k").alias("first_word"), F.negate("b.e").alias("end_word"))


def clean(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text an item leaks into, rows of null id included; all columns stay as they are.
    Rows are known by id and hash of the text, so another row of the same id stays."""
    bad = materialise(leaks(docs, bench, threshold, True).select("doc_id", "sig").distinct(), "leaked").toDF("its_id", "its_sig")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names of the caller's columns can't clash with ours
    at_id, at_text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    kept = plain.join(small(bad), plain[at_id].cast("long").eqNullSafe(F.col("its_id")) & (F.xxhash64(at_text) == F.col("its_sig")), "left_anti")
    return kept.toDF(*names)
