"""Substring deduplication with suffix automata of reference shards and matching statistics.

A span of at least ``least`` words that also occurs in a document of lesser id is removed; the first document keeps
it.  Spans are maximal: the union of all matches at least that long.  The method:

1. Every text is fingerprinted: of each ``least`` - ``SEED`` + 1 successive word n-grams the least hash is selected
   (winnowing), so texts that share ``least`` words select a common n-gram.  Fragments of the hash order tell which
   selected n-grams occur in more than one document; all other text can't repeat and is never looked at again.
2. Around each of these a region (as far as ``least`` words with the n-gram inside can reach) goes to the shard of
   its n-gram.  A shard streams its regions in order of document through a suffix automaton of the regions before:
   the matching statistics give each word's longest match ending there.  Regions that an automaton already holds
   aren't added.  An automaton holds up to ``SHARD_WORDS``; a longer group has several, one at a time, and all later
   regions stream through each, so memory is bounded and no repeat is lost.
   An n-gram with more than ``HOT`` regions (a passage of very many documents) would be too much for one task: its
   regions' windows of ``least`` words meet by hash instead (128 bits), with the least document of each known before
   they do, so the result is the same and no task holds the group.
3. Spans are merged per document and cut out, with the white space behind each word.

Automata are built where the shard's regions are, rather than broadcast: the reference is the corpus itself, so
broadcast automata would grow with it and every document would stream through all of them.

Defined results: null texts stay null, empty and blank ones as they are; rows with equal ids count as one document
and never strike each other; of equal texts under different ids the least id's stays; rows of null id are neither
reference nor cleaned; very long texts are compared whole; an empty table stays empty; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fragments, materialise, small
from .ngram_join import cut, uncut
from .textkernel import Words, column_bytes, grams, mix, sliced

LEAST = 50
SEED = 16
SHARD_WORDS = 300_000
#: a selected n-gram with more regions than this has no group of its own
HOT = 10_000


def _thin(at: np.ndarray, g: np.ndarray, row: np.ndarray, reach: int) -> np.ndarray:
    """Leave out selections of one hash in a row (periodic text) while windows of ``reach`` still hold one."""
    keep = np.ones(len(at), np.bool_)
    same = np.flatnonzero((g[1:] == g[:-1]) & (row[1:] == row[:-1])) + 1
    last = {}
    for i in same.tolist():
        held = last.get(i - 1, at[i - 1])
        more = i + 1 < len(at) and g[i + 1] == g[i] and row[i + 1] == row[i]
        if more and at[i + 1] - held <= reach:
            keep[i] = False
            last = {i: held}
        else:
            last = {i: at[i]}
    return keep


def selected(words: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word (within its text) of the selected n-grams of each text of ``least`` words or more."""
    seed = min(SEED, least)
    g, row, first = grams(words, seed)
    reach = least - seed + 1
    n = len(g) - reach + 1
    if n <= 0:
        return g[:0], row[:0], first[:0]
    low, at = g.copy(), np.arange(len(g), dtype=np.int64)  # least hash of spans of doubling length, and where it is
    span = 1
    while span < reach:
        step = min(span, reach - span)
        m = len(low) - step
        right = low[step:] < low[:m]
        at = np.where(right, at[step:], at[:m])
        low = np.where(right, low[step:], low[:m])
        span += step
    whole = row[:n] == row[reach - 1 :]
    pick = np.unique(at[whole])
    pick = pick[_thin(first[pick], g[pick], row[pick], reach)] if len(pick) else pick
    return g[pick], row[pick], first[pick] - words.first[row[pick]]


def _repeated(got: pa.Table) -> pa.Table:
    """Selected n-grams of a fragment that occur in more than one document."""
    doc, g = uncut(got)
    extra = np.frombuffer(column_bytes(got["extra"].combine_chunks())[0], "<i8").reshape(-1, 2)
    o = np.lexsort((doc, g))
    doc, g, extra = doc[o], g[o], extra[o]
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
    times = np.diff(np.append(at, len(g)))
    many = np.repeat(doc[at] != doc[at + times - 1], times) if len(g) else np.zeros(0, bool)
    n = np.repeat(times, times)[many] if len(g) else times
    return pa.table({"doc_id": doc[many], "sig": np.ascontiguousarray(extra[many, 0]), "seed": g[many].view(np.int64), "at": extra[many, 1].astype(np.int32), "n": n.astype(np.int32)})


class Automaton:
    """Suffix automaton of several word sequences, kept apart by symbols of their own."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0
        self.words = 0
        self.parts = 0

    def add(self, sequence: list[int]) -> None:
        if self.words:
            self.parts += 1
            self._extend(-self.parts)
        for w in sequence:
            self._extend(w)
        self.words += len(sequence)

    def _extend(self, w: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        self.last = cur

    def matches(self, sequence: list[int], least: int) -> tuple[list[list[int]], bool]:
        """Maximal spans covered by matches of ``least`` words or more; whether the whole sequence is one match."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        spans: list[list[int]] = []
        for i, w in enumerate(sequence):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(w)
            if to is None:
                size = 0
                continue
            state = to
            size += 1
            if size >= least:
                start = i + 1 - size
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return spans, size == len(sequence)


def repeats(group: list[tuple[int, int, int, bytes]], least: int, most: int = SHARD_WORDS) -> list[tuple[int, int, int, int]]:
    """(doc_id, sig, first word, end word) of the spans of a group of regions (doc_id, sig, first word, words), in
    order of doc_id, that regions of lesser ids hold."""
    out: list[tuple[int, int, int, int]] = []
    todo = 0
    while todo < len(group):
        shard, seen, waiting, own, full = Automaton(), set(), [], [], None
        doc = None
        for k in range(todo, len(group)):
            who, sig, first, raw = group[k]
            if who != doc:
                for x in own:
                    if x not in seen:
                        seen.add(x)
                        waiting.append(x)
                own, doc = [], who
                if full is None and shard.words + sum(map(len, waiting)) // 4 > most:
                    full = k
            if raw in seen:
                if len(raw) >= 4 * least:
                    out.append((who, sig, first, first + len(raw) // 4))
                continue
            for x in waiting:
                shard.add(np.frombuffer(x, "<u4").tolist())
            waiting = []
            held = False
            if shard.words:
                spans, held = shard.matches(np.frombuffer(raw, "<u4").tolist(), least)
                out.extend((who, sig, first + s, first + e) for s, e in spans)
            if full is None and not held:
                own.append(raw)
            elif full is None:
                seen.add(raw)
        todo = len(group) if full is None else full
    return out


def _shard(least: int):
    """Stream a partition's regions, ordered by n-gram and document, group by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "sig", "first", "end"]

        def rows(found: list) -> pa.RecordBatch:
            cols = list(zip(*found)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names)

        now, group, found = None, [], []
        for b in batches:
            for seed, doc, sig, first, raw in zip(*(c.to_pylist() for c in b.columns)):
                if seed != now:
                    if len(group) > 1:
                        found.extend(repeats(group, least))
                    now, group = seed, []
                group.append((doc, sig, first, raw))
            if found:
                yield rows(found)
                found = []
        if len(group) > 1:
            yield rows(repeats(group, least))

    return run


def _select(least: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in sliced(batches):
            g, row, at = selected(words, least)
            if len(g):
                o = np.argsort(row, kind="stable")
                extra = np.stack([part.column(1).to_numpy()[row[o]], at[o]], 1).astype("<i8")
                yield cut(part.column(0).to_numpy()[row[o]], g[o], count, extra=np.ascontiguousarray(extra).view("V16").ravel())

    return run


def _regions(least: int):
    seed = min(SEED, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in sliced(batches):
            ids, sigs = part.column(0).to_pylist(), part.column(1).to_pylist()
            small = words.hash.astype("<u4")
            out = [[], [], [], [], []]
            for r, hits in enumerate(part.column(3).to_pylist()):
                lo, hi = int(words.first[r]), int(words.first[r + 1])
                for h in hits:
                    a = max(lo, lo + h["at"] - (least - seed))
                    for column, value in zip(out, (h["seed"], ids[r], sigs[r], a - lo, small[a : min(hi, lo + h["at"] + least)].tobytes())):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["seed", "doc_id", "sig", "first", "words"])

    return run


def _windows(least: int):
    """Hashes, document and place of every window of ``least`` words that holds one of its text's hits."""
    seed = min(SEED, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in sliced(batches):
            g, row, at = grams(words, least)
            other = Words(words.data, words.offsets)
            other._hash = mix(words.hash + np.uint64(0x5851F42D4C957F2D))
            h, _, _ = grams(other, least)
            edge = np.zeros(len(words.hash) + 1, np.int64)
            for r, hits in enumerate(part.column(3).to_pylist()):
                lo, hi = int(words.first[r]), int(words.first[r + 1])
                for x in hits:
                    edge[max(lo, lo + x["at"] - (least - seed))] += 1
                    edge[min(hi, lo + x["at"] + 1)] -= 1
            use = np.cumsum(edge)[at] > 0
            g, h, row, at = g[use], h[use], row[use], at[use]
            ids = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(h.view(np.int64)), part.column(0).take(ids), part.column(1).take(ids), pa.array((at - words.first[row]).astype(np.int32))], ["g", "h", "doc_id", "sig", "first"])

    return run


def repeated_spans(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """doc_id, sig (hash of the row's text) and the sorted, merged spans [first, end) of words to remove."""
    count = fragments(docs.sparkSession, docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"), "text").filter("doc_id is not null and text is not null")
    blocks = texts.mapInArrow(_select(least, count), "frag int, docs binary, times binary, grams binary, extra binary")
    hits = blocks.groupBy("frag").applyInArrow(lambda t: _repeated(t), "doc_id long, sig long, seed long, at int, n int")
    hits = materialise(hits.groupBy("doc_id", "sig").agg(F.collect_set(F.struct("seed", "at", "n")).alias("hits")), "hits")

    def near(part: DataFrame) -> DataFrame:
        kept = texts.join(small(part.select("doc_id", "sig")), ["doc_id", "sig"], "left_semi").dropDuplicates(["doc_id", "sig"])
        return kept.join(part, ["doc_id", "sig"]).select("doc_id", "sig", "text", "hits")

    few = hits.withColumn("hits", F.filter("hits", lambda x: x["n"] <= hot)).filter("size(hits) > 0")
    many = hits.withColumn("hits", F.filter("hits", lambda x: x["n"] > hot)).filter("size(hits) > 0")
    regions = near(few).mapInArrow(_regions(least), "seed long, doc_id long, sig long, first int, words binary")
    streams = regions.repartition(count, "seed").sortWithinPartitions("seed", "doc_id", "sig", "first")
    spans = streams.mapInArrow(_shard(least), "doc_id long, sig long, first int, end int")
    if not many.isEmpty():
        windows = materialise(near(many).mapInArrow(_windows(least), "g long, h long, doc_id long, sig long, first int"), "windows")
        least_of = windows.groupBy("g", "h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("g", "h", "lo")
        later = windows.join(least_of, ["g", "h"]).filter("doc_id > lo")
        spans = spans.unionByName(later.select("doc_id", "sig", "first", (F.col("first") + least).alias("end")))
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct("first", "end"))),
        F.expr("cast(array() as array<struct<first:int,end:int>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["first"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return spans.distinct().groupBy("doc_id", "sig").agg(joined.alias("spans"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, words in sliced(batches):
        texts, removed = [], []
        for r, spans in enumerate(part.column(2).to_pylist()):
            raw = words.data[words.offsets[r] : words.offsets[r + 1]].tobytes()
            if not spans:
                texts.append(raw if part.column(1)[r].is_valid else None)
                removed.append(0)
                continue
            lo, base = int(words.first[r]), int(words.offsets[r])
            last = int(words.first[r + 1])
            kept, at = [], 0
            for s in spans:
                kept.append(raw[at : int(words.start[lo + s["first"]]) - base])
                at = int(words.start[lo + s["end"]]) - base if lo + s["end"] < last else len(raw)
            kept.append(raw[at:])
            texts.append(b"".join(kept))
            removed.append(sum(s["end"] - s["first"] for s in spans))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(removed, pa.int32())], ["doc_id", "text", "removed_words"])


def deduplicated(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """doc_id, text without repeated spans, and the number of words removed, of every row."""
    spans = materialise(repeated_spans(docs, least, hot), "spans")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("sig"))
    found = texts.join(small(spans), ["doc_id", "sig"], "left")
    return found.select("doc_id", "text", "spans").mapInArrow(_without, "doc_id long, text string, removed_words int")


SQL = """
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+[ \\t\\n\\v\\f\\r]*') AS p,
         regexp_extract(text, '^[ \\t\\n\\v\\f\\r]*') AS lead FROM documents),
w AS (SELECT doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS pos FROM d),
t AS (SELECT doc_id, list_transform(p, lambda x: rtrim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS p FROM d),
g AS (SELECT doc_id, i AS pos, md5(array_to_string(p[i:i + 49], ' ')) AS gram
      FROM (SELECT doc_id, p, unnest(range(1, len(p) - 48)) AS i FROM t WHERE len(p) >= 50)),
m AS (SELECT gram, min(doc_id) AS first_doc FROM g GROUP BY gram),
f AS (SELECT g.doc_id, g.pos FROM g JOIN m USING (gram) WHERE m.first_doc < g.doc_id),
c AS (SELECT w.doc_id, w.pos, w.piece,
             max(CASE WHEN f.pos IS NOT NULL THEN w.pos END) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM w LEFT JOIN f ON f.doc_id = w.doc_id AND f.pos = w.pos),
k AS (SELECT doc_id, string_agg(piece, '' ORDER BY pos) FILTER (WHERE NOT gone) AS rest, count(*) FILTER (WHERE gone) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE d.lead || coalesce(k.rest, '') END AS text, coalesce(k.n, 0)::INTEGER AS removed_words
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
