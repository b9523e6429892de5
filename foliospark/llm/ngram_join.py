"""N-gram Jaccard join by vertical partitioning.

A document is the set of its word n-grams (a text of fewer words is one gram of all of them).  All pairs of distinct
texts with Jaccard similarity of at least ``threshold`` are found, exactly:

1. Copies.  Documents of equal text are linked to the least id among them, which stands for all (its class).
2. Survivors.  The order of gram hashes is cut into fragments; each fragment counts, per document, grams that some
   other document has too, and the counts are summed.  A document with fewer than threshold x size shared grams is in
   no pair.  Only four bytes of a hash travel here: a collision can only let a document through.
3. Candidates.  The survivors' whole hashes are cut again; fragments give back document frequencies.  Each survivor
   orders its grams globally, rare first; two documents of a pair share a gram among the first
   size - ceil(threshold x size) + 1 of both, so frequent grams (a licence line, a greeting) never meet themselves.
   Of their first shared gram, the places in both orders leave enough grams for the overlap: other meetings are none.
4. Overlaps.  The gram order is cut into ``VERTICAL`` fragments; each counts every candidate's partial overlap on its
   own, and a sum per pair gives the overlap.  A document's segments go once to the cell of its group's least id.

``similar_pairs`` has all pairs of classes, and a row for each further member of a class: copies are not expanded.
``linked`` has a row per document with the id of its group (what pairs lead to, least id) and its numbers of copies and
of links; ``one_of_each`` needs groups only.  Groups don't need their pairs: each document is first counted with the least
one of each of its posting lists; candidates whose documents that has put into one group are then left out, all others
are counted, so groups are those of all pairs.  No pair leaves its group, so ``linked`` then counts all links of a group
at once: parts of at most ``PART_DOCS`` documents (``PART_GRAMS`` grams) meet in cells, where overlaps are summed up over
fragments of the grams as products of 0/1 matrices.  Only a number per document leaves a cell, pairs are no rows.

Blocks of numpy bytes are shuffled, a row per fragment and slice of input, not rows per gram.  No posting list or
group is cut.

Defined results: null, empty and blank texts are in no pair; rows with one id are one document (the union of their
grams), copies are documents with the same texts, and no document pairs with itself; rows of null id are left out;
very long texts are sets of all their grams; pairs of equal similarity are all there; in ``linked`` a document in no
pair is a class of its own; other columns, whatever their names, are not read; an empty table has no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fragments, free_name, materialise, released, small
from .textkernel import column_bytes, grams, release, sliced, unique_rows

NGRAM = 3
THRESHOLD = 0.5
VERTICAL = 8
PAIRS_AT_ONCE = 1_000_000
PART_DOCS = 2_048
PART_GRAMS = 2_000_000
#: a gram of fewer than a cell's documents / RARE is counted by its pairs, others in matrices of GRAMS_AT_ONCE columns
RARE = 32
GRAMS_AT_ONCE = 2_048
INK = "[^ \\t\\n\\u000B\\f\\r]"


def fragment_of(g: np.ndarray, count: int) -> np.ndarray:
    """Which of ``count`` equal ranges of the hash order a gram is in."""
    return (((g >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.uint32)


def _binary(raw: np.ndarray, edges: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(raw)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * raw.itemsize).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def cut(doc: np.ndarray, g: np.ndarray, count: int, low: bool = False, extra: np.ndarray | None = None, about: np.ndarray | None = None) -> pa.RecordBatch:
    """A row per fragment: runs of documents with their numbers of grams, and the grams (their low halves); extra: of
    each gram, about: of each gram's document, kept once a run."""
    frag = fragment_of(g, count)
    o = np.argsort(frag.astype(np.uint16) if count < 65536 else frag, kind="stable")
    frag, doc, g = frag[o], doc[o], g[o]
    new = np.ones(len(g), np.bool_)
    new[1:] = (frag[1:] != frag[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(g))).astype(np.uint32)
    used = np.unique(frag)
    edge = np.append(np.searchsorted(frag, used), len(g))
    runs = np.searchsorted(at, edge)
    body = g.astype(np.uint32) if low else g
    columns = [pa.array(used.astype(np.int32)), _binary(doc[at], runs), _binary(times, runs), _binary(body, edge)]
    names = ["frag", "docs", "times", "grams"]
    if extra is not None:
        columns.append(_binary(extra[o], edge))
        names.append("extra")
    if about is not None:
        columns.append(_binary(about[o[at]], runs))
        names.append("about")
    return pa.RecordBatch.from_arrays(columns, names)


def uncut(got: pa.Table, kind: str = "<u8") -> tuple[np.ndarray, np.ndarray]:
    """Documents and grams of a fragment's rows."""
    docs = np.frombuffer(column_bytes(got["docs"].combine_chunks())[0], "<i8")
    times = np.frombuffer(column_bytes(got["times"].combine_chunks())[0], "<u4")
    return np.repeat(docs, times), np.frombuffer(column_bytes(got["grams"].combine_chunks())[0], kind)


_BLOCKS = "frag int, docs binary, times binary, grams binary"


def _cut_texts(docs: DataFrame, n: int, count: int, low: bool) -> DataFrame:
    """Blocks of all texts' grams; low: of their low halves, and beside them (as fragments from ``count`` on) blocks of
    the documents' numbers of grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (part, words) in enumerate(sliced(batches)):
            g, row, _ = grams(words, n, short=True)
            if len(g):
                g, row = unique_rows(g, row)
                doc = part.column(0).to_numpy()
                yield cut(doc[row], g, count, low)
                if low:
                    own, size = np.unique(row, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([count + k % count], pa.int32()), *(_binary(x, np.array([0, len(x)])) for x in (doc[own], size.astype(np.uint32), np.zeros(0, np.uint32)))], ["frag", "docs", "times", "grams"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").mapInArrow(run, _BLOCKS)


def copies(docs: DataFrame) -> DataFrame:
    """doc_id and rep, the least id with the same texts, of every document with a word.  An id's distinct texts are
    summed up order-free, so that no id's rows meet in one place."""
    inked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("same"), F.col("text").rlike(INK).alias("inked"))
    inked = inked.filter("inked and doc_id is not null").select("doc_id", F.unhex("same").alias("same")).distinct()
    both = [F.expr(f"bit_xor(xxhash64(same, {k}))").alias(f"h{k}") for k in (0, 1)]
    inked = inked.groupBy("doc_id").agg(F.count("*").alias("texts"), *both)
    reps = inked.groupBy("texts", "h0", "h1").agg(F.min("doc_id").alias("rep"))
    return inked.join(reps, ["texts", "h0", "h1"]).select("doc_id", "rep")


def _shared(got: pa.Table, count: int) -> pa.Table:
    """Of each document in a fragment that has some, the number of grams which occur again; or documents' sizes."""
    if got["frag"][0].as_py() >= count:
        docs, sizes = (np.frombuffer(column_bytes(got[c].combine_chunks())[0], kind) for c, kind in (("docs", "<i8"), ("times", "<u4")))
        return pa.table({"doc_id": docs, "shared": np.zeros(len(docs), np.int32), "size": sizes.astype(np.int32)})
    doc, g = uncut(got, "<u4")
    o = np.argsort(g)
    s = g[o]
    twice = np.zeros(len(s), np.bool_)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= twice[1:]
    ids, many = np.unique(doc[o[twice]], return_counts=True)
    return pa.table({"doc_id": ids, "shared": many.astype(np.int32), "size": np.zeros(len(ids), np.int32)})


def survivors(docs: DataFrame, n: int, threshold: float, count: int) -> DataFrame:
    per = _cut_texts(docs, n, count, True).groupBy("frag").applyInArrow(lambda t: released(_shared(t, count)), "doc_id long, shared int, size int")
    total = per.groupBy("doc_id").agg(F.sum("shared").alias("shared"), F.sum("size").alias("size"))
    return total.filter((F.col("shared") > 0) & (F.col("shared") >= threshold * F.col("size") - 1e-6)).select("doc_id")


def _frequencies(got: pa.Table) -> pa.Table:
    """Per document: the fragment's grams that other documents have too, with frequencies, and the number of all."""
    doc, g = uncut(got)
    o = np.lexsort((doc, g))
    doc, g = doc[o], g[o]
    keep = np.ones(len(g), np.bool_)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    doc, g = doc[keep], g[keep]
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
    df = np.diff(np.append(at, len(g)))
    df = np.repeat(df, df).astype(np.uint32)
    o = np.argsort(doc, kind="stable")
    doc, g, df = doc[o], g[o], df[o]
    ids, first, size = np.unique(doc, return_index=True, return_counts=True)
    more = df > 1
    edges = np.append(0, np.cumsum(more))[np.append(first, len(g))]
    return pa.table([pa.array(ids), pa.array(size.astype(np.int32)), _binary(g[more], edges), _binary(df[more], edges)], ["doc_id", "size", "grams", "df"])


def _whole(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 62) -> Iterator[pa.Table]:
    """Tables holding all rows of each of their documents (their first column), from a stream ordered by it."""
    kept: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        ids = b.column(0).to_numpy()
        tail = int(np.searchsorted(ids, ids[-1]))
        if (rows > 20_000 or size > most_bytes) and tail:
            kept[-1] = b.slice(0, tail)
            yield pa.Table.from_batches(kept)
            kept, rows, size = [b.slice(tail)], b.num_rows - tail, b.slice(tail).nbytes
    if kept:
        yield pa.Table.from_batches(kept)


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-6).astype(np.int64) + 1


def _ordered(threshold: float):
    """Per document: all its shared grams in order of hash, those of its prefix and these ones' places in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            ids, back = np.unique(t["doc_id"].to_numpy(), return_inverse=True)
            size = np.bincount(back, t["size"].to_numpy()).astype(np.int64)
            raw, off = column_bytes(t["grams"].combine_chunks())
            g = np.frombuffer(raw, "<u8")
            df = np.frombuffer(column_bytes(t["df"].combine_chunks())[0], "<u4")
            row = np.repeat(back, np.diff(off) // 8)
            o = np.lexsort((g, df, row))
            g, df, row = g[o], df[o], row[o]
            n = np.bincount(row, minlength=len(ids))
            first = np.cumsum(n) - n
            rank = np.arange(len(g)) - first[row]
            head = prefix_length(size, threshold) - (size - n)
            inside = rank < head[row]
            by_hash = np.lexsort((g, row))
            edges = np.append(first, len(g))
            p = np.append(0, np.cumsum(inside))[edges]
            place = (rank + (size - n)[row])[inside].astype(np.uint32)  # grams of no other document come first
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size.astype(np.int32)), _binary(g[by_hash], edges), _binary(g[inside], p), _binary(place, p)], ["doc_id", "size", "grams", "prefix", "place"])

    return run


def _cut_prefixes(count: int):
    """Blocks of (doc_id, size, label, prefix, place) rows' prefix grams and their places; size and label go along with
    each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = column_bytes(b.column(3))
            g = np.frombuffer(raw, "<u8")
            if len(g):
                row = np.repeat(np.arange(b.num_rows), np.diff(off) // 8)
                about = np.empty(b.num_rows, _ABOUT)
                about["size"], about["label"] = b.column(1).to_numpy(), b.column(2).to_numpy()
                place = np.frombuffer(column_bytes(b.column(4))[0], "<u4")
                yield cut(b.column(0).to_numpy()[row], g, count, extra=place, about=about[row])

    return run


_ABOUT = np.dtype([("size", "<u4"), ("label", "<i8")])


def _candidates(threshold: float, part: str):
    """Pairs of a fragment's posting lists whose sizes and places allow the threshold: "all" of them, "first": those
    with the list's least document, "rest": the others, if their labels differ."""

    def run(got: pa.Table) -> pa.Table:
        doc, g = uncut(got)
        about = np.frombuffer(column_bytes(got["about"].combine_chunks())[0], _ABOUT)
        about = np.repeat(about, np.frombuffer(column_bytes(got["times"].combine_chunks())[0], "<u4"))
        place = np.frombuffer(column_bytes(got["extra"].combine_chunks())[0], "<u4")
        label = doc if part == "all" else about["label"]
        o = np.lexsort((doc, g) if part == "first" else (doc, label, g))
        doc, g, label = doc[o], g[o], label[o]
        size = about["size"][o].astype(np.int64)
        left = size - place[o]  # grams from this one on: no more can be shared if it is the first one shared
        ids, code = np.unique(doc, return_inverse=True)
        at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
        times = np.diff(np.append(at, len(g)))
        found: list[np.ndarray] = []
        waiting = 0

        def meet(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal waiting
            fit = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-6
            fit &= np.minimum(left[i], left[j]) * (1 + threshold) >= threshold * (size[i] + size[j]) - 1e-6
            x, y = code[i[fit]].astype(np.int64), code[j[fit]].astype(np.int64)
            found.append((np.minimum(x, y) << 32) | np.maximum(x, y))
            waiting += len(x)
            if waiting > PAIRS_AT_ONCE:
                found[:] = [np.unique(np.concatenate(found))]
                waiting = 0

        if part == "first":
            i, j = np.repeat(at, times), np.arange(len(g))
            meet(i[i < j], j[i < j])
        elif len(g):
            # sorted by label: a row meets those of its list after its label's run
            stop = np.repeat(at + times, times)
            new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (label[1:] != label[:-1])))
            begin = np.repeat(np.append(new[1:], len(g)), np.diff(np.append(new, len(g))))
            if part == "rest":
                other = doc > np.repeat(np.minimum.reduceat(doc, at), times)
            else:
                other = np.ones(len(g), np.bool_)
            rows = np.flatnonzero((stop > begin) & other)
            many = (stop - begin)[rows]
            ends = np.cumsum(many)
            k = 0
            while k < len(rows):
                to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS_AT_ONCE)))
                m = many[k:to]
                i = np.repeat(rows[k:to], m)
                j = np.arange(len(i)) + np.repeat(begin[rows[k:to]] - (np.cumsum(m) - m), m)
                meet(i[other[j]], j[other[j]])
                k = to
        p = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        a, b = ids[p >> 32] if len(p) else ids[:0], ids[p & 0xFFFFFFFF] if len(p) else ids[:0]
        apart = a != b
        return pa.table({"a": a[apart].astype(np.int64), "b": b[apart].astype(np.int64)})

    return lambda t: released(run(t))


def _overlaps(left: pa.Table, right: pa.Table) -> pa.Table:
    """Partial overlaps of the cell's pairs (right) over its segments (left)."""
    seg = left["doc_id"].to_numpy()
    raw, off = column_bytes(left["grams"].combine_chunks()) if left.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    names, one = np.unique(seg, return_index=True)
    g, code = np.unique(np.frombuffer(raw, "<u8"), return_inverse=True)
    lo, n = off[:-1] // 8, np.diff(off) // 8
    rank = np.searchsorted(names, seg)
    key = np.sort((rank.repeat(n).astype(np.int64) << 32) | code)
    lo, n = lo[one], n[one]
    pa_, pb = right["a"].to_numpy(), right["b"].to_numpy()
    a, b = np.searchsorted(names, pa_), np.searchsorted(names, pb)
    has = (a < len(names)) & (b < len(names))
    has[has] = (names[a[has]] == pa_[has]) & (names[b[has]] == pb[has])
    pa_, pb, a, b = pa_[has], pb[has], a[has], b[has]
    out = np.zeros(len(a), np.int32)
    swap = n[a] > n[b]  # walk the shorter segment
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    ends = np.cumsum(n[a])
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000)))
        m = n[a[at:to]]
        total = int(m.sum())
        if total:
            walk = np.arange(total) + np.repeat(lo[a[at:to]] - (np.cumsum(m) - m), m)
            want = (np.repeat(b[at:to], m).astype(np.int64) << 32) | code[walk]
            spot = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[spot] == want
            out[at:to] = np.bincount(np.repeat(np.arange(to - at), m)[hit], minlength=to - at)
        at = to
    some = out > 0
    return pa.table({"a": pa_[some], "b": pb[some], "overlap": out[some]})


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, doc_id, grams -> a row per vertical fragment."""
    for b in batches:
        raw, off = column_bytes(b.column(2))
        g = np.frombuffer(raw, "<u8")
        rows = b.num_rows
        row = np.repeat(np.arange(rows), np.diff(off) // 8)
        slot = row * VERTICAL + fragment_of(g, VERTICAL)  # ascending: a document's grams are in order of hash
        n = np.bincount(slot, minlength=rows * VERTICAL)
        edges = np.append(0, np.cumsum(n))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(b.column(0).to_numpy(), VERTICAL)), pa.array(np.tile(np.arange(VERTICAL, dtype=np.int32), rows)), pa.array(np.repeat(b.column(1).to_numpy(), VERTICAL)), _binary(g, edges)],
            ["cell", "part", "doc_id", "grams"],
        )


def _gram_sets(docs: DataFrame, links: DataFrame, n: int, threshold: float, count: int) -> DataFrame:
    """doc_id, size, all shared grams, the prefix and its places of every class that may be in a pair."""
    alive = materialise(survivors(docs, n, threshold, count).join(links.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi"), "survivors")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(alive), "doc_id", "left_semi")
    known = _cut_texts(texts, n, count, False).groupBy("frag").applyInArrow(lambda t: released(_frequencies(t)), "doc_id long, size int, grams binary, df binary")
    sets = known.repartition(count, "doc_id").sortWithinPartitions("doc_id").mapInArrow(_ordered(threshold), "doc_id long, size int, grams binary, prefix binary, place binary")
    return materialise(sets, "sets")


def _found(sets: DataFrame, threshold: float, count: int, part: str = "all", labels: DataFrame | None = None) -> DataFrame:
    """a < b: candidates of the sets' prefixes (see ``_candidates``); labels: doc_id, root."""
    labelled = sets.select("doc_id", "size", F.col("doc_id").alias("label"), "prefix", "place")
    if labels is not None:
        labelled = sets.join(small(labels), "doc_id", "left").select("doc_id", "size", F.coalesce("root", "doc_id").alias("label"), "prefix", "place")
    cuts = labelled.mapInArrow(_cut_prefixes(count), _BLOCKS + ", extra binary, about binary")
    return materialise(cuts.groupBy("frag").applyInArrow(_candidates(threshold, part), "a long, b long").distinct(), "candidates")


def _similar(sets: DataFrame, pairs: DataFrame, threshold: float, count: int) -> DataFrame:
    """doc_a, doc_b and jaccard of the candidates that reach the threshold."""
    # a group's documents nearly always have the same least partner: their pairs are counted in its cell
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    root = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")), "roots")
    placed = pairs.join(root.withColumnRenamed("root", "ra"), "a").join(root.select(F.col("a").alias("b"), F.col("root").alias("rb")), "b")
    placed = materialise(placed.select("a", "b", F.when(F.col("ra") == F.col("rb"), F.col("ra")).otherwise(F.col("a")).alias("at")), "placed")
    cell = F.pmod(F.xxhash64("at"), F.lit(count)).cast("int").alias("cell")
    needs = placed.select(cell, F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    segments = needs.join(sets.select("doc_id", "grams"), "doc_id").select("cell", "doc_id", "grams").mapInArrow(_segments, "cell int, part int, doc_id long, grams binary")
    split = placed.select(cell, F.explode(F.sequence(F.lit(0), F.lit(VERTICAL - 1))).alias("part"), "a", "b")
    partial = segments.groupBy("cell", "part").cogroup(split.groupBy("cell", "part")).applyInArrow(lambda l, r: released(_overlaps(l, r)), "a long, b long, overlap int")
    summed = partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    size = sets.select("doc_id", "size")
    full = summed.join(size.select(F.col("doc_id").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("doc_id").alias("b"), F.col("size").alias("sb")), "b")
    jaccard = F.col("overlap").cast("double") / (F.col("sa") + F.col("sb") - F.col("overlap"))
    return full.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold - 1e-12)


def similar_pairs(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """doc_a < doc_b, jaccard and copy: all pairs of classes (by their least ids; copy is false), and every further
    member of a class with its least id (copy is true).  All pairs of documents follow from these."""
    count = fragments(docs.sparkSession, docs)
    links = materialise(copies(docs), "copies")
    sets = _gram_sets(docs, links, n, threshold, count)
    near = _similar(sets, _found(sets, threshold, count), threshold, count).withColumn("copy", F.lit(False))
    same = links.filter("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"), F.lit(True).alias("copy"))
    return near.unionByName(same)


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """doc_id and root, the least id its pairs lead to, of every document in a pair.  Least labels and pointer
    jumping: rounds grow with the logarithm of a group's diameter; each round's table is written."""
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = materialise(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = materialise(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")), "labels")
    while True:
        heard = edges.join(label.select(F.col("u").alias("v"), F.col("root").alias("theirs")), "v").groupBy("u").agg(F.min("theirs").alias("theirs"))
        spread = label.join(heard, "u").select("u", "root", F.least("root", "theirs").alias("next"))
        jump = label.select(F.col("u").alias("next"), F.col("root").alias("further"))
        moved = spread.join(jump, "next", "left").select("u", "root", F.least("next", F.coalesce("further", "next")).alias("next"))
        moved = materialise(moved, "labels")
        if moved.filter("root <> next").isEmpty():
            return moved.select(F.col("u").alias("doc_id"), "root")
        label = moved.select("u", F.col("next").alias("root"))


def _edges(sets: DataFrame, threshold: float, count: int) -> DataFrame:
    """doc_a and doc_b: similar pairs of classes that lead to all that their other pairs lead to."""
    first = materialise(_similar(sets, _found(sets, threshold, count, "first"), threshold, count).select("doc_a", "doc_b"), "first")
    joined = materialise(components(first), "joined")
    rest = _similar(sets, _found(sets, threshold, count, "rest", joined), threshold, count).select("doc_a", "doc_b")
    # a group so far is a star about its root: rounds don't grow with its diameter again
    return joined.filter("doc_id <> root").select(F.col("root").alias("doc_a"), F.col("doc_id").alias("doc_b")).unionByName(rest)


def _overlap_matrix(row: np.ndarray, g: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of shared grams of the documents left x right; row: the document (of ``left`` or ``right``) of each gram."""
    rows = int(max(left.max(), right.max())) + 1
    o = np.argsort(g, kind="stable")
    row, g = row[o], g[o]
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
    df = np.diff(np.append(at, len(g)))
    found = np.zeros((len(left), len(right)), np.float32)
    often = df >= max(2, rows / RARE)
    column = np.where(often, np.cumsum(often) - 1, -1)
    which = np.repeat(column, df)
    edge = np.searchsorted(which[which >= 0], np.arange(0, int(often.sum()) + GRAMS_AT_ONCE, GRAMS_AT_ONCE))
    r, c = row[which >= 0], which[which >= 0]
    for k, (lo, hi) in enumerate(zip(edge[:-1], edge[1:])):
        one = np.zeros((rows, min(GRAMS_AT_ONCE, int(often.sum()) - k * GRAMS_AT_ONCE)), np.float32)
        one[r[lo:hi], c[lo:hi] - k * GRAMS_AT_ONCE] = 1
        found += one[left] @ one[right].T
    # grams of few documents: each of the left with each of the right
    x_of, y_of = np.full(rows, -1), np.full(rows, -1)
    x_of[left], y_of[right] = np.arange(len(left)), np.arange(len(right))
    few = np.repeat((df > 1) & ~often, df)
    r, c = row[few], np.repeat(np.arange(len(df)), df)[few]
    x, xc, y, yc = x_of[r][x_of[r] >= 0], c[x_of[r] >= 0], y_of[r][y_of[r] >= 0], c[y_of[r] >= 0]
    begin = np.searchsorted(yc, xc)
    many = np.searchsorted(yc, xc, "right") - begin
    ends = np.cumsum(many)
    k = 0
    while k < len(x):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + 4 * PAIRS_AT_ONCE)))
        m = many[k:to]
        i = np.repeat(x[k:to].astype(np.int64), m)
        j = y[np.arange(len(i)) + np.repeat(begin[k:to] - (np.cumsum(m) - m), m)]
        found += np.bincount(i * len(right) + j, minlength=found.size).reshape(found.shape)
        k = to
    return found


def cell_links(side: np.ndarray, own: bool, row: np.ndarray, g: np.ndarray, size: np.ndarray, members: np.ndarray, threshold: float) -> np.ndarray:
    """Of each document of a cell the members of all it is similar to on the other side (own: of all others)."""
    left, right = (np.arange(len(side)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    total = np.zeros(len(side))
    if not (len(left) and len(right)):
        return total.astype(np.int64)
    overlap = _overlap_matrix(row, g, left, right)
    if own:
        np.fill_diagonal(overlap, 0)
    weight = members.astype(float)
    for s in range(0, len(left), 256):
        some = left[s : s + 256]
        shared = overlap[s : s + 256].astype(float)
        hit = (shared / (size[some][:, None] + size[right][None, :] - shared) >= threshold - 1e-12).astype(float)
        total[some] += hit @ weight[right]
        if not own:
            total[right] += weight[some] @ hit
    return total.astype(np.int64)


def _links(threshold: float):
    """cell, side, own, doc_id, size, members, grams in order of cell -> doc_id, others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, 32 << 20):
            cell, side, own, ids, size, members = (t[c].to_numpy() for c in ("cell", "side", "own", "doc_id", "size", "members"))
            raw, off = column_bytes(t["grams"].combine_chunks())
            g, off = np.frombuffer(raw, "<u8"), off // 8
            at = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
            others = np.zeros(len(cell), np.int64)
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                row = np.repeat(np.arange(e - s), np.diff(off[s : e + 1]))
                others[s:e] = cell_links(side[s:e], bool(own[s]), row, g[off[s] : off[e]], size[s:e].astype(np.int64), members[s:e], threshold)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others)], ["doc_id", "others"])
        release()

    return run


def _others(sets: DataFrame, joined: DataFrame, members: DataFrame, threshold: float, count: int) -> DataFrame:
    """rep and others, the number of documents of all classes in a pair with it, of the classes of all groups."""
    placed = materialise(joined.join(members.withColumnRenamed("rep", "doc_id"), "doc_id").join(sets.select("doc_id", "size"), "doc_id"), "placed")
    need = F.greatest(F.ceil(F.count("*") / PART_DOCS), F.ceil(F.sum("size") / PART_GRAMS)).cast("int")
    parts = materialise(placed.groupBy("root").agg(need.alias("parts")), "parts")
    placed = materialise(placed.drop("size").join(small(parts), "root").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts").cast("long")).cast("int")), "parted")
    # each two parts of a group meet in a cell, each part's own pairs are in one
    held = sets.select("doc_id", "size", "grams").join(small(placed), "doc_id").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("root", F.least("part", "with"), F.greatest("part", "with")).alias("cell")
    held = held.select(cell, (F.col("part") > F.col("with")).cast("int").alias("side"), (F.col("part") == F.col("with")).cast("int").alias("own"), "doc_id", "size", "members", "grams")
    found = held.repartition(count, "cell").sortWithinPartitions("cell").mapInArrow(_links(threshold), "doc_id long, others long")
    return found.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("others").alias("others"))


def linked(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document id: class_id, the least id that its pairs lead to (its own if it has none), copies, the
    number of other documents with the same texts, and links, that of all others in a pair with it, copies included."""
    count = fragments(docs.sparkSession, docs)
    links = materialise(copies(docs), "copies")
    sets = _gram_sets(docs, links, n, threshold, count)
    joined = materialise(components(_edges(sets, threshold, count)), "groups")
    size = links.groupBy("rep").agg(F.count("*").alias("members"))
    others = _others(sets, joined, size, threshold, count)
    of_class = size.join(others, "rep", "left").join(joined.withColumnRenamed("doc_id", "rep"), "rep", "left")
    held = links.join(of_class, "rep").select("doc_id", F.coalesce("root", "rep").alias("class_id"), (F.col("members") - 1).alias("copies"), (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    zero = F.lit(0).cast("long")
    return ids.join(held, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", zero).alias("copies"), F.coalesce("links", zero).alias("links"))


def groups(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and root, the least id that pairs lead to, of every document that has a copy or a near copy."""
    count = fragments(docs.sparkSession, docs)
    links = materialise(copies(docs), "copies")
    sets = _gram_sets(docs, links, n, threshold, count)
    same = links.filter("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"))
    return components(_edges(sets, threshold, count).unionByName(same))


def one_of_each(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that have a near duplicate of lesser id in their group; rows of null id all stay, and all
    rows of an id that stays."""
    name = free_name(docs, "lost_id")
    lost = materialise(groups(docs, n, threshold).filter("doc_id <> root").select(F.col("doc_id").alias(name)), "lost")
    return docs.join(small(lost), docs["doc_id"] == F.col(name), "left_anti")


SQL = """
WITH RECURSIVE t AS (SELECT doc_id, list_sort(list(DISTINCT text)) AS texts FROM documents
           WHERE doc_id IS NOT NULL AND regexp_matches(text, '[^ \\t\\n\\v\\f\\r]') GROUP BY doc_id),
d AS (SELECT min(doc_id) AS rep, texts, list(doc_id) AS ids FROM t GROUP BY texts),
x AS (SELECT rep, list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda y: y <> '') AS w
      FROM (SELECT rep, unnest(texts) AS text FROM d)),
g AS (
  SELECT DISTINCT rep, unnest(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    ELSE [array_to_string(w, ' ')] END) AS gram FROM x),
s AS (SELECT rep, count(*) AS size FROM g GROUP BY rep),
o AS (SELECT a.rep AS doc_a, b.rep AS doc_b, count(*) AS overlap FROM g a JOIN g b ON a.gram = b.gram AND a.rep < b.rep GROUP BY ALL),
j AS (SELECT doc_a, doc_b, overlap::DOUBLE / (x.size + y.size - overlap) AS jaccard
      FROM o JOIN s x ON x.rep = doc_a JOIN s y ON y.rep = doc_b),
p AS (SELECT doc_a, doc_b FROM j WHERE jaccard >= 0.5),
e AS (SELECT doc_a, doc_b FROM p UNION ALL SELECT doc_b, doc_a FROM p),
r AS (SELECT rep, rep AS to_id FROM d UNION SELECT r.rep, e.doc_b FROM r JOIN e ON e.doc_a = r.to_id),
c AS (SELECT rep, min(to_id) AS class_id FROM r GROUP BY rep),
l AS (SELECT doc_a AS rep, sum(len(ids)) AS others FROM e JOIN d ON d.rep = doc_b GROUP BY doc_a),
m AS (SELECT unnest(ids) AS doc_id, class_id, len(ids) - 1 AS copies, len(ids) - 1 + coalesce(others, 0) AS links FROM d JOIN c USING (rep) LEFT JOIN l USING (rep))
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(copies, 0)::BIGINT AS copies, coalesce(links, 0)::BIGINT AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN m USING (doc_id)
"""
