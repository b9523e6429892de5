"""Toxicity: a convolutional text classifier trained and applied in numpy.

Words (lower case, no punctuation) are hashed to two rows of an embedding table, which are added.  Filters of one, two and three words
slide over a text, each keeps its greatest activation (ReLU, max pooling), and a logistic layer gives a probability.
Embeddings start from each row's shrunken class log-odds in one dimension and small noise in the others, so pooling
looks at telling words from the first step; all weights are then trained with Adam, gradients following the pooled
positions.  All labelled rows take part.  Three of four are trained on, in shards by hash of the id: each shard's task
streams its rows through a copy of the weights, and after each pass the copies' changes are averaged (of an embedding over
the shards that changed it), as whole numbers, so that their order doesn't matter.  Driver and tasks hold weights and counts
by table row, never the labelled texts.  Thresholds come from the fourth row: per language the one of best F1; a language
with too few labels, or whose best F1 is under ``TRUST``, has the common threshold, fitted on all languages but those
under ``TRUST``.

Defined results: a null, empty or blank text has no words, pools to zeros and is never toxic; a null or unknown
language has the common threshold; equal texts score equally (to six places); rows are scored one by one, so repeated ids are too;
a very long text is pooled whole; of equal scores in training any threshold has all or none; an empty table gives an
empty table; other columns, whatever their names, are not read.  Without labelled rows of both classes ``fit`` gives
the network of zeros, by which nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small
from .decontaminate import plain
from .textkernel import Words, sliced

BITS = 18
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
TRUST = 0.6
ROWS_AT_ONCE = 100_000
EPOCHS = 3
#: labelled rows a shard, and how many shards there are at most; more rows make longer shards
SHARD_ROWS = 8_000
SHARDS_MOST = 64
SHUFFLED_AT_ONCE = 2_048
UNIT = float(1 << 30)


def buckets(words: Words) -> np.ndarray:
    """Two table rows a word, of independent bits of its hash: words rarely share both."""
    return np.stack([words.hash >> np.uint64(64 - BITS), words.hash & np.uint64((1 << BITS) - 1)], 1).astype(np.int32)


@dataclass
class Network:
    table: np.ndarray  # 2^BITS x DIM
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Greatest activations, documents x all filters, of texts whose words are first[r]:first[r + 1] of b."""
        rows = len(first) - 1
        result = np.zeros((rows, FILTERS * len(WIDTHS)), np.float32)
        at = 0
        while at < rows:
            to = min(rows, max(at + 1, int(np.searchsorted(first, first[at] + ROWS_AT_ONCE, "right")) - 1))
            lo, hi = int(first[at]), int(first[to])
            if hi > lo:
                e = self.table[b[lo:hi, 0]] + self.table[b[lo:hi, 1]]
                begin = first[at:to] - lo
                n = np.diff(first[at : to + 1])
                some = np.flatnonzero(n)
                left = np.repeat(begin + n, n) - np.arange(hi - lo)  # words to the end of the text
                for k, width in enumerate(WIDTHS):
                    if hi - lo < width:
                        continue
                    size = hi - lo - width + 1
                    act = np.zeros((hi - lo, FILTERS), np.float32)
                    for j in range(width):
                        act[:size] += e[j : size + j] @ self.filters[k][j]
                    act += self.bias[k]
                    np.maximum(act, 0, out=act)
                    if width > 1:
                        act[left < width] = 0
                    result[at + some, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(act, begin[some], axis=0)
            at = to
        return result

    def score(self, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probabilities to six places: sums of single floats may differ beyond that by a text's place in its slice."""
        return np.round(1 / (1 + np.exp(-(self.pooled(b, first) @ self.out + self.out_bias[0]).astype(float))), 6)


def _start(with_word: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> Network:
    """with_word: by class and table row, documents that have it; rows: documents by class."""
    size = 1 << BITS
    share = (with_word + 0.5) / (rows[:, None] + 1)
    seen = with_word.sum(0)
    odds = np.log(share[1] / share[0]) * seen / (seen + 20)
    table = (rng.normal(0, 0.05, (size, DIM)) * (seen > 2)[:, None]).astype(np.float32)
    table[:, 0] = np.clip(odds, -3, 3) / 2
    filters = [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.5
    return Network(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), np.zeros(1, np.float32))


def blank() -> Network:
    """All zeros: every text has the score one half."""
    size = FILTERS * len(WIDTHS)
    return Network(np.zeros((1 << BITS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(size, np.float32), np.zeros(1, np.float32))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, name: str, w: np.ndarray, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        if name not in self.state:
            self.state[name] = (np.zeros_like(w), np.zeros_like(w))
        m, v = self.state[name]
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.999 * v[at] + 0.001 * g * g
        w[at] -= self.rate * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.999**self.t)) + 1e-7)


def gradients(net: Network, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted mean logistic loss of a batch of texts (a word or more each), by name of the weight;
    of the table, those of the touched ``rows``."""
    b = np.concatenate(docs)
    n = np.array([len(d) for d in docs])
    first = np.append(0, np.cumsum(n))
    left = np.repeat(first[1:], n) - np.arange(len(b))
    e = net.table[b[:, 0]] + net.table[b[:, 1]]
    best = np.zeros((len(docs), FILTERS * len(WIDTHS)), e.dtype)
    where = np.zeros(best.shape, np.int64)
    for k, width in enumerate(WIDTHS):
        size = len(b) - width + 1
        act = np.full((len(b), FILTERS), -np.inf, e.dtype)
        if size > 0:
            act[:size] = net.bias[k]
            for j in range(width):
                act[:size] += e[j : size + j] @ net.filters[k][j]
        act[left < width] = -np.inf
        for r in range(len(docs)):
            own = act[first[r] : first[r + 1]]
            i = own.argmax(0)
            where[r, k * FILTERS : (k + 1) * FILTERS] = first[r] + i
            best[r, k * FILTERS : (k + 1) * FILTERS] = own[i, np.arange(FILTERS)]
    h = np.maximum(best, 0)
    p = 1 / (1 + np.exp(-(h @ net.out + net.out_bias[0])))
    d = ((p - y) * weight / len(docs)).astype(e.dtype)
    dh = np.outer(d, net.out) * (best > 0)
    found = {"out": h.T @ d, "out_bias": d.sum(keepdims=True)}
    rows, grads = [], []
    for k, width in enumerate(WIDTHS):
        g = dh[:, k * FILTERS : (k + 1) * FILTERS]
        at = where[:, k * FILTERS : (k + 1) * FILTERS]
        df = np.zeros_like(net.filters[k])
        for j in range(width):
            spot = np.minimum(at + j, len(b) - 1)
            df[j] = np.einsum("rfd,rf->df", e[spot], g)
            own = (g[:, :, None] * net.filters[k][j].T[None]).reshape(-1, DIM)
            for side in (0, 1):
                rows.append(b[spot, side].ravel())
                grads.append(own)
        found[f"f{k}"], found[f"b{k}"] = df, g.sum(0)
    rows, grads = np.concatenate(rows), np.concatenate(grads)
    live = np.abs(grads).sum(1) > 0
    found["rows"], back = np.unique(rows[live], return_inverse=True)
    found["table"] = np.zeros((len(found["rows"]), DIM), e.dtype)
    np.add.at(found["table"], back, grads[live])
    return found


def train(net: Network, adam: _Adam, docs: list[np.ndarray], y: np.ndarray, toxic_weight: float, rng: np.random.Generator, batch: int = 64) -> None:
    """One pass over the texts, in random order; changes net."""
    weight = np.where(y == 1, toxic_weight, 1.0)
    order = rng.permutation(len(docs))
    for s in range(0, len(order), batch):
        pick = order[s : s + batch]
        pick = pick[[len(docs[i]) > 0 for i in pick]]
        if not len(pick):
            continue
        adam.t += 1
        g = gradients(net, [docs[i] for i in pick], y[pick], weight[pick])
        adam.step("out", net.out, g["out"] + 1e-4 * net.out)
        adam.step("out_bias", net.out_bias, g["out_bias"])
        for k in range(len(WIDTHS)):
            adam.step(f"f{k}", net.filters[k], g[f"f{k}"] + 1e-4 * net.filters[k])
            adam.step(f"b{k}", net.bias[k], g[f"b{k}"])
        if len(g["rows"]):
            adam.step("table", net.table, g["table"] + 1e-4 * net.table[g["rows"]], g["rows"])


def best_threshold(p: np.ndarray, hits: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Threshold of greatest F1 (the middle of the gap below it) and that F1.  p: distinct scores, with their numbers of
    toxic rows and of all rows; a threshold can't part equal scores."""
    if not len(p) or not hits.sum():
        return 2.0, 0.0
    o = np.argsort(-p)
    p, hit = p[o], np.cumsum(hits[o])
    f1 = 2 * hit / (np.cumsum(n[o]) + hit[-1])
    k = int(f1.argmax())
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2), float(f1[k])


@dataclass
class Classifier:
    net: Network
    common: float
    by_language: dict[str, float]

    def threshold(self, lang: str | None) -> float:
        return self.by_language.get(lang, self.common) if lang is not None else self.common


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, raw in sliced(batches):
        w = plain(raw)
        lists = pa.ListArray.from_arrays(pa.array((2 * w.first).astype(np.int32)), pa.array(buckets(w).ravel()))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], ["doc_id", "y", "lang", "b"])


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """shard, held, y, lang and b (the words' table rows) of every labelled id, in order of shard: one of an id's texts,
    the least, however often it is repeated.  A file has whole shards."""
    named = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    named = materialise(named, "labels")
    shards = min(SHARDS_MOST, max(1, -(-named.count() // SHARD_ROWS)))
    found = docs.select("doc_id", "lang", "text").join(small(named), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "y", F.col("lang").cast("string").alias("lang"), "text")
    placed = found.mapInArrow(_bucketed, "doc_id long, y int, lang string, b array<int>").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")).withColumn("at", F.xxhash64("doc_id"))
    each = placed.repartition(shards, "shard").groupBy("shard", "at", "doc_id").agg(F.min(F.struct("b", "lang", "y")).alias("s")).sortWithinPartitions("shard", "at", "doc_id")
    return materialise(each.select("shard", (F.pmod("at", F.lit(4)) == 0).alias("held"), "s.y", "s.lang", "s.b"), "labelled")


def _texts(b: pa.Array) -> list[np.ndarray]:
    off, flat = b.offsets.to_numpy(), b.values.to_numpy()
    return [flat[x:y].reshape(-1, 2) for x, y in zip(off[:-1], off[1:])]


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """y, b -> of each table row (and, as -1, of all) the documents by class."""
    found = np.zeros((2, 1 << BITS), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        for y, d in zip((batch.column(0).to_numpy() == 1).astype(int), _texts(batch.column(1))):
            found[y, np.unique(d)] += 1
            rows[y] += 1
    some = np.flatnonzero(found.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), *(pa.array(np.append(found[y, some], rows[y])) for y in (0, 1))], ["k", "n0", "n1"])


def _parts(net: Network) -> list[np.ndarray]:
    return [net.out, net.out_bias, *net.filters, *net.bias]


def _changes(net: Network, start: Network) -> pa.RecordBatch:
    """Rows of DIM whole numbers: by k of the table, and below zero of all other weights."""
    rows = np.flatnonzero((net.table != start.table).any(1))
    rest = np.concatenate([(x.astype(float) - y).ravel() for x, y in zip(_parts(net), _parts(start))])
    rest = np.append(rest, np.zeros(-len(rest) % DIM)).reshape(-1, DIM)
    k = np.concatenate([rows, -1 - np.arange(len(rest))]).astype(np.int32)
    moved = np.rint(np.concatenate([net.table[rows].astype(float) - start.table[rows], rest]) * UNIT).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(k), *(pa.array(np.ascontiguousarray(moved[:, j])) for j in range(DIM))], ["k", *(f"c{j}" for j in range(DIM))])


def _pass(rows: DataFrame, net: Network, toxic_weight: float, epoch: int) -> Network:
    """net after a pass over all rows: the mean of what its copies became, one for each shard."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, own, now = shared.value, None, None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else []
            for s, e in zip(edges[:-1], edges[1:]):
                if shard[s] != now:
                    if own is not None:
                        yield _changes(own, start)
                    own, now, adam = deepcopy(start), shard[s], _Adam(0.01)
                    rng = np.random.default_rng([7, epoch, int(now)])
                for lo in range(int(s), int(e), SHUFFLED_AT_ONCE):
                    part = batch.slice(lo, min(SHUFFLED_AT_ONCE, int(e) - lo))
                    train(own, adam, _texts(part.column(2)), (part.column(1).to_numpy() == 1).astype(np.int64), toxic_weight, rng)
        if own is not None:
            yield _changes(own, start)

    moved = rows.select("shard", "y", "b").mapInArrow(run, "k int, " + ", ".join(f"c{j} long" for j in range(DIM)))
    got = moved.groupBy("k").agg(F.count("*").alias("copies"), *(F.sum(f"c{j}").alias(f"c{j}") for j in range(DIM))).toArrow()
    shared.unpersist()
    k = got["k"].to_numpy()
    mean = np.stack([got[f"c{j}"].to_numpy() for j in range(DIM)], 1) / UNIT / got["copies"].to_numpy()[:, None]
    new = deepcopy(net)
    new.table[k[k >= 0]] += mean[k >= 0].astype(np.float32)
    rest = mean[k < 0][np.argsort(-k[k < 0])].ravel()
    at = 0
    for w in _parts(new):
        w += rest[at : at + w.size].reshape(w.shape).astype(np.float32)
        at += w.size
    return new


def _calibrated(held: DataFrame, net: Network, least: int = 20) -> Classifier:
    """Thresholds by all held rows; what is gathered are counts by score, of which there are at most a million and one."""
    shared = held.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SHUFFLED_AT_ONCE):
                part = batch.slice(lo, SHUFFLED_AT_ONCE)
                texts = _texts(part.column(2))
                p = shared.value.score(np.concatenate(texts), np.append(0, np.cumsum([len(d) for d in texts])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p)], ["lang", "y", "p"])

    def of_language(t: pa.Table) -> pa.Table:
        cut, f1 = best_threshold(*(t[c].to_numpy() for c in ("p", "hits", "n")))
        return pa.table({"lang": t["lang"][:1], "cut": [cut], "f1": [f1], "hits": [int(t["hits"].to_numpy().sum())]})

    scored = held.select("lang", "y", "b").mapInArrow(run, "lang string, y int, p double")
    counts = materialise(scored.groupBy("lang", "p").agg(F.count_if(F.col("y") == 1).alias("hits"), F.count("*").alias("n")), "held")
    by = counts.filter("lang is not null").groupBy("lang").applyInArrow(of_language, "lang string, cut double, f1 double, hits long").filter(F.col("hits") >= least).collect()
    poor = [r["lang"] for r in by if r["f1"] < TRUST]

    def common(rows: DataFrame) -> tuple[float, float]:
        got = rows.groupBy("p").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).toArrow()
        return best_threshold(*(got[c].to_numpy() for c in ("p", "hits", "n")))

    cut, f1 = common(counts.filter(F.col("lang").isNull() | ~F.col("lang").isin(poor)) if poor else counts)
    if poor and not f1:
        cut, _ = common(counts)
    return Classifier(net, cut, {r["lang"]: r["cut"] for r in by if r["f1"] >= TRUST})


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Train on all labelled documents but every fourth (by hash of the id), which calibrate."""
    rows = _labelled(docs, labels)
    fitted = rows.filter("not held")
    got = fitted.select("y", "b").mapInArrow(_with_words, "k int, n0 long, n1 long").groupBy("k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    k, n = got["k"].to_numpy(), np.stack([got["n0"].to_numpy(), got["n1"].to_numpy()])
    of_class = n[:, k < 0].sum(1)
    if not of_class.all():
        return Classifier(blank(), 2.0, {})
    with_word = np.zeros((2, 1 << BITS))
    with_word[:, k[k >= 0]] = n[:, k >= 0]
    net = _start(with_word, of_class, np.random.default_rng(7))
    for epoch in range(EPOCHS):
        net = _pass(fitted, net, min(5.0, of_class[0] / of_class[1]), epoch)
    return _calibrated(rows.filter("held"), net)


def classify(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, lang, score, threshold and toxic of every row: one pass, no shuffle.  The model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in sliced(batches):
            w = plain(raw)
            score = shared.value.net.score(buckets(w), w.first)
            cut = np.array([shared.value.threshold(x) for x in part.column(1).to_pylist()])
            toxic = (score >= cut) & (w.count > 0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array(cut), pa.array(toxic)], ["doc_id", "lang", "score", "threshold", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "doc_id long, lang string, score double, threshold double, toxic boolean")
