"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Sixteen statistics of a text are transformed (logs of counts, logits of shares) so that each class is near a
Gaussian.  Class covariances are shrunk towards the pooled covariance and a ridge; a document's score is the
difference of the two classes' log-densities, from Mahalanobis distances by cached Cholesky factors.

Defined results: a null text counts as empty; empty and blank texts get the statistics of a text without words
and are scored like any other; rows with a null id are scored too; equal texts get equal scores; a very long text is
measured whole; a score equal to the threshold is kept; an empty table gives an empty table; other columns pass through
untouched, whatever their names.  Without labelled rows of both classes (an empty table of labels or documents) there
is nothing to tell them apart by: ``fit`` gives the model that scores 0 and keeps every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import Words, sliced

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_spread", "upper", "digit", "symbol", "stop", "newline",
    "wide", "distinct", "top_word", "again", "shouted", "marked", "long_word",
)

_KIND = np.zeros((256, 6), np.float32)  # upper, digit, symbol, stop, newline, beyond ASCII
_KIND[65:91, 0] = 1
_KIND[48:58, 1] = 1
for _c in b"#$%&*|!<>{}[]~^_=+\\/@`":
    _KIND[_c, 2] = 1
for _c in b".,;:?'\"()-":
    _KIND[_c, 3] = 1
_KIND[10, 4] = 1
_KIND[128:, 5] = 1
_FLAG = np.zeros(256, np.uint8)
for _i in range(6):
    _FLAG[_KIND[:, _i] > 0] = _i + 1


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    p = (part + 0.5) / (whole + 1.0)
    return np.log(p) - np.log1p(-np.minimum(p, 1 - 1e-9))


def statistics(words: Words) -> np.ndarray:
    """Transformed statistics, one row a text."""
    rows = len(words.offsets) - 1
    size = np.diff(words.offsets).astype(float)
    count = words.count.astype(float)
    out = np.zeros((rows, len(STATISTICS)))
    flag = _FLAG[words.data]
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(words.offsets))
    kinds = np.bincount(owner * 7 + flag, minlength=rows * 7).reshape(rows, 7)[:, 1:]
    length = (words.end - words.start).astype(float)
    row = words.row
    some = np.maximum(count, 1)
    mean = np.bincount(row, length, rows) / some
    spread = np.sqrt(np.maximum(np.bincount(row, length * length, rows) / some - mean * mean, 0))
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(spread)
    for i in range(6):
        out[:, 4 + i] = _logit(kinds[:, i], size)
    h = words.hash
    o = np.argsort(h, kind="stable")
    o = o[np.argsort(row[o], kind="stable")]
    sh, sr = h[o], row[o]
    new = np.ones(len(sh), np.bool_)
    new[1:] = (sh[1:] != sh[:-1]) | (sr[1:] != sr[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(sh)))
    distinct = np.bincount(sr[at], minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, sr[at], times)
    same = np.zeros(len(h), np.bool_)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    # words are upper case (or marked) throughout if the byte counts between their bounds say so
    upper = np.concatenate([[0], np.cumsum(flag == 1)])
    mark = np.concatenate([[0], np.cumsum(flag == 3)])
    ups, marks = upper[words.end] - upper[words.start], mark[words.end] - mark[words.start]
    out[:, 10] = np.log1p(distinct) / np.log(count + 2)
    out[:, 11] = _logit(top, count)
    out[:, 12] = _logit(np.bincount(row[same], minlength=rows), count)
    out[:, 13] = _logit(np.bincount(row[(ups > 1) & (ups * 2 > length)], minlength=rows), count)
    out[:, 14] = _logit(np.bincount(row[marks > 0], minlength=rows), count)
    out[:, 15] = _logit(np.bincount(row[length > 24], minlength=rows), count)
    return out


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and log-density constants; index 0 low, 1 good."""

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    constant: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-density of good less that of low."""
        z = (x - self.centre) / np.maximum(self.scale, 1e-6)
        dens = []
        for c in (0, 1):
            w = (z - self.mean[c]) @ self.whiten[c].T
            dens.append(self.constant[c] - 0.5 * np.einsum("ij,ij->i", w, w))
        return dens[1] - dens[0]


#: scores every text 0 and keeps it
NEUTRAL = Discriminant(*(np.zeros(s) for s in ((len(STATISTICS),), (1,), (2, len(STATISTICS)), (2, len(STATISTICS), len(STATISTICS)), (2,))), 0.0)


def fit_arrays(x: np.ndarray, y: np.ndarray, pooled: float = 0.1, ridge: float = 0.02, keep: float = 0.998) -> Discriminant:
    """Fit on statistics x and labels y (1 good).  keep: share of good training rows the threshold must keep."""
    y = np.asarray(y)
    if not ((y == 0).sum() > 1 and (y == 1).sum() > 1):
        raise ValueError("labelled rows of both classes are needed")
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    means = np.stack([z[y == c].mean(0) for c in (0, 1)])
    covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    share = np.array([(y == c).mean() for c in (0, 1)])
    both = share[0] * covs[0] + share[1] * covs[1]
    whiten, constant = [], []
    for c in (0, 1):
        s = (1 - pooled) * covs[c] + pooled * both + ridge * np.eye(len(centre))
        chol = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(chol))
        constant.append(np.log(share[c]) - np.log(np.diag(chol)).sum())
    model = Discriminant(centre, scale, means, np.stack(whiten), np.array(constant), 0.0)
    good = np.sort(model.score(x[y == 1]))
    cut = min(0.0, float(good[int((1 - keep) * len(good))]))
    return Discriminant(centre, scale, means, model.whiten, model.constant, cut)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, words in sliced(batches):
        x = statistics(words)
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([part.column(0), values], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, **settings: float) -> Discriminant:
    """Fit on at most ``most`` labelled documents: those whose ids have the least hashes (a bound on what is
    fitted, not on what is scored).  Rows of labels without id or class are left out; a repeated id counts once,
    with its least label and the least statistics of its texts."""
    named = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    sample = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.struct(F.col("doc_id").cast("long").alias("i"), F.col("y").cast("int").alias("y")).alias("y"), "text")
    # a row an id: what is sent to the driver is bounded however often an id is repeated
    each = found.mapInArrow(_measured, "y struct<i:long,y:int>, x array<double>").groupBy("y.i").agg(F.min("y.y").alias("y"), F.min("x").alias("x"))
    got = each.toArrow()
    y = got["y"].to_numpy()
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return NEUTRAL
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(got.num_rows, len(STATISTICS))
    # rows arrive in any order: sorting makes sums, hence the model, repeatable
    o = np.lexsort([*x.T, y])
    return fit_arrays(x[o], y[o], **settings)


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score, keep for every row of docs: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in sliced(batches):
            s = model.score(statistics(words))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array(s >= model.threshold)], ["doc_id", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, keep boolean")


def kept(docs: DataFrame, model: Discriminant) -> DataFrame:
    """The rows of docs that the model keeps, with all their columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # by position: other columns may have any names
            short = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["i", "text"])
            good = [model.score(statistics(words)) >= model.threshold for _, words in sliced(iter([short]))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
