"""Corpus tables: quality, usage, versions, vectors.

All are joins, aggregates and windows on keys that spread with the data; nothing is collected.  Null keys form a group
of their own in aggregates and match nothing in joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as X


_UNSURE, _UNREADABLE = "\\[\\?\\]", "(?i)\\[unreadable\\b[^\\]]*\\]"


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, unsure and unreadable marks, and the first five lines that hold some (number and 200 characters), of each
    document with any."""
    n = lambda p: F.regexp_count("text", F.lit(p))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.substring(X.stripped(x), 1, 200).alias("text"), x.rlike(f"{_UNSURE}|{_UNREADABLE}").alias("hit")))
    samples = F.transform(F.slice(F.filter(lines, lambda x: x["hit"]), 1, 5), lambda x: F.struct(x["line"], x["text"]))
    found = docs.select("doc_id", n(_UNSURE).alias("unsure"), n(_UNREADABLE).alias("unreadable"), samples.alias("samples"))
    return found.filter("unsure + unreadable > 0")


def quality_report(docs: DataFrame) -> DataFrame:
    """Per source: files, those with marks of doubt, the marks, and a score from 1 down to 0."""
    q, u = F.regexp_count("text", F.lit(_UNSURE)), F.regexp_count("text", F.lit(_UNREADABLE))
    zero = F.lit(0)
    agg = docs.groupBy("source").agg(F.count("*").alias("files"), F.count_if((q > 0) | (u > 0)).alias("with_issues"), F.coalesce(F.sum(q), zero).alias("unsure"), F.coalesce(F.sum(u), zero).alias("unreadable"))
    return agg.withColumn("score", F.bround(F.greatest(F.lit(0.0), 1 - (F.col("unsure") + 2 * F.col("unreadable")) / F.col("files") / 20), 3))


def usage_rollup(calls: DataFrame) -> DataFrame:
    """Calls and tokens by model, and of all (model null, total true)."""
    return calls.rollup("model").agg(F.count("*").alias("calls"), F.sum("tokens").cast("long").alias("tokens"), (F.grouping("model") == 1).alias("total"))


def state_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids of two versions with what is to be done: cached, modified, new or deleted."""
    a = before.select("doc_id", F.md5("text").alias("old"))
    b = after.select("doc_id", F.md5("text").alias("new"), F.lit(True).alias("there"))
    both = a.withColumn("was", F.lit(True)).join(b, "doc_id", "full_outer")
    what = F.when(F.col("there").isNull(), "deleted").when(F.col("was").isNull(), "new").when(F.col("old").eqNullSafe(F.col("new")), "cached").otherwise("modified")
    return both.select("doc_id", what.alias("action"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors as rows; null and zero vectors are NaN."""
    held = column.combine_chunks()
    there = held.is_valid().to_numpy(zero_copy_only=False)
    flat = held.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.full((len(there), len(flat) // max(1, int(there.sum()))), np.nan)
    out[there] = flat.reshape(int(there.sum()), -1) if len(flat) else np.nan
    with np.errstate(invalid="ignore"):
        return out / np.sqrt((out * out).sum(1, keepdims=True))


def _nearest(k: int):
    """The k nearest (more at a tie) of a block of vectors to each probe of a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, probes = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(probes[:0], ids[:0], np.zeros(0))]
        if len(ids) and len(probes):
            p, v = _matrix(left["embedding"]), _matrix(right["embedding"])
            if not p.shape[1] or not v.shape[1]:  # a block of nulls
                p, v = np.full((len(p), 1), np.nan), np.full((len(v), 1), np.nan)
            for at in range(0, len(p), 256):
                sim = np.round(p[at : at + 256] @ v.T, 6)
                order = np.where(np.isnan(sim), -2.0, sim)  # without a similarity: last
                order[probes[at : at + 256, None] == ids[None, :]] = -3.0
                least = np.partition(order, -k, axis=1)[:, -k, None] if len(ids) > k else -2.0
                r, c = np.nonzero((order >= least) & (order > -3.0))
                found.append((probes[at + r], ids[c], sim[r, c]))
        a, b, s = (np.concatenate(x) for x in zip(*found))
        return pa.table({"probe_id": a, "vec_id": b, "similarity": pa.array(s, pa.float64(), mask=np.isnan(s))})

    return run


def vector_topk(vectors: DataFrame, probes: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """The k most similar vectors (cosine, rounded to six places; ties by id; null and zero vectors last) of each probe.
    Each pair of blocks of about ``block`` rows is one matrix product, whose partial top k leaves it."""
    n_probes, n_vectors = (max(1, -(-df.count() // block)) for df in (probes, vectors))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = probes.select(part(n_probes).alias("p"), every(n_vectors).alias("v"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    v = vectors.select(every(n_probes).alias("p"), part(n_vectors).alias("v"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    scored = p.groupBy("p", "v").cogroup(v.groupBy("p", "v")).applyInArrow(_nearest(k), "probe_id long, vec_id long, similarity double")
    w = Window.partitionBy("probe_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
