"""Secret scan: a battery of randomness tests with control of false discoveries run by run.

Candidates are all runs of ``LEAST`` or more characters of the usual key alphabets (base 64's padding ends a run, as
does the sign between a name and its value).  The characters of a run tell its
encoding (decimal, hexadecimal, upper- or lower-case alphanumeric, base 64, letters).  Under the hypothesis that it
is uniformly random in that encoding's alphabet, a run gets three p-values: chi-squared uniformity, Wald-Wolfowitz
runs about the middle of the alphabet, and lag-one serial correlation; Fisher's method combines them.  Runs with a
combined value under ``ALPHA`` are not random, which costs that share of true secrets.

The rest are random or too short to tell, so each run is decided on its own: how likely are its characters if drawn
evenly from its encoding's alphabet, and how likely as ordinary text of the same length?  Ordinary text is a chain over
letters (case folded), digits and word starts, counted in the corpus's short words (no key is among them) on top of
built-in counts, so it tells something of an empty corpus too.  With ``PRIOR`` as the share of keys among candidates, the
two give the chance that a run is ordinary (its local false-discovery rate); it is reported if that is at most
``FALSE_SHARE``.  How many other runs the corpus holds, and which, has no part in it: a lone key is found among any number
of words.  Decimal digits are never reported: ordinary ones are as even as random ones.

Defined results: null, empty and blank texts have no candidates; a run that occurs again, or in a repeated row, is
reported at each place; rows of null id are scanned and reported with it; very long texts are scanned whole, and a
very long run is one run; runs of equal p-values are each decided alike; an empty table reports nothing; other columns
are not read, and ``redacted`` gives them back whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small
from .textkernel import column_bytes, sliced

LEAST = 16
ALPHA = 0.01
FALSE_SHARE = 0.05
MASK = "<SECRET>"

_DIGIT, _UP, _LOW = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "decimal": _DIGIT, "hex": _DIGIT + "abcdef", "HEX": _DIGIT + "ABCDEF", "upper36": _DIGIT + _UP, "lower36": _DIGIT + _LOW,
    "lower": _LOW, "upper": _UP, "letters": _UP + _LOW, "base64": _UP + _LOW + _DIGIT + "+/", "base64url": _UP + _LOW + _DIGIT + "-_",
}
_INDEX = {name: {ord(c): i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}

_KEY = np.zeros(256, np.bool_)
for _c in (_DIGIT + _UP + _LOW + "+/-_").encode():
    _KEY[_c] = True
#: share of keys assumed among candidates
PRIOR = 0.001

_EDGE, _LONG = 27, 28
#: letters (case folded) 0-25, digits 26, anything else 27
_CLASS = np.full(256, _EDGE, np.int64)
for _i in range(26):
    _CLASS[[65 + _i, 97 + _i]] = _i
_CLASS[48:58] = 26
_SEPARATORS = b"-_/+"
#: letters of ordinary text in parts of a thousand (English), a to z
_LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: built-in counts of each class's row: next is of the same kind (letter, digit) but for this share
_WEIGHT, _SWITCH, _CASE_SWITCH = 50.0, 0.03, 0.1


def encoding_of(run: bytes) -> tuple[str, bytes]:
    """The encoding a run is in and its symbols (hyphens between groups left out)."""
    body, joined = run, run.replace(b"-", b"")
    has = set(joined)
    digit, up, low = any(48 <= c < 58 for c in has), any(65 <= c < 91 for c in has), any(97 <= c < 123 for c in has)
    if has <= set(b"0123456789"):
        return "decimal", joined
    if has <= set(b"0123456789abcdef") and digit:
        return "hex", joined
    if has <= set(b"0123456789ABCDEF") and digit:
        return "HEX", joined
    marks = has - set((_DIGIT + _UP + _LOW).encode())
    if len(joined) == len(body) and not marks:
        if digit and up != low:
            return ("upper36" if up else "lower36"), body
        if not digit:
            return ("letters" if up and low else "upper" if up else "lower"), body
        return "base64", body
    if set(body) <= set(ALPHABETS["base64url"].encode()):
        return "base64url", body
    return "base64", bytes(c for c in body if c in _INDEX["base64"])


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(symbols: bytes, encoding: str) -> tuple[float, float, float, float]:
    """p-values of uniformity, runs and serial correlation, and all three combined."""
    index = _INDEX[encoding]
    x = np.array([index[c] for c in symbols])
    n, k = len(x), len(index)
    counts = np.bincount(x, minlength=k)
    stat = float((counts.astype(float) ** 2).sum() * k / n - n)
    # a gamma of the statistic's mean and variance, by the cube-root normal approximation
    df = (k - 1) * n / (n - 1)
    z = ((stat / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    chi = _upper_tail(z)
    high = x * 2 >= k
    a, b = int(high.sum()), int(n - high.sum())
    if a and b and n > 2:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * a * b / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        order = min(1.0, 2 * _upper_tail(abs(runs - mean) / math.sqrt(var)))
    else:
        order = 2.0 ** (1 - n)
    d = x - x.mean()
    total = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / total if total else 1.0
    serial = min(1.0, 2 * _upper_tail(abs(r + 1 / n) * math.sqrt(n)))
    f = -2 * sum(math.log(max(p, 1e-300)) for p in (chi, order, serial))
    return chi, order, serial, math.exp(-f / 2) * (1 + f / 2 + f * f / 8)


def transitions(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of neighbouring classes within words (letters and digits) of under LEAST characters: 28 x 28."""
    kind = np.full(len(data) + 2, _EDGE, np.int64)
    kind[1:-1] = _CLASS[data]
    ink = kind != _EDGE
    step = np.diff(ink.astype(np.int8))
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    long = end - start >= LEAST
    gone = np.zeros(len(kind) + 1, np.int32)
    gone[start[long]] += 1
    gone[end[long]] -= 1
    kind[np.cumsum(gone[:-1]) > 0] = _LONG
    code = kind[:-1] * 29 + kind[1:]
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    code[inner] = _LONG * 29  # the pair of two texts
    n = np.bincount(code, minlength=29 * 29).reshape(29, 29)[:28, :28].copy()
    n[_EDGE, _EDGE] = 0
    return n


def ordinary(counts: np.ndarray) -> np.ndarray:
    """-log of the chance of each class after each (27: at a word's start), given that the word goes on."""
    letters = np.array(_LETTERS) / sum(_LETTERS)
    base = np.empty((28, 27))
    base[:26], base[:26, 26] = np.append(letters * (1 - _SWITCH), 0), _SWITCH
    base[26], base[26, 26] = np.append(letters * _SWITCH, 0), 1 - _SWITCH
    base[27], base[27, 26] = np.append(letters * 0.9, 0), 0.1
    n = counts[:, :27] + base * _WEIGHT
    return -np.log(n / n.sum(1, keepdims=True))


def chance_ordinary(run: bytes, encoding: str, body: bytes, cost: np.ndarray) -> float:
    """Chance that a run which passed the battery is ordinary text: its local false-discovery rate."""
    if encoding == "decimal":
        return 1.0
    x = _CLASS[np.frombuffer(run, np.uint8)]
    seen = np.append(_EDGE, x[:-1])
    ink = x != _EDGE
    plain = float(cost[seen[ink], x[ink]].sum()) + int(ink[x == 26].sum()) * math.log(10)
    plain += sum(body.count(c) for c in _SEPARATORS) * math.log(len(_SEPARATORS))
    if encoding in ("letters", "base64", "base64url"):
        raw = np.frombuffer(run, np.uint8)
        letter, small = x < 26, raw >= 97
        both = letter[1:] & letter[:-1]
        switch = int((small[1:] != small[:-1])[both].sum())
        plain -= switch * math.log(_CASE_SWITCH) + (int(both.sum()) - switch) * math.log(1 - _CASE_SWITCH)
        plain += (int(letter.sum()) - int(both.sum())) * math.log(2)
    even = len(body) * math.log(len(_INDEX[encoding]))
    odds = min(even - plain, 700.0)  # log of ordinary : even, before the prior
    ratio = math.exp(odds) * (1 - PRIOR) / PRIOR
    return ratio / (1 + ratio)


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and byte bounds (within its text) of every run of LEAST or more key characters."""
    ink = np.zeros(len(data) + 2, np.int8)
    ink[1:-1] = _KEY[data]
    step = np.diff(ink)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    inner = inner[(ink[inner] == 1) & (ink[inner + 1] == 1)]  # a text's end ends a run
    if len(inner):
        start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
    long = end - start >= LEAST
    start, end = start[long], end[long]
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start - offsets[row], end - offsets[row]


_SCHEMA = "doc_id long, sig long, start int, end int, encoding string, symbols int, p_uniform double, p_runs double, p_serial double, p_value double"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.float64()] * 4]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((28, 28), np.int64)
    for _, words in sliced(batches):
        counts += transitions(words.data, words.offsets)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts.ravel()[used])], ["pair", "times"])


def _found(cost: np.ndarray, alpha: float, false_share: float):
    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in sliced(batches):
            ids, sigs = part.column(0).to_pylist(), part.column(1).to_pylist()
            out: list[tuple] = []
            for r, s, e in zip(*(x.tolist() for x in candidates(words.data, words.offsets))):
                base = int(words.offsets[r])
                run = words.data[base + s : base + e].tobytes()
                lead = len(run) - len(run.lstrip(b"-_/+"))
                run = run[lead:].rstrip(b"-_/+")
                kind, body = encoding_of(run)
                if len(body) < LEAST or chance_ordinary(run, kind, body, cost) > false_share:
                    continue
                tests = battery(body, kind)
                if tests[-1] >= alpha:
                    out.append((ids[r], sigs[r], s + lead, s + lead + len(run), kind, len(body), *tests))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], _NAMES)

    return run_all


def scan(docs: DataFrame, alpha: float = ALPHA, false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, sig (hash of the row's text), byte bounds, encoding and p-values of every secret found."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"), "text").filter("text is not null")
    counts = np.zeros(28 * 28, np.int64)
    # 784 rows at most
    for r in texts.mapInArrow(_counted, "pair int, times long").groupBy("pair").agg(F.sum("times").alias("times")).collect():
        counts[r["pair"]] = r["times"]
    return texts.mapInArrow(_found(ordinary(counts.reshape(28, 28)), alpha, false_share), _SCHEMA)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.num_columns - 2)
        data, off = column_bytes(text)
        out = []
        for r, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            if not text[r].is_valid:
                out.append(None)
                continue
            raw = data[off[r] : off[r + 1]].tobytes()
            at, kept = 0, []
            for s in spans or []:
                kept += [raw[at : s["start"]], MASK.encode()]
                at = s["end"]
            out.append(b"".join([*kept, raw[at:]]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.binary()).cast(pa.string())], [*batch.schema.names[:-2], "masked"])


def redacted(docs: DataFrame, alpha: float = ALPHA, false_share: float = FALSE_SHARE) -> DataFrame:
    """docs with each secret replaced by ``MASK`` in text; all columns stay in place (n_chars is the caller's)."""
    spans = scan(docs, alpha, false_share).groupBy("doc_id", "sig").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    spans = materialise(spans, "secrets")
    side = spans.select(F.col("doc_id").alias("its_id"), F.col("sig").alias("its_sig"), "spans")
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # names of the caller's columns can't clash with ours
    plain = docs.toDF(*inner)
    at_text, at_id = inner[names.index("text")], inner[names.index("doc_id")]
    held = plain.join(small(side), plain[at_id].cast("long").eqNullSafe(F.col("its_id")) & (F.xxhash64(at_text) == F.col("its_sig")), "left")
    rest = [c for c in inner if c != at_text]
    schema = ", ".join([f"{c} {plain.schema[c].dataType.simpleString()}" for c in rest] + ["masked string"])
    done = held.select(*rest, at_text, "spans").mapInArrow(_masked, schema)
    return done.select(*[F.col("masked" if c == at_text else c).alias(n) for c, n in zip(inner, names)])
