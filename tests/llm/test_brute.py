"""Operators against brute force, exact round trips or held-out accuracy."""

import base64
import hashlib
import io
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, media, ngram_join, packing, quality, queries, secrets, substring_dedup, tokens, toxicity, warc
from foliospark.llm.textkernel import Words

DATA = "/root/testdata/sf0.01"


def words_of(texts):
    raw = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def prose(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


# --- 1 quality


def test_discriminant_equals_plain_densities():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (200, 5)), rng.normal(1, 2, (300, 5))])
    y = np.repeat([0, 1], [200, 300])
    m = quality.fit_arrays(x, y)
    z = (x - x.mean(0)) / x.std(0)
    covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    both = 0.4 * covs[0] + 0.6 * covs[1]
    want = []
    for c in (0, 1):
        s = 0.9 * covs[c] + 0.1 * both + 0.02 * np.eye(5)
        d = z - z[y == c].mean(0)
        want.append(np.log((0.4, 0.6)[c]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(m.score(x), want[1] - want[0])


def test_quality_on_held_out_labels(spark):
    d, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r["doc_id"]: r["keep"] for r in quality.score(d, quality.fit(d, labels.filter("doc_id % 2 = 0"))).collect()}
    held = labels.filter("doc_id % 2 = 1").collect()
    good = [got[r["doc_id"]] for r in held if r["quality"] == 1]
    bad = [got[r["doc_id"]] for r in held if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.5


def odd_rows(rng):
    """Null and repeated ids, null, empty, blank and very long texts, and columns named like those inside."""
    texts = [None, "", " \n ", "same words here again", "same words here again", prose(rng, 30_000, 500), "good"]
    return [(i, t, "en" if k % 2 else None, k, "x") for k, (i, t) in enumerate(zip([1, 2, 3, 4, 4, None, 5], texts))]


ODD = "doc_id long, text string, lang string, y int, score string"


def test_quality_on_odd_rows(spark):
    rows = odd_rows(random.Random(20))
    d, labels = spark.createDataFrame(rows, ODD), spark.createDataFrame([(1, 0), (2, 0), (4, 1), (5, 1), (5, 1), (None, 0), (4, None)], "doc_id long, quality int")
    for model in (quality.fit(d, labels), quality.fit(d, labels.filter("quality = 1")), quality.fit(d.limit(0), labels)):
        got = quality.score(d, model).collect()
        x = quality.statistics(words_of([t or "" for _, t, *_ in rows]))
        assert sorted((r["doc_id"] or 0, round(r["score"], 9), r["keep"]) for r in got) == sorted((i or 0, round(float(v), 9), bool(v >= model.threshold)) for (i, *_), v in zip(rows, model.score(x)))
        assert sorted(map(repr, quality.kept(d, model).collect())) == sorted(repr(r) for r, v in zip(d.collect(), model.score(x)) if v >= model.threshold)
        assert quality.score(d.limit(0), model).count() == 0
    assert quality.kept(d, quality.NEUTRAL).count() == len(rows)


# --- 2 media


def test_media_made_and_found_again():
    note = b"hello world " * 30
    for kind, made in (("image/png", media.make_png(note)), ("image/gif", media.make_gif(note)), ("audio/wav", media.make_wav(note)), ("application/gzip", media.make_gzip(note)), ("application/zip", media.make_zip(note))):
        assert media.main_type(made) == (kind, len(made))
        got, n, carved = media.sniff(b"some text " + made + b" tail")
        assert [(k, at, size, h) for k, at, size, h in carved] == [(kind, 10, len(made), hashlib.md5(made).hexdigest())] and n == 0
        cut = made[:-9]
        assert media.main_type(cut)[1] in (0, len(cut)) and media.sniff(cut)[1] != len(made)


def test_media_in_a_data_address_and_nulls(spark):
    png = media.make_png(b"x")
    page = b"<html><img src='data:image/png;base64," + base64.b64encode(png) + b"'></html>"
    df = spark.createDataFrame([(1, "image/gif", png), (2, None, page), (3, "text/plain", None), (4, "text/plain", b""), (None, None, b"\0\1")], "media_id long, declared string, content binary")
    got = {r["media_id"]: r for r in media.sniffed(df).collect()}
    assert got[1]["type"] == "image/png" and got[1]["corrected"]
    assert got[2]["type"] == "text/html" and got[2]["carved"][0]["md5"] == hashlib.md5(png).hexdigest()
    assert got[3]["type"] is None and got[4]["type"] == "application/x-empty" and got[None]["type"] == "application/octet-stream"
    assert media.sniffed(df.limit(0)).count() == 0


def test_png_checksum_is_checked():
    png = bytearray(media.make_png(b"abc"))
    png[40] ^= 1
    assert media.main_type(bytes(png))[1] == 0
    assert zlib.crc32(b"") == 0 and struct.calcsize(">I4s") == 8


@pytest.mark.parametrize("kind", media.MAKERS)
def test_every_validator(kind):
    for note in (b"", b"x", b"<p>100 %</p>" * 300, b"long " * 200_000):
        made = media.MAKERS[kind](note)
        assert media.main_type(made) == (kind, len(made))
        for cut in {len(made) // 2, len(made) - 1}:
            assert media.main_type(made[:cut])[1] != len(made)
        if kind != "audio/flac":  # has no length: takes all that follows
            assert [x[:3] for x in media.objects(b"some text " + made + b" tail")] == [(kind, 10, len(made))]


def naive_objects(content):
    """All offsets by all validators."""
    found, at = [], 0
    while at < len(content):
        for magic, place, _, valid in media.SIGNATURES:
            if content[at + place : at + place + len(magic)] == magic and (n := valid(content, at)):
                found.append((at, n))
                at += n
                break
        else:
            at += 1
    return found


def test_objects_equal_a_scan_of_all_offsets():
    rng = random.Random(21)
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            made = rng.choice(list(media.MAKERS.values()))(prose(rng, rng.randrange(20)).encode())
            parts.append(rng.choice([made, made[: rng.randrange(len(made))], rng.randbytes(rng.randrange(40)), b"BM RIFF PK\3\4 ID3 \xff\xd8\xff", b"text "]))
        content = b"".join(parts)
        assert [(at, n) for _, at, n, _ in media.objects(content)] == naive_objects(content)


def test_declared_types_stay_unless_contradicted(spark):
    rows = [(1, "text/csv", b"a,b"), (2, "font/woff2", b"wOF2\0\1"), (3, "image/png", b"\0\1"), (4, "application/json; charset=utf-8", b"{}"), (5, "text/plain", b" <!-- c --> <HTML>"), (6, None, b"a"), (7, "image/jpeg", media.MAKERS["image/heic"](b"")), (7, "text/csv", b"a,b"), (None, "text/csv", None)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "media_id long, declared string, content binary, type string, carved int")
    got = sorted((r["media_id"] or 0, r["type"] or "", r["corrected"]) for r in media.sniffed(d).collect())
    assert got == [(0, "", False), (1, "text/csv", False), (2, "font/woff2", False), (3, "application/octet-stream", True), (4, "application/json", False), (5, "text/html", True), (6, "text/plain", True), (7, "image/heic", True), (7, "text/csv", False)]
    assert media.sniffed(d.limit(0)).count() == 0 and media.carved(d).count() == 0


def test_carved_bytes(spark):
    inside = [media.make_gif(b"abc"), media.make_pdf(b"x" * 10)]
    page = b"<html>" + inside[0] + b" and data:;base64," + base64.b64encode(inside[1]) + b" end"
    got = media.carved(spark.createDataFrame([(9, page), (10, None), (11, b"")], "media_id long, content binary")).collect()
    assert [(r["media_id"], r["offset"], bytes(r["content"])) for r in sorted(got, key=lambda r: r["offset"])] == [(9, 6, inside[0]), (9, page.index(b"base64,") + 7, inside[1])]


# --- 3 packing


def brute_pack(pieces, window, places):
    open_, out, born = [], [], 0
    for p in pieces:
        if p[2] == window:
            out.append([p])
            continue
        fits = [w for w in open_ if window - sum(x[2] for x in w[1]) >= p[2]]
        if fits:
            best = min(fits, key=lambda w: (window - sum(x[2] for x in w[1]), w[0]))
            best[1].append(p)
            continue
        if len(open_) == places:
            full = max(open_, key=lambda w: (sum(x[2] for x in w[1]), -w[0]))
            open_.remove(full)
            out.append(full[1])
        open_.append((born, [p]))
        born += 1
    return out, [w[1] for w in open_]


def test_packer_equals_brute_force():
    rng = random.Random(3)
    pieces = [(i, 0, rng.choice([rng.randrange(1, 101), 7, 100])) for i in range(800)]
    p = packing.Packer(100, 6)
    out = [w for w in map(p.add, pieces) if w]
    assert (out, p.rest()) == brute_pack(pieces, 100, 6)


def test_every_token_is_packed_once(spark):
    counts = spark.createDataFrame([(1, 50), (2, 250), (2, 250), (3, 0), (None, 5), (4, 100)], "doc_id long, n_tokens long")
    got = packing.pack(counts, window=100, places=2, packers=3).collect()
    assert all(r["fill"] == sum(r["lengths"]) <= 100 for r in got)
    held = sorted((d or 0, s, n) for r in got for d, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]))
    assert held == sorted([(1, 0, 50), *[(2, 0, 100), (2, 100, 100), (2, 200, 50)] * 2, (0, 0, 5), (4, 0, 100)])
    assert packing.pack(counts.limit(0), 100, 2, 3).count() == 0
    assert len({r["window_id"] for r in got}) == len(got)


# --- 4 substring dedup


def brute_spans(texts, least):
    seen, out = {}, {}
    for i in sorted(texts):
        w = texts[i].split()
        gone = set()
        for k in range(len(w) - least + 1):
            if seen.get(tuple(w[k : k + least]), i) < i:
                gone |= set(range(k, k + least))
        for k in range(len(w) - least + 1):
            seen.setdefault(tuple(w[k : k + least]), i)
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_substrings_equal_brute_force(spark):
    rng = random.Random(5)
    passage = [prose(rng, 70) for _ in range(4)]
    texts = {i: " ".join(rng.choice([prose(rng, 40), rng.choice(passage), "again " * 30]) for _ in range(5)).strip() for i in range(60)}
    for hot in (substring_dedup.HOT, 12, 0):  # groups by automata, some or all by windows
        got = {r["doc_id"]: r["text"].split() for r in substring_dedup.deduplicated(docs(spark, list(texts.items())), hot=hot).collect()}
        assert got == brute_spans(texts, substring_dedup.LEAST)


def test_small_shards_lose_nothing():
    rng = random.Random(6)
    base = [rng.randrange(50) for _ in range(120)]
    group = [(i, 0, 0, np.array(base[a : a + 60] + [100 + i], "<u4").tobytes()) for i, a in enumerate(rng.randrange(60) for _ in range(30))]
    want = {x[0] for x in substring_dedup.repeats(group, 20)}
    cells = lambda most: {(d, k) for d, _, a, b in substring_dedup.repeats(group, 20, most) for k in range(a, b)}
    assert cells(100) == cells(10**6) and want


def test_substring_nulls_and_copies(spark):
    rng = random.Random(7)
    long = prose(rng, 80)
    got = {r["doc_id"]: (r["text"], r["removed_words"]) for r in substring_dedup.deduplicated(docs(spark, [(1, None), (2, ""), (4, long), (3, long), (None, long)])).collect()}
    assert got == {1: (None, 0), 2: ("", 0), 3: (long, 0), 4: ("", 80), None: (long, 0)}


# --- 5 token records


def test_records_round_trip_and_damage(spark, tmp_path):
    texts = ["", None, "Hello, world! it's  fine\n\n", "naïve café 漢字  x", "a" * 50_000, "Hello, world!"]
    index = tokens.write_records(docs(spark, list(enumerate(texts))), folder=f"file://{tmp_path}/records")
    got = {r["doc_id"]: r["ids"] for r in tokens.read_records(index.orderBy("checksum")).collect()}
    bpe = tokens.encoding(tokens.VOCABULARY)
    assert got == {i: bpe.encode_ordinary(t or "") for i, t in enumerate(texts)}
    row = index.filter("doc_id = 2").first()
    with open(row["file"].removeprefix("file://"), "r+b") as f:
        f.seek(row["offset"] + 30)
        byte = f.read(1)[0]
        f.seek(row["offset"] + 30)
        f.write(bytes([byte ^ 1]))
    with pytest.raises(Exception, match="damaged record"):
        tokens.read_records(index).collect()


def test_ids_equal_the_tokenizer_on_all_kinds_of_white_space():
    bpe = tokens.encoding(tokens.VOCABULARY)
    rng = random.Random(15)
    bits = ["a", "Word", "don't", "'s", "12", "4", "!", "...", "é", "ß", "漢", "か", "—", "“", "😀", "×", "À", "\u200b", "\x00", *"\xa0\u3000\u2028\u2029\u0085\u1680\u2003\u202f\u205f\x1c\x1f\x0b\x0c\r\n\t ", "  ", "\n\n", " "]
    for _ in range(10_000):
        texts = ["".join(rng.choices(bits, k=rng.randrange(14))) if rng.random() > 0.05 else None for _ in range(rng.randrange(1, 6))]
        batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
        got = [x.tolist() for _, ids, n in tokens.encoded(iter([batch]), tokens.VOCABULARY) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [bpe.encode_ordinary(t or "") for t in texts]


def test_token_queries_on_odd_rows(spark, tmp_path):
    """op5 and op3 from texts on, against the tokenizer and the packers' contract."""
    bpe = tokens.encoding(tokens.VOCABULARY)
    rng = random.Random(16)
    texts = ["para one.\n\u00a0\npara two ! x", "\u00a0", "!", "", None, prose(rng, 9000, 10**6), "same", "same", "same"]
    ids = [1, 2, 3, 4, 5, 6, 7, 7, None]
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in zip(ids, texts)], "doc_id long, text string, ids string, n_tokens int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(((-1 if i is None else i), bpe.encode_ordinary(t or "")) for i, t in zip(ids, texts))
    index = queries.op5_token_records(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["ids"]) for r in tokens.read_records(index).collect()) == want
    assert index.filter("doc_id is null").count() == 1 and tokens.write_records(d.limit(0)).count() == 0
    windows = queries.op3_packing(spark, str(tmp_path)).collect()
    cells = sorted(((-1 if i is None else i), s, n) for r in windows for i, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]))
    assert cells == sorted((i, s, min(2048, len(x) - s)) for i, x in want for s in range(0, len(x), 2048))
    assert all(r["fill"] == sum(r["lengths"]) <= 2048 for r in windows)


def test_merge_equals_brute_force():
    rng = random.Random(17)
    for _ in range(50):
        todo = [(rng.randrange(1, 40), (0, k), [(k, 0, 0)]) for k in range(rng.randrange(30))]
        bins = []
        for fill, key, held in sorted(todo, key=lambda x: (-x[0], x[1])):
            fits = [b for b in bins if b[0] >= fill]
            best = min(fits, key=lambda b: (b[0], b[1])) if fits else [40, len(bins), []]
            if not fits:
                bins.append(best)
            best[0] -= fill
            best[2] += held
        assert packing.merge(todo, 40) == [b[2] for b in bins]


def test_crc32c_known_value():
    data = np.frombuffer(b"123456789" + b"\0" * 32, np.uint8)
    assert tokens.crc32c(data, np.array([0, 9]), np.array([9, 41])).tolist() == [0xE3069283, 0x8A9136AA]


# --- 6 secrets


def test_random_keys_are_found_and_words_are_not(spark):
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = {i: "".join(rng.choices(alphabet, k=40)) for i in range(60)}
    hexes = {i: "".join(rng.choices("0123456789abcdef", k=64)) for i in range(60, 120)}
    rows = [(i, f"token = \"{k}\" and longcompoundwordsofprose stay") for i, k in {**keys, **hexes}.items()]
    plain = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("not text rlike '[0-9A-Fa-f]{20}'").collect()]
    rows += [(1000 + i, "erschlichkeitenverstand unquestionablenesses " + t) for i, t in enumerate(plain)] + [(None, None), (900, "")]
    got = secrets.scan(docs(spark, rows)).collect()
    texts = dict(rows)
    found = {r["doc_id"]: texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode() for r in got}
    wanted = {**keys, **hexes}
    assert len(set(found) & set(wanted)) >= 0.95 * len(wanted) and set(found) <= set(wanted)
    masked = {r["doc_id"]: r["text"] for r in secrets.redacted(docs(spark, rows)).collect()}
    assert all(wanted[i].strip("+/-_") not in masked[i] for i in found) and masked[900] == "" and masked[None] is None
    assert secrets.scan(docs(spark, []).limit(0)).count() == 0


def test_a_lone_key_is_found_whatever_else_there_is(spark):
    rng = random.Random(12)
    words = sorted({w for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("lang = 'en'").collect() for w in r["text"].split() if w.isascii() and w.isalpha() and w.islower()})
    upper, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = {1: "AKIA" + "".join(rng.choices(upper, k=16)), 2: "".join(rng.choices(mixed, k=40))}
    rows = [(i, f'key = "{k}" here') for i, k in keys.items()]
    others = [(i, sign.join(rng.choices(words, k=6)) + f"{sign}{rng.randrange(3000)}") for i, sign in enumerate("-/_" * 2000, 10)]
    others += [(10000 + i, "INVOICES" * 3) for i in range(40)]
    for corpus in ([], others):
        for alone in rows:
            assert [r["doc_id"] for r in secrets.scan(docs(spark, [alone, *corpus])).collect()] == [alone[0]]



def test_p_values_are_even_on_random_runs():
    rng = random.Random(22)
    for name, size in (("hex", 40), ("base64", 64), ("upper36", 32)):
        p = np.array([secrets.battery("".join(rng.choices(secrets.ALPHABETS[name], k=size)).encode(), name) for _ in range(2000)])
        for column in p.T:
            assert abs((column < 0.05).mean() - 0.05) < 0.025 and abs((column < 0.5).mean() - 0.5) < 0.12
    assert secrets.battery(b"a" * 40, "lower")[3] < 1e-6 and secrets.battery(b"abcdefghijklmnopqrstuvwxyz" * 2, "lower")[3] < 1e-6


def test_scan_equals_a_plain_loop(spark):
    rng = random.Random(23)
    rows = [(i, rng.choice(["k = ", "x"]) + "".join(rng.choices("abcdef0123456789", k=rng.choice([10, 15, 16, 40]))) + rng.choice(["", " word", "+/", "_-"]) + " " + prose(rng, 30)) for i in range(60)]
    rows += [(3, None), (None, ""), (None, rows[5][1]), (5, rows[5][1]), (70, "".join(rng.choices("abcdef0123456789", k=30_000))), (71, prose(rng, 20_000))]
    counts = np.zeros((28, 28), np.int64)
    for _, t in rows:
        for word in re.findall(rb"[A-Za-z0-9]+", (t or "").encode()):
            if len(word) < secrets.LEAST:
                kinds = [27, *(26 if 48 <= c < 58 else (c | 32) - 97 for c in word), 27]
                for x, y in zip(kinds, kinds[1:]):
                    counts[x, y] += 1
    cost = secrets.ordinary(counts)
    want = []
    for i, t in rows:
        for m in re.finditer(rb"[A-Za-z0-9+/_-]{16,}", (t or "").encode()):
            run = m.group().strip(b"-_/+")
            at = m.start() + m.group().index(run)
            kind, body = secrets.encoding_of(run)
            if len(body) >= secrets.LEAST and secrets.chance_ordinary(run, kind, body, cost) <= secrets.FALSE_SHARE and secrets.battery(body, kind)[3] >= secrets.ALPHA:
                want.append((i, at, at + len(run)))
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, masked int")
    got = [(r["doc_id"], r["start"], r["end"]) for r in secrets.scan(d).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 20
    masked = secrets.redacted(d).collect()
    spans = {}
    for i, a, b in set(want):
        spans.setdefault(i, []).append((a, b))
    for r in masked:
        raw = r["text"]
        if raw is not None and r["doc_id"] is not None and r["doc_id"] not in (3, 5):
            text = dict(rows[:60] + rows[-2:])[r["doc_id"]].encode()
            for a, b in sorted(spans.get(r["doc_id"], []), reverse=True):
                text = text[:a] + secrets.MASK.encode() + text[b:]
            assert raw == text.decode()
    assert secrets.redacted(d).columns == d.columns and len(masked) == len(rows) and secrets.redacted(d.limit(0)).count() == 0


# --- 7 n-gram join


def gram_set(t):
    w = t.split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def test_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    base = [prose(rng, 40, 60).split() for _ in range(8)]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    rows += [(200, "one"), (201, "one"), (202, ""), (203, None), (204, "one two"), (None, "one")]
    sets = {i: gram_set(t) for i, t in rows if t and i is not None}
    ids = sorted(sets)
    text = dict(rows)
    least = {}
    for i in ids:
        least.setdefault(text[i], i)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[k + 1 :] if least[text[a]] == a and least[text[b]] == b}
    want = {k: v for k, v in want.items() if v >= 0.5} | {(least[text[i]], i): 1.0 for i in ids if least[text[i]] != i}
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in ngram_join.similar_pairs(docs(spark, rows)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def brute_groups(sets):
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in sets}


def test_query_counts_every_pair_of_rows(spark, tmp_path):
    rng = random.Random(13)
    one = prose(rng, 40, 60).split()
    near, far = [*one[:-2], "x1", "x2"], prose(rng, 40, 60).split()
    rows = [(rng.randrange(10**6) * 100 + i, " ".join([one, near, far, ["alone", str(i)]][i % 4])) for i in range(80)] + [(None, " ".join(one)), (7, ""), (8, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: gram_set(t or "") for i, t in rows if i is not None}
    text = dict(rows)
    root = brute_groups(sets)
    alike = {i: [j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])] for i in sets}
    want = sorted((i, root[i], sum(text[j] == text[i] for j in alike[i]), len(alike[i])) for i in sets)
    got = queries.op7_ngram_join(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("doc_id", "class_id", "copies", "links").collect())) == want and sum(x[3] for x in want) == 2 * (3 * 190 + 400)


def test_an_id_with_several_texts_is_one_document(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d e"), (1, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, None), (4, "a b c d")]
    got = sorted((r["doc_a"], r["doc_b"], round(r["jaccard"], 6), r["copy"]) for r in ngram_join.similar_pairs(docs(spark, rows)).collect())
    # {abc bcd cde} of 1 and 2 (copies) and 3, {abc bcd} of 4
    assert got == [(1, 2, 1.0, True), (1, 3, 1.0, False), (1, 4, 0.666667, False), (3, 4, 0.666667, False)]
    assert ngram_join.similar_pairs(docs(spark, rows).limit(0)).count() == 0


def test_groups_equal_those_of_all_pairs(spark):
    rng = random.Random(14)
    base = [prose(rng, 24, 40).split() for _ in range(12)]
    rows = []
    for i in range(400):
        w = list(rng.choice(base)) if rng.random() < 0.8 else prose(rng, 24, 40).split()
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(20)}"
        rows.append((rng.randrange(10**6) * 1000 + i, " ".join(w)))
    want = brute_groups({i: gram_set(t) for i, t in rows})
    assert 20 < len(set(want.values())) < 380
    kept = {r["doc_id"] for r in ngram_join.one_of_each(docs(spark, rows)).collect()}
    assert kept == {i for i, r in want.items() if i == r}


def test_links_of_a_large_group_are_counted_without_rows_of_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(15)
    one, rows = prose(rng, 60, 400).split(), []
    for i in range(300):
        w = list(one)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(200)}"
        rows.append((rng.randrange(10**6) * 1000 + i, " ".join(w)))
    rows += [(5 + 10**10, rows[7][1]), (6 + 10**10, prose(rng, 60, 400))]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: gram_set(t) for i, t in rows}
    links = {i: sum(j != i and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    root = brute_groups(sets)
    write, most = ngram_join.materialise, []

    def counted(df, name):
        found = write(df, name)
        most.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "materialise", counted)
    monkeypatch.setattr(ngram_join, "PART_DOCS", 70, raising=False)  # five parts
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in queries.op7_ngram_join(spark, str(tmp_path)).collect()}
    assert got == {i: (root[i], links[i]) for i in sets} and sum(links.values()) > 40_000
    assert max(most) < 20 * len(rows)


@pytest.mark.parametrize("rare, columns", [(32, 2048), (2, 5), (1, 3)])
def test_links_of_a_cell_equal_a_loop(monkeypatch, rare, columns):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "GRAMS_AT_ONCE", columns)
    monkeypatch.setattr(ngram_join, "PAIRS_AT_ONCE", 7)
    rng = np.random.default_rng(16)
    for own in (True, False):
        sets = [np.unique(rng.integers(0, 24, rng.integers(0, 20))).astype(np.uint64) for _ in range(40)]
        side, members, size = rng.integers(0, 2, 40), rng.integers(1, 5, 40), np.array([len(x) + 1 for x in sets])
        got = ngram_join.cell_links(side, own, np.repeat(np.arange(40), [len(x) for x in sets]), np.concatenate(sets), size, members, 0.5)
        both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
        want = [sum(members[b] for b in range(40) if b != a and (own or side[a] != side[b]) and both(a, b) >= 0.5 * (size[a] + size[b] - both(a, b))) for a in range(40)]
        assert got.tolist() == want and sum(want)


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "doc_a long, doc_b long")
    got = {r["doc_id"]: r["root"] for r in ngram_join.components(pairs).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_one_of_each_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b c d", "y"), (None, "a b c d", "z"), (3, None, "w")], "doc_id long, text string, lost_id string")
    assert sorted((r["doc_id"] or 0, r["lost_id"]) for r in ngram_join.one_of_each(df).collect()) == [(0, "z"), (1, "x"), (3, "w")]


# --- 8 toxicity


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.classify(d, toxicity.fit(d, labels.filter("doc_id % 4 > 0"))).collect()}
    held = labels.filter("doc_id % 4 = 0").collect()
    hit = sum(got[r["doc_id"]] and r["toxic"] == 1 for r in held)
    flagged, toxic = sum(got[r["doc_id"]] for r in held), sum(r["toxic"] == 1 for r in held)
    assert hit / max(1, flagged) > 0.8 and hit / toxic > 0.8


def test_pooling_equals_a_loop_and_gradients_a_difference():
    rng = np.random.default_rng(24)
    net = toxicity.Network(rng.normal(0, 1, (1 << toxicity.BITS, toxicity.DIM)), [rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], [rng.normal(0, 0.5, toxicity.FILTERS) for _ in toxicity.WIDTHS], rng.normal(0, 1, toxicity.FILTERS * len(toxicity.WIDTHS)), rng.normal(0, 1, 1))
    texts = [rng.integers(0, 50, (n, 2)).astype(np.int32) for n in (1, 2, 3, 7, 20)]

    def pool(t):
        e, out = net.table[t[:, 0]] + net.table[t[:, 1]], []
        for w, f, bias in zip(toxicity.WIDTHS, net.filters, net.bias):
            seen = [bias + sum(e[i + j] @ f[j] for j in range(w)) for i in range(len(e) - w + 1)]
            out.append(np.maximum(np.max(seen, axis=0), 0) if seen else np.zeros(toxicity.FILTERS))
        return np.concatenate(out)

    first = np.append(0, np.cumsum([0, *map(len, texts)]))
    assert np.allclose(net.pooled(np.concatenate(texts), first), [np.zeros(24), *map(pool, texts)], atol=1e-4)
    y, weight = np.array([0, 1, 1, 0, 1]), np.array([1.0, 2, 1, 1, 3])

    def loss():
        z = np.array([pool(t) @ net.out + net.out_bias[0] for t in texts])
        return float(np.mean(weight * (np.log1p(np.exp(z)) - y * z)))

    g = toxicity.gradients(net, texts, y, weight)
    for name, w in [("out", net.out), ("out_bias", net.out_bias), *((f"f{k}", net.filters[k]) for k in range(3)), *((f"b{k}", net.bias[k]) for k in range(3)), ("table", net.table)]:
        for _ in range(8):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if name == "table":
                row = rng.integers(0, len(g["rows"]))
                at, found = (g["rows"][row], at[1]), g["table"][row, at[1]]
            else:
                found = g[name][at]
            kept = w[at]
            w[at] = kept + 1e-5
            up = loss()
            w[at] = kept - 1e-5
            down = loss()
            w[at] = kept
            assert abs((up - down) / 2e-5 - found) < 1e-4


def test_toxicity_on_odd_rows(spark):
    d = spark.createDataFrame(odd_rows(random.Random(25)) + [(10 + i, "you awful fool" if i % 2 else "a kind word", "en", i % 2, "x") for i in range(40)], ODD)
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(40)] + [(1, 0), (4, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    for given in (labels, labels.filter("toxic = 0"), labels.limit(0)):
        got = toxicity.classify(d, toxicity.fit(d, given)).collect()
        assert len(got) == 47 and not any(r["toxic"] for r in got if r["doc_id"] in (1, 2, 3))
        assert given is labels or not any(r["toxic"] for r in got)
        assert len({(r["score"], r["toxic"]) for r in got if (r["doc_id"] or 0) >= 10}) <= 2  # equal texts score equally
    assert toxicity.classify(d.limit(0), toxicity.fit(d.limit(0), labels)).count() == 0


def test_toxicity_learns_from_all_labelled_rows(spark):
    rng = random.Random(26)
    ids = [r[0] for r in spark.range(20_000).orderBy(F.xxhash64("id")).collect()]
    rows = []
    for k, i in enumerate(ids):  # the last 2,000 ids in order of hash have an insult that no other has
        word = "zorbface" if k >= 18_000 and k % 2 else "fool" if k % 10 == 1 else "kind"
        rows.append((i, f"{prose(rng, 5)} {word} {prose(rng, 5)}", "en", int(word != "kind")))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(d, d.select("doc_id", "toxic"))
    new = spark.createDataFrame([(i, f"{prose(rng, 5)} {('zorbface', 'fool', 'kind')[i % 3]} {prose(rng, 5)}", "en") for i in range(300)], "doc_id long, text string, lang string")
    got = [(r["doc_id"] % 3, r["toxic"]) for r in toxicity.classify(new, model).collect()]
    found = [sum(t for k, t in got if k == kind) for kind in range(3)]
    assert found[0] > 90 and found[1] > 90 and found[2] < 10


# --- 9 decontamination


def test_alignment_equals_plain_smith_waterman():
    rng = random.Random(10)
    for _ in range(30):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        best = 0
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        assert decontaminate.align(np.array(a), np.array(b)) == best


def test_whole_and_edited_items_are_found(spark):
    rng = random.Random(11)
    items = {i: prose(rng, 30, 3000) for i in range(12)}
    rows = []
    for i, t in items.items():
        w = t.split()
        edited = list(w)
        for k in (5, 15, 25):
            edited[k] = "changed"
        rows += [(10 * i, prose(rng, 200) + " " + t.upper() + ". " + prose(rng, 50)), (10 * i + 1, prose(rng, 20) + " " + " ".join(edited)), (10 * i + 2, prose(rng, 300))]
    rows += [(900, None), (901, ""), (None, items[0])]
    bench = spark.createDataFrame([*items.items(), (99, None), (98, ""), (None, "x")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert got == {(10 * i + k, i) for i in items for k in (0, 1)} | {(None, 0)}
    assert decontaminate.leaks(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.clean(docs(spark, rows), bench).count() == len(rows) - 25


def test_clean_judges_rows_not_ids(spark):
    rng = random.Random(18)
    item = prose(rng, 30, 3000)
    rows = [(1, item, "a"), (1, "other text", "b"), (None, item, "c"), (None, None, "d"), (2, item, "e"), (2, item, "f"), (3, "", "g"), (4, prose(rng, 60_000, 3000) + " " + item, "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    bench = spark.createDataFrame([(5, item), (5, item)], "item_id long, text string")
    assert sorted(r["sig"] for r in decontaminate.clean(d, bench).collect()) == ["b", "d", "g"]
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.leaks(d, bench).collect()) == [(0, 5), (1, 5), (2, 5), (4, 5)]
    assert decontaminate.clean(d.limit(0), bench).count() == 0 and decontaminate.clean(d, bench.limit(0)).count() == len(rows)


# --- 10 WARC


def test_archives_round_trip_and_resolve(spark, tmp_path):
    rows = [("a", "response", "http://x/\n1", "2024-01-02", None, b"HTTP/1.1 200 OK\r\n\r\nbody"), ("b", "response", None, "2024-01-01", None, b"HTTP/1.1 200 OK\r\n\r\nbody"), ("c", "revisit", "http://y", "2024-01-03", hashlib.sha1(b"body").hexdigest(), b"HTTP/1.1 304\r\n\r\n"), ("d", "revisit", "http://z", None, "0" * 40, None), ("e", "response", "http://e", "2024-01-01", None, None), ("a", "response", "http://x/\n1", "2024-01-02", None, b"HTTP/1.1 200 OK\r\n\r\nbody"), (None, "metadata", None, None, None, b"note")]
    df = spark.createDataFrame(rows, "record_id string, type string, url string, date string, digest string, block binary")
    index = warc.write(df.repartition(3), f"file://{tmp_path}/in")
    files = [r[0] for r in index.select("file").distinct().collect()]
    again = warc.headers(spark, files).filter("type <> 'warcinfo'")
    key = lambda r: repr(tuple((x or "").replace("\n", "%0A") if isinstance(x, str) or x is None else x for x in r))
    assert sorted(map(key, again.collect())) == sorted(map(key, index.collect()))
    out = warc.deduplicate(index, f"file://{tmp_path}/out")
    got = sorted(((r["record_id"] or "", r["type"], r["refers_to"]) for r in out.collect()), key=repr)
    assert got == sorted([("a", "revisit", "b"), ("a", "revisit", "b"), ("b", "response", None), ("c", "revisit", "b"), ("d", "revisit", None), ("e", "response", None), ("", "metadata", None)], key=repr)
    fresh = {r["record_id"]: r for r in warc.headers(spark, [r[0] for r in out.select("file").distinct().collect()]).collect() if r["type"] != "warcinfo"}
    assert fresh[warc.fresh("b")]["digest"] == hashlib.sha1(b"body").hexdigest() and fresh[warc.fresh("c")]["type"] == "revisit"
    assert warc.write(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_resolving_pages(spark):
    rng = random.Random(26)
    rows = [(i, f"http://x/{i}", rng.choice(["<p>a</p>", f"<p>{i}</p>", None, ""]), "x", 1) for i in range(60)] + [(60, None, "y" * 300_000, "x", 1), (None, "http://n", "z", "x", 1), (3, "http://x/3", "<p>a</p>", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, offset int")
    want = []
    made = [(*c[:4], hashlib.sha1(warc.split_http(c[5])[1]).hexdigest() if c[1] == "response" else c[4]) for i, u, h, *_ in rows if i is not None for c in warc.captures(i, u, h)]
    first = {}
    for c in sorted((c for c in made if c[1] == "response"), key=lambda c: (c[3], c[0])):
        first.setdefault(c[4], c[0])
    seen = set()
    for key, kind, url, date, digest in made:
        to = first.get(digest)
        itself = kind == "response" and to == key and key not in seen
        seen |= {key} if itself else set()
        want.append((key, "revisit" if to and not itself else kind, url, date, digest, None if itself or not to else to))
    got = [(r["record_id"], r["type"], r["url"], r["date"], r["digest"], r["refers_to"]) for r in warc.resolve_pages(pages).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.resolve_pages(pages.limit(0)).count() == 0


def test_substrings_of_odd_tables(spark):
    rng = random.Random(27)
    long = prose(rng, 30_000, 10**6)
    rows = [(2, long, "a", 1), (5, "start " + " ".join(long.split()[100:400]) + " end", "b", 2), (5, "start " + " ".join(long.split()[100:400]) + " end", "c", 2), (7, None, "d", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, sig string, spans int")
    got = sorted((r["doc_id"], r["text"], r["removed_words"]) for r in substring_dedup.deduplicated(d).collect() if r["text"])
    assert got == [(2, long, 0), (5, "start end", 300), (5, "start end", 300)]
    assert substring_dedup.deduplicated(d.limit(0)).count() == 0


def test_plain_archives_and_damage():
    one = warc.record([("WARC-Type", "response")], b"x" * 3000)
    assert [(a, n) for a, n, _ in warc.members(io.BytesIO(one * 3))] == [(k * len(one), len(one)) for k in range(3)]
    for bad in (one[:-10], warc.member(one)[:-5], b"junk" * 9, b"\x1f\x8b\x08" + b"\xff" * 40):
        with pytest.raises(ValueError, match="archive"):
            list(warc.members(io.BytesIO(bad)))
