"""The pipeline's stages against plain Python, on a small corpus with odd rows."""

import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_brute import brute_groups, gram_set, prose, words_of  # noqa: E402

from foliospark.llm import decontaminate, packing, quality, secrets, tokens  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, lost_id int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(30)
    item = prose(rng, 30, 3000)
    key = "".join(rng.choices("0123456789abcdef", k=40))
    base = [prose(rng, 60, 3000) for _ in range(40)]
    texts = [*base, *base[:10], *(t + " more words" for t in base[:8]), base[11] + " " + item, item, f"token {key} " + prose(rng, 60, 3000), *(f"{'#' * 9} !! {i} $$" for i in range(30)), "", None, " ", base[13] + "\n\u00a0\n" + prose(rng, 4000, 3000)]
    rows = [(i, t, "en", None if i % 7 == 0 else "web", len(t or ""), "x", i) for i, t in enumerate(texts)]
    rows += [(None, item + " tail", "en", "web", 1, "y", 0), (None, base[14], None, None, None, None, None), (3, base[3], "en", "web", 1, "z", 0), (12, "another text of one id " + prose(rng, 40, 3000), "en", "web", 1, "z", 0)]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(not (t or "#").startswith("#"))) for i, t in enumerate(texts)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "a b c")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, item, key


def stage_input(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def kept_rows(df):
    assert df.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    return [tuple(r) for r in df.collect()]


def test_stages_equal_plain_python(spark, corpus):
    d, rows, item, key = corpus
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "packing"]

    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    good = model.score(quality.statistics(words_of([r[1] or "" for r in rows]))) >= model.threshold
    want = [r for r, g in zip(rows, good) if g]
    got = kept_rows(steps["quality_classifier"](spark, docs, d))
    assert sorted(got, key=repr) == sorted(want, key=repr) and not any((r[1] or "").startswith("#") for r in want) and len(want) > 50

    sets = {}
    for r in want:
        if r[0] is not None:
            sets[r[0]] = sets.get(r[0], set()) | gram_set(r[1] or "")
    root = brute_groups(sets)
    want = [r for r in want if r[0] is None or root[r[0]] == r[0]]
    got = kept_rows(steps["ngram_jaccard_join"](spark, stage_input(spark, got), d))
    assert sorted(got, key=repr) == sorted(want, key=repr)

    bench = decontaminate.items([1], [item])
    leaked = {k for k, r in enumerate(want) if any(decontaminate.leaks_of(decontaminate.plain(words_of([r[1] or ""])), bench, 0.5))}
    assert len(leaked) >= 2 and any(want[k][0] is None for k in leaked)
    want = [r for k, r in enumerate(want) if k not in leaked]
    got = kept_rows(steps["benchmark_decontamination"](spark, stage_input(spark, got), d))
    assert sorted(got, key=repr) == sorted(want, key=repr)

    masked = kept_rows(steps["secret_scan"](spark, stage_input(spark, got), d))
    want = [(r[0], r[1] and r[1].replace(key, secrets.MASK), *r[2:4], r[1] and len(r[1].replace(key, secrets.MASK)), *r[5:]) for r in want]
    assert sorted(masked, key=repr) == sorted(want, key=repr) and any(secrets.MASK in (r[1] or "") for r in want)

    bpe = tokens.encoding(tokens.VOCABULARY)
    windows = steps["packing"](spark, stage_input(spark, masked), d).collect()
    cells = sorted((-1 if i is None else i, s, n) for w in windows for i, s, n in zip(w["doc_ids"], w["starts"], w["lengths"]))
    sizes = [(-1 if r[0] is None else r[0], len(bpe.encode_ordinary(r[1] or ""))) for r in want]
    assert cells == sorted((i, s, min(2048, n - s)) for i, n in sizes for s in range(0, n, 2048)) and all(w["fill"] == sum(w["lengths"]) <= 2048 for w in windows)
    # the run as a whole packs the same cells
    ran = corpus_pipeline.run(spark, d).collect()
    assert sorted((-1 if i is None else i, s, n) for w in ran for i, s, n in zip(w["doc_ids"], w["starts"], w["lengths"])) == cells


def test_stages_on_empty_tables(spark, corpus, tmp_path):
    d = corpus[0]
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0, name
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name in ("quality_classifier", "benchmark_decontamination"):
        assert dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).count() == docs.count()


def test_pack_is_best_fit_of_one_stream(spark):
    rng = np.random.default_rng(31)
    sizes = [(int(i), int(n)) for i, n in enumerate(rng.integers(1, 100, 300))]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long").coalesce(1), window=100, places=5, packers=1).collect()
    p = packing.Packer(100, 5)
    out = [w for w in (p.add((i, 0, n)) for i, n in sizes) if w]
    rest = packing.merge([(sum(x[2] for x in w), (0, len(out) + k), w) for k, w in enumerate(p.rest())], 100)
    assert sorted(tuple(r["doc_ids"]) for r in got) == sorted(tuple(x[0] for x in w) for w in [*out, *rest])
