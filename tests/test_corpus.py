"""Corpus tables and expressions against brute force and known values."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from foliospark.functions import headers as H
from foliospark.functions import labels as L
from foliospark.functions import tables as T
from foliospark.functions import text as X
from foliospark.operators import budget, cleaning, corpus, knowledge, shapes, state

DATA = "/root/testdata/sf0.001"


def test_nearest_vectors_of_all(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    e = vectors.orderBy("vec_id").toPandas()
    x = np.array(e["embedding"].tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim, ids = np.round(x @ x.T, 6), e["vec_id"].to_numpy()
    np.fill_diagonal(sim, -9)
    got = {(r["probe_id"], r["place"]): r for r in corpus.vector_topk(vectors, vectors).collect()}
    assert len(got) == 10 * len(ids)
    for i, row in enumerate(sim):
        for place, j in enumerate(np.argsort(-row, kind="stable")[:10], 1):
            r = got[ids[i], place]
            assert abs(r["similarity"] - row[j]) < 2e-6 and abs(sim[i][np.searchsorted(ids, r["vec_id"])] - row[j]) < 2e-6


def test_vectors_in_small_blocks_and_without_similarity(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (1, 2, 100):
        got = {(r["probe_id"], r["place"]): (r["vec_id"], r["similarity"]) for r in corpus.vector_topk(df, df, 4, block).collect()}
        assert len(got) == 24 and [got[2, p][0] for p in (1, 2, 3, 4)] == [6, 1, 3, 4] and got[2, 4][1] is None
        assert [got[1, p][0] for p in (1, 2, 3)] == [2, 6, 3] and [got[4, p] for p in (1, 2)] == [(1, None), (2, None)]


def test_index_holds_all_keywords(spark):
    own = {s: [f"{s}word{i:02d}" for i in range(20)] for s in "abcd"}
    entries = spark.createDataFrame([(s, [" ".join(w * 2), "group", "everywhere" + " shared" * (s in "ab")]) for s, w in own.items()], "path string, sections array<string>")
    chunks = spark.createDataFrame([("a", "list", None), ("z", "elsewhere", "x"), ("b", None, None)], "source string, title_path string, sheet_name string")
    counts = knowledge.keyword_counts(knowledge.keyword_texts(entries, chunks))
    got = sorted(((r["keyword"], r["df"], r["path"]) for r in knowledge.postings(counts, knowledge.keyword_index(counts, entries)).collect()), key=lambda r: (-r[1], r[0], r[2]))
    assert got[:2] == [("shared", 2, "a"), ("shared", 2, "b")]
    assert got[2:] == sorted((w, 1, s) for s, words in own.items() for w in words)[:49]
    top = knowledge.top_keywords(counts).collect()
    assert sorted((r["path"], r["keyword"], r["times"], r["place"]) for r in top) == sorted((s, w, 2, i) for s, words in own.items() for i, w in enumerate(words[:15], 1))


def one(spark, column, **given):
    return spark.range(1).select(column(*[F.lit(v) for v in given.values()]).alias("x")).first()["x"]


def test_texts(spark):
    rows = [("090-1234-5678 and 4111 1111 1111 1111, 4111-1111-1111-1112 at 999.1.1.1 or 10.0.0.1 via http://a.b:80/x?y me@x.org",), (None,), ("",)]
    got = [r["x"] for r in spark.createDataFrame(rows, "t string").select(X.sanitized(F.col("t")).alias("x")).collect()]
    assert got == ["[PHONE] and [CREDIT_CARD], 4111-1111-1111-1112 at 999.1.1.1 or [IP_ADDRESS] via [URL] [EMAIL]", None, ""]
    kw = spark.createDataFrame([("DB2 in a Group of group の売上高に関する 東京 東",)], "t string").select(X.keywords_in(F.col("t")).alias("x")).first()["x"]
    assert kw == ["DB2", "Group", "売上高", "東京"]
    lang = spark.createDataFrame([("こんにちは" + " " * 300,), ("한국",), ("中文字",), ("plain text",), (" ",), ("123",), (None,)], "t string").select(X.detect_language(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in lang] == ["ja", "ko", "zh", "en", "unknown", "unknown", None]
    assert [r["x"] for r in spark.createDataFrame([("a",), ("漢",), ("ñ",), ("5",), ("\u20d0",), ("я",)], "t string").select(X.script_of(F.col("t")).alias("x")).collect()] == ["Latin", "Han", "Latin", "Common", "Other", "Cyrillic"]
    assert one(spark, X.nothing_added, a=" (No additional visual content). ") and not one(spark, X.nothing_added, a="more")


def test_rows_of_tables(spark):
    for line, want in (("| a | b | a | b |", "| a | b | a | b |"), ("| A | A | A | B | B | B |", "| A | B |"), ("| a | a | b |", "| a | a | b |"), ("x | x | x | x", "x | x | x | x"), ("| | | |", "| | | |")):
        assert one(spark, T.without_repeats, a=line) == want
    for line, want in (("| | | id | | A1 | | |", "| id | A1 |"), ("| n | | p |", "| n | p |"), ("| n | | p | q |", "| n | | p | q |"), ("| | None | |", ""), ("| --- | |", "| --- | |"), ("text", "text")):
        assert one(spark, T.without_empty, a=line) == want
    assert one(spark, T.clean_sheets, a="| x |\n| x |\n| a | b |\n| a | b |\n<!-- pagebreak -->\n| x |") == "| x |\n| a | b |\n| a | b |\n<!-- pagebreak -->\n| x |"
    assert one(spark, T.pairs_of, a="| k | v |\n| a | b | c |\n| k | | w |") == {"k": "w"}
    assert one(spark, T.cell_count, a="| a \\| b | c |") == 2 and one(spark, T.cell_text, a="3.0") == "3"


def test_labels(spark):
    for path, want in (("a/b.c.pdf", "b.c"), (".env", ".env"), ("x", "x"), ("d\\e f.md", "e f")):
        assert one(spark, L.stem, a=path) == want
    assert one(spark, L.suffix, a="A/B.TXT") == "txt" and one(spark, L.suffix, a=".env") == ""
    assert one(spark, L.chunk_id, a="in/a b.md", n=1234) == "a-b_chunk_1234" and one(spark, L.chunk_id, a="x.md", n=7) == "x_chunk_007"
    assert [one(spark, L.slug, a=x) for x in ("a b,c", "12", "x", " _ok_ ")] == ["a_b_c", None, None, "ok"]
    assert one(spark, L.inner_name, z="arc", a="sub/my file.v2.PDF") == "arc__sub_my file.v2.PDF"
    assert [one(spark, L.iso_date, a=x) for x in ("20240230", "20240229", "2024:01:02 03:04:05", "2024-01-02T03:04Z", "2024-13-01", "x", "")] == [None, "2024-02-29", "2024-01-02T03:04:05", "2024-01-02T03:04Z", None, None, None]
    assert [one(spark, L.seconds_of, a=x) for x in ("1:02:03", "2:03", "5", "a:1", "")] == [3723, 123, 5, None, None]
    assert [one(spark, L.clock, a=x) for x in (5, 65, 3605)] == ["00:05", "01:05", "1:00:05"] and one(spark, L.minutes, a=5405) == "90:05"
    assert [one(spark, L.yaml_scalar, a=x) for x in ("a", "a: b", "", "[x]", 'q"#', " s")] == ["a", '"a: b"', '""', '"[x]"', '"q\\"#"', '" s"']
    assert one(spark, lambda a, b: L.calls_phrase(a, b), a=1, b=2607) == "LLM: 1 call / 2,607 tok"
    violated = spark.createDataFrame([([("pages", 320.0, 100.0), ("size_mb", 120.5, 100.0)],)], "r array<struct<metric:string,value:double,threshold:double>>").select(L.violation_phrase(F.col("r"))).first()[0]
    assert violated == "pages=320 > 100; size_mb=120.5 > 100"


def test_headers_are_put_once(spark):
    line = "[关键实体: A — d]"
    for text in ("body", "[来源: s]\nbody", "[来源: s]"):
        put = one(spark, H.with_entities, a=text, b=line)
        assert line in put and one(spark, H.with_entities, a=put, b=line) == put and one(spark, H.without_entities, a=put).rstrip("\n") == text
    assert one(spark, H.with_title, a="x", o="/a/b.pdf", s=None, t="T") == "[b.pdf > T]\nx" and one(spark, H.with_title, a=" [Source: q]", o="b", s=None, t=None) == " [Source: q]"
    assert one(spark, H.shortened, a="abc " * 40).endswith("…") and one(spark, H.description_of, a="n\n d1 <SEP> d2") == "d1" and one(spark, H.description_of, a="n") == ""


def test_pages(spark):
    B = cleaning.PAGE_BREAK
    assert cleaning.strip_pages(f"H\na\n{B}\n H \n7\n{B}\nH\n# t\n{B}\n# t", numbers=True) == f"H\na\n{B}\n{B}\n# t\n{B}\n# t"
    assert cleaning.strip_pages(f"H\n{B}\nH") == f"H\n{B}\nH"
    assert cleaning.splice_frames("x\n[00:10] a\n[00:05] b", [0, 7, 20]) == f"x\n{B}\n{B}\n[00:10] a\n[00:05] b\n{B}"
    assert cleaning.described_only(f"a\n{cleaning.DESCRIBED}\n" + "d" * 300) == "d" * 300 and "a" in cleaning.described_only(f"a\n{cleaning.DESCRIBED}\nd")
    assert cleaning.name_sections(f"one{B}# Two\nx{B}", ["One", "Two", "Three", "Four"]) == f"\n## One\n\none\n{B}# Two\nx{B}\n## Three\n"
    pages = spark.createDataFrame([(f"a{B}b", [(1, "D1"), (3, "D3")]), ("plain ", [(0, "D")]), (f"a{B}b", [])], "t string, p array<struct<page:int,text:string>>")
    got = [r[0] for r in pages.select(cleaning.inject_descriptions(F.col("t"), F.col("p"))).collect()]
    assert got == [f"a{B}b\n\n{cleaning.DESCRIBED}\nD1\n\n<!-- vision-enriched page=4 (overflow) -->\nD3\n", "plain\n\n<!-- vision-enriched page=1 -->\nD\n", f"a{B}b"]
    charts = [r[0] for r in pages.select(cleaning.add_sections(F.col("t"), F.col("p"))).collect()]
    assert charts == [f"a{B}b\n\nD1\n", "plain\n\nD\n", f"a{B}b"]
    assert cleaning.is_generated_name("rich_cell-1") and not cleaning.is_generated_name("Day 5")


def test_repeating_lines_of_a_source(spark):
    rows = [(i, s, f"Head er\nown {i}\n# Title\n{'Header' if i == 3 else 'x'}") for i, s in ((1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, None), (6, None), (7, None))] + [(8, "a", None), (None, "a", "Head er"), (9, "a", "")]
    got = {r["doc_id"]: (r["text"], r["removed"]) for r in cleaning.strip_repeating(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[1] == (rows[0][2], 0) and got[2] == ("own 2\n# Title\nx", 1) and got[3] == ("own 3\n# Title", 2) and got[4][1] == 0
    assert got[5][1] == 0 and got[6] == ("own 6\n# Title", 2) and got[8] == (None, 0) and got[None] == ("Head er", 0) and got[9] == ("", 0)


def test_names_skip_those_taken(spark):
    paths = ["a.md", "a_1.md", "x/a.md", "a.pdf", "b.md", "a_1_1.md", "a_1.txt"]
    taken, want = set(), []
    for p in paths:
        stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        name, k = stem, 0
        while name in taken:
            k += 1
            name = f"{stem}_{k}"
        taken.add(name)
        want.append(f"{name}.md")
    got = knowledge.source_names(spark.createDataFrame(list(enumerate(paths)), "pos long, path string")).orderBy("pos").collect()
    assert [r["name"] for r in got] == want


def test_tags_aliases_and_guides(spark):
    merged = spark.range(1).select(knowledge.merged_tags(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("a"), F.lit("c"))).alias("x")).first()["x"]
    assert merged == ["A", "b", "c"]
    names = spark.createDataFrame([("Report", "REPORT ", "/x/report_v2.pdf"), ("Untitled1", None, "document3.doc"), ("T", "U", "final plan.md")], "a string, b string, p string").select(knowledge.aliases(F.col("a"), F.col("b"), F.col("p")).alias("x")).collect()
    assert [r["x"] for r in names] == [["Report", "report_v2"], [], ["T", "U", "final plan"]]
    guide = spark.createDataFrame([("q", "s", ["f"], ["e"]), ("q", "", ["f"], ["e"]), ("q", "s", [], ["e"]), (None, "s", ["f"], None)], "query_type string, strategy string, target_files array<string>, examples array<string>")
    assert knowledge.guide_entries(guide).count() == 1
    files = spark.createDataFrame([("a", "en", 0), ("a", "ja", 1), ("a", "ja", 2), ("b", "ko", 5), ("b", "en", 3), ("c", "", 0)], "source string, language string, chunk_index int")
    assert {r["source"]: r["language"] for r in knowledge.language_of(files).collect()} == {"a": "ja", "b": "en"}


def test_budgets(spark):
    prices = [("m-1", 1.0), ("m-1-pro", 2.0), ("_default", 9.0)]
    assert [budget.price(m, prices) for m in ("m-1-pro", "M-1-prox", "m", "z", "")] == [2.0, 1.0, 1.0, 9.0, 9.0] and budget.price("z", []) == 0.005
    got = budget.priced(spark.createDataFrame([("m-1-pro",), ("M-1-prox",), ("m",), ("z",), (None,)], "model string"), spark.createDataFrame([(i, *p) for i, p in enumerate(prices)], "pos int, name string, price double"))
    assert {r["model"]: r["price"] for r in got.collect()} == {"m-1-pro": 2.0, "M-1-prox": 1.0, "m": 1.0, "z": 9.0, None: 9.0}
    infos = spark.createDataFrame([("a", 150, 1.0), ("b", 400, None), ("c", None, 0.5)], "path string, pages long, est_cost_usd double")
    assert sorted((r["path"] or "", r["metric"], r["value"]) for r in budget.check(infos).collect()) == [("", "total_pages", 550.0), ("a", "pages", 150.0), ("b", "pages", 400.0)]
    assert budget.check(infos.limit(0)).count() == 0
    assert [budget.sample_pages(t, n) for t, n in ((0, 3), (2, 3), (10, 1), (10, 3), (100, 5))] == [[], [0, 1], [5], [0, 5, 9], [0, 25, 50, 75, 99]]
    assert [one(spark, lambda c, m=m: budget.refine_action(c, F.lit(1), m, 2.0), c=3.0) for m in ("off", "warn", "strict")] == ["ok", "warn", "block"]


def test_state(spark):
    assert state.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}} and state.nested({"a": {"b": 1}}, "a.b") == 1 and state.nested({"a": 1}, "a.b", 7) == 7
    assert state.config_hash({"a": 1, "z": 2}, ["a"]) == state.config_hash({"a": 1, "z": 3}, ["a"]) != state.config_hash({"a": 2}, ["a"])
    assert state.needed_outputs({"graph"}, {"graph": {"chunks"}, "chunks": {"sources"}, "sources": {"chunks"}}) == {"graph", "chunks", "sources"}
    entries = spark.createDataFrame([("a", hashlib.md5(b"x").hexdigest(), "h"), ("b", "old", "h"), ("c", hashlib.md5(b"z").hexdigest(), "other")], "chunk_id string, content_hash string, llm_config_hash string")
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "n")], "chunk_id string, text string")
    todo = state.uncached_chunks(chunks, entries, "h")
    assert sorted(r["chunk_id"] for r in todo.collect()) == ["b", "c", "d"]
    assert state.uncached_chunks(chunks, state.marked(entries, todo, "h"), "h").count() == 0


def test_shapes(spark):
    pages = spark.createDataFrame([(1, None, 5, 0), (1, 0, 1, 1), (1, 9, 0, 2)], "page int, top int, left int, pos int")
    assert [r["pos"] for r in shapes.reading_order(pages).orderBy("place").collect()] == [1, 0, 2]
    box = spark.range(1).select(shapes.on_picture(*[F.lit(x) for x in (10, 190, 20, 180, 100, 200, 1000)]).alias("b")).first()["b"]
    assert tuple(box) == (100.0, 100.0, 200.0, 200.0)
    sheets = spark.createDataFrame([(0, "A  b"), (1, "C"), (2, "A b ")], "pos int, sheet string")
    toc = spark.createDataFrame([(0, 1, "A b", 3), (1, 1, "A b", 9), (2, 2, "C", 5), (3, 1, None, 1)], "pos int, level int, title string, page int")
    assert [tuple(r) for r in shapes.sheet_pages(sheets, toc).collect()] == [("A b ", 3)]
    pictures = shapes.page_pictures(spark.createDataFrame([(1,), (1,), (2,)], "page int"), spark.createDataFrame([(1,), (3,)], "page int"))
    assert sorted(map(tuple, pictures.collect())) == [(1, 2), (2, 1), (3, 1)]
