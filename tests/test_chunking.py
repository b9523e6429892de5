from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.operators import chunking as C
from foliospark.sources import subtitles
from foliospark.streaming import incremental

PROSE = st.lists(st.sampled_from(["alpha beta.", "no end here", "漢字の文。", "\n\n", " ", "Is it? ", "word " * 300]), max_size=60).map("".join)


@settings(max_examples=60, deadline=None)
@given(PROSE)
def test_no_blank_or_repeated_chunks_and_no_lost_words(text):
    got = C.recursive(text)
    assert all(c.strip() for c in got)
    assert all(a != b for a, b in zip(got, got[1:]))
    assert bool(got) == bool(text.strip())


def test_budget_cuts_are_longest_prefixes():
    text = "x" * 5000 + "漢" * 900
    parts = list(C.by_budget(text))
    assert "".join(parts) == text
    assert all(C.tokens_of(p) <= C.MOST for p in parts)
    assert all(C.tokens_of(a + b[0]) > C.MOST for a, b in zip(parts, parts[1:]))


def test_timestamps_keep_header_and_seconds():
    (text, start, end), *more = C.timestamped("# Talk\n\n[00:05] a\n[1:00:07] b")
    assert text == "# Talk\n\n[00:05] a\n\n[1:00:07] b" and (start, end) == (5, 3607) and not more
    assert C.timestamped("no times") == []


def test_outline_paths():
    got = C.outlined("intro\n# A\nx\n## B\ny\n#### deep\n# C\nz")
    assert [(p, n) for p, n, _ in got] == [("", 0), ("A", 1), ("A > B", 2), ("C", 1)]
    assert got[2][2] == "## B\ny\n#### deep"


def test_chunks_of_null_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in C.chunk_recursive(docs).collect())
    assert got == [(0, "c"), (3, "a b"), (3, "a b")]
    assert C.chunk_recursive(docs.limit(0)).count() == 0


def test_srt_vtt_and_ass(spark):
    raw = "1\n00:00:01,000 --> 00:00:02,000\nhello\n<i>there</i>\n\nbad\n\n2\n01:30:05.500 --> 01:30:06,000\nbye\n\nno number\nstill text\n"
    vtt = "WEBVTT\n\nNOTE\nskip\n\n1\n00:01:00.000 --> 00:01:02.000\nhey\n"
    ass = "[Events]\nDialogue: 0,0:00:07.10,0:00:08.00,Default,,0,0,0,,{\\i1}so\\Nlong, and\nComment: x"
    df = spark.createDataFrame([(1, raw, "srt"), (2, None, "srt"), (3, "", "vtt"), (4, vtt, "VTT"), (5, ass, "ass"), (6, raw, "doc"), (None, ass, "ssa")], "id long, raw string, kind string")
    got = sorted((r["id"] or 0, r["cue"], r["start_seconds"], r["line"]) for r in subtitles.cues(df, "id", kind="kind").collect())
    assert got == [(0, 0, 7, "[00:07] so long, and"), (1, 0, 1, "[00:01] hello there"), (1, 1, 5405, "[90:05] bye"), (1, 2, None, "still text"), (4, 0, 60, "[01:00] hey"), (5, 0, 7, "[00:07] so long, and")]
    assert subtitles.srt(raw, False)[0] == (None, "hello there")
    assert subtitles.transcript(subtitles.cues(df, "id"), "id").filter("id = 1").first()["markdown"] == "## Transcript\n\n[00:01] hello there\n\n[90:05] bye\n\nstill text"
    media = spark.createDataFrame([("/a/x.mp4",), ("/a/y.mp4",)], "path string")
    subs = spark.createDataFrame([("/a/x.ja.srt",), ("/a/x.vtt",), ("/b/y.srt",)], "path string")
    assert {r["path"]: r["subtitle"] for r in subtitles.subtitle_of(media, subs).collect()} == {"/a/x.mp4": "/a/x.ja.srt", "/a/y.mp4": None}


def test_protected_blocks():
    lines = "a\n```\n| x |\n- y\n```\n| 1 |\n| 2 |\n- i\n  more\n* j\n\n> q\n>r\n1. n\n```\nopen".split("\n")
    assert C.protected(lines) == [(1, 4, "code"), (5, 6, "table"), (7, 9, "list"), (11, 12, "quote"), (13, 13, "list"), (14, 15, "code")]
    assert C.protected(lines, ("quote",)) == [(11, 12, "quote")]
    assert [k for k, _ in C.segments("\n".join(lines))] == ["text", "code", "table", "list", "quote", "list", "code"]


def test_blocks_over_their_limit():
    limits = C.Limits(overlap=0)
    rows = [f"| {i} " + "word " * 60 + "|" for i in range(20)]
    table = "\n".join(["| h |", "| --- |", *rows])
    got = C.recursive("# Title\n\n" + table, limits)
    assert len(got) > 2 and got[0].startswith("# Title\n| h |\n| --- |") and all("| h |\n| --- |" in c for c in got)
    assert [x for c in got for x in c.split("\n") if x in rows] == rows
    code = "```\n" + "x = 1\n" * 2000 + "```"
    assert C.recursive("intro\n\n" + code + "\n\nend", limits) == ["intro\n" + code, "end"]
    assert C.split_table("no table here", 50) == ["no table here"] and C.split_table("| h |\n| --- |", 50) == ["| h |\n| --- |"]
    assert C.split_table("lead\n| h |\n| --- |\n| 1 |\n| 2 |\ntrail", 512, True, 1) == ["lead\n| h |\n| --- |\n| 1 |", "| h |\n| --- |\n| 2 |\ntrail"]


def test_overlap_is_the_tail_of_the_chunk_before():
    paragraphs = [f"p{i} " + "word " * 90 for i in range(12)]
    alone = C.recursive("\n\n".join(paragraphs), C.Limits(overlap=0))
    got = C.recursive("\n\n".join(paragraphs))
    assert got[0] == alone[0] and all(g == C.tail(a, 50) + "\n\n" + b for g, a, b in zip(got[1:], alone, alone[1:]))
    assert C.tail("a\n\nb\n\n" + "w " * 500, 50) == "w " * 500


def test_small_sections_wait_and_tails_are_glued():
    body = "word " * 100
    got = C.headed(f"intro\n# A\n## B\n{body}\n## C\nsmall\n# D\n{body}\n# E\nend")
    assert [p.title_path for p in got] == ["A > B", "A > C"]
    assert got[0].text.startswith("intro\n\n# A\n\n## B") and got[1].text.endswith("# E\nend")
    assert [p.title_path for p in C.headed(f"# A\n# B\n{body}", C.Limits(lone_heading="keep"))] == ["A", "B"]
    assert [p.text for p in C.headed(f"x\n# B\n{body}", C.Limits(prelude="drop"))] == [f"# B\n{body.strip()}"]
    long = "# L\n" + "A sentence here. " * 300
    assert len(C.headed(long)) > 1 and {p.title_path for p in C.headed(long)} == {"L"}
    assert C.title_of(["A", "A > B", "C > D"]) == "A > B" and C.title_of(["", "A", "A"], "all") == "A" and C.title_of([]) == ""


def test_sheets_slides_and_routing():
    book = "## One\n\ntext\n\n| Cap |\n| --- |\n| a | b |\n| 1 | 2 |\n" + C.PAGE_BREAK + "\n| k | v |\n| --- | --- |\n| 1 | 2 |"
    got = [(p.sheet_name, p.text) for p in C.sheeted(book)]
    assert got == [("One", "## One\n\ntext"), ("One", "| Cap |\n| --- |\n| a | b |\n| 1 | 2 |"), ("Sheet 2", "| k | v |\n| --- | --- |\n| 1 | 2 |")]
    assert [n for n, _ in C.sheets("pre\n# A\nx\n## B\ny")] == ["", "A", "B"]
    assert C.slides("a\n---\nb\n---\nc") == ["a", "---\nb", "---\nc"] and C.slides("plain") == []
    assert C.slides("# Slide 1\nx\n# Slide 2\ny") == ["# Slide 1\nx", "# Slide 2\ny"]
    assert C.slide_title("<!-- x -->\n\n## T") == "T"
    assert [C.strategy_of("plain", k) for k in ("PPTX", "csv", "mp3", "png", "pdf", None)] == ["slide", "sheet", "timestamp", "whole", "recursive", "recursive"]
    assert C.structure_score("# a\n" + "w" * 600 + "\n# b\n" + "w" * 600 + "\n# c\n" + "w" * 600) == 3 and C.structure_score("# a\n#### b\nx") == 0 and C.structure_score("") == 1


def test_fragments_join_their_section():
    P = C.Piece
    big = "word " * 100
    got = C.settled([P("tiny", "A"), P(big, "A"), P("small", "A"), P("lone", "B"), P("<!-- image --> <!-- image -->\n\n\n\n\nx", "C"), P(big, "C")])
    assert [(p.title_path, p.text.split()[0]) for p in got] == [("A", "tiny"), ("B", "lone"), ("C", "<!--")]
    assert got[0].text.endswith("small") and got[2].text.startswith("<!-- image -->\n\nx\n\nword")
    assert C.same_section(P("", None, "s", 1), P("", None, "s", 2)) and not C.same_section(P("", "a"), P("", "b")) and C.same_section(P(""), P("", "b"))


def test_refine_pieces_cut_at_headings_outside_blocks():
    text = "# A\n" + "word " * 80 + "\n```\n# not here\n```\n# B\n" + "word " * 80 + "\n# C\nx"
    got = C.refine_pieces(text, 50)
    assert [p.split("\n")[0] for p in got] == ["# A", "# B", "# C"] and "# not here" in got[0]
    assert C.refine_pieces("no heading " * 500, 10) == [("no heading " * 500).strip()]


def test_auto_keeps_columns_and_refuses_clashes(spark):
    docs = spark.createDataFrame([(1, "a\n" + C.PAGE_BREAK + "\nb", "pptx", "x"), (2, "[00:01] hi", "mp4", None), (None, "plain", None, "y"), (3, None, "md", "z"), (4, " ", "md", "z")], "k long, markdown string, format string, extra string")
    got = sorted(((r["k"] or 0, r["strategy"], r["text"], r["extra"], r["slide_index"], r["start_seconds"]) for r in C.chunk_auto(docs, "k", keep=("extra",)).collect()), key=repr)
    assert got == [(0, "recursive", "plain", "y", None, None), (1, "slide", "a", "x", 0, None), (1, "slide", "b", "x", 1, None), (2, "timestamp", "[00:01] hi", None, None, 1)]
    try:
        C.chunk_recursive(docs.withColumnRenamed("extra", "tokens"), "k", "markdown", keep=("tokens",))
        raise AssertionError
    except ValueError as e:
        assert "tokens" in str(e)


def test_stream_chunks_each_content_once(spark, tmp_path):
    schema = "doc_id long, text string"
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([(1, "one."), (2, "two.")], schema).write.parquet(src)
    incremental.ingest(spark, src, schema, out, check)
    spark.createDataFrame([(1, "one."), (2, "two, changed."), (3, "three.")], schema).write.mode("append").parquet(src)
    incremental.ingest(spark, src, schema, out, check)
    incremental.ingest(spark, src, schema, out, check)
    got = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{out}/chunks").collect())
    assert got == [(1, "one."), (2, "two, changed."), (2, "two."), (3, "three.")]
