"""Settings, steps, equations, models and the graph."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from foliospark import __main__ as cli
from foliospark import hooks, models, settings
from foliospark.operators import entities, graph
from foliospark.sources import equations

M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def tex(body):
    return equations.inline(ET.fromstring(f"<m:oMath {M}>{body}</m:oMath>"))


def r(t):
    return f"<m:r><m:t>{t}</m:t></m:r>"


def test_equations():
    e = lambda x: f"<m:e>{x}</m:e>"
    assert tex(f"<m:f><m:num>{r('a')}</m:num><m:den>{r('b_1')}</m:den></m:f>") == "$\\frac{a}{b\\_1}$"
    assert tex(f"<m:sSup>{e(r('x'))}<m:sup>{r('2')}</m:sup></m:sSup>{r('≤')}<m:rad><m:deg>{r('3')}</m:deg>{e(r('y'))}</m:rad>") == "$x^{2}\\leq \\sqrt[3]{y}$"
    assert tex(f"<m:nary><m:naryPr><m:chr m:val='∑'/></m:naryPr><m:sub>{r('i=0')}</m:sub><m:sup>{r('n')}</m:sup>{e(r('i'))}</m:nary>") == "$\\sum_{i=0}^{n} i$"
    assert tex(f"<m:d><m:dPr><m:begChr m:val='['/><m:endChr m:val=''/></m:dPr>{e(r('x'))}{e(r('y'))}</m:d>") == "$\\left[x, y\\right.$"
    assert tex(f"<m:func><m:fName>{r('sin')}</m:fName>{e(r('θ'))}</m:func>") == "$\\sin \\theta$"
    assert tex(f"<m:func><m:fName><m:limLow>{e(r('lim'))}<m:lim>{r('x→0')}</m:lim></m:limLow></m:fName>{e(r('f'))}</m:func>") == "$\\lim_{x\\rightarrow 0} f$"
    assert tex(f"<m:m><m:mr>{e(r('1'))}{e(r('0'))}</m:mr><m:mr>{e(r('0'))}{e(r('1'))}</m:mr></m:m>") == "$\\begin{matrix}1 & 0 \\\\ 0 & 1\\end{matrix}$"
    assert tex(f"<m:acc><m:accPr><m:chr m:val='⃗'/></m:accPr>{e(r('v'))}</m:acc><m:bar><m:barPr><m:pos m:val='top'/></m:barPr>{e(r('z'))}</m:bar>") == "$\\vec{v}\\overline{z}$"
    assert tex("") == ""


def test_settings(tmp_path):
    assert [settings.value_of(x) for x in ("Yes", "off", "~", "-3", "1.5", "1e3", "gpt-4", "1-2", "e")] == [True, False, None, -3, 1.5, 1000.0, "gpt-4", "1-2", "e"]
    assert settings.from_environment({"foliospark__Limits__MOST": "300", "FOLIOSPARK__model": "Big", "OTHER": "1", "FOLIOSPARK__": "x"}) == {"limits": {"most": 300}, "model": "Big"}
    (tmp_path / "s.json").write_text('{"limits": {"most": 1, "least": 2}}')
    assert settings.load({"limits": {"overlap": 5}}, str(tmp_path / "s.json"), {"FOLIOSPARK__limits__most": "7"}, {"limits.least": 9}) == {"limits": {"overlap": 5, "most": 7, "least": 9}}
    with pytest.raises(FileNotFoundError):
        settings.load({}, str(tmp_path / "none.json"))
    assert settings.outputs_for(purpose="search") == ({"chunks", "index"}, {"chunks", "index", "sources"}) and settings.outputs_for(["guide"], "read")[1] >= {"guide", "keywords", "index"}
    assert settings.outputs_for()[0] == set(settings.OUTPUTS)
    for bad in ({"outputs": ["x"]}, {"purpose": "x"}):
        with pytest.raises(ValueError, match="unknown"):
            settings.outputs_for(**bad)
    assert cli.doctor()["packages"]["pyspark"]


def test_steps(spark):
    def bad(_, __):
        raise RuntimeError

    steps = hooks.Steps().before("none", ["*"], lambda e, b: None).before("bad", ["md"], bad).before("up", ["*"], lambda e, b: b.upper()).after("bad", ["*"], bad).after("same", ["*"], lambda e, t: t).after("mark", ["md"], lambda e, t: t + "!").after("late", ["*"], lambda e, t: "x" + t, "pre_write")
    assert steps.open("md", b"a") == (b"A", "up") and hooks.Steps().open("md", b"a") == (b"a", None)
    df = spark.createDataFrame([("md", "a"), ("txt", "b"), (None, None)], "format string, text string")
    got = hooks.applied(hooks.applied(df, steps), steps, "pre_write").collect()
    assert [(x["text"], x["transformations"]) for x in got] == [("xa!", ["post_parse:mark", "pre_write:late"]), ("xb", ["pre_write:late"]), (None, [])]
    line = hooks.lineage(spark.createDataFrame([("s.md", "s.pdf", "slide", ["a:b"])], "source string, original_file string, strategy string, transformations array<string>")).first()["lineage"]
    assert line["transformations"] == ["a:b", "chunker:slide"] and line["original_input"]["filename"] == "s.pdf"
    with pytest.raises(ValueError, match="phase"):
        steps.after("x", ["*"], lambda e, t: t, "never")


def test_chains_limits_and_retries():
    assert [m["model"] for m in models.chain({"primary": {"provider": "p", "model": "a"}, "fallback": {"provider": "p", "model": "b"}})] == ["a", "b"]
    for bad in (None, {}, {"primary": {"provider": "p"}}):
        with pytest.raises(ValueError, match="model"):
            models.chain(bad)
    task = {"max_retries": 0, "_defaults": {"max_response_tokens": 5}}
    assert [models.setting(task, "max_response_tokens", 1), models.setting(task, "max_retries", 2), models.setting(None, "x", 3), models.setting(task, "x", 3, 4)] == [5, 0, 3, 4]
    assert models.for_format({"model": "a", "formats": {"pdf": {"model": "b", "triage": 1}}}, "PDF")["model"] == "b"
    calls = []

    def flaky(prompt, most):
        calls.append(most)
        if len(calls) < 2:
            raise OSError("down")
        return models.Answer(prompt * most, ended="length" if most == 1 else "stop")

    assert models.complete([flaky], "a", 1, 3, wait=0).text == "aaa" and calls == [1, 1, 3]
    with pytest.raises(RuntimeError, match="down"):
        models.complete([lambda p, m: (_ for _ in ()).throw(OSError("down"))], "a", retries=1, wait=0)
    assert models.batched(30, 2) and not models.batched(3, 2, 2.0) and not models.batched(9, None)
    assert models.sound_spans(1300.0) == [(0.0, 600.0), (600.0, 1200.0), (1200.0, 1300.0)] and models.sound_spans(0) == []


def test_calls_as_tables(spark):
    def model(prompt, most):
        if "bad" in prompt:
            raise OSError("no")
        return models.Answer(prompt.upper(), len(prompt), 1)

    got = {x["key"]: x for x in models.called(spark.createDataFrame([("a", "hi"), ("b", "bad")], "key string, prompt string"), [model]).collect()}
    assert got["a"]["answer"] == "HI" and got["b"]["answer"] is None and "no" in got["b"]["error"]
    log = spark.createDataFrame([("m", 5, 1, False), ("m", 7, 2, True), ("n", 1, 1, None)], "model string, prompt_tokens long, answer_tokens long, hit boolean")
    assert {(x["model"], x["calls"], x["cache_hits"], x["total_tokens"]) for x in models.usage(log).collect()} == {("m", 1, 1, 6), ("n", 1, 0, 2), (None, 2, 1, 8)}
    pages = spark.createDataFrame([(1, k, bytes([k]), None if k == 2 else f"t{k}") for k in range(1, 6)], "doc_id long, page int, picture binary, text string")
    batches = models.batch_requests(pages, 2).orderBy("batch").collect()
    assert [len(b["pictures"]) for b in batches] == [2, 2, 1] and batches[0]["text"] == "[page 1]\nt1\n\n[page 2]\n(empty)" and len({b["hash"] for b in batches}) == 3
    c = [F.lit("m"), F.lit("h"), F.lit("t"), F.lit("d")]
    keys = spark.range(1).select(models.page_key(*c).alias("a"), models.page_key(c[0], c[1], F.lit("other"), c[3]).alias("b"), models.page_key(*c, rest_only=True).alias("c"), models.page_key(c[0], c[1], F.lit("other"), c[3], rest_only=True).alias("d"), models.page_prompt(F.lit(" "), F.lit("x")).alias("p")).first()
    assert keys["a"] == keys["b"] and len({keys["a"], keys["c"], keys["d"]}) == 3 and "(empty)" in keys["p"]
    heard = models.transcribed(spark.createDataFrame([("a", b"x"), ("b", None)], "path string, content binary"), lambda raw: [(0.5, " hi "), (65.0, "you")])
    assert [x["line"] for x in heard.orderBy("cue").collect()] == ["[00:00] hi", "[01:05] you"]


def test_graph_is_built_in_steps(spark, tmp_path):
    log, at = tmp_path / "log", f"file://{tmp_path}/graph"

    def extract(text):
        with open(log, "a") as f:
            f.write("x")
        names = [w for w in text.split() if w.istitle()]
        return [(n, f"{n} in {text}") for n in names], list(zip(names, names[1:], ["next"] * 9))

    chunks = spark.createDataFrame([("c1", "Ann meets Bob"), ("c2", "Bob rests"), ("c3", None)], "chunk_id string, text string")
    assert not graph.status(at)["built"]
    first = graph.build(chunks, extract, at)
    assert (first["chunks_extracted"], first["entities"], first["relations"]) == (3, 2, 1) and log.read_text() == "xxx"
    changed = spark.createDataFrame([("c1", "Ann meets Bob"), ("c2", "Bob and Cy rest")], "chunk_id string, text string")
    second = graph.build(changed, extract, at)
    assert (second["chunks_extracted"], second["chunks_cached"], second["entities"]) == (1, 1, 3) and len(log.read_text()) == 4
    assert graph.build(changed, extract, at, {"model": "other"})["chunks_extracted"] == 2 and graph.build(changed, extract, at, {"model": "other"}, force=True)["chunks_cached"] == 0
    hits = graph.hits(spark, at)
    assert entities.top(hits, 1).count() == 2
    assert {(x["chunk_id"], x["name"], x["exclusive"]) for x in hits.collect()} == {("c1", "Ann", True), ("c1", "Bob", False), ("c2", "Bob", False), ("c2", "Cy", True)}
    assert [(x["source"], x["target"]) for x in graph.neighbours(spark, at, ["Cy"]).collect()] == [("Bob", "Cy")]
    assert graph.query_mode("full", " Mix ") == "mix"
    with pytest.raises(ValueError, match="global"):
        graph.query_mode("vector_only", "global")
    files = spark.createDataFrame([("b", "ja"), ("a", "EN"), ("c", ""), ("d", "ja")], "path string, language string")
    assert [graph.language_name(x, files) for x in (None, "default", "de", "Latin", "auto")] == [None, None, "German", "Latin", "Japanese"]
