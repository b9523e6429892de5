"""Files in, collections out: formats, archives, runs that use earlier ones again, exports."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark import engine
from foliospark.sources import files as sources
from foliospark.sources import office, output

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(*pairs):
    return "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>" + "".join(f"<Relationship Id='{i}' Target='{t}'/>" for i, t in pairs) + "</Relationships>"


def word():
    return zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>One two</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})


def book():
    sheet = f"<worksheet {S}><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='inlineStr'><is><t>n</t></is></c></row><row r='2'><c r='A2'><v>3.0</v></c><c r='C2'><v>2.5</v></c></row></sheetData><mergeCells><mergeCell ref='A1:A1'/><mergeCell ref='B1:C1'/></mergeCells></worksheet>"
    return zipped({"xl/workbook.xml": f"<workbook {S}><sheets><sheet name='One' sheetId='1' r:id='x'/><sheet name='Gone' state='hidden' r:id='x'/></sheets></workbook>", "xl/_rels/workbook.xml.rels": rels(("x", "worksheets/sheet1.xml")), "xl/sharedStrings.xml": f"<sst {S}><si><t>key</t></si></sst>", "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/_rels/sheet1.xml.rels": rels(("d", "../drawings/drawing1.xml"))})


def deck():
    shape = lambda y, text, kind="": f"<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x='0' y='{y}'/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda *s: f"<p:sld {P}><p:cSld><p:spTree>{''.join(s)}</p:spTree></p:cSld></p:sld>"
    return zipped({"ppt/presentation.xml": f"<p:presentation {P}><p:sldIdLst><p:sldId r:id='b'/><p:sldId r:id='a'/></p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": rels(("a", "slides/slide1.xml"), ("b", "/ppt/slides/slide2.xml")), "ppt/slides/slide1.xml": slide(shape(1, "last")), "ppt/slides/slide2.xml": slide(shape(9, "below"), shape(1, "Top", "<p:ph type='title'/>"))})


def test_office_files():
    assert office.docx(word()) == "# Title\n\nOne two\n\n- item\n\n| a\\|b |  |\n| --- | --- |\n| 1 |  |"
    assert office.xlsx(book()) == "## One\n\n| key | n | n |\n| --- | --- | --- |\n| 3 |  | 2.5 |"
    assert office.pptx(deck()) == "# Top\n\nbelow\n\n<!-- pagebreak -->\n\nlast" and office.drawings(book()) == {"drawing1.xml": 1}
    assert office.counts("docx", word())["pages"] == 1 and office.counts("xlsx", book()) == {"pages": 1, "total_rows": 2} and office.counts("pptx", deck()) == {"pages": 2, "chars_est": 12}
    c = "http://schemas.openxmlformats.org/drawingml/2006/chart"
    chart = f"<c:chartSpace xmlns:c='{c}' xmlns:a='http://schemas.openxmlformats.org/drawingml/2006/main'><c:chart><c:title><a:t>T</a:t></c:title><c:plotArea><c:barChart><c:ser><c:cat><c:strCache><c:pt><c:v>Q1</c:v></c:pt><c:pt><c:v>Q2</c:v></c:pt></c:strCache></c:cat><c:val><c:numCache><c:pt><c:v>1.0</c:v></c:pt></c:numCache></c:val></c:ser></c:barChart></c:plotArea><c:legend/></c:chart></c:chartSpace>"
    assert office.chart_table(chart.encode()) == "### Chart: T\n> type: bar · legend: yes\n\n| Category | Series 1 |\n| --- | --- |\n| Q1 | 1 |\n| Q2 |  |"
    x = "xmlns:xdr='http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing' xmlns:a='http://schemas.openxmlformats.org/drawingml/2006/main'"
    anchor = lambda kind, name, flip, text: f"<xdr:twoCellAnchor><xdr:{kind}><xdr:cNvPr name='{name}'/><a:xfrm {flip}><a:off x='1' y='2'/><a:ext cx='10' cy='20'/></a:xfrm>{text}</xdr:{kind}></xdr:twoCellAnchor>"
    boxes, lines = office.drawing(f"<xdr:wsDr {x}>{anchor('sp', 'b', '', '<a:t>hi</a:t>')}{anchor('cxnSp', 'c', 'flipH=\"1\"', '')}</xdr:wsDr>".encode())
    assert boxes == [{"name": "b", "text": "hi", "x": 1, "y": 2, "w": 10, "h": 20}] and lines == [{"name": "c", "sx": 11, "sy": 2, "ex": 1, "ey": 22}]


def test_archives_and_encodings():
    inner = zipped({"deep/x.txt": "deep"})
    raw = zipped({"a/b c.txt": "1", "__MACOSX/a": "no", "._h": "no", "in.zip": inner, "w.docx": word()})
    got = [(n, c[:4], e) for _, n, c, e in sources.members("/x/arc.zip", raw)]
    assert got == [("arc__a_b c.txt", b"1", ""), ("arc__in__deep_x.txt", b"deep", ""), ("arc__w.docx", b"PK\x03\x04", "")]
    assert "limit 1" in list(sources.members("a.zip", raw, most_files=1))[0][3] and "limit 3" in list(sources.members("a.zip", raw, most_bytes=3))[0][3]
    assert list(sources.members("a.zip", b"PK\x03\x04 broken"))[0][3].startswith("damaged archive")
    assert sources.member_name("日本.txt".encode("cp932").decode("cp437")) == "日本.txt" and sources.member_name("plain.txt") == "plain.txt"
    assert [sources.decoded(x)[1] for x in (b"a", "é".encode(), "日本".encode("cp932"), b"\0\1")] == ["utf-8", "utf-8", "cp932", "binary"]


def test_ingest_twice_and_export(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    (src / "sub").mkdir(parents=True)
    (src / "a.md").write_text("# A\n\n## B\n\nhello world " + "word " * 200)
    (src / "sub" / "a.md").write_text("other text of one name")
    (src / ".hidden.md").write_text("no")
    (src / "w.docx").write_bytes(word())
    (src / "x.xlsx").write_bytes(book())
    (src / "bad.pptx").write_bytes(b"PK\x03\x04 no")
    (src / "b.txt").write_bytes(b"\0\0")
    (src / "p.pdf").write_bytes(b"%PDF-1.4 no text")
    (src / "s.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhello\n")
    (src / "z.zip").write_bytes(zipped({"q.txt": "inside"}))
    made = engine.ingest(spark, [str(src)], out)
    chunks = {(r["original_file"], r["chunk_index"]): r for r in made.table("chunks").collect()}
    assert {k[0] for k in chunks} == {"a.md", "w.docx", "x.xlsx", "s.srt", "z__q.txt"}
    assert chunks["s.srt", 0]["text"] == "[来源: sources/s.md]\n## Transcript\n\n[00:01] hello" and chunks["x.xlsx", 0]["sheet_name"] == "One"
    s = made.summary()
    assert (s["total_files"], s["added"], s["failed"], s["cached"]) == (6, 6, 3, 0)
    assert {r["name"] for r in made.table("sources").collect()} >= {"a.md", "a_1.md"}
    (src / "sub" / "a.md").write_text("changed text")
    again = engine.ingest(spark, [str(src)], out)
    s = again.summary()
    assert (again.run, s["added"], s["cached"], s["failed"]) == (2, 1, 5, 3) and again.table("chunks").count() == made.table("chunks").count()
    assert {(r["original_file"], r["text"]) for r in again.table("chunks").collect()} >= {("w.docx", chunks["w.docx", 0]["text"])}
    assert engine.ingest(spark, [str(src)], out, {"limits": {"most": 300}}).summary()["updated"] == 6
    again.export(f"file://{tmp_path}/exported")
    back = output.read_files(spark, f"file://{tmp_path}/exported/sources").collect()
    assert len(back) == 6 and next(r for r in back if r["name"] == "w.md")["front"]["format"] == "docx" and next(r for r in back if r["name"] == "w.md")["tags"] == ["format/docx", "lang/unknown"]
    records = output.read_chunks(spark, f"file://{tmp_path}/exported/chunks")
    assert records.count() == again.table("chunks").count() and output.loaded(records, ["docx"]).count() == 1
    assert "| w.docx | docx |" in "".join((tmp_path / "exported" / "guide" / f.name).read_text() for f in (tmp_path / "exported" / "guide").glob("part-*"))
    assert [c.run for c in engine.collections(spark, f"file://{tmp_path}")] == [3]
    assert {r["page_content"] for r in engine.sourced(spark, f"file://{tmp_path}/exported/chunks")()} == {r["text"] for r in again.table("chunks").collect()}


def test_budget_refine_and_ask(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    (src / "t.csv").write_text("k,v\n" * 60_000)
    with pytest.raises(engine.BudgetExceeded, match="rows"):
        engine.ingest(spark, [str(src)], out)
    info = engine.inspect(spark, [str(src)]).first()
    assert info["total_rows"] == 60_000 and info["recommendation"].startswith("rows=60,000 > 50,000")
    (src / "t.csv").unlink()
    (src / "m.md").write_text("# A\n" + "apple " * 300 + "\n# B\n" + "pear " * 300)
    made = engine.ingest(spark, [str(src)], out)
    calls = tmp_path / "calls"

    def shout(prompt):
        with open(calls, "a") as f:
            f.write("x")
        return prompt.upper()

    for _ in range(2):
        got = engine.refine(made, shout, target=50, most=100, cache=f"file://{tmp_path}/answers").collect()
        assert len(got) == 1 and got[0]["text"].startswith("# A\nAPPLE") and "\n\n# B\nPEAR" in got[0]["text"]
    assert calls.read_text() == "xx"
    near = engine.ask(made, "pear", lambda texts: [[float(t.count("apple")), float(t.count("pear")), 1.0] for t in texts], k=1).collect()
    assert len(near) == 1 and "pear" in near[0]["text"]
    with pytest.raises(ValueError, match="graph"):
        engine.ask(made, "x", lambda t: [[1.0]], mode="local")


def test_front_matter_and_records(spark, tmp_path):
    text = spark.range(1).select(output.front_matter(F.lit("/a/b: c.pdf"), {"format": F.lit("pdf"), "title": F.lit(None).cast("string"), "pages": F.lit(3)}, {"tags": F.array(F.lit("a"), F.lit("b: c"))}, F.array(F.lit("careful")), F.create_map(F.lit("Make"), F.lit("X"))).alias("x")).first()["x"]
    assert text == '---\nsource: "b: c.pdf"\nformat: pdf\npages: 3\ntags:\n  - a\n  - "b: c"\nwarning: careful\nexif:\n  Make: X\n---'
    df = spark.createDataFrame([(text + "\nbody",), ("no front",)], "t string")
    got = df.select(output.front_fields(F.col("t")).alias("f"), output.front_tags(F.col("t")).alias("g"), output.body_of(F.col("t")).alias("b"), output.with_tags(F.col("t"), F.array(F.lit("z"))).alias("w")).collect()
    assert got[0]["f"] == {"source": "b: c.pdf", "format": "pdf", "pages": "3"} and got[0]["g"] == ["a", "b: c"] and got[0]["b"] == "body"
    assert got[0]["w"].endswith("tags:\n  - z\n---\nbody") and "b: c.pdf" in got[0]["w"] and got[1]["w"] == "no front" and got[1]["f"] == {}
    (tmp_path / "c.jsonl").write_text(json.dumps({"id": "a", "text": "one two three", "metadata": {"format": "PDF", "source": "s/x.md", "n": 1}}) + "\nbroken\n" + json.dumps({"id": "a", "text": "zz"}) + "\n" + json.dumps({"id": "b", "text": " "}) + "\n\n")
    records = output.read_chunks(spark, f"file://{tmp_path}/c.jsonl")
    assert records.count() == 3 and output.chunks_by_id(records).filter("id = 'a'").first()["text"] == "zz"
    assert [r["text"] for r in output.loaded(records, ["pdf"], 3).collect()] == ["[x.md]\none two three"]
