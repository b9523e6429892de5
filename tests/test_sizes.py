"""Queries on tables that the given ones don't have: odd rows, and sections, drawings and entities of any size."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliospark import registry
from foliospark.functions import tables as T
from foliospark.functions import text as X
from foliospark.operators import chunking, entities, shapes
from tests.test_queries import TABLES, rows

GIVEN = "/root/testdata/sf0.001"


def against_sql(spark, name, path, **made):
    """A query's rows with some tables made by SQL over the given ones, which must be those of its own statement."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{GIVEN}/{t}.parquet'")
    for t in TABLES:
        con.execute(f"COPY ({made.get(t, f'SELECT * FROM {t}')}) TO '{path}/{t}.parquet'")
    for t in made:
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = registry.queries()[name](spark, str(path))
    got = df.collect()
    assert rows(df.columns, map(tuple, got)) == rows(columns, want.fetchall())
    return got


def test_cache_keys_of_odd_rows(spark, tmp_path):
    odd = "SELECT * FROM documents UNION ALL SELECT * REPLACE (repeat(text, 500)[1:16384 + doc_id] AS text) FROM documents WHERE doc_id < 3 UNION ALL SELECT * REPLACE (CASE doc_id WHEN 3 THEN '' END AS text) FROM documents WHERE doc_id IN (3, 4) UNION ALL SELECT * REPLACE (NULL AS doc_id) FROM documents WHERE doc_id = 5"
    assert len(against_sql(spark, "cache_keys", tmp_path, documents=odd)) > 200


def test_merged_headings_of_large_sections(spark, tmp_path):
    many = "SELECT * REPLACE (c_custkey + i * 1000 AS c_custkey) FROM customer, range(200) r(i)"
    got = against_sql(spark, "chunk_heading_merged", tmp_path, customer=many)
    assert max(r["tokens"] for r in got) > chunking.MOST
    # elsewhere such sections are cut
    text = "\n\n".join(r["text"] for r in got)
    assert max(chunking.tokens_of(p.text) for p in chunking.headed(text, chunking.Limits(overlap=0))) <= chunking.DEFAULT.ceiling("text")


def test_nearest_boxes_of_crowded_drawings(spark, tmp_path):
    one = "SELECT * REPLACE ({k} + i * {n} AS {k}, 1 AS {nation}) FROM {t}, range({times}) r(i)"
    boxes = one.format(t="supplier", k="s_suppkey", n=10, nation="s_nationkey", times=60)
    lines = one.format(t="customer", k="c_custkey", n=150, nation="c_nationkey", times=40)
    assert against_sql(spark, "connector_nearest", tmp_path, supplier=boxes, customer=lines)


def test_nearest_looks_at_few_boxes():
    rng, looked = np.random.default_rng(1), []
    whole = shapes._distances

    def counted(x, y, right, top, at, to):
        out = whole(x, y, right, top, at, to)
        looked.append(out.size)
        return out

    def run(n, side):
        looked.clear()
        px, py, x, y = rng.integers(0, 200_000, (4, n))
        w, h = rng.integers(1, side, (2, n))
        shapes._distances = counted
        try:
            found, far = shapes.nearest(px, py, x, y, w, h)
        finally:
            shapes._distances = whole
        for i in range(0, n, n // 50):
            d = whole(x, y, x + w, y + h, (px[i], py[i]), (px[i], py[i]))
            assert found[i] == d.argmin() and far[i] == d.min()
        return sum(looked)

    for side in (50, 60_000):
        assert run(16_000, side) < 8 * run(4_000, side)  # pairs are sixteen times as many


def test_entities_leave_descriptions_behind(spark):
    rng = np.random.default_rng(2)
    some = [(int(p), f" n{p % 7}", f"n\nd{rng.integers(3)}", "<SEP>".join(f"g{g}" for g in rng.integers(0, 40, rng.integers(0, 4)))) for p in rng.integers(0, 30, 80)]
    some += [(None, "a", "a\nb", "g1"), (31, None, "a\nb", "g1"), (32, "a", None, "g1<SEP> <SEP>g9"), (33, "a", "b", None)]
    known = [(f"g{g}", f"c{g % 15}") for g in range(30)] + [("g1", "c2")]
    made = spark.createDataFrame(some, "pos long, entity_name string, content string, source_id string")
    got = entities.inverted(made, spark.createDataFrame(known, "graph_id string, chunk_id string"))
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    at = {(p, n.strip(), d.split("\n")[1] if d else "", c) for p, n, d, s in some if n and s and p is not None for g in s.split("<SEP>") for k, c in known if k == g.strip()}
    alone = Counter(p for p, *_ in at)
    want = {}
    for p, n, d, c in sorted(at):
        want.setdefault((c, n), (c, n, d, alone[p] == 1))
    assert sorted(map(tuple, got.collect())) == sorted(want.values()) and any(x[3] for x in want.values())
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert sum("description#" in x for x in moved) <= 3  # the entities' own, twice, and the rows that come out


def test_injected_entities_move_once_by_chunk(spark, tmp_path):
    twice = "SELECT * FROM lineitem UNION ALL SELECT * REPLACE (l_partkey % 50 AS l_partkey) FROM lineitem"
    against_sql(spark, "entity_inject", tmp_path, lineitem=twice)
    df = registry.queries()["entity_inject"](spark, str(tmp_path))
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning(chunk_id") <= 2  # entities of chunks, and chunks


def test_rows_are_split_once(spark, tmp_path):
    line = F.col("l_comment")
    assert [str(change(line)).count("split(") for change in (T.without_repeats, T.without_empty)] == [1, 1]
    odd = ["| a | a | a | b |", "| a | A | a |", "|a|a|　a　|", "  | x | x | x |", "| a |  | a | a | a |", "plain", "|", "", None, "| | |", "| --- | --- |", "| | none | | x |", "| None | |"]
    df = spark.createDataFrame([(x,) for x in odd], "x string").select("x", T.without_repeats(F.col("x")).alias("r"), T.without_empty(F.col("x")).alias("e"))
    same = {x: (x, x) for x in odd}
    want = {**same, "| a | a | a | b |": ("| a | b |", odd[0]), "|a|a|　a　|": ("| a |", odd[2]), "  | x | x | x |": ("| x |", odd[3]), odd[4]: ("| a |", odd[4]), "|": ("|", ""), "| | none | | x |": (odd[11], "| x |"), "| None | |": (odd[12], "")}
    assert {r["x"]: (r["r"], r["e"]) for r in df.collect()} == want


def test_chunks_leave_in_bounded_batches(spark):
    class Docs:
        """What stands for a table: gives the function over batches itself."""

        schema = spark.createDataFrame([], "doc_id long, text string").schema
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    texts = ["".join(f"Sentence {i} of some length. " for i in range(4000)), None, "short", ""] * 25
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "fold_text": texts})
    out = list(chunking.chunk_recursive(Docs())(iter([batch])))
    assert max(b.nbytes for b in out) < 3 << 20 and len(out) > 2
    got = pa.Table.from_batches(out).to_pylist()
    assert [(r["doc_id"], r["text"]) for r in got] == [(i, c) for i, t in enumerate(texts) if t for c in chunking.recursive(t)]


def test_scripts_are_counted_once(spark):
    rng = np.random.default_rng(3)
    points = [c for spans in X.SCRIPTS.values() for a, b in spans for c in (a, b, (a + b) // 2)] + [0x530, 0x1680, 0x1F600]
    texts = ["".join(map(chr, rng.choice(points, n))) for n in (1, 5, 60, 400)] + ["", None, "plain words", "αβ words", "  ", "ÄÖ"]

    def script(c):
        return next((n for n, spans in X.SCRIPTS.items() if any(a <= ord(c) <= b for a, b in spans)), "Other")

    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("n", X.script_counts(F.col("t")))
    for r in df.select("t", "n", X.unexpected_ratio(F.col("t"), ["Latin"]).alias("a"), X.unexpected_ratio(F.col("t"), ["Latin"], F.col("n")).alias("b")).collect():
        assert r["n"] == dict(Counter(map(script, r["t"] or ""))) and r["a"] == r["b"]
    plan = registry.queries()["script_ratio"](spark, GIVEN)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= len(X.SCRIPTS) + 1
