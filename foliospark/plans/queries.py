"""Registered queries over the given tables, each with an independent DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import tables as T
from foliospark.functions import text as X
from foliospark.functions import labels as L
from foliospark.operators import budget, chunking, cleaning, corpus, entities
from foliospark.sources.tables import outlines, part_tables, table, transcripts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_WIDE = r"[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{AC00}-\x{D7AF}\x{20000}-\x{2FA1F}]"


def _tok(t: str, wide: str = _WIDE) -> str:
    n = f"len(regexp_extract_all({t}, '{wide}'))"
    return f"trunc({n} * 1.5::DOUBLE + (length({t}) - {n}) * 0.25::DOUBLE)::INTEGER"


def _est(t: str) -> str:
    return f"greatest(1, {_tok(t)})"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
SELECT doc_id, {_est('text')} AS tokens,
  CASE WHEN length(text) = 0 THEN 0 ELSE {_tok('text', r'[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]')} END AS loader_tokens,
  CASE WHEN length(ink) = 0 THEN 'unknown' WHEN len(regexp_extract_all(ink, '[\\x{{3040}}-\\x{{30FF}}\\x{{31F0}}-\\x{{31FF}}]')) > 0.05 * length(ink) THEN 'ja'
       WHEN len(regexp_extract_all(ink, '[\\x{{AC00}}-\\x{{D7AF}}]')) > 0.05 * length(ink) THEN 'ko'
       WHEN len(regexp_extract_all(ink, '[\\x{{4E00}}-\\x{{9FFF}}]')) > 0.10 * length(ink) THEN 'zh'
       WHEN len(regexp_extract_all(ink, '[A-z]')) > 0.5 * length(ink) THEN 'en' ELSE 'unknown' END AS language
FROM (SELECT doc_id, text, regexp_replace(text[1:2000], '\\s+', '', 'g') AS ink FROM documents)
""")
def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(t).alias("tokens"), X.loader_tokens(t).alias("loader_tokens"), X.detect_language(t).alias("language"))


#: texts as they are, with cards in groups, a phone number, an address beyond its range and a URL behind some
_MARKED_UP = "concat(text, CASE doc_id % 4 WHEN 0 THEN ' 4111 1111 1111 1111, 4111-1111-1111-1112, 4012888888881881.' WHEN 1 THEN ' call 090-1234-5678 or 0120-123-456' WHEN 2 THEN ' 999.999.999.999 10.0.0.255 https://x.example.org:8080/a?b=c d@e.org' ELSE '' END)"
_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
_LINK = "https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^ \\n]*)?"
_CARD = "\\b[0-9]{4}[ \\n-]?[0-9]{4}[ \\n-]?[0-9]{4}[ \\n-]?[0-9]{1,7}\\b"
_BYTE = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_HOST = f"\\b{_BYTE}\\.{_BYTE}\\.{_BYTE}\\.{_BYTE}\\b"
_PHONE = "\\b0[0-9]{1,4}[- ()\\n]{1,2}[0-9]{1,4}[- \\n][0-9]{3,4}\\b"
_LUHN = "length({c}) >= 13 AND list_sum(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN (length({c}) - i) % 2 = 0 THEN {c}[i]::INTEGER WHEN {c}[i]::INTEGER >= 5 THEN {c}[i]::INTEGER * 2 - 9 ELSE {c}[i]::INTEGER * 2 END)) % 10 = 0"
_RULED = f"""
WITH a AS (SELECT doc_id, {_MARKED_UP} AS t0 FROM documents),
b AS (SELECT *, regexp_replace(t0, '{_MAIL}', '[EMAIL]', 'g') AS t1 FROM a),
c AS (SELECT *, regexp_replace(t1, '{_LINK}', '[URL]', 'g') AS t2 FROM b),
m AS (SELECT *, list_transform(regexp_extract_all(t2, '{_CARD}'), lambda x: {{'raw': x, 'd': regexp_replace(x, '[^0-9]', '', 'g')}}) AS cards FROM c),
n AS (SELECT *, list_transform(cards, lambda x: {{'raw': x.raw, 'ok': {_LUHN.format(c='x.d')}}}) AS judged FROM m),
o AS (SELECT *, array_to_string(list_transform(list_zip(regexp_split_to_array(t2, '{_CARD}'), judged), lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' WHEN z[2].ok THEN '[CREDIT_CARD]' ELSE z[2].raw END), '') AS t3 FROM n),
p AS (SELECT *, regexp_replace(t3, '{_HOST}', '[IP_ADDRESS]', 'g') AS t4 FROM o)
"""


@query(_RULED + f"""
SELECT doc_id, len(regexp_extract_all(t0, '{_MAIL}'))::INTEGER AS email, len(regexp_extract_all(t1, '{_LINK}'))::INTEGER AS url, len(list_filter(judged, lambda x: x.ok))::INTEGER AS credit_card,
  len(regexp_extract_all(t3, '{_HOST}'))::INTEGER AS ipv4, len(regexp_extract_all(t4, '{_PHONE}'))::INTEGER AS phone_jp FROM p
""")
def sanitize_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.pii_table(table(spark, d, "documents").select("doc_id", F.expr(_MARKED_UP).alias("text")), "text").drop("text", "masked")


@query(_RULED + f"SELECT doc_id, regexp_replace(t4, '{_PHONE}', '[PHONE]', 'g') AS text FROM p")
def sanitize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.sanitized(F.expr(_MARKED_UP)).alias("text"))


_SPLIT = f"""
WITH RECURSIVE d AS (SELECT doc_id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM documents),
s AS (SELECT doc_id, CASE
    WHEN {_est('t')} <= 512 THEN [t]
    WHEN regexp_matches(t, '[。．.!！?？]\\s+') THEN list_filter(list_transform(string_split(regexp_replace(t, '([。．.!！?？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '')
    ELSE list_transform(range(0, ((length(t) + 2050) // 2051)::BIGINT), lambda i: t[i * 2051 + 1:(i + 1) * 2051]) END AS parts FROM d WHERE t <> ''),
p AS (SELECT doc_id, unnest(parts) AS piece, unnest(range(1, len(parts) + 1)) AS pos FROM s),
n AS (SELECT doc_id, pos, piece, {_est('piece')} AS n FROM p),
f AS (
  SELECT doc_id, pos, n AS held, 1 AS chunk FROM n WHERE pos = 1
  UNION ALL
  SELECT n.doc_id, n.pos, CASE WHEN held + n.n > 512 AND (held >= 100 OR held + n.n > 768) THEN n.n ELSE held + n.n END,
         chunk + CASE WHEN held + n.n > 512 AND (held >= 100 OR held + n.n > 768) THEN 1 ELSE 0 END
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.pos = f.pos + 1),
c AS (SELECT doc_id, chunk, string_agg(piece, chr(10) || chr(10) ORDER BY pos) AS text FROM f JOIN n USING (doc_id, pos) GROUP BY doc_id, chunk),
b AS (SELECT doc_id, chunk, piece, pos, n.n, sum(n.n) OVER (PARTITION BY doc_id, chunk ORDER BY pos DESC) AS behind FROM f JOIN n USING (doc_id, pos)),
t AS (SELECT doc_id, chunk, string_agg(piece, chr(10) || chr(10) ORDER BY pos) AS tail FROM b WHERE behind <= 50 OR behind = n GROUP BY doc_id, chunk),
o AS (SELECT c.doc_id, c.chunk, coalesce(t.tail || chr(10) || chr(10), '') || c.text AS text FROM c LEFT JOIN t ON t.doc_id = c.doc_id AND t.chunk = c.chunk - 1)
"""


def _numbered(of: str) -> str:
    return f""", k AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk) AS before FROM {of}),
u AS (SELECT doc_id, chunk, text FROM k WHERE before IS NULL OR before <> text),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1)::INTEGER AS chunk_index, count(*) OVER (PARTITION BY doc_id)::INTEGER AS total_chunks, {_est('text')} AS tokens, text FROM u)
"""


_ALONE = _SPLIT + _numbered("c")
NO_OVERLAP = chunking.Limits(overlap=0)


@query(_ALONE + "SELECT * FROM chunks")
def chunk_recursive_pack(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_recursive(table(spark, d, "documents"), limits=NO_OVERLAP)


@query(_SPLIT + _numbered("o") + "SELECT * FROM chunks")
def chunk_recursive_overlap(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_recursive(table(spark, d, "documents"))


@query(_ALONE + """
SELECT lang, count(*) AS chunks, count(DISTINCT c.doc_id) AS docs, sum(tokens)::BIGINT AS tokens, max(tokens) AS longest, min(tokens) AS shortest
FROM chunks c JOIN documents USING (doc_id) GROUP BY lang
""")
def chunk_statistics(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.chunk_recursive(table(spark, d, "documents"), limits=NO_OVERLAP, keep=("lang",)).drop("text")
    return chunks.groupBy("lang").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"), F.min("tokens").alias("shortest"))


@query(_ALONE + """
SELECT 'doc-' || c.doc_id || '_chunk_' || CASE WHEN chunk_index < 1000 THEN lpad(chunk_index::VARCHAR, 3, '0') ELSE chunk_index::VARCHAR END AS chunk_id, c.doc_id, md5('[source: ' || coalesce(source, '') || ']' || chr(10) || c.text) AS content_key
FROM chunks c JOIN documents USING (doc_id)
""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.chunk_recursive(table(spark, d, "documents"), limits=NO_OVERLAP, keep=("source",))
    header = F.concat(F.lit("[source: "), F.coalesce("source", F.lit("")), F.lit("]\n"), "text")
    path = F.concat(F.lit("in/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return chunks.select(L.chunk_id(path, F.col("chunk_index")).alias("chunk_id"), "doc_id", F.md5(header).alias("content_key"))


@query(f"""
WITH RECURSIVE l AS (
  SELECT conv_id, turn * 7 AS sec, '[' || CASE WHEN turn * 7 // 60 < 10 THEN '0' ELSE '' END || (turn * 7 // 60) || ':' || lpad((turn * 7 % 60)::VARCHAR, 2, '0') || '] ' || coalesce(role, '') || ': ' || replace(coalesce(text, ''), chr(10), ' ') AS line,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
n AS (SELECT *, {_est('line')} AS n FROM l),
f AS (
  SELECT conv_id, pos, n AS held, 1 AS chunk FROM n WHERE pos = 1
  UNION ALL
  SELECT n.conv_id, n.pos, CASE WHEN held + n.n > 512 THEN n.n ELSE held + n.n END, chunk + CASE WHEN held + n.n > 512 THEN 1 ELSE 0 END
  FROM f JOIN n ON n.conv_id = f.conv_id AND n.pos = f.pos + 1),
c AS (SELECT conv_id, chunk, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS text, min(sec) AS start_seconds, max(sec) AS end_seconds FROM f JOIN n USING (conv_id, pos) GROUP BY conv_id, chunk)
SELECT conv_id, (chunk - 1)::INTEGER AS chunk_index, count(*) OVER (PARTITION BY conv_id)::INTEGER AS total_chunks, {_est('text')} AS tokens, text, start_seconds, end_seconds FROM c
""")
def chunk_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_timestamps(transcripts(table(spark, d, "conversations")), "conv_id")


@query(f"""
WITH b AS (SELECT s_nationkey, string_agg(s_name, ', ' ORDER BY s_suppkey) AS body FROM supplier GROUP BY s_nationkey),
s AS (
  SELECT r_regionkey::BIGINT AS doc_id, -1 AS n, r_name AS title_path, 1 AS level, '# ' || r_name AS text FROM region
  UNION ALL
  SELECT r_regionkey, n_nationkey, r_name || ' > ' || n_name, 2, '## ' || n_name || coalesce(chr(10) || chr(10) || body, '')
  FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN b ON s_nationkey = n_nationkey)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INTEGER AS chunk_index, count(*) OVER (PARTITION BY doc_id)::INTEGER AS total_chunks, {_est('text')} AS tokens, text, title_path, level FROM s
""")
def chunk_heading_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_outline(outlines(*(table(spark, d, t) for t in ("nation", "region", "supplier"))), "doc_id")


@query(f"""
WITH RECURSIVE l AS (SELECT regexp_replace(p_brand, '[^0-9]', '', 'g')::BIGINT AS brand_no, '| ' || p_partkey || ' | ' || p_name || ' |' AS line, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM part),
n AS (SELECT *, {_est('line')} AS n FROM l),
f AS (
  SELECT brand_no, pos, n AS held, 1 AS chunk FROM n WHERE pos = 1
  UNION ALL
  SELECT n.brand_no, n.pos, CASE WHEN held + n.n > 505 THEN n.n ELSE held + n.n END, chunk + CASE WHEN held + n.n > 505 THEN 1 ELSE 0 END
  FROM f JOIN n ON n.brand_no = f.brand_no AND n.pos = f.pos + 1),
c AS (SELECT brand_no, chunk, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS text FROM f JOIN n USING (brand_no, pos) GROUP BY brand_no, chunk)
SELECT brand_no, (chunk - 1)::INTEGER AS chunk_index, count(*) OVER (PARTITION BY brand_no)::INTEGER AS total_chunks, {_est('text')} AS tokens, text FROM c
""")
def table_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_tables(part_tables(table(spark, d, "part")), "brand_no")


def _row_cells(array: str) -> str:
    """Cells of a made-up row: parted repeats, runs, a short row, an empty cell."""
    a, b = "l_returnflag", "l_linestatus"
    forms = (f"{a}, {b}, {a}, {b}, {a}", f"{a}, {a}, {a}, {b}, {b}, {b}, ''", f"{a}, {a}, {b}", f"'x', '', 'x', 'x', 'x', {b}")
    return "CASE l_linenumber % 4 " + " ".join(f"WHEN {i} THEN {array}({x})" for i, x in enumerate(forms)) + " END"


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {_row_cells('list_value')} AS c FROM lineitem),
f AS (SELECT *, list_filter(c, lambda x: x <> '') AS whole FROM r),
k AS (SELECT *, list_filter(whole, lambda x, i: i = 1 OR x <> whole[i - 1]) AS kept FROM f)
SELECT l_orderkey, l_linenumber, '| ' || array_to_string(CASE WHEN len(whole) > 2 AND len(kept) < len(whole) AND len(kept) * 2 <= len(whole) THEN kept ELSE c END, ' | ') || ' |' AS line FROM k
""")
def denoise_rows(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("| "), F.array_join(F.expr(_row_cells("array")), " | "), F.lit(" |"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.without_repeats(line).alias("line"))


_MARKED = "concat(text, CASE doc_id % 5 WHEN 0 THEN ' [?] [?]' WHEN 1 THEN ' [unreadable seal]' ELSE '' END)"


@query(f"""
WITH q AS (SELECT source, {_MARKED} AS t FROM documents),
a AS (SELECT source, count(*) AS files, count(*) FILTER (regexp_matches(t, '\\[\\?\\]|(?i)\\[unreadable\\b[^\\]]*\\]')) AS with_issues, coalesce(sum(len(regexp_extract_all(t, '\\[\\?\\]'))), 0)::BIGINT AS unsure, coalesce(sum(len(regexp_extract_all(t, '(?i)\\[unreadable\\b[^\\]]*\\]'))), 0)::BIGINT AS unreadable FROM q GROUP BY source)
SELECT *, round_even(greatest(0, 1 - (unsure + 2 * unreadable)::DOUBLE / files / 20), 3) AS score FROM a
""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return corpus.quality_report(table(spark, d, "documents").withColumn("text", F.expr(_MARKED)))


_INFO_SQL = """
WITH i AS (SELECT doc_id::VARCHAR AS path, ceil(n_chars / 200)::BIGINT AS pages, n_chars AS chars_est, (doc_id % 70000) AS total_rows, n_chars / 20000.0::DOUBLE AS est_cost_usd FROM documents),
v AS (SELECT path, 'pages' AS metric, pages::DOUBLE AS value, 100::DOUBLE AS threshold FROM i UNION ALL SELECT path, 'chars_est', chars_est, 500000 FROM i
  UNION ALL SELECT path, 'rows', total_rows, 50000 FROM i UNION ALL SELECT path, 'est_cost_usd', est_cost_usd, 2 FROM i
  UNION ALL SELECT NULL, 'total_pages', sum(pages), 500 FROM i UNION ALL SELECT NULL, 'total_files', count(*), 100 FROM i UNION ALL SELECT NULL, 'total_est_cost_usd', round(sum(est_cost_usd), 4), 10 FROM i)
SELECT * FROM v WHERE value > threshold
"""


@query(_INFO_SQL)
def safety_violations(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    infos = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.ceil(n / 200).alias("pages"), n.alias("chars_est"), (F.col("doc_id") % 70_000).alias("total_rows"), (n / 20_000.0).alias("est_cost_usd"))
    return budget.check(infos)


@query(f"""
SELECT source, sum({_est('text')})::BIGINT AS tokens, sum(CASE WHEN {_est('text')} > 50000 THEN ceil({_est('text')} / 8000) ELSE 1 END)::BIGINT AS calls,
       round(sum(CASE WHEN {_est('text')} > 50000 THEN ceil({_est('text')} / 8000) ELSE 1 END)::BIGINT * 0.002::DOUBLE, 4) AS cost
FROM documents WHERE text IS NOT NULL GROUP BY source
""")
def refine_cost(spark: SparkSession, d: str) -> DataFrame:
    return budget.refine_cost(table(spark, d, "documents"))


@query("SELECT event_type AS model, count(*) AS calls, sum(event_id % 1000)::BIGINT AS tokens, grouping(event_type) = 1 AS total FROM events GROUP BY ROLLUP (event_type)")
def token_usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return corpus.usage_rollup(table(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("tokens")))


@query("""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS spot FROM documents),
k AS (SELECT *, CASE WHEN length(trim(line)) BETWEEN 1 AND 120 AND NOT regexp_matches(trim(line), '^(#|\\||>|\\*|-|```|<!--)') THEN regexp_replace(line, '\\s+', '', 'g') END AS key FROM l),
h AS (SELECT source, key, min({'d': doc_id, 'a': spot}) AS first FROM k WHERE key IS NOT NULL GROUP BY source, key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, spot, line, first IS NOT NULL AND first <> {'d': k.doc_id, 'a': spot} AS gone FROM k LEFT JOIN h ON h.source IS NOT DISTINCT FROM k.source AND h.key = k.key)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (NOT gone), '') AS text, count(*) FILTER (gone)::INTEGER AS removed FROM j GROUP BY doc_id
""")
def strip_repeating(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.strip_repeating(table(spark, d, "documents").select("doc_id", "source", "text")).drop("source")


@query("""
WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0),
b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.doc_id IS NULL THEN 'new' WHEN a.text IS NOT DISTINCT FROM b.text THEN 'cached' ELSE 'modified' END AS action
FROM a FULL JOIN b ON a.doc_id = b.doc_id
""")
def cache_partition(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    after = docs.filter("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return corpus.state_diff(docs.filter("doc_id % 7 <> 0"), after)


@query("""
WITH p AS (SELECT vec_id AS probe_id, embedding AS probe FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT probe_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], probe::DOUBLE[]), 6) AS similarity FROM embeddings JOIN p ON probe_id <> vec_id)
SELECT probe_id, vec_id, similarity, (row_number() OVER (PARTITION BY probe_id ORDER BY similarity DESC, vec_id))::INTEGER AS place FROM s QUALIFY place <= 10
""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return corpus.vector_topk(e, e.filter("vec_id % 100 = 0"))  # the query set of searches, against all rows


@query("""
WITH m AS (SELECT DISTINCT l_orderkey AS chunk_id, p_name AS entity FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT entity, count(DISTINCT chunk_id) AS chunks FROM m GROUP BY entity)
SELECT chunk_id, entity, chunks, (row_number() OVER (PARTITION BY chunk_id ORDER BY chunks, length(entity), entity))::INTEGER AS place FROM m JOIN n USING (entity) QUALIFY place <= 5
""")
def entity_topn(spark: SparkSession, d: str) -> DataFrame:
    lines, part = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "part").select("p_partkey", "p_name")
    return entities.entity_topn(lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("chunk_id"), F.col("p_name").alias("entity")))
