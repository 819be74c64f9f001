"""Queries of segments, labels, shapes, columns, history and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as h
from ..operators import recognizers_more as m
from ..operators import segments as s
from ..operators import tables as tb
from . import inputs as i
from .detection import N, spans_sql
from .detection import query as _query
from .inputs import derived

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    return _query(name, sql, QUERIES, ORACLES)


OUT = ["id", "entity_type", "start_pos", "end_pos", "value", "score"]
LICENCE_HIT = "(" + " OR ".join(f"contains(lower(text), '{w.replace(chr(39), chr(39) * 2)}')" for w in m.LICENCE_WORDS) + ")"
PASSPORT_HIT = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in m.PASSPORT_WORDS) + ")"
SAME = f"len(list_distinct(string_split({N}, ''))) = 1"


@query("dt24_licence", "SELECT * FROM (" + spans_sql(i.LICENCE, r"\b\d{4}[\s.\-]?\d{4}[\s.\-]?\d{4}(?:[\s.\-]?\d{2})?\b|\b\d{12,14}\b", f"id, 'ID_SIM' AS entity_type, start_pos, end_pos, value, (CASE WHEN {SAME} OR NOT {LICENCE_HIT} THEN 0 WHEN regexp_matches(lower(text), '\\bsim\\s*(b1|b2|a|b|c|d)\\b') THEN 0.8 ELSE 0.7 END)::DOUBLE AS score") + ") AS y WHERE score > 0")
def dt24(spark, d):
    return m.licence(derived(spark, d, i.LICENCE)).select(*OUT)


@query("dt25_passport", "SELECT * FROM (" + spans_sql(i.LICENCE, r"(?i)\b[A-Z][\s.\-]?\d{7}\b", f"id, 'ID_PASSPORT' AS entity_type, start_pos, end_pos, value, CASE WHEN {SAME} OR {N} = '1234567' THEN 0 ELSE round(0.4 + CASE WHEN upper(left(value, 1)) IN ('A','B','C','M','N','P','R','S','T','X') THEN 0.2 ELSE 0.05 END + CASE WHEN {PASSPORT_HIT} THEN 0.25 ELSE -0.1 END, 6) END::DOUBLE AS score") + ") AS y WHERE score > 0")
def dt25(spark, d):
    return m.passport(derived(spark, d, i.LICENCE)).select(*OUT)


LABELS = "SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'Nama  Pasien' WHEN 1 THEN 'No HP' WHEN 2 THEN 'jenis kelamin' WHEN 3 THEN 'Tgl Lahir' WHEN 4 THEN 'nomor KK keluarga' WHEN 5 THEN 'E-mail kantor' WHEN 6 THEN p_type WHEN 7 THEN 'Alamat' ELSE 'NIK' END AS label, CASE p_partkey % 2 WHEN 0 THEN '1990-01-02' ELSE ' ' || p_name END AS text FROM part"


def label_sql(label: str) -> str:
    norm = f"regexp_replace(trim(lower({label})), '\\s+', ' ', 'g')"
    arms = "".join(" WHEN " + " OR ".join(f"{norm} = '{w}' OR starts_with({norm}, '{w} ') OR contains(' ' || {norm}, ' {w}')" for w in words) + f" THEN '{e}'" for words, e in m.LABEL_TYPES)
    return f"CASE WHEN {norm} IN ({','.join(repr(x) for x in m.PLAIN_LABELS)}) THEN NULL{arms} END"


@query("cx08_labels", f"SELECT id, {label_sql('label')} AS entity_type FROM ({LABELS}) AS x")
def cx08(spark, d):
    return derived(spark, d, LABELS).select("id", m.label_type(F.col("label")).alias("entity_type"))


@query("cx08_typed_cells", f"SELECT id, entity_type, 0::BIGINT AS start_pos, length(text)::BIGINT AS end_pos, trim(text) AS value FROM (SELECT *, {label_sql('label')} AS entity_type FROM ({LABELS}) AS x) WHERE entity_type IS NOT NULL AND (entity_type <> 'DATE_OF_BIRTH' OR regexp_matches(trim(text), '\\d{{4}}[\\-/]\\d{{1,2}}[\\-/]\\d{{1,2}}'))")
def cx08_cells(spark, d):
    return m.typed_cells(derived(spark, d, LABELS)).select("id", "entity_type", "start_pos", "end_pos", "value")


PEOPLE = "SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'Budi Santoso' WHEN 1 THEN 'Demam Tinggi' WHEN 2 THEN 'Jalan Merdeka' WHEN 3 THEN 'Nama Pasien' WHEN 4 THEN 'Al' WHEN 5 THEN 'Siti Nur Aini Dewi Lestari' WHEN 6 THEN c_name ELSE 'NIK Mock' END AS value FROM customer"


COMMON = ["nama", "pasien", "nik", "nama pasien"]


def words_sql(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


NOT_A_PERSON = f"""SELECT id, v = '' OR list_contains({words_sql(COMMON)}, v) OR regexp_matches(value, '[0-9|:=/@#(){{}}<>\\[\\]\\n\\r\\\\]') OR len(list_intersect(t, {words_sql(m.PLACE_WORDS)})) > 0 OR len(t) > 4 OR (len(t) = 1 AND length(t[1]) <= 2)
 OR len(list_filter(t, lambda x: NOT list_contains({words_sql(COMMON)}, x))) = 0 OR len(list_intersect(t, {words_sql(m.CLINICAL_WORDS)})) > 0
 OR (len(list_intersect(t, {words_sql(m.LABEL_PARTS)})) > 0 AND len(list_filter(t, lambda x: NOT list_contains({words_sql([*COMMON, *m.LABEL_PARTS])}, x))) = 0) AS dropped
 FROM (SELECT *, list_filter(regexp_split_to_array(v, '[\\s\\-]+'), lambda x: x <> '') AS t FROM (SELECT *, regexp_replace(lower(trim(value)), '\\s+', ' ', 'g') AS v FROM ({PEOPLE}) AS p))"""


@query("fl05_person_filter", NOT_A_PERSON)
def fl05(spark, d):
    return derived(spark, d, PEOPLE).select("id", m.not_a_person(F.col("value"), COMMON).alias("dropped"))


LINES = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Nama: ' || o_orderpriority WHEN 1 THEN 'kunci = ' || o_orderstatus || ' x' WHEN 2 THEN 'sebuah kalimat yang terlalu panjang : nilai' WHEN 3 THEN 'tanpa pemisah' ELSE 'a | b | c' END AS text FROM orders"
KV = "'^(.{1,30}?)\\s*[:=|]\\s*(.+)$'"


@query("sg02_key_value", f"SELECT id, trim(regexp_extract(text, {KV}, 1)) AS key, trim(regexp_extract(text, {KV}, 2)) AS value FROM ({LINES}) AS x WHERE regexp_matches(text, {KV}) AND (lower(trim(regexp_extract(text, {KV}, 1))) = 'nama' OR length(trim(regexp_extract(text, {KV}, 1))) <= 25)")
def sg02(spark, d):
    return derived(spark, d, LINES).select("id", s.key_value(F.col("text")).alias("kv")).where("kv is not null").select("id", "kv.key", "kv.value")


@query("sg01_paragraphs", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
 o AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - length(line) - 1)::BIGINT AS start_pos FROM l)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::BIGINT AS idx, regexp_replace(line, '^ +| +$', '', 'g') AS text, start_pos + length(line) - length(ltrim(line, ' ')) AS start_pos FROM o WHERE trim(line) <> ''""")
def sg01(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return s.paragraphs(docs, "doc_id")


@query("sg05_neighbours", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
 p AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::BIGINT AS idx, regexp_replace(line, '^ +| +$', '', 'g') AS text FROM l WHERE trim(line) <> '')
SELECT doc_id, idx, md5(coalesce(lag(text) OVER w, '')) AS before, md5(coalesce(lead(text) OVER w, '')) AS behind FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""")
def sg05(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    h = lambda c: F.md5(F.coalesce(c, F.lit("")).cast("binary"))
    return s.with_context(s.paragraphs(docs, "doc_id"), "doc_id").select("doc_id", "idx", h(F.col("previous_text")).alias("before"), h(F.col("next_text")).alias("behind"))


def html_sql() -> str:
    out = "html"
    for p, to in ((r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|li|tr|h[1-6])>", "\n"), (r"<[^>]+>", "")):
        out = f"regexp_replace({out}, '{p}', '{to}', 'g')"
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&apos;", "''"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{to}')"
    for p, to in ((r"[ \t\r\f\x0b]+", " "), (r"\n{3,}", "\n\n"), (r"^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$", "")):
        out = f"regexp_replace({out}, '{p}', '{to}', 'g')"
    return out


@query("src15_html_text", f"SELECT page_id, length(t)::BIGINT AS n, md5(t) AS hash FROM (SELECT page_id, {html_sql()} AS t FROM pages)")
def src15(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", s.html_to_text(F.col("html")).alias("text"))
    return pages.select("page_id", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("hash"))


SHAPES = "SELECT l_orderkey AS slide, ((l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey) AS shape, CAST(l_partkey % 7 AS BIGINT) * 200000 AS x, CAST(l_suppkey % 5 AS BIGINT) * 250000 AS y, CAST(300000 AS BIGINT) AS width, CAST(100000 AS BIGINT) AS height, l_partkey % 3 = 0 AS is_label FROM lineitem"
DX, DY = "greatest(b.x - a.x - a.width, a.x - b.x - b.width, 0)", "greatest(b.y - a.y - a.height, a.y - b.y - b.height, 0)"


@query("sp02_relations", f"""WITH s AS ({SHAPES}), p AS (SELECT a.slide, a.shape AS shape_a, b.shape AS shape_b, sqrt(({DX})::DOUBLE * {DX} + ({DY})::DOUBLE * {DY}) AS dist, abs(a.y - b.y) <= 50000 AS line, abs(a.x - b.x) <= 50000 AS col, a.x AS ax, b.x AS bx, a.y AS ay, b.y AS bfy FROM s a JOIN s b ON a.slide = b.slide AND a.shape <> b.shape),
 r AS (SELECT *, CASE WHEN line THEN CASE WHEN bx + 300000 <= ax THEN 'left_of' WHEN bx >= ax + 300000 THEN 'right_of' ELSE 'same_line' END WHEN col THEN CASE WHEN bfy + 100000 <= ay THEN 'above' WHEN bfy >= ay + 100000 THEN 'below' ELSE 'same_column' END ELSE 'adjacent' END AS relation FROM p WHERE dist <= 914400)
SELECT slide, shape_a, shape_b, relation, round(dist, 3) AS distance, round(MAP {{'left_of': 0.9, 'above': 0.8, 'same_line': 0.7, 'same_column': 0.6, 'right_of': 0.4, 'below': 0.3, 'adjacent': 0.5}}[relation]::DOUBLE * (1 - dist / 914400), 6) AS confidence FROM r""")
def sp02(spark, d):
    return s.label_relations(derived(spark, d, SHAPES), "slide")


@query("sp05_value_below", f"WITH s AS ({SHAPES}) SELECT a.slide, a.shape AS label_shape, arg_min(b.shape, [abs(b.x - a.x) + b.y - a.y, b.shape]) AS value_shape, min(abs(b.x - a.x) + b.y - a.y) AS distance FROM s a JOIN s b ON a.slide = b.slide AND a.is_label AND NOT b.is_label AND b.y > a.y AND abs(b.x - a.x) <= 500000 GROUP BY 1, 2")
def sp05(spark, d):
    return s.value_below(derived(spark, d, SHAPES), F.col("is_label"), "slide")


RUNS = "SELECT o_custkey AS par, o_orderkey AS run, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderpriority END AS text FROM orders"


@query("sg12_source_ranges", f"""WITH r AS ({RUNS}), m AS (SELECT *, sum(length(text)) OVER (PARTITION BY par ORDER BY run ROWS UNBOUNDED PRECEDING) AS e FROM r WHERE text <> '')
SELECT par, 3::BIGINT AS start_pos, 20::BIGINT AS end_pos, run, (greatest(e - length(text), 3) - (e - length(text)))::BIGINT AS source_start, (least(e, 20) - (e - length(text)))::BIGINT AS source_end FROM m WHERE e - length(text) < 20 AND 3 < e""")
def sg12(spark, d):
    runs = derived(spark, d, RUNS)
    spans = runs.select("par").distinct().withColumn("start_pos", F.lit(3).cast("long")).withColumn("end_pos", F.lit(20).cast("long"))
    out = s.source_ranges(s.runs_map(runs, "par"), spans, "par")
    return out.select("par", "start_pos", "end_pos", "run", F.col("source_start").cast("long"), F.col("source_end").cast("long"))


HEADERS = "SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN 'Nama Pasien' WHEN 1 THEN 'Patient ID' WHEN 2 THEN 'Status Pasien' WHEN 3 THEN 'No. HP' WHEN 4 THEN 'e-mail' WHEN 5 THEN 'Alamat Rumah' WHEN 6 THEN p_brand WHEN 7 THEN 'Tanggal Lahir' WHEN 8 THEN 'kk' ELSE 'Diagnosa' END AS header FROM part"


def header_sql(h: str) -> str:
    low = f"lower(trim({h}))"
    ids = "(" + " OR ".join(f"contains({low}, '{w}')" for w in tb.ID_WORDS) + ")"
    arms = "".join(f" WHEN contains({low}, '{w}') THEN " + (f"CASE WHEN NOT {ids} THEN 'PERSON' END" if e == "PERSON" else f"'{e}'") for w, e in tb.HEADER_TYPES.items())
    return f"CASE WHEN string_split({low}, ' ')[1] IN ({','.join(repr(x) for x in tb.PLAIN_HEADERS)}) THEN NULL{arms} END"


@query("cp01_headers", f"SELECT id, {header_sql('header')} AS entity_type FROM ({HEADERS}) AS x")
def cp01(spark, d):
    return derived(spark, d, HEADERS).select("id", tb.header_type(F.col("header")).alias("entity_type"))


@query("cp02_content_vote", """WITH u AS (SELECT 'o_orderkey' AS column_name, o_orderkey::VARCHAR AS v FROM orders UNION ALL SELECT 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
 k AS (SELECT column_name, CASE WHEN regexp_matches(v, '\\b\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}\\b') THEN 'DATE' END AS kind FROM u WHERE trim(v) <> '')
SELECT column_name, count(*)::BIGINT AS cells, CASE WHEN count(kind) / count(*)::DOUBLE >= 0.6 THEN 'DATE' END AS content_type FROM k GROUP BY 1""")
def cp02(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    return tb.content_types(tb.cells(orders)).select("column_name", "cells", "content_type")


KINDS = f"SELECT 'nik' AS column_name, text AS value FROM ({i.NIK}) AS a UNION ALL SELECT 'npwp', text FROM ({i.NPWP}) AS b UNION ALL SELECT 'phone', text FROM ({i.PHONE}) AS p UNION ALL SELECT 'mail', CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE 'surel u' || CAST(s_suppkey AS STRING) || '@x.id' END FROM supplier"


def kinds_sql() -> str:
    from .detection import PROV, SIXTEEN_SQL, SUBJ

    only = lambda p: f"regexp_replace(regexp_extract(v, '{p}'), '\\D', '', 'g')"
    old, new = r"\b\d{2}[.\s]?\d{3}[.\s]?\d{3}[.\s]?\d[-.\s]?\d{3}[.\s]?\d{3}\b", r"\b\d{2}[.\s]?\d{3}[.\s]?\d{3}[.\s]?\d[-.\s]?\d{3}[.\s]?\d{3}[.\s]?\d\b|\b\d{16}\b"
    phones = []
    for p in tb.r.MOBILE:
        q = p.regex.removeprefix("(?U)")
        n = f"regexp_replace(regexp_extract(v, '{q}'), '[^0-9+]', '', 'g')"
        local = f"(CASE WHEN starts_with({n}, '+62') THEN '0' || substr({n}, 4) WHEN starts_with({n}, '62') THEN '0' || substr({n}, 3) ELSE {n} END)"
        good = f"(substr({local}, 1, 4) IN ({', '.join(map(repr, tb.r.CARRIERS))}) OR {p.score - 0.2 > 0.5})"
        phones.append(f"(regexp_matches(v, '{q}') AND {good} AND length({local}) BETWEEN 10 AND 13)")
    return f"""CASE WHEN regexp_matches(v, '{SIXTEEN_SQL}') AND substr({only(SIXTEEN_SQL)}, 1, 2) IN {PROV} THEN 'ID_NIK' WHEN (regexp_matches(v, '{old}') AND substr({only(old)}, 1, 2) IN {SUBJ}) OR regexp_matches(v, '{new}') THEN 'ID_NPWP'
 WHEN {' OR '.join(phones)} THEN 'ID_PHONE' WHEN regexp_matches(v, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b') THEN 'EMAIL_ADDRESS' WHEN regexp_matches(v, '\\b\\d{{1,2}}[-/][A-Za-z0-9]{{1,9}}[-/]\\d{{2,4}}\\b|\\b\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}\\b') THEN 'DATE' END"""


@query("cp02_content_kinds", f"""WITH k AS (SELECT column_name, {kinds_sql()} AS kind FROM (SELECT column_name, trim(value) AS v FROM ({KINDS}) AS x WHERE trim(value) <> '')), c AS (SELECT column_name, kind, count(*) AS n FROM k GROUP BY 1, 2)
SELECT column_name, sum(n)::BIGINT AS cells, CASE WHEN max(n) FILTER (kind IS NOT NULL) / sum(n)::DOUBLE >= 0.6 THEN arg_max(kind, n) FILTER (kind IS NOT NULL) END AS content_type FROM c GROUP BY 1""")
def cp02b(spark, d):
    return tb.content_types(derived(spark, d, KINDS)).select("column_name", "cells", "content_type")


@query("cp03_narrative", """WITH u AS (SELECT 'text' AS column_name, text AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents), w AS (SELECT column_name, trim(v) AS v FROM u WHERE trim(v) <> '')
SELECT column_name, count(*)::BIGINT AS cells, round(avg(length(v)), 6) AS avg_length, round(avg(len(regexp_split_to_array(v, '\\s+'))), 6) AS avg_tokens, avg(length(v)) >= 50 AND avg(len(regexp_split_to_array(v, '\\s+'))) >= 8 AS is_narrative FROM w GROUP BY 1""")
def cp03(spark, d):
    return tb.narrative(tb.cells(spark.read.parquet(f"{d}/documents.parquet").select("text", "lang", "source")))


PROFILED = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query("cp04_profile", f"""WITH v AS (SELECT column_name, trim(value) AS v FROM ({PROFILED}) AS u WHERE trim(value) <> ''), k AS (SELECT column_name, v, {kinds_sql()} AS kind FROM v), c AS (SELECT column_name, kind, count(*) AS n FROM k GROUP BY 1, 2),
 t AS (SELECT column_name, sum(n)::BIGINT AS cells, CASE WHEN max(n) FILTER (kind IS NOT NULL) / sum(n)::DOUBLE >= 0.6 THEN arg_max(kind, n) FILTER (kind IS NOT NULL) END AS content_type FROM c GROUP BY 1),
 n AS (SELECT column_name, avg(length(v)) >= 50 AND avg(len(regexp_split_to_array(v, '\\s+'))) >= 8 AS is_narrative FROM v GROUP BY 1)
SELECT *, coalesce(header_type, content_type, CASE WHEN is_narrative THEN 'TEKS_NARASI' END) AS suggested_type, CASE WHEN is_narrative THEN 'pii_only' ELSE 'full_cell' END AS mode FROM (SELECT t.column_name, cells, {header_sql("t.column_name")} AS header_type, content_type, is_narrative FROM t JOIN n USING (column_name))""")
def cp04(spark, d):
    return tb.profile(spark.read.parquet(f"{d}/customer.parquet"))


@query("st06_events", "SELECT event_id, event_type, value FROM events WHERE user_id = 7 AND event_type IN ('click', 'view', 'error') ORDER BY ts DESC, event_id DESC LIMIT 50")
def st06(spark, d):
    return tb.events(spark.read.parquet(f"{d}/events.parquet"), "user_id", 7, ["click", "view", "error"], limit=50).select("event_id", "event_type", "value")


@query("st07_summary", "SELECT user_id, count(*)::BIGINT AS total, min(ts) AS first_at, max(ts) AS last_at, round(sum(value), 4) AS amount, count(*) FILTER (event_type = 'click')::BIGINT AS n_click, count(*) FILTER (event_type = 'error')::BIGINT AS n_error FROM events GROUP BY 1")
def st07(spark, d):
    return tb.summary(spark.read.parquet(f"{d}/events.parquet"), "user_id", ["click", "error"], "value")


@query("st07_entity_counts", "SELECT json_extract_string(props, '$.k') AS k, count(*)::BIGINT AS n FROM events GROUP BY 1")
def st07b(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("st08_retention", "SELECT count(*)::BIGINT AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY")
def st08(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return tb.kept_after(e, str(e.agg(F.max("ts")).first()[0]), 5).agg(F.count("*").alias("kept"))


#: The history of operations made from events: (project_id, ts, event_id, event_type, operation_id, counts, duration_ms, types), types with bars between, empty for none.
HISTORY = """
SELECT user_id AS project_id, ts, event_id, CASE event_type WHEN 'click' THEN 'scan_completed' WHEN 'view' THEN 'scan_failed' WHEN 'error' THEN 'restore_failed' WHEN 'purchase' THEN 'protection_completed' ELSE 'restore_completed' END AS event_type,
  'op' || CAST(event_id % 100 AS STRING) AS operation_id, event_id % 4 AS file_count, event_id % 9 AS findings_count, CASE WHEN event_id % 5 > 0 THEN event_id % 6 END AS tokens_generated, event_id % 3 AS tokens_restored,
  value AS duration_ms, CASE event_id % 3 WHEN 0 THEN 'ID_NIK|PERSON' WHEN 1 THEN 'PERSON' ELSE '' END AS types FROM events"""


def history(spark, d):
    return derived(spark, d, HISTORY).withColumn("entity_types", F.when(F.col("types") != "", F.split("types", r"\|"))).drop("types")


@query(
    "st08_report",
    f"""WITH h AS ({HISTORY}), t AS (SELECT project_id, x, count(*) AS n FROM (SELECT project_id, unnest(string_split(types, '|')) AS x FROM h WHERE types <> '') AS u GROUP BY 1, 2),
 d AS (SELECT project_id, string_agg(x || ':' || n, ',' ORDER BY x) AS types FROM t GROUP BY 1),
 e AS (SELECT project_id, string_agg(event_id::VARCHAR || event_type || operation_id, ',' ORDER BY ts DESC, event_id DESC) AS newest
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, event_id DESC) AS place FROM h) AS r WHERE place <= 20 GROUP BY 1)
SELECT project_id, count(*)::BIGINT AS total_operations, sum(file_count)::BIGINT AS total_files, sum(findings_count)::BIGINT AS total_findings, coalesce(sum(tokens_generated), 0)::BIGINT AS tokens_generated,
 sum(tokens_restored)::BIGINT AS tokens_restored, round(sum(duration_ms) / 1000, 6)::DOUBLE AS seconds,
 count(*) FILTER (event_type = 'scan_completed')::BIGINT AS scans_completed, count(*) FILTER (event_type = 'scan_failed')::BIGINT AS scans_failed,
 count(*) FILTER (event_type = 'protection_completed')::BIGINT AS protections_completed, count(*) FILTER (event_type = 'protection_failed')::BIGINT AS protections_failed,
 count(*) FILTER (event_type = 'restore_completed')::BIGINT AS restores_completed, count(*) FILTER (event_type = 'restore_failed')::BIGINT AS restores_failed,
 min(ts) AS first_at, max(ts) AS last_at, coalesce(any_value(types_), '') AS entity_types, any_value(newest) AS newest
FROM (SELECT h.*, d.types AS types_, e.newest FROM h LEFT JOIN d USING (project_id) JOIN e USING (project_id)) AS a GROUP BY 1""",
)
def st08_report(spark, d):
    r = h.report(history(spark, d), most_events=20)
    types = F.array_join(F.transform(F.map_entries("entity_types"), lambda x: F.concat(x["key"], F.lit(":"), x["value"])), ",")
    newest = F.array_join(F.transform("events", lambda e: F.concat(e["event_id"].cast("string"), e["event_type"], e["operation_id"])), ",")
    return r.withColumn("entity_types", types).withColumn("newest", newest).drop("events")


@query(
    "st08_cleaned_up",
    f"""WITH h AS ({HISTORY}), m AS (SELECT project_id, count(*) AS n, count(*) FILTER (ts < TIMESTAMP '2024-01-15 00:00:00') AS old FROM h GROUP BY 1)
SELECT project_id, CASE WHEN old > 0 THEN old END::BIGINT AS removed, CASE WHEN n > old THEN n - old END::BIGINT AS kept FROM m WHERE project_id <> 7""",
)
def st08_cleaned_up(spark, d):
    """Project 7 is deleted, then old events are cleaned up."""
    left = h.without(history(spark, d), who=7)
    kept = h.without(left, before="2024-01-15 00:00:00").groupBy("project_id").agg(F.count("*").alias("kept"))
    return h.removed(left, before="2024-01-15 00:00:00").join(kept, "project_id", "full")


GOLD = f"SELECT segment_id AS id, CASE segment_id % 3 WHEN 0 THEN 'hr' WHEN 1 THEN 'medical' ELSE 'banking' END AS doc_type, entity_type, start_pos, end_pos FROM ({i.FINDINGS}) AS g WHERE finding_id % 5 <> 0"
PRED = f"SELECT segment_id AS id, CASE segment_id % 3 WHEN 0 THEN 'hr' WHEN 1 THEN 'medical' ELSE 'banking' END AS doc_type, entity_type, start_pos, CASE WHEN finding_id % 7 = 0 THEN end_pos + 1 ELSE end_pos END AS end_pos FROM ({i.FINDINGS}) AS p WHERE finding_id % 4 <> 0"
SCORES = f"""WITH g AS (SELECT DISTINCT * FROM ({GOLD})), p AS (SELECT DISTINCT * FROM ({PRED})), o AS (SELECT coalesce(g.doc_type, p.doc_type) AS doc_type, coalesce(g.entity_type, p.entity_type) AS entity_type, g.id IS NOT NULL AS ig, p.id IS NOT NULL AS ip FROM g FULL JOIN p ON g.id = p.id AND g.doc_type = p.doc_type AND g.entity_type = p.entity_type AND g.start_pos = p.start_pos AND g.end_pos = p.end_pos),
 c AS (SELECT doc_type, entity_type, count(*) FILTER (ig AND ip)::BIGINT AS tp, count(*) FILTER (ip AND NOT ig)::BIGINT AS fp, count(*) FILTER (ig AND NOT ip)::BIGINT AS fn FROM o GROUP BY GROUPING SETS ((entity_type), (doc_type, entity_type), ()))
SELECT doc_type, entity_type, tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c"""


def outcomes(spark, d):
    return tb.matched(derived(spark, d, PRED), derived(spark, d, GOLD), "id")


@query("ac02_scores", SCORES)
def ac02(spark, d):
    return tb.scores(outcomes(spark, d))


LEAST_F1 = {"ID_NIK": 0.95, "EMAIL_ADDRESS": 0.95, "PERSON": 0.5, "CREDIT_CARD": 0.6}


@query("ac03_gates", "SELECT entity_type, f1, least_f1, f1 >= least_f1 AS passed FROM (" + SCORES + ") AS s JOIN (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in LEAST_F1.items()) + ") AS t(e, least_f1) ON e = entity_type WHERE doc_type IS NULL")
def ac03(spark, d):
    return tb.gates(tb.scores(outcomes(spark, d)).where("doc_type is null"), LEAST_F1)


def match_sql(fits: str, pred: str = PRED, gold: str = GOLD) -> str:
    """Predictions p take gold spans y of their text and type in order; ``fits`` says which they match."""
    return f"""WITH RECURSIVE p AS MATERIALIZED (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY id, doc_type, entity_type) AS n FROM (SELECT DISTINCT * FROM ({pred}) AS x)
  WINDOW w AS (PARTITION BY id, doc_type, entity_type ORDER BY start_pos, end_pos)),
g AS (SELECT id, doc_type, entity_type, list({{'s': start_pos, 'e': end_pos}} ORDER BY start_pos, end_pos) AS spans FROM (SELECT DISTINCT * FROM ({gold}) AS x) GROUP BY ALL),
k AS (
  SELECT id, doc_type, entity_type, coalesce(n, 0) AS n, coalesce(spans, []) AS spans FROM (SELECT DISTINCT id, doc_type, entity_type, n FROM p)
  FULL JOIN g USING (id, doc_type, entity_type)),
f AS (
  SELECT id, doc_type, entity_type, n, len(spans) AS total, 0::BIGINT AS rn, spans AS free FROM k
  UNION ALL
  SELECT id, doc_type, entity_type, n, total, prn, CASE WHEN len(hit) = 0 THEN free ELSE list_filter(free, lambda y: y <> hit[1]) END
  FROM (
    SELECT f.*, p.rn AS prn, list_filter(f.free, lambda y: {fits}) AS hit
    FROM f JOIN p ON p.id = f.id AND p.doc_type = f.doc_type AND p.entity_type = f.entity_type AND p.rn = f.rn + 1))
SELECT entity_type, sum(total - len(free))::BIGINT AS tp, sum(n - total + len(free))::BIGINT AS fp, sum(len(free))::BIGINT AS fn FROM f WHERE rn = n GROUP BY 1"""


def match_counts(spark, d, mode: str, pred: str = PRED, gold: str = GOLD):
    found = tb.matched(derived(spark, d, pred), derived(spark, d, gold), "id", mode)
    return found.groupBy("entity_type").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


@query("ac01_overlap_match", match_sql("least(y.e, p.end_pos) > greatest(y.s, p.start_pos)"))
def ac01(spark, d):
    return match_counts(spark, d, "overlap")


#: Spans of several lengths, from lines of orders, and annotations around, inside and beside them.
WIDE_PRED = "SELECT l_orderkey AS id, 'T' || CAST(l_orderkey % 3 AS STRING) AS doc_type, CASE l_partkey % 2 WHEN 0 THEN 'PERSON' ELSE 'ID_NIK' END AS entity_type, CAST(l_linenumber * 6 AS BIGINT) AS start_pos, CAST(l_linenumber * 6 + 2 + l_suppkey % 9 AS BIGINT) AS end_pos FROM lineitem"
WIDE_GOLD = "SELECT l_orderkey AS id, 'T' || CAST(l_orderkey % 3 AS STRING) AS doc_type, CASE l_suppkey % 2 WHEN 0 THEN 'PERSON' ELSE 'ID_NIK' END AS entity_type, CAST(l_linenumber * 6 - l_partkey % 4 AS BIGINT) AS start_pos, CAST(l_linenumber * 6 + 3 + l_partkey % 7 AS BIGINT) AS end_pos FROM lineitem"


@query("ac01_partial_match", match_sql("least(y.e, p.end_pos) - greatest(y.s, p.start_pos) >= 0.5 * least(y.e - y.s, p.end_pos - p.start_pos)", WIDE_PRED, WIDE_GOLD))
def ac01_partial(spark, d):
    return match_counts(spark, d, "partial", WIDE_PRED, WIDE_GOLD)


@query("ac01_contained_match", match_sql("p.start_pos >= y.s AND p.end_pos <= y.e", WIDE_PRED, WIDE_GOLD))
def ac01_contained(spark, d):
    return match_counts(spark, d, "contained", WIDE_PRED, WIDE_GOLD)


@query("str06_breaker", """WITH e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error'), c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM e)
SELECT event_id, recent::BIGINT AS recent, max((recent >= 3)::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) = 1 AS open FROM c""")
def str06(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").select("user_id", "ts", "event_id")
    return tb.latched_breaker(e, "user_id", 3, 86_400).select("event_id", "recent", "open")


@query("str02_fingerprints", "SELECT conv_id, turn, sha256(text) AS fingerprint, CASE WHEN length(text) <= 0 THEN '0' WHEN length(text) < 100 THEN '<100' WHEN length(text) < 1000 THEN '<1k' WHEN length(text) < 10000 THEN '<10k' WHEN length(text) < 100000 THEN '<100k' WHEN length(text) < 512000 THEN '<512k' ELSE '>=512k' END AS bucket FROM conversations")
def str02(spark, d):
    from ..functions.text import length_bucket

    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"), length_bucket(F.length("text")).alias("bucket"))


TAGS = "SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS idx, CASE (l_partkey + l_linenumber) % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'B-PER' WHEN 2 THEN 'I-PER' WHEN 3 THEN 'I-LOC' ELSE 'B-GPE' END AS tag, CAST(l_quantity / 100 AS DOUBLE) AS score, l_linenumber * 10 AS start_pos, l_linenumber * 10 + 8 AS end_pos FROM lineitem"


@query("nr02_tagged_spans", f"""WITH t AS ({TAGS}), e AS (SELECT *, CASE tag WHEN 'O' THEN NULL WHEN 'B-PER' THEN 'PERSON' WHEN 'I-PER' THEN 'PERSON' ELSE 'LOC' END AS entity_type FROM t),
 n AS (SELECT *, CASE WHEN starts_with(tag, 'I-') AND lag(entity_type) OVER (PARTITION BY id ORDER BY idx) = entity_type THEN 0 ELSE 1 END AS new FROM e), r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT id, first(entity_type) AS entity_type, min(start_pos) AS start_pos, max(end_pos) AS end_pos, min(score) AS score FROM r WHERE entity_type IS NOT NULL GROUP BY id, run""")
def nr02(spark, d):
    from ..operators import entities

    return entities.tagged_spans(derived(spark, d, TAGS), "id")


ANY = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Nama: ' || o_orderpriority WHEN 1 THEN '123=  x y' WHEN 2 THEN 'a' || chr(9) || 'b' WHEN 3 THEN 'kiri | kanan' ELSE 'tanpa' END AS text FROM orders"


KEY_SHAPES = [r"^([^:]+):\s*(.+)$", r"^([^=]+)=\s*(.+)$", r"^([^\t]+)\t+(.+)$", r"^([^|]+)\|\s*(.+)$"]
_part = lambda p, n: f"trim(regexp_extract(trim(text), '{p}', {n}))"
_first = lambda n: "CASE " + " ".join(f"WHEN regexp_matches(trim(text), '{p}') AND length({_part(p, 1)}) <= 50 AND NOT regexp_matches({_part(p, 1)}, '^\\d+$') THEN {_part(p, n)}" for p in KEY_SHAPES) + " END"


@query("sg04_key_value_any", f"SELECT * FROM (SELECT id, {_first(1)} AS key, {_first(2)} AS value FROM ({ANY}) AS x) WHERE key IS NOT NULL")
def sg04(spark, d):
    return derived(spark, d, ANY).select("id", s.key_value_any(F.col("text")).alias("kv")).where("kv is not null").select("id", "kv.key", "kv.value")


BLOCKS = "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'a,' || c_name || chr(10) || 'c,d' WHEN 1 THEN 'a|' || c_mktsegment || ',c' || chr(10) || 'd|e' WHEN 2 THEN 'a;b' WHEN 3 THEN 'x' || chr(10) || 'y,z' WHEN 4 THEN 'p;q;' || c_name || chr(10) || '1;2;3' ELSE 'a' || chr(9) || c_name || chr(10) || 'b' || chr(9) || 'c' END AS text FROM customer"
_even = lambda d: f"len(list_distinct(list_transform(lines, lambda x: len(string_split(x, {d}))))) = 1 AND len(string_split(lines[1], {d})) > 1"


@query("sg09_table_delimiter", f"SELECT id, CASE WHEN len(lines) < 2 THEN NULL WHEN {_even(repr(','))} THEN ',' WHEN {_even('chr(9)')} THEN chr(9) WHEN {_even(repr('|'))} THEN '|' WHEN {_even(repr(';'))} THEN ';' END AS delimiter FROM (SELECT id, string_split(text, chr(10)) AS lines FROM ({BLOCKS}) AS b)")
def sg09(spark, d):
    return derived(spark, d, BLOCKS).select("id", s.table_delimiter(F.split("text", "\n")).alias("delimiter"))


SETTINGS = {"o": [("PERSON", False, None, None), ("CUSTOM", None, "MASK", None)], "p": [("ID_NIK", True, "TOKEN", 0.7), ("EMAIL_ADDRESS", None, "MASK", 0.5), ("PERSON", True, "REDACT", 0.1)], "c": [("PHONE_NUMBER", False, "REDACT"), ("CREDIT_CARD", True, "CATEGORY")]}


@query("fl09_policy", f"""WITH f AS ({i.FINDINGS}) SELECT finding_id, CASE entity_type WHEN 'ID_NIK' THEN 'TOKEN' WHEN 'EMAIL_ADDRESS' THEN 'MASK' WHEN 'CUSTOM' THEN 'MASK' WHEN 'CREDIT_CARD' THEN 'CATEGORY' ELSE 'TOKEN' END AS treatment
 FROM f WHERE entity_type NOT IN ('PERSON', 'PHONE_NUMBER') AND score >= CASE entity_type WHEN 'ID_NIK' THEN 0.7 WHEN 'EMAIL_ADDRESS' THEN 0.5 ELSE 0 END""")
def fl09(spark, d):
    from ..operators import entities

    settings = "entity_type string, enabled boolean, treatment string, least_score double"
    o, p = (spark.createDataFrame(SETTINGS[k], settings) for k in ("o", "p"))
    c = spark.createDataFrame(SETTINGS["c"], "entity_type string, category_enabled boolean, category_treatment string")
    return entities.under_policy(derived(spark, d, i.FINDINGS), o, p, c).select("finding_id", "treatment")


@query("st01_recent_customers", "SELECT c_custkey, max(o_orderdate) AS last_at, count(o_orderkey)::BIGINT AS files FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def st01(spark, d):
    c, o = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "orders"))
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey").agg(F.max("o_orderdate").alias("last_at"), F.count("o_orderkey").alias("files"))
