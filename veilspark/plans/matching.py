"""Queries that look for many values in many texts, and of leaks by kind, with their DuckDB equivalents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions.text import composed
from ..operators import engine
from ..operators import matching as m
from ..operators import protect as pr
from ..operators import protection as pt
from ..operators.vault import Vault
from .detection import query as _query
from .inputs import AS_OF, KEY, derived
from .protection import hmac_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    return _query(name, sql, QUERIES, ORACLES)


#: Protected output that names customers and suppliers in either case, some of whom were never protected.
OUTPUT = """
SELECT o_orderkey AS id, o_custkey % 5 AS project, CASE o_orderkey % 3 WHEN 0 THEN 'kepada CUSTOMER#' WHEN 1 THEN 'untuk customer#' ELSE 'pelanggan ' END || lpad(CAST(o_custkey AS STRING), 9, '0') ||
  ', dari supplier#' || lpad(CAST(o_orderkey % 130 AS STRING), 9, '0') || '.' AS text FROM orders"""
PROTECTED = """
SELECT c_custkey % 5 AS project, c_name AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey % 5 AS project, s_name AS value FROM supplier"""


def left_over(spark, d, scope):
    found = pt.rescan(derived(spark, d, OUTPUT), "id", AS_OF, derived(spark, d, PROTECTED), scope=scope, only=["general"])
    return found.where("leakage_type = 'untokenized_value'").select("id", "severity", "value")


@query(
    "lk01_every_value",
    f"""SELECT DISTINCT o.id, 'CRITICAL' AS severity, v.value
FROM (SELECT id, lower(text) AS text FROM ({OUTPUT}) AS x) AS o JOIN (SELECT value, lower(value) AS low FROM ({PROTECTED}) AS y) AS v ON contains(o.text, v.low)""",
)
def lk01(spark, d):
    return left_over(spark, d, None)


@query(
    "lk01_values_of_a_project",
    f"""SELECT DISTINCT o.id, 'CRITICAL' AS severity, v.value
FROM (SELECT id, project, lower(text) AS text FROM ({OUTPUT}) AS x) AS o
JOIN (SELECT project, value, lower(value) AS low FROM ({PROTECTED}) AS y) AS v ON o.project = v.project AND contains(o.text, v.low)""",
)
def lk01_scoped(spark, d):
    return left_over(spark, d, "project")


#: Terms that documents themselves give: a stretch of each, and its first run of plain letters as a word.
TERMS = """
SELECT DISTINCT substr(text, 4, 9) AS term, 'contains' AS kind, 'PART' AS entity_type, doc_id % 2 = 0 AS case_sensitive FROM documents WHERE length(text) > 40
UNION ALL SELECT DISTINCT regexp_extract(text, '([a-z][a-z][a-z][a-z]+)', 1) AS term, 'word' AS kind, 'WORD' AS entity_type, false AS case_sensitive FROM documents WHERE text IS NOT NULL"""


@query(
    "ct01_table_of_terms",
    f"""WITH d AS (SELECT doc_id AS id, text, lower(text) AS low FROM documents WHERE text IS NOT NULL),
t AS (SELECT term, kind, entity_type, bool_and(case_sensitive) AS always, bool_or(case_sensitive) AS ever FROM ({TERMS}) AS x WHERE term <> '' GROUP BY ALL),
k AS (SELECT term, kind, entity_type, false AS sensitive FROM t WHERE NOT always UNION ALL SELECT term, kind, entity_type, true FROM t WHERE ever),
c AS (
  SELECT id, text, entity_type, kind, length(term) AS n, str_split(CASE WHEN sensitive THEN text ELSE low END, CASE WHEN sensitive THEN term ELSE lower(term) END) AS pieces
  FROM d JOIN k ON contains(CASE WHEN sensitive THEN text ELSE low END, CASE WHEN sensitive THEN term ELSE lower(term) END)),
u AS (SELECT id, text, entity_type, kind, n, unnest(pieces[1:len(pieces) - 1]) AS piece, unnest(range(len(pieces) - 1)) AS i, pieces FROM c),
p AS (SELECT id, text, entity_type, kind, n, list_sum(list_transform(pieces[1:i + 1], lambda x: length(x))) + i * n AS start_pos FROM u)
SELECT id, entity_type, start_pos::BIGINT AS start_pos, (start_pos + n)::BIGINT AS end_pos, substr(text, start_pos::BIGINT + 1, n) AS value FROM p
WHERE kind = 'contains' OR NOT regexp_matches(CASE WHEN start_pos = 0 THEN '' ELSE substr(text, start_pos::BIGINT, 1) END || '.' || substr(text, (start_pos + n)::BIGINT + 1, 1), '[\\p{{L}}\\p{{M}}\\p{{Nd}}_-]')""",
)
def ct01(spark, d):
    return m.term_matches(derived(spark, d, "SELECT doc_id AS id, text FROM documents"), "id", derived(spark, d, TERMS)).select("id", "entity_type", "start_pos", "end_pos", "value")


VALUES = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN lower(o_orderpriority) ELSE o_orderpriority || ' x' END AS value FROM orders"
UNWANTED = "SELECT DISTINCT upper(o_orderpriority) AS term, CASE WHEN o_orderpriority < '3' THEN 'word' ELSE 'exact' END AS kind FROM orders WHERE o_orderpriority < '4'"


@query("fl04_table_of_terms", f"SELECT id, value FROM ({VALUES}) AS v WHERE lower(value) NOT IN (SELECT lower(term) FROM ({UNWANTED}) AS u)")
def fl04(spark, d):
    return m.excluded_by_terms(derived(spark, d, VALUES), derived(spark, d, UNWANTED))


#: Findings of protected files, and what was found in the originals.
FOUND = """
SELECT o_orderkey AS id, o_custkey % 50 AS file, 'PERSON' AS entity_type, CASE o_orderkey % 6 WHEN 0 THEN 'CUSTOMER#' || lpad(CAST(o_custkey AS STRING), 9, '0') WHEN 1 THEN lpad(CAST(o_custkey AS STRING), 9, '0')
  WHEN 2 THEN 'Bpk Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') WHEN 3 THEN '[[PERSON_' || CAST(o_orderkey AS STRING) || ']]' WHEN 4 THEN 'x_masked_y' ELSE 'baru' || CAST(o_orderkey AS STRING) END AS value FROM orders"""
BEFORE = "SELECT c_custkey % 50 AS file, 'PERSON' AS entity_type, c_name AS value FROM customer WHERE c_custkey % 3 <> 0"
LEAK = """CASE WHEN low IN (SELECT lower(value) FROM b WHERE b.file = f.file) THEN 'RESIDUAL'
    WHEN {partial} EXISTS (SELECT 1 FROM b WHERE b.file = f.file AND lower(b.value) <> low AND (contains(low, lower(b.value)) OR contains(lower(b.value), low))) THEN 'INCOMPLETE'
    WHEN (value LIKE '[%]') OR (value LIKE '<%>') OR contains(upper(value), '_REDACTED') OR contains(upper(value), '_MASKED') OR contains(upper(value), 'TOKEN_') THEN 'INTRODUCED' ELSE 'MISSED' END"""
LEAKS = f"""WITH b AS ({BEFORE}), f AS (SELECT *, lower(value) AS low FROM ({FOUND}) AS x), k AS (SELECT file, entity_type, value, {LEAK} AS leak FROM f)
SELECT file, entity_type, value, leak, CASE leak WHEN 'RESIDUAL' THEN 'CRITICAL' WHEN 'INTRODUCED' THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM k"""


def leaks(spark, d, partial):
    found = pr.leaks(derived(spark, d, FOUND), derived(spark, d, BEFORE), "file", partial)
    return found.withColumn("severity", pr.leak_severity(F.col("leak")))


@query("lk03_leaks_of_files", LEAKS.replace("{partial}", ""))
def lk03(spark, d):
    return leaks(spark, d, True)


@query("lk03_leaks_of_texts", LEAKS.replace("{partial}", "false AND"))
def lk03_text(spark, d):
    return leaks(spark, d, False)


#: Names as some systems write them: letters and marks apart, in both orders of two marks.
SPELT = """
SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Jose\u0301 ' || c_name WHEN 1 THEN 'A\u030asa' WHEN 2 THEN 'Vie\u0323\u0302t' WHEN 3 THEN 'Vie\u0302\u0323t'
  WHEN 4 THEN '\u212bngstro\u0308m q\u0301' ELSE c_name END AS value FROM customer"""


@query("tk01_composed", f"SELECT id, nfc_normalize(value) AS value FROM ({SPELT}) AS s")
def tk01(spark, d):
    return derived(spark, d, SPELT).select("id", composed(F.col("value")).alias("value"))


#: Names found by a model or by their context, behind address labels and elsewhere: (id, text, name, recognizer).
NAMED = """
SELECT o_orderkey AS id, lead || name || '.' AS text, name, CAST(length(lead) AS BIGINT) AS start_pos, CASE WHEN o_custkey % 4 = 0 THEN 'id_person' ELSE 'ner' END AS recognizer
FROM (SELECT o_orderkey, o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'ALAMAT: ' WHEN 1 THEN 'domisili di sebelah pasar lama yang besar sekali, milik ' WHEN 2 THEN 'Pasien ' WHEN 3 THEN '' ELSE 'kota asal ' END AS lead,
  CASE o_custkey % 6 WHEN 0 THEN 'Budi Santoso' WHEN 1 THEN 'Gula Darah' WHEN 2 THEN 'Kebon Jeruk' WHEN 3 THEN 'Tekanan Darah' WHEN 4 THEN 'Minggu' ELSE 'Siti Rahayu' END AS name FROM orders) AS o"""


@query(
    "fl05_default_terms_and_places",
    f"""SELECT id, name AS value, start_pos, recognizer FROM ({NAMED}) AS n WHERE name IN ('Budi Santoso', 'Kebon Jeruk', 'Siti Rahayu')
AND NOT (recognizer <> 'id_person' AND start_pos > 0 AND regexp_matches(right(lower(left(text, start_pos)), 40), 'alamat|address|domisili|jl\\.|jalan|kota|kecamatan|kelurahan'))""",
)
def fl05(spark, d):
    texts = derived(spark, d, NAMED)
    found = texts.select("id", F.lit("PERSON").alias("entity_type"), "start_pos", F.col("name").alias("value"), "recognizer")
    return engine.person_filter(found, texts, "id").select("id", "value", "start_pos", "recognizer")


NAME_HMAC = hmac_sql("('PERSON|' || lower(c_name))")


@query(
    "tk04_lasting_vault",
    f"""SELECT 'PERSON' AS entity_type, h AS hmac, '[[PERSON_' || upper(left(h, 4 + 2 * row_number() OVER (PARTITION BY left(h, 6) ORDER BY later, h))) || ']]' AS token
FROM (SELECT c_custkey % 3 = 0 AS later, {NAME_HMAC} AS h FROM customer)""",
)
def tk04(spark, d):
    """Two days' names through a vault in a folder; the second day brings all names again."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='spark-vault-')}"
    path = f"{shared.rstrip('/')}/vault-{uuid.uuid4().hex}"
    vault = Vault(spark, path, digits=1)  # few names, few buckets
    names = spark.read.parquet(f"{d}/customer.parquet").select(F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("value"), "c_custkey")
    vault.tokens(names.where("c_custkey % 3 <> 0"), KEY)
    vault.tokens(names, KEY)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return vault.read()
