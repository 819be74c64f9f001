"""Queries of protection end to end, re-scans, segments, columns, named-entity helpers, repositories and states, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as en
from ..operators import protection as pt
from ..operators import recognizers as r
from ..operators import repositories as rp
from ..operators import segments as s
from ..operators import tables as tb
from ..streaming import states as st
from . import inputs as i
from .detection import query as _query
from .inputs import AS_OF, KEY, derived
from .protection import hmac_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    return _query(name, sql, QUERIES, ORACLES)


TEXTS = "SELECT c_custkey AS id, c_name || ' dan ' || c_name || ' x, ' || c_mktsegment || ' / ' || lower(c_mktsegment) AS text FROM customer"


@query("spl02_replace_all", "SELECT id, replace(replace(replace(text, c_name, '[[PERSON_1]]'), c_mktsegment, '[[ORG_1]]'), 'dan', '&') AS text, ((length(text) - length(replace(text, c_name, ''))) // length(c_name) + (length(text) - length(replace(text, c_mktsegment, ''))) // length(c_mktsegment) + (length(text) - length(replace(text, 'dan', ''))) // 3)::BIGINT AS replaced FROM (" + TEXTS + ") AS t JOIN customer ON c_custkey = id")
def spl02(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    rows = [("c_name", 0, "[[PERSON_1]]"), ("c_mktsegment", 1, "[[ORG_1]]")]
    mapping = c.select(F.col("c_custkey").alias("id"), F.lit(2).alias("position"), F.lit("dan").alias("value"), F.lit("&").alias("token"))
    for column, position, token in rows:
        mapping = mapping.unionByName(c.select(F.col("c_custkey").alias("id"), F.lit(position).alias("position"), F.col(column).alias("value"), F.lit(token).alias("token")))
    return pt.replace_values(derived(spark, d, TEXTS), mapping, "id")


@query("spl04_padded", "SELECT c_custkey AS id, CASE WHEN length(c_mktsegment) >= n THEN left(c_mktsegment, n) ELSE rpad(c_mktsegment, n, ' ') END AS padded FROM (SELECT *, (c_custkey % 15 + 1)::INT AS n FROM customer)")
def spl04(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), pt.padded(F.col("c_mktsegment"), (F.col("c_custkey") % 15 + 1).cast("int")).alias("padded"))


CELLS = "SELECT c_custkey AS id, c_name, CASE c_custkey % 4 WHEN 0 THEN 'surel: u' || CAST(c_custkey % 50 AS STRING) || '@x.id, ok' WHEN 1 THEN 'ip 10.0.0.' || CAST(c_custkey % 200 AS STRING) WHEN 2 THEN '  ' ELSE 'tanpa data' END AS note FROM customer"


def token_sql(entity: str, value: str) -> str:
    return f"'[[{entity}_' || upper(left({hmac_sql('(' + repr(entity + '|') + f' || lower({value}))')}, 6)) || ']]'"


EMAIL_CELL, IP_CELL = "'u' || (id % 50) || '@x.id'", "'10.0.0.' || (id % 200)"


@query("spl05_protect_columns", f"SELECT id, {token_sql('PERSON', 'c_name')} AS c_name, CASE id % 4 WHEN 0 THEN 'surel: ' || {token_sql('EMAIL_ADDRESS', EMAIL_CELL)} || ', ok' WHEN 1 THEN 'ip ' || {token_sql('IP_ADDRESS', IP_CELL)} ELSE note END AS note FROM ({CELLS}) AS c")
def spl05(spark, d):
    return pt.protect_columns(derived(spark, d, CELLS), "id", {"c_name": "PERSON"}, ["note"], AS_OF, KEY)[0]


REVIEWED = "SELECT id, note AS text FROM (" + CELLS + ") AS c"


@query("spl06_plan_treat_apply", f"SELECT id, CASE id % 4 WHEN 0 THEN CASE WHEN id % 3 = 0 THEN text ELSE 'surel: ' || {token_sql('EMAIL_ADDRESS', EMAIL_CELL)} || ', ok' END WHEN 1 THEN 'ip ' || {token_sql('IP_ADDRESS', IP_CELL)} ELSE text END AS text FROM ({REVIEWED}) AS c")
def spl06(spark, d):
    texts = derived(spark, d, REVIEWED)
    planned = pt.plan(texts, "id", AS_OF, only=["general"])
    reviewed = planned.withColumn("review_action", F.when((F.col("entity_type") == "EMAIL_ADDRESS") & (F.col("id") % 3 == 0), "ALLOW"))
    return pt.apply(texts, pt.treatments(reviewed, KEY)[0], "id")


TOKENS = "SELECT c_custkey AS id, c_name, CASE c_custkey % 3 WHEN 0 THEN 'a [[X_AB12CD]] b [[X_AB12CD]] [[Y_0F]]' WHEN 1 THEN '[[Y_0f]] [[NOPE_12]]' ELSE 'tanpa' END AS note FROM customer"


@query("rs06_restore_cells", f"SELECT id, c_name, replace(replace(note, '[[X_AB12CD]]', 'Budi'), '[[Y_0f]]', 'Siti') AS note, CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS restored, CASE id % 3 WHEN 2 THEN 0 ELSE 1 END::BIGINT AS not_found FROM ({TOKENS}) AS t")
def rs06(spark, d):
    known = spark.createDataFrame([("[[X_AB12CD]]", "Budi"), ("[[Y_0f]]", "Siti")], "token string, original string")
    return pt.restore_cells(derived(spark, d, TOKENS), known, "id", ["note", "c_name"])


OUTPUT = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'mail u' || CAST(c_custkey AS STRING) || '@x.id [[EMAIL_ABCDEF12]]' WHEN 1 THEN 'nama ' || upper(c_name) || ' [[PERSON' WHEN 2 THEN 'rusak EMAIL_ABC123]] dan [[PERSON]]' WHEN 3 THEN '[[EM_ABCDEF]] bersih' ELSE 'bersih' END AS text FROM customer"
ORIGINALS = "SELECT c_custkey AS id, c_name AS value FROM customer"
RESCAN = rf"""WITH t AS (SELECT o.id, o.text, v.value FROM ({OUTPUT}) AS o JOIN ({ORIGINALS}) AS v ON v.id = o.id),
 m AS (SELECT id, 'residual_pii' AS leakage_type, 'CRITICAL' AS severity, unnest(regexp_extract_all(text, '(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b')) AS value FROM t
 UNION ALL SELECT id, 'untokenized_value', 'CRITICAL', value FROM t WHERE contains(lower(text), lower(value))
 UNION ALL SELECT id, 'partial_token', 'WARNING', unnest(list_filter(regexp_extract_all(text, '\[\[(?:[A-Z][A-Z0-9_]{{1,31}}_[A-F0-9]{{6,16}}\]\])?'), lambda x: x = '[[')) FROM t
 UNION ALL SELECT id, 'partial_token', 'WARNING', unnest(regexp_extract_all(regexp_replace(text, '\[\[[A-Z]', '[[#', 'g'), '[A-Z][A-Z0-9_]+_[A-F0-9]{{6,16}}\]\]')) FROM t
 UNION ALL SELECT id, 'partial_token', 'WARNING', unnest(regexp_extract_all(text, '\[\[[A-Z_]+\]\]')) FROM t)"""


def leaks(spark, d):
    return pt.rescan(derived(spark, d, OUTPUT), "id", AS_OF, derived(spark, d, ORIGINALS), only=["general"])


@query("lk01_rescan", RESCAN + " SELECT * FROM m")
def lk01(spark, d):
    return leaks(spark, d).select("id", "leakage_type", "severity", "value")


@query("lk02_result", RESCAN + f" SELECT o.id, count(*) FILTER (severity = 'CRITICAL') = 0 AS is_clean, count(*) FILTER (severity = 'CRITICAL')::BIGINT AS critical, count(*) FILTER (severity = 'WARNING')::BIGINT AS warning, 0::BIGINT AS info FROM ({OUTPUT}) AS o LEFT JOIN m ON m.id = o.id GROUP BY 1")
def lk02(spark, d):
    return pt.rescan_result(derived(spark, d, OUTPUT), leaks(spark, d), "id")


@query("lk02_remediation", RESCAN + " SELECT id, leakage_type, CASE leakage_type WHEN 'residual_pii' THEN 'Add detection rule for EMAIL_ADDRESS: ''' || left(value, 20) || '...''' WHEN 'untokenized_value' THEN 'Value ''' || left(value, 20) || '...'' was not tokenized - check detection patterns' ELSE 'Fix malformed token at ' || id || ': ''' || value || '''' END AS suggestion FROM m")
def lk02b(spark, d):
    return pt.remediation(leaks(spark, d), "id").select("id", "leakage_type", "suggestion")


DECIDED = "SELECT o_orderkey AS id, CASE o_custkey % 2 WHEN 0 THEN 'PERSON' ELSE 'EMAIL' END AS entity_type, CASE o_orderkey % 2 WHEN 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS value, CASE o_orderkey % 3 WHEN 0 THEN 'TOKEN' WHEN 1 THEN 'MASK' ELSE 'KEEP' END AS treatment FROM orders"


@query("tk05_first_decision", f"SELECT id, first_value(treatment) OVER (PARTITION BY entity_type, lower(value) ORDER BY id) AS treatment FROM ({DECIDED}) AS x")
def tk05(spark, d):
    return pt.consistent_treatments(derived(spark, d, DECIDED), "id").select("id", "treatment")


VAULT = "SELECT DISTINCT entity_type, h AS hmac, '[[' || entity_type || '_' || upper(left(h, n)) || ']]' AS token FROM (SELECT 'PERSON' AS entity_type, sha256(CAST(c_custkey AS VARCHAR)) AS h, CASE c_custkey % 2 WHEN 0 THEN 6 ELSE 8 END AS n FROM customer)"


@query("tk04_ids_beside_vault", f"""WITH v AS (SELECT DISTINCT lower(c_name) AS normalised, {hmac_sql("('PERSON|' || lower(c_name))")} AS hmac FROM customer)
SELECT normalised, hmac, '[[PERSON_' || upper(left(hmac, CASE k WHEN 0 THEN 6 WHEN 1 THEN 8 WHEN 2 THEN 6 ELSE 10 END)) || ']]' AS token FROM (SELECT *, CASE WHEN k4 = 3 THEN 3 ELSE k4 END AS k FROM (SELECT *, (ascii(right(hmac, 1)) % 4) AS k4 FROM v))""")
def tk04(spark, d):
    """A vault forged so that of each value's lengths 6, 8 or both are held by another value."""
    from ..functions.text import value_hmac
    from ..operators import protect

    values = spark.read.parquet(f"{d}/customer.parquet").select(F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("value"))
    h = values.select(value_hmac(F.col("entity_type"), F.col("value"), KEY).alias("h")).distinct().withColumn("k", F.ascii(F.right("h", F.lit(1))) % 4)
    held = h.select("h", F.explode(F.when(F.col("k") == 1, F.array(F.lit(6))).when(F.col("k") == 2, F.array(F.lit(8))).when(F.col("k") == 3, F.array(F.lit(6), F.lit(8))).otherwise(F.array().cast("array<int>"))).alias("n"))
    vault = held.select(F.lit("PERSON").alias("entity_type"), F.concat(F.lit("forged"), "h", F.col("n").cast("string")).alias("hmac"), F.concat(F.lit("[[PERSON_"), F.upper(F.left("h", F.col("n"))), F.lit("]]")).alias("token"))
    return protect.assign_tokens(values, KEY, vault).select("normalised", "hmac", "token")


SEALED = "SELECT o_orderkey AS id, '[[P_' || CAST(o_orderkey AS STRING) || ']]' AS token, o_orderpriority AS value FROM orders"


@query("rs02_resolved_tokens", f"SELECT token, CASE WHEN id % 3 > 0 THEN value END AS original, CASE WHEN id % 3 = 0 THEN 'expired' ELSE 'found' END AS status FROM ({SEALED}) AS v WHERE id % 2 = 0 UNION ALL SELECT token, NULL, 'unknown' FROM ({SEALED}) AS v WHERE id % 2 = 1")
def rs02(spark, d):
    """A third of the vault was sealed for another row, so it doesn't open."""
    from ..operators import protect

    v = derived(spark, d, SEALED)
    sealed = v.where("id % 2 = 0").withColumn("cipher", protect.encrypt(F.col("value"), F.lit("p1"), "token_mappings", F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("id").cast("string")), "original_value", KEY))
    return protect.resolved_tokens(v, sealed, KEY, F.lit("p1"))


@query("rs04_restore_metrics", "SELECT c_mktsegment, count(*)::BIGINT AS documents, count(*) FILTER (c_custkey % 3 < 2)::BIGINT AS with_tokens, sum(CASE c_custkey % 3 WHEN 0 THEN 1 ELSE 0 END)::BIGINT AS restored, sum(CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END)::BIGINT AS unresolved, round(sum(CASE c_custkey % 3 WHEN 0 THEN 1 ELSE 0 END) / sum(CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::DOUBLE * 100, 6) AS rate FROM customer GROUP BY 1")
def rs04(spark, d):
    from ..operators import protect

    texts = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "a [[X_AB12CD]] [[Y_AB12CD]]").when(F.col("c_custkey") % 3 == 1, "[[Y_AB12CD]]").otherwise("tanpa").alias("text"))
    known = spark.createDataFrame([("[[XX_AB12CD]]", "z"), ("[[X_AB12CD]]", "Budi")], "token string, original string")
    texts = texts.withColumn("text", F.replace(F.replace(F.col("text"), F.lit("[[X_"), F.lit("[[XX_")), F.lit("[[Y_"), F.lit("[[YY_")))
    return protect.restore_metrics(protect.restore_texts(texts, known, "c_custkey"), "c_mktsegment")


PARTS_OF = "SELECT c_custkey AS doc, CAST(0 AS BIGINT) AS seg, CAST(0 AS BIGINT) AS parent_offset, 'surel u' || CAST(c_custkey AS STRING) || '@x.id' AS text FROM customer UNION ALL SELECT c_custkey, CAST(1 AS BIGINT), CAST(100 AS BIGINT), 'ip 10.0.0.' || CAST(c_custkey % 200 AS STRING) || ' dan 10.1.1.1' FROM customer"


@query("dt00b_document_findings", f"WITH p AS ({PARTS_OF}), f AS (SELECT doc, seg, 'EMAIL_ADDRESS' AS entity_type, 6::BIGINT AS start_pos, length(text)::BIGINT AS end_pos FROM p WHERE seg = 0 UNION ALL SELECT doc, seg, 'IP_ADDRESS', 103, 103 + length(regexp_extract(text, '10\\.0\\.0\\.\\d+'))::BIGINT FROM p WHERE seg = 1) SELECT * FROM f")
def dt00b(spark, d):
    return pt.document_findings(derived(spark, d, PARTS_OF), "doc", "seg", AS_OF, each=1, only=["general"]).select("doc", "seg", "entity_type", "start_pos", "end_pos")


FILES = "SELECT c_custkey AS id, c_name || ' caf' || CASE c_custkey % 2 WHEN 0 THEN chr(233) ELSE 'e' END AS text FROM customer"


@query("src13_decoded", f"SELECT id, text FROM ({FILES}) AS f")
def src13(spark, d):
    """Texts as bytes in one of five encodings, read back."""
    from ..sources import files

    t = derived(spark, d, FILES)
    kinds = ["UTF-8", "ISO-8859-1", "UTF-16LE", "UTF-16BE"]
    made = F.when(F.col("id") % 5 == 4, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8")))
    for no, name in enumerate(kinds):
        mark = {"UTF-16LE": b"\xff\xfe", "UTF-16BE": b"\xfe\xff"}.get(name, b"")
        made = made.when(F.col("id") % 5 == no, F.concat(F.lit(mark), F.encode("text", name)))
    return t.select("id", files.decoded(made).alias("text"))


PARAGRAPHS = "SELECT l_orderkey AS doc, l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10 AS idx, CASE l_partkey % 4 WHEN 0 THEN 'Bab ' || CAST(l_partkey AS STRING) || ' ' WHEN 1 THEN 'Nama : ' || l_returnflag WHEN 2 THEN 'kunci yang sangat panjang sekali = x' ELSE 'isi biasa' END AS text, CASE l_partkey % 4 WHEN 0 THEN 'Heading 2' ELSE 'Normal' END AS style FROM lineitem"
LABEL = "'^(.{1,30}?)\\s*[:=]\\s*(.+)$'"


@query("sg03_key_labels", f"SELECT doc, idx, trim(regexp_extract(text, {LABEL}, 1)) AS key_label FROM ({PARAGRAPHS}) AS p WHERE regexp_matches(text, {LABEL}) AND length(trim(regexp_extract(text, {LABEL}, 1))) <= 25")
def sg03(spark, d):
    return derived(spark, d, PARAGRAPHS).select("doc", "idx", s.key_label(F.col("text")).alias("key_label")).where("key_label is not null")


@query("sg07_headings", f"SELECT doc, idx, style = 'Heading 2' AS is_heading, CASE WHEN style <> 'Heading 2' THEN last_value(CASE WHEN style = 'Heading 2' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS heading FROM ({PARAGRAPHS}) AS p")
def sg07(spark, d):
    return s.with_headings(derived(spark, d, PARAGRAPHS), "doc").select("doc", "idx", "is_heading", "heading")


TABLE = "SELECT CAST(FLOOR(c_custkey / 20) AS BIGINT) AS tbl, CAST(FLOOR(c_custkey % 20 / 4) AS INT) AS row, CAST(c_custkey % 4 AS INT) AS col, CASE c_custkey % 9 WHEN 0 THEN ' ' ELSE ' ' || c_mktsegment || CAST(c_custkey AS STRING) END AS text FROM customer"


@query("sg08_table_headers", f"""WITH t AS (SELECT tbl, "row", col, text FROM ({TABLE}) AS x) SELECT t.tbl, t."row", t.col, CASE WHEN t."row" > 0 AND trim(h.text) <> '' THEN trim(h.text) END AS table_header, CASE WHEN t.col > 0 AND trim(f.text) <> '' THEN trim(f.text) END AS row_header, t."row" = 0 OR t.col = 0 AS is_header
 FROM t LEFT JOIN t AS h ON h.tbl = t.tbl AND h.col = t.col AND h."row" = 0 LEFT JOIN t AS f ON f.tbl = t.tbl AND f."row" = t."row" AND f.col = 0""")
def sg08(spark, d):
    return s.with_table_headers(derived(spark, d, TABLE), "tbl").select("tbl", "row", "col", "table_header", "row_header", "is_header")


@query("sg10_segments", f"""WITH t AS (SELECT tbl * 1000 + "row" * 10 + col AS id, tbl, text, "row", col FROM ({TABLE}) AS x) SELECT id, text, 'xlsx' AS file_type, id % 10 = 0 OR id % 1000 // 10 = 0 AS is_header, false AS is_value_of_key, NULL::VARCHAR AS slide_title FROM t""")
def sg10(spark, d):
    cells = s.with_table_headers(derived(spark, d, TABLE), "tbl").withColumn("id", F.col("tbl") * 1000 + F.col("row") * 10 + F.col("col")).withColumn("file_id", F.col("tbl").cast("string"))
    return s.as_segments(cells, "xlsx").select("id", "text", "file_type", "is_header", "is_value_of_key", "slide_title")


@query("src14_flattened", f"""SELECT tbl, string_agg(CASE WHEN "row" > 0 AND trim(h) <> '' THEN trim(h) || ': ' || text ELSE text END, chr(10) ORDER BY "row" * 10 + col) AS text FROM (SELECT t.*, h.text AS h FROM ({TABLE}) AS t LEFT JOIN ({TABLE}) AS h ON h.tbl = t.tbl AND h.col = t.col AND h."row" = 0) GROUP BY 1""")
def src14(spark, d):
    cells = s.with_table_headers(derived(spark, d, TABLE), "tbl")
    return s.flattened(cells.select("tbl", (F.col("row") * 10 + F.col("col")).alias("idx"), "text", F.col("table_header").alias("header")), "tbl")


WORDS = "SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'Nama:' WHEN 1 THEN 'no. 12' WHEN 2 THEN 'JUDUL BESAR' WHEN 3 THEN 'satu dua tiga empat lima' WHEN 4 THEN c_name WHEN 5 THEN 'kata kata panjang sekali xx' WHEN 6 THEN ' ' ELSE 'biasa saja' END AS text FROM customer"
CLEAN = "rtrim(rtrim(trim(text), ':'))"


@query("sp03_labels", rf"SELECT id, trim(text) <> '' AND length({CLEAN}) <= 25 AND len(list_filter(string_split({CLEAN}, ' '), lambda w: w <> '')) <= 4 AS potential, text <> '' AND length(text) <= 50 AND (right(trim(text), 1) = ':' OR (length(trim(text)) <= 20 AND regexp_matches(lower(trim(text)), 'nama|nik|npwp|telepon|alamat|email|name|phone|address|id|no\.|nomor')) OR (upper(trim(text)) = trim(text) AND regexp_matches(text, '[A-Z]') AND length(trim(text)) <= 30)) AS likely FROM ({WORDS}) AS w")
def sp03(spark, d):
    return derived(spark, d, WORDS).select("id", s.is_potential_label(F.col("text")).alias("potential"), s.is_label_like(F.col("text")).alias("likely"))


SHAPES = "SELECT l_orderkey AS slide, ((l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey) AS shape, CAST(l_partkey % 7 AS BIGINT) * 700000 AS x, CAST(l_suppkey % 5 AS BIGINT) * 250000 AS y, CAST(600000 AS BIGINT) AS width, CAST(200000 AS BIGINT) AS height, CASE l_partkey % 3 WHEN 0 THEN 'Nama:' WHEN 1 THEN 'NIK ' || CAST(l_partkey % 5 AS STRING) ELSE 'isi yang terlalu panjang untuk sebuah label' END AS text FROM lineitem"
NEAR_SCORE = """CASE WHEN a.x < b.x AND abs(a.y - b.y) <= 228600 AND b.x - a.x - 600000 BETWEEN 0 AND 2743200 THEN 100.0 - (b.x - a.x - 600000) / 2743200.0::DOUBLE * 50
 WHEN a.y < b.y AND ((a.x < b.x + 600000 AND a.x + 600000 > b.x) OR abs(a.x - b.x) <= 600000) AND b.y - a.y - 200000 BETWEEN 0 AND 457200 THEN 80.0 - (b.y - a.y - 200000) / 457200.0::DOUBLE * 30
 WHEN abs(a.y - b.y) <= 228600 AND sqrt((a.x - b.x)::DOUBLE * (a.x - b.x) + (a.y - b.y)::DOUBLE * (a.y - b.y)) <= 2 * 2743200 THEN 50.0 - sqrt((a.x - b.x)::DOUBLE * (a.x - b.x) + (a.y - b.y)::DOUBLE * (a.y - b.y)) / 2743200 * 25 END"""


@query("sp04_nearby_labels", f"""WITH s AS ({SHAPES}), p AS (SELECT a.slide, b.shape, rtrim(a.text, ':') AS t, a.shape AS other, {NEAR_SCORE} AS score FROM s a JOIN s b ON a.slide = b.slide AND a.shape <> b.shape WHERE length(a.text) <= 25),
 k AS (SELECT *, row_number() OVER (PARTITION BY slide, shape ORDER BY score DESC, other) AS n FROM p WHERE score IS NOT NULL), f AS (SELECT slide, shape, t, min(n) AS n FROM k WHERE n <= 3 GROUP BY ALL)
SELECT slide, shape, string_agg(t, '|' ORDER BY n) AS labels FROM f GROUP BY 1, 2""")
def sp04(spark, d):
    return s.nearby_labels(derived(spark, d, SHAPES), "slide").select("slide", "shape", F.array_join("labels", "|").alias("labels"))


@query("sp04_slide_title", f"WITH s AS ({SHAPES}), k AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY y, shape) AS n FROM s) SELECT slide, arg_min(text, n) AS title FROM k WHERE n <= 5 AND length(text) <= 25 GROUP BY 1")
def sp04b(spark, d):
    return s.slide_title(derived(spark, d, SHAPES), "slide")


HEADERS = "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'Nama Ibu' WHEN 1 THEN 'E-Mail' WHEN 2 THEN 'No RM' WHEN 3 THEN 'khusus' WHEN 4 THEN 'Tgl Lahir' WHEN 5 THEN p_brand ELSE 'Handphone' END AS header FROM part"


@query("cp05_csv_types", f"SELECT id, CASE WHEN header = 'khusus' THEN 'SECRET' " + " ".join(f"WHEN contains(lower(header), '{w}') THEN '{k}'" for w, k in tb.CSV_TYPES.items()) + f" ELSE 'PII' END AS entity_type FROM ({HEADERS}) AS h")
def cp05(spark, d):
    return derived(spark, d, HEADERS).select("id", tb.csv_type(F.col("header"), {"khusus": "SECRET"}).alias("entity_type"))


COLUMNS = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ID_NIK' WHEN 2 THEN 'EMAIL' ELSE 'PERSON' END AS suggested_type, CASE c_custkey % 4 WHEN 3 THEN 'pii_only' ELSE 'full_cell' END AS mode, CASE c_custkey % 4 WHEN 1 THEN 'u' || CAST(c_custkey AS STRING) || '@x.id' ELSE 'kata ' || c_mktsegment END AS value FROM customer"


@query("cp06_scanned_columns", f"SELECT id, CASE id % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'EMAIL_ADDRESS' ELSE 'EMAIL' END AS entity_type, 0::BIGINT AS start_pos, length(value)::BIGINT AS end_pos, value, CASE id % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 ELSE 0.8 END::DOUBLE AS score FROM ({COLUMNS}) AS c WHERE id % 4 <> 3")
def cp06(spark, d):
    return tb.scan_columns(derived(spark, d, COLUMNS), AS_OF).select("id", "entity_type", "start_pos", "end_pos", "value", "score")


@query("nr03_kept_predictions", f"""WITH RECURSIVE f AS MATERIALIZED (SELECT segment_id, entity_type, start_pos, end_pos, score, row_number() OVER (PARTITION BY segment_id ORDER BY start_pos, score DESC, start_pos - end_pos, entity_type, end_pos) AS rn FROM (SELECT DISTINCT segment_id, entity_type, start_pos, end_pos, score FROM ({i.FINDINGS}) AS x WHERE score >= 0.5 AND entity_type IN ('PERSON', 'ID_NIK', 'CUSTOM'))),
 k AS (SELECT segment_id, rn, end_pos AS last, entity_type, start_pos, end_pos, score FROM f WHERE rn = 1 UNION ALL SELECT n.segment_id, n.rn, n.end_pos, n.entity_type, n.start_pos, n.end_pos, n.score FROM k JOIN f AS n ON n.segment_id = k.segment_id AND n.rn = (SELECT min(rn) FROM f AS z WHERE z.segment_id = k.segment_id AND z.rn > k.rn AND z.start_pos >= k.last))
SELECT segment_id, entity_type, start_pos, end_pos, score FROM k""")
def nr03(spark, d):
    f = derived(spark, d, i.FINDINGS).select("segment_id", "entity_type", "start_pos", "end_pos", "score").distinct()
    return en.kept_predictions(f, "segment_id", 0.5, ["PERSON", "ID_NIK", "CUSTOM"])


@query("nr04_chunks", """WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 c AS (SELECT doc_id, 0 AS chunk, 0 AS s, 0 AS e, false AS done FROM t WHERE false UNION ALL
  SELECT doc_id, 0, 0, CASE WHEN length(text) <= 512 THEN length(text) ELSE CASE WHEN 512 - strpos(reverse(left(text, 512)), ' ') > 256 AND strpos(reverse(left(text, 512)), ' ') > 0 THEN 512 - strpos(reverse(left(text, 512)), ' ') + 1 ELSE 512 END END, length(text) <= 512 FROM t),
 r AS (SELECT doc_id, chunk, s, e FROM c UNION ALL SELECT r.doc_id, r.chunk + 1, r.e - 50, CASE WHEN r.e - 50 + 512 >= length(t.text) THEN length(t.text) ELSE CASE WHEN strpos(reverse(substr(t.text, r.e - 49, 512)), ' ') > 0 AND 512 - strpos(reverse(substr(t.text, r.e - 49, 512)), ' ') > 256 THEN r.e - 50 + 512 - strpos(reverse(substr(t.text, r.e - 49, 512)), ' ') + 1 ELSE r.e - 50 + 512 END END FROM r JOIN t USING (doc_id) WHERE r.e < length(t.text))
SELECT doc_id, chunk, s::BIGINT AS start_pos, md5(substr(text, s + 1, e - s)) AS hash FROM r JOIN t USING (doc_id)""")
def nr04(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return en.chunks(docs, "doc_id").select("doc_id", "chunk", "start_pos", F.md5(F.col("text").cast("binary")).alias("hash"))


PIECES = "SELECT c_custkey AS id, 0 AS chunk, CAST(0 AS BIGINT) AS start_pos FROM customer UNION ALL SELECT c_custkey, 1, CAST(460 AS BIGINT) FROM customer"
MODEL = "SELECT c_custkey AS id, 0 AS chunk, 'PER' AS entity_type, CAST(470 AS BIGINT) AS start_pos, CAST(480 AS BIGINT) AS end_pos, CAST(0.5 AS DOUBLE) AS score FROM customer UNION ALL SELECT c_custkey, 1, CASE c_custkey % 3 WHEN 0 THEN 'PER' ELSE 'LOC' END, CAST(10 AS BIGINT) + c_custkey % 2, CAST(20 AS BIGINT), CASE c_custkey % 5 WHEN 0 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END FROM customer UNION ALL SELECT c_custkey, 1, 'ORG', CAST(100 AS BIGINT), CAST(110 AS BIGINT), CAST(0.7 AS DOUBLE) FROM customer"


@query("nr05_merged_predictions", """WITH c AS (SELECT c_custkey AS id, c_custkey % 3 = 0 AS same, CASE c_custkey % 5 WHEN 0 THEN 0.4 ELSE 0.9 END::DOUBLE AS b, 470 + c_custkey % 2 AS begins FROM customer)
SELECT id, 'ORG' AS entity_type, 560::BIGINT AS start_pos, 570::BIGINT AS end_pos, 0.7::DOUBLE AS score FROM c
UNION ALL SELECT id, 'PER', 470, 480, 0.5 FROM c WHERE b < 0.5 OR (NOT same AND begins > 470)
UNION ALL SELECT id, CASE WHEN same THEN 'PER' ELSE 'LOC' END, begins, 480, b FROM c WHERE b > 0.5""")
def nr05(spark, d):
    return en.merged_predictions(derived(spark, d, PIECES), derived(spark, d, MODEL), "id")


RESTORED = """
SELECT o_orderkey AS id, o_orderstatus AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'a [[XX_AB12CD]] [[YY_AB12CD]]' WHEN 1 THEN '[[YY_AB12CD]]' ELSE 'tanpa' END AS text, CAST(o_orderdate AS TIMESTAMP) AS started,
  CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderdate AS TIMESTAMP) + CAST(o_custkey % 50 AS INT) * INTERVAL '1' SECOND END AS completed FROM orders"""


@query(
    "rs04_restore_durations",
    f"""WITH r AS ({RESTORED}), t AS (SELECT *, greatest(date_diff('millisecond', started, completed), 0) AS ms FROM r)
SELECT kind, count(*)::BIGINT AS documents, count(*) FILTER (id % 3 < 2)::BIGINT AS with_tokens, count(*) FILTER (id % 3 = 0)::BIGINT AS restored, count(*) FILTER (id % 3 < 2)::BIGINT AS unresolved,
 coalesce(sum(ms), 0)::DOUBLE AS total_ms, coalesce(max(ms), 0)::DOUBLE AS slowest_ms, coalesce(greatest(date_diff('millisecond', min(started), max(completed)), 0), 0)::DOUBLE AS elapsed_ms,
 count(*) FILTER (completed IS NULL)::BIGINT AS unfinished, round(count(*) FILTER (id % 3 = 0) / (count(*) FILTER (id % 3 = 0) + count(*) FILTER (id % 3 < 2))::DOUBLE * 100, 6) AS rate FROM t GROUP BY 1""",
)
def rs04_durations(spark, d):
    from ..operators import protect

    known = spark.createDataFrame([("[[XX_AB12CD]]", "Budi")], "token string, original string")
    restored = protect.restore_texts(derived(spark, d, RESTORED), known, "id")
    return protect.restore_metrics(restored, "kind", started="started", completed="completed")


PROJECTS = "SELECT c_custkey AS id, c_name AS name, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS updated_at, CASE WHEN c_custkey % 3 = 0 THEN CAST('2024-02-01 00:00:00' AS TIMESTAMP) END AS last_opened_at FROM customer"
OPS = "SELECT o_orderkey AS id, CAST(o_custkey % 20 AS STRING) AS project_id, o_orderdate AS started_at, o_orderstatus AS status, CAST(NULL AS TIMESTAMP) AS completed_at, CAST(NULL AS STRING) AS error, o_totalprice > 100000 AS enabled FROM orders"


@query("st01_project_list", "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey % 3 = 0 DESC, c_custkey)::INT AS place FROM customer")
def st01(spark, d):
    from pyspark.sql import Window

    p = rp.projects(derived(spark, d, PROJECTS))
    opened = F.coalesce("last_opened_at", "updated_at")
    return p.select("id", F.row_number().over(Window.orderBy(opened.desc(), "id")).alias("place"))


@query("st03_operations", f"SELECT id, status FROM ({OPS}) AS o WHERE project_id = '7' ORDER BY started_at DESC, id LIMIT 25")
def st03(spark, d):
    return rp.operations(derived(spark, d, OPS), "7", 25).select("id", "status")


@query("st03_completed", f"SELECT id, CASE WHEN id % 4 = 0 THEN 'done' ELSE status END AS status, CASE WHEN id % 4 = 0 THEN started_at + INTERVAL 1 HOUR END AS completed_at FROM ({OPS}) AS o")
def st03b(spark, d):
    o = derived(spark, d, OPS)
    done = o.where("id % 4 = 0").select("id", F.lit("done").alias("status"), (F.col("started_at") + F.expr("INTERVAL 1 HOUR")).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("error"))
    return rp.completed(o, done).select("id", "status", F.col("completed_at").cast("timestamp_ntz").alias("completed_at"))


@query("st02_files", f"SELECT id FROM ({OPS}) AS o WHERE project_id = '3'")
def st02(spark, d):
    return rp.of_project(derived(spark, d, OPS), "3", "started_at").select("id")


@query("st04_rules", f"SELECT id FROM ({OPS}) AS o WHERE project_id = '5' AND enabled")
def st04(spark, d):
    return rp.rules(derived(spark, d, OPS).withColumnRenamed("started_at", "created_at"), "5").select("id")


@query("st04_upserted", f"SELECT id, CASE WHEN id % 10 = 0 THEN 'new' ELSE status END AS status FROM ({OPS}) AS o WHERE id % 10 <> 1 UNION ALL SELECT -id, 'added' FROM ({OPS}) AS o WHERE id % 100 = 0")
def st04b(spark, d):
    o = derived(spark, d, OPS).select("id", "status")
    changed = o.where("id % 10 = 0").withColumn("status", F.lit("new")).unionByName(o.where("id % 100 = 0").select((-F.col("id")).alias("id"), F.lit("added").alias("status")))
    return rp.removed(rp.upserted(o, changed), o.where("id % 10 = 1"))


MAPPINGS = "SELECT o_orderkey AS id, CAST(o_custkey % 20 AS STRING) AS project_id, '[[T_' || CAST(o_orderkey AS STRING) || ']]' AS token, o_orderdate AS expires_at, CAST(NULL AS TIMESTAMP) AS last_used_at FROM orders"


@query("st05_mappings", f"SELECT id, token, CASE WHEN id % 7 = 0 THEN TIMESTAMP '2024-06-15 00:00:00' END AS last_used_at FROM ({MAPPINGS}) AS m WHERE expires_at >= TIMESTAMP '1995-01-01' AND project_id IN ('1', '2')")
def st05(spark, d):
    m = derived(spark, d, MAPPINGS)
    live = rp.unexpired(m, "1995-01-01 00:00:00")
    wanted = m.where("project_id in ('1', '2')").select("project_id", "token")
    used = rp.touched(rp.mappings_of(live, wanted, "project_id", "token"), m.where("id % 7 = 0").select("id"), f"{AS_OF} 00:00:00")
    return used.select("id", "token", F.col("last_used_at").cast("timestamp_ntz").alias("last_used_at"))


@query("st05_exists", f"SELECT DISTINCT token, id % 2 = 0 AS known FROM ({MAPPINGS}) AS m")
def st05b(spark, d):
    m = derived(spark, d, MAPPINGS)
    return rp.exists(m.where("id % 2 = 0"), m.select("token"), "token").distinct()


@query("snk05_unique_names", "SELECT p_partkey AS id, p_brand || '_protected' || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.csv' AS output FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)")
def snk05(spark, d):
    files = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("stem"), F.lit(".csv").alias("ext"))
    return rp.unique_names(files).select("id", "output")


WALK = "SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN 'STARTING' WHEN 1 THEN 'READY' WHEN 2 THEN 'SCANNING' WHEN 3 THEN 'STOPPING' ELSE 'STOPPED' END AS target FROM events"


@query("str07_states", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ({WALK}) AS w), ok(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, to in st.WORKER.items() for b in (*to, a))}),
 r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 'STOPPED' AS state, NULL::BOOLEAN AS accepted FROM e UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN ok.a IS NOT NULL THEN e.target ELSE r.state END, ok.a IS NOT NULL FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1 LEFT JOIN ok ON ok.a = r.state AND ok.b = e.target)
SELECT user_id, event_id, state, accepted FROM r WHERE n > 0""")
def str07(spark, d):
    return st.states(derived(spark, d, WALK), "user_id", "event_id", st.WORKER, "STOPPED").select("user_id", "event_id", "state", "accepted")


RESULTS = "SELECT event_id, user_id AS source, event_id % 3 AS generation, 'f' || CAST(event_id % 2 AS STRING) AS fingerprint, CAST(event_id AS DOUBLE) AS created, CAST(event_id + event_id % 9 AS DOUBLE) AS seen FROM events"


@query("str04_fresh_results", f"SELECT event_id FROM ({RESULTS}) AS x WHERE generation = 1 AND fingerprint = 'f0' AND seen - created <= 5")
def str04(spark, d):
    results = derived(spark, d, RESULTS)
    current = results.select("source", F.lit(1).cast("long").alias("generation"), F.lit("f0").alias("fingerprint")).distinct()
    return st.fresh_results(results, current, "source").select("event_id")


FAILS = "SELECT event_id, user_id, CAST(event_id * 7 AS BIGINT) AS sec, CASE event_id % 2 WHEN 0 THEN 'failure' ELSE 'crash' END AS kind FROM events"


@query("str06_resilience", f"""WITH c AS (SELECT *, count(*) FILTER (kind = 'failure') OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS f, count(*) FILTER (kind = 'crash') OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS k FROM ({FAILS}) AS x)
SELECT event_id, f::BIGINT AS failures, k::BIGINT AS crashes, max(((kind = 'failure' AND f >= 3) OR (kind = 'crash' AND k >= 5))::INT) OVER (PARTITION BY user_id ORDER BY sec RANGE UNBOUNDED PRECEDING) = 1 AS open, CASE event_id % 6 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 WHEN 3 THEN 5.0 WHEN 4 THEN 15.0 END::DOUBLE AS wait,
 CASE WHEN event_id % 4 = 0 THEN 'DEAD' WHEN event_id % 9 <= 2 THEN 'HEALTHY' WHEN event_id % 9 <= 6 THEN 'LATE' ELSE 'UNRESPONSIVE' END AS health FROM c""")
def str06(spark, d):
    out = st.breaker(derived(spark, d, FAILS).withColumnRenamed("sec", "at"), "user_id").withColumnRenamed("at", "sec")
    last = F.when(F.col("event_id") % 4 != 0, F.col("sec") - F.col("event_id") % 9)
    return out.select("event_id", "failures", "crashes", "open", st.backoff(F.col("event_id") % 6).alias("wait"), st.heartbeat_health(last, F.col("sec")).alias("health"))


@query("ac04_corpus", "SELECT o_orderkey AS id, true AS holds, true AS detected FROM orders")
def ac04(spark, d):
    """Every made text holds its value where the label says, and the recognizers find it there."""
    made = tb.corpus(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id")))
    held = F.substring("text", (F.col("start_pos") + 1).cast("int"), (F.col("end_pos") - F.col("start_pos")).cast("int")) == F.col("value")
    found = F.concat(*[f(F.col("text"), AS_OF) for f in r.REGISTRY.values()])
    same = F.exists(found, lambda x: (x["start_pos"] == F.col("start_pos")) & (x["end_pos"] == F.col("end_pos")) & (x["entity_type"] == F.col("entity_type")))
    return made.select("id", held.alias("holds"), same.alias("detected"))


