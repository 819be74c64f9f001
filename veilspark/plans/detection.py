"""Queries of the detection operators, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import engine
from ..operators import recognizers as r
from ..operators import recognizers_more as m
from . import inputs as i
from .inputs import AS_OF, derived

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, queries: dict = QUERIES, oracles: dict = ORACLES):
    def add(f):
        queries[name] = f
        if sql:
            oracles[name] = sql
        return f

    return add


def spans_sql(source: str, pattern: str, columns: str) -> str:
    """DuckDB: spans of ``pattern`` in (id, text) of ``source`` as x(id, text, value, start_pos, end_pos), then ``columns``."""
    p = pattern.replace("'", "''")
    return f"""SELECT {columns} FROM (SELECT *, end_pos - length(value) AS start_pos FROM (
  SELECT id, text, value, (sum(length(gap) + length(value)) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING))::BIGINT AS end_pos FROM (
   SELECT id, text, unnest(m) AS value, unnest(g[1:len(m)]) AS gap, unnest(range(len(m))) AS k FROM (
    SELECT id, text, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM ({source}) AS s)))) AS x"""


DOCS = "SELECT doc_id AS id, coalesce(text, '') AS text FROM documents"
EMAIL_SQL = r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
IP_SQL = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
SPAN = "id, '{e}' AS entity_type, start_pos, end_pos, value, {s}::DOUBLE AS score"
OUT = ["id", "entity_type", "start_pos", "end_pos", "value", "score"]
CARD_SQL = r"\b\d{4}-\d{4}-\d{4}-\d{4}\b|\b\d{4}\s\d{4}\s\d{4}\s\d{4}\b|\b\d{16}\b"


def docs(spark, d):
    return derived(spark, d, DOCS)


@query("dt01_email_spans", spans_sql(DOCS, EMAIL_SQL, SPAN.format(e="EMAIL_ADDRESS", s=0.9)))
def dt01(spark, d):
    return r.general(docs(spark, d), patterns=[r.EMAIL]).select(*OUT)


@query("dt04_ip_spans", spans_sql(DOCS, IP_SQL, SPAN.format(e="IP_ADDRESS", s=0.95)))
def dt04(spark, d):
    return r.general(docs(spark, d), patterns=r.IPS).select(*OUT)


@query(
    "dt02_phone_spans",
    spans_sql(i.PHONE, r"\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}", SPAN.format(e="PHONE_NUMBER", s=0.8)) + " UNION ALL "
    + spans_sql(i.PHONE, r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", SPAN.format(e="PHONE_NUMBER", s=0.7)),
)
def dt02(spark, d):
    return r.general(derived(spark, d, i.PHONE), patterns=r.PHONES).select(*OUT)


@query(
    "dt03_card_spans",
    spans_sql(i.CARD, r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", SPAN.format(e="CREDIT_CARD", s=0.85)) + " UNION ALL "
    + spans_sql(i.CARD, CARD_SQL, SPAN.format(e="CREDIT_CARD", s=0.7)),
)
def dt03(spark, d):
    return r.general(derived(spark, d, i.CARD), patterns=r.CARDS).select(*OUT)


URL_TEXT = "SELECT page_id AS id, 'lihat ' || url || ' dan www.x' || CAST(page_id AS STRING) || '.id \"q\"' AS text FROM pages"


@query("dt05_url_spans", spans_sql(URL_TEXT, r"(?i)https?://[^\s<>\"']+", SPAN.format(e="URL", s=0.9)) + " UNION ALL " + spans_sql(URL_TEXT, r"(?i)www\.[^\s<>\"']+", SPAN.format(e="URL", s=0.8)))
def dt05(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), F.concat(F.lit("lihat "), "url", F.lit(" dan www.x"), F.col("page_id").cast("string"), F.lit('.id "q"')).alias("text"))
    return r.general(pages, patterns=r.URLS).select(*OUT)


IBAN_TEXT = "SELECT s_suppkey AS id, 'iban ' || CASE s_suppkey % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'gb' ELSE 'X' END || lpad(CAST(s_suppkey % 90 AS STRING), 2, '0') || lpad(CAST(s_suppkey * 977 AS STRING), 12, '0') || ' end' AS text FROM supplier"


@query("dt06_iban_spans", spans_sql(IBAN_TEXT, r"(?i)\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", SPAN.format(e="IBAN_CODE", s=0.8)))
def dt06(spark, d):
    return r.general(derived(spark, d, IBAN_TEXT), patterns=[r.IBAN]).select(*OUT)


SIXTEEN_SQL = r"\b\d{2}[\s.-]?\d{2}[\s.-]?\d{2}[\s.-]?\d{6}[\s.-]?\d{4}\b|\b\d{16}\b"
N = "regexp_replace(value, '\\D', '', 'g')"
PROV = "(" + ",".join(f"'{p}'" for p in r.PROVINCES) + ")"


def born_sql(women: bool) -> tuple[str, str]:
    """(in range, date) of digits 7 to 12 in DuckDB."""
    day = f"substr({N}, 7, 2)::INT"
    day = f"(CASE WHEN {day} > 40 THEN {day} - 40 ELSE {day} END)" if women else f"({day})"
    month, year = f"substr({N}, 9, 2)::INT", f"substr({N}, 11, 2)::INT"
    date = f"try_cast((CASE WHEN {year} > 50 THEN 1900 ELSE 2000 END + {year})::VARCHAR || '-' || lpad({month}::VARCHAR, 2, '0') || '-' || lpad({day}::VARCHAR, 2, '0') AS DATE)"
    return f"({day} BETWEEN 1 AND 31 AND {month} BETWEEN 1 AND 12)", date


SANE, DATE = born_sql(True)
NIK_SQL = spans_sql(i.NIK, SIXTEEN_SQL, f"id, 'ID_NIK' AS entity_type, start_pos, end_pos, value, round(CASE WHEN substr({N}, 1, 2) NOT IN {PROV} THEN 0 ELSE least(1.0, 0.7 + CASE WHEN NOT {SANE} THEN -0.2 WHEN {DATE} IS NULL THEN 0.15 ELSE 0.3 END) END, 6)::DOUBLE AS score")


@query("dt07_nik_score", f"SELECT * FROM ({NIK_SQL}) AS y WHERE score > 0")
def dt07(spark, d):
    return r.nik(derived(spark, d, i.NIK)).select(*OUT)


@query(
    "dt08_nik_metadata",
    spans_sql(i.NIK, SIXTEEN_SQL, f"id, substr({N},1,2) AS province_code, substr({N},3,2) AS city_code, substr({N},5,2) AS district_code, (CASE WHEN substr({N},7,2)::INT > 40 THEN substr({N},7,2)::INT - 40 ELSE substr({N},7,2)::INT END)::INT AS birth_day, substr({N},9,2)::INT AS birth_month, (CASE WHEN substr({N},11,2)::INT > 50 THEN 1900 ELSE 2000 END + substr({N},11,2)::INT)::INT AS birth_year, substr({N},7,2)::INT > 40 AS is_female, substr({N},13,4) AS sequence"),
)
def dt08(spark, d):
    from ..functions.text import Pattern, digits, find_spans

    found = find_spans(derived(spark, d, i.NIK), "text", [Pattern("ID_NIK", r.SIXTEEN, 0.5)])
    return found.select("id", r.nik_parts(digits(F.col("value"))).alias("p")).select("id", "p.*")


def near_sql(words) -> str:
    around = "lower(substr(text, greatest(start_pos - 50, 0)::INT + 1, (least(end_pos + 30, length(text)) - greatest(start_pos - 50, 0))::INT))"
    return "(" + " OR ".join(f"contains({around}, '{w}')" for w in words) + ")"


SANE_KK, DATE_KK = born_sql(False)
KK_SQL = spans_sql(i.NIK, SIXTEEN_SQL, f"id, 'ID_KK' AS entity_type, start_pos, end_pos, value, round(CASE WHEN substr({N}, 1, 2) NOT IN {PROV} THEN 0 ELSE greatest(0, least(0.95, 0.4 + CASE WHEN {near_sql(r.KK_KEYWORDS)} THEN 0.3 ELSE 0 END + CASE WHEN NOT {SANE_KK} THEN -0.1 WHEN {DATE_KK} IS NULL THEN 0.06 WHEN {DATE_KK} <= DATE '{AS_OF}' THEN 0.2 ELSE 0.1 END - CASE WHEN substr({N}, 7, 2)::INT > 31 THEN 0.2 ELSE 0 END)) END, 6)::DOUBLE AS score")


@query("dt09_kk_score", f"SELECT * FROM ({KK_SQL}) AS y WHERE score > 0")
def dt09(spark, d):
    return r.kk(derived(spark, d, i.NIK), AS_OF).select(*OUT)


SUBJ = "(" + ",".join(f"'{s}'" for s in r.SUBJECTS) + ")"
LEFT = "((" + " + ".join(f"substr({N}, {k + 1}, 1)::INT * {w}" for k, w in enumerate(r.NPWP_WEIGHTS)) + ") % 11)"
OLD_SQL = spans_sql(i.NPWP, r"\b\d{2}[.\s]?\d{3}[.\s]?\d{3}[.\s]?\d[-.\s]?\d{3}[.\s]?\d{3}\b", f"id, start_pos, end_pos, value, (CASE WHEN substr({N}, 1, 2) NOT IN {SUBJ} THEN 0 WHEN substr({N}, 9, 1)::INT = (CASE {LEFT} WHEN 0 THEN 0 ELSE 11 - {LEFT} END) OR 11 - {LEFT} = 10 THEN 0.9 ELSE 0.75 END)::DOUBLE AS score")
NEW_SQL = spans_sql(i.NPWP, r"\b\d{2}[.\s]?\d{3}[.\s]?\d{3}[.\s]?\d[-.\s]?\d{3}[.\s]?\d{3}[.\s]?\d\b|\b\d{16}\b", f"id, start_pos, end_pos, value, (CASE WHEN starts_with({N}, '0') AND substr({N}, 2, 2) IN {SUBJ} THEN CASE WHEN {near_sql(r.NPWP_KEYWORDS)} THEN 0.9 ELSE 0.75 END WHEN {near_sql(r.NPWP_KEYWORDS)} THEN 0.85 ELSE 0.5 END)::DOUBLE AS score")


@query("dt10_npwp_score", f"WITH o AS (SELECT * FROM ({OLD_SQL}) AS a WHERE score > 0), n AS ({NEW_SQL}) SELECT id, 'ID_NPWP' AS entity_type, start_pos, end_pos, value, score FROM o UNION ALL SELECT id, 'ID_NPWP', start_pos, end_pos, value, score FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = n.id AND o.start_pos <= n.start_pos AND o.end_pos >= n.end_pos)")
def dt10(spark, d):
    return r.npwp(derived(spark, d, i.NPWP)).select(*OUT)


def phone_sql() -> str:
    number = "regexp_replace(value, '[^0-9+]', '', 'g')"
    local = f"CASE WHEN starts_with({number}, '+62') THEN '0' || substr({number}, 4) WHEN starts_with({number}, '62') THEN '0' || substr({number}, 3) ELSE {number} END"
    parts = []
    for k, p in enumerate(r.MOBILE + r.LANDLINE):
        parts.append(spans_sql(i.PHONE, p.regex.removeprefix("(?U)"), f"id, {k} AS k, start_pos, end_pos, value, {local} AS n, {p.score}::DOUBLE AS base"))
    carriers, areas = "(" + ",".join(f"'{c}'" for c in r.CARRIERS) + ")", " OR ".join(f"starts_with(n, '{a}')" for a in r.AREAS)
    score = f"round(greatest(0, least(1, CASE WHEN k < 3 THEN base + CASE WHEN substr(n, 1, 4) IN {carriers} THEN 0.05 ELSE -0.2 END - CASE WHEN length(n) BETWEEN 10 AND 13 THEN 0 ELSE 0.3 END ELSE base + CASE WHEN {areas} THEN 0.1 ELSE 0 END - CASE WHEN length(n) BETWEEN 9 AND 12 THEN 0 ELSE 0.2 END END)), 6)::DOUBLE"
    return f"""WITH RECURSIVE a AS MATERIALIZED (SELECT *, {score} AS score FROM ({' UNION ALL '.join(parts)}) AS u), b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, start_pos) AS rn FROM a WHERE score > 0.5 AND (k < 3 OR NOT starts_with(n, '08'))),
f AS (SELECT id, 0::BIGINT AS rn, []::STRUCT(s BIGINT, e BIGINT)[] AS kept, false AS taken FROM (SELECT DISTINCT id FROM b) UNION ALL
 SELECT f.id, b.rn, CASE WHEN hit THEN kept ELSE list_append(kept, {{'s': b.start_pos, 'e': b.end_pos}}) END, NOT hit FROM (SELECT f.*, b2.start_pos AS s0, b2.end_pos AS e0, len(list_filter(kept, lambda x: b2.start_pos < x.e AND b2.end_pos > x.s)) > 0 AS hit FROM f JOIN b AS b2 ON b2.id = f.id AND b2.rn = f.rn + 1) AS f JOIN b ON b.id = f.id AND b.rn = f.rn + 1)
SELECT b.id, 'ID_PHONE' AS entity_type, b.start_pos, b.end_pos, b.value, b.score FROM f JOIN b ON b.id = f.id AND b.rn = f.rn WHERE f.taken"""


@query("dt11_id_phone", phone_sql())
def dt11(spark, d):
    return r.id_phone(derived(spark, d, i.PHONE)).select(*OUT)


BIRTH_LABELS_SQL = lambda t: "(" + " OR ".join(f"contains({t}, '{w}')" for w in r.BIRTH_LABELS) + ")"


def birth_sql() -> str:
    shapes = [r"\b\d{1,2}[\s\-/]+[A-Za-z]{3,9}[\s\-/]+\d{4}\b", r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{4}\b", r"\b\d{4}[/\-]\d{1,2}[/\-]\d{1,2}\b"]
    months = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in r.MONTHS.items()) + "}"
    parts = []
    for k, p in enumerate(shapes):
        w = lambda n: f"regexp_extract_all(value, '[0-9]+|[A-Za-z]+')[{n}]"
        y, m, dd = (w(1), f"try_cast({w(2)} AS INT)", w(3)) if k == 2 else (w(3), f"try_cast({w(2)} AS INT)" if k else f"{months}[lower({w(2)})]", w(1))
        parts.append(spans_sql(i.BIRTH, p, f"id, text, start_pos, end_pos, value, try_cast({y} || '-' || lpad({m}::VARCHAR, 2, '0') || '-' || lpad({dd}, 2, '0') AS DATE) AS day"))
    before = "lower(regexp_extract(substr(text, greatest(start_pos - 30, 0)::INT + 1, least(start_pos, 30)::INT), '[^\\n]*$'))"
    return f"""WITH a AS (SELECT *, {BIRTH_LABELS_SQL(before)} AS lab, {BIRTH_LABELS_SQL('lower(text)')} AS any_lab, regexp_matches(text, '\\b[A-Z][a-z]{{2,}}\\s+[A-Z][a-z]{{2,}}\\b') AS person FROM ({' UNION ALL '.join(parts)}) AS u)
SELECT id, 'DATE_OF_BIRTH' AS entity_type, start_pos, end_pos, value, (CASE WHEN lab THEN 0.95 WHEN any_lab THEN 0.85 ELSE 0.65 END)::DOUBLE AS score FROM a
WHERE (any_lab OR person) AND day IS NOT NULL AND year(day) >= 1920 AND day <= DATE '{AS_OF}' AND (lab OR NOT (day >= DATE '{AS_OF}' - INTERVAL 24 MONTH OR (year(day) = 2024 AND month(day) = 6)))"""


@query("dt12_dob", birth_sql())
def dt12(spark, d):
    return r.birth_date(derived(spark, d, i.BIRTH), AS_OF).select(*OUT)


_NAME_SQL = r"[A-Z][a-z]+(?:[\t ]+[A-Z][a-z]+){0,3}"
_TITLES = r"(?:(?:dr|drg|dra|ir|prof|h|hj|tn|ny|sdr|sdri|bpk|bapak|ibu)\.?\s*)?"
_alternatives = lambda words: "|".join(sorted(words, key=len, reverse=True))


def person_sql() -> str:
    """The four patterns without look-ahead: what has to follow is part of the match, and the name is cut out of it."""
    shapes = [
        (0, rf"(?i)(?:{_alternatives(r.NAME_LABELS)})\s*[:=]\s*({_NAME_SQL})", 0.9), (1, rf"\]\s*({_NAME_SQL})\s*[|\n]", 0.85),
        (2, rf"[\"'](?i:{_alternatives(r.NAME_KEYS)})[\"']\s*:\s*[\"']({_TITLES}{_NAME_SQL})[\"']", 0.9), (3, rf"\b(?i:{_alternatives(r.NAME_CUES)})\s+({_NAME_SQL})", 0.8),
    ]
    parts = []
    for no, p, score in shapes:
        q = p.replace("'", "''")
        parts.append("SELECT * FROM (" + spans_sql(i.PERSON, p, f"id, {no} AS no, start_pos + strpos(value, regexp_extract(value, '{q}', 1)) - 1 AS start_pos, regexp_extract(value, '{q}', 1) AS value, {score}::DOUBLE AS score") + ") AS y")
    every = " UNION ALL ".join(parts)
    return f"SELECT id, 'PERSON' AS entity_type, start_pos, start_pos + length(value) AS end_pos, value, score, 'id_person' AS recognizer FROM (SELECT *, row_number() OVER (PARTITION BY id, start_pos, length(value) ORDER BY no) AS n FROM ({every})) WHERE n = 1"


@query("dt13_person", person_sql())
def dt13(spark, d):
    return r.person(derived(spark, d, i.PERSON)).select(*OUT, "recognizer")


BPJS_SQL = spans_sql(i.BPJS, r"\b\d{4}[\s.\-]?\d{4}[\s.\-]?\d{5}\b", f"id, 'ID_BPJS' AS entity_type, start_pos, end_pos, value, (CASE WHEN NOT {near_sql(r.BPJS_KEYWORDS)} OR len(list_distinct(string_split({N}, ''))) = 1 OR {N} = '0123456789012' THEN 0 WHEN starts_with({N}, '0') THEN 0.85 ELSE 0.75 END)::DOUBLE AS score")


@query("dt14_bpjs_score", f"SELECT * FROM ({BPJS_SQL}) AS y WHERE score > 0")
def dt14(spark, d):
    return r.bpjs(derived(spark, d, i.BPJS)).select(*OUT)


RULES = [("kartu anggota", "regex", r"\bkartu\s+\d"), ("habis", "word", "habis"), ("Tiga", "contains", "3333")]


@query("dt15_custom_patterns", " UNION ALL ".join(spans_sql(i.CARD, p, SPAN.format(e=e, s=0.95)) for e, p in (("KARTU_ANGGOTA", r"(?i)\bkartu\s+\d"), ("HABIS", r"(?i)\bhabis\b"), ("TIGA", "3333"))))
def dt15(spark, d):
    return r.custom(derived(spark, d, i.CARD), RULES).select(*OUT)


@query("dt16_scan_counts")
def dt16(spark, d):
    return r.scan(docs(spark, d), AS_OF, rules=[("token", "word", "token")]).groupBy("entity_type", "recognizer").agg(F.count("*").alias("findings"), F.max("score").alias("best"))


ENGINE_COMMON = ["tidak", "ada"]


@query(
    "dt00_engine",
    f"""WITH f AS ({person_sql()}), t AS (SELECT *, list_filter(string_split(lower(value), ' '), lambda x: x <> '') AS tokens FROM f)
SELECT id, entity_type, start_pos, end_pos, value, score FROM t WHERE len(list_intersect(tokens, {[*m.PLACE_WORDS]})) = 0 AND len(list_intersect(tokens, {[*m.CLINICAL_WORDS]})) = 0 AND NOT (len(tokens) = 1 AND length(tokens[1]) <= 2)
 AND lower(value) NOT IN ('budi santoso', 'siti', 'lestari') AND NOT (len(tokens) > 1 AND len(list_filter(tokens, lambda x: x NOT IN ('siti', 'lestari'))) = 0)""",
)
def dt00(spark, d):
    """Persons of the made texts but for those that can't be any and those on a deny-list."""
    denied = spark.createDataFrame([("budi santoso",), ("siti",), ("lestari",)], "term string")
    return engine.analyze(derived(spark, d, i.PERSON), AS_OF, common=ENGINE_COMMON, denied=denied, only=["id_person"]).select(*OUT)
