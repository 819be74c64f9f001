"""Queries of context scoring, terms, unified recognizers and pattern sets, with their DuckDB equivalents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import recognizers as r
from ..operators import recognizers_unified as u
from ..operators import scoring as c
from ..operators import terms as tm
from . import inputs as i
from .detection import N, PROV, SIXTEEN_SQL, spans_sql
from .detection import query as _query
from .inputs import AS_OF, KEY, derived

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    return _query(name, sql, QUERIES, ORACLES)


#: Segments with their surroundings; lists are strings with bars between, empty for none.
SEGMENTS = """
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Nama Pasien: Budi, no. KTP 3171' WHEN 1 THEN 'invoice number 12, order id 7' WHEN 2 THEN 'slip gaji karyawan NPWP' WHEN 3 THEN 'E-mail dan Nomor HP nasabah'
  WHEN 4 THEN 'laporan tahunan perusahaan' ELSE 'kosong saja' END AS text, CASE o_orderkey % 7 WHEN 0 THEN 'NIK' WHEN 3 THEN 'No. Rekening' WHEN 5 THEN 'e-mail' ELSE '' END AS key_label,
  CASE o_custkey % 5 WHEN 0 THEN 'Data Pasien' WHEN 1 THEN 'Faktur' ELSE '' END AS heading, CASE o_custkey % 4 WHEN 0 THEN 'Rekam Medis' ELSE '' END AS slide_title,
  CASE o_custkey % 6 WHEN 0 THEN 'nama|npwp' WHEN 1 THEN 'kode|rekening' ELSE '' END AS th, CASE o_custkey % 9 WHEN 0 THEN 'telepon' ELSE '' END AS rh, CASE o_orderkey % 8 WHEN 0 THEN 'KTP|alamat' WHEN 1 THEN 'phone' ELSE '' END AS nl,
  CASE o_orderkey % 10 WHEN 0 THEN 'B2' ELSE '' END AS cell, CASE o_orderkey % 11 WHEN 0 THEN 'payroll' ELSE 'f1' END AS file_id, '' AS sheet,
  CASE o_orderkey % 5 WHEN 0 THEN 'ID_NIK' WHEN 1 THEN 'PERSON' WHEN 2 THEN 'EMAIL_ADDRESS' WHEN 3 THEN 'ID_NPWP' ELSE 'IP_ADDRESS' END AS entity_type, CAST(20 + o_orderkey % 79 AS DOUBLE) / 100 AS score FROM orders"""


def segments(spark, d):
    s = derived(spark, d, SEGMENTS)
    for name, of in (("table_headers", "th"), ("row_headers", "rh"), ("nearby_labels", "nl")):
        s = s.withColumn(name, F.when(F.col(of) != "", F.split(of, r"\|")))
    return s.drop("th", "rh", "nl")


def list_sql(name: str) -> str:
    return f"(CASE WHEN {name} <> '' THEN string_split({name}, '|') ELSE []::VARCHAR[] END)"


def given_sql(*names: str) -> str:
    return f"list_filter([{', '.join(names)}], lambda x: x <> '')"


LABELS = f"list_concat(list_concat({given_sql('heading', 'key_label', 'slide_title')}, {list_sql('th')}), list_concat({list_sql('rh')}, {list_sql('nl')}))"
LEXICAL = f"array_to_string(list_concat(list_concat([text], {given_sql('key_label')}), list_concat({LABELS}, {list_sql('th')})), ' ')"
DOCUMENT = f"array_to_string(list_concat(list_concat([text], {LABELS}), list_concat({list_sql('th')}, {given_sql('heading', 'file_id', 'sheet')})), ' ')"


def map_sql(table: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in table.items()) + "}"


def words_sql(text: str, table: dict) -> str:
    pattern = r"(?i)\b(" + "|".join(re.escape(w).replace("\\ ", " ") for w in sorted(table, key=len, reverse=True)) + r")\b"
    return f"list_transform(regexp_extract_all({text}, '{pattern}', 1), lambda x: lower(x))"


def weight_sql(words: str, table: dict) -> str:
    return f"coalesce(list_sum(list_transform({words}, lambda x: {map_sql(table)}[x])), 0)"


ASKED = "MAP {" + ", ".join(f"'{k}': [{', '.join(map(repr, v))}]" for k, v in c.LABEL_ENTITIES.items()) + "}"
BOOST = f"""SELECT *, len(list_filter(asked, lambda x: list_contains(x, entity_type))) > 0 AS hit, len(list_filter(asked, lambda x: NOT list_contains(x, entity_type))) > 0 AS miss
 FROM (SELECT *, list_filter(list_transform({LABELS}, lambda x: {ASKED}[lower(x)]), lambda x: x IS NOT NULL) AS asked FROM ({SEGMENTS}) AS s)"""


@query("cx01_label_boost", f"SELECT id, CASE WHEN hit THEN 'match' WHEN miss THEN 'mismatch' END AS context, round(CASE WHEN hit THEN least(1, score + 0.15) WHEN miss THEN greatest(0, score - 0.1) ELSE score END, 6)::DOUBLE AS score FROM ({BOOST})")
def cx01(spark, d):
    s = segments(spark, d)
    return c.label_boost(s.withColumn("labels", c.context_labels())).select("id", "context", "score")


@query("cx02_lexical", f"""WITH t AS (SELECT id, entity_type, {LEXICAL} AS t FROM ({SEGMENTS}) AS s), w AS (SELECT *, {words_sql('t', c.POSITIVE)} AS p, {words_sql('t', c.NEGATIVE)} AS n FROM t)
SELECT id, array_to_string(p, ',') AS positive, array_to_string(n, ',') AS negative, round({weight_sql('p', c.POSITIVE)} - {weight_sql('n', c.NEGATIVE)}, 6)::DOUBLE AS net_score,
 list_max(list_transform({words_sql('t', c.ENTITY_WORDS['ID_NIK'])}, lambda x: {map_sql(c.ENTITY_WORDS['ID_NIK'])}[x]))::DOUBLE AS nik_hint FROM w""")
def cx02(spark, d):
    out = c.lexical(segments(spark, d))
    return out.select("id", F.array_join("positive", ",").alias("positive"), F.array_join("negative", ",").alias("negative"), "net_score", F.try_element_at("hints", F.lit("ID_NIK")).alias("nik_hint"))


NEAR = f"list_filter({LABELS}, lambda x: x <> key_label)"
PRIMARY = f"""CASE WHEN key_label <> '' THEN ['key_label', key_label] WHEN th <> '' THEN ['table_header', string_split(th, '|')[1]] WHEN rh <> '' THEN ['row_header', string_split(rh, '|')[1]] WHEN heading <> '' THEN ['document_heading', heading]
 WHEN slide_title <> '' THEN ['section_title', slide_title] WHEN nl <> '' THEN ['nearby_label', string_split(nl, '|')[1]] WHEN cell <> '' THEN ['cell_position', cell] END"""


@query("cx03_structure", f"""SELECT id, ({PRIMARY})[1] AS kind, ({PRIMARY})[2] AS label, (len({given_sql('key_label', 'heading', 'slide_title', 'cell')}) + len({list_sql('th')}) + len({list_sql('rh')}) + len({NEAR}))::INT AS items,
 round((key_label <> '')::INT * 0.4 + len({list_sql('th')}) * 0.35 + len({list_sql('rh')}) * 0.3 + (heading <> '')::INT * 0.25 + (slide_title <> '')::INT * 0.25 + len({NEAR}) * 0.2 + (cell <> '')::INT * 0.1, 6)::DOUBLE AS weight FROM ({SEGMENTS}) AS s""")
def cx03(spark, d):
    s = segments(spark, d).withColumn("items", c.structure())
    p = c.primary(F.col("items"))
    weight = F.round(F.aggregate("items", F.lit(0.0), lambda acc, x: acc + x["weight"]), 6)
    return s.select("id", p["kind"].alias("kind"), p["text"].alias("label"), F.size("items").alias("items"), weight.alias("weight"))


TYPES = "[" + ", ".join(f"'{k}'" for k in c.DOCUMENT_WORDS) + "]"
SCORES = "[" + ", ".join(f"round(least(1, {weight_sql(words_sql('t', table), table)}), 6)::DOUBLE" for table in c.DOCUMENT_WORDS.values()) + "]"
TYPED = f"SELECT *, CASE WHEN list_max(sc) >= 0.3 THEN {TYPES}[list_position(sc, list_max(sc))] ELSE 'general' END AS doc_type, CASE WHEN list_max(sc) >= 0.3 THEN list_max(sc) ELSE 0 END AS doc_confidence FROM (SELECT *, {SCORES} AS sc FROM (SELECT *, {DOCUMENT} AS t FROM ({SEGMENTS}) AS s))"
SENSITIVE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in c.SENSITIVITY.items()) + "}"
EXPECTED = "coalesce(MAP {" + ", ".join(f"'{k}': [{', '.join(map(repr, v))}]" for k, v in c.EXPECTED.items()) + "}[doc_type], []::VARCHAR[])"


@query("cx04_document_type", f"SELECT id, doc_type, doc_confidence::DOUBLE AS doc_confidence, {SENSITIVE}[doc_type] AS sensitivity, len({EXPECTED})::INT AS expected FROM ({TYPED})")
def cx04(spark, d):
    out = c.in_context(segments(spark, d))
    return out.select("id", "doc_type", "doc_confidence", "sensitivity", F.size("expected").alias("expected"))


def hint_sql() -> str:
    best = lambda table: f"list_max(list_transform({words_sql('lt', table)}, lambda x: {map_sql(table)}[x]))"
    return "coalesce(CASE entity_type " + " ".join(f"WHEN '{e}' THEN {best(t)}" for e, t in c.ENTITY_WORDS.items()) + " END, 0)"


RESCORED = f"""SELECT id, entity_type, score, doc_type, {PRIMARY} AS pr, {weight_sql(words_sql('lt', c.POSITIVE), c.POSITIVE)} * 0.15 AS pos, {weight_sql(words_sql('lt', c.NEGATIVE), c.NEGATIVE)} * 0.2 AS neg, {hint_sql()} * 0.1 AS hint,
 CASE ({PRIMARY})[1] WHEN 'key_label' THEN 0.24 WHEN 'table_header' THEN 0.18 WHEN 'row_header' THEN 0.18 WHEN 'document_heading' THEN 0.15 WHEN 'section_title' THEN 0.15 WHEN 'nearby_label' THEN 0.12 WHEN 'cell_position' THEN 0.06 ELSE 0 END AS place,
 CASE WHEN nl <> '' AND slide_title <> '' THEN 0.08 ELSE 0 END AS near, CASE WHEN doc_confidence > 0.3 THEN doc_confidence * 0.06 ELSE 0 END AS typed,
 CASE WHEN len({EXPECTED}) = 0 THEN 0 WHEN list_contains({EXPECTED}, entity_type) THEN 0.06 ELSE -0.03 END AS wanted, CASE WHEN {SENSITIVE}[doc_type] IN ('high', 'critical') THEN 0.03 ELSE 0 END AS risky,
 len({words_sql('lt', c.POSITIVE)}) AS np, len({words_sql('lt', c.NEGATIVE)}) AS nn FROM (SELECT *, {LEXICAL} AS lt FROM ({TYPED}))"""
DELTA = "greatest(-0.4, least(0.3, pos - neg + hint + place + near + typed + wanted + risky))"


@query("cx05_rescored", f"SELECT id, round(greatest(0.1, least(1.0, score + {DELTA})), 6)::DOUBLE AS score, round(greatest(0.1, least(1.0, score + {DELTA})) - score, 6)::DOUBLE AS score_delta FROM ({RESCORED})")
def cx05(spark, d):
    return c.rescored(c.in_context(segments(spark, d))).select("id", "score", "score_delta")


GOOD = "(np + (hint > 0)::INT + (place > 0)::INT + (near > 0)::INT + (typed > 0)::INT + (wanted > 0)::INT + (risky > 0)::INT)"


@query("cx06_explained", f"SELECT id, {GOOD}::INT AS positive, (nn + (wanted < 0)::INT)::INT AS negative, CASE WHEN np > 0 THEN 'positive_keyword' WHEN hint > 0 THEN 'entity_hint' WHEN place > 0 THEN CASE pr[1] WHEN 'row_header' THEN 'table_header' ELSE pr[1] END WHEN near > 0 THEN 'slide_title' WHEN typed > 0 THEN 'document_type' WHEN wanted > 0 THEN 'expected_entity' WHEN risky > 0 THEN 'high_sensitivity' END AS primary_reason, CASE WHEN {GOOD} > 1 THEN 'Supported by ' || ({GOOD} - 1) || ' additional factor(s). ' ELSE '' END || CASE WHEN nn + (wanted < 0)::INT > 0 THEN 'Note: ' || (nn + (wanted < 0)::INT) || ' factor(s) reduced confidence. ' ELSE '' END || 'Overall confidence: B.' AS tail FROM ({RESCORED})")
def cx06(spark, d):
    out = c.rescored(c.in_context(segments(spark, d))).withColumn("x", c.explained(F.col("entity_type"), F.lit("B")))
    return out.select("id", "x.positive", "x.negative", "x.primary_reason", F.regexp_replace("x.summary", r"^Detected as [^.]*(?:\.[^.]*?)*?\. (?=Supported|Note|Overall)", "").alias("tail"))


@query("cx07_with_evidence", f"SELECT id, 1.0::DOUBLE AS score, 'CRITICAL' AS band, 'custom_term_match' AS reason, 1.0::DOUBLE AS weight FROM ({SEGMENTS}) AS s UNION ALL SELECT id, score, CASE WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END, 'pattern_match', score FROM ({SEGMENTS}) AS s")
def cx07(spark, d):
    f = derived(spark, d, SEGMENTS).select("id", "entity_type", "score")
    both = c.with_evidence(f, "custom_term").unionByName(c.with_evidence(f, "regex"))
    return both.select("id", "score", "band", F.col("evidence")[0]["reason"].alias("reason"), F.col("evidence")[0]["weight"].alias("weight"))


SPAN = ["id", "entity_type", "start_pos", "end_pos", "value", "score"]
TODAY = f"DATE '{AS_OF}'"


def any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def date_sql(women: bool, window: int) -> tuple[str, str]:
    day = f"substr({N}, 7, 2)::INT"
    day = f"(CASE WHEN {day} > 40 THEN {day} - 40 ELSE {day} END)" if women else f"({day})"
    year = f"(CASE WHEN substr({N}, 11, 2)::INT > {int(AS_OF[2:4]) + window} THEN 1900 ELSE 2000 END + substr({N}, 11, 2)::INT)"
    return f"try_cast({year}::VARCHAR || '-' || substr({N}, 9, 2) || '-' || lpad({day}::VARCHAR, 2, '0') AS DATE)", year


BORN, _ = date_sql(True, 0)
ISSUED, ISSUE_YEAR = date_sql(False, 10)
IN_NIK = f"CASE WHEN substr({N}, 1, 2) NOT IN {PROV} THEN 0 ELSE least(1, 0.7 + CASE WHEN coalesce({BORN} <= {TODAY} AND {BORN} > {TODAY} - INTERVAL 121 YEAR, false) THEN 0.3 ELSE -0.1 END + CASE WHEN {any_sql('lower(text)', u.NIK_WORDS)} THEN 0.1 ELSE 0 END) END"
KK_NEAR, NIK_NEAR = any_sql("lower(text)", u.KK_WORDS), any_sql("lower(text)", u.NIK_ONLY_WORDS)
IN_KK = f"CASE WHEN {NIK_NEAR} AND NOT {KK_NEAR} OR substr({N}, 1, 2) NOT IN {PROV} THEN 0 ELSE least(1, CASE WHEN {KK_NEAR} THEN 0.85 ELSE 0.5 END + CASE WHEN coalesce({ISSUED} <= {TODAY} AND {ISSUE_YEAR} >= 1990, false) THEN 0.15 ELSE -0.1 END) END"


def scored_sql(source: str, pattern: str, entity: str, score: str) -> str:
    return "SELECT * FROM (" + spans_sql(source, pattern, f"id, {entity} AS entity_type, start_pos, end_pos, value, round({score}, 6)::DOUBLE AS score") + ") AS y WHERE score > 0"


def found(spark, d, source, expression):
    return r.rows_of(derived(spark, d, source), "text", expression(F.col("text"))).select(*SPAN)


@query("dt19_nik_segment", scored_sql(i.NIK, SIXTEEN_SQL, "'ID_NIK'", IN_NIK))
def dt19(spark, d):
    return found(spark, d, i.NIK, lambda t: u.nik_in_segment(t, AS_OF))


@query("dt20_kk_segment", scored_sql(i.NIK, SIXTEEN_SQL, "'ID_KK'", IN_KK))
def dt20(spark, d):
    return found(spark, d, i.NIK, lambda t: u.kk_in_segment(t, AS_OF))


NPWP_NEAR = any_sql("lower(text)", u.NPWP_WORDS)
IN_NPWP = f"CASE WHEN len(list_distinct(string_split({N}, ''))) = 1 THEN 0 ELSE 0.5 + CASE WHEN substr({N}, 1, 2) IN ({', '.join(map(repr, u.TAX_CATEGORIES))}) THEN 0.15 ELSE 0 END + CASE WHEN substr({N}, 10, 3) = '000' THEN 0.1 ELSE 0 END + CASE WHEN {NPWP_NEAR} THEN 0.15 ELSE 0 END END"
LONG = f"CASE WHEN {NPWP_NEAR} AND {any_sql('lower(text)', u.TAX_WORDS)} AND NOT {any_sql('lower(text)', u.IDENTITY_WORDS)} THEN 0.6 ELSE 0 END"
TAXED = "SELECT id, text FROM (" + i.NPWP + ") AS a UNION ALL SELECT o_orderkey + 100000000 AS id, CASE o_orderkey % 3 WHEN 0 THEN 'npwp ' WHEN 1 THEN 'npwp atau nik ' ELSE 'x ' END || lpad(CAST(o_orderkey * 7919 AS STRING), 16, '3') AS text FROM orders"


@query("dt21_npwp_segment", "SELECT DISTINCT * FROM (" + " UNION ALL ".join(scored_sql(TAXED, p, "'ID_NPWP'", s) for p, s in ((r"\b\d{2}[.\s]?\d{3}[.\s]?\d{3}[.\s]?\d[-.\s]?\d{3}[.\s]?\d{3}\b", IN_NPWP), (r"\b\d{2}[.\s-]?\d{3}[.\s-]?\d{3}[.\s-]?\d[.\s-]?\d{3}[.\s-]?\d{3}\b", IN_NPWP), (r"\b\d{16}\b", LONG))) + ")")
def dt21(spark, d):
    return found(spark, d, TAXED, lambda t: u.npwp_in_segment(t))


NUMBER = r"regexp_replace(regexp_replace(value, '[\s.\-()]', '', 'g'), '^(?:\+62|62|0)', '')"
PHONES = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'hp 08' || lpad(CAST(c_custkey % 100 AS STRING), 2, '1') || '-555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') WHEN 1 THEN 'hubungi +6221' || lpad(CAST(c_custkey * 31 % 10000000 AS STRING), 8, '2') WHEN 2 THEN 'nomor 62 857 1' || lpad(CAST(c_custkey % 1000000 AS STRING), 6, '4') WHEN 3 THEN 'ref 021' || lpad(CAST(c_custkey % 10000000 AS STRING), 7, '5') ELSE 'tanpa 1234' END || ' .' AS text FROM customer"
IN_PHONE = f"CASE WHEN length({NUMBER}) BETWEEN 8 AND 12 THEN 0.5 + CASE WHEN left({NUMBER}, 3) IN ({', '.join(map(repr, u.MOBILE_PREFIXES))}) THEN 0.15 ELSE 0 END + CASE WHEN {any_sql('lower(text)', u.PHONE_WORDS)} THEN 0.1 ELSE 0 END ELSE 0 END"
PHONE_SQL = scored_sql(PHONES, r"\+?\b(?:62[\s.\-]?[0-9][\s.\-]?(?:[0-9][\s.\-]?){6,11}|0[1-9][\s.\-]?(?:[0-9][\s.\-]?){6,11})", f"CASE WHEN starts_with({NUMBER}, '8') THEN 'ID_PHONE' ELSE 'PHONE_NUMBER' END", IN_PHONE)


@query("dt22_phone_segment", f"WITH a AS ({PHONE_SQL}) SELECT * FROM a UNION SELECT id, entity_type, start_pos, end_pos - length(value) + length(rtrim(value)), rtrim(value), score FROM a WHERE regexp_matches(value, '^[0-9+]+\\s*$') OR regexp_matches(value, '^62 [0-9]{{8,12}}\\s*$')")
def dt22(spark, d):
    return found(spark, d, PHONES, lambda t: u.phone_in_segment(t))


BPJS_NEAR = any_sql("lower(text)", u.BPJS_WORDS)


@query("dt23_bpjs_segment", scored_sql(i.BPJS, r"\b\d{4}[\s.\-]?\d{4}[\s.\-]?\d{5}\b", "'ID_BPJS'", f"CASE WHEN NOT {BPJS_NEAR} OR len(list_distinct(string_split({N}, ''))) = 1 OR {N} = '0123456789012' THEN 0 WHEN starts_with({N}, '0') THEN 0.85 ELSE 0.75 END"))
def dt23(spark, d):
    return found(spark, d, i.BPJS, lambda t: u.bpjs_in_segment(t))


SIMPLE = f"SELECT id, text FROM ({i.NIK}) AS a UNION ALL SELECT id + 200000000, text FROM ({i.NPWP}) AS b UNION ALL SELECT id + 300000000, text FROM ({i.PHONE}) AS p"
DAY, MONTH = f"substr({N}, 7, 2)::INT", f"substr({N}, 9, 2)::INT"


@query("dt26_simple_ids", " UNION ALL ".join((
    scored_sql(SIMPLE, r"\b[1-9][1-9]\d{14}\b", "'ID_NIK'", f"CASE WHEN substr({N}, 1, 2)::INT BETWEEN 11 AND 94 AND ({DAY} BETWEEN 1 AND 31 OR {DAY} BETWEEN 41 AND 71) AND {MONTH} BETWEEN 1 AND 12 THEN 0.85 ELSE 0 END"),
    scored_sql(SIMPLE, r"\b\d{2}\.?\d{3}\.?\d{3}\.?\d[-.]?\d{3}\.?\d{3}\b", "'ID_NPWP'", "0.8"), scored_sql(SIMPLE, r"(?:\+62|62|0)8[1-9][0-9]{7,10}\b", "'ID_PHONE'", "0.75"))))
def dt26(spark, d):
    return found(spark, d, SIMPLE, u.simple_ids)


TXT_TEXT = "SELECT c_custkey AS id, 'Pasien: Budi ' || CASE c_custkey % 3 WHEN 0 THEN 'Santoso' WHEN 1 THEN 'Mock' ELSE 'Rahayu' END || ', u' || CAST(c_custkey AS STRING) || '@x.id, 10.' || CAST(c_custkey % 300 AS STRING) || '.1.2, ' || CASE c_custkey % 2 WHEN 0 THEN '4111 1111 1111 ' ELSE '9111-1111-1111-' END || CASE c_custkey % 2 WHEN 0 THEN '1111' ELSE '2222' END || ', tgl 2020-01-0' || CAST(c_custkey % 9 + 1 AS STRING) || ' https://a.b/' || CAST(c_custkey AS STRING) AS text FROM customer"


def txt_sql(patterns, person: str, checked: bool) -> str:
    checks = {"IP_ADDRESS": "CASE WHEN len(list_filter(string_split(value, '.'), lambda x: x::INT > 255)) = 0 THEN 1 ELSE 0 END", "CREDIT_CARD": f"CASE WHEN left({N}, 1) IN ('3', '4', '5', '6') THEN 1 ELSE 0 END"} if checked else {}
    parts = []
    for p in patterns:
        if p.entity == "PERSON":
            parts.append("SELECT * FROM (" + spans_sql(TXT_TEXT, person, "id, 'PERSON' AS entity_type, end_pos - length(regexp_extract(value, 'Budi.*$')) AS start_pos, end_pos, regexp_extract(value, 'Budi.*$') AS value, 1::DOUBLE AS score") + ") AS y" + (" WHERE value <> 'Budi Mock'" if checked else ""))
        else:
            pattern = p.regex.replace("(?iU)", "(?i)").replace("(?iuU)", "(?i)")
            pattern = pattern.replace(r"\d{4}([\s-]?)\d{4}\1\d{4}\1\d{4}", r"(?:\d{16}|\d{4}\s\d{4}\s\d{4}\s\d{4}|\d{4}-\d{4}-\d{4}-\d{4})")
            parts.append(scored_sql(TXT_TEXT, pattern, f"'{p.entity}'", checks.get(p.entity, "1")))
    return " UNION ALL ".join(parts)


@query("dt17_txt_patterns", txt_sql(u.TXT, r"(?i)Pasien[\s:]+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}", True))
def dt17(spark, d):
    return u.txt(derived(spark, d, TXT_TEXT), AS_OF).where("recognizer = 'txt'").select(*SPAN)


@query("dt18_office_patterns", txt_sql(u.OFFICE, r"(?i)Pasien[\s:]+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}", False))
def dt18(spark, d):
    return r.rows_of(derived(spark, d, TXT_TEXT), "text", u.office_found(F.col("text"), AS_OF)).where("recognizer in ('txt', 'office')").select(*SPAN)


CELLS = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Nama Pasien' WHEN 1 THEN 'Tanggal Lahir' WHEN 2 THEN 'Alamat' WHEN 3 THEN 'Catatan' ELSE 'Tgl Lahir' END AS header, CASE c_custkey % 5 WHEN 0 THEN ' Budi ' || c_name WHEN 1 THEN '12/05/19' || CAST(c_custkey % 90 + 10 AS STRING) WHEN 2 THEN 'Jl. Merdeka 1' WHEN 3 THEN 'hubungi u' || CAST(c_custkey AS STRING) || '@x.id' ELSE 'tidak tahu' END AS text FROM customer"


@query("dt18_office_cells", f"SELECT id, CASE id % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'DATE_OF_BIRTH' WHEN 2 THEN 'LOCATION' ELSE 'EMAIL' END AS entity_type, CASE WHEN id % 5 = 3 THEN 8 ELSE 0 END::BIGINT AS start_pos, length(trim(text))::BIGINT AS end_pos, CASE WHEN id % 5 = 3 THEN substr(text, 9) ELSE trim(text) END AS value, CASE WHEN id % 5 = 3 THEN 1.0 ELSE 0.9 END::DOUBLE AS score FROM ({CELLS}) AS x WHERE id % 5 <> 4")
def dt18_cells(spark, d):
    return u.office_cells(derived(spark, d, CELLS), AS_OF).select(*SPAN)


TERMS = [{"term": "order", "kind": "word", "entity_type": "T_WORD"}, {"term": "er", "kind": "contains", "entity_type": "T_PART"}, {"term": r"o\w+-\w+", "kind": "regex", "entity_type": "T_REGEX", "case_sensitive": True}, {"term": "re-order", "kind": "exact", "entity_type": "T_EXACT"}]
TERM_TEXT = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Order ' || o_orderpriority || ' re-order pre order' WHEN 1 THEN 'Re-Order' WHEN 2 THEN 'border order-x Order' ELSE 'lain' END AS text FROM orders"
WORD_HITS = spans_sql(TERM_TEXT, r"(?i)[\w-]+", "id, start_pos, end_pos, value")


@query("ct01_terms", f"SELECT id, 'T_WORD' AS entity_type, start_pos, end_pos, value FROM ({WORD_HITS}) AS w WHERE lower(value) = 'order' UNION ALL SELECT * FROM ({spans_sql(TERM_TEXT, '(?i)er', chr(105) + 'd, ' + repr('T_PART') + ' AS entity_type, start_pos, end_pos, value')}) AS p UNION ALL SELECT * FROM ({spans_sql(TERM_TEXT, r'o[A-Za-z0-9_]+-[A-Za-z0-9_]+', 'id, ' + repr('T_REGEX') + ' AS entity_type, start_pos, end_pos, value')}) AS x UNION ALL SELECT id, 'T_EXACT', 0, 8, text FROM ({TERM_TEXT}) AS e WHERE lower(text) = 're-order'")
def ct01(spark, d):
    return tm.terms(derived(spark, d, TERM_TEXT), TERMS).select("id", "entity_type", "start_pos", "end_pos", "value")


@query("ct02_literal_terms", spans_sql(TERM_TEXT, "(?i)order", "id, 'CUSTOM' AS entity_type, start_pos, end_pos, value, 1.0::DOUBLE AS score"))
def ct02(spark, d):
    return tm.literal_terms(derived(spark, d, TERM_TEXT), ["order"]).select(*SPAN)


@query("ct03_always_protected", spans_sql(TERM_TEXT, r"(?i)\border\b", "id, 'VIP' AS entity_type, start_pos, end_pos, value, 0.95::DOUBLE AS score, 'HIGH' AS band, true AS is_from_custom_terms"))
def ct03(spark, d):
    return tm.always_protected(derived(spark, d, TERM_TEXT), [{"term": "order", "kind": "word", "entity_type": "VIP"}]).select(*SPAN, "band", "is_from_custom_terms")


@query("ct04_terms_round_trip", "SELECT p_brand || ' \"' || p_type || '\"' AS term, CASE WHEN p_size % 2 = 0 THEN 'word' ELSE 'contains' END AS kind, upper(p_brand) AS entity_type, p_size % 3 = 0 AS case_sensitive FROM part")
def ct04(spark, d):
    table = spark.read.parquet(f"{d}/part.parquet").select(F.concat("p_brand", F.lit(' "'), "p_type", F.lit('"')).alias("term"), F.when(F.col("p_size") % 2 == 0, "word").otherwise("contains").alias("kind"), F.upper("p_brand").alias("entity_type"), (F.col("p_size") % 3 == 0).alias("case_sensitive"))
    return tm.import_terms(tm.export_terms(table))


@query(
    "ct04_sealed_terms",
    """SELECT p_partkey AS id, p_brand || ' "' || p_type || '"' AS term, CASE WHEN p_size % 2 = 0 THEN 'word' ELSE 'contains' END AS kind, upper(p_brand) AS entity_type, p_size % 3 = 0 AS case_sensitive, false AS legible
FROM part WHERE p_partkey % 4 > 0""",
)
def ct04_sealed(spark, d):
    """Terms out of a sealed store of which a quarter was sealed for another project."""
    part = spark.read.parquet(f"{d}/part.parquet")
    term, kind = F.concat("p_brand", F.lit(' "'), "p_type", F.lit('"')), F.when(F.col("p_size") % 2 == 0, "word").otherwise("contains")
    table = part.select(F.col("p_partkey").alias("id"), term.alias("term"), kind.alias("kind"), F.upper("p_brand").alias("entity_type"), (F.col("p_size") % 3 == 0).alias("case_sensitive"))
    store = tm.sealed_terms(table.where("id % 4 > 0"), "p1", KEY).unionByName(tm.sealed_terms(table.where("id % 4 = 0"), "p2", KEY))
    legible = store.select("id", F.contains("cipher", F.encode(F.lit("entity_type"), "UTF-8")).alias("legible"))
    return tm.opened_terms(store, "p1", KEY, strict=False).join(legible, "id")


VALUES = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN lower(o_orderpriority) WHEN 2 THEN o_orderpriority || ' x' ELSE o_orderstatus END AS value FROM orders"


@query("fl04_never_protected", f"SELECT id, value FROM ({VALUES}) AS v WHERE lower(value) NOT IN ('1-urgent', 'o') AND NOT regexp_matches(lower(value), '^\\d-not.*$')")
def fl04(spark, d):
    return tm.never_protected(derived(spark, d, VALUES), [{"term": "1-URGENT", "kind": "exact"}, {"term": "o"}, {"term": r"\d-not.*", "kind": "regex"}])


NAMES = "SELECT c_custkey AS id, 'PERSON' AS entity_type, CAST(c_custkey % 50 AS BIGINT) AS start_pos, CAST(c_custkey % 50 AS BIGINT) + length(v) AS end_pos, v AS value FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Pasien Budi Santoso' WHEN 1 THEN 'dr. Siti Rahayu kontrol' WHEN 2 THEN 'Kota Lama' WHEN 3 THEN 'Agus Wijaya' WHEN 4 THEN 'Bpk  Joko  Lestari,' ELSE 'Nama Pasien' END AS v FROM customer) AS c"
PEELED = r"regexp_extract(value, '(?i)^(?:(?:pasien|nama|bpk|kota|lama|dr|kontrol)[.,]*(?:\s+|$))*(.*?)(?:\s*\b(?:kontrol|pasien|lama))*$', 1)"


@query("fl06_trimmed_persons", f"SELECT id, entity_type, start_pos + strpos(value, {PEELED}) - 1 AS start_pos, start_pos + strpos(value, {PEELED}) - 1 + length({PEELED}) AS end_pos, {PEELED} AS value FROM ({NAMES}) AS n WHERE {PEELED} <> ''")
def fl06(spark, d):
    return tm.trim_persons(derived(spark, d, NAMES), []).select("id", "entity_type", "start_pos", "end_pos", "value")
