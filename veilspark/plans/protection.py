"""Queries of tokens, treatments, restoring, leaks and the vault."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import protect
from ..operators import recognizers as r
from . import inputs as i
from .detection import DOCS, EMAIL_SQL, spans_sql
from .detection import query as _query
from .inputs import KEY, derived

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    return _query(name, sql, QUERIES, ORACLES)


#: Values of several types, some of which differ in nothing but case and spaces.
VALUES = """
SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'ID_PHONE' WHEN 2 THEN 'PERSON' WHEN 3 THEN 'SALARY' ELSE 'DATE_OF_BIRTH' END AS entity_type,
 CASE c_custkey % 5 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'User' ELSE 'user' END || CAST(c_custkey % 300 AS STRING) || '@Mail.example' WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN '0' ELSE '62' END || '812-' || CAST(c_custkey % 300 AS STRING)
 WHEN 2 THEN '  Budi   ' || c_name || ' ' WHEN 3 THEN 'Rp ' || CAST(c_custkey * c_custkey * 997 AS STRING) ELSE CAST(1950 + c_custkey % 50 AS STRING) || '-01-02' END AS value FROM customer"""
NORMAL = """CASE WHEN entity_type = 'EMAIL' THEN lower(trim(value)) WHEN entity_type = 'ID_PHONE' THEN CASE WHEN starts_with(regexp_replace(value, '[^0-9+]', '', 'g'), '0') THEN '+62' || substr(regexp_replace(value, '[^0-9+]', '', 'g'), 2)
 WHEN starts_with(regexp_replace(value, '[^0-9+]', '', 'g'), '62') THEN '+' || regexp_replace(value, '[^0-9+]', '', 'g') ELSE regexp_replace(value, '[^0-9+]', '', 'g') END ELSE regexp_replace(lower(trim(value)), '\\s+', ' ', 'g') END"""
PAD = KEY.ljust(64, b"\0")
IPAD, OPAD = (bytes(b ^ x for b in PAD).hex() for x in (0x36, 0x5C))


def hmac_sql(message: str) -> str:
    return f"sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode({message}))))"


HMAC = hmac_sql(f"(entity_type || '|' || {NORMAL})")


@query("tk01_normalise", f"SELECT id, {NORMAL} AS normalised FROM ({VALUES}) AS v")
def tk01(spark, d):
    return derived(spark, d, VALUES).select("id", t.normalise_value(F.col("entity_type"), F.col("value")).alias("normalised"))


@query("tk02_hmac", f"SELECT id, {HMAC} AS hmac FROM ({VALUES}) AS v")
def tk02(spark, d):
    return derived(spark, d, VALUES).select("id", t.value_hmac(F.col("entity_type"), F.col("value"), KEY).alias("hmac"))


OLD = f"SELECT DISTINCT entity_type, {HMAC} AS hmac, '[[' || entity_type || '_' || upper(left({HMAC}, 8)) || ']]' AS token FROM ({VALUES}) AS v WHERE id % 10 = 1"


@query("tk03_tokens", f"""WITH old AS ({OLD}), v AS (SELECT DISTINCT entity_type, {NORMAL} AS normalised, {HMAC} AS hmac FROM ({VALUES}) AS v),
 k AS (SELECT v.*, old.token AS known FROM v LEFT JOIN old USING (entity_type, hmac)),
 n AS (SELECT entity_type, normalised, hmac, row_number() OVER (PARTITION BY entity_type, left(hmac, 6) ORDER BY hmac) - 1 AS r FROM k WHERE known IS NULL)
SELECT entity_type, normalised, hmac, known AS token, false AS is_new FROM k WHERE known IS NOT NULL UNION ALL
SELECT entity_type, normalised, hmac, '[[' || entity_type || '_' || upper(left(hmac, least(16, 6 + 2 * r)::INT)) || ']]', true FROM n""")
def tk03(spark, d):
    values = derived(spark, d, VALUES)
    h = t.value_hmac(F.col("entity_type"), F.col("value"), KEY)
    vault = values.where("id % 10 = 1").select("entity_type", h.alias("hmac"), F.concat(F.lit("[["), "entity_type", F.lit("_"), F.upper(F.left(h, F.lit(8))), F.lit("]]")).alias("token")).distinct()
    return protect.assign_tokens(values, KEY, vault)


@query("tk05_consistency", f"SELECT entity_type, count(*)::BIGINT AS findings, count(DISTINCT {NORMAL})::BIGINT AS unique_values, (count(*) - count(DISTINCT {NORMAL}))::BIGINT AS reused, round((count(*) - count(DISTINCT {NORMAL})) / count(*)::DOUBLE * 100, 6) AS reuse_rate FROM ({VALUES}) AS v GROUP BY 1")
def tk05(spark, d):
    v = derived(spark, d, VALUES).withColumn("n", t.normalise_value(F.col("entity_type"), F.col("value")))
    g = v.groupBy("entity_type").agg(F.count("*").alias("findings"), F.countDistinct("n").alias("unique_values")).withColumn("reused", F.col("findings") - F.col("unique_values"))
    return g.withColumn("reuse_rate", F.round(F.col("reused") / F.col("findings") * 100, 6))


MASK = "CASE WHEN length(value) <= 4 THEN repeat('*', length(value)) ELSE left(value, 2) || repeat('*', length(value) - 4) || right(value, 2) END"
MONEY = "try_cast(regexp_replace(value, '[^0-9.]', '', 'g') AS DOUBLE)"
GENERAL = f"CASE entity_type WHEN 'DATE_OF_BIRTH' THEN left(value, 4) WHEN 'SALARY' THEN CASE WHEN {MONEY} >= 1e9 THEN '[BILLIONS]' WHEN {MONEY} >= 1e6 THEN '[MILLIONS]' WHEN {MONEY} >= 1e3 THEN '[THOUSANDS]' ELSE '[AMOUNT]' END ELSE '[' || entity_type || ']' END"
PSEUDO = f"CASE entity_type WHEN 'PERSON' THEN 'Person_' || upper(left({HMAC}, 8)) WHEN 'EMAIL' THEN 'user_' || left({HMAC}, 8) || '@redacted.local' ELSE entity_type || '_' || upper(left({HMAC}, 8)) END"
KIND = "CASE id % 6 WHEN 0 THEN 'REDACT' WHEN 1 THEN 'CATEGORY' WHEN 2 THEN 'MASK' WHEN 3 THEN 'GENERALIZE' WHEN 4 THEN 'PSEUDONYM' ELSE 'KEEP' END"


@query("tr01_treatments", f"SELECT id, {KIND} AS treatment, CASE {KIND} WHEN 'REDACT' THEN '[REDACTED]' WHEN 'MASK' THEN {MASK} WHEN 'KEEP' THEN value WHEN 'GENERALIZE' THEN {GENERAL} WHEN 'PSEUDONYM' THEN {PSEUDO} ELSE '[' || entity_type || ']' END AS replacement FROM ({VALUES}) AS v")
def tr01(spark, d):
    v = derived(spark, d, VALUES).withColumn("treatment", F.expr(KIND))
    return v.select("id", "treatment", t.treated(F.col("treatment"), F.col("entity_type"), F.col("value"), F.lit(None).cast("string"), KEY).alias("replacement"))


@query("tr02_mask", f"SELECT id, {MASK} AS masked FROM ({VALUES}) AS v")
def tr02(spark, d):
    return derived(spark, d, VALUES).select("id", t.mask(F.col("value")).alias("masked"))


@query("tr03_generalise", f"SELECT id, {GENERAL} AS general FROM ({VALUES}) AS v")
def tr03(spark, d):
    return derived(spark, d, VALUES).select("id", t.generalise(F.col("entity_type"), F.col("value")).alias("general"))


@query("tr04_pseudonym", f"SELECT id, {PSEUDO} AS pseudonym FROM ({VALUES}) AS v")
def tr04(spark, d):
    return derived(spark, d, VALUES).select("id", t.pseudonym(F.col("entity_type"), F.col("value"), KEY).alias("pseudonym"))


def nested(expression: str) -> str:
    for p, to in t.LOG_PATTERNS:
        expression = f"regexp_replace({expression}, '{p}', '{to}', 'g')"
    return expression


@query("tr06_log_redaction", " UNION ALL ".join(f"SELECT id, {nested('text')} AS line FROM ({s}) AS x" for s in (i.PHONE, i.NPWP)))
def tr06(spark, d):
    lines = derived(spark, d, i.PHONE).unionByName(derived(spark, d, i.NPWP))
    return lines.select("id", t.redacted_line(F.col("text")).alias("line"))


def documents(spark, d):
    return derived(spark, d, DOCS)


def emails(spark, d):
    return r.general(documents(spark, d), patterns=[r.EMAIL])


@query("spl01_redact_documents", f"SELECT id, regexp_replace(text, '{EMAIL_SQL}', '[EMAIL_REDACTED]', 'g') AS text FROM ({DOCS}) AS x")
def spl01(spark, d):
    edits = emails(spark, d).groupBy("id").agg(F.collect_list(F.struct("start_pos", "end_pos", F.lit("[EMAIL_REDACTED]").alias("replacement"))).alias("e"))
    joined = documents(spark, d).join(edits, "id", "left")
    return joined.select("id", F.when(F.col("e").isNull(), F.col("text")).otherwise(t.splice(F.col("text"), F.col("e"))).alias("text"))


def round_trip(spark, d):
    found = emails(spark, d).select("id", F.lit("EMAIL").alias("entity_type"), "start_pos", "end_pos", "value")
    tokens = protect.assign_tokens(found.select("entity_type", "value"), KEY)
    protected = protect.protect_texts(documents(spark, d), found, tokens, "id")
    originals = found.withColumn("normalised", t.normalise_value(F.col("entity_type"), F.col("value"))).groupBy("entity_type", "normalised").agg(F.min("value").alias("original"))
    mappings = tokens.join(originals, ["entity_type", "normalised"]).select("token", "original")
    return protected, mappings, protect.spellings(found, tokens, mappings, "id")


@query("rs01_token_spans", spans_sql(DOCS, EMAIL_SQL, f"id, '[[EMAIL_' || upper(left({hmac_sql('(' + chr(39) + 'EMAIL|' + chr(39) + ' || lower(value))')}, 6)) || ']]' AS token"))
def rs01(spark, d):
    return protect.find_tokens(round_trip(spark, d)[0]).select("id", "token")


@query("rs03_round_trip", f"SELECT id, text, len(regexp_extract_all(text, '{EMAIL_SQL}'))::BIGINT AS restored, 0::BIGINT AS unresolved FROM ({DOCS}) AS x")
def rs03(spark, d):
    protected, mappings, spelt = round_trip(spark, d)
    return protect.restore_texts(protected, mappings, "id", spelt=spelt).select("id", "text", "restored", "unresolved")


TOKENISED = "SELECT c_custkey AS id, 'a [[EMAIL_' || upper(left({h}, 6)) || ']] b [[PERSON_' || upper(left({h}, 8)) || ']] c' AS text FROM customer"


@query("rs05_restore_check", r"""WITH c AS (SELECT c_custkey AS id, upper(md5(c_custkey::VARCHAR)) AS h FROM customer), x AS (SELECT id, 'a [[EMAIL_' || left(h, 6) || ']] b [[PERSON_' || left(h, 8) || ']] c' AS text FROM c),
 known AS (SELECT '[[EMAIL_' || left(h, 6) || ']]' AS token FROM c UNION SELECT '[[PERSON_' || left(h, 8) || ']]' FROM c WHERE id % 3 = 0), t AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '\[\[[A-Z][A-Z0-9_]{1,31}_[A-F0-9]{6,16}\]\]')) AS token FROM x),
 g AS (SELECT id, count(*)::BIGINT AS total, count(known.token)::BIGINT AS resolved FROM t LEFT JOIN known USING (token) GROUP BY 1) SELECT *, round(resolved / total::DOUBLE * 100, 6) AS rate, resolved = total AS is_valid, resolved = total AS can_proceed FROM g""")
def rs05(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").withColumn("h", F.upper(F.md5(F.col("c_custkey").cast("string").cast("binary"))))
    token = lambda e, n: F.concat(F.lit(f"[[{e}_"), F.left("h", F.lit(n)), F.lit("]]"))
    texts = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("a "), token("EMAIL", 6), F.lit(" b "), token("PERSON", 8), F.lit(" c")).alias("text"))
    known = c.select(token("EMAIL", 6).alias("token")).unionByName(c.where("c_custkey % 3 = 0").select(token("PERSON", 8).alias("token")))
    return protect.restore_check(protect.find_tokens(texts), known, by="id")


LEAK_P = "SELECT id, entity_type, CASE id % 4 WHEN 0 THEN value WHEN 1 THEN substr(value, 2, 3) WHEN 2 THEN '[X_REDACTED]' ELSE 'fresh' || CAST(id AS STRING) END AS value FROM (" + VALUES + ") AS v"


@query("lk03_leaks", f"""WITH o AS (SELECT id, lower(value) AS v FROM ({VALUES}) AS v), p AS ({LEAK_P})
SELECT p.id, entity_type, value, CASE WHEN lower(value) = o.v THEN 'RESIDUAL' WHEN contains(o.v, lower(value)) OR contains(lower(value), o.v) THEN 'INCOMPLETE' WHEN contains(value, '_REDACTED') THEN 'INTRODUCED' ELSE 'MISSED' END AS leak FROM p JOIN o ON o.id = p.id""")
def lk03(spark, d):
    return protect.leaks(derived(spark, d, LEAK_P), derived(spark, d, VALUES), "id")


@query("snk02_protect_columns", f"SELECT c_custkey, '[[PERSON_' || upper(left({hmac_sql('(' + chr(39) + 'PERSON|' + chr(39) + ' || lower(c_name))')}, 6)) || ']]' AS c_name, c_mktsegment FROM customer")
def snk02(spark, d):
    return protect.protect_values(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment"), {"c_name": "PERSON"}, KEY)[0]


@query("sc01_vault_cipher", f"SELECT id, value AS opened, NULL::VARCHAR AS elsewhere FROM ({VALUES}) AS v")
def sc01(spark, d):
    v = derived(spark, d, VALUES).withColumn("c", protect.encrypt(F.col("value"), F.lit("p1"), "token_mappings", F.col("id").cast("string"), "original_value", KEY))
    opened = lambda row: protect.decrypt(F.col("c"), F.lit("p1"), "token_mappings", row, "original_value", KEY)
    return v.select("id", opened(F.col("id").cast("string")).alias("opened"), opened(F.lit("other")).alias("elsewhere"))


@query("sc03_hashes", "SELECT page_id, sha256(html) AS hash FROM pages")
def sc03(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", t.content_hash(F.col("html")).alias("hash"))
