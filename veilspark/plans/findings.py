"""Queries over findings: overlaps, bands, modes, filters, caps, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, resolve
from . import inputs as i
from .detection import query as _query
from .inputs import derived

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    return _query(name, sql, QUERIES, ORACLES)


BASE = f"WITH RECURSIVE f AS MATERIALIZED ({i.FINDINGS})"
KEPT = "segment_id, finding_id, entity_type, start_pos, end_pos, score"
COLUMNS = KEPT.split(", ")
PRIO = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in resolve.PRIORITY.items()) + "}"
TPRIO = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in resolve.TEXT_PRIORITY.items()) + "}"


def findings(spark, d):
    return derived(spark, d, i.FINDINGS)


def fold_sql(order: str, extra: str, step: str) -> str:
    """A fold in DuckDB: rows of a segment by ``order``; ``step``: the next list from acc and x (a struct of the row)."""
    row = "{'finding_id': finding_id, 'entity_type': entity_type, 's': start_pos, 'e': end_pos, 'score': score, 'p': p}"
    return f"""{BASE}, o AS MATERIALIZED (SELECT segment_id, row_number() OVER (PARTITION BY segment_id ORDER BY {order}, entity_type, end_pos, finding_id) AS n, {row} AS x
  FROM (SELECT *, {extra} AS p FROM f)), z AS (
  SELECT segment_id, 0::BIGINT AS n, list_filter([x], lambda y: false) AS acc FROM o WHERE n = 1 UNION ALL
  SELECT z.segment_id, o.n, {step} FROM z JOIN o ON o.segment_id = z.segment_id AND o.n = z.n + 1),
 l AS (SELECT segment_id, unnest(arg_max(acc, n)) AS k FROM z GROUP BY 1)
SELECT segment_id, k.finding_id AS finding_id, k.entity_type AS entity_type, k.s AS start_pos, k.e AS end_pos, k.score AS score FROM l"""


HIT = "y.s < x.e AND x.s < y.e"
FIRST = fold_sql("start_pos, score DESC, start_pos - end_pos", "0", f"CASE WHEN len(list_filter(acc, lambda y: {HIT})) > 0 THEN acc ELSE list_append(acc, x) END")


@query("ov02_first_wins", FIRST)
def ov02(spark, d):
    return resolve.first_wins(findings(spark, d)).select(*COLUMNS)


WINS1 = "(x.score > old.score + 0.05 OR (NOT old.score > x.score + 0.05 AND x.e - x.s > old.e - old.s))".replace("old", f"list_filter(acc, lambda y: {HIT})[1]")


@query("ov01_by_margin", fold_sql("start_pos, -end_pos", "0", f"CASE WHEN len(list_filter(acc, lambda y: {HIT})) = 0 THEN list_append(acc, x) WHEN {WINS1} THEN list_append(list_filter(acc, lambda w: w.finding_id <> list_filter(acc, lambda y: {HIT})[1].finding_id), x) ELSE acc END"))
def ov01(spark, d):
    return resolve.by_margin(findings(spark, d)).select(*COLUMNS)


CLOSE = "y.s < x.e AND x.s < y.e AND least(x.e, y.e) - greatest(x.s, y.s) >= 0.5 * least(x.e - x.s, y.e - y.s)"
BEATS = "(CASE WHEN (x.entity_type = 'CUSTOM') <> (y.entity_type = 'CUSTOM') THEN x.entity_type = 'CUSTOM' WHEN x.p <> y.p THEN x.p > y.p ELSE x.score >= y.score END)"


@query("ov03_priority", fold_sql("start_pos, score DESC", f"{PRIO}[entity_type]", f"CASE WHEN len(list_filter(acc, lambda y: {CLOSE} AND NOT {BEATS})) > 0 THEN acc ELSE list_append(list_filter(acc, lambda y: NOT ({CLOSE})), x) END"))
def ov03(spark, d):
    return resolve.by_priority(findings(spark, d)).select(*COLUMNS)


@query("ov04_last_kept", fold_sql("start_pos", f"coalesce({TPRIO}[entity_type], 5)", "CASE WHEN len(acc) = 0 OR x.s >= acc[-1].e THEN list_append(acc, x) WHEN x.p > acc[-1].p OR (x.p = acc[-1].p AND x.e - x.s > acc[-1].e - acc[-1].s) THEN list_append(acc[1:len(acc) - 1], x) ELSE acc END"))
def ov04(spark, d):
    return resolve.against_last(findings(spark, d)).select(*COLUMNS)


@query("ov04b_greedy_score", fold_sql("score DESC, start_pos", "0", f"CASE WHEN len(list_filter(acc, lambda y: {HIT})) > 0 THEN acc ELSE list_append(acc, x) END"))
def ov04b(spark, d):
    return resolve.greedy_by_score(findings(spark, d)).select(*COLUMNS)


SEV = "MAP {" + ", ".join(f"'{k}': {('low', 'medium', 'high', 'critical').index(v)}" for k, v in classify.SEVERITY.items()) + "}"
RANK = "[{a}.p, {a}.score, {a}.e - {a}.s, -{a}.s]"
LESS = f"{RANK.format(a='y')} < {RANK.format(a='x')}"
BEST = BASE.replace("f AS MATERIALIZED (", "f AS MATERIALIZED (SELECT * FROM (").removesuffix(")") + ") QUALIFY row_number() OVER (PARTITION BY segment_id, entity_type, start_pos, end_pos ORDER BY score DESC, finding_id) = 1)"


@query("ov04c_severity", fold_sql("start_pos, start_pos - end_pos", f"coalesce({SEV}[entity_type], 1)", f"CASE WHEN len(list_filter(acc, lambda y: {HIT})) = 0 THEN list_append(acc, x) ELSE list_transform(acc, lambda y: CASE WHEN y.finding_id = list_filter(acc, lambda w: w.s < x.e AND x.s < w.e)[1].finding_id AND ({LESS}) THEN x ELSE y END) END").replace(BASE, BEST))
def ov04c(spark, d):
    f = findings(spark, d).withColumn("severity", classify.severity(F.col("entity_type")))
    return resolve.by_severity(f).select(*COLUMNS)


@query("ov05_pairs", f"""{BASE} SELECT a.segment_id, a.finding_id AS finding_id_a, b.finding_id AS finding_id_b, least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) AS shared,
 round((least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) / least(a.end_pos - a.start_pos, b.end_pos - b.start_pos)::DOUBLE, 6) AS ratio,
 (a.start_pos <= b.start_pos AND a.end_pos >= b.end_pos) OR (b.start_pos <= a.start_pos AND b.end_pos >= a.end_pos) AS contained
 FROM f a JOIN f b ON a.segment_id = b.segment_id AND a.finding_id < b.finding_id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos""")
def ov05(spark, d):
    return resolve.overlapping_pairs(findings(spark, d))


@query("ov06_merge_adjacent", f"""{BASE}, n AS (SELECT *, CASE WHEN lag(entity_type) OVER w = entity_type AND start_pos - lag(end_pos) OVER w <= 1 THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY segment_id ORDER BY start_pos, entity_type, end_pos)),
 r AS (SELECT *, sum(new) OVER (PARTITION BY segment_id ORDER BY start_pos, entity_type, end_pos ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT segment_id, first(entity_type) AS entity_type, min(start_pos) AS start_pos, arg_max(end_pos, [start_pos, end_pos]) AS end_pos, string_agg(value, '' ORDER BY start_pos, entity_type, end_pos, value) AS value, max(score) AS score, count(*)::BIGINT AS parts FROM r GROUP BY segment_id, run""")
def ov06(spark, d):
    return resolve.merge_adjacent(findings(spark, d))


def band_sql(mode: str, score: str = "score") -> str:
    table = classify.THRESHOLDS[mode]
    arms = ""
    for e in ("ID_NIK", "EMAIL_ADDRESS", "PERSON", "CREDIT_CARD", "PHONE_NUMBER", "CUSTOM"):
        h, m, low = table[classify.GROUP_OF.get(e.lower().replace("_", ""), "default")]
        arms += f" WHEN '{e}' THEN CASE WHEN {score} < {low} THEN NULL WHEN {score} >= {h} THEN 'HIGH' WHEN {score} >= {m} THEN 'MEDIUM' ELSE 'LOW' END"
    return f"CASE entity_type{arms} END"


@query("ag01_band", f"{BASE} SELECT finding_id, entity_type, score, {band_sql('balanced')} AS band FROM f WHERE {band_sql('balanced')} IS NOT NULL")
def ag01(spark, d):
    return classify.classify(findings(spark, d)).select("finding_id", "entity_type", "score", "band")


@query("ag02_modes", f"{BASE} SELECT *, strict_count - balanced_count AS strict_only, balanced_count - minimal_count AS minimal_excluded FROM (SELECT count({band_sql('strict')})::BIGINT AS strict_count, count({band_sql('balanced')})::BIGINT AS balanced_count, count(*) FILTER ({band_sql('minimal')} IN ('HIGH', 'MEDIUM'))::BIGINT AS minimal_count FROM f)")
def ag02(spark, d):
    return classify.compare_modes(findings(spark, d))


STATS = "count(*)::BIGINT AS total, count(*) FILTER (band = 'HIGH')::BIGINT AS high, count(*) FILTER (band = 'MEDIUM')::BIGINT AS medium, count(*) FILTER (band = 'LOW')::BIGINT AS low, count(*) FILTER (band IS NULL)::BIGINT AS unclassified, round(avg(score), 6) AS avg_score, min(score) AS min_score, max(score) AS max_score, count(*) FILTER (band IN ('HIGH', 'MEDIUM'))::BIGINT AS protectable"


@query("ag03_statistics", f"{BASE} SELECT entity_type, {STATS} FROM (SELECT *, {band_sql('strict')} AS band FROM f) GROUP BY 1")
def ag03(spark, d):
    return classify.statistics(findings(spark, d).withColumn("band", classify.band(F.col("entity_type"), F.col("score"), "strict")), "entity_type")


@query("ag04_running_stats", f"{BASE} SELECT entity_type, CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS band, count(*)::BIGINT AS findings, sum(end_pos - start_pos)::BIGINT AS characters, count(DISTINCT segment_id)::BIGINT AS segments FROM f GROUP BY 1, 2")
def ag04(spark, d):
    return classify.running_statistics(findings(spark, d), "segment_id")


TREAT = "CASE finding_id % 4 WHEN 0 THEN 'TOKEN' WHEN 1 THEN 'REDACT' WHEN 2 THEN 'KEEP' ELSE 'MASK' END"


@query("ag05_plan_counters", f"{BASE} SELECT count(*)::BIGINT AS findings, count(*) FILTER ({TREAT} <> 'KEEP')::BIGINT AS to_treat, count(*) FILTER ({TREAT} = 'TOKEN')::BIGINT AS tokens, count(*) FILTER ({TREAT} = 'KEEP')::BIGINT AS kept FROM f")
def ag05(spark, d):
    return classify.plan_counters(findings(spark, d).withColumn("treatment", F.expr(TREAT)))


@query("ag06_groups", f"{BASE} SELECT sha256(value) AS value_hash, entity_type, count(*)::BIGINT AS findings, count(DISTINCT segment_id)::BIGINT AS files, count(DISTINCT segment_id) = 1 AS same_file FROM f GROUP BY 1, 2")
def ag06(spark, d):
    return classify.value_groups(findings(spark, d), "segment_id")


@query("ag07_entity_counts", f"{BASE} SELECT segment_id, entity_type, count(*)::BIGINT AS findings FROM f GROUP BY 1, 2")
def ag07(spark, d):
    return classify.entity_counts(findings(spark, d), "segment_id")


SEV_CASE = "CASE entity_type" + "".join(f" WHEN '{k}' THEN {('low', 'medium', 'high', 'critical').index(v)}" for k, v in classify.SEVERITY.items()) + " ELSE 1 END"


@query("ag08_risk", f"{BASE} SELECT segment_id, count(*)::BIGINT AS findings, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][(CASE WHEN max({SEV_CASE}) = 1 AND count(*) FILTER ({SEV_CASE} >= 1) >= 2 THEN 2 ELSE max({SEV_CASE}) END)::INT + 1] AS risk FROM f GROUP BY 1")
def ag08(spark, d):
    return classify.risk(findings(spark, d).withColumn("severity", classify.severity(F.col("entity_type"))), "segment_id")


@query("wn01_caps", f"""{BASE}, a AS (SELECT *, min(start_pos) OVER (PARTITION BY segment_id, entity_type) AS fs, row_number() OVER (PARTITION BY segment_id, entity_type ORDER BY start_pos, end_pos, entity_type) AS n FROM f)
SELECT segment_id, entity_type, start_pos, end_pos FROM a WHERE n <= 1 QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY fs, entity_type, start_pos, end_pos) <= 3""")
def wn01(spark, d):
    return resolve.cap_per_type(findings(spark, d), 1, 3).select("segment_id", "entity_type", "start_pos", "end_pos")


@query("wn02_top_by_score", f"{BASE} SELECT segment_id, entity_type, start_pos, end_pos, score FROM f QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, start_pos, entity_type, end_pos) <= 2")
def wn02(spark, d):
    return resolve.top_by_score(findings(spark, d), 2).select("segment_id", "entity_type", "start_pos", "end_pos", "score")


@query("wn03_first_of_value", f"{BASE} SELECT segment_id, value, entity_type FROM f QUALIFY row_number() OVER (PARTITION BY segment_id, value ORDER BY start_pos, entity_type, end_pos) = 1")
def wn03(spark, d):
    return resolve.first_of_value(findings(spark, d)).select("segment_id", "value", "entity_type")


@query("fl01_admit", f"{BASE} SELECT finding_id FROM f WHERE entity_type IN ('ID_NIK', 'PERSON') AND score >= 0.6 AND NOT regexp_matches(value, '^v1')")
def fl01(spark, d):
    return classify.admitted(findings(spark, d), ["ID_NIK", "PERSON"], 0.6, ["^v1"]).select("finding_id")


NAMES = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '  ' || upper(p_name) ELSE p_name END AS value FROM part"


@query("fl02_deny_list", f"""WITH f AS ({NAMES}), t AS (SELECT DISTINCT term FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS term FROM part) AS w WHERE md5(term) < '9' UNION SELECT DISTINCT lower(p_name) FROM part WHERE p_partkey % 7 = 0),
 v AS (SELECT id, regexp_replace(trim(lower(value)), '\\s+', ' ', 'g') AS v FROM f),
 k AS (SELECT id, v, unnest(list_filter(regexp_split_to_array(v, '[\\s\\-]+'), lambda x: x <> '')) AS tok FROM v),
 m AS (SELECT k.id, count(*) AS n, count(t.term) AS hit FROM k LEFT JOIN t ON t.term = k.tok GROUP BY 1)
SELECT v.id FROM v LEFT JOIN m USING (id) WHERE v.v NOT IN (SELECT term FROM t) AND NOT coalesce(m.n > 1 AND m.n = m.hit, false)""")
def fl02(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    words = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).where(F.md5(F.col("term").cast("binary")) < "9")
    terms = words.unionByName(part.where("p_partkey % 7 = 0").select(F.lower("p_name").alias("term")))
    return classify.without_denied(derived(spark, d, NAMES), terms).select("id")


@query("fl03_allow_list", f"WITH f AS ({NAMES}) SELECT id FROM f WHERE lower(value) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 5 = 0)")
def fl03(spark, d):
    allowed = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 5 = 0").select(F.col("p_name").alias("term"))
    return classify.without_allowed(derived(spark, d, NAMES), allowed).select("id")


@query("fl07_criteria", f"{BASE} SELECT finding_id FROM (SELECT *, {band_sql('balanced')} AS band FROM f) WHERE band IN ('HIGH', 'MEDIUM') AND entity_type IN ('PERSON', 'EMAIL_ADDRESS', 'CREDIT_CARD') AND entity_type <> 'PERSON' AND score BETWEEN 0.5 AND 0.95 AND recognizer = 'regex' AND end_pos - start_pos > 4")
def fl07(spark, d):
    f = classify.classify(findings(spark, d))
    found = classify.matching(f, ["HIGH", "MEDIUM"], ["PERSON", "EMAIL_ADDRESS", "CREDIT_CARD"], ["PERSON"], 0.5, 0.95, ["regex"], F.col("end_pos") - F.col("start_pos") > 4)
    return found.select("finding_id")


LEAST = "CASE entity_type" + "".join(f" WHEN '{k}' THEN {v}" for k, v in classify.LEAST_SCORE.items()) + " ELSE 0.8 END"


@query("fl08_policy", f"{BASE} SELECT entity_type, ['low', 'medium', 'high', 'critical'][{SEV_CASE} + 1] AS severity, count(*) FILTER (score >= {LEAST})::BIGINT AS passing, count(*)::BIGINT AS findings FROM f GROUP BY 1, 2")
def fl08(spark, d):
    f = findings(spark, d).withColumn("severity", classify.severity(F.col("entity_type")))
    return f.groupBy("entity_type", "severity").agg(F.count_if(classify.passes_policy(F.col("entity_type"), F.col("score"))).alias("passing"), F.count("*").alias("findings"))
