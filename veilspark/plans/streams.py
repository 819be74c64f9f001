"""Queries of the guard, as batches over the events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recognizers as r
from ..operators import resolve
from ..streaming import guard, live
from . import inputs as i
from .detection import query as _query
from .inputs import AS_OF, derived

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    return _query(name, sql, QUERIES, ORACLES)


@query("str01_debounce", """WITH e AS (SELECT user_id, ts, event_type || event_id::VARCHAR AS text FROM events), n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM e),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM n)
SELECT user_id, arg_max(text, [epoch_us(ts)::VARCHAR, text]) AS text, count(*)::BIGINT AS events FROM s GROUP BY user_id, burst""")
def str01(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    return guard.debounce(e, "user_id", "1 hour").select("user_id", "text", "events")


@query("str03_own_writes", """WITH e AS (SELECT user_id, ts, event_id, event_type AS text FROM events), w AS (SELECT * FROM e WHERE event_id % 50 = 0),
 x AS (SELECT DISTINCT first_value(e.event_id) OVER (PARTITION BY w.user_id, w.ts, w.text ORDER BY e.ts, e.event_id) AS event_id FROM e JOIN w ON e.user_id = w.user_id AND e.text = w.text AND e.ts BETWEEN w.ts AND w.ts + INTERVAL 3600 SECOND)
SELECT event_id FROM e WHERE event_id NOT IN (SELECT event_id FROM x)""")
def str03(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", F.col("event_type").alias("text"))
    return guard.without_own_writes(e, e.where("event_id % 50 = 0"), "user_id", 3600).select("event_id")


@query("str05_judge")
def str05(spark, d):
    texts = derived(spark, d, i.PHONE).unionByName(derived(spark, d, i.NPWP).withColumn("id", F.col("id") + 10_000_000))
    return guard.judge(texts, AS_OF)


@query("flagship_counts", r"""WITH RECURSIVE t AS (SELECT doc_id AS id, lang, coalesce(text, '') AS text FROM documents), p(no, e, s) AS (VALUES (0, 'EMAIL_ADDRESS', 0.9::DOUBLE), (1, 'IP_ADDRESS', 0.95::DOUBLE), (2, 'ID_NIK', 0.5::DOUBLE)),
 m AS (SELECT id, lang, e, s, CASE no WHEN 0 THEN regexp_extract_all(text, '(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b') WHEN 1 THEN regexp_extract_all(text, '\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b') ELSE regexp_extract_all(text, '\b\d{16}\b') END AS found FROM t, p)
SELECT lang, e AS entity_type, count(*)::BIGINT AS findings, count(DISTINCT id)::BIGINT AS documents, max(s) AS best FROM (SELECT id, lang, e, s, unnest(found) AS v FROM m) GROUP BY 1, 2""")
def flagship(spark, d):
    """Mail, IPv4 and 16-digit findings, overlaps resolved, counted by language and type."""
    from ..functions.text import Pattern, find_spans

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    found = find_spans(docs, "text", [r.EMAIL, r.IPS[0], Pattern("ID_NIK", r"(?U)\b\d{16}\b", 0.5)]).drop("pattern_no")
    kept = resolve.first_wins(found, "doc_id")
    return kept.groupBy("lang", "entity_type").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("documents"), F.max("score").alias("best"))


#: Half an hour of quiet and an hour between scans, so that texts wait for their turn.
TEXTS = "SELECT user_id, ts, event_id, event_type AS text FROM events"


@query(
    "str01_coalesced",
    f"""WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) AS at, row_number() OVER w AS rn, lead(epoch_us(ts)) OVER w AS later FROM ({TEXTS}) AS t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (
  SELECT DISTINCT user_id, 0::BIGINT AS rn, NULL::BIGINT AS last, NULL::BIGINT AS event_id FROM e
  UNION ALL
  SELECT user_id, rn, CASE WHEN goes THEN due ELSE last END, CASE WHEN goes THEN event_id END FROM (
    SELECT *, later IS NULL OR due < later AS goes FROM (
      SELECT r.user_id, e.rn, r.last, e.later, e.event_id, greatest(e.at + 1800000000, coalesce(r.last + 3600000000, e.at)) AS due FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)))
SELECT user_id, event_id, last AS scanned_us FROM r WHERE event_id IS NOT NULL""",
)
def str01_coalesced(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("text"))
    return live.coalesced(e, "user_id", 1800, 3600).select("user_id", "event_id", F.unix_micros("scanned").alias("scanned_us"))


RESULTS = "SELECT user_id, event_id, ts, event_id % 4 = 0 AS names, CAST(event_id % 2 AS INT) AS generation, CASE WHEN event_id % 7 = 0 THEN 'g' ELSE 'f' END AS fingerprint FROM events"


@query(
    "str04_shown_results",
    f"""SELECT user_id, event_id FROM (
  SELECT *, last_value(CASE WHEN names THEN generation END IGNORE NULLS) OVER w AS g, last_value(CASE WHEN names THEN fingerprint END IGNORE NULLS) OVER w AS f FROM ({RESULTS}) AS r
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
WHERE NOT names AND g = generation AND f = fingerprint AND event_id % 9 <= 5""",
)
def str04_shown(spark, d):
    e = derived(spark, d, RESULTS).withColumn("seen", F.col("ts").cast("timestamp")).withColumn("created", F.timestamp_micros(F.unix_micros("seen") - F.col("event_id") % 9 * 1_000_000)).drop("ts")
    return live.shown_results(e.where("not names"), e.where("names"), "user_id").select("user_id", "event_id")
