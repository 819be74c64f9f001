"""Secret scans over an incremental ledger of blobs.

Every historical version of a text is content-addressed by its SHA-256. The ledger holds the (blob, rule, rule version)
triples that were scanned already; only the others are scanned, once for each blob, and the findings are joined back to all
paths that ever held the blob. Only DataFrame functions are used: match offsets come from the lengths of the matches and of
the gaps between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``value``: the group whose length must reach ``least``."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1
    version: int = 1


#: The three base rules of the result contract (a run of fewer than ``least`` letters of its class is no match, so the class
#: rules ask for the length at once), in the order in which they are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", value=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds of secrets besides the base ones.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
RULES = BASE + MORE


def _matches(rule: Rule) -> Column:
    """array<struct<kind, i, gap, match>> of one text; the gap is the text between the match before and this one."""
    found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    gaps = F.split("text", rule.pattern, -1)
    zipped = F.transform(found, lambda m, i: F.struct(F.lit(rule.kind).alias("kind"), i.alias("i"), F.length(F.element_at(gaps, i + 1)).alias("gap"), m.alias("match")))
    return F.when(F.array_contains("todo", rule.kind) & F.col("text").rlike(rule.pattern), zipped).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,match:string>>"))


def blob_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def scan(history: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """``history``: (path, version, text); ``ledger``: (blob, rule, rule_version) scanned before, or None.

    Returns the new findings (blob, kind, start, end; code points, end exclusive) and the triples to add to the ledger. A null text
    is the empty blob; repeated versions are one blob; an empty history gives empty results; further columns are ignored.
    """
    spark = history.sparkSession
    seen = history.select("path", "version", blob_of(text_or_empty()).alias("blob"))
    blobs = seen.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    todo = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    if ledger is None:
        pairs = None
        work = blobs.withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
        scanned = blobs.select("blob", F.explode(todo).alias("p")).select("blob", "p.*")
    else:
        pairs = blobs.select("blob", "at", F.explode(todo).alias("p")).select("blob", "at", "p.*").join(ledger, ["blob", "rule", "rule_version"], "left_anti")
        work = pairs.groupBy("blob", "at").agg(F.collect_set("rule").alias("todo"))
        scanned = pairs.select("blob", "rule", "rule_version")
    work = work.select(F.col("blob").alias("_blob"), F.col("at.path").alias("_path"), F.col("at.version").alias("_version"), "todo")
    texts = history.select("path", "version", text_or_empty().alias("text")).withColumn("blob", blob_of(F.col("text")))
    on = (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path")) & F.col("version").eqNullSafe(F.col("_version"))
    hits = (
        texts.join(work, on).withColumn("row", F.monotonically_increasing_id())
        .select("blob", "row", F.explode(F.concat(*[_matches(r) for r in rules])).alias("m")).select("blob", "row", "m.*")
    )
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(order)
    ended = hits.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    long_enough = F.lit(False)
    for r in rules:
        long_enough = F.when(F.col("kind") == r.kind, F.length(F.regexp_extract("match", r.pattern, r.value)) >= r.least).otherwise(long_enough)
    findings = ended.where(long_enough).select("blob", "kind", F.col("start").cast("long"), F.col("end").cast("long"))
    return findings.distinct(), scanned


def spans_by_path(history: DataFrame, findings: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """(path, version, n_<base kind>..., base_sha256, spans) for every version: ``findings`` joined back by blob."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    listed = findings.select("blob", F.struct(F.col("start"), rank[F.col("kind")].alias("rank"), F.col("end"), F.col("kind")).alias("s"))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    every = F.array_sort(F.collect_list("s"))
    digest = listed.groupBy("blob").agg(
        *[F.count_if(F.col("s.kind") == r.kind).alias(f"n_{r.kind}") for r in base], joined(F.filter(every, lambda s: s["rank"] < len(base))).alias("base"), joined(every).alias("spans")
    )
    # a blob may be held by a third of all paths
    seen = materialize(history.select("path", "version", blob_of(text_or_empty()).alias("blob")), "secret-paths")
    held = digest.join(seen.groupBy("blob").agg(F.count("*").alias("paths")), "blob")
    met = join_hot(seen, materialize(held, "secret-digests"), "blob", "paths", seen.count(), "left")
    return met.select(
        "path", "version", "blob", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in base],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def document_secrets(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs``.

    Documents come in ``rounds`` deliveries, dealt by a hash of their ids. Each is scanned against the ledger that those before it wrote, so a blob that an earlier
    delivery held isn't scanned again; findings of all deliveries are joined back to all documents. Null texts are empty; repeated rows each have
    their result; an empty table gives an empty result.
    """
    history = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    delivery = F.pmod(F.xxhash64("path"), F.lit(rounds))
    found = ledger = None
    for turn in range(rounds):
        findings, scanned = scan(history.where(delivery == turn), ledger)
        findings, scanned = materialize(findings, "secret-findings"), materialize(scanned, "secret-ledger")
        found, ledger = (findings, scanned) if found is None else (found.unionByName(findings), ledger.unionByName(scanned))
    out = spans_by_path(history, found)
    return out.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


SQL = r"""
WITH rules(kind, rank, p, least) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  ('access', 1, 'AKIA[A-Z0-9]+', 20), ('hex', 2, '[0-9a-f]+', 24),
  ('private_key', 3, '-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----', 1), ('host_token', 4, 'gh[pousr]_[A-Za-z0-9]{36,}', 1),
  ('web_token', 5, 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}', 1)),
m AS (
  SELECT doc_id, kind, rank, least,
    CASE rank WHEN 0 THEN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') WHEN 2 THEN regexp_extract_all(t, '[0-9a-f]+')
      WHEN 3 THEN regexp_extract_all(t, '-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----') WHEN 4 THEN regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]{36,}')
      ELSE regexp_extract_all(t, 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}') END AS found,
    CASE rank WHEN 0 THEN regexp_split_to_array(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 1 THEN regexp_split_to_array(t, 'AKIA[A-Z0-9]+') WHEN 2 THEN regexp_split_to_array(t, '[0-9a-f]+')
      WHEN 3 THEN regexp_split_to_array(t, '-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----') WHEN 4 THEN regexp_split_to_array(t, 'gh[pousr]_[A-Za-z0-9]{36,}')
      ELSE regexp_split_to_array(t, 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}') END AS gaps
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), rules),
u AS (SELECT doc_id, kind, rank, least, unnest(found) AS s, unnest(gaps[1:len(found)]) AS g, unnest(range(len(found))) AS i FROM m),
e AS (SELECT *, sum(length(g) + length(s)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS fin FROM u),
f AS (
  SELECT doc_id, kind, rank, fin - length(s) AS start, fin FROM e
  WHERE (CASE rank WHEN 0 THEN length(regexp_extract(s, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) ELSE length(s) END) >= least),
d AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base,
    string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN d USING (doc_id)
"""
