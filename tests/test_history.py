"""Literal cases of the history, of stores read in order, of the sealed store of terms and of restore durations."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilspark.operators import history as h
from veilspark.operators import protect, terms
from veilspark.operators import repositories as rp

HISTORY = "project_id string, ts timestamp, event_id int, event_type string, operation_id string, file_count int, findings_count int, tokens_generated int, tokens_restored int, duration_ms double, entity_types array<string>"


@pytest.fixture
def events(spark):
    rows = [
        ("p", "2024-01-01 00:00:00", 1, "scan_completed", "a", 2, 5, None, 0, 1500.0, ["ID_NIK", "PERSON"]), ("p", "2024-01-03 00:00:00", 2, "protection_failed", "b", 1, 0, 7, None, None, ["PERSON", None]),
        ("p", "2024-01-03 00:00:00", 3, "restore_completed", None, None, None, None, 4, 500.0, None), (None, "2024-01-02 00:00:00", 4, "scan_failed", "c", 1, 1, 1, 1, 1.0, []), ("q", None, 5, "project_opened", None, 0, 0, 0, 0, 0.0, None),
    ]
    return spark.createDataFrame([(p, None, *rest) if ts is None else (p, ts, *rest) for p, ts, *rest in rows], HISTORY.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))


def test_report_of_a_project(spark, events):
    got = {x.project_id: x for x in h.report(events, most_events=2).collect()}
    p = got["p"]
    assert (p.total_operations, p.total_files, p.total_findings, p.tokens_generated, p.tokens_restored, p.seconds) == (3, 3, 5, 7, 4, 2.0)
    assert (p.scans_completed, p.scans_failed, p.protections_completed, p.protections_failed, p.restores_completed, p.restores_failed) == (1, 0, 0, 1, 1, 0)
    assert p.entity_types == {"ID_NIK": 1, "PERSON": 2} and [e.event_id for e in p.events] == [3, 2] and p.first_at.day == 1 and p.last_at.day == 3
    assert got[None].scans_failed == 1 and got[None].entity_types == {} and [e.event_id for e in got[None].events] == [4]
    assert got["q"].first_at is None and got["q"].entity_types == {} and [e.event_id for e in got["q"].events] == [5]
    assert "events" not in h.report(events).columns and h.report(events.limit(0), most_events=5).count() == 0


def test_report_holds_one_hot_project(spark):
    many = spark.range(20_000).select((F.col("id") % 1).cast("string").alias("project_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("int").alias("event_id"), F.lit("scan_completed").alias("event_type"), F.lit("o").alias("operation_id"), *[F.lit(1).alias(c) for c in ("file_count", "findings_count", "tokens_generated", "tokens_restored")], F.lit(1.0).alias("duration_ms"), F.array(F.lit("X")).alias("entity_types"))
    report = h.report(many, most_events=h.MOST_EVENTS)
    (p,) = report.collect()
    assert [e.event_id for e in p.events] == list(range(19_999, 18_999, -1)) and p.entity_types == {"X": 20_000}
    assert "WindowGroupLimit" in report._jdf.queryExecution().executedPlan().toString()


def test_deleting_and_cleaning_up(events):
    ids = lambda df: sorted(x.event_id for x in df.collect())
    assert ids(h.without(events, who="p")) == [4, 5] and ids(h.without(events, before="2024-01-03 00:00:00")) == [2, 3, 5]
    assert [tuple(x) for x in h.removed(events, who="p").collect()] == [("p", 3)]
    assert sorted((x.project_id or "", x.removed) for x in h.removed(events, before="2024-01-03 00:00:00").collect()) == [("", 1), ("p", 1)]
    for wrong in ({}, {"who": "p", "before": "2024-01-01"}):
        with pytest.raises(ValueError, match="either"):
            h.without(events, **wrong)


def test_stores_come_in_their_order(spark):
    projects = spark.createDataFrame([(1, "2024-01-01", None), (2, "2023-01-01", "2024-03-01"), (3, "2024-02-01", "2022-01-01"), (4, "2024-03-01", None), (5, None, None)], "id int, updated_at string, last_opened_at string")
    assert [x.id for x in rp.projects(projects.repartition(3)).collect()] == [2, 4, 1, 3, 5]
    ops = spark.createDataFrame([(1, "p", 3, True), (2, "p", 9, False), (3, "q", 1, True), (4, "p", 3, True), (5, "p", 1, None)], "id int, project_id string, at int, enabled boolean").repartition(3)
    assert [x.id for x in rp.of_project(ops, "p", "at").collect()] == [2, 1, 4, 5] and [x.id for x in rp.of_project(ops, "p", "at", limit=2).collect()] == [2, 1]
    made = ops.withColumnRenamed("at", "created_at")
    assert [x.id for x in rp.rules(made, "p").collect()] == [1, 4] and [x.id for x in rp.rules(made, "p", enabled_only=False).collect()] == [5, 1, 4, 2]


def test_sealed_terms(spark):
    rows = [(1, "Budi \"B\"", "word", "PERSON", True), (2, "é😀", "contains", "CUSTOM_TERM", False), (3, "", "exact", None, None)]
    table = spark.createDataFrame(rows, "id int, term string, kind string, entity_type string, case_sensitive boolean")
    key, other = bytes(range(32)), bytes(32)
    store = terms.sealed_terms(table, "p", key)
    assert sorted(tuple(x) for x in terms.opened_terms(store, "p", key).collect()) == rows
    for opened in (lambda: terms.opened_terms(store, "q", key), lambda: terms.opened_terms(store, "p", other), lambda: terms.opened_terms(store.withColumn("id", F.col("id") + 1), "p", key), lambda: terms.opened_terms(store.withColumn("cipher", F.substring("cipher", F.lit(1), F.length("cipher") - 1)), "p", key)):
        with pytest.raises(PySparkException, match="does not open"):
            opened().collect()
    assert terms.opened_terms(store, "q", key, strict=False).count() == 0
    broken = store.withColumn("cipher", F.when(F.col("id") != 2, F.col("cipher")))
    assert sorted(x.id for x in terms.opened_terms(broken, "p", key, strict=False).collect()) == [1, 3]


def test_restore_durations(spark):
    rows = [("x", 2, 1, "2024-01-01 00:00:00", "2024-01-01 00:00:01.5"), ("x", 0, 0, "2024-01-01 00:00:02", "2024-01-01 00:00:02.25"), ("x", 0, 1, "2024-01-01 00:00:03", None), ("y", 0, 0, None, None), ("z", 1, 0, "2024-01-01 00:00:05", "2024-01-01 00:00:04")]
    df = spark.createDataFrame(rows, "kind string, restored long, unresolved long, a string, b string").withColumns({"a": F.col("a").cast("timestamp"), "b": F.col("b").cast("timestamp")})
    got = {x.kind: x for x in protect.restore_metrics(df, "kind", started="a", completed="b").collect()}
    assert (got["x"].total_ms, got["x"].slowest_ms, got["x"].elapsed_ms, got["x"].unfinished, got["x"].rate) == (1750.0, 1500.0, 2250.0, 1, 50.0)
    assert (got["y"].total_ms, got["y"].slowest_ms, got["y"].elapsed_ms, got["y"].unfinished, got["y"].rate) == (0.0, 0.0, 0.0, 0, 100.0)
    assert (got["z"].total_ms, got["z"].elapsed_ms) == (0.0, 0.0) and "total_ms" not in protect.restore_metrics(df, "kind").columns
