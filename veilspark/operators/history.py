"""Reports of the operation history, and what deleting a project or cleaning up takes away.

A history has a project, ts, event_id, event_type, operation_id, file_count, findings_count, tokens_generated, tokens_restored, duration_ms (nulls count as
nothing) and entity_types (an array; null counts as empty). Events without a project are a project of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Operations whose ends are counted, and how many events a report lists at most.
OPERATIONS, ENDS, MOST_EVENTS = ["scan", "protection", "restore"], ["completed", "failed"], 1000


def distribution(history: DataFrame, project: str = "project_id") -> DataFrame:
    """(project, entity_types): how many events name each entity type, as a map in the order of the names. Events are counted before types meet."""
    counts = history.select(project, F.explode("entity_types").alias("_type")).where(F.col("_type").isNotNull()).groupBy(project, "_type").agg(F.count("*").alias("_n"))
    return counts.groupBy(project).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_type", "_n")))).alias("entity_types"))


def newest(history: DataFrame, most: int = MOST_EVENTS, project: str = "project_id") -> DataFrame:
    """(project, events): the newest ``most`` events of each project, newest first. A project's surplus goes before its events move."""
    place = F.row_number().over(Window.partitionBy(project).orderBy(F.col("ts").desc_nulls_last(), F.desc("event_id")))
    listed = history.withColumn("_place", place).where(F.col("_place") <= most)
    item = F.struct("_place", F.struct("event_id", "event_type", "ts", "operation_id"))
    return listed.groupBy(project).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["col2"]).alias("events"))


def report(history: DataFrame, project: str = "project_id", most_events: int | None = None) -> DataFrame:
    """One row a project: total_operations, total_files, total_findings, tokens_generated, tokens_restored, seconds, the completed and failed scans, protections and
    restores, first_at, last_at, entity_types (map to the number of events), and with ``most_events`` its newest events.

    No history gives no row; a project whose events name no types has an empty map.
    """
    amount = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("long")
    ends = [F.count_if(F.col("event_type") == f"{o}_{e}").alias(f"{o}s_{e}") for o in OPERATIONS for e in ENDS]
    out = history.groupBy(project).agg(
        F.count("*").alias("total_operations"), amount("file_count").alias("total_files"), amount("findings_count").alias("total_findings"), amount("tokens_generated").alias("tokens_generated"),
        amount("tokens_restored").alias("tokens_restored"), F.round(F.coalesce(F.sum("duration_ms"), F.lit(0.0)) / 1000, 6).alias("seconds"), *ends, F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
    )

    def beside(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        met = right.withColumnRenamed(project, "_p")
        return left.join(met, F.col(project).eqNullSafe(F.col("_p")), "left").drop("_p").withColumn(name, F.coalesce(name, F.expr("map()" if name == "entity_types" else "array()").cast(right.schema[name].dataType)))

    out = beside(out, distribution(history, project), "entity_types")
    return beside(out, newest(history, most_events, project), "events") if most_events is not None else out


def _taken(project: str, who=None, before: str | None = None) -> Column:
    if (who is None) == (before is None):
        raise ValueError("either a project is deleted or old events are cleaned up")
    gone = F.col(project) == F.lit(who) if before is None else F.col("ts") < F.lit(before).cast("timestamp")
    return F.coalesce(gone, F.lit(False))


def without(history: DataFrame, who=None, before: str | None = None, project: str = "project_id") -> DataFrame:
    """History without the events of project ``who``, or without those before a time; events without a project or time stay."""
    return history.where(~_taken(project, who, before))


def removed(history: DataFrame, who=None, before: str | None = None, project: str = "project_id") -> DataFrame:
    """(project, removed): how many events ``without`` takes away, for each project that loses some."""
    return history.where(_taken(project, who, before)).groupBy(project).agg(F.count("*").alias("removed"))
