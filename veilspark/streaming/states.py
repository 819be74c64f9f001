"""State machines, stale results and resilience of the guard, over tables of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which state may follow which; how long results live; failures and crashes that open the circuit; waits before restarts; heartbeats.
MONITOR = {
    "OFF": ["STARTING"],
    "STARTING": ["ACTIVE", "USER_INITIATED_ONLY", "PERMISSION_REQUIRED", "UNSUPPORTED", "DEGRADED", "ERROR", "STOPPING"],
    "ACTIVE": ["PAUSED", "DEGRADED", "ERROR", "STOPPING", "USER_INITIATED_ONLY"],
    "PAUSED": ["ACTIVE", "STOPPING", "ERROR"],
    "DEGRADED": ["ACTIVE", "USER_INITIATED_ONLY", "ERROR", "STOPPING"],
    "USER_INITIATED_ONLY": ["ACTIVE", "PAUSED", "DEGRADED", "ERROR", "STOPPING"],
    "PERMISSION_REQUIRED": ["STARTING", "STOPPING", "ERROR"],
    "UNSUPPORTED": ["STOPPING"],
    "ERROR": ["STARTING", "STOPPING"],
    "STOPPING": ["OFF"],
}
WORKER = {
    "STOPPED": ["STARTING"],
    "STARTING": ["READY", "DEGRADED", "ERROR", "STOPPING"],
    "READY": ["SCANNING", "STOPPING", "DEGRADED", "ERROR"],
    "SCANNING": ["READY", "DEGRADED", "ERROR", "STOPPING"],
    "DEGRADED": ["STARTING", "ERROR", "STOPPING"],
    "ERROR": ["STARTING", "STOPPING"],
    "STOPPING": ["STOPPED"],
}
RESULT_SECONDS, WATCHDOG_SECONDS = 30.0, 5.0
SCAN_FAILURES, SCAN_WINDOW, CRASHES, CRASH_WINDOW = 3, 60, 5, 600
BACKOFF, HEARTBEAT, UNHEALTHY = [1.0, 2.0, 5.0, 15.0], 2.0, 6.0


def states(requests: DataFrame, key: str, order: str, table: dict[str, list[str]], start: str) -> DataFrame:
    """(key, order..., target, state, accepted) of each machine's requests in order: a request that the table doesn't allow from the present state is refused and
    changes nothing; asking for the present state is allowed. A machine's requests meet in one array."""
    allowed = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    one = F.struct(F.col(order).alias("o"), F.col("target").alias("target"))
    every = requests.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        now = F.when(F.size(acc) > 0, F.element_at(acc, -1)["state"]).otherwise(F.lit(start))
        good = (x["target"] == now) | F.coalesce(F.array_contains(F.try_element_at(allowed, now), x["target"]), F.lit(False))
        return F.array_append(acc, F.struct(x["o"].alias("o"), x["target"].alias("target"), F.when(good, x["target"]).otherwise(now).alias("state"), good.alias("accepted")))

    kind = dict(requests.dtypes)[order]
    told = F.aggregate("all", F.array().cast(f"array<struct<o:{kind},target:string,state:string,accepted:boolean>>"), step)
    return every.select(key, F.explode(told).alias("s")).select(key, F.col("s.o").alias(order), "s.target", "s.state", "s.accepted")


def fresh_results(results: DataFrame, current: DataFrame, source: str) -> DataFrame:
    """Results (source, generation, fingerprint, created, seen) that may be shown: of the present generation and text in ``current`` (source, generation,
    fingerprint), and neither older than RESULT_SECONDS nor later than the watchdog allows. created and seen are in seconds."""
    now = current.select(F.col(source).alias("_s"), F.col("generation").alias("_g"), F.col("fingerprint").alias("_f"))
    met = results.join(now, (F.col(source) == F.col("_s")) & (F.col("generation") == F.col("_g")) & (F.col("fingerprint") == F.col("_f")), "left_semi")
    age = F.col("seen") - F.col("created")
    return met.where((age < RESULT_SECONDS) & (age <= WATCHDOG_SECONDS))


def breaker(events: DataFrame, key: str) -> DataFrame:
    """Events (key, at in seconds, kind failure or crash) with the counts in their windows and open: once 3 failures in a minute or 5 crashes in ten minutes were
    met it stays so."""
    def recent(kind: str, seconds: int) -> Column:
        w = Window.partitionBy(key).orderBy("at").rangeBetween(-seconds, 0)
        return F.count_if(F.col("kind") == kind).over(w)

    counted = events.withColumn("failures", recent("failure", SCAN_WINDOW)).withColumn("crashes", recent("crash", CRASH_WINDOW))
    opens = ((F.col("kind") == "failure") & (F.col("failures") >= SCAN_FAILURES)) | ((F.col("kind") == "crash") & (F.col("crashes") >= CRASHES))
    so_far = Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("open", F.max(opens).over(so_far))


def backoff(attempt: Column) -> Column:
    """Seconds to wait before a restart; null when no attempt is left."""
    return F.get(F.array(*map(F.lit, BACKOFF)), F.when(attempt.between(1, len(BACKOFF)), attempt.cast("int") - 1))


def heartbeat_health(last: Column, now: Column) -> Column:
    age = now - last
    return F.when(last.isNull(), "DEAD").when(age <= HEARTBEAT, "HEALTHY").when(age <= UNHEALTHY, "LATE").otherwise("UNRESPONSIVE")
