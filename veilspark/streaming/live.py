"""The guard's rules over live streams: state by source, event-time timers, and results that equal the batch's whatever the order of arrival.

Rows wait in state until the watermark passes them, and are then taken in the order of their time, so late, early and repeated deliveries change nothing. Each rule says what
one row makes of a source's memory; the memory is small, whatever the stream's length: what is due, what was written lately, what is current. A row travels as JSON
beside the few values that a rule looks at, so its columns come back as they were.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.intervals import islands
from .states import RESULT_SECONDS, WATCHDOG_SECONDS

#: Quiet time of a burst, least time between two scans, and how long an own write is expected back, in seconds.
QUIET, INTERVAL, ECHO = 0.25, 0.25, 2.0
#: JSON that keeps microseconds.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
WAITING, OUT = "at long, rank int, mark string, row string", "row string, done long"


class InOrder(StatefulProcessor):
    """Takes a source's rows in the order of (time in microseconds, rank, row). ``step`` changes the memory by a row and says whether it comes out; ``due`` is the time, if any, at
    which the memory gives a row by itself, and ``release`` gives it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.memory = handle.getValueState("memory", "json string")
        self.swept: dict = {}

    def close(self) -> None:
        pass

    def step(self, memory: dict, at: int, rank: int, mark: str, row: str) -> bool:
        raise NotImplementedError

    def due(self, memory: dict) -> int | None:
        return None

    def release(self, memory: dict, at: int) -> str:
        raise NotImplementedError

    def taken(self, memory: dict, rows: list[tuple], until: int) -> list[tuple[str, int]]:
        """(row, time at which it comes out) of rows up to the time ``until``, and of what is due by then."""
        found = []

        def let_out(before: int) -> None:
            # a row that comes exactly when another is due still replaces it
            while (at := self.due(memory)) is not None and at < before:
                found.append((self.release(memory, at), at))

        for at, rank, mark, row in sorted(rows):
            let_out(at)
            if self.step(memory, at, rank, mark, row):
                found.append((row, at))
        let_out(until + 1)
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = [(int(at), int(rank), mark, row) for part in rows for at, rank, mark, row in part[["at", "rank", "mark", "row"]].itertuples(index=False, name=None)]
        self.waiting.appendList(given)
        for at in {x[0] // 1_000 + 1 for x in given}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed is taken at the first of a source's timers; the others of this batch find nothing left
        until = timerValues.getCurrentWatermarkInMs() * 1_000
        if self.swept.get(key) == until:
            return iter(())
        self.swept[key] = until
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        ready, later = [x for x in held if x[0] <= until], [x for x in held if x[0] > until]
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        found = self.taken(memory, ready, until)
        if memory:
            self.memory.update((json.dumps(memory),))
        elif self.memory.exists():
            self.memory.clear()
        if (at := self.due(memory)) is not None:
            self.handle.registerTimer(at // 1_000 + 1)
        return iter([pd.DataFrame(found, columns=["row", "done"])] if found else [])


class Coalescer(InOrder):
    """The latest text wins: it comes out when nothing newer came for ``quiet`` microseconds and ``interval`` have passed since the last one came out."""

    def __init__(self, quiet: int, interval: int):
        self.quiet, self.interval = quiet, interval

    def step(self, memory, at, rank, mark, row):
        memory["ready"], memory["row"] = at + self.quiet, row
        return False

    def due(self, memory):
        return max(memory["ready"], memory["last"] + self.interval if "last" in memory else memory["ready"]) if "row" in memory else None

    def release(self, memory, at):
        memory["last"] = at
        del memory["ready"]
        return memory.pop("row")


class EchoFilter(InOrder):
    """Texts (rank 1) but for the first echo of each own write (rank 0) of the same mark within ``span`` microseconds; an echo is consumed with the writes that expect it, and
    what isn't met in time expires."""

    def __init__(self, span: int):
        self.span = span

    def step(self, memory, at, rank, mark, row):
        for old in [m for m, times in memory.items() if max(times) + self.span < at]:
            del memory[old]
        if rank == 0:
            memory.setdefault(mark, []).append(at)
            return False
        if any(t <= at <= t + self.span for t in memory.get(mark, [])):
            del memory[mark]
            return False
        return True


class Current(InOrder):
    """Results (rank 1) of the mark that was named last (rank 0); only that is remembered."""

    def step(self, memory, at, rank, mark, row):
        if rank == 0:
            memory["current"] = mark
        return rank == 1 and memory.get("current") == mark


def _packed(df: DataFrame, source: str, time: str, rank: int, mark: Column) -> DataFrame:
    row = F.to_json(F.struct(*df.columns), EXACT)
    return df.where(F.col(time).isNotNull()).select(source, time, F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.lit(rank).alias("rank"), mark.alias("mark"), row.alias("row"))


def _live(packed: list[DataFrame], source: str, time: str, rule: InOrder, like: DataFrame, late: str) -> DataFrame:
    """The rows that come out, with the columns of ``like`` and ``done``. Each stream has its own watermark; the slowest one counts, so that none runs away from the others."""
    marked = [s.withWatermark(time, late) for s in packed]
    both = marked[0] if len(marked) == 1 else marked[0].unionByName(marked[1])
    out = both.groupBy(source).transformWithStateInPandas(rule, outputStructType=OUT, outputMode="append", timeMode="eventTime")
    return out.select(F.from_json("row", like.schema, EXACT).alias("r"), "done").select("r.*", "done")


def coalesced(texts: DataFrame, source: str = "source", quiet: float = QUIET, interval: float = INTERVAL, late: str = "10 seconds") -> DataFrame:
    """The texts (source, ts, text, ...) that are scanned, with ``scanned``, the time at which: a text that is still waiting when the next one of its source comes gives way to it.

    Batch or stream; texts without a time are left out, and of texts of one time the last as JSON counts. In a batch, a source's texts fall into runs that no text outside can
    touch, and each run is one fold.
    """
    q, i = round(quiet * 1e6), round(interval * 1e6)
    packed = _packed(texts, source, "ts", 1, F.lit(""))
    if texts.isStreaming:
        return _live([packed], source, "ts", Coalescer(q, i), texts, late).withColumn("scanned", F.timestamp_micros("done")).drop("done")
    # even a text that had to wait for the one before comes out before the next run begins
    spans = packed.select(source, F.col("at").alias("start_pos"), (F.col("at") + max(q, i) + i + 1).alias("end_pos"), "row")
    every = islands(spans, [source], "_run").groupBy(source, "_run").agg(F.array_sort(F.collect_list(F.struct(F.col("start_pos").alias("at"), "row"))).alias("all"))

    def fold(acc: Column, x: Column) -> Column:
        at = F.greatest(x["at"] + q, F.coalesce(acc["last"] + i, x["at"]))
        later = F.get(F.col("all"), acc["n"] + 1)["at"]
        goes = later.isNull() | (at < later)
        out = F.when(goes, F.array_append(acc["out"], F.struct(x["row"].alias("row"), at.alias("done")))).otherwise(acc["out"])
        return F.struct((acc["n"] + 1).alias("n"), F.when(goes, at).otherwise(acc["last"]).alias("last"), out.alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<row:string,done:bigint>>").alias("out"))
    told = every.select(F.explode(F.aggregate("all", start, fold, lambda acc: acc["out"])).alias("o"))
    return told.select(F.from_json("o.row", texts.schema, EXACT).alias("r"), F.timestamp_micros("o.done").alias("scanned")).select("r.*", "scanned")


def without_echoes(texts: DataFrame, writes: DataFrame, source: str = "source", seconds: float = ECHO, late: str = "10 seconds") -> DataFrame:
    """A stream of texts (source, ts, text, ...) without the first echo of each own write (source, ts, text) within ``seconds``: what ``guard.without_own_writes`` makes of a batch."""
    mark = F.sha2(F.col("text").cast("binary"), 256)
    both = [_packed(texts, source, "ts", 1, mark), _packed(writes.select(source, "ts", "text"), source, "ts", 0, mark)]
    return _live(both, source, "ts", EchoFilter(round(seconds * 1e6)), texts, late).drop("done")


def shown_results(results: DataFrame, current: DataFrame, source: str = "source", late: str = "10 seconds") -> DataFrame:
    """Results (source, seen, created, generation, fingerprint, ...) that may be shown: of the generation and text that ``current`` (source, seen, generation, fingerprint) named last, and
    neither past their life nor later than the watchdog allows. Batch or stream; what is named at the time at which a result is seen counts already, and of several named
    at one time the last as JSON."""
    mark = F.to_json(F.struct("generation", "fingerprint"))
    age = (F.unix_micros("seen") - F.unix_micros("created")) / 1e6
    young = results.where((age < RESULT_SECONDS) & (age <= WATCHDOG_SECONDS) & F.col("generation").isNotNull() & F.col("fingerprint").isNotNull())
    both = [_packed(young, source, "seen", 1, mark), _packed(current.select(source, "seen", "generation", "fingerprint"), source, "seen", 0, mark)]
    if results.isStreaming:
        return _live(both, source, "seen", Current(), results, late).drop("done")
    so_far = Window.partitionBy(source).orderBy("at", "rank", "row").rowsBetween(Window.unboundedPreceding, 0)
    now = both[0].unionByName(both[1]).withColumn("_now", F.last(F.when(F.col("rank") == 0, F.col("mark")), ignorenulls=True).over(so_far))
    return now.where("rank = 1 and _now = mark").select(F.from_json("row", results.schema, EXACT).alias("r")).select("r.*")
