"""Exact deduplication with counting quotient filters.

Each task sorts the 64-bit fingerprints of its rows into counting quotient filters, one for each range of high bits.
Filters of a range merge without loss, because a filter is the sorted list of (quotient, remainder, count).
Fingerprints counted more than once send their rows to the comparison of bytes; nothing else shuffles text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, join_hot, key_map, materialize, text_or_empty

#: Fingerprints that a task holds before it writes its filters out, and those aimed at in a merged range.
TASK_FINGERPRINTS = 1_000_000
RANGE_FINGERPRINTS = 200_000


@dataclass
class CountingQuotientFilter:
    """Sorted remainders in runs: ``occupied`` has a bit for each quotient, ``run_end`` one for each slot."""

    quotient_bits: int
    occupied: np.ndarray
    run_end: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, quotient_bits: int | None = None) -> CountingQuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        keys = fingerprints[order].astype(np.uint64)
        n = np.ones(len(keys), np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        keys, n = keys[first], np.add.reduceat(n, first) if len(first) else n
        q = max(1, math.ceil(math.log2(max(2, len(keys))))) if quotient_bits is None else quotient_bits
        quotient = (keys >> np.uint64(64 - q)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        return cls(q, occupied, np.r_[quotient[1:] != quotient[:-1], True][: len(keys)], keys << np.uint64(q) >> np.uint64(q), n)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, ascending, and their counts."""
        runs = np.cumsum(np.r_[0, self.run_end[:-1]]) if len(self.run_end) else np.zeros(0, np.int64)
        quotient = np.flatnonzero(self.occupied)[runs.astype(np.int64)].astype(np.uint64)
        return quotient << np.uint64(64 - self.quotient_bits) | self.remainders, self.counts

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        (a, m), (b, n) = self.items(), other.items()
        return type(self).of(np.concatenate([a, b]), np.concatenate([m, n]))

    def to_bytes(self) -> bytes:
        bits = lambda x: np.packbits(x).tobytes()
        head = np.array([self.quotient_bits, len(self.remainders)], np.int64).tobytes()
        return head + bits(self.occupied) + bits(self.run_end) + self.remainders.tobytes() + self.counts.astype(np.int64).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, n = (int(x) for x in np.frombuffer(data, np.int64, 2))
        at = 16
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, size := ((1 << q) + 7) // 8, at), count=1 << q).astype(bool)
        at += size
        run_end = np.unpackbits(np.frombuffer(data, np.uint8, size := (n + 7) // 8, at), count=n).astype(bool)
        at += size
        return cls(q, occupied, run_end, np.frombuffer(data, np.uint64, n, at), np.frombuffer(data, np.int64, n, at + 8 * n))


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, copies) for the values of the one long column of ``fingerprints`` that occur more than once."""
    bits = max(6, math.ceil(math.log2(max(1, rows / RANGE_FINGERPRINTS))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filters(parts: list[np.ndarray]) -> pa.RecordBatch:
            fps = np.sort(np.concatenate(parts))
            tops = fps >> np.uint64(64 - bits)
            starts = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]])
            own = [CountingQuotientFilter.of(x).to_bytes() for x in np.split(fps, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(tops[starts].astype(np.int64)), pa.array(own, pa.binary())], ["span", "filter"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, held)) >= TASK_FINGERPRINTS:
                yield filters(held)
                held = []
        if sum(map(len, held)):
            yield filters(held)

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        parts = [CountingQuotientFilter.from_bytes(x).items() for x in group["filter"]]
        fps, n = CountingQuotientFilter.of(*(np.concatenate(x) for x in zip(*parts, strict=True))).items()
        return pd.DataFrame({"fp": fps[n > 1].view(np.int64), "copies": n[n > 1]})

    built = fingerprints.mapInArrow(build, "span long, filter binary")
    return built.groupBy("span").applyInPandas(merged, "fp long, copies long")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def exact_groups(docs: DataFrame, fingerprint_bits: int = 64) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, so that all empty texts are one group. Of a group the row with the most code points stays, then the
    one with the smallest doc_id (a null doc_id last); of repeated rows of that id, one. An empty table gives an empty result; columns
    other than doc_id and text are ignored. ``fingerprint_bits`` below 64 makes collisions, which the comparison of bytes
    sorts out.
    """
    norm = normalised(text_or_empty())
    fp = F.shiftrightunsigned(F.xxhash64(norm), 64 - fingerprint_bits)
    fp = F.shiftleft(fp, 64 - fingerprint_bits)  # the filters use the high bits
    base = materialize(
        docs.select("doc_id", F.length(text_or_empty()).alias("n_chars"), F.sha2(norm.cast("binary"), 256).alias("text_sha256"), fp.alias("fp"), F.monotonically_increasing_id().alias("row")),
        "exact-base",
    )
    rows = base.count()
    repeated = materialize(repeated_fingerprints(base.select("fp"), rows), "exact-repeated").select("fp")

    texts = docs.select(norm.alias("norm")).select("norm", F.shiftleft(F.shiftrightunsigned(F.xxhash64("norm"), 64 - fingerprint_bits), 64 - fingerprint_bits).alias("fp"))
    same_bytes = texts.join(repeated, "fp", "left_semi").groupBy("fp", "norm").agg(F.count("*").alias("rows")).where("rows > 1")
    # a class is a byte string; two of them under one fingerprint and SHA-256 would be a SHA-256 collision, and are refused
    classes = same_bytes.groupBy("fp", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")).agg(F.count("*").alias("strings"))
    checked = classes.withColumn("strings", F.when(F.col("strings") > 1, F.raise_error(F.lit("two texts have one SHA-256"))).otherwise(F.col("strings")))

    rank = F.struct("n_chars", F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("first"), (-F.col("row")).alias("row"))
    best = (
        base.join(repeated, "fp", "left_semi").groupBy("text_sha256").agg(F.count("*").alias("n"), F.max(rank).alias("best"))
        .join(checked.where("strings > 0").select("text_sha256").distinct(), "text_sha256", "left_semi")
        .select(F.col("text_sha256").alias("sha"), "n", (-F.col("best.first")).alias("best_id"), (-F.col("best.row")).alias("best_row"))
    )
    grouped = F.col("n").isNotNull()
    best = materialize(best, "exact-best")
    return join_hot(base, best, "text_sha256", "n", rows, "left", to="sha").select(
        "doc_id",
        F.when(grouped, F.col("best_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("best_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; all columns stay.

    Of equal texts one row stays, by the rule of ``exact_groups``; of rows that repeat its doc_id and text, whatever their other columns,
    any one. Null and empty texts are equal; an empty table gives an empty result.
    """
    groups = materialize(exact_groups(docs), "exact-groups")
    ident, sha, times, turn = fresh(docs, "exact_id", "exact_sha", "exact_times", "exact_turn")
    keys = groups.groupBy(F.col("doc_id").alias(ident), F.col("text_sha256").alias(sha)).agg(F.count("*").alias("rows"), F.count_if("kept").alias("stay"))
    keys = materialize(keys.where("stay = 0 or rows > 1").select(ident, sha, F.when(F.col("stay") > 0, F.col("rows")).otherwise(0).alias(times)), "exact-keys")
    digest = F.sha2(normalised(text_or_empty()).cast("binary"), 256)
    of_key = F.col("doc_id").eqNullSafe(F.col(ident)) & (digest == F.col(sha))
    named = key_map(keys, ident)
    if named is None:
        stay = docs.join(keys, of_key, "left_anti")
    else:  # rows whose id is in no key stay where they are
        may_go = named(F.xxhash64("doc_id"))
        (flag,) = fresh(docs, "exact_flag")
        flagged = docs.withColumn(flag, may_go)
        stay = flagged.where(~F.col(flag)).select(*docs.columns).unionByName(docs.where(may_go).join(keys, of_key, "left_anti"))
    twice = keys.where(F.col(times) > 1)
    if twice.isEmpty():
        return stay
    # rows of one id and text: the longest original of each task, then of all
    again = docs.join(twice, of_key).withColumn(turn, F.monotonically_increasing_id())
    best = F.max_by(F.struct(*docs.columns), F.struct(F.length(text_or_empty()), F.col(turn)))
    one = again.groupBy(ident, sha).agg(best.alias(turn)).select(f"{turn}.*")
    return stay.unionByName(one)


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
