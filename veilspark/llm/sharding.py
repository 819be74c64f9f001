"""Sharding by rendezvous hashing.

Every shard draws a number for a record's key; the shard with the best draw, stretched by its weight, takes the record. A draw depends on the key and
on that shard alone, so a further shard takes records into itself and moves no other. Only DataFrame functions are used: the draws are columns, and
places within a shard come from one range sort whose parts are counted, not from a window over a shard.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Records aimed at in a part of the range sort.
PART_ROWS = 1_000_000


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard: 52 bits of a digest, which any engine gives alike."""
    digest = F.md5(F.concat(key, F.lit(f"|{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def best_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: of all shards the one with the greatest ``-weight / ln(draw)``, so that a shard gets keys in proportion to its weight.

    A shard without weight gets none; of equal draws the lower shard's wins.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights are numbers from 0, at least one above 0")
    bids = [F.struct((-F.lit(float(w)) / F.log(draw(key, n))).alias("bid"), F.lit(-n).alias("shard")) for n, w in enumerate(weights) if w > 0]
    return (-(F.greatest(*bids) if len(bids) > 1 else bids[0])["shard"]).cast("int")


def stable_key(doc_id: Column) -> Column:
    """The decimal form of the id; rows without one share the empty key."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: Sequence[float] | None = None) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, size (UTF-8 bytes and one more), text_crc32, law, shard, slot, grown_shard.

    ``weights``: one number for each shard. ``grown`` (by default one more shard, of the mean weight) gives ``grown_shard``; a row that changes goes to a new shard, as
    long as ``grown`` begins with ``weights``. The law is ``key``: id and shards decide, so repeated rows, rows of one id and rows without id share a
    shard, while equal texts of different ids needn't. ``slot`` counts a shard's rows from 0 without gaps, by doc_id (null last), then digest
    and size of the text; rows equal in all of these are interchangeable. A null text is empty (size 1). An empty table gives an empty result; other
    columns are ignored. A key that holds a third of all rows fills one shard, as the law says, but no task: the sort deals such rows out by a number of their own.
    """
    grown = (*weights, sum(weights) / len(weights)) if grown is None else grown
    text = F.coalesce("text", F.lit(""))
    key = stable_key(F.col("doc_id"))
    base = materialize(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            best_shard(key, weights).alias("shard"), best_shard(key, grown).alias("grown_shard"), F.monotonically_increasing_id().alias("row"),
        ),
        "shard-base",
    )
    settings = docs.sparkSession.conf
    parts = max(int(settings.get("spark.sql.shuffle.partitions")), math.ceil(base.count() / PART_ROWS))
    order = [F.col("shard"), F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size"), F.col("row")]
    # the row's number within its part is in the low 33 bits of the generated one
    sorted_rows = base.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(sorted_rows.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "shard-placed")
    return placed.join(F.broadcast(_starts(placed)), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("start")).cast("long").alias("slot"), "grown_shard",
    )


def _starts(placed: DataFrame) -> DataFrame:
    """(shard, part, start): what to add to a row's place in its part for its slot. Parts follow each other, so there are at most as many rows as
    parts and shards together: a bound that the number of partitions sets, not the rows."""
    counted = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    by_shard = counted.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("part", "n", "first"))).alias("parts"))
    added = F.aggregate(
        F.col("parts"),
        F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<part:int,start:bigint>>").alias("out")),
        lambda acc, p: F.struct((acc["n"] + p["n"]).alias("n"), F.array_append(acc["out"], F.struct(p["part"].alias("part"), (acc["n"] - p["first"]).alias("start"))).alias("out")),
    )
    return by_shard.select("shard", F.explode(added["out"]).alias("p")).select("shard", "p.part", "p.start")


def sharded_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8) -> DataFrame:
    """``docs`` with the column ``shard`` (a column of that name is replaced), for a write that is partitioned by it. Nothing is shuffled.

    Null ids, repeated rows and empty tables as in ``assign_shards``.
    """
    return docs.withColumn("shard", best_shard(stable_key(F.col("doc_id")), weights))


#: For DuckDB, which has no crc32: the table of 256 remainders comes from its rule, and bytes are folded one by one.
SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
  FROM documents, tab),
bids AS (
  SELECT key, n, -1.0::DOUBLE / ln((('0x' || substr(md5(key || '|' || n), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS bid
  FROM (SELECT DISTINCT key FROM d), range(9) s(n)),
best AS (
  SELECT key, first(n ORDER BY bid DESC, n) FILTER (n < 8) AS shard, first(n ORDER BY bid DESC, n) AS grown_shard FROM bids GROUP BY key)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard
FROM d JOIN best USING (key)
"""
