"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents. A document's virtual finish time is the number of words of its
source up to and including it, divided by the source's target; a second epoch goes on where the first ends. All
copies are then ordered by finish time and cut where the total budget is used up.

Only DataFrame functions are used. Running sums never gather a source in one task: documents fall into hash ranges of
two levels, ranges are summed before the shuffle, and prefix sums run over ranges, then within a range.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, row_numbers, word_count

#: Rows aimed at in a hash range, and slices of virtual time in which the cut is searched.
RANGE_ROWS = 256
SLICES = 4096
#: Copies that one task may order at the cut.
CUT_ROWS = 50_000


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): ``share`` of all words dealt by weight, no source above
    ``cap`` times its size, what is cut off dealt anew by weight (water filling).

    One row a source: mixing weights are set by people for each source, so this table stays small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("level", F.col("most") / F.col("w"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    tried = ranked.withColumn("pour", (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    water = F.min(F.when(F.col("pour") <= F.col("level"), F.struct("level", "pour"))).over(every)["pour"]
    return tried.select("source", "source_size", F.least(F.coalesce(water * F.col("w"), F.col("most")), F.col("most")).alias("target"))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", row: str | None = None) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken.

    ``taken`` is size times the number of epochs in which the cut left the document in, at most ``ceil(cap)``. Null
    texts have size 0 and are never taken; a null source is a source of its own, last in order; a null doc_id is shuffled
    by its text's digest; repeated rows are dealt one by one. An empty table gives an empty result. Other columns of
    ``docs`` are ignored, but for ``row``, which names a column that tells rows apart and comes out as ``row``. Reruns agree: the
    order is a digest of the id.
    """
    spark = docs.sparkSession
    shuffled = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))
    base = materialize(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat(shuffled, F.lit(f"|{seed}")).cast("binary")).alias("key"),
            (F.col(row) if row else F.lit(None).cast("string")).alias("row"),
        ),
        "mix-base",
    )
    rows = base.count()
    targets = materialize(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mix-targets")

    level = max(1, math.ceil(math.sqrt(rows / RANGE_ROWS)))
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    ranged = base.withColumn("fine", F.floor(at * level * level).cast("long")).withColumn("coarse", F.floor(F.col("fine") / level).cast("long"))
    fine = ranged.groupBy("source", "coarse", "fine").agg(F.sum("size").alias("n"))
    coarse = fine.groupBy("source", "coarse").agg(F.sum("n").alias("n"))

    def earlier(*part: str, order: str) -> Column:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    coarse = coarse.select("source", "coarse", earlier("source", order="coarse").alias("before_coarse"))
    fine = fine.select("source", "coarse", "fine", earlier("source", "coarse", order="fine").alias("before_fine"))

    def joined(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        """Equi-join in which the null source meets itself."""
        right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return left.join(right, on, "left").drop(*[f"_{k}" for k in keys])

    starts = joined(fine, coarse, "source", "coarse").select("source", "coarse", "fine", (F.col("before_coarse") + F.col("before_fine")).alias("before"))
    running = Window.partitionBy("source", "coarse", "fine").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # rows without words move no sum and aren't taken: they stay out of the windows
    inside = ranged.where("size > 0").withColumn("upto", F.sum("size").over(running)).unionByName(ranged.where("size = 0").withColumn("upto", F.lit(0).cast("long")))
    placed = joined(joined(inside, starts, "source", "coarse", "fine"), targets, "source")
    epochs = math.ceil(cap)
    finish = [(F.col("before") + F.col("upto") + F.lit(e) * F.col("source_size")) / F.col("target") for e in range(epochs)]
    placed = materialize(
        placed.select("doc_id", "row", "size", "source_size", "target", *[F.when(F.col("size") > 0, f).alias(f"finish{e}") for e, f in enumerate(finish)]),
        "mix-placed",
    )
    total = base.agg(F.sum("size")).first()[0] or 0
    copies = placed.select("size", F.explode(F.array(*[f"finish{e}" for e in range(epochs)])).alias("finish")).where("finish is not null")
    before_cut = _before_cut(copies, share * total)
    taken = sum((F.when(before_cut(F.col(f"finish{e}")), F.col("size")).otherwise(0) for e in range(epochs)), F.lit(0)).cast("long")
    kept = ["row"] if row else []
    return placed.select("doc_id", *kept, "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"))


def _before_cut(copies: DataFrame, budget: float) -> Callable[[Column], Column]:
    """The condition under which a finish time lies before the cut: copies (size, finish), ordered by finish, that fit the budget.

    The cut is searched in slices of virtual time, each round in slices SLICES times as thin within the one that holds it, until few enough
    copies are left to order them in one task. Scaling by a power of two is exact, so slices nest.
    """
    thin, spent, rest = 1, 0, copies
    while True:
        thin *= SLICES
        slice_of = lambda f, thin=thin: F.least(F.floor(f * thin), F.lit(4 * thin))
        upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)  # at most 4 * SLICES + 1 rows
        cut = (
            rest.groupBy(slice_of(F.col("finish")).alias("slice")).agg(F.sum("size").alias("n"), F.count("*").alias("rows")).withColumn("upto", F.sum("n").over(upto) + F.lit(spent))
            .where(F.col("upto") > F.lit(budget)).orderBy("slice").select("slice", "rows", (F.col("upto") - F.col("n")).alias("before")).first()
        )
        if cut is None:
            return lambda f: f.isNotNull()
        rest, spent = rest.where(slice_of(F.col("finish")) == cut["slice"]), cut["before"]
        if cut["rows"] <= CUT_ROWS or thin >= SLICES**4 or cut["slice"] == 4 * thin:
            break
    by_finish = Window.orderBy("finish").rangeBetween(Window.unboundedPreceding, 0)
    fits = rest.groupBy("finish").agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(by_finish) + F.lit(spent)).where(F.col("upto") <= F.lit(budget))
    last = fits.agg(F.max("finish")).first()[0]
    return lambda f: (slice_of(f) < F.lit(cut["slice"])) | (f <= F.lit(last).cast("double"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each once for each epoch in which it takes that row; all columns stay.

    Rows are told apart by a number of their own, so rows that repeat an id, or have none, each get the copies that the mix dealt to
    them. A null or empty text has no words and is never taken. An empty table gives an empty result.
    """
    (row,) = fresh(docs, "mix_row")
    numbered = row_numbers(docs, row, "mix-documents")
    plan = mix_sources(numbered, row=row, **how)
    copies, size = fresh(numbered, "mix_copies", "mix_size")
    times = plan.where("taken > 0").select(F.col("row").alias(row), (F.col("taken") / F.col("size")).cast("int").alias(copies))
    return numbered.join(times, row).withColumn(size, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


#: For DuckDB: the same mix with whole windows.
SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, md5(text), '') || '|mix') AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM src),
lev AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / w AS lvl FROM ranked),
tried AS (
  SELECT *, ((SELECT sum(source_size) FROM src)::DOUBLE * 1.5::DOUBLE
     - coalesce(sum(most) OVER (ORDER BY lvl, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(w) OVER (ORDER BY lvl, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pour FROM lev),
targets AS (SELECT source, source_size, least(coalesce((SELECT arg_min(pour, lvl) FROM tried WHERE pour <= lvl) * w, most), most) AS target FROM tried),
placed AS (
  SELECT b.doc_id, b.size, t.source_size, t.target,
         sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT size, (upto + e * source_size)::DOUBLE / target AS finish FROM placed, (VALUES (0), (1)) AS v(e) WHERE size > 0),
summed AS (SELECT finish, sum(size) OVER (ORDER BY finish RANGE UNBOUNDED PRECEDING) AS n FROM copies),
cut AS (SELECT max(finish) AS finish FROM summed WHERE n <= 1.5 * (SELECT sum(size) FROM base))
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (CASE WHEN upto::DOUBLE / target <= cut.finish THEN 1 ELSE 0 END
              + CASE WHEN (upto + source_size)::DOUBLE / target <= cut.finish THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed, cut
"""
