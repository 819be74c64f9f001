"""Spans and boxes of one key that overlap, joined without meeting all others of their key.

A span lies in bins about as wide as itself, of widths that grow eightfold from level to level, so it touches at most two bins (a box four). Two spans meet in the wider
one's level, in the one bin that holds the beginning of what they share, and nowhere else; spans of one key that are far apart never do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of bins, and how much wider the bins of each are than those below.
LEVELS, GROWTH = 9, 8
Spans = list[tuple[str, str]]


def islands(df: DataFrame, keys: list[str], name: str, touching: bool = False) -> DataFrame:
    """``df`` with the number, in ``name``, of each span's island: spans (start_pos, end_pos) of one key that a chain of overlaps links. With ``touching``, spans that meet without
    sharing a character are linked too. The running maximum of ends is one pass over the sorted spans of a key."""
    by_start = Window.partitionBy(*keys).orderBy("start_pos")
    reach = F.max("end_pos").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start_pos") > reach if touching else F.col("start_pos") >= reach
    return df.withColumn(name, F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_spans: Spans, right_spans: Spans, unit: float = 64.0) -> DataFrame:
    """Rows of ``left`` and ``right`` of equal ``keys`` whose spans overlap in every dimension (``start < other's end`` both ways), each pair once, with the columns of both.

    ``left_spans`` and ``right_spans`` name (start, end) for each dimension; but for the keys no column may be in both tables. ``unit`` is the width of the
    narrowest bins. Rows with a null key or bound meet none; an empty span meets what has it inside.
    """

    def own_level(spans: Spans) -> Column:
        extent = reduce(F.greatest, [F.col(b) - F.col(a) for a, b in spans]) if len(spans) > 1 else F.col(spans[0][1]) - F.col(spans[0][0])
        return sum((F.when(extent > unit * GROWTH**k, 1).otherwise(0) for k in range(LEVELS - 1)), F.lit(0)).cast("int")

    def masks(df: DataFrame, spans: Spans) -> DataFrame:
        """Which levels the spans of a key have, as bits."""
        return df.groupBy(*keys).agg(F.bit_or(F.pow(F.lit(2.0), own_level(spans)).cast("int")).alias("_mask"))

    def dealt(df: DataFrame, spans: Spans, levels: Column, tag: str) -> DataFrame:
        out = df.withColumn("_level", F.explode(levels))
        width = F.lit(float(unit)) * F.pow(F.lit(float(GROWTH)), F.col("_level"))
        for d, (a, b) in enumerate(spans):
            # what ends at a bin's beginning isn't in it, but a span is where it begins
            last = F.greatest(F.ceil(F.col(b) / width) - 1, F.floor(F.col(a) / width))
            out = out.withColumn(f"_bin{d}", F.explode(F.sequence(F.floor(F.col(a) / width), last)))
        return out.select(*df.columns, *[F.col(c).alias(f"{c}{tag}") for c in ("_level", *[f"_bin{d}" for d in range(len(spans))])])

    full = lambda df, spans: df.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for s in spans for c in s]))
    left, right = full(left, left_spans), full(right, right_spans)
    upward = lambda first: F.when(first < LEVELS, F.filter(F.sequence(first, F.lit(LEVELS - 1)), lambda n: F.getbit("_mask", n) == 1)).otherwise(F.array().cast("array<int>"))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        """``a`` dealt with tag _l, ``b`` with tag _r."""
        renamed = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
        on = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col(f"{c}_l") == F.col(f"{c}_r") for c in ("_level", *[f"_bin{d}" for d in range(len(left_spans))])]
        width = F.lit(float(unit)) * F.pow(F.lit(float(GROWTH)), F.col("_level_l"))
        for d, ((a0, a1), (b0, b1)) in enumerate(zip(left_spans, right_spans, strict=True)):
            on += [F.col(a0) < F.col(b1), F.col(b0) < F.col(a1), F.col(f"_bin{d}_l") == F.floor(F.greatest(F.col(a0), F.col(b0)) / width)]
        return a.join(renamed, reduce(lambda x, y: x & y, on)).select(*left.columns, *[c for c in right.columns if c not in keys])

    own = lambda spans: F.array(own_level(spans))
    below = met(dealt(left, left_spans, own(left_spans), "_l"), dealt(right.join(masks(left, left_spans), keys), right_spans, upward(own_level(right_spans)), "_r"))
    above = met(dealt(left.join(masks(right, right_spans), keys), left_spans, upward(own_level(left_spans) + 1), "_l"), dealt(right, right_spans, own(right_spans), "_r"))
    return below.unionByName(above)
