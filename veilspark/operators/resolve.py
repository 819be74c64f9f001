"""Overlap resolution. Each rule is a fold over the ordered findings of one segment; the folds differ on purpose.

Findings are rows (segment_id, entity_type, start_pos, end_pos, score, ...). Findings that a chain of overlaps links meet in one array; every order ends in
entity_type and end_pos, so ties always fall the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands, overlap_join

#: Priorities of entity types when spans collide.
PRIORITY = {
    "ID_NIK": 90, "ID_KK": 90, "ID_NPWP": 85, "ID_PHONE": 80, "CREDIT_CARD": 85, "IBAN_CODE": 85, "BANK_ACCOUNT": 80, "US_SSN": 85, "US_PASSPORT": 80, "UK_NHS": 80,
    "EMAIL_ADDRESS": 75, "PHONE_NUMBER": 70, "IP_ADDRESS": 65, "URL": 60, "PERSON": 50, "DATE_OF_BIRTH": 50, "LOCATION": 45, "ADDRESS": 45, "DATE": 30, "NRP": 40, "CUSTOM": 100,
}
TEXT_PRIORITY = {"DATE_OF_BIRTH": 10, "ID_NIK": 9, "ID_NPWP": 9, "ID_KK": 9, "CREDIT_CARD": 8, "EMAIL": 8, "PHONE_NUMBER": 7, "PERSON": 6, "DATE": 2}

Fold = Callable[[Column, Column], Column]


def lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def overlap(a: Column, b: Column) -> Column:
    return (a["start_pos"] < b["end_pos"]) & (b["start_pos"] < a["end_pos"])


def _length(x: Column) -> Column:
    return x["end_pos"] - x["start_pos"]


def folded(df: DataFrame, key: str, order: list[Column], fold: Fold) -> DataFrame:
    """Findings as arrays in ``order`` (and then by type and end), folded, and out again. Each array is an island of a segment, the findings that a chain of overlaps links: a
    finding is only ever weighed against ones that it overlaps, so islands don't know of each other, and no array grows with its segment."""
    names = [c for c in df.columns if c != key]
    ranks = [o.alias(f"_{i}") for i, o in enumerate([*order, F.col("entity_type"), F.col("end_pos")])]
    one = F.struct(*ranks, *[F.col(c) for c in names])
    # an island lies in its segment's partition, so this groups without another shuffle
    every = islands(df, [key], "_island").groupBy(key, "_island").agg(F.array_sort(F.collect_list(one)).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), fold)
    # most islands are one finding, which no rule drops
    return every.select(key, F.explode(F.when(F.size("all") == 1, F.col("all")).otherwise(kept)).alias("k")).select(key, *[F.col(f"k.{c}") for c in names])


def _replace_first(acc: Column, hit: Fold, x: Column, wins: Fold) -> Column:
    """Compare ``x`` with the first element that it hits: the better one stays, at the end of the array if it is ``x``."""
    first = F.get(F.filter(acc, lambda y: hit(y, x)), F.lit(0))
    others = F.filter(acc, lambda y: y != first)
    return F.when(first.isNull(), F.array_append(acc, x)).when(wins(first, x), F.array_append(others, x)).otherwise(acc)


def by_margin(df: DataFrame, key: str = "segment_id", margin: float = 0.05) -> DataFrame:
    """By start and longest first; against the first overlap a score better by more than ``margin`` wins, else the longer span."""
    wins = lambda old, new: (new["score"] > old["score"] + margin) | (~(old["score"] > new["score"] + margin) & (_length(new) > _length(old)))
    return folded(df, key, [F.col("start_pos"), -F.col("end_pos")], lambda acc, x: _replace_first(acc, overlap, x, wins))


def first_wins(df: DataFrame, key: str = "segment_id") -> DataFrame:
    """By start, best score and length; whatever overlaps an accepted finding is dropped."""
    order = [F.col("start_pos"), -F.col("score"), F.col("start_pos") - F.col("end_pos")]

    def taken(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)  # accepted findings follow each other, so the last ends last; only empty spans need a look at all
        return F.when(F.size(acc) == 0, False).when(last["start_pos"] < last["end_pos"], overlap(x, last)).otherwise(F.exists(acc, lambda y: overlap(x, y)))

    return folded(df, key, order, lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.array_append(acc, x)))


def by_priority(df: DataFrame, key: str = "segment_id", strategy: str = "priority_first", least_ratio: float = 0.5) -> DataFrame:
    """Overlaps of at least ``least_ratio`` of the shorter span are decided by custom terms, then type priority, then score (or length). A
    finding that loses is dropped, one that wins removes all that it beats. ``strategy``: priority_first, score_first, longer_span, keep_all."""
    if strategy == "keep_all":
        return df
    if strategy not in ("priority_first", "score_first", "longer_span"):
        raise ValueError(f"strategy {strategy!r} is not supported")
    ranked = df.withColumn("_custom", (F.col("entity_type") == "CUSTOM").cast("int")).withColumn("_p", lookup(PRIORITY, F.col("entity_type"), 50))
    close = lambda a, b: overlap(a, b) & ((F.least(a["end_pos"], b["end_pos"]) - F.greatest(a["start_pos"], b["start_pos"])) >= least_ratio * F.least(_length(a), _length(b)))
    last = (lambda a: _length(a).cast("double")) if strategy == "longer_span" else (lambda a: a["score"])
    beats = lambda x, y: F.struct(x["_custom"], x["_p"], last(x)) >= F.struct(y["_custom"], y["_p"], last(y))
    fold = lambda acc, x: F.when(
        F.exists(acc, lambda y: close(x, y) & ~beats(x, y)), F.filter(acc, lambda y: F.lit(True))
    ).otherwise(F.array_append(F.filter(acc, lambda y: ~close(x, y)), x))
    return folded(ranked, key, [F.col("start_pos"), -F.col("score")], fold).drop("_custom", "_p")


def against_last(df: DataFrame, key: str = "segment_id") -> DataFrame:
    """By start; only the last kept finding is looked at: higher type priority replaces it, then greater length."""
    ranked = df.withColumn("_p", lookup(TEXT_PRIORITY, F.col("entity_type"), 5))

    def fold(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        better = (x["_p"] > last["_p"]) | ((x["_p"] == last["_p"]) & (_length(x) > _length(last)))
        clash = (F.size(acc) > 0) & (x["start_pos"] < last["end_pos"])
        return F.when(~clash, F.array_append(acc, x)).when(better, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), x)).otherwise(acc)

    return folded(ranked, key, [F.col("start_pos")], fold).drop("_p")


def greedy_by_score(df: DataFrame, key: str = "segment_id") -> DataFrame:
    order = [-F.col("score"), F.col("start_pos")]
    return folded(df, key, order, lambda acc, x: F.when(F.exists(acc, lambda y: overlap(x, y)), acc).otherwise(F.array_append(acc, x)))


def by_severity(df: DataFrame, key: str = "segment_id") -> DataFrame:
    """Invalid spans go, equal ones keep the best score; by start and length, the first conflict is decided by severity, score, length, start.
    ``df`` has a column severity (low, medium, high, critical)."""
    valid = df.where((F.col("start_pos") >= 0) & (F.col("start_pos") < F.col("end_pos")))
    rest = [c for c in df.columns if c not in (key, "entity_type", "start_pos", "end_pos", "score")]
    best = Window.partitionBy(key, "entity_type", "start_pos", "end_pos").orderBy(F.desc("score"), *rest)
    ranked = valid.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumn("_s", lookup({"low": 0, "medium": 1, "high": 2, "critical": 3}, F.col("severity"), 1))
    rank = lambda x: F.struct(x["_s"], x["score"], _length(x), -x["start_pos"])

    def fold(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda y: overlap(y, x)), F.lit(True))
        put = lambda y, i: F.when((i + 1 == at) & (rank(y) < rank(x)), x).otherwise(y)
        return F.when(at == 0, F.array_append(acc, x)).otherwise(F.transform(acc, put))

    return folded(ranked, key, [F.col("start_pos"), F.col("start_pos") - F.col("end_pos")], fold).drop("_s")


def overlapping_pairs(df: DataFrame, key: str = "segment_id") -> DataFrame:
    """All overlapping pairs of a segment, each once, with the shared length, its share of the shorter span, and containment. Spans meet in bins as wide as they are, so
    that others of their segment never do."""
    box = lambda p: df.select(key, *[F.col(c).alias(f"{c}_{p}") for c in ("finding_id", "start_pos", "end_pos")])
    met = overlap_join(box("a"), box("b"), [key], [("start_pos_a", "end_pos_a")], [("start_pos_b", "end_pos_b")]).where("finding_id_a < finding_id_b")
    shared = F.least("end_pos_a", "end_pos_b") - F.greatest("start_pos_a", "start_pos_b")
    inside = lambda x, y: (F.col(f"start_pos_{x}") <= F.col(f"start_pos_{y}")) & (F.col(f"end_pos_{x}") >= F.col(f"end_pos_{y}"))
    shorter = F.least(F.col("end_pos_a") - F.col("start_pos_a"), F.col("end_pos_b") - F.col("start_pos_b"))
    return met.select(key, "finding_id_a", "finding_id_b", shared.alias("shared"), F.round(shared / shorter, 6).alias("ratio"), (inside("a", "b") | inside("b", "a")).alias("contained"))


def merge_adjacent(df: DataFrame, key: str = "segment_id", gap: int = 1) -> DataFrame:
    """Runs of findings of one type, each at most ``gap`` behind the end of the one before, become one: its end is that of the last, its
    score the best, its text all texts."""
    order = Window.partitionBy(key).orderBy("start_pos", "entity_type", "end_pos")
    new = (F.lag("entity_type").over(order) == F.col("entity_type")) & (F.col("start_pos") - F.lag("end_pos").over(order) <= gap)
    run = df.withColumn("_new", F.when(new, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct("start_pos", "entity_type", "end_pos", "value")
    return run.groupBy(key, "_run").agg(
        F.first("entity_type").alias("entity_type"), F.min("start_pos").alias("start_pos"), F.array_sort(F.collect_list(one)).alias("_all"), F.max("score").alias("score"), F.count("*").alias("parts")
    ).select(key, "entity_type", "start_pos", F.element_at("_all", -1)["end_pos"].alias("end_pos"), F.array_join(F.transform("_all", lambda x: x["value"]), "").alias("value"), "score", "parts")


def cap_per_type(df: DataFrame, each: int = 1000, total: int = 10_000, key: str = "segment_id") -> DataFrame:
    """At most ``each`` findings of a type, then at most ``total``, in the order of encounter."""
    seen = ["start_pos", "end_pos", "entity_type"]
    of_type = Window.partitionBy(key, "entity_type").orderBy(*seen)
    first = Window.partitionBy(key, "entity_type")
    whole = Window.partitionBy(key).orderBy("_first", "entity_type", *seen)
    few = df.withColumn("_first", F.min("start_pos").over(first)).withColumn("_n", F.row_number().over(of_type)).where(F.col("_n") <= each)
    return few.withColumn("_n", F.row_number().over(whole)).where(F.col("_n") <= total).drop("_n", "_first")


def top_by_score(df: DataFrame, most: int = 100, key: str = "segment_id") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "start_pos", "entity_type", "end_pos")
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def first_of_value(df: DataFrame, key: str = "segment_id") -> DataFrame:
    """One finding a value: the first met gives the type."""
    order = Window.partitionBy(key, "value").orderBy("start_pos", "entity_type", "end_pos")
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
