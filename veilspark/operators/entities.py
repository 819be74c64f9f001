"""Tags of a named-entity model as spans, and which entity types a policy treats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PART, blocks, bound, piece
from . import resolve

#: Names of one kind under several labels.
SAME_TYPE = {"PER": "PERSON", "GPE": "LOC", "ORGANIZATION": "ORG", "LOCATION": "LOC"}


def entity_of(tag: Column) -> Column:
    """The type of a tag such as B-PER; null for O."""
    bare = F.regexp_replace(F.upper(tag), "^[BI]-", "")
    known = F.create_map(*[F.lit(x) for kv in SAME_TYPE.items() for x in kv])
    return F.when(bare != "O", F.coalesce(F.try_element_at(known, bare), bare))


def tagged_spans(tokens: DataFrame, key: str) -> DataFrame:
    """Tokens (key, idx, tag, score, start_pos, end_pos) as spans: an I- tag goes on with a span of its type, all else begins one; the score is
    the least of its tokens."""
    order = Window.partitionBy(key).orderBy("idx")
    typed = tokens.withColumn("entity_type", entity_of(F.col("tag")))
    goes_on = F.upper("tag").startswith("I-") & (F.lag("entity_type").over(order) == F.col("entity_type"))
    run = typed.withColumn("_run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("entity_type is not null")
    return run.groupBy(key, "_run").agg(F.first("entity_type").alias("entity_type"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.min("score").alias("score")).drop("_run")


def under_policy(findings: DataFrame, overrides: DataFrame, profile: DataFrame, categories: DataFrame) -> DataFrame:
    """Findings with the treatment that applies: of the override, else of the profile's type, else of its category, else TOKEN; types switched off and
    scores below the least are dropped. overrides and profile: (entity_type, enabled, treatment, least_score); categories: (entity_type,
    category_enabled, category_treatment). All three are small tables of settings, one row a type."""
    named = lambda df, p: df.select("entity_type", *[F.col(c).alias(f"{p}_{c}") for c in ("enabled", "treatment", "least_score")])
    met = findings.join(named(overrides, "o"), "entity_type", "left").join(named(profile, "p"), "entity_type", "left").join(categories, "entity_type", "left")
    on = F.coalesce("o_enabled", "p_enabled", "category_enabled", F.lit(True))
    least = F.coalesce("o_least_score", "p_least_score", F.lit(0.0))
    treatment = F.coalesce("o_treatment", "p_treatment", "category_treatment", F.lit("TOKEN"))
    return met.where(on & (F.col("score") >= least)).select(*findings.columns, treatment.alias("treatment"))


def kept_predictions(predictions: DataFrame, key: str, least: float, types: list[str] | None = None) -> DataFrame:
    """Predictions of enough score and of the types asked for, the first of overlapping ones (by start, then score)."""
    good = predictions.where(F.col("score") >= least)
    return resolve.first_wins(good.where(F.col("entity_type").isin(types)) if types else good, key)


CHUNK = "array<struct<start:int,end:int>>"


def chunk_starts(text: Column, most: int = 512, overlap: int = 50) -> Column:
    """array<struct<start, end>>: pieces of at most ``most`` characters that overlap by ``overlap``; a piece ends behind its last space if that lies beyond its
    middle. Each piece is read from the text's blocks, and pieces are listed part by part, so that the cost grows with the text's length."""
    return bound(blocks(text), lambda cut: bound(F.length(text), lambda n: _chunked(n, cut, most, overlap)))


def _chunked(n: Column, cut: Column, most: int, overlap: int) -> Column:
    step = (most // 2 + 1) - overlap  # a piece moves on by more than this

    def next_of(last: Column) -> Column:
        at = F.when(last < 0, 0).otherwise(last - overlap)
        full = F.least(at + most, n)

        def ended(part: Column) -> Column:
            back = F.locate(" ", F.reverse(part))
            space = F.length(part) - back  # place of the last space
            end = F.when((full < n) & (back > 0) & (space > most // 2), at + space + 1).otherwise(full)
            return F.struct(at.cast("int").alias("start"), end.cast("int").alias("end"))

        return bound(piece(cut, at, F.lit(most)), ended)

    def some(last: Column) -> Column:
        """The next PART pieces behind the one that ends at ``last``."""

        def put(acc: Column, _: Column) -> Column:
            grown = bound(next_of(acc["last"]), lambda p: F.struct(p["end"].alias("last"), F.array_append(acc["out"], p).alias("out")))
            return F.when(acc["last"] >= n, acc).otherwise(grown)

        return F.aggregate(F.sequence(F.lit(1), F.lit(PART)), F.struct(last.alias("last"), F.array().cast(CHUNK).alias("out")), put)

    rounds = F.sequence(F.lit(0), F.floor(n / (step * PART)).cast("int") + 1)
    start = F.struct(F.lit(-1).alias("last"), F.array().cast(f"array<{CHUNK}>").alias("parts"))
    more = lambda acc: bound(some(acc["last"]), lambda s: F.struct(s["last"].alias("last"), F.array_append(acc["parts"], s["out"]).alias("parts")))
    listed = F.aggregate(rounds, start, lambda acc, _: F.when(acc["last"] >= n, acc).otherwise(more(acc)), lambda acc: F.flatten(acc["parts"]))
    return F.when(n <= most, F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))).otherwise(listed)


def chunks(texts: DataFrame, key: str, text: str = "text", most: int = 512, overlap: int = 50) -> DataFrame:
    """(key, chunk, start_pos, text): the pieces of each text for a model that reads no more at once."""
    t = F.col(text)
    cut = lambda b, n: F.transform(_chunked(n, b, most, overlap), lambda c: F.struct(c["start"].cast("long").alias("start_pos"), piece(b, c["start"], c["end"] - c["start"]).alias("text")))
    return texts.select(key, F.posexplode(bound(blocks(t), lambda b: bound(F.length(t), lambda n: cut(b, n)))).alias("chunk", "_c")).select(key, "chunk", "_c.start_pos", "_c.text")


def merged_predictions(pieces: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Predictions (key, chunk, entity_type, start_pos, end_pos, score) of pieces as those of the texts: offsets move, and in the overlaps one of a type that shares more than
    0.8 of the shorter keeps the better score, other overlaps the better of the two where the earlier is not worse."""
    moved = predictions.join(pieces.select(key, "chunk", F.col("start_pos").alias("_at")), [key, "chunk"])
    moved = moved.withColumn("start_pos", F.col("start_pos") + F.col("_at")).withColumn("end_pos", F.col("end_pos") + F.col("_at")).select(key, "entity_type", "start_pos", "end_pos", "score")
    shared = lambda x, y: F.least(x["end_pos"], y["end_pos"]) - F.greatest(x["start_pos"], y["start_pos"])
    width = lambda x: x["end_pos"] - x["start_pos"]
    same = lambda x, y: (x["entity_type"] == y["entity_type"]) & (shared(x, y) > 0.8 * F.least(width(x), width(y))) & (shared(x, y) > 0)

    def fold(acc: Column, x: Column) -> Column:
        stops = lambda y: same(x, y) | ((shared(x, y) > 0) & (x["score"] <= y["score"]))

        def put(first: Column) -> Column:
            better = same(x, first) & (x["score"] > first["score"])
            return F.when(first.isNull(), F.array_append(acc, x)).when(better, F.array_append(F.filter(acc, lambda y: y != first), x)).otherwise(acc)

        return bound(F.get(F.filter(acc, stops), F.lit(0)), put)

    return resolve.folded(moved, key, [F.col("start_pos"), -F.col("score")], fold)
