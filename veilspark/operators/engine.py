"""The detection engine: the recognizers asked for, then names that are none and denied values out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blocks, bound, piece
from . import classify, recognizers
from .recognizers_more import ADDRESS_LABELS, COMMON_TERMS, not_a_person

#: Entity types whose value has to be a name; the recognizer that knows a name by what stands around it; characters before a name in which an address label makes it a place.
NAMES, BY_CONTEXT, ADDRESS_WINDOW = ["PERSON"], "id_person", 40


def analyze(df: DataFrame, as_of: str, text: str = "text", common: list[str] | None = None, denied: DataFrame | None = None, **how) -> DataFrame:
    """The findings of ``recognizers.scan`` without persons that can't be persons (``common``: lower-case words that are no names, which the caller's
    language decides) and without values of the deny-list (term). Blank texts have none."""
    found = recognizers.scan(df.where(F.trim(text) != ""), as_of, text, **how)
    kept = found.where(~F.col("entity_type").isin(NAMES) | ~F.coalesce(not_a_person(F.col("value"), common or []), F.lit(True)))
    return classify.without_denied(kept, denied) if denied is not None else kept


def without_addresses(findings: DataFrame, before: str = "before") -> DataFrame:
    """Persons that directly follow an address label, by the text ``before`` them on their line, are places and go."""
    line = F.lower(F.substring_index(F.col(before), "\n", -1))
    address = line.rlike("(?:" + "|".join(w.replace(".", r"\.") for w in ADDRESS_LABELS) + r")\s*[:.]?\s*$")
    return findings.where(~F.col("entity_type").isin(NAMES) | ~F.coalesce(address, F.lit(False)))


def without_places(findings: DataFrame, texts: DataFrame, key: str, text: str = "text", window: int = ADDRESS_WINDOW) -> DataFrame:
    """``findings`` (key, entity_type, start_pos, recognizer, ...) without persons that an address label precedes within ``window`` characters, case apart: those are places. Names that the
    context recognizer found stay, as do findings at a text's beginning and those of no text.

    The places asked about in a text meet in one row beside it, so that it is read once, from blocks, and not once for each finding.
    """
    doubtful = F.col("entity_type").isin(NAMES) & (F.col("recognizer") != BY_CONTEXT) & (F.col("start_pos") > 0)
    asked = findings.where(doubtful).groupBy(F.col(key).alias("_k")).agg(F.collect_set(F.col("start_pos").cast("long")).alias("_starts"))
    labels = "|".join(w.replace(".", r"\.") for w in ADDRESS_LABELS)

    def named(cut, start):
        first = F.greatest(start - window, F.lit(0))
        return F.lower(piece(cut, first, start - first)).rlike(labels)

    met = texts.select(F.col(key).alias("_t"), F.col(text).alias("_text")).join(asked, F.col("_t") == F.col("_k"))
    places = met.select("_k", F.explode(bound(blocks(F.col("_text")), lambda cut: F.filter("_starts", lambda s: named(cut, s)))).alias("_s"))
    return findings.join(places.distinct(), (F.col(key) == F.col("_k")) & (F.col("start_pos") == F.col("_s")) & doubtful, "left_anti")


def person_filter(findings: DataFrame, texts: DataFrame, key: str, text: str = "text", common: list[str] | None = None) -> DataFrame:
    """``findings`` without persons that can't be persons: by their words (``common``, by default COMMON_TERMS), and by an address label before them."""
    bad = F.coalesce(not_a_person(F.col("value"), COMMON_TERMS if common is None else common), F.lit(True))
    return without_places(findings.where(~F.col("entity_type").isin(NAMES) | ~bad), texts, key, text)
