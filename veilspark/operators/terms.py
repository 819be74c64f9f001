"""Terms that a user always or never wants protected, and names cut free of noise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Pattern, bound, located
from .protect import decrypt, encrypt
from .recognizers import rows_of, scored
from .recognizers_more import LABEL_PARTS, PLACE_WORDS, not_a_person

#: How many terms a list may hold, and words around a name that aren't part of it.
MOST_TERMS = 1000
#: The name under which a store of terms is sealed.
TERM_STORE = "custom_terms"
LEADING_NOISE = (
    ["pasien", "dokter", "dr", "nama", "cek", "lab", "kontrol", "penjamin", "pengirim", "penerima", "kepada", "dari", "pic", "an", "atas", "perawat", "bapak", "bpk", "ibu", "sdr", "sdri", "tn", "ny"]
)


def term_pattern(term: str, kind: str, case_sensitive: bool = False, hyphens: bool = True) -> str:
    """The expression of a term: exact, word, contains or regex. ``hyphens``: a word also ends at no hyphen; a pattern that Java can't read counts as
    literal text."""
    literal = r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"
    sides = (r"(?<![\w-])", r"(?![\w-])") if hyphens else (r"\b", r"\b")
    body = {"exact": rf"^{literal}$", "word": f"{sides[0]}{literal}{sides[1]}", "contains": literal}.get(kind)
    if body is None:
        try:
            re.compile(term)
            body = term
        except re.error:
            body = literal
    return f"(?U){body}" if case_sensitive else f"(?iuU){body}"


def terms_found(text: Column, terms: list[dict], score: float = 1.0, hyphens: bool = True) -> Column:
    """The matches of ``terms`` (term, kind, entity_type, case_sensitive), MOST_TERMS of them at most, each term's without overlap among themselves."""
    if len(terms) > MOST_TERMS:
        raise ValueError(f"a list holds at most {MOST_TERMS} terms")
    patterns = [Pattern(t.get("entity_type", "CUSTOM_TERM"), term_pattern(t["term"], t.get("kind", "word"), t.get("case_sensitive", False), hyphens), score, "custom_terms") for t in terms]
    return F.concat(*[scored(located(text, p), p) for p in patterns])


def terms(df: DataFrame, wanted: list[dict], text: str = "text") -> DataFrame:
    return rows_of(df, text, terms_found(F.col(text), wanted))


def literal_terms(df: DataFrame, wanted: list[str], text: str = "text", case_sensitive: bool = False) -> DataFrame:
    """Every place of each literal term, of type CUSTOM and certain."""
    return rows_of(df, text, terms_found(F.col(text), [{"term": t, "kind": "contains", "entity_type": "CUSTOM", "case_sensitive": case_sensitive} for t in wanted]))


def always_protected(df: DataFrame, wanted: list[dict], text: str = "text") -> DataFrame:
    """Terms that are always protected: score 0.95, band HIGH, flagged as the user's own."""
    found = rows_of(df, text, terms_found(F.col(text), wanted, 0.95, hyphens=False))
    return found.withColumn("band", F.lit("HIGH")).withColumn("is_from_custom_terms", F.lit(True))


def never_protected(df: DataFrame, unwanted: list[dict], value: str = "value") -> DataFrame:
    """Findings but for those whose whole value a term matches, case apart."""
    v = F.col(value)
    out = F.lit(False)
    for t in unwanted:
        pattern = term_pattern(t["term"], t.get("kind", "word"), t.get("case_sensitive", False), hyphens=False)
        out = out | F.exists(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), lambda m: F.lower(m) == F.lower(v))
    return df.where(~F.coalesce(out, F.lit(False)))


def export_terms(terms_table: DataFrame) -> DataFrame:
    """One JSON line a term (term, kind, entity_type, case_sensitive)."""
    return terms_table.select(F.to_json(F.struct("term", "kind", "entity_type", "case_sensitive")).alias("value"))


def import_terms(lines: DataFrame) -> DataFrame:
    """Terms of JSON lines; lines that hold none are left out, what is missing takes the usual value."""
    t = F.from_json("value", "term string, kind string, entity_type string, case_sensitive boolean")
    out = lines.select(t.alias("t")).where(F.col("t.term").isNotNull() & (F.col("t.term") != ""))
    return out.select("t.term", F.coalesce("t.kind", F.lit("word")).alias("kind"), F.coalesce("t.entity_type", F.lit("CUSTOM_TERM")).alias("entity_type"), F.coalesce("t.case_sensitive", F.lit(False)).alias("case_sensitive"))


def sealed_terms(terms_table: DataFrame, project: str, key: bytes) -> DataFrame:
    """(id, cipher): the terms of a project (id, term, kind, entity_type, case_sensitive) as a store keeps them, each a JSON text under AES-GCM that opens only in its place."""
    body = F.to_json(F.struct("term", "kind", "entity_type", "case_sensitive"))
    return terms_table.select("id", encrypt(body, F.lit(project), TERM_STORE, F.col("id").cast("string"), "term", key).alias("cipher"))


def opened_terms(store: DataFrame, project: str, key: bytes, strict: bool = True) -> DataFrame:
    """The terms (id, term, kind, entity_type, case_sensitive) of a store. What doesn't open with this project and key fails the query, or is left out if not ``strict``;
    nulls and cut-off ciphers don't open."""
    body = F.coalesce(decrypt(F.col("cipher"), F.lit(project), TERM_STORE, F.col("id").cast("string"), "term", key), F.raise_error(F.concat(F.lit("a term does not open: "), F.col("id").cast("string"))) if strict else F.lit(None))
    read = store.select("id", F.from_json(body, "term string, kind string, entity_type string, case_sensitive boolean").alias("t"))
    return read.where(F.col("t.term").isNotNull()).select("id", "t.*")


def trimmed_person(value: Column, common: list[str]) -> Column:
    """struct<value, lead>: a name without noise words at its ends and how many characters went from its beginning; null where no name is left.
    ``common``: lower-case words and phrases that are no names."""
    noise = sorted({*LEADING_NOISE, *common, *LABEL_PARTS, *PLACE_WORDS})
    token = Pattern("T", r"(?U)\S+", 1.0)
    is_noise = lambda x: bound(F.lower(F.regexp_replace(x["value"], r"^[.,;:|()\[\]]+|[.,;:|()\[\]]+$", "")), lambda w: (w == "") | w.isin(noise))

    def kept(tokens: Column) -> Column:
        good = F.filter(tokens, lambda x: ~is_noise(x))
        cut = lambda g: F.when(F.size(g) > 0, F.struct(F.substring(value, (F.get(g, F.lit(0))["start_pos"] + 1).cast("int"), (F.element_at(g, -1)["end_pos"] - F.get(g, F.lit(0))["start_pos"]).cast("int")).alias("value"), F.get(g, F.lit(0))["start_pos"].alias("lead")))
        return bound(good, cut)

    return bound(bound(located(value, token), kept), lambda s: F.when(~not_a_person(s["value"], common), s))


def trim_persons(df: DataFrame, common: list[str]) -> DataFrame:
    """Findings in which persons are cut to their names; those of which none is left go."""
    person = F.col("entity_type") == "PERSON"
    cut = df.withColumn("_t", F.when(person, trimmed_person(F.col("value"), common))).where(~person | F.col("_t").isNotNull())
    start = F.col("start_pos") + F.coalesce("_t.lead", F.lit(0))
    value = F.coalesce("_t.value", "value")
    return cut.withColumn("end_pos", F.when(person, start + F.length(value)).otherwise(F.col("end_pos"))).withColumn("start_pos", start).withColumn("value", value).drop("_t")


