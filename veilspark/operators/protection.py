"""Protection end to end: plan, treat and apply; whole cells or only what is found in them; restoring cells; the re-scan of protected output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Pattern, find_spans, normalise_value, splice, treated
from . import matching, protect, recognizers, resolve

#: Entity types looked for inside cells, the least score there, the token forms of cells and of leftovers.
CELL_TYPES = ["EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS", "URL", "IBAN_CODE", "ID_NIK", "ID_NPWP", "ID_KK", "ID_PHONE", "ID_BPJS", "PERSON", "DATE_OF_BIRTH"]
CELL_SCORE = 0.5
CELL_TOKEN = r"\[\[[A-Z_]+_[A-Fa-f0-9]+\]\]"
WHOLE_TOKEN = rf"^{protect.TOKEN}$"
PARTIAL_TOKENS = [r"\[\[(?![A-Z][A-Z0-9_]{1,31}_[A-F0-9]{6,16}\]\])", r"(?<!\[\[)[A-Z][A-Z0-9_]+_[A-F0-9]{6,16}\]\]", r"\[\[[A-Z_]+\]\]"]


def replace_all(text: Column, pairs: Column) -> Column:
    """Every occurrence of each value of ``pairs`` (array of struct value, token) replaced, pair after pair in the array's order."""
    return F.aggregate(pairs, text, lambda acc, p: F.when(p["value"] != "", F.replace(acc, p["value"], p["token"])).otherwise(acc))


def replace_values(texts: DataFrame, mapping: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``texts`` with all occurrences of the values of ``mapping`` (key, position, value, token) of the same key replaced in the order of position, and
    ``replaced``: how often they occurred in the text as it was."""
    pairs = mapping.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "value", "token"))).alias("_p"))
    met = texts.join(pairs, key, "left")
    times = F.aggregate("_p", F.lit(0).cast("long"), lambda acc, p: acc + F.when(p["value"] != "", F.floor((F.length(text) - F.length(F.replace(F.col(text), p["value"], F.lit("")))) / F.length(p["value"]))).otherwise(0))
    out = met.withColumn("replaced", F.coalesce(times, F.lit(0).cast("long")))
    return out.withColumn(text, F.when(F.col("_p").isNull(), F.col(text)).otherwise(replace_all(F.col(text), F.col("_p")))).drop("_p")


def padded(replacement: Column, length: Column) -> Column:
    """A replacement cut or filled with blanks to ``length``."""
    return F.rpad(replacement, length, F.lit(" "))


def plan(texts: DataFrame, key: str, as_of: str, text: str = "text", least: float = 0.0, **how) -> DataFrame:
    """The findings to treat: (key, entity_type, start_pos, end_pos, value, score, recognizer), overlaps decided; a review may add review_action."""
    found = recognizers.scan(texts.select(key, text), as_of, text, **how).where(F.col("score") >= least)
    return resolve.first_wins(found, key)


def document_findings(segments: DataFrame, document: str, segment: str, as_of: str, each: int = 1000, text: str = "text", **how) -> DataFrame:
    """Findings of a document's segments (document, segment, parent_offset, text) at their places in the document, overlaps decided within a segment; a document keeps at
    most ``each`` a segment, in order."""
    found = recognizers.scan(segments.select(document, segment, "parent_offset", text), as_of, text, **how)
    place = F.struct(document, segment, "parent_offset")
    one = resolve.by_margin(found.select(place.alias("_s"), *[c for c in found.columns if c not in (document, segment, "parent_offset")]), "_s").select("_s.*", *[c for c in found.columns if c not in (document, segment, "parent_offset")])
    moved = one.withColumn("start_pos", F.col("start_pos") + F.col("parent_offset")).withColumn("end_pos", F.col("end_pos") + F.col("parent_offset"))
    count = segments.groupBy(F.col(document).alias("_d")).agg((F.count("*") * each).alias("_most"))
    order = Window.partitionBy(document).orderBy("start_pos", "end_pos", "entity_type")
    ranked = moved.withColumn("_n", F.row_number().over(order)).join(count, F.col(document) == F.col("_d"))
    return ranked.where(F.col("_n") <= F.col("_most")).drop("_n", "_d", "_most", "parent_offset")


def treatments(planned: DataFrame, hmac_key: bytes, default: str = "TOKEN", vault: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The plan with treatment and replacement, and the vault rows: what a review allows is kept, all else has the default treatment or that of its own
    column treatment."""
    own = F.col("treatment") if "treatment" in planned.columns else F.lit(default)
    allowed = F.col("review_action") == "ALLOW" if "review_action" in planned.columns else F.lit(False)
    chosen = planned.withColumn("treatment", F.when(F.coalesce(allowed, F.lit(False)), "KEEP").otherwise(F.coalesce(own, F.lit(default))))
    tokens = protect.assign_tokens(chosen.where("treatment = 'TOKEN'"), hmac_key, vault)
    normal = chosen.withColumn("normalised", normalise_value(F.col("entity_type"), F.col("value")))
    met = normal.join(tokens.select("entity_type", "normalised", "token"), ["entity_type", "normalised"], "left")
    return met.withColumn("replacement", treated(F.col("treatment"), F.col("entity_type"), F.col("value"), F.col("token"), hmac_key)).drop("normalised", "token"), tokens


def apply(texts: DataFrame, treated_plan: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``texts`` with the replacements of a treated plan put in."""
    edits = treated_plan.groupBy(key).agg(F.collect_list(F.struct("start_pos", "end_pos", "replacement")).alias("_e"))
    met = texts.join(edits, key, "left")
    return met.withColumn(text, F.when(F.col("_e").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("_e")))).drop("_e")


def execute(texts: DataFrame, key: str, as_of: str, hmac_key: bytes, default: str = "TOKEN", vault: DataFrame | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """Plan, treat and apply in one: the protected texts and the vault rows."""
    made, tokens = treatments(plan(texts, key, as_of, **how), hmac_key, default, vault)
    return apply(texts, made, key), tokens


def protect_cells(df: DataFrame, key: str, columns: list[str], as_of: str, hmac_key: bytes, vault: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Only what is found inside the cells of ``columns`` replaced by tokens, the best score first where findings overlap; the text around it stays. Blank cells and
    cells without findings stay as they are, others are trimmed."""
    cells = df.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.trim(F.col(c).cast("string")) for c in columns])))).toDF(key, "_column", "_cell").where("_cell <> ''")
    keyed = cells.select(F.struct(key, "_column").alias("cell"), "_cell")
    found = recognizers.scan(keyed, as_of, "_cell", entities=CELL_TYPES).where(F.col("score") >= CELL_SCORE)
    made, tokens = treatments(resolve.greedy_by_score(found, "cell"), hmac_key, "TOKEN", vault)
    touched = apply(keyed.join(made.select("cell").distinct(), "cell", "left_semi"), made, "cell", "_cell")
    new = touched.groupBy(F.col(f"cell.{key}").alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("cell._column", "_cell"))).alias("_new"))
    met = df.join(new, F.col(key) == F.col("_k"), "left")
    out = met.select(*[F.coalesce(F.try_element_at("_new", F.lit(c)), F.col(c).cast("string")).alias(c) if c in columns else F.col(c) for c in df.columns])
    return out, tokens


def protect_columns(df: DataFrame, key: str, full: dict[str, str], pii_only: list[str], as_of: str, hmac_key: bytes, vault: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Columns of ``full`` (name -> entity type) become one token a cell, in those of ``pii_only`` only findings do; and all vault rows."""
    out, tokens = protect.protect_values(df, full, hmac_key, vault) if full else (df, None)
    if not pii_only:
        return out, tokens
    seen = vault if tokens is None else tokens.select("entity_type", "hmac", "token")
    if tokens is not None and vault is not None:
        seen = seen.unionByName(vault.select("entity_type", "hmac", "token")).distinct()
    out, more = protect_cells(out, key, pii_only, as_of, hmac_key, seen)
    return out, more if tokens is None else tokens.unionByName(more.where("is_new"))


def restore_cells(df: DataFrame, mappings: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with the tokens in the cells of ``columns`` replaced by the originals of ``mappings`` (token, original); restored and not_found count tokens met,
    each as often as it stands there."""
    cells = df.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns])))).toDF(key, "_column", "_cell")
    tokens = cells.select(key, "_column", F.posexplode(F.regexp_extract_all("_cell", F.lit(CELL_TOKEN), F.lit(0))).alias("position", "token"))
    met = tokens.join(mappings.select("token", "original"), "token", "left")
    pair = F.struct("position", F.col("token").alias("value"), F.col("original").alias("token"))
    by_cell = met.groupBy(key, "_column").agg(F.array_sort(F.collect_list(F.when(F.col("original").isNotNull(), pair))).alias("_p"), F.count("original").alias("_hit"), F.count_if(F.col("original").isNull()).alias("_miss"))
    new = cells.join(by_cell, [key, "_column"]).withColumn("_cell", replace_all(F.col("_cell"), F.col("_p")))
    rows = new.groupBy(F.col(key).alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("_column", "_cell"))).alias("_new"), F.sum("_hit").alias("_hit"), F.sum("_miss").alias("_miss"))
    out = df.join(rows, F.col(key) == F.col("_k"), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(*[F.coalesce(F.try_element_at("_new", F.lit(c)), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns], count(F.col("_hit")).alias("restored"), count(F.col("_miss")).alias("not_found"))


def rescan(texts: DataFrame, key: str, as_of: str, values: DataFrame | None = None, strict: bool = True, text: str = "text", scope: str | None = None, **how) -> DataFrame:
    """(key, leakage_type, severity, value, entity_type, confidence, message) of what protected texts still give away: findings that are no valid tokens, protected
    values that stand in any text, case apart, and leftovers of tokens.

    Every value of ``values`` (value) is looked for in every text; with ``scope``, a column of both tables such as the project, in the texts of its own scope only.
    """
    found = recognizers.scan(texts.select(key, text), as_of, text, **how).where(~F.col("value").rlike(WHOLE_TOKEN))
    residual = found.select(
        key, F.lit("residual_pii").alias("leakage_type"), protect.rescan_severity(F.col("score"), strict).alias("severity"), "value", "entity_type", F.col("score").alias("confidence"),
        F.concat(F.lit("Residual "), "entity_type", F.lit(" found in output")).alias("message"),
    )
    patterns = [Pattern("TOKEN", p, 0.8) for p in PARTIAL_TOKENS]
    partial = find_spans(texts.select(key, text), text, patterns).select(
        key, F.lit("partial_token").alias("leakage_type"), F.lit("WARNING").alias("severity"), "value", F.lit(None).cast("string").alias("entity_type"), F.lit(0.8).alias("confidence"), F.lit("Partial or malformed token found").alias("message")
    )
    out = residual.unionByName(partial)
    if values is None:
        return out
    left = matching.literal_matches(texts, key, values, text, places=False, scope=scope)
    return out.unionByName(left.select(
        key, F.lit("untokenized_value").alias("leakage_type"), F.lit("CRITICAL").alias("severity"), "value", F.lit(None).cast("string").alias("entity_type"), F.lit(1.0).alias("confidence"),
        F.lit("Original value found in output - should have been tokenized").alias("message"),
    ))


def rescan_result(texts: DataFrame, leaks: DataFrame, key: str) -> DataFrame:
    """(key, is_clean, critical, warning, info) for every text: clean without critical leaks."""
    n = lambda s: F.count_if(F.col("severity") == s)
    g = leaks.groupBy(key).agg(n("CRITICAL").alias("critical"), n("WARNING").alias("warning"), n("INFO").alias("info"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return texts.select(key).join(g, key, "left").select(key, (F.coalesce("critical", F.lit(0)) == 0).alias("is_clean"), *[zero(c) for c in ("critical", "warning", "info")])


def remediation(leaks: DataFrame, place: str) -> DataFrame:
    """Leaks with a suggestion; ``place`` names the column that says where a leak is."""
    start = F.left("value", F.lit(20))
    said = (
        F.when(F.col("leakage_type") == "residual_pii", F.concat(F.lit("Add detection rule for "), "entity_type", F.lit(": '"), start, F.lit("...'")))
        .when(F.col("leakage_type") == "untokenized_value", F.concat(F.lit("Value '"), start, F.lit("...' was not tokenized - check detection patterns")))
        .when(F.col("leakage_type") == "partial_token", F.concat(F.lit("Fix malformed token at "), F.col(place).cast("string"), F.lit(": '"), "value", F.lit("'")))
    )
    return leaks.withColumn("suggestion", said)


def consistent_treatments(findings: DataFrame, order: str) -> DataFrame:
    """Findings whose treatment is that of the first finding, by ``order``, with the same type and normalised value."""
    w = Window.partitionBy("entity_type", normalise_value(F.col("entity_type"), F.col("value"))).orderBy(order)
    return findings.withColumn("treatment", F.first_value("treatment").over(w))
