"""Tokens, the vault, protection of texts and columns, restoring, and the search for leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Pattern, find_spans, normalise_value, splice, value_hmac
from . import matching

#: Fixed value: the form of a token.
TOKEN = r"\[\[[A-Z][A-Z0-9_]{1,31}_[A-F0-9]{6,16}\]\]"
#: How many digits a token may have.
LENGTHS = [6, 8, 10, 12, 14, 16]
#: So many originals of one document are compared with each of its findings; more are looked for by matching.
FEW_ORIGINALS = 64


def assign_tokens(values: DataFrame, key: bytes, vault: DataFrame | None = None) -> DataFrame:
    """(entity_type, normalised, hmac, token, is_new) for the distinct values of ``values`` (entity_type, value).

    A value in ``vault`` (entity_type, hmac, token) keeps its token. Other tokens take six digits of the keyed hash; of values that share these,
    each takes a length of its own from 6, 8, up to 16 in the order of the hash, and none that a token of the vault with these six digits
    has, so no two tokens can be equal below 16 digits. Where 16 digits don't part two values, raise_error stops the job: the form of a
    token has no room for more.
    """
    e, v = F.col("entity_type"), F.col("value")
    distinct = values.select("entity_type", normalise_value(e, v).alias("normalised"), value_hmac(e, v, key).alias("hmac")).distinct()
    if vault is None:
        vault = values.sparkSession.createDataFrame([], "entity_type string, hmac string, token string")
    old = vault.select("entity_type", "hmac", F.col("token").alias("old"))
    known = distinct.join(old, ["entity_type", "hmac"], "left")
    token_of = lambda n: F.concat(F.lit("[["), e, F.lit("_"), F.upper(F.substring("hmac", F.lit(1), n)), F.lit("]]"))
    digits_of = F.regexp_extract("token", r"_([A-F0-9]+)\]\]$", 1)
    taken = vault.select("entity_type", F.left(digits_of, F.lit(6)).alias("six"), F.length(digits_of).alias("n")).groupBy("entity_type", "six").agg(F.collect_set("n").alias("used"))
    fresh = known.where("old is null").withColumn("six", F.upper(F.left("hmac", F.lit(6)))).join(taken, ["entity_type", "six"], "left")
    free = F.array_except(F.array(*[F.lit(n) for n in LENGTHS[:-1]]), F.coalesce("used", F.array().cast("array<int>")))
    rank = F.row_number().over(Window.partitionBy("entity_type", "six").orderBy("hmac")) - 1
    made = fresh.withColumn("token", token_of(F.coalesce(F.get(free, rank), F.lit(LENGTHS[-1]))))
    in_vault = vault.select(F.col("token").alias("_t")).where(F.length(digits_of) == LENGTHS[-1]).distinct()
    same = F.count("*").over(Window.partitionBy("token"))
    made = made.join(in_vault, F.col("token") == F.col("_t"), "left")
    made = made.withColumn("token", F.when((same > 1) | F.col("_t").isNotNull(), F.raise_error(F.lit("tokens collide at full length"))).otherwise(F.col("token")))
    kept = known.where("old is not null").select("entity_type", "normalised", "hmac", F.col("old").alias("token"), F.lit(False).alias("is_new"))
    return kept.unionByName(made.select("entity_type", "normalised", "hmac", "token", F.lit(True).alias("is_new")))


def protect_texts(texts: DataFrame, findings: DataFrame, tokens: DataFrame, key_column: str, text: str = "text") -> DataFrame:
    """``texts`` with each finding (key_column, entity_type, start_pos, end_pos, value), none overlapping, replaced by its token."""
    f = findings.withColumn("normalised", normalise_value(F.col("entity_type"), F.col("value"))).join(tokens.select("entity_type", "normalised", "token"), ["entity_type", "normalised"])
    edits = f.groupBy(key_column).agg(F.collect_list(F.struct("start_pos", "end_pos", F.col("token").alias("replacement"))).alias("_edits"))
    joined = texts.join(edits, key_column, "left")
    return joined.withColumn(text, F.when(F.col("_edits").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("_edits")))).drop("_edits")


def protect_values(df: DataFrame, columns: dict[str, str], key: bytes, vault: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Whole cells of the columns (name -> entity type) replaced by tokens, and the vault rows of all of them. Values in ``vault`` keep their tokens;
    blank cells stay."""
    cells = None
    for c, entity in columns.items():
        one = df.select(F.lit(entity).alias("entity_type"), F.trim(F.col(c).cast("string")).alias("value")).where("value <> ''")
        cells = one if cells is None else cells.unionByName(one)
    tokens = assign_tokens(cells, key, vault)
    for c, entity in columns.items():
        own = tokens.where(F.col("entity_type") == entity).select(F.col("normalised").alias("_n"), F.col("token").alias("_t"))
        df = df.join(own, normalise_value(F.lit(entity), F.trim(F.col(c).cast("string"))) == F.col("_n"), "left")
        df = df.withColumn(c, F.when(F.trim(F.col(c).cast("string")) == "", F.col(c).cast("string")).otherwise(F.coalesce("_t", F.col(c).cast("string")))).drop("_n", "_t")
    return df, tokens


def find_tokens(df: DataFrame, text: str = "text", context: int = 20) -> DataFrame:
    """Tokens in texts with the characters around them."""
    spans = find_spans(df, text, [Pattern("TOKEN", TOKEN, 1.0)], context, context)
    ahead = F.least("start_pos", F.lit(context)).cast("int")
    bare = F.regexp_replace("value", r"^\[\[|\]\]$", "")
    return spans.select(
        *[c for c in df.columns if c != text], "start_pos", "end_pos", F.col("value").alias("token"), F.regexp_extract(bare, r"^(.*)_([A-F0-9]+)$", 1).alias("entity_type"),
        F.regexp_extract(bare, r"^(.*)_([A-F0-9]+)$", 2).alias("token_id"), F.left("context", ahead).alias("context_before"), F.substring("context", ahead + F.length("value") + 1, F.lit(context)).alias("context_after"),
    )


def spellings(findings: DataFrame, tokens: DataFrame, mappings: DataFrame, key_column: str) -> DataFrame:
    """(key_column, start_pos, original): places of protected texts whose value was written otherwise than the original of its token in ``mappings`` (token, original), such as in another case.
    ``findings`` and ``tokens`` as in ``protect_texts``; a place moves by what the tokens before it are longer than their values."""
    f = findings.withColumn("normalised", normalise_value(F.col("entity_type"), F.col("value"))).join(tokens.select("entity_type", "normalised", "token"), ["entity_type", "normalised"])
    before = Window.partitionBy(key_column).orderBy("start_pos").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.col("start_pos") + F.coalesce(F.sum(F.length("token") - (F.col("end_pos") - F.col("start_pos"))).over(before), F.lit(0))
    met = f.withColumn("_at", moved).join(mappings.select("token", "original"), "token").where("value <> original")
    return met.select(key_column, F.col("_at").alias("start_pos"), F.col("value").alias("original"))


def restore_texts(texts: DataFrame, mappings: DataFrame, key_column: str, text: str = "text", spelt: DataFrame | None = None) -> DataFrame:
    """Every token of ``mappings`` (token, original) in a text replaced; columns restored and unresolved count its tokens. Values that differ in case share a token, so the original
    stands for all of them, but where ``spelt`` (of ``spellings``) has a place's own."""
    met = find_tokens(texts.select(key_column, text), text).select(key_column, "start_pos", "end_pos", "token").join(mappings.select("token", "original"), "token", "left")
    if spelt is not None:
        met = met.join(spelt.select(key_column, "start_pos", F.col("original").alias("_own")), [key_column, "start_pos"], "left").withColumn("original", F.coalesce("_own", "original"))
    edits = met.groupBy(key_column).agg(
        F.collect_list(F.when(F.col("original").isNotNull(), F.struct("start_pos", "end_pos", F.col("original").alias("replacement")))).alias("_edits"),
        F.count("original").alias("restored"), F.count_if(F.col("original").isNull()).alias("unresolved"),
    )
    joined = texts.join(edits, key_column, "left")
    out = F.when(F.size("_edits") > 0, splice(F.col(text), F.col("_edits"))).otherwise(F.col(text))
    return joined.withColumn(text, out).withColumn("restored", F.coalesce("restored", F.lit(0)).cast("long")).withColumn("unresolved", F.coalesce("unresolved", F.lit(0)).cast("long")).drop("_edits")


def resolved_tokens(tokens: DataFrame, vault: DataFrame, key: bytes, project: Column, table: str = "token_mappings", field: str = "original_value") -> DataFrame:
    """(token, original, status) for the distinct tokens: found, expired where the cipher of ``vault`` (id, token, cipher) doesn't open, or unknown."""
    met = tokens.select("token").distinct().join(vault.select("token", "id", "cipher"), "token", "left")
    opened = met.withColumn("original", decrypt(F.col("cipher"), project, table, F.col("id").cast("string"), field, key))
    return opened.select("token", "original", F.when(F.col("id").isNull(), "unknown").when(F.col("original").isNull(), "expired").otherwise("found").alias("status"))


def restore_metrics(restored: DataFrame, *by: str, started: str | None = None, completed: str | None = None) -> DataFrame:
    """Documents, those with tokens, tokens restored and unresolved, and the share restored in per cent (100 where there are none). With the columns of when a document's
    restore ``started`` and ``completed``: total_ms, slowest_ms, elapsed_ms from the first start to the last end, and unfinished, those without an end; these take no time."""
    total = F.col("restored") + F.col("unresolved")
    sums = [F.count("*").alias("documents"), F.count_if(total > 0).alias("with_tokens"), F.sum("restored").alias("restored"), F.sum("unresolved").alias("unresolved")]
    if started is not None and completed is not None:
        micros = lambda c: F.unix_micros(c.cast("timestamp"))
        apart = lambda a, b: F.round(F.greatest(micros(b) - micros(a), F.lit(0)) / 1000, 3)
        took = apart(F.col(started), F.col(completed))
        sums += [
            F.round(F.coalesce(F.sum(took), F.lit(0.0)), 3).alias("total_ms"), F.coalesce(F.max(took), F.lit(0.0)).alias("slowest_ms"),
            F.coalesce(apart(F.min(started), F.max(completed)), F.lit(0.0)).alias("elapsed_ms"), F.count_if(F.col(started).isNotNull() & F.col(completed).isNull()).alias("unfinished"),
        ]
    return restored.groupBy(*by).agg(*sums).withColumn("rate", F.round(F.when(total > 0, F.col("restored") / total * 100).otherwise(100.0), 6))


def missing_mappings(texts: DataFrame, mappings: DataFrame, key_column: str, text: str = "text") -> DataFrame:
    """(key_column, token): tokens of texts that no mapping resolves."""
    return find_tokens(texts.select(key_column, text), text).select(key_column, "token").distinct().join(mappings.select("token").distinct(), "token", "left_anti").select(key_column, "token")


def restore_check(tokens: DataFrame, mappings: DataFrame, allow_partial: bool = False, least_rate: float = 100.0, *, by: str) -> DataFrame:
    """Whether a restore may go on: totals by ``by`` over distinct tokens, the rate, is_valid and can_proceed."""
    flagged = tokens.select(by, "token").distinct().join(mappings.select("token", F.lit(1).alias("known")).distinct(), "token", "left")
    g = flagged.groupBy(by).agg(F.count("*").alias("total"), F.count("known").alias("resolved"))
    rate = F.col("resolved") / F.col("total") * 100
    full = F.col("resolved") == F.col("total")
    partial = rate >= least_rate if allow_partial else F.lit(False)
    return g.select(by, "total", "resolved", F.round(rate, 6).alias("rate"), full.alias("is_valid"), (full | partial).alias("can_proceed"))


def looks_like_token(value: Column) -> Column:
    up = F.upper(value)
    wrapped = lambda a, b: value.startswith(a) & value.endswith(b)
    return wrapped("[", "]") | wrapped("<", ">") | wrapped("{{", "}}") | up.contains("_REDACTED") | up.contains("_MASKED") | up.contains("TOKEN_")


def leaks(protected: DataFrame, original: DataFrame, key_column: str, partial: bool = True, few: int = FEW_ORIGINALS) -> DataFrame:
    """Findings in protected texts by kind of leak: RESIDUAL (an original value), INCOMPLETE (part of one, or around one), INTRODUCED (made by
    the protection) or MISSED. Both inputs: (key_column, entity_type, value); a document's originals meet as one array beside its findings. Those of a document with more
    than ``few`` are looked for in its distinct findings, and these in them, so that no finding is held against all of them."""
    own = original.select(F.col(key_column).alias("_k"), F.lower("value").alias("_o")).where("_k is not null and _o is not null").distinct()
    counts = own.groupBy("_k").agg(F.count("*").alias("_n"))
    crowded = counts.where(F.col("_n") > few).select("_k")
    v, crowds = F.lower("value"), not crowded.isEmpty()
    arrays = (own.join(crowded, "_k", "left_anti") if crowds else own).groupBy("_k").agg(F.collect_list("_o").alias("_o"))
    met = protected.join(arrays, F.col(key_column) == F.col("_k"), "left").drop("_k")
    residual = F.coalesce(F.array_contains("_o", v), F.lit(False))
    part = F.coalesce(F.exists("_o", lambda o: (o != v) & (v.contains(o) | o.contains(v))), F.lit(False)) & F.lit(partial)
    if crowds:
        flags = _crowded_leaks(protected.select(F.col(key_column).alias("_k"), v.alias("_v")).where("_v is not null").join(crowded, "_k", "left_semi").distinct(), own.join(crowded, "_k", "left_semi"), partial)
        met = met.join(flags, (F.col(key_column) == F.col("_k")) & (v == F.col("_v")), "left")
        residual, part = residual | F.coalesce("_residual", F.lit(False)), part | F.coalesce("_part", F.lit(False))
    kind = F.when(residual, "RESIDUAL").when(part, "INCOMPLETE").when(looks_like_token(F.col("value")), "INTRODUCED").otherwise("MISSED")
    return met.select(key_column, "entity_type", "value", kind.alias("leak"))


def _crowded_leaks(found: DataFrame, own: DataFrame, partial: bool) -> DataFrame:
    """(_k, _v, _residual, _part) of the distinct findings (_k, _v) that are among, within or around the many originals (_k, _o) of their documents."""
    flags = own.select("_k", F.col("_o").alias("_v"), F.lit(True).alias("_residual"), F.lit(False).alias("_part"))
    if partial:

        def within(texts: DataFrame, values: DataFrame) -> DataFrame:
            """(_k, _text, value) of values that stand in other texts of their document."""
            spot = F.struct("_k", "_text")
            met = matching.literal_matches(texts.select("_k", "_text", spot.alias("_spot")), "_spot", values.select("_k", "value"), "_text", case_sensitive=True, places=False, scope="_k")
            return met.select("_spot.*", "value").where("_text <> value")

        around = within(found.withColumnRenamed("_v", "_text"), own.withColumnRenamed("_o", "value")).select("_k", F.col("_text").alias("_v"))
        inside = within(own.withColumnRenamed("_o", "_text"), found.withColumnRenamed("_v", "value")).select("_k", F.col("value").alias("_v"))
        # an empty value is part of any other
        blank = found.where("_v = ''").unionByName(found.where("_v <> ''").join(own.where("_o = ''").select("_k"), "_k", "left_semi"))
        flags = flags.unionByName(around.unionByName(inside).unionByName(blank).select("_k", "_v", F.lit(False).alias("_residual"), F.lit(True).alias("_part")))
    return flags.groupBy("_k", "_v").agg(F.max("_residual").alias("_residual"), F.max("_part").alias("_part"))


def leak_severity(leak: Column) -> Column:
    """A value that is still there is critical, one that was missed or is there in part high, one that the protection made medium."""
    return F.when(leak == "RESIDUAL", "CRITICAL").when(leak.isin("MISSED", "INCOMPLETE"), "HIGH").when(leak == "INTRODUCED", "MEDIUM")


def rescan_severity(score: Column, strict: bool = False) -> Column:
    return F.lit("CRITICAL") if strict else F.when(score >= 0.9, "CRITICAL").when(score >= 0.7, "WARNING").otherwise("INFO")


def encrypt(value: Column, project: Column, table: str, row: Column, field: str, key: bytes, version: int = 1) -> Column:
    """AES-256-GCM with the place of the value as associated data; a version byte leads."""
    aad = F.concat_ws("|", project, F.lit(table), row, F.lit(field))
    return F.concat(F.unhex(F.lit(f"{version:02x}")), F.aes_encrypt(value.cast("binary"), F.unhex(F.lit(key.hex())), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), aad))


def decrypt(data: Column, project: Column, table: str, row: Column, field: str, key: bytes) -> Column:
    """Null where the place, the key or the data is wrong."""
    aad = F.concat_ws("|", project, F.lit(table), row, F.lit(field))
    return F.try_aes_decrypt(F.substring(data, F.lit(2), F.length(data)), F.unhex(F.lit(key.hex())), F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")
