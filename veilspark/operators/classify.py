"""Confidence bands, scan modes, statistics, filters and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

#: Fixed values: (high, medium, low) thresholds of each mode by group of entity types, and the names that lead to a group.
THRESHOLDS = {
    "strict": {
        "nik": (0.8, 0.5, 0.3),
        "npwp": (0.8, 0.5, 0.3),
        "kk": (0.8, 0.5, 0.3),
        "email": (0.85, 0.6, 0.4),
        "phone": (0.7, 0.4, 0.25),
        "person": (0.65, 0.4, 0.25),
        "organization": (0.65, 0.4, 0.25),
        "location": (0.6, 0.35, 0.2),
        "credit_card": (0.85, 0.6, 0.4),
        "iban": (0.85, 0.6, 0.4),
        "medical_record": (0.7, 0.4, 0.25),
        "default": (0.7, 0.4, 0.25),
    },
    "balanced": {
        "nik": (0.85, 0.6, 0.4),
        "npwp": (0.85, 0.6, 0.4),
        "kk": (0.85, 0.6, 0.4),
        "email": (0.9, 0.7, 0.5),
        "phone": (0.8, 0.5, 0.3),
        "person": (0.75, 0.5, 0.35),
        "organization": (0.75, 0.5, 0.35),
        "location": (0.7, 0.45, 0.3),
        "credit_card": (0.9, 0.7, 0.5),
        "iban": (0.9, 0.7, 0.5),
        "medical_record": (0.8, 0.5, 0.3),
        "default": (0.8, 0.5, 0.3),
    },
    "minimal": {
        "nik": (0.9, 0.7, 0.5),
        "npwp": (0.9, 0.7, 0.5),
        "kk": (0.9, 0.7, 0.5),
        "email": (0.95, 0.8, 0.6),
        "phone": (0.9, 0.7, 0.5),
        "person": (0.85, 0.65, 0.5),
        "organization": (0.85, 0.65, 0.5),
        "location": (0.8, 0.6, 0.45),
        "credit_card": (0.95, 0.8, 0.6),
        "iban": (0.95, 0.8, 0.6),
        "medical_record": (0.9, 0.7, 0.5),
        "default": (0.9, 0.7, 0.5),
    },
}
GROUP_OF = {
    "idnik": "nik", "nik": "nik", "idnpwp": "npwp", "npwp": "npwp", "idkk": "kk", "kk": "kk", "emailaddress": "email", "email": "email", "phonenumber": "phone", "phone": "phone",
    "idphone": "phone", "person": "person", "pername": "person", "organization": "organization", "org": "organization", "location": "location", "loc": "location", "gpe": "location",
    "creditcard": "credit_card", "creditcardnumber": "credit_card", "iban": "iban", "ibancode": "iban", "medicalrecord": "medical_record", "medicalrecordnumber": "medical_record",
}
STRICT_WORDS = ["hr", "human resource", "payroll", "salary", "medical", "patient", "health", "hospital", "financial", "bank", "account", "credit", "legal", "contract", "compliance", "customer", "client", "personal data"]
MINIMAL_WORDS = ["technical", "log", "system", "invoice", "reference", "order", "code", "programming", "config"]
SEVERITY = {
    "ID_NIK": "high", "ID_NPWP": "high", "ID_KK": "high", "ID_PHONE": "medium", "ID_BPJS": "high", "PHONE_NUMBER": "medium", "EMAIL_ADDRESS": "medium", "CREDIT_CARD": "high",
    "IBAN_CODE": "high", "IP_ADDRESS": "low", "URL": "low", "PERSON": "medium", "DATE_OF_BIRTH": "medium", "DATE": "low", "MEDICAL_RECORD": "critical", "MEDICAL_INFO": "critical",
}
LEAST_SCORE = {
    "ID_NIK": 0.7, "ID_NPWP": 0.7, "ID_KK": 0.7, "ID_PHONE": 0.6, "ID_BPJS": 0.7, "PHONE_NUMBER": 0.6, "EMAIL_ADDRESS": 0.75, "CREDIT_CARD": 0.7, "IBAN_CODE": 0.7, "IP_ADDRESS": 0.6,
    "URL": 0.6, "PERSON": 0.85, "DATE_OF_BIRTH": 0.7, "DATE": 0.8, "MEDICAL_RECORD": 0.7, "MEDICAL_INFO": 0.7,
}
SEVERITIES = ("low", "medium", "high", "critical")


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def simple_band(score: Column, high: float, medium: float) -> Column:
    """The two fixed scales: (0.9, 0.7) for raw results, (0.85, 0.6) for unified findings."""
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def band(entity: Column, score: Column, mode: str = "balanced") -> Column:
    """HIGH, MEDIUM, LOW, or null below the lowest threshold of the entity's group."""
    group = F.coalesce(F.try_element_at(_map(GROUP_OF), F.regexp_replace(F.lower(entity), "[_-]", "")), F.lit("default"))
    of = lambda i: F.element_at(_map({g: t[i] for g, t in THRESHOLDS[mode].items()}), group)
    return F.when(score < of(2), None).when(score >= of(0), "HIGH").when(score >= of(1), "MEDIUM").otherwise("LOW")


def classify(df: DataFrame, mode: str = "balanced", include_low: bool = True) -> DataFrame:
    out = df.withColumn("band", band(F.col("entity_type"), F.col("score"), mode)).where("band is not null")
    return out if include_low else out.where("band <> 'LOW'")


def compare_modes(df: DataFrame) -> DataFrame:
    """How many findings each mode keeps; the minimal one leaves LOW out."""
    kept = {m: band(F.col("entity_type"), F.col("score"), m) for m in THRESHOLDS}
    n = df.agg(
        F.count_if(kept["strict"].isNotNull()).alias("strict_count"), F.count_if(kept["balanced"].isNotNull()).alias("balanced_count"), F.count_if(kept["minimal"].isin("HIGH", "MEDIUM")).alias("minimal_count")
    )
    return n.select("*", (F.col("strict_count") - F.col("balanced_count")).alias("strict_only"), (F.col("balanced_count") - F.col("minimal_count")).alias("minimal_excluded"))


def recommend_mode(document_type: Column) -> Column:
    low = F.lower(document_type)
    some = lambda words: low.rlike("|".join(words))
    return F.when(document_type.isNull(), "balanced").when(some(STRICT_WORDS), "strict").when(some(MINIMAL_WORDS), "minimal").otherwise("balanced")


def statistics(df: DataFrame, *by: str) -> DataFrame:
    """Counts by band, average, least and greatest score; findings without a band count as unclassified; HIGH and MEDIUM are protectable."""
    n = lambda b: F.count_if(F.col("band") == b)
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"), F.count_if(F.col("band").isNull()).alias("unclassified"),
        F.round(F.avg("score"), 6).alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.count_if(F.col("band").isin("HIGH", "MEDIUM")).alias("protectable"),
    )


def running_statistics(df: DataFrame, segment: str) -> DataFrame:
    """Findings, characters and segments met so far by type and raw band."""
    f = df.withColumn("band", simple_band(F.col("score"), 0.9, 0.7))
    return f.groupBy("entity_type", "band").agg(F.count("*").alias("findings"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("characters"), F.countDistinct(segment).alias("segments"))


def plan_counters(planned: DataFrame, *by: str) -> DataFrame:
    """What a plan (treatment) does: findings, those to treat, tokens and those kept."""
    t = F.col("treatment")
    return planned.groupBy(*by).agg(F.count("*").alias("findings"), F.count_if(t != "KEEP").alias("to_treat"), F.count_if(t == "TOKEN").alias("tokens"), F.count_if(t == "KEEP").alias("kept"))


def value_groups(df: DataFrame, file: str) -> DataFrame:
    """Findings of one value and type as a group: how many, in how many files, and whether in one only."""
    g = df.groupBy(F.sha2(F.col("value").cast("binary"), 256).alias("value_hash"), "entity_type").agg(F.count("*").alias("findings"), F.countDistinct(file).alias("files"))
    return g.withColumn("same_file", F.col("files") == 1)


def entity_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "entity_type").agg(F.count("*").alias("findings"))


def matching(df: DataFrame, bands=None, types=None, not_types=None, least=None, most=None, recognizers=None, where: Column | None = None) -> DataFrame:
    """Findings that meet every criterion given; ``where`` is a condition of the caller's own."""
    for column, allowed in (("band", bands), ("entity_type", types), ("recognizer", recognizers)):
        df = df.where(F.col(column).isin(list(allowed))) if allowed else df
    df = df.where(~F.col("entity_type").isin(list(not_types))) if not_types else df
    df = df.where(F.col("score") >= least) if least is not None else df
    df = df.where(F.col("score") <= most) if most is not None else df
    return df.where(where) if where is not None else df


def admitted(df: DataFrame, types: list[str], least: float, allow_patterns: list[str]) -> DataFrame:
    """Enabled types of enough score whose value no allow pattern matches."""
    out = df.where(F.col("entity_type").isin(types) & (F.col("score") >= least))
    for p in allow_patterns:
        out = out.where(~F.col("value").rlike(p))
    return out


def without_denied(df: DataFrame, terms: DataFrame, value: str = "value") -> DataFrame:
    """Drops findings whose collapsed value is a term, or has several tokens of which each is a term. ``terms``: (term), collapsed.

    The distinct values are judged, each once, and what is denied is joined back, so no row needs a number of its own.
    """
    values = df.select(collapse(F.col(value)).alias("_v")).where("_v is not null").distinct()
    t = terms.select(F.col("term").alias("_term")).distinct()
    whole = values.join(t, F.col("_v") == F.col("_term"), "left_semi")
    # only values of several tokens are taken apart
    tokens = F.filter(F.split("_v", r"(?U)[\s\-]+"), lambda x: x != "")
    several = values.select("_v", F.array_distinct(tokens).alias("t"), F.size(tokens).alias("n")).where("n > 1")
    each = several.select("_v", F.size("t").alias("k"), F.explode("t").alias("_t")).join(t, F.col("_t") == F.col("_term")).groupBy("_v", "k").agg(F.count("*").alias("hit")).where("hit = k")
    denied = whole.unionByName(each.select("_v")).distinct().withColumnRenamed("_v", "_denied")
    return df.join(denied, collapse(F.col(value)) == F.col("_denied"), "left_anti")


def without_allowed(df: DataFrame, allowed: DataFrame, value: str = "value") -> DataFrame:
    """Drops findings whose value is in the list, whatever the case."""
    return df.join(allowed.select(F.lower("term").alias("_term")).distinct(), F.lower(F.col(value)) == F.col("_term"), "left_anti")


def severity(entity: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(SEVERITY), entity), F.lit("medium"))


def passes_policy(entity: Column, score: Column) -> Column:
    return score >= F.coalesce(F.try_element_at(_map(LEAST_SCORE), entity), F.lit(0.8))


def risk(df: DataFrame, *by: str) -> DataFrame:
    """The greatest severity of a group; two or more of MEDIUM and none above make HIGH. ``df`` has a column severity."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")) - 1
    rank = F.when(rank < 0, 1).otherwise(rank)
    g = df.groupBy(*by).agg(F.max(rank).alias("_max"), F.count_if(rank >= 1).alias("_n"), F.count("*").alias("findings"))
    level = F.when((F.col("_max") == 1) & (F.col("_n") >= 2), 2).otherwise(F.col("_max"))
    return g.select(*by, "findings", F.upper(F.element_at(F.array(*map(F.lit, SEVERITIES)), (level + 1).cast("int"))).alias("risk"))
