"""Column profiling, the operation history, and evaluation against gold spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from . import recognizers as r
from .intervals import islands

#: Header keywords in order, and words that make a header a plain one.
HEADER_TYPES = {
    "nama": "PERSON", "name": "PERSON", "pasien": "PERSON", "patient": "PERSON", "karyawan": "PERSON", "employee": "PERSON", "pegawai": "PERSON", "nik": "ID_NIK", "ktp": "ID_NIK", "identitas": "ID_NIK", "npwp": "ID_NPWP",
    "pajak": "ID_NPWP", "tax": "ID_NPWP", "kk": "ID_KK", "kartu keluarga": "ID_KK", "bpjs": "ID_BPJS", "jkn": "ID_BPJS", "hp": "ID_PHONE", "handphone": "ID_PHONE", "telepon": "PHONE_NUMBER", "telp": "PHONE_NUMBER",
    "phone": "PHONE_NUMBER", "mobile": "PHONE_NUMBER", "kontak": "PHONE_NUMBER", "contact": "PHONE_NUMBER", "email": "EMAIL_ADDRESS", "e-mail": "EMAIL_ADDRESS", "surel": "EMAIL_ADDRESS", "alamat": "ADDRESS", "address": "ADDRESS",
    "jalan": "ADDRESS", "jl.": "ADDRESS", "rekening": "BANK_ACCOUNT", "account": "BANK_ACCOUNT", "bank": "BANK_ACCOUNT", "kartu kredit": "CREDIT_CARD", "credit card": "CREDIT_CARD", "cc": "CREDIT_CARD",
    "tanggal lahir": "DATE_OF_BIRTH", "tgl lahir": "DATE_OF_BIRTH", "birth": "DATE_OF_BIRTH", "dob": "DATE_OF_BIRTH", "medical": "MEDICAL_RECORD", "medis": "MEDICAL_RECORD", "emr": "MEDICAL_RECORD", "rm": "MEDICAL_RECORD",
    "rekam medis": "MEDICAL_RECORD", "diagnosis": "MEDICAL_INFO", "diagnosa": "MEDICAL_INFO", "obat": "MEDICAL_INFO", "resep": "MEDICAL_INFO",
}
PLAIN_HEADERS = [
    "status", "jenis", "tipe", "type", "kategori", "category", "golongan", "kode", "code", "klasifikasi", "persetujuan", "consent", "kota", "kabupaten", "provinsi", "fasilitas", "penjamin",
]
ID_WORDS = ["id", "no.", "no ", "nomor", "number"]
NARRATIVE_LENGTH, NARRATIVE_TOKENS, MAJORITY = 50, 8, 0.6


def header_type(header: Column) -> Column:
    low = F.lower(F.trim(header))
    plain = F.split(low, r"\s+")[0].isin(PLAIN_HEADERS)
    is_id = F.lit(False)
    for w in ID_WORDS:
        is_id = is_id | low.contains(w)
    out = F.when(header.isNull() | (low == "") | plain, None)
    for word, entity in HEADER_TYPES.items():
        out = out.when(low.contains(word), F.when(~is_id, entity) if entity == "PERSON" else F.lit(entity))
    return out


def cells(df: DataFrame) -> DataFrame:
    """(column_name, value): every cell as text."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])).alias("c")).select("c.*")


def cell_type(value: Column) -> Column:
    """The first kind of value that a cell looks like."""
    v = F.trim(value)
    nik = v.rlike(r.SIXTEEN) & (r.nik_score(F.regexp_replace(F.regexp_extract(v, r.SIXTEEN, 0), r"\D", "")) > 0)
    npwp = (v.rlike(r.NPWP_OLD) & F.substring(F.regexp_replace(F.regexp_extract(v, r.NPWP_OLD, 0), r"\D", ""), 1, 2).isin(r.SUBJECTS)) | v.rlike(r.NPWP_NEW)
    phone = F.lit(False)
    for p in r.MOBILE:
        n = r.local_phone(F.regexp_extract(v, p.regex, 0))
        phone = phone | (v.rlike(p.regex) & (F.substring(n, 1, 4).isin(r.CARRIERS) | (F.lit(p.score - 0.2) > 0.5)) & F.length(n).between(10, 13))
    mail = v.rlike(r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")
    date = v.rlike(r"\b\d{1,2}[-/][A-Za-z0-9]{1,9}[-/]\d{2,4}\b|\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b")
    return F.when(nik, "ID_NIK").when(npwp, "ID_NPWP").when(phone, "ID_PHONE").when(mail, "EMAIL_ADDRESS").when(date, "DATE")


def content_types(cell_rows: DataFrame) -> DataFrame:
    """(column_name, content_type): the type of most cells, if it covers six tenths of those that aren't blank."""
    full = cell_rows.where(F.trim("value") != "").withColumn("kind", cell_type(F.col("value")))
    counts = full.groupBy("column_name", "kind").agg(F.count("*").alias("n"))
    g = counts.groupBy("column_name").agg(F.sum("n").alias("cells"), F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))).alias("top"))
    return g.select("column_name", "cells", F.when(F.col("top.n") / F.col("cells") >= MAJORITY, F.col("top.kind")).alias("content_type"))


def narrative(cell_rows: DataFrame) -> DataFrame:
    """(column_name, cells, avg_length, avg_tokens, is_narrative): long free text, or JSON for the most part."""
    v = F.trim("value")
    json = v.rlike(r"^[{\[]") & F.try_parse_json(v).isNotNull()
    full = cell_rows.where(v != "")
    g = full.groupBy("column_name").agg(F.count("*").alias("cells"), F.avg(F.length(v)).alias("avg_length"), F.avg(F.size(F.split(v, r"(?U)\s+"))).alias("avg_tokens"), (F.count_if(json) / F.count("*")).alias("_json"))
    long = (F.col("avg_length") >= NARRATIVE_LENGTH) & (F.col("avg_tokens") >= NARRATIVE_TOKENS)
    return g.select("column_name", "cells", F.round("avg_length", 6).alias("avg_length"), F.round("avg_tokens", 6).alias("avg_tokens"), (long | (F.col("_json") >= MAJORITY)).alias("is_narrative"))


def profile(df: DataFrame) -> DataFrame:
    """Per column: the type by header, by content, the suggestion, and whether whole cells or only findings inside are protected."""
    rows = cells(df)
    joined = content_types(rows).join(narrative(rows).drop("cells"), "column_name", "left").withColumn("header_type", header_type(F.col("column_name")))
    suggested = F.coalesce("header_type", "content_type", F.when(F.col("is_narrative"), "TEKS_NARASI"))
    return joined.select("column_name", "cells", "header_type", "content_type", "is_narrative", suggested.alias("suggested_type"), F.when(F.col("is_narrative"), "pii_only").otherwise("full_cell").alias("mode"))


def events(history: DataFrame, project: str, who, types: list[str] | None = None, since: str | None = None, until: str | None = None, limit: int = 100, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The newest events of a project."""
    out = history.where(F.col(project) == who)
    out = out.where(F.col("event_type").isin(types)) if types else out
    out = out.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else out
    out = out.where(F.col("ts") <= F.lit(until).cast("timestamp")) if until else out
    return out.orderBy(*[F.desc(c) for c in order]).limit(limit)


def summary(history: DataFrame, project: str, kinds: list[str], amount: str) -> DataFrame:
    """Per project: number, first and last, a sum, and counts by kind of event."""
    return history.groupBy(project).agg(F.count("*").alias("total"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.round(F.sum(amount), 4).alias("amount"), *[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds])


def kept_after(history: DataFrame, now: str, days: int) -> DataFrame:
    """History without what is older than ``days``."""
    return history.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


#: Names of one type in predictions and annotations.
SAME_TYPE = {
    "PERSON_NAME": "PERSON", "PER": "PERSON", "PHONE_NUMBER": "ID_PHONE", "PHONE": "ID_PHONE", "EMAIL": "EMAIL_ADDRESS", "NIK": "ID_NIK", "NPWP": "ID_NPWP", "KK": "ID_KK", "BPJS": "ID_BPJS",
}


def compared_type(entity: Column) -> Column:
    """The name under which an entity type is compared, whatever its case."""
    known = F.create_map(*[F.lit(x) for kv in SAME_TYPE.items() for x in kv])
    return bound(F.upper(entity), lambda e: F.coalesce(F.try_element_at(known, e), e))


def matched(predictions: DataFrame, gold: DataFrame, key: str, mode: str = "exact", share: float = 0.5) -> DataFrame:
    """(doc_type, entity_type, tp, fp, fn) for each run of spans that lie together. Spans of one text and type match if equal (exact), overlapping (overlap), overlapping by
    ``share`` of the shorter (partial) or if the prediction lies within the annotation (contained); predictions take gold spans in order, each gold span once.

    Only spans of one island, linked by touching or overlapping spans of either table, can match, so each island is matched by itself.
    """
    group = [key, "doc_type", "entity_type"]
    side = lambda df, is_gold: df.select(*group, "start_pos", "end_pos").distinct().withColumn("_gold", F.lit(is_gold))
    all_ = islands(side(predictions, False).unionByName(side(gold, True)), group, "_island", touching=True)
    spans = lambda is_gold: F.array_sort(F.collect_list(F.when(F.col("_gold") == is_gold, F.struct("start_pos", "end_pos"))))
    both = all_.groupBy(*group, "_island").agg(spans(False).alias("p"), spans(True).alias("g"))
    shared = lambda a, b: F.least(a["end_pos"], b["end_pos"]) - F.greatest(a["start_pos"], b["start_pos"])
    short = lambda a, b: F.least(a["end_pos"] - a["start_pos"], b["end_pos"] - b["start_pos"])
    fits = {
        "exact": lambda a, b: (a["start_pos"] == b["start_pos"]) & (a["end_pos"] == b["end_pos"]), "overlap": lambda a, b: shared(a, b) > 0,
        "partial": lambda a, b: (short(a, b) > 0) & (F.greatest(shared(a, b), F.lit(0)) >= share * short(a, b)),
        "contained": lambda a, b: (a["start_pos"] >= b["start_pos"]) & (a["end_pos"] <= b["end_pos"]),
    }[mode]

    def take(free: Column, x: Column) -> Column:
        """Without the first free gold span that ``x`` matches."""
        hit = F.get(F.filter(free, lambda y: fits(x, y)), F.lit(0))
        return F.when(hit.isNull(), free).otherwise(F.filter(free, lambda y: y != hit))

    counted = both.select("doc_type", "entity_type", F.size("p").alias("_p"), F.size("g").alias("_g"), F.size(F.aggregate("p", F.col("g"), take)).alias("fn"))
    return counted.select("doc_type", "entity_type", (F.col("_g") - F.col("fn")).cast("long").alias("tp"), (F.col("_p") - F.col("_g") + F.col("fn")).cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"))


def scores(outcomes: DataFrame) -> DataFrame:
    """Precision, recall and F1 by type, by document type and type, and over all."""
    grouped = outcomes.groupingSets([[F.col("entity_type")], [F.col("doc_type"), F.col("entity_type")], []], "doc_type", "entity_type")
    g = grouped.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    g = g.withColumn("precision", part(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", part(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return g.select("doc_type", "entity_type", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def gates(by_type: DataFrame, least: dict[str, float]) -> DataFrame:
    """Whether each type reaches its least F1."""
    need = F.create_map(*[F.lit(v) for kv in least.items() for v in kv])
    out = by_type.where(F.col("entity_type").isin(list(least)))
    return out.select("entity_type", "f1", F.element_at(need, F.col("entity_type")).alias("least_f1"), (F.col("f1") >= F.element_at(need, F.col("entity_type"))).alias("passed"))


def latched_breaker(failures: DataFrame, source: str, limit: int = 3, seconds: int = 60) -> DataFrame:
    """Failures (source, ts) with the number within the window and whether the breaker is open from there on."""
    t = F.col("ts").cast("timestamp").cast("double")
    inside = Window.partitionBy(source).orderBy(t).rangeBetween(-seconds, 0)
    run = Window.partitionBy(source).orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return failures.withColumn("recent", F.count("*").over(inside)).withColumn("open", F.max((F.col("recent") >= limit).cast("int")).over(run) == 1)


#: Keywords of the headers of delimited files, in order, and types that a column's header decides by itself.
CSV_TYPES = {
    "nama": "PERSON", "name": "PERSON", "email": "EMAIL", "e-mail": "EMAIL", "phone": "PHONE_NUMBER", "telepon": "PHONE_NUMBER", "telp": "PHONE_NUMBER", "hp": "PHONE_NUMBER", "handphone": "PHONE_NUMBER",
    "nik": "ID_NIK", "ktp": "ID_NIK", "npwp": "ID_NPWP", "kk": "ID_KK", "alamat": "ADDRESS", "address": "ADDRESS", "rekam medis": "MEDICAL_RECORD", "medical record": "MEDICAL_RECORD", "mrn": "MEDICAL_RECORD",
    "no rm": "MEDICAL_RECORD", "norm": "MEDICAL_RECORD", "tanggal lahir": "DATE_OF_BIRTH", "tgl lahir": "DATE_OF_BIRTH", "dob": "DATE_OF_BIRTH", "birth": "DATE_OF_BIRTH",
}
DIRECT_TYPES = ["PERSON", "ADDRESS", "MEDICAL_RECORD", "MEDICAL_INFO", "DATE_OF_BIRTH"]


def csv_type(header: Column, given: dict[str, str] | None = None) -> Column:
    """The entity type of a column of a delimited file: what is given for the name, else the first keyword in it, else PII."""
    low = F.lower(header)
    out = F.when(F.lit(False), "")
    for name, kind in (given or {}).items():
        out = out.when(header == name, kind) if kind != "PII" else out
    for word, kind in CSV_TYPES.items():
        out = out.when(low.contains(word), kind)
    return out.otherwise("PII")


def scan_columns(cells_: DataFrame, as_of: str, value: str = "value") -> DataFrame:
    """Findings of cells (..., suggested_type, mode, value): a type that decides by itself takes the whole cell (0.95); else the cell is searched, and where nothing is found
    the suggested type takes it (0.8). In the mode pii_only no type is suggested."""
    from .recognizers import NONE, found_by, rows_of

    text = F.col(value)
    suggested = F.when(F.col("mode") != "pii_only", F.col("suggested_type"))
    whole = lambda score: F.array(F.struct(suggested.alias("entity_type"), F.lit(0).cast("long").alias("start_pos"), F.length(text).cast("long").alias("end_pos"), text.alias("value"), F.lit(score).alias("score"), F.lit("column").alias("recognizer")))
    from ..functions.text import bound

    searched = bound(found_by(text, as_of), lambda found: F.when(F.size(found) > 0, found).when(suggested.isNotNull(), whole(0.8)).otherwise(F.array().cast(NONE)))
    return rows_of(cells_.where(text.isNotNull()), value, F.when(suggested.isin(DIRECT_TYPES), whole(0.95)).otherwise(searched))


def corpus(keys: DataFrame, key: str = "id") -> DataFrame:
    """A labelled text for every key, made from the key alone: (id, doc_type, text, entity_type, start_pos, end_pos), one annotated number or address each."""
    from .recognizers import CARRIERS, PROVINCES

    h = lambda salt, n: F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(n))
    digits = lambda salt, n: F.lpad(h(salt, 10**n).cast("string"), n, "0")
    pick = lambda salt, words: F.element_at(F.array(*map(F.lit, words)), (h(salt, len(words)) + 1).cast("int"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    born = F.concat(two(h("day", 28) + 1 + 40 * h("sex", 2)), two(h("month", 12) + 1), two(h("year", 60) + 40))
    person = F.concat(pick("province", PROVINCES), digits("city", 2), digits("district", 2))
    kinds = [("hr", "ID_NIK", "NIK: ", F.concat(person, born, digits("seq", 4))), ("payroll", "ID_NPWP", "NPWP ", F.concat(pick("tax", ["01", "02", "09", "21"]), F.lit("."), digits("a", 3), F.lit("."), digits("b", 3), F.lit("."), digits("c", 1), F.lit("-"), digits("d", 3), F.lit(".000"))),
             ("customer", "ID_PHONE", "hp ", F.concat(pick("carrier", CARRIERS), digits("p", 7))), ("medical", "ID_BPJS", "No. BPJS ", F.concat(F.lit("000"), digits("e", 10))), ("banking", "EMAIL_ADDRESS", "surel ", F.concat(F.lit("u"), digits("u", 6), F.lit("@contoh.id")))]
    no = h("kind", len(kinds))
    of = lambda i: F.element_at(F.array(*[k[i] if i == 3 else F.lit(k[i]) for k in kinds]), (no + 1).cast("int"))
    made = keys.select(F.col(key).alias("id"), of(0).alias("doc_type"), of(1).alias("entity_type"), of(2).alias("_before"), of(3).alias("value"))
    text = F.concat("_before", "value", F.lit(" tercatat"))
    return made.select("id", "doc_type", text.alias("text"), "entity_type", F.length("_before").cast("long").alias("start_pos"), (F.length("_before") + F.length("value")).cast("long").alias("end_pos"), "value")
