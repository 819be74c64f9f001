"""Scores adjusted by context: labels, keywords around, the segment's place, and the kind of document.

A segment is a row with text, heading, key_label, slide_title, file_id, sheet, cell (strings, null where there is none) and table_headers, row_headers,
nearby_labels (arrays of strings, null counts as empty). Everything is an expression over that row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from . import classify

#: Entity types that a label asks for, and what agreement and contradiction are worth.
LABEL_ENTITIES = {
    "nik": ["ID_NIK"], "nomor induk kependudukan": ["ID_NIK"], "no. ktp": ["ID_NIK"], "no ktp": ["ID_NIK"], "ktp": ["ID_NIK"], "nama": ["PERSON"], "nama lengkap": ["PERSON"], "nama pasien": ["PERSON"],
    "nama karyawan": ["PERSON"], "alamat": ["ADDRESS", "LOCATION"], "alamat rumah": ["ADDRESS"], "alamat kantor": ["ADDRESS"], "telepon": ["ID_PHONE", "PHONE_NUMBER"], "telp": ["ID_PHONE", "PHONE_NUMBER"],
    "no. telp": ["ID_PHONE", "PHONE_NUMBER"], "no telp": ["ID_PHONE", "PHONE_NUMBER"], "hp": ["ID_PHONE", "PHONE_NUMBER"], "handphone": ["ID_PHONE", "PHONE_NUMBER"], "email": ["EMAIL_ADDRESS"],
    "e-mail": ["EMAIL_ADDRESS"], "npwp": ["ID_NPWP"], "no. npwp": ["ID_NPWP"], "kk": ["ID_KK"], "no. kk": ["ID_KK"], "nomor kartu keluarga": ["ID_KK"], "tanggal lahir": ["DATE_OF_BIRTH", "DATE"],
    "tgl lahir": ["DATE_OF_BIRTH", "DATE"], "tempat lahir": ["LOCATION"], "rekening": ["BANK_ACCOUNT"], "no. rekening": ["BANK_ACCOUNT"], "nomor rekening": ["BANK_ACCOUNT"], "name": ["PERSON"],
    "full name": ["PERSON"], "patient name": ["PERSON"], "employee name": ["PERSON"], "address": ["ADDRESS", "LOCATION"], "phone": ["PHONE_NUMBER"], "mobile": ["PHONE_NUMBER"], "dob": ["DATE_OF_BIRTH"],
    "date of birth": ["DATE_OF_BIRTH"], "ssn": ["US_SSN"], "social security": ["US_SSN"], "credit card": ["CREDIT_CARD"], "card number": ["CREDIT_CARD"],
}
MATCH_BOOST, MISMATCH_PENALTY = 0.15, 0.1

#: Keywords that speak for and against personal data, and for one entity type, with their weights.
POSITIVE = {
    "nama": 0.3, "nama lengkap": 0.4, "nama pasien": 0.5, "nama karyawan": 0.5, "nama nasabah": 0.5, "nama pelanggan": 0.5, "nama pemilik": 0.4, "nama penumpang": 0.5, "nama tertanggung": 0.5, "name": 0.3,
    "full name": 0.4, "patient name": 0.5, "employee name": 0.5, "customer name": 0.5, "client name": 0.5, "passenger name": 0.5, "nik": 0.5, "no. nik": 0.5, "nomor nik": 0.5, "nomor induk kependudukan": 0.5,
    "ktp": 0.5, "no. ktp": 0.5, "kartu tanda penduduk": 0.5, "npwp": 0.5, "no. npwp": 0.5, "nomor pokok wajib pajak": 0.5, "kk": 0.4, "no. kk": 0.5, "kartu keluarga": 0.5, "bpjs": 0.5, "no. bpjs": 0.5,
    "sim": 0.4, "no. sim": 0.5, "surat izin mengemudi": 0.5, "paspor": 0.5, "no. paspor": 0.5, "passport": 0.5, "id number": 0.4, "national id": 0.5, "tax id": 0.5, "ssn": 0.5, "social security": 0.5,
    "telepon": 0.4, "no. telepon": 0.5, "nomor telepon": 0.5, "hp": 0.4, "no. hp": 0.5, "handphone": 0.4, "whatsapp": 0.4, "wa": 0.3, "phone": 0.4, "phone number": 0.5, "mobile": 0.4, "cell": 0.4,
    "contact": 0.3, "contact number": 0.4, "email": 0.4, "e-mail": 0.4, "alamat email": 0.5, "email address": 0.5, "alamat": 0.4, "alamat lengkap": 0.5, "alamat rumah": 0.5, "alamat kantor": 0.4,
    "alamat tinggal": 0.5, "domisili": 0.4, "address": 0.4, "home address": 0.5, "mailing address": 0.5, "residential address": 0.5, "rekening": 0.5, "no. rekening": 0.5, "nomor rekening": 0.5,
    "kartu kredit": 0.5, "no. kartu kredit": 0.5, "account": 0.3, "account number": 0.5, "bank account": 0.5, "credit card": 0.5, "card number": 0.5, "tanggal lahir": 0.4, "tgl lahir": 0.4, "ttl": 0.3,
    "tempat tanggal lahir": 0.4, "date of birth": 0.4, "dob": 0.4, "birth date": 0.4, "pasien": 0.4, "no. rm": 0.5, "nomor rekam medis": 0.5, "medical record": 0.5, "patient id": 0.5, "diagnosa": 0.3,
    "diagnosis": 0.3, "karyawan": 0.4, "nip": 0.5, "nik karyawan": 0.5, "employee id": 0.5, "staff id": 0.5, "gaji": 0.4, "salary": 0.4, "pribadi": 0.3, "rahasia": 0.3, "confidential": 0.3, "private": 0.3,
    "personal": 0.3, "data diri": 0.4,
}
NEGATIVE = {
    "invoice": 0.4, "invoice number": 0.5, "no. invoice": 0.5, "faktur": 0.4, "no. faktur": 0.5, "order": 0.3, "order id": 0.5, "order number": 0.5, "no. order": 0.5, "po number": 0.5, "purchase order": 0.4,
    "sku": 0.5, "kode barang": 0.4, "kode produk": 0.4, "product code": 0.5, "item code": 0.5, "serial number": 0.5, "serial no": 0.5, "no. seri": 0.5, "barcode": 0.5, "reference": 0.4,
    "reference number": 0.5, "ref": 0.3, "ref no": 0.4, "no. ref": 0.4, "document number": 0.4, "no. dokumen": 0.4, "file number": 0.4, "case number": 0.4, "ticket": 0.4, "ticket number": 0.5,
    "transaction": 0.4, "transaction id": 0.5, "transaksi": 0.4, "no. transaksi": 0.5, "receipt": 0.4, "receipt number": 0.5, "version": 0.4, "versi": 0.4, "batch": 0.4, "batch number": 0.5, "lot": 0.4,
    "lot number": 0.5, "pt": 0.3, "cv": 0.3, "perusahaan": 0.3, "company": 0.3, "vendor": 0.3, "supplier": 0.3, "id": 0.2, "code": 0.2, "kode": 0.2, "nomor urut": 0.4, "sequence": 0.4, "index": 0.4,
}
ENTITY_WORDS = {
    "ID_NIK": {"nik": 0.5, "nomor induk kependudukan": 0.5, "ktp": 0.4, "kartu tanda penduduk": 0.5},
    "ID_NPWP": {"npwp": 0.5, "nomor pokok wajib pajak": 0.5, "tax id": 0.4, "pajak": 0.3},
    "ID_KK": {"kk": 0.4, "kartu keluarga": 0.5, "no. kk": 0.5},
    "ID_BPJS": {"bpjs": 0.5, "bpjs kesehatan": 0.5, "bpjs ketenagakerjaan": 0.5, "jkn": 0.4},
    "ID_SIM": {"sim": 0.4, "surat izin mengemudi": 0.5, "sim a": 0.5, "sim b": 0.5, "sim c": 0.5, "driving license": 0.4},
    "ID_PASSPORT": {"passport": 0.5, "paspor": 0.5, "no. paspor": 0.5, "travel document": 0.4},
    "ID_PHONE": {"telepon": 0.4, "no. telepon": 0.5, "hp": 0.4, "handphone": 0.4, "whatsapp": 0.4, "phone": 0.4, "mobile": 0.4},
    "PERSON": {"nama": 0.3, "nama lengkap": 0.4, "name": 0.3, "full name": 0.4},
    "EMAIL_ADDRESS": {"email": 0.5, "e-mail": 0.5, "alamat email": 0.5},
    "LOCATION": {"alamat": 0.4, "address": 0.4, "domisili": 0.4},
    "DATE_TIME": {"tanggal lahir": 0.4, "tgl lahir": 0.4, "date of birth": 0.4, "dob": 0.4},
    "CREDIT_CARD": {"kartu kredit": 0.5, "credit card": 0.5, "card number": 0.4},
    "IBAN_CODE": {"rekening": 0.4, "account number": 0.4, "bank account": 0.4},
}

#: Kinds of structure in the order of their priority, with their weights.
STRUCTURE = {"key_label": 0.4, "table_header": 0.35, "row_header": 0.3, "document_heading": 0.25, "section_title": 0.25, "nearby_label": 0.2, "cell_position": 0.1}

#: Keywords of the document types, in order, their sensitivity, and the entity types that they lead to expect.
DOCUMENT_WORDS = {
    "hr": {
        "karyawan": 0.3, "pegawai": 0.3, "data karyawan": 0.5, "daftar karyawan": 0.5, "sdm": 0.4, "sumber daya manusia": 0.5, "hrd": 0.5, "human resources": 0.5, "rekrutmen": 0.4, "recruitment": 0.4, "cv": 0.3,
        "curriculum vitae": 0.4, "resume": 0.4, "lamaran": 0.4, "pelamar": 0.4, "kandidat": 0.4, "employee data": 0.5, "staff list": 0.5, "personnel": 0.4, "workforce": 0.3, "headcount": 0.4, "onboarding": 0.4,
        "offboarding": 0.4,
    },
    "medical": {
        "pasien": 0.5, "data pasien": 0.6, "rekam medis": 0.6, "medical record": 0.6, "rm": 0.3, "no. rm": 0.5, "diagnosa": 0.5, "diagnosis": 0.5, "resep": 0.4, "prescription": 0.4, "rawat inap": 0.5,
        "rawat jalan": 0.5, "poliklinik": 0.5, "rumah sakit": 0.5, "rs": 0.3, "klinik": 0.4, "dokter": 0.3, "perawat": 0.3, "bpjs kesehatan": 0.5, "patient": 0.5, "patient data": 0.6, "medical": 0.4,
        "hospital": 0.4, "clinic": 0.4, "healthcare": 0.4, "treatment": 0.3, "medication": 0.4, "lab result": 0.5,
    },
    "financial": {
        "rekening": 0.4, "nomor rekening": 0.5, "bank": 0.3, "perbankan": 0.4, "mutasi": 0.4, "saldo": 0.4, "transfer": 0.3, "transaksi": 0.3, "kredit": 0.3, "debit": 0.3, "kartu kredit": 0.5, "pinjaman": 0.4,
        "loan": 0.4, "investasi": 0.3, "investment": 0.3, "account number": 0.5, "bank account": 0.5, "banking": 0.4, "financial": 0.3, "credit card": 0.5, "statement": 0.3, "balance": 0.3, "transaction": 0.3,
    },
    "legal": {
        "perjanjian": 0.5, "kontrak": 0.5, "contract": 0.5, "agreement": 0.5, "hukum": 0.4, "legal": 0.4, "pengadilan": 0.5, "court": 0.5, "gugatan": 0.5, "litigation": 0.5, "kuasa hukum": 0.5, "notaris": 0.5,
        "notary": 0.5, "akta": 0.4, "deed": 0.4, "surat kuasa": 0.5, "power of attorney": 0.5, "legal document": 0.5, "attorney": 0.4, "plaintiff": 0.5, "defendant": 0.5, "confidential": 0.3,
    },
    "customer": {
        "pelanggan": 0.4, "nasabah": 0.4, "customer": 0.4, "client": 0.4, "data pelanggan": 0.5, "daftar pelanggan": 0.5, "customer list": 0.5, "crm": 0.5, "member": 0.3, "membership": 0.4, "subscriber": 0.4,
        "pengguna": 0.3, "user": 0.3, "customer data": 0.5, "client list": 0.5, "contact list": 0.4, "mailing list": 0.4,
    },
    "payroll": {
        "gaji": 0.5, "salary": 0.5, "payroll": 0.6, "slip gaji": 0.6, "tunjangan": 0.5, "allowance": 0.4, "bonus": 0.4, "kompensasi": 0.5, "compensation": 0.5, "pph 21": 0.5, "pajak penghasilan": 0.5,
        "income tax": 0.4, "bpjs ketenagakerjaan": 0.5, "jamsostek": 0.5, "payslip": 0.6, "wage": 0.4, "remuneration": 0.5,
    },
    "insurance": {
        "asuransi": 0.5, "insurance": 0.5, "polis": 0.5, "policy": 0.4, "premi": 0.5, "premium": 0.4, "klaim": 0.4, "claim": 0.4, "tertanggung": 0.5, "insured": 0.5, "penerima manfaat": 0.5, "beneficiary": 0.5,
        "underwriting": 0.5, "insurance policy": 0.6, "coverage": 0.4,
    },
    "invoice": {
        "invoice": 0.5, "faktur": 0.5, "tagihan": 0.4, "billing": 0.4, "pembayaran": 0.3, "payment": 0.3, "po": 0.3, "purchase order": 0.4, "quotation": 0.4, "penawaran": 0.4, "kwitansi": 0.4, "receipt": 0.4,
        "bill": 0.3, "order": 0.2,
    },
    "corporate": {
        "presentasi": 0.3, "presentation": 0.3, "perusahaan": 0.2, "company": 0.2, "corporate": 0.3, "pt": 0.2, "cv": 0.2, "manajemen": 0.3, "management": 0.3, "strategi": 0.3, "strategy": 0.3,
        "annual report": 0.4, "laporan tahunan": 0.4, "board": 0.3, "shareholders": 0.4, "stakeholder": 0.3,
    },
}
SENSITIVITY = {"hr": "high", "medical": "critical", "financial": "high", "legal": "high", "customer": "high", "payroll": "high", "insurance": "high", "invoice": "low", "corporate": "medium", "general": "medium"}
EXPECTED = {
    "hr": ["PERSON", "ID_NIK", "ID_NPWP", "ID_KK", "EMAIL_ADDRESS", "ID_PHONE", "LOCATION", "DATE_TIME"],
    "medical": ["PERSON", "ID_NIK", "ID_BPJS", "ID_PHONE", "DATE_TIME", "LOCATION", "EMAIL_ADDRESS"],
    "financial": ["PERSON", "ID_NIK", "ID_NPWP", "CREDIT_CARD", "IBAN_CODE", "ID_PHONE", "EMAIL_ADDRESS"],
    "legal": ["PERSON", "ID_NIK", "ID_NPWP", "LOCATION", "DATE_TIME", "EMAIL_ADDRESS", "ID_PHONE"],
    "customer": ["PERSON", "EMAIL_ADDRESS", "ID_PHONE", "LOCATION", "ID_NIK", "DATE_TIME"],
    "payroll": ["PERSON", "ID_NIK", "ID_NPWP", "ID_BPJS", "IBAN_CODE", "EMAIL_ADDRESS"],
    "insurance": ["PERSON", "ID_NIK", "ID_KK", "ID_BPJS", "DATE_TIME", "ID_PHONE", "EMAIL_ADDRESS"],
}
#: What each part of the context counts, and the bounds of the sum and of the score.
LEXICAL, STRUCTURAL, SPATIAL, DOCUMENT = 1.0, 1.2, 0.8, 0.6
POSITIVE_WEIGHT, NEGATIVE_WEIGHT, HINT_WEIGHT, KEY_WEIGHT, HEADER_WEIGHT = 0.15, 0.2, 0.1, 0.2, 0.15
TYPE_WEIGHT, EXPECTED_BOOST, UNEXPECTED_PENALTY, SENSITIVE_BOOST, TITLE_BOOST = 0.1, 0.1, 0.05, 0.05, 0.1
LEAST_SCORE, MOST_SCORE, MOST_BOOST, MOST_PENALTY, CLEAR_TYPE = 0.1, 1.0, 0.3, 0.4, 0.3
EMPTY = "array<string>"


def _map(table: dict) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(EMPTY))


def _given(*columns: str) -> Column:
    """The columns that hold something, as an array."""
    return F.filter(F.array(*map(F.col, columns)), lambda x: F.coalesce(x != "", F.lit(False)))


def context_labels() -> Column:
    """Heading, key and slide title, then the headers of the table and the row, then the labels near."""
    return F.concat(_given("heading", "key_label", "slide_title"), _list("table_headers"), _list("row_headers"), _list("nearby_labels"))


def _branches(node: dict) -> str:
    ways = [re.escape(letter) + _branches(below) for letter, below in node.items() if letter]
    if not ways:
        return ""
    body = ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"
    return f"(?:{body})?" if "" in node else body


def any_of(words) -> str:
    """An expression for any of ``words`` with common beginnings written once: where several match, the longest is tried first."""
    root: dict = {}
    for word in sorted(words):
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}
    return _branches(root)


def word_pattern(words) -> str:
    return rf"(?iU)\b({any_of(words)})\b"


def run_pattern(tables) -> str:
    """Runs of words that occur in some keyword, with what may stand between them: every keyword of a text lies within one run, between the same neighbours."""
    words = [w for table in tables for w in table]
    single = any_of({x for w in words for x in re.split(r"[ .\-]+", w) if x})
    return rf"(?iU)\b(?:{single})\b(?:[ .\-]+(?:{single})\b)*"


def keyword_runs(text: Column, tables) -> Column:
    """The parts of a text in which keywords of ``tables`` can lie, line by line: one pass over the text, so that each table is looked for in little."""
    return F.array_join(F.regexp_extract_all(text, F.lit(run_pattern(tables)), F.lit(0)), "\n")


def words_met(text: Column, table: dict[str, float]) -> Column:
    """The keywords of ``table`` in a text, the longest first where several begin, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(word_pattern(table)), F.lit(1)), F.lower)


def weight_of(words: Column, table: dict[str, float]) -> Column:
    known = _map(table)
    return F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(known, w), F.lit(0.0)))


def label_boost(findings: DataFrame, balanced: bool = True) -> DataFrame:
    """Findings with a column labels (array, null for none): the score goes up where a label asks for the type, and in the balanced mode down where one
    asks for another. Labels count as they stand but for case. A column ``band`` is set anew by the new score where a label spoke."""
    known = _map(LABEL_ENTITIES)
    asked = F.transform(F.coalesce("labels", F.array().cast(EMPTY)), lambda x: F.try_element_at(known, F.lower(x)))
    match = F.exists(asked, lambda e: F.coalesce(F.array_contains(e, F.col("entity_type")), F.lit(False)))
    other = F.exists(asked, lambda e: F.coalesce(~F.array_contains(e, F.col("entity_type")), F.lit(False)))
    down = F.greatest(F.lit(0.0), F.col("score") - MISMATCH_PENALTY) if balanced else F.col("score")
    score = F.when(match, F.least(F.lit(1.0), F.col("score") + MATCH_BOOST)).when(other, down).otherwise(F.col("score"))
    told = findings.withColumn("context", F.when(match, "match").when(other & F.lit(balanced), "mismatch"))
    scored = told.withColumn("score", F.round(score, 6))
    if "band" not in findings.columns:
        return scored
    return scored.withColumn("band", F.when(F.col("context").isNull(), F.col("band")).otherwise(classify.simple_band(F.col("score"), 0.85, 0.6)))


def lexical_text() -> Column:
    """Where keywords are looked for: the text, the key, all labels and the table's headers, so key and headers count twice."""
    return F.array_join(F.concat(F.array(F.coalesce("text", F.lit(""))), _given("key_label"), context_labels(), _list("table_headers")), " ")


def lexical(segments: DataFrame) -> DataFrame:
    """Segments with positive, negative (keywords met), net_score and hints (entity type -> best weight of its keywords)."""
    joined = segments.withColumn("_text", keyword_runs(lexical_text(), [POSITIVE, NEGATIVE, *ENTITY_WORDS.values()]))
    best = lambda table: F.array_max(F.transform(words_met(F.col("_text"), table), lambda w: F.coalesce(F.try_element_at(_map(table), w), F.lit(0.0))))
    hints = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(e).alias("k"), best(table).alias("v")) for e, table in ENTITY_WORDS.items()]), lambda x: x["v"].isNotNull()))
    out = joined.withColumn("positive", words_met(F.col("_text"), POSITIVE)).withColumn("negative", words_met(F.col("_text"), NEGATIVE)).withColumn("hints", hints)
    return out.withColumn("net_score", F.round(weight_of(F.col("positive"), POSITIVE) - weight_of(F.col("negative"), NEGATIVE), 6)).drop("_text")


def structure() -> Column:
    """array<struct<kind, text, weight, distance>> of what surrounds a segment."""
    item = lambda kind, text, at: F.struct(F.lit(kind).alias("kind"), F.trim(text).alias("text"), F.lit(STRUCTURE[kind]).alias("weight"), at.cast("int").alias("distance"))
    one = lambda kind, name: F.transform(_given(name), lambda x: item(kind, x, F.lit(0)))
    many = lambda kind, names: F.transform(names, lambda x, i: item(kind, x, i))
    near = F.filter(context_labels(), lambda x: ~x.eqNullSafe(F.col("key_label")))
    every = F.concat(
        one("key_label", "key_label"), many("table_header", _list("table_headers")), many("row_header", _list("row_headers")), one("document_heading", "heading"), one("section_title", "slide_title"),
        F.transform(near, lambda x: item("nearby_label", x, F.lit(1))), one("cell_position", "cell"),
    )
    return F.filter(every, lambda x: x["text"] != "")


def primary(items: Column) -> Column:
    """The first item of the kind with the highest priority."""
    first = lambda kind: F.get(F.filter(items, lambda x: x["kind"] == kind), F.lit(0))
    return F.coalesce(*[first(kind) for kind in STRUCTURE])


def document_type(texts: Column) -> Column:
    """struct<type, confidence> of the joined texts: the type whose keywords weigh most, the earlier one of equals; below 0.3 it is general."""
    weight = lambda runs, table: F.round(F.least(F.lit(1.0), weight_of(words_met(runs, table), table)), 6)
    typed = lambda runs: F.array(*[F.struct(F.lit(kind).alias("type"), weight(runs, table).alias("confidence")) for kind, table in DOCUMENT_WORDS.items()])
    scored = bound(keyword_runs(texts, DOCUMENT_WORDS.values()), typed)
    best = lambda all_: F.aggregate(all_, F.get(all_, F.lit(0)), lambda acc, x: F.when(x["confidence"] > acc["confidence"], x).otherwise(acc))
    clear = lambda b: F.when(b["confidence"] >= CLEAR_TYPE, F.struct(b["type"].alias("type"), b["confidence"].alias("confidence"))).otherwise(F.struct(F.lit("general").alias("type"), F.lit(0.0).alias("confidence")))
    return bound(bound(scored, best), clear)


def document_text() -> Column:
    return F.array_join(F.concat(F.array(F.coalesce("text", F.lit(""))), context_labels(), _list("table_headers"), _given("heading", "file_id", "sheet")), " ")


def in_context(segments: DataFrame) -> DataFrame:
    """Segments with all that ``rescored`` needs: the columns of ``lexical``, primary, doc_type, doc_confidence, sensitivity and expected."""
    out = lexical(segments).withColumn("primary", bound(structure(), primary)).withColumn("_d", document_type(document_text()))
    kind = F.col("_d.type")
    known = F.coalesce(F.try_element_at(_map(EXPECTED), kind), F.array().cast(EMPTY))
    return out.select("*", kind.alias("doc_type"), F.col("_d.confidence").alias("doc_confidence"), F.try_element_at(_map(SENSITIVITY), kind).alias("sensitivity"), known.alias("expected")).drop("_d")


def evidence() -> Column:
    """array<struct<source, reason, weight, description>>: what the context adds to a finding's score and takes from it, in order."""
    piece = lambda source, reason, weight, text: F.struct(F.lit(source).alias("source"), F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"), weight.alias("weight"), text.alias("description"))
    part = lambda when, made: F.when(F.coalesce(when, F.lit(False)), F.array(made)).otherwise(F.array().cast("array<struct<source:string,reason:string,weight:double,description:string>>"))
    word = lambda name, table, sign, of, reason, said: F.transform(F.col(name), lambda w: piece("lexical_context", reason, F.coalesce(F.try_element_at(_map(table), w), F.lit(0.0)) * (sign * of * LEXICAL), F.concat(F.lit(f"{said} keyword: '"), w, F.lit("'"))))
    hint, p = F.try_element_at(F.col("hints"), F.col("entity_type")), F.col("primary")
    kind = F.when(p["kind"] == "row_header", "table_header").otherwise(p["kind"])
    place = F.when(kind == "key_label", KEY_WEIGHT * STRUCTURAL).when(kind == "table_header", HEADER_WEIGHT * STRUCTURAL).otherwise(p["weight"] * (STRUCTURAL * 0.5))
    said = F.concat(F.when(kind == "key_label", "Key label: '").when(kind == "table_header", "Table header: '").otherwise("Structural context: '"), p["text"], F.lit("'"))
    some = F.size("expected") > 0
    hit = F.array_contains("expected", F.col("entity_type"))
    near = F.exists(_list("nearby_labels"), lambda x: F.trim(x) != "")
    in_type = lambda a, b: F.concat(F.col("entity_type"), F.lit(a), F.col("doc_type"), F.lit(b))
    return F.concat(
        word("positive", POSITIVE, 1, POSITIVE_WEIGHT, "positive_keyword", "Positive"), word("negative", NEGATIVE, -1, NEGATIVE_WEIGHT, "negative_keyword", "Negative"),
        part(hint > 0, piece("lexical_context", "entity_hint", hint * (HINT_WEIGHT * LEXICAL), F.concat(F.lit("Entity keyword hint for "), F.col("entity_type")))),
        part(p.isNotNull(), piece("structural_context", kind, place, said)),
        part(near & (F.col("slide_title") != ""), piece("spatial_context", "slide_title", F.lit(TITLE_BOOST * SPATIAL), F.concat(F.lit("Slide title: '"), F.col("slide_title"), F.lit("'")))),
        part(F.col("doc_confidence") > CLEAR_TYPE, piece("document_context", "document_type", F.col("doc_confidence") * (TYPE_WEIGHT * DOCUMENT), F.concat(F.lit("Document type: "), F.col("doc_type")))),
        part(some & hit, piece("document_context", "expected_entity", F.lit(EXPECTED_BOOST * DOCUMENT), in_type(" expected in ", ""))),
        part(some & ~hit, piece("document_context", "unexpected_entity", F.lit(-UNEXPECTED_PENALTY * DOCUMENT), in_type(" not typical for ", ""))),
        part(F.col("sensitivity").isin("high", "critical"), piece("document_context", "high_sensitivity", F.lit(SENSITIVE_BOOST * DOCUMENT), F.concat(F.lit("High sensitivity document ("), F.col("sensitivity"), F.lit(")")))),
    )


def rescored(findings: DataFrame) -> DataFrame:
    """Findings beside the columns of ``in_context``: score with the bounded sum of all evidence in it, score_delta, and the evidence."""
    judged = findings.withColumn("evidence", evidence())
    delta = F.greatest(F.lit(-MOST_PENALTY), F.least(F.lit(MOST_BOOST), F.aggregate("evidence", F.lit(0.0), lambda acc, e: acc + e["weight"])))
    score = F.greatest(F.lit(LEAST_SCORE), F.least(F.lit(MOST_SCORE), F.col("score") + delta))
    return judged.withColumn("score_delta", F.round(score - F.col("score"), 6)).withColumn("score", F.round(score, 6))


def explained(entity: Column, band: Column, evidence_column: str = "evidence") -> Column:
    """struct<primary_reason, positive, negative, summary> of a finding's evidence; the first piece in favour speaks for it."""
    e = F.col(evidence_column)
    good, bad = F.filter(e, lambda x: x["weight"] > 0), F.filter(e, lambda x: x["weight"] < 0)

    def told(g: Column) -> Column:
        first = F.get(g, F.lit(0))
        parts = F.array(
            F.when(F.size(g) > 0, F.concat(F.lit("Detected as "), entity, F.lit(": "), first["description"], F.lit("."))),
            F.when(F.size(g) > 1, F.concat(F.lit("Supported by "), (F.size(g) - 1).cast("string"), F.lit(" additional factor(s)."))),
            F.when(F.size(bad) > 0, F.concat(F.lit("Note: "), F.size(bad).cast("string"), F.lit(" factor(s) reduced confidence."))), F.concat(F.lit("Overall confidence: "), band, F.lit(".")),
        )
        return F.struct(first["reason"].alias("primary_reason"), F.size(g).alias("positive"), F.size(bad).alias("negative"), F.array_join(parts, " ").alias("summary"))

    return bound(good, told)


def shown(entity: Column, value: Column, band: Column, score: Column, evidence_column: str = "evidence") -> Column:
    """The explanation as text: what was found, how sure, what speaks for it and what against."""
    e = F.col(evidence_column)
    lines = lambda mark, keep: F.transform(F.filter(e, keep), lambda x: F.concat(F.lit(f"  {mark} "), x["description"]))
    head = F.array(F.concat(F.lit("Entity: "), entity), F.concat(F.lit('Text: "'), value, F.lit('"')), F.concat(F.lit("Confidence: "), band, F.lit(" ("), F.round(score * 100, 0).cast("int").cast("string"), F.lit("%)")), F.lit(""), F.lit("Why detected:"))
    bad = lines("✗", lambda x: x["weight"] < 0)
    tail = F.when(F.size(bad) > 0, F.concat(F.array(F.lit(""), F.lit("Factors reducing confidence:")), bad)).otherwise(F.array().cast(EMPTY))
    return F.array_join(F.concat(head, lines("✓", lambda x: x["weight"] > 0), tail), "\n")


def with_evidence(findings: DataFrame, kind: str) -> DataFrame:
    """Findings as a detector of ``kind`` (custom_term, regex, model) makes them: score, band and one piece of evidence. A custom term is certain."""
    reason, source, said = {"custom_term": ("custom_term_match", "custom_terms", "Matched custom term"), "regex": ("pattern_match", "regex", "Matched pattern"), "model": ("model_match", "model", "Found by the model")}[kind]
    score = F.lit(1.0) if kind == "custom_term" else F.col("score")
    band = F.lit("CRITICAL") if kind == "custom_term" else F.when(score >= 0.85, "HIGH").when(score >= 0.6, "MEDIUM").otherwise("LOW")
    piece = F.struct(F.lit(source).alias("source"), F.lit(reason).alias("reason"), score.alias("weight"), F.lit(said).alias("description"))
    return findings.withColumn("evidence", F.array(piece)).withColumn("band", band).withColumn("is_from_custom_terms", F.lit(kind == "custom_term")).withColumn("score", score)
