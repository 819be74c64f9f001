"""Licences, passports, names that are none, and types from labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Pattern, bound, collapse, contains_any, digits, located
from .recognizers import NONE, rows_of, scored

#: Keywords, series letters and labels.
LICENCE_WORDS = ["sim", "surat izin mengemudi", "driving license", "driver license", "driver's license"]
PASSPORT_WORDS = ["passport", "paspor", "travel document", "dokumen perjalanan"]
PASSPORT_LETTERS = list("ABCMNPRSTX")
LABEL_TYPES = [
    (["tanggal lahir", "tgl lahir", "tgl. lahir", "date of birth", "dob", "birth date", "ttl", "lahir"], "DATE_OF_BIRTH"),
    (["nama lengkap", "nama pasien", "nama karyawan", "nama pelanggan", "nama mock", "nama", "full name", "patient name", "name"], "PERSON"),
    (["nik", "no ktp", "nomor ktp", "no. ktp"], "ID_NIK"), (["npwp"], "ID_NPWP"), (["no kk", "nomor kk", "kartu keluarga", "kk"], "ID_KK"), (["bpjs", "no bpjs"], "ID_BPJS"),
    (["email", "e-mail", "surel"], "EMAIL_ADDRESS"), (["telepon", "telp", "no telp", "no hp", "nomor hp", "handphone", "phone", "kontak"], "PHONE_NUMBER"), (["alamat", "address", "domisili"], "LOCATION"),
]
PLAIN_LABELS = ["jenis kelamin", "gender", "penjamin", "emr id", "encounter", "diagnosis", "diagnosa", "icd-10", "icd", "keluhan", "terapi", "tanda vital", "spo2", "td", "suhu", "penanggung"]
PLACE_WORDS = [
    "no", "no.", "jl", "jl.", "jalan", "gang", "gg", "blok", "rt", "rw", "kecamatan", "kelurahan", "desa", "kota", "kabupaten", "kab", "baru", "lama", "timur", "barat", "utara", "selatan",
    "tengah", "raya", "dalam", "atas", "bawah",
]
CLINICAL_WORDS = [
    "demam", "berdarah", "batuk", "pilek", "nyeri", "sesak", "mual", "muntah", "hipertensi", "diabetes", "dispepsia", "asma", "dermatitis", "ispa", "alergi", "penisilin", "amoxicillin",
    "amoksisilin", "paracetamol", "metformin", "amlodipine", "obat", "resep", "dosis", "diagnosis", "diagnosa", "gula", "darah", "ruam", "gatal", "endoskopi", "terapi", "penicillin",
    "antibiotik", "infeksi", "radang", "tumor", "kanker", "jangan", "berikan", "menunjukkan", "mengeluh", "kontrol", "isolasi", "rujukan", "rawat", "periksa", "cek", "penjamin", "asuransi",
    "mandiri", "inhealth",
]
#: Words and phrases of Indonesian documents that are taken for names, by theme.
COMMON_TERMS = [
    "perempuan", "laki-laki", "laki laki", "pria", "wanita", "jenis kelamin", "gender", "usia", "umur",
    "penjamin", "kunjungan", "keluhan", "terapi", "diagnosis", "diagnosa", "tanda", "tanda vital", "emr", "nik", "nik mock", "npwp", "kk", "no ktp", "nomor", "alamat", "alamat mock", "kontak", "email",
    "telepon", "telp", "hp", "penanggung", "pasien", "karyawan", "nama", "nama mock", "nama pasien", "nama lengkap", "tempat lahir", "tanggal lahir", "tgl lahir", "lahir",
    "encounter", "provinsi", "kota", "kabupaten", "kecamatan", "kelurahan", "pekerjaan", "jabatan", "departemen", "divisi", "unit",
    "demam", "batuk", "pilek", "nyeri", "sesak", "mual", "muntah", "hipertensi", "diabetes", "dispepsia", "asma", "dermatitis", "ispa", "kontrol", "gula darah", "tekanan darah", "suhu", "ruam",
    "rawat inap", "rawat jalan", "poli", "poliklinik", "igd", "ugd", "resep", "obat", "dosis", "rujukan", "anamnesis", "vital",
    "kulit", "gatal", "napas", "darah", "ulu", "hati", "punggung", "kepala", "perut", "dada", "kaki", "tangan", "mata", "telinga",
    "bpjs", "bpjs kesehatan", "asuransi", "asuransi swasta", "asuransi perusahaan", "corporate guarantee", "pribadi", "mandiri",
    "sangat rahasia", "rahasia", "mockup", "klasifikasi", "peringatan", "confidential", "internal", "public",
    "januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember", "senin", "selasa", "rabu", "kamis", "jumat", "sabtu", "minggu",
    "aktif", "nonaktif", "tidak", "spesifik", "esensial", "fungsional", "ringan", "sedang", "berat", "normal", "abnormal",
    "dan", "atau", "dengan", "yang", "untuk", "dari", "pada", "di", "ke",
    "catatan", "bukan", "data", "identitas", "medis", "file", "ini", "sintetis", "nyata", "semua", "contoh", "dokumen", "simulasi", "informasi", "keperluan", "demo", "pengujian",
]
LABEL_PARTS = ["mock", "emr", "nik", "npwp", "id", "no", "nomor"]
ADDRESS_LABELS = ["alamat", "address", "domisili", "jl.", "jalan", "kota", "kecamatan", "kelurahan"]


def licence_found(text: Column) -> Column:
    """Numbers of 12 to 14 digits in texts that speak of a licence; a named class adds to the score."""
    p = Pattern("ID_SIM", r"(?U)\b\d{4}[\s.\-]?\d{4}[\s.\-]?\d{4}(?:[\s.\-]?\d{2})?\b|\b\d{12,14}\b", 0.7, "sim")
    lower = F.lower(text)

    def of(kind: Column) -> Column:
        score = lambda x: F.when(digits(x["value"]).rlike(r"^(\d)\1*$"), 0.0).otherwise(F.lit(0.7) + F.when(kind, 0.1).otherwise(0.0))
        return scored(located(text, p), p, score)

    return F.when(contains_any(lower, LICENCE_WORDS), bound(lower.rlike(r"(?U)\bsim\s*(b1|b2|a|b|c|d)\b"), of)).otherwise(F.array().cast(NONE))


def licence(df: DataFrame, text: str = "text") -> DataFrame:
    return rows_of(df, text, licence_found(F.col(text)))


def passport_found(text: Column) -> Column:
    p = Pattern("ID_PASSPORT", r"(?iuU)\b[A-Z][\s.\-]?\d{7}\b", 0.4, "passport")

    def of(near: Column) -> Column:
        def score(x: Column) -> Column:
            letter = F.upper(F.left(x["value"], F.lit(1)))
            raw = F.lit(0.4) + F.when(letter.isin(PASSPORT_LETTERS), 0.2).otherwise(0.05) + F.when(near, 0.25).otherwise(-0.1)
            return bound(digits(x["value"]), lambda n: F.when(n.rlike(r"^(\d)\1*$") | (n == "1234567"), 0.0).otherwise(raw))

        return scored(located(text, p), p, score)

    return bound(contains_any(F.lower(text), PASSPORT_WORDS), of)


def passport(df: DataFrame, text: str = "text") -> DataFrame:
    return rows_of(df, text, passport_found(F.col(text)))


def label_type(label: Column) -> Column:
    """The entity type that a label asks for, or null: the first group with a keyword at the label's start or behind a space in it."""
    norm = collapse(label)
    out = F.when(norm.isNull() | norm.isin(PLAIN_LABELS), None)
    for words, entity in LABEL_TYPES:
        hit = norm.rlike(r"(?:^| )(?:" + "|".join(re.escape(w) for w in words) + ")")
        out = out.when(hit, entity)
    return out


def typed_cells(df: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """Cells whose label gives their type, as whole-cell findings of score 0.9; birth dates must look like dates."""
    entity = label_type(F.col(label))
    date = F.trim(text).rlike(r"\d{1,2}[\s\-/][A-Za-z0-9]{1,9}[\s\-/]\d{2,4}|\d{4}[\-/]\d{1,2}[\-/]\d{1,2}")
    found = df.withColumn("entity_type", entity).where(F.col("entity_type").isNotNull() & (F.trim(text) != "") & ((F.col("entity_type") != "DATE_OF_BIRTH") | date))
    rest = [c for c in df.columns if c not in (label, text)]
    return found.select(*rest, "entity_type", F.lit(0).cast("long").alias("start_pos"), F.length(text).cast("long").alias("end_pos"), F.trim(text).alias("value"), F.lit(0.9).alias("score"), F.lit("label").alias("recognizer"))


def not_a_person(value: Column, common: list[str], denied: list[str] | None = None) -> Column:
    """Whether a value found as a name can't be one. ``common``: lower-case words and phrases that are no names."""
    norm = collapse(value)
    tokens = F.filter(F.split(norm, r"(?U)[\s\-]+"), lambda x: x != "")
    any_of = lambda words: F.exists(tokens, lambda x: x.isin(words))
    known = [*common, *LABEL_PARTS]
    bad = (norm == "") | value.rlike(r"[\n\r]") | norm.isin(common) | value.rlike(r"[0-9|:=/\\@#\[\](){}<>]") | any_of(PLACE_WORDS) | (F.size(tokens) > 4) | ((F.size(tokens) == 1) & (F.length(F.get(tokens, F.lit(0))) <= 2))
    bad = bad | F.forall(tokens, lambda x: x.isin(common)) | any_of(CLINICAL_WORDS) | (any_of(LABEL_PARTS) & F.forall(tokens, lambda x: x.isin(known)))
    return bad | norm.isin(denied) if denied else bad
