"""Recognizers that judge a number by its whole segment (text and labels), and the pattern sets of text and office files.

``labels`` is an array of the segment's labels, its key among them; null counts as none. Like all recognizers these are array expressions over one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Pattern, bound, contains_any, digits, located
from .recognizers import EMAIL, NONE, PROVINCES, SIXTEEN, Score, birth_date_found, bpjs_found, first_of_equal, person_found, rows_of, scored
from .recognizers_more import label_type

#: Words that make a segment speak of a number, tax categories and mobile prefixes.
NIK_WORDS = ["nik", "nomor induk kependudukan", "no. ktp", "no ktp", "nomor ktp", "ktp", "kartu tanda penduduk", "identitas", "identity", "id number"]
NIK_ONLY_WORDS = ["nik", "ktp", "kartu tanda penduduk", "nomor induk kependudukan"]
KK_WORDS = ["kk", "kartu keluarga", "no. kk", "no kk", "nomor kk", "nomor kartu keluarga", "family card", "family register"]
NPWP_WORDS = ["npwp", "nomor pokok wajib pajak", "tax id", "tax number", "nomor pajak", "wajib pajak", "pajak", "tax identification", "tin"]
TAX_WORDS, IDENTITY_WORDS = ["npwp", "pajak", "tax", "wajib pajak"], ["nik", "ktp", "kartu tanda penduduk", "identitas"]
PHONE_WORDS = ["telepon", "telp", "telpon", "hp", "handphone", "no. hp", "no hp", "nomor hp", "phone", "mobile", "cell", "whatsapp", "wa", "contact", "kontak", "hubungi"]
BPJS_WORDS = ["bpjs", "bpjs kesehatan", "bpjs ketenagakerjaan", "no. bpjs", "no bpjs", "nomor bpjs", "kartu bpjs", "peserta bpjs", "jkn", "jaminan kesehatan", "jaminan sosial"]
TAX_CATEGORIES = ["01", "02", "03", "04", "05", "06", "07", "08", "09", "21", "31", "41", "51", "61", "71", "81"]
MOBILE_PREFIXES = [
    "811", "812", "813", "821", "822", "823", "851", "852", "853", "814", "815", "816", "855", "856", "857", "858", "817", "818", "819", "859", "877", "878", "879",
    "831", "832", "833", "838", "895", "896", "897", "898", "899", "881", "882", "883", "884", "885", "886", "887", "888", "889",
]
#: Patterns of text files, and those in which office files differ.
TXT = [
    Pattern("EMAIL", EMAIL.regex, 1.0, "txt"),
    Pattern("PHONE_NUMBER", r"(?iU)\b(?:\+62|62|0)[\s.-]?(?:\d{2,4})[\s.-]?(?:\d{3,4})[\s.-]?(?:\d{3,4})\b", 1.0, "txt"),
    Pattern("ID_NIK", r"(?iU)\b[1-9]\d{15}\b", 1.0, "txt"),
    Pattern("ID_NPWP", r"(?iU)\b\d{2}\.?\d{3}\.?\d{3}\.?\d[-.]?\d{3}\.?\d{3}\b", 1.0, "txt"),
    Pattern("ID_KK", r"(?iU)\b[1-9]\d{15}\b", 1.0, "txt"),
    Pattern("CREDIT_CARD", r"(?iU)\b\d{4}([\s-]?)\d{4}\1\d{4}\1\d{4}\b", 1.0, "txt"),
    Pattern("IP_ADDRESS", r"(?iU)\b(?:\d{1,3}\.){3}\d{1,3}\b", 1.0, "txt"),
    Pattern("DATE", r"(?iU)\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/](?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|Januari|Februari|Maret|April|Mei|Juni|Juli|Agustus|September|Oktober|November|Desember)[-/]\d{2,4})\b", 1.0, "txt"),
    Pattern("URL", r'(?iU)https?://[^\s<>"{}|\\^`\[\]]+', 1.0, "txt"),
    Pattern("PERSON", r"(?iU)(?:Nama\s*(?:Pasien)?|Pasien|Dokter|Dr\.|Perawat|Pengirim|Penerima|Kepada|Dari|Attn|PIC)[\s:]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})(?=\s*[\|\n\r,;]|$)", 1.0, "txt", 1),
]
OFFICE_PERSON = Pattern("PERSON", r"(?iU)(?:Nama|Name|Pasien|Patient|Dr\.?|Dokter|Bpk\.?|Ibu|Sdr\.?|Sdri\.?)\s*[:\s]\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})", 1.0, "office", 1)
OFFICE_DATE = Pattern("DATE", r"(?iU)\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b", 1.0, "office")
OFFICE = [*[OFFICE_DATE if p.entity == "DATE" else p for p in TXT if p.entity not in ("ID_KK", "PERSON")], OFFICE_PERSON]
NO_NAMES = ["data", "file", "mock", "test", "nama", "pasien", "dokter"]


def segment_text(text: Column, labels: Column | None = None) -> Column:
    """Text and labels in lower case, each on lines of its own, for keyword searches."""
    parts = F.array(F.coalesce(text, F.lit("")))
    return F.lower(F.array_join(parts if labels is None else F.concat(parts, F.coalesce(labels, F.array().cast("array<string>"))), "\n"))


def _date(code: Column, as_of: str, shift_women: bool, window: int) -> tuple[Column, Column]:
    """(date or null, year) of a ddmmyy code: two digits above those of ``as_of``'s year plus ``window`` belong to the last century."""
    day, month, year = (F.substring(code, i, 2).cast("int") for i in (1, 3, 5))
    day = F.when(day > 40, day - 40).otherwise(day) if shift_women else day
    full = F.when(year > int(as_of[2:4]) + window, 1900 + year).otherwise(2000 + year)
    return F.concat_ws("-", full, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date"), full


def nik_in_segment(text: Column, as_of: str, labels: Column | None = None) -> Column:
    """0.5 for the shape, 0.2 for the province (else none), 0.2 and 0.1 for a birth date up to 120 years ago or -0.1, 0.1 for the segment's words."""
    p = Pattern("ID_NIK", SIXTEEN, 0.5, "enhanced_nik")
    today = F.lit(as_of).cast("date")

    def score(near: Column) -> Score:
        def of(number: Column) -> Column:
            date, _ = _date(F.substring(number, 7, 6), as_of, True, 0)
            good = F.coalesce((date <= today) & (F.floor(F.months_between(today, date, False) / 12) <= 120), F.lit(False))
            raw = F.least(F.lit(1.0), F.lit(0.7) + F.when(good, 0.3).otherwise(-0.1))
            return F.when(F.substring(number, 1, 2).isin(PROVINCES), F.least(F.lit(1.0), raw + F.when(near, 0.1).otherwise(0.0))).otherwise(0.0)

        return lambda x: bound(digits(x["value"]), of)

    return bound(contains_any(segment_text(text, labels), NIK_WORDS), lambda near: scored(located(text, p), p, score(near)))


def kk_in_segment(text: Column, as_of: str, labels: Column | None = None) -> Column:
    """0.5 with the words of a family card, else 0.3, and none at all where a segment speaks of the identity number only; 0.2 for the province, 0.15 for
    a date of issue since 1990 or -0.1, 0.15 for the words."""
    p = Pattern("ID_KK", SIXTEEN, 0.3, "enhanced_kk")

    def of_segment(seen: Column) -> Column:
        near = contains_any(seen, KK_WORDS)

        def of(number: Column) -> Column:
            date, year = _date(F.substring(number, 7, 6), as_of, False, 10)
            good = F.coalesce((date <= F.lit(as_of).cast("date")) & (year >= 1990), F.lit(False))
            raw = F.when(near, 0.5).otherwise(0.3) + 0.2 + F.when(good, 0.15).otherwise(-0.1)
            return F.when(F.substring(number, 1, 2).isin(PROVINCES), F.least(F.lit(1.0), raw + F.when(near, 0.15).otherwise(0.0))).otherwise(0.0)

        found = scored(located(text, p), p, lambda x: bound(digits(x["value"]), of))
        return F.when(contains_any(seen, NIK_ONLY_WORDS) & ~near, F.array().cast(NONE)).otherwise(found)

    return bound(segment_text(text, labels), of_segment)


def npwp_in_segment(text: Column, labels: Column | None = None, key: Column | None = None) -> Column:
    """Numbers of 15 digits with marks between (0.5) or, in a segment that speaks of taxes, without; 0.15 for the category, 0.1 for a main branch, 0.15 for
    the words; and of 16 digits (0.6) where text and key speak of taxes and not of identity."""
    shapes = [r"(?U)\b\d{2}[.\s]?\d{3}[.\s]?\d{3}[.\s]?\d[-.\s]?\d{3}[.\s]?\d{3}\b", r"(?U)\b\d{2}[.\s-]?\d{3}[.\s-]?\d{3}[.\s-]?\d[.\s-]?\d{3}[.\s-]?\d{3}\b"]
    marked = [Pattern("ID_NPWP", x, 0.5, "enhanced_npwp") for x in shapes]
    longer = Pattern("ID_NPWP", r"(?U)\b\d{16}\b", 0.6, "enhanced_npwp")

    def of_segment(near: Column) -> Column:
        def of(number: Column) -> Column:
            raw = F.lit(0.5) + F.when(F.substring(number, 1, 2).isin(TAX_CATEGORIES), 0.15).otherwise(0.0) + F.when(F.substring(number, 10, 3) == "000", 0.1).otherwise(0.0)
            return F.when(number.rlike(r"^(\d)\1*$"), 0.0).otherwise(F.least(F.lit(1.0), raw + F.when(near, 0.15).otherwise(0.0)))

        fifteen = [scored(located(text, p), p, lambda x: bound(digits(x["value"]), of)) for p in marked]
        own = segment_text(text, None if key is None else F.array(F.coalesce(key, F.lit(""))))
        taxed = near & contains_any(own, TAX_WORDS) & ~contains_any(own, IDENTITY_WORDS)
        return first_of_equal(F.concat(*fifteen, F.when(taxed, scored(located(text, longer), longer)).otherwise(F.array().cast(NONE))))

    return bound(contains_any(segment_text(text, labels), NPWP_WORDS), of_segment)


def phone_in_segment(text: Column, labels: Column | None = None) -> Column:
    """Numbers of +62, 62 or 0 with 8 to 12 digits behind: 0.5, 0.15 for a mobile prefix, 0.1 for the words; mobile ones are ID_PHONE, others PHONE_NUMBER."""
    shapes = [
        r"(?<![0-9])(?:(?:\+62|62)[\s.\-]?[0-9][\s.\-]?(?:[0-9][\s.\-]?){6,11}|0[1-9][\s.\-]?(?:[0-9][\s.\-]?){6,11})(?![0-9])",
        r"(?<![0-9])(?:(?:\+62|62)[\s.\-]?(?:[1-9][0-9]{7,11})|(?:0[1-9][0-9]{6,11}))(?![0-9])",
    ]
    subscriber = lambda v: F.regexp_replace(F.regexp_replace(v, r"[\s.\-()]", ""), r"^(?:\+62|62|0)", "")
    is_mobile = lambda n: n.startswith("8")  # noqa: E731  (every known prefix begins with 8)

    def of_segment(near: Column) -> Column:
        raw = lambda n: F.lit(0.5) + F.when(F.left(n, F.lit(3)).isin(MOBILE_PREFIXES), 0.15).otherwise(0.0) + F.when(near, 0.1).otherwise(0.0)
        score = lambda x: bound(subscriber(x["value"]), lambda n: F.when(F.length(n).between(8, 12), raw(n)).otherwise(0.0))
        patterns = [Pattern("PHONE_NUMBER", x, 0.5, "enhanced_phone") for x in shapes]
        every = first_of_equal(F.concat(*[scored(located(text, p), p, score) for p in patterns]))
        return F.transform(every, lambda x: F.when(is_mobile(subscriber(x["value"])), x.withField("entity_type", F.lit("ID_PHONE"))).otherwise(x))

    return bound(contains_any(segment_text(text, labels), PHONE_WORDS), of_segment)


def phone_forms(value: Column) -> Column:
    """struct<e164, international, national> of an Indonesian number."""
    of = lambda n: F.struct(F.concat(F.lit("+62"), n).alias("e164"), F.concat(F.lit("+62 "), n).alias("international"), F.concat(F.lit("0"), n).alias("national"))
    return bound(F.regexp_replace(F.regexp_replace(value, r"[\s.\-()]", ""), r"^(?:\+62|62|0)", ""), of)


def bpjs_in_segment(text: Column, labels: Column | None = None) -> Column:
    """Thirteen digits in a segment that speaks of the insurance: 0.75, and 0.1 for a leading zero."""
    p = Pattern("ID_BPJS", r"(?U)\b\d{4}[\s.\-]?\d{4}[\s.\-]?\d{5}\b", 0.75, "bpjs")
    of = lambda n: F.when(n.rlike(r"^(\d)\1*$") | (n == "0123456789012"), 0.0).when(n.startswith("0"), 0.85).otherwise(0.75)
    found = scored(located(text, p), p, lambda x: bound(digits(x["value"]), of))
    return F.when(contains_any(segment_text(text, labels), BPJS_WORDS), found).otherwise(F.array().cast(NONE))


def simple_ids(text: Column) -> Column:
    """Identity numbers of province 11 to 94 with a possible date (0.85), tax numbers (0.8) and mobile numbers (0.75)."""
    nik = Pattern("ID_NIK", r"(?U)\b[1-9][1-9]\d{14}\b", 0.85, "indonesian_id/nik")
    npwp = Pattern("ID_NPWP", r"(?U)\b\d{2}\.?\d{3}\.?\d{3}\.?\d[-.]?\d{3}\.?\d{3}\b", 0.8, "indonesian_id/npwp")
    phone = Pattern("ID_PHONE", r"(?U)(?:\+62|62|0)8[1-9][0-9]{7,10}\b", 0.75, "indonesian_id/phone")

    def sane(x: Column) -> Column:
        part = lambda i: F.substring(x["value"], i, 2).cast("int")
        day = part(7)
        return F.when(part(1).between(11, 94) & (day.between(1, 31) | day.between(41, 71)) & part(9).between(1, 12), 0.85).otherwise(0.0)

    return F.concat(scored(located(text, nik), nik, sane), scored(located(text, npwp), npwp), scored(located(text, phone), phone))


def _valid(entity: str) -> Score:
    """What text files ask of a match beyond its shape; 1 or 0."""
    if entity == "IP_ADDRESS":
        return lambda x: F.when(F.forall(F.split(x["value"], r"\."), lambda p: p.cast("int") <= 255), 1.0).otherwise(0.0)
    if entity == "ID_NIK":
        return lambda x: F.when(F.left(x["value"], F.lit(2)).cast("int").between(1, 99), 1.0).otherwise(0.0)
    if entity == "CREDIT_CARD":
        return lambda x: F.when(F.left(digits(x["value"]), F.lit(1)).isin("3", "4", "5", "6") & ~x["value"].rlike(r"\d{4}[-/]\d{6,8}[-/]\d{4}"), 1.0).otherwise(0.0)
    if entity == "PERSON":
        words = lambda x: F.filter(F.split(x["value"], r"(?U)\s+"), lambda w: w != "")
        return lambda x: bound(words(x), lambda w: F.when((F.size(w) >= 2) & ~F.exists(w, lambda y: F.lower(y).isin(NO_NAMES)), 1.0).otherwise(0.0))
    return lambda x: F.lit(1.0)


def txt_found(text: Column, as_of: str) -> Column:
    """The findings of a text file, overlaps left in: the patterns with their checks, then names, birth dates and insurance numbers."""
    return F.concat(*[scored(located(text, p), p, _valid(p.entity)) for p in TXT], person_found(text), birth_date_found(text, as_of), bpjs_found(text))


def txt(df: DataFrame, as_of: str, text: str = "text") -> DataFrame:
    return rows_of(df, text, txt_found(F.col(text), as_of))


def office_found(text: Column, as_of: str) -> Column:
    """The findings of a paragraph of an office file: the patterns as they stand, then names, birth dates and insurance numbers."""
    return F.concat(*[scored(located(text, p), p) for p in OFFICE], person_found(text), birth_date_found(text, as_of), bpjs_found(text))


def office_cells(df: DataFrame, as_of: str, header: str = "header", text: str = "text") -> DataFrame:
    """Cells of tables: where the header asks for a person, a birth date or a place, the cell is one finding (0.9; birth dates must look like dates, else the
    cell has none); others are searched like paragraphs."""
    bare, kind = F.trim(text), label_type(F.when(F.col(header) != "", F.col(header)))
    date = bare.rlike(r"\d{1,2}[\s\-/][A-Za-z0-9]{1,9}[\s\-/]\d{2,4}|\d{4}[\-/]\d{1,2}[\-/]\d{1,2}")
    whole = F.array(F.struct(kind.alias("entity_type"), F.lit(0).cast("long").alias("start_pos"), F.length(bare).cast("long").alias("end_pos"), bare.alias("value"), F.lit(0.9).alias("score"), F.lit("header").alias("recognizer")))
    none = F.array().cast(NONE)
    found = F.when(bare == "", none).when((kind == "DATE_OF_BIRTH") & ~date, none).when(kind.isin("PERSON", "DATE_OF_BIRTH", "LOCATION"), whole).otherwise(office_found(bare, as_of))
    return rows_of(df, text, found)
