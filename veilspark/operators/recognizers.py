"""Recognizers: DataFrame of texts in, one row a detected span out.

Each recognizer is an array expression over one text (``..._found``): spans, scores and the rules among a text's own findings are worked out within the
row, so detection shuffles nothing and many recognizers share one pass. All dates are judged against an explicit ``as_of``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Pattern, bound, contains_any, digits, located

#: Patterns, code lists, keywords and scores of the detected entities.
EMAIL = Pattern("EMAIL_ADDRESS", r"(?iuU)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.9, needs=("@",))
PHONES = [
    Pattern("PHONE_NUMBER", r"(?U)\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}", 0.8),
    Pattern("PHONE_NUMBER", r"(?U)\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", 0.7),
]
CARDS = [
    Pattern("CREDIT_CARD", r"(?U)\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", 0.85),
    Pattern("CREDIT_CARD", r"(?U)\b\d{4}([-\s]?)\d{4}\1\d{4}\1\d{4}\b", 0.7),
]
IPS = [
    Pattern("IP_ADDRESS", r"(?U)\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", 0.95),
    Pattern("IP_ADDRESS", r"(?U)\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0.9, needs=(":",)),
]
URLS = [Pattern("URL", r"(?iuU)https?://[^\s<>\"']+", 0.9, needs=("://",)), Pattern("URL", r"(?iuU)www\.[^\s<>\"']+", 0.8)]
IBAN = Pattern("IBAN_CODE", r"(?iuU)\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", 0.8)
GENERAL = [EMAIL, *PHONES, *CARDS, *IPS, *URLS, IBAN]

#: Eight digits with at most two characters between them, none a letter; what isn't ASCII counts as a digit. Every number of the patterns in LONG_NUMBERS and of the recognizers in
#: BY_NUMBER holds so many, so that a text without them is searched for none of these.
EIGHT_DIGITS = r"[0-9\P{ASCII}](?:[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{0,2}[0-9\P{ASCII}]){7}"
LONG_NUMBERS, BY_NUMBER = [PHONES[1], *CARDS], ["nik", "kk", "npwp", "id_phone", "bpjs"]

SIXTEEN = r"(?U)\b\d{2}[\s.-]?\d{2}[\s.-]?\d{2}[\s.-]?\d{6}[\s.-]?\d{4}\b|\b\d{16}\b"
PROVINCES = [
    "11", "12", "13", "14", "15", "16", "17", "18", "19", "21", "31", "32", "33", "34", "35", "36", "51", "52", "53", "61", "62", "63", "64", "65", "71", "72", "73", "74", "75", "76", "81",
    "82", "91", "92", "93", "94", "95", "96",
]
KK_KEYWORDS = ["kartu keluarga", "no. kk", "no kk", "nomor kk", "kk:", "family card", "kepala keluarga"]
NPWP_OLD = r"(?U)\b\d{2}[.\s]?\d{3}[.\s]?\d{3}[.\s]?\d[-.\s]?\d{3}[.\s]?\d{3}\b"
NPWP_NEW = r"(?U)\b\d{2}[.\s]?\d{3}[.\s]?\d{3}[.\s]?\d[-.\s]?\d{3}[.\s]?\d{3}[.\s]?\d\b|\b\d{16}\b"
SUBJECTS = ["00", "01", "02", "03", "04", "05", "06", "07", "08", "09", "21", "22", "31", "32"]
NPWP_KEYWORDS = ["npwp", "pajak", "tax", "wajib pajak", "nomor pokok", "dirjen pajak", "ditjen pajak", "efin", "spt"]
NPWP_WEIGHTS = [4, 3, 2, 7, 6, 5, 4, 3, 2]
MOBILE = [
    Pattern("ID_PHONE", r"(?U)\+62[-.\s]?8\d{2}[-.\s]?\d{3,4}[-.\s]?\d{3,4}", 0.95, "id_phone"),
    Pattern("ID_PHONE", r"(?U)\b08\d{2}[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b", 0.9, "id_phone"),
    Pattern("ID_PHONE", r"(?U)\b08\d{8,10}\b", 0.85, "id_phone"),
]
LANDLINE = [
    Pattern("ID_PHONE", r"(?U)\+62[-.\s]?\d{2,3}[-.\s]?\d{3,4}[-.\s]?\d{3,4}", 0.85, "id_phone"),
    Pattern("ID_PHONE", r"(?U)\(0\d{2,3}\)[-.\s]?\d{3,4}[-.\s]?\d{3,4}", 0.9, "id_phone"),
    Pattern("ID_PHONE", r"(?U)\b0\d{1,3}[-.\s]\d{3,4}[-.\s]?\d{3,4}\b", 0.75, "id_phone"),
]
CARRIERS = [
    "0811", "0812", "0813", "0821", "0822", "0823", "0851", "0852", "0853", "0814", "0815", "0816", "0855", "0856", "0857", "0858", "0817", "0818", "0819", "0859", "0877", "0878", "0879",
    "0831", "0832", "0833", "0838", "0895", "0896", "0897", "0898", "0899", "0881", "0882", "0883", "0884", "0885", "0886", "0887", "0888", "0889",
]
AREAS = ["021", "022", "024", "031", "061", "0411", "0361", "0274", "0271", "0341"]
BPJS_KEYWORDS = ["bpjs", "bpjs kesehatan", "bpjs ketenagakerjaan", "no bpjs", "no. bpjs", "nomor bpjs", "kartu bpjs", "peserta bpjs", "jkn", "jaminan kesehatan", "jaminan sosial"]
BIRTH_LABELS = ["tanggal lahir", "tgl lahir", "tgl. lahir", "tanggal. lahir", "tempat/tanggal lahir", "ttl", "lahir", "date of birth", "d.o.b", "dob", "born", "birth date", "birthdate"]
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "january": 1, "february": 2, "march": 3,
    "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12, "januari": 1, "februari": 2, "maret": 3, "mei": 5,
    "juni": 6, "juli": 7, "agustus": 8, "oktober": 10, "desember": 12, "agu": 8, "okt": 10, "des": 12, "peb": 2,
}
MIN_BIRTH_YEAR = 1920
NAME_LABELS = ["nama lengkap", "nama pasien", "nama karyawan", "nama pelanggan", "nama mock", "nama", "name", "full name", "patient name"]
NAME_KEYS = ["name", "nama", "full_name", "fullname", "patient", "patient_name", "pasien", "nama_pasien", "doctor", "dokter", "nama_dokter", "employee", "karyawan", "customer", "pelanggan"]
NAME_CUES = ["pasien", "dokter", "perawat", "cek lab", "atas nama", "kontak darurat", "penanggung jawab", "pengirim", "penerima"]

_longest_first = lambda words: "|".join(sorted(words, key=len, reverse=True))
_NAME = r"[A-Z][a-z]+(?:[^\S\n]+[A-Z][a-z]+){0,3}"
PERSONS = [
    Pattern("PERSON", rf"(?iuU)(?:{_longest_first(NAME_LABELS)})\s*[:=]\s*({_NAME})", 0.9, "id_person", 1, (":", "=")),
    Pattern("PERSON", rf"(?U)\]\s*({_NAME})(?=\s*[|\n])", 0.85, "id_person", 1, ("]",)),
    Pattern("PERSON", rf"(?U)[\"'](?iu:{_longest_first(NAME_KEYS)})[\"']\s*:\s*[\"']((?:(?:dr|drg|dra|ir|prof|h|hj|tn|ny|sdr|sdri|bpk|bapak|ibu)\.?\s*)?{_NAME})(?=[\"'])", 0.9, "id_person", 1, (":",)),
    Pattern("PERSON", rf"(?U)\b(?iu:{_longest_first(NAME_CUES)})\s+({_NAME})", 0.8, "id_person", 1),
]


FOUND = ("entity_type", "start_pos", "end_pos", "value", "score", "recognizer")
NONE = "array<struct<entity_type:string,start_pos:bigint,end_pos:bigint,value:string,score:double,recognizer:string>>"
Score = Callable[[Column], Column]


def scored(spans: Column, pattern: Pattern, score: Score | None = None) -> Column:
    """Spans of one pattern as findings; those that score nothing go. ``score``: of a span (value, context), else the pattern's own."""
    own = score or (lambda x: F.lit(float(pattern.score)))
    fields = lambda x: (F.lit(pattern.entity), x["start_pos"], x["end_pos"], x["value"], F.round(own(x), 6).cast("double"), F.lit(pattern.recognizer))
    return F.filter(F.transform(spans, lambda x: F.struct(*[f.alias(n) for n, f in zip(FOUND, fields(x), strict=True)])), lambda x: x["score"] > 0)


def first_of_equal(found: Column) -> Column:
    """Of findings with equal spans the first."""
    spot = lambda x: F.struct(x["start_pos"], x["end_pos"])
    numbered = F.array_sort(F.transform(found, lambda x, i: F.struct(x["start_pos"], x["end_pos"], i.alias("i"), x.alias("x"))))
    differs = lambda all_: F.filter(all_, lambda y, i: (i == 0) | (spot(y["x"]) != spot(F.get(all_, F.greatest(i - 1, F.lit(0)))["x"])))
    return F.transform(bound(numbered, differs), lambda y: y["x"])


def rows_of(df: DataFrame, text: str, found: Column) -> DataFrame:
    """One row a finding beside the other columns."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.inline(found))


def where_digits(text: Column, parts: list[tuple[bool, Column]]) -> Column:
    """All findings of ``parts`` (whether they need EIGHT_DIGITS, findings), in order; neighbours that need them are asked for once."""
    some = lambda needed, found: F.when(text.rlike(EIGHT_DIGITS), found).otherwise(F.array().cast(NONE)) if needed else found
    return F.concat(*[some(needed, F.concat(*[found for _, found in run])) for needed, run in groupby(parts, key=lambda part: part[0])])


def general_found(text: Column, patterns: list[Pattern] | None = None) -> Column:
    return where_digits(text, [(p in LONG_NUMBERS, scored(located(text, p), p)) for p in patterns or GENERAL])


def general(df: DataFrame, text: str = "text", patterns: list[Pattern] | None = None) -> DataFrame:
    """Mail, phone, card, IP, URL and IBAN spans; pass some of GENERAL to prune recognizers before they run."""
    return rows_of(df, text, general_found(F.col(text), patterns))


def _calendar(code: Column, shift_women: bool) -> tuple[Column, Column, Column, Column]:
    """Day, month, in range, and the date of a ddmmyy code (null if the calendar lacks it)."""
    day, month, year = (F.substring(code, i, 2).cast("int") for i in (1, 3, 5))
    if shift_women:
        day = F.when(day > 40, day - 40).otherwise(day)
    full = F.when(year > 50, 1900 + year).otherwise(2000 + year)
    date = F.concat_ws("-", full, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")
    return day, month, day.between(1, 31) & month.between(1, 12), date


def nik_score(number: Column) -> Column:
    _, _, sane, date = _calendar(F.substring(number, 7, 6), True)
    born = F.when(~sane, -0.2).when(date.isNull(), 0.15).otherwise(0.3)
    return F.when(F.substring(number, 1, 2).isin(PROVINCES), F.least(F.lit(0.7) + born, F.lit(1.0))).otherwise(0.0)


def nik_found(text: Column) -> Column:
    p = Pattern("ID_NIK", SIXTEEN, 0.5, "nik")
    return scored(located(text, p), p, lambda x: bound(digits(x["value"]), nik_score))


def nik(df: DataFrame, text: str = "text") -> DataFrame:
    return rows_of(df, text, nik_found(F.col(text)))


def nik_parts(number: Column) -> Column:
    day, month, _, _ = _calendar(F.substring(number, 7, 6), True)
    year = F.substring(number, 11, 2).cast("int")
    return F.struct(
        F.substring(number, 1, 2).alias("province_code"), F.substring(number, 3, 2).alias("city_code"), F.substring(number, 5, 2).alias("district_code"), day.alias("birth_day"), month.alias("birth_month"),
        F.when(year > 50, 1900 + year).otherwise(2000 + year).alias("birth_year"), (F.substring(number, 7, 2).cast("int") > 40).alias("is_female"), F.substring(number, 13, 4).alias("sequence"),
    )


def kk_found(text: Column, as_of: str) -> Column:
    p = Pattern("ID_KK", SIXTEEN, 0.4, "kk")

    def score(x: Column) -> Column:
        def of(number: Column) -> Column:
            day, _, sane, date = _calendar(F.substring(number, 7, 6), False)
            when = F.when(~sane, -0.1).when(date.isNull(), 0.06).when(date <= F.lit(as_of).cast("date"), 0.2).otherwise(0.1)
            raw = F.lit(0.4) + F.when(contains_any(F.lower(x["context"]), KK_KEYWORDS), 0.3).otherwise(0.0) + when - F.when(day > 31, 0.2).otherwise(0.0)
            return F.when(F.substring(number, 1, 2).isin(PROVINCES), F.greatest(F.lit(0.0), F.least(raw, F.lit(0.95)))).otherwise(0.0)

        return bound(digits(x["value"]), of)

    return scored(located(text, p, 0, 50, 30), p, score)


def kk(df: DataFrame, as_of: str, text: str = "text") -> DataFrame:
    return rows_of(df, text, kk_found(F.col(text), as_of))


def npwp_found(text: Column) -> Column:
    """Numbers of 15 digits, then those of 16 that no 15-digit one covers."""
    old, new = Pattern("ID_NPWP", NPWP_OLD, 0.75, "npwp"), Pattern("ID_NPWP", NPWP_NEW, 0.5, "npwp")

    def fifteen(number: Column) -> Column:
        left = sum((F.substring(number, i + 1, 1).cast("int") * w for i, w in enumerate(NPWP_WEIGHTS)), F.lit(0)) % 11
        expected = F.when(left == 0, 0).otherwise(11 - left)
        check = (F.substring(number, 9, 1).cast("int") == expected) | (expected >= 10)
        return F.when(F.substring(number, 1, 2).isin(SUBJECTS), F.when(check, 0.9).otherwise(0.75)).otherwise(0.0)

    def sixteen(x: Column) -> Column:
        near = contains_any(F.lower(x["context"]), NPWP_KEYWORDS)
        moved = lambda n: F.when(n.startswith("0") & F.substring(n, 2, 2).isin(SUBJECTS), F.when(near, 0.9).otherwise(0.75)).when(near, 0.85).otherwise(0.5)
        return bound(digits(x["value"]), moved)

    longer = scored(located(text, new, 1, 50, 30), new, sixteen)
    covered = lambda x, by: F.exists(by, lambda y: (y["start_pos"] <= x["start_pos"]) & (y["end_pos"] >= x["end_pos"]))
    return bound(scored(located(text, old), old, lambda x: bound(digits(x["value"]), fifteen)), lambda kept: F.concat(kept, F.filter(longer, lambda x: ~covered(x, kept))))


def npwp(df: DataFrame, text: str = "text") -> DataFrame:
    return rows_of(df, text, npwp_found(F.col(text)))


def local_phone(value: Column) -> Column:
    number = F.regexp_replace(value, r"[^0-9+]", "")
    return F.when(number.startswith("+62"), F.concat(F.lit("0"), F.substring(number, 4, 100))).when(number.startswith("62"), F.concat(F.lit("0"), F.substring(number, 3, 100))).otherwise(number)


def id_phone_found(text: Column) -> Column:
    """Mobile patterns, then landline ones, in order; a hit that overlaps an accepted one is dropped."""

    def score(p: Pattern, mobile: bool) -> Score:
        def of(number: Column) -> Column:
            if mobile:
                raw = F.lit(p.score) + F.when(F.substring(number, 1, 4).isin(CARRIERS), 0.05).otherwise(-0.2) - F.when(F.length(number).between(10, 13), 0.0).otherwise(0.3)
                able = F.lit(True)
            else:
                area = number.rlike(f"^(?:{'|'.join(AREAS)})")
                raw = F.lit(p.score) + F.when(area, 0.1).otherwise(0.0) - F.when(F.length(number).between(9, 12), 0.0).otherwise(0.2)
                able = ~number.startswith("08")
            bounded = F.round(F.greatest(F.lit(0.0), F.least(raw, F.lit(1.0))), 6)
            return F.when(able & (bounded > 0.5), bounded).otherwise(0.0)

        return lambda x: bound(local_phone(x["value"]), of)

    every = F.concat(*[scored(located(text, p), p, score(p, p in MOBILE)) for p in MOBILE + LANDLINE])
    hits = lambda acc, x: F.exists(acc, lambda y: (x["start_pos"] < y["end_pos"]) & (x["end_pos"] > y["start_pos"]))
    return F.aggregate(every, F.array().cast(NONE), lambda acc, x: F.when(hits(acc, x), acc).otherwise(F.array_append(acc, x)))


def id_phone(df: DataFrame, text: str = "text") -> DataFrame:
    return rows_of(df, text, id_phone_found(F.col(text)))


def bpjs_found(text: Column) -> Column:
    p = Pattern("ID_BPJS", r"(?U)\b\d{4}[\s.\-]?\d{4}[\s.\-]?\d{5}\b", 0.75, "bpjs")

    def score(x: Column) -> Column:
        bad = lambda n: n.rlike(r"^(\d)\1{12}$") | (n == "0123456789012")
        near = contains_any(F.lower(x["context"]), BPJS_KEYWORDS)
        return bound(digits(x["value"]), lambda n: F.when(~near | bad(n), 0.0).when(n.startswith("0"), 0.85).otherwise(0.75))

    return scored(located(text, p, 0, 50, 30), p, score)


def bpjs(df: DataFrame, text: str = "text") -> DataFrame:
    return rows_of(df, text, bpjs_found(F.col(text)))


def birth_date_found(text: Column, as_of: str) -> Column:
    """Dates that a label or a person in the text makes birth dates."""
    shapes = [
        Pattern("DATE_OF_BIRTH", r"(?U)\b\d{1,2}[\s\-/]+[A-Za-z]{3,9}[\s\-/]+\d{4}\b", 0, "date_of_birth"),
        Pattern("DATE_OF_BIRTH", r"(?U)\b\d{1,2}[/\-]\d{1,2}[/\-]\d{4}\b", 0, "date_of_birth"),
        Pattern("DATE_OF_BIRTH", r"(?U)\b\d{4}[/\-]\d{1,2}[/\-]\d{1,2}\b", 0, "date_of_birth"),
    ]
    month_names = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    today = F.lit(as_of).cast("date")

    def score(no: int, label: Column) -> Score:
        def of(x: Column) -> Column:
            # the context ends with the match; a label counts on the match's own line, 30 characters back at most
            ahead = F.left(x["context"], F.length(x["context"]) - F.length(x["value"]))
            labelled = contains_any(F.substring_index(F.lower(ahead), "\n", -1), BIRTH_LABELS)

            def judged(parts: Column) -> Column:
                part = lambda i: F.get(parts, F.lit(i))
                month = F.try_element_at(month_names, F.lower(part(1))) if no == 0 else part(1).try_cast("int")
                year, day = (part(0), part(2)) if no == 2 else (part(2), part(0))

                def at(date: Column) -> Column:
                    recent = (date >= F.add_months(today, -24)) | ((F.year(date) == F.year(today)) & (F.month(date) == F.month(today)))
                    good = date.isNotNull() & (F.year(date) >= MIN_BIRTH_YEAR) & (date <= today) & (labelled | ~recent)
                    return F.when(~F.coalesce(good, F.lit(False)), 0.0).when(labelled, 0.95).when(label, 0.85).otherwise(0.65)

                whole = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
                return bound(F.when(month.isNotNull(), whole.try_cast("date")), at)

            return bound(F.regexp_extract_all(x["value"], F.lit(r"[0-9]+|[A-Za-z]+"), F.lit(0)), judged)

        return of

    person = text.rlike(r"(?U)\b[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}\b")
    every = lambda label: F.concat(*[scored(located(text, p, no, 30, 0), p, score(no, label)) for no, p in enumerate(shapes)])
    return bound(contains_any(F.lower(text), BIRTH_LABELS), lambda label: F.when(label | person, every(label)).otherwise(F.array().cast(NONE)))


def birth_date(df: DataFrame, as_of: str, text: str = "text") -> DataFrame:
    return rows_of(df, text, birth_date_found(F.col(text), as_of))


def person_found(text: Column) -> Column:
    """Names behind labels, record ids, JSON keys and cues; the first pattern counts where spans agree."""
    return first_of_equal(F.concat(*[scored(located(text, p), p) for p in PERSONS]))


def person(df: DataFrame, text: str = "text") -> DataFrame:
    return rows_of(df, text, person_found(F.col(text)))


def custom_patterns(rules: list[tuple[str, str, str]]) -> list[Pattern]:
    quote = lambda s: r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"
    regex = {"regex": lambda p: p, "word": lambda p: rf"\b{quote(p)}\b", "contains": quote, "exact": lambda p: rf"\A{quote(p)}\z"}
    return [Pattern(re.sub(r"[^A-Z0-9]+", "_", label.strip().upper()).strip("_") or "CUSTOM", f"(?iuU){regex[kind](p)}", 0.95, "custom") for label, kind, p in rules]


def custom_found(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """User patterns: (label, kind, pattern), kind one of regex, word, contains, exact; case is ignored, score 0.95, equal spans count once
    for the first rule. Labels become upper-case names."""
    return first_of_equal(F.concat(*[scored(located(text, p), p) for p in custom_patterns(rules)]))


def custom(df: DataFrame, rules: list[tuple[str, str, str]], text: str = "text") -> DataFrame:
    return rows_of(df, text, custom_found(F.col(text), rules))


#: All recognizers of ``scan`` by name: the findings of a text, given the date to judge by.
REGISTRY: dict[str, Callable[[Column, str], Column]] = {
    "general": lambda t, as_of: general_found(t), "nik": lambda t, as_of: nik_found(t), "kk": kk_found, "npwp": lambda t, as_of: npwp_found(t), "id_phone": lambda t, as_of: id_phone_found(t),
    "bpjs": lambda t, as_of: bpjs_found(t), "date_of_birth": birth_date_found, "id_person": lambda t, as_of: person_found(t),
}


def found_by(text: Column, as_of: str, only: list[str] | None = None) -> Column:
    """The findings of a text by all recognizers of REGISTRY, or ``only`` those named."""
    return where_digits(text, [(name in BY_NUMBER, REGISTRY[name](text, as_of)) for name in only or REGISTRY])


def scan(df: DataFrame, as_of: str, text: str = "text", rules: list[tuple[str, str, str]] | None = None, only: list[str] | None = None, entities: list[str] | None = None) -> DataFrame:
    """The recognizers of REGISTRY (or ``only`` those named) over one text column in one pass: raw spans, overlaps left in, of the entity types
    asked for (all by default)."""
    t = F.col(text)
    out = rows_of(df, text, F.concat(found_by(t, as_of, only), custom_found(t, rules)) if rules else found_by(t, as_of, only))
    return out.where(F.col("entity_type").isin(entities)) if entities else out
