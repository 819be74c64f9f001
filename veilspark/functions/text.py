"""Text expressions: spans of regular expressions, value normalisation, keyed hashes and replacements."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A regular expression of one entity type. ``group``: the capture whose span counts (its text must end the match if it isn't 0); what has
    to follow it is a look-ahead at the end. ``needs``: texts of which every match holds one, so that other texts aren't searched."""

    entity: str
    regex: str
    score: float
    recognizer: str = "regex"
    group: int = 0
    needs: tuple[str, ...] = ()

    @property
    def of_match(self) -> str:
        """The expression for a match by itself, with nothing behind it."""
        return re.sub(r"\(\?=[^()]*\)$", "", self.regex)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Matches of a text whose ends are summed in one go; longer lists are summed part by part. Characters of a block of a text that is read at many places.
PART, BLOCK = 512, 4096
SPAN = "array<struct<no:int,start_pos:bigint,end_pos:bigint,value:string,context:string>>"


def blocks(text: Column) -> Column:
    """``text`` as an array of blocks, cut in one pass: a place in it is then found by arithmetic, while ``substring`` walks there from the text's beginning."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def piece(cut: Column, start: Column, length: Column) -> Column:
    """``length`` characters from place ``start`` (from 0) of a text in blocks; what lies beyond its end is left out, and no length gives an empty text."""
    shift = BLOCK.bit_length() - 1
    first, last = F.shiftright(start, shift), F.shiftright(start + F.greatest(length, F.lit(1)) - 1, shift)
    near = F.array_join(F.slice(cut, first.cast("int") + 1, (last - first).cast("int") + 1), "")
    return F.substring(near, start.bitwiseAND(F.lit(BLOCK - 1)).cast("int") + 1, length.cast("int"))


def located(text: Column, pattern: Pattern, no: int = 0, before: int = 0, behind: int = 0) -> Column:
    """The spans of ``pattern`` in one text, as an array of SPAN: ``context`` is the text from ``before`` characters before a match to ``behind``
    characters after it (null if neither is asked for).

    A match ends behind the gaps and matches before it; all happens within the row, so no row is shuffled and no text copied. The cost grows with the text and its
    matches, not with their product: sums are taken part by part, and contexts are read from blocks.
    """
    gaps = F.transform(F.split(text, pattern.regex, -1), F.length)
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0)), gaps, lambda m, g: F.struct(m.alias("value"), g.cast("long").alias("gap")))
    width = lambda x: x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0))

    def span(end: Column, match: Column, cut: Column) -> Column:
        value = F.regexp_extract(match, pattern.of_match, pattern.group) if pattern.group else match
        context = around(cut, end - F.length(match), end, before, behind) if before or behind else F.lit(None).cast("string")
        # a captured value ends its match
        return F.struct(F.lit(no).alias("no"), (end - F.length(value)).alias("start_pos"), end.alias("end_pos"), value.alias("value"), context.alias("context"))

    def step(acc: Column, x: Column, cut: Column) -> Column:
        end = acc["at"] + width(x)
        grown = F.struct(end.alias("at"), F.array_append(acc["spans"], span(end, x["value"], cut)).alias("spans"))
        return F.when(x["value"].isNull(), acc).otherwise(grown)

    def every(all_: Column, cut: Column) -> Column:
        part = lambda i: F.slice(all_, i * PART + 1, F.lit(PART))
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PART).cast("int")), lambda i: F.aggregate(part(i), F.lit(0).cast("long"), lambda acc, x: acc + width(x)))
        # where each part begins: sums of a few parts, not of all matches before
        first = lambda of: F.transform(of, lambda _, i: F.aggregate(F.slice(of, F.lit(1), i), F.lit(0).cast("long"), lambda acc, x: acc + x))
        start = lambda at: F.struct(at.alias("at"), F.array().cast(SPAN).alias("spans"))
        firsts = F.when(F.size(all_) <= PART, F.array(F.lit(0).cast("long"))).otherwise(bound(sums, first))
        return F.flatten(F.transform(firsts, lambda at, i: F.aggregate(part(i), start(at), lambda acc, x: step(acc, x, cut), lambda acc: acc["spans"])))

    found = bound(pairs, lambda all_: bound(blocks(text), lambda cut: every(all_, cut))) if before or behind else bound(pairs, lambda all_: every(all_, F.array(F.lit(""))))
    hit = text.rlike(pattern.regex)
    if pattern.needs:
        hit = reduce(Column.__or__, [text.contains(n) for n in pattern.needs]) & hit
    return F.when(hit, found).otherwise(F.array().cast(SPAN))


def find_spans(df: DataFrame, text: str, patterns: list[Pattern], before: int = 0, behind: int = 0) -> DataFrame:
    """One row a match: the other columns of ``df`` and entity_type, start_pos, end_pos, value, score, recognizer, pattern_no, and where it
    is asked for the context. Offsets are code points, the end exclusive."""
    rest = [c for c in df.columns if c != text]
    (m,) = [n for n in ("_m", "__m", "___m") if n not in rest][:1]
    found = F.concat(*[located(F.col(text), p, no, before, behind) for no, p in enumerate(patterns)])

    def pick(of) -> Column:
        out = F.lit(of(patterns[0]))
        for no, p in enumerate(patterns[1:], 1):
            out = F.when(F.col(f"{m}.no") == no, F.lit(of(p))).otherwise(out)
        return out

    return df.select(*rest, F.explode(found).alias(m)).select(
        *rest, pick(lambda p: p.entity).alias("entity_type"), f"{m}.start_pos", f"{m}.end_pos", f"{m}.value", pick(lambda p: float(p.score)).alias("score"),
        pick(lambda p: p.recognizer).alias("recognizer"), F.col(f"{m}.no").alias("pattern_no"), *([f"{m}.context"] if before or behind else []),
    )


def around(cut: Column, start: Column, end: Column, before: int, behind: int) -> Column:
    """The text from ``before`` characters before a span to ``behind`` characters after it, of a text in blocks."""
    first = F.greatest(start - before, F.lit(0))
    return piece(cut, first, end + behind - first)


def contains_any(text: Column, words) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def collapse(value: Column) -> Column:
    """Trimmed, lower-cased, runs of white space as one space."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))), r"(?U)\s+", " ")


def folded(value: Column) -> Column:
    """Text in which case doesn't count: by way of the capitals, so that a sharp s and a double one agree."""
    return F.lower(F.upper(value))


@cache
def _compositions() -> tuple[str, str, str]:
    """From the character database: a JSON map from letters with marks, in each order of marks that counts as the same, to the composed letter; and the characters that have another
    one in their place, with those."""
    pairs, before, behind = {}, "", ""
    for point in range(0xA0, 0x2FA1E):
        c = chr(point)
        apart, together = unicodedata.normalize("NFD", c), unicodedata.normalize("NFC", c)
        if len(apart) > 1 and together == c and not 0xAC00 <= point <= 0xD7A3:
            for marks in permutations(apart[1:]):
                if unicodedata.normalize("NFC", spelt := apart[0] + "".join(marks)) == c:
                    pairs[spelt] = c
        elif len(together) == 1 and together != c:
            before, behind = before + c, behind + together
    # a composed letter may still take a mark: é and a dot below
    for spelt, c in list(pairs.items()):
        for mark in {x for k in pairs for x in k[1:]} if len(spelt) == 2 else ():
            more = unicodedata.normalize("NFC", c + mark)
            if len(more) == 1:
                pairs[c + mark] = more
    return json.dumps(pairs), before, behind


def composed(value: Column) -> Column:
    """``value`` with letters and the marks behind them as composed characters (NFC), so that both ways of writing a name agree. Only texts with a mark, or with a character that stands for
    another one, are looked into. Hangul that is spelt in single letters stays so, as do a vowel sign that is made
    of several signs and a letter with marks that no one character has."""
    pairs, before, behind = _compositions()
    known = F.from_json(F.lit(pairs), "map<string,string>")
    marked = r"(?s)\P{M}\p{M}*|\p{M}+"

    def one(x: Column) -> Column:
        """A letter with its marks: composed at once, else with the first mark."""
        first = F.try_element_at(known, F.left(x, F.lit(2)))
        part = F.when(first.isNotNull(), F.concat(first, F.substring(x, F.lit(3), F.length(x)))).otherwise(x)
        return F.when(F.length(x) == 1, x).otherwise(F.coalesce(F.try_element_at(known, x), part))

    joined = lambda v: F.array_join(F.transform(F.regexp_extract_all(v, F.lit(marked), F.lit(0)), one), "")
    into = bound(F.translate(value, before, behind), lambda v: F.when(v.rlike(r"\p{M}"), joined(v)).otherwise(v))
    # marks and characters that stand for others begin at U+0300
    return F.when(value.rlike(r"[^\x00-\u02ff]"), into).otherwise(value)


def normalise_value(entity: Column, value: Column) -> Column:
    """The form in which two values count as the same, whatever the case and whether their characters are composed."""

    def form(bare: Column) -> Column:
        number = F.regexp_replace(bare, r"[^0-9+]", "")
        phone = F.when(number.startswith("0"), F.concat(F.lit("+62"), F.substring(number, 2, 1000))).when(number.startswith("62"), F.concat(F.lit("+"), number)).otherwise(number)
        return F.when(entity == "EMAIL", folded(bare)).when(entity.isin("PHONE_NUMBER", "ID_PHONE"), phone).otherwise(F.regexp_replace(folded(bare), r"(?U)\s+", " "))

    return bound(F.regexp_replace(composed(value), r"(?U)^\s+|\s+$", ""), form)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 as lowercase hexadecimal, of two sha2 calls and two padded keys."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in key).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def value_hmac(entity: Column, value: Column, key: bytes) -> Column:
    return hmac_sha256(F.concat(entity, F.lit("|"), normalise_value(entity, value)), key)


def mask(value: Column) -> Column:
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2))))


def generalise(entity: Column, value: Column) -> Column:
    number = F.regexp_replace(value, r"[^0-9.]", "").try_cast("double")
    size = F.when(number >= 1e9, "[BILLIONS]").when(number >= 1e6, "[MILLIONS]").when(number >= 1e3, "[THOUSANDS]").otherwise("[AMOUNT]")
    return (
        F.when(entity == "DATE_OF_BIRTH", F.when(F.length(value) >= 4, F.left(value, F.lit(4))).otherwise("[DATE]"))
        .when(entity == "ADDRESS", "[ADDRESS]").when(entity.isin("SALARY", "TRANSACTION_VALUE", "PRICING"), size).otherwise(F.concat(F.lit("["), entity, F.lit("]")))
    )


def pseudonym(entity: Column, value: Column, key: bytes) -> Column:
    h = F.left(value_hmac(entity, value, key), F.lit(8))
    return (
        F.when(entity == "PERSON", F.concat(F.lit("Person_"), F.upper(h))).when(entity == "EMAIL", F.concat(F.lit("user_"), h, F.lit("@redacted.local")))
        .when(entity == "ORGANIZATION", F.concat(F.lit("Org_"), F.upper(h))).otherwise(F.concat(entity, F.lit("_"), F.upper(h)))
    )


def treated(treatment: Column, entity: Column, value: Column, token: Column, key: bytes) -> Column:
    """The replacement of a value under one of the treatments; unknown ones give the category."""
    category = F.concat(F.lit("["), entity, F.lit("]"))
    return (
        F.when(treatment == "TOKEN", token).when(treatment == "REDACT", "[REDACTED]").when(treatment == "MASK", mask(value)).when(treatment == "KEEP", value)
        .when(treatment == "GENERALIZE", generalise(entity, value)).when(treatment == "PSEUDONYM", pseudonym(entity, value, key)).otherwise(category)
    )


def splice(text: Column, edits: Column) -> Column:
    """``text`` with non-overlapping ``edits`` (array of struct start_pos, end_pos, replacement) put in, in one pass: what lies between them is read from blocks. Invalid spans are
    skipped; a replacement that is null makes the text null."""

    def joined(cut: Column, good: Column, n: Column) -> Column:
        end = lambda i: F.coalesce(F.get(good, i)["end_pos"], F.lit(0)).cast("long")
        parts = F.transform(good, lambda e, i: bound(end(i - 1), lambda last: F.concat(piece(cut, last, e["start_pos"] - last), e["replacement"])))
        rest = bound(end(F.size(good) - 1), lambda last: piece(cut, last, n - last))
        whole = F.concat(F.array_join(parts, ""), rest)
        return F.when(F.exists(good, lambda e: e["replacement"].isNull()), F.lit(None).cast("string")).otherwise(whole)

    # the length is bound: it is counted anew wherever it is named
    def put(n: Column) -> Column:
        valid = F.filter(F.array_sort(edits), lambda e: (e["start_pos"] >= 0) & (e["start_pos"] < e["end_pos"]) & (e["end_pos"] <= n))
        return bound(valid, lambda good: F.when(F.size(good) == 0, text).otherwise(bound(blocks(text), lambda cut: joined(cut, good, n))))

    return bound(F.length(text), put)


def length_bucket(n: Column) -> Column:
    out = F.when(n <= 0, "0")
    for limit, name in ((100, "<100"), (1000, "<1k"), (10_000, "<10k"), (100_000, "<100k"), (512_000, "<512k")):
        out = out.when(n < limit, name)
    return out.otherwise(">=512k")


#: Patterns and labels for log lines, in order.
LOG_PATTERNS = [
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"), (r"\b(?:\+62|62|0)[\s.-]?\d{2,4}[\s.-]?\d{3,4}[\s.-]?\d{3,4}\b", "[PHONE_REDACTED]"),
    (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE_REDACTED]"), (r"\b\d{16}\b", "[NIK_REDACTED]"), (r"\b\d{2}\.\d{3}\.\d{3}\.\d[-]?\d{3}\.\d{3}\b", "[NPWP_REDACTED]"),
    (r"\b\d{4}[\s.-]?\d{4}[\s.-]?\d{4}[\s.-]?\d{4}\b", "[CC_REDACTED]"), (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP_REDACTED]"),
]


def redacted_line(line: Column) -> Column:
    """A log line without the values that its patterns know."""
    for pattern, label in LOG_PATTERNS:
        line = F.regexp_replace(line, f"(?U){pattern}", label)
    return line


def content_hash(value: Column) -> Column:
    """SHA-256 of a text's bytes, in hexadecimal digits."""
    return F.sha2(value.cast("binary"), 256)
