"""I-Match fingerprints with randomised lexicons.

Terms whose inverse document frequency lies in a band form the lexicon. Of a document's distinct lexicon terms, sorted, those in each of many
random subsets of the lexicon are hashed; the fingerprint lists the hashes. Subsets come in levels of falling density, so that texts of any
length have a level at which a subset holds about one of their terms; likeness is the share of equal hashes at that level.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, fetch, materialize, mix64, rows_of, text_or_empty, tidy

#: A subset of level i holds one term in 4 ** (i + 1); each level has so many subsets, each hash so many hexadecimal digits.
LEVELS, SUBSETS, DIGITS = 5, 32, 3
#: The band: document frequency as a share of all documents. The rarer end also ends where more than MOST_TERMS could be in the lexicon.
RAREST, COMMONEST, MOST_TERMS = 1e-4, 0.2, 1_000_000
#: Filled subsets from which a level is used, and words counted together before the shuffle.
FILLED, CHUNK_WORDS = 12, 3_000_000
NONE = "0" * DIGITS
#: Bytes of text aimed at in a range of ids, and the most ranges; a task reads its range batch by batch.
RANGE_BYTES, MOST_RANGES = 8 << 20, 20_000


class TermIds(WordIds):
    """Word -> hash of the word without marks around it."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.strip(b".,;:!?\"'()|#*%&$"))
        return h


_terms = TermIds()


def terms_of(text: str) -> np.ndarray:
    """The sorted hashes of the distinct terms of a text."""
    return np.unique(_terms.of(list(set(text.lower().encode().split()))))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, n): in how many documents a term occurs; counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            term, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(times.astype(np.int64))], ["term", "n"])

        for batch in batches:
            for (text,) in rows_of(batch):
                held.append(terms_of(text))
                n += len(held[-1])
                if n >= CHUNK_WORDS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return docs.select(text_or_empty().alias("text")).mapInArrow(lambda b: tidy(count(b)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


_power_table: list[np.ndarray] = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    """At least ``n`` powers of the base of the sequence hash, modulo 2 ** 64."""
    if len(_power_table[0]) < n:
        _power_table[0] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 4096), np.uint64(0x9E3779B97F4A7C15))].astype(np.uint64))
    return _power_table[0]


class Lexicon:
    """Sorted term hashes, and for each term the subsets that it is in."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms)
        self.value = mix64(self.terms ^ np.uint64(0xD6E8FEB86659FD93))
        term, subset = [], []
        for k in range(LEVELS * SUBSETS):
            salt = np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))
            term.append(np.flatnonzero(mix64(self.terms + salt) >> np.uint64(64 - 2 * (k // SUBSETS + 1)) == 0))
            subset.append(np.full(len(term[-1]), k, np.uint8))
        term, subset = np.concatenate(term), np.concatenate(subset)
        self.subset = subset[np.argsort(term, kind="stable")]
        self.end = np.cumsum(np.bincount(term, minlength=len(self.terms)))

    def fingerprint(self, text: str) -> str:
        """Fixed-width hexadecimal hashes of the subsets' sorted terms, zeros for subsets without a term of the text. A text without lexicon terms has the digest
        of its characters instead, so that equal texts, and no others, agree."""
        found = terms_of(text)
        at = np.searchsorted(self.terms, found)
        at = at[self.terms[np.minimum(at, len(self.terms) - 1)] == found] if len(self.terms) else at[:0]
        if not len(at):
            return "=" + hashlib.sha256(text.encode()).hexdigest()
        n = self.end[at] - np.where(at > 0, self.end[at - 1], 0)
        total = np.cumsum(n)
        subset = self.subset[np.arange(total[-1]) + np.repeat(self.end[at] - total, n)]
        # for each subset the polynomial hash of its terms in their order
        order = np.argsort(subset, kind="stable")
        count = np.bincount(subset, minlength=LEVELS * SUBSETS)
        filled, begin = np.flatnonzero(count), np.cumsum(count) - count
        codes = np.zeros(LEVELS * SUBSETS, np.uint16)
        if len(filled):
            power = _powers(int(count.max()))[np.arange(len(subset)) - np.repeat(begin, count)]
            hashes = np.add.reduceat(np.repeat(self.value[at], n)[order] * power, begin[filled])
            codes[filled] = mix64(hashes) % np.uint64(16**DIGITS - 1) + np.uint64(1)
        return np.frombuffer(codes.astype(">u2").tobytes().hex().encode(), np.uint8).reshape(-1, 4)[:, 4 - DIGITS :].tobytes().decode()


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of equal hashes among the subsets that either text fills, at the sparsest level that they fill enough."""
    if a == b:
        return 1.0
    if a[:1] == "=" or b[:1] == "=":
        return 0.0
    best = 0.0
    for level in reversed(range(LEVELS)):
        of = slice(level * SUBSETS * DIGITS, (level + 1) * SUBSETS * DIGITS)
        x, y = (np.frombuffer(s[of].encode(), f"S{DIGITS}") for s in (a, b))
        filled = int(((x != NONE.encode()) | (y != NONE.encode())).sum())
        if filled:
            best = float(((x == y) & (x != NONE.encode())).sum() / filled)
        if filled >= FILLED:
            break
    return best


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs`` (doc_id, text).

    The next document is that of the largest smaller doc_id, after the smallest the largest; a single document follows itself. A null text
    is empty; texts without lexicon terms match equal texts only. Null doc_ids are smallest, rows of one doc_id follow each other in the
    order of a hash of their texts. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), text_or_empty().alias("text"))
    n = keyed.count()
    df = document_frequencies(docs).where(F.col("n") <= max(1, COMMONEST * n))
    df = materialize(df, "document-frequencies")
    total = df.agg(F.sum("n")).first()[0] or 0
    least = max(RAREST * n, total / MOST_TERMS)  # terms this frequent are MOST_TERMS at most
    terms = fetch(df.where(F.col("n") >= least).select("term"))["term"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(Lexicon(terms))  # made once, some 40 bytes for each of MOST_TERMS terms at most

    # ranges of ids, and for each the largest id, which is also wanted at the end of the range before it
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(64, math.ceil(size / RANGE_BYTES)))
    bounds = np.unique(np.array(keyed.stat.approxQuantile("d", [i / ranges for i in range(1, ranges)], 0.25 / ranges), float).astype(np.int64)) if n else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def range_of(d: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, d.to_numpy(np.int64)).astype(np.int32))

    tops = keyed.select("d").groupBy(range_of("d").alias("range")).agg(F.max("d").alias("top")).toPandas().sort_values("range", ascending=False)  # a row a range
    edge = dict(zip(tops["top"].tolist(), np.roll(tops["range"].to_numpy(), 1).tolist(), strict=True))

    @F.pandas_udf("array<int>")
    def targets(d: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, d.to_numpy(np.int64))
        return pd.Series([[int(r), int(edge[x])] if x in edge else [int(r)] for r, x in zip(own, d.tolist(), strict=True)])

    dealt = keyed.select("d", "text", F.xxhash64("text").alias("th"), F.posexplode(targets("d")).alias("extra", "range"))
    ordered = dealt.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "extra", F.desc("d"), "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        names = ["d", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        last: tuple | None = None
        for batch in batches:
            rows = []
            for r, extra, d, text in rows_of(batch):
                own = lexicon.fingerprint(text)
                if last is not None and last[0] == r:
                    _, d0, text0, own0 = last
                    changed = edited(text0, text)
                    other = lexicon.fingerprint(changed)
                    rows.append((d0, len(text0), hashlib.sha256(changed.encode()).hexdigest(), own0, other, likeness(own0, other), likeness(own0, own)))
                last = None if extra else (r, d, text, own)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    out = ordered.select("range", "extra", "d", "text").mapInArrow(lambda b: tidy(run(b)), "d long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(F.when(F.col("d") != -(2**63), F.col("d")).alias("doc_id"), *out.columns[1:])
