"""Fill-in-middle transformation over run-length encoded character classes.

A text is stored as its maximal runs of one character class, each with the number of units that end up to and including it. A cut after ``k`` units is
found by a binary search of the run that holds it, and its offset follows by arithmetic; units are never listed, nor is a prefix of the text walked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialize, rows_of, text_or_empty, tidy

#: The sentinels of the result contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, those to transform and, of those, the ones with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 50, 80
#: Character classes.
SPACE, OTHER, SINGLE = 0, 1, 2
#: Code point ranges of white space, and of scripts written without it (each character a unit, where asked for).
SPACES = ((0x09, 0x0D), (0x20, 0x20))
UNSPACED = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x0E00, 0x0E7F))


@dataclass
class Runs:
    """Maximal runs of one class. ``ends``: code points up to and including each; ``units``: units that end up to and including it; ``classes``: its class."""

    ends: np.ndarray
    units: np.ndarray
    classes: np.ndarray

    @classmethod
    def of(cls, text: str, singles: bool = False) -> Runs:
        """A unit is white space (or none) with the other characters behind it; white space at the end is one of its own. With ``singles`` every character of
        an unspaced script ends a unit, and so do the other characters before it."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.full(len(points), OTHER, np.uint8)
        for ranges, kind in ((SPACES, SPACE), *([(UNSPACED, SINGLE)] if singles else [])):
            for low, high in ranges:
                kinds[(points >= low) & (points <= high)] = kind
        last = np.flatnonzero(np.r_[kinds[1:] != kinds[:-1], True][: len(kinds)])
        ends, own = last + 1, kinds[last]
        ending = np.where(own == SINGLE, np.diff(ends, prepend=0), (own == OTHER).astype(np.int64))
        if len(own) and own[-1] == SPACE:
            ending[-1] = 1
        return cls(ends, np.cumsum(ending), own)

    def count(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def offset(self, cut: int) -> int:
        """Code points before the end of the first ``cut`` units."""
        if cut == 0:
            return 0
        at = int(np.searchsorted(self.units, cut))
        if self.classes[at] == SINGLE:
            return int(self.ends[at] - (self.units[at] - cut))
        return int(self.ends[at])


def draws(doc_id, seed: int = 42) -> list[int]:
    """The first four groups of eight digits of the digest of seed and id, as numbers. An id that is null counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(text: str, doc_id, seed: int = 42, singles: bool = False) -> tuple[int, str, str, int | None, int | None]:
    """(units, form, output, code points of the prefix, of the middle); form is plain, psm or spm."""
    runs = Runs.of(text, singles)
    n = runs.count()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= TRANSFORMED:
        return n, "plain", text, None, None
    low, high = (runs.offset(c) for c in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", low, high - low
    return n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", low, high - low


def restore(output: str, form: str) -> str:
    """The text again, from output and form alone: no part holds a sentinel, and none begins within another string, so the first of each divides."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(first):
        raise ValueError(f"an output of form {form} begins with {first}")
    one, found, rest = output[len(first) :].partition(second)
    other, also, middle = rest.partition(MIDDLE)
    if not (found and also):
        raise ValueError("a sentinel is missing")
    return other + middle + one if form == "spm" else one + middle + other


def fill_in_middle(docs: DataFrame, seed: int = 42, singles: bool = False) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output.

    Whole texts of any length are cut; a null text is an empty one and plain, as is one that holds a sentinel. A null id draws as an empty one.
    Repeated rows each have their result, always the same; an empty table gives an empty result; other columns are ignored. Nothing is shuffled.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                made = [transform(text, i, seed, singles) for i, text in rows_of(part)]
                n, form, output, prefix, middle = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output)],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(lambda b: tidy(run(b)), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def middle_digests(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``fill_in_middle`` with digests in place of the output: output_sha256, restored_sha256 (the text rebuilt from output and form). Odd rows as there."""
    made = fill_in_middle(docs, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            digests = [(sha(output), sha(restore(output, form))) for output, form in rows_of(batch.select(["output", "form"]))]
            kept = [batch.column(name) for name in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([d[k] for d in digests], pa.string()) for k in (0, 1)]], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return materialize(made.mapInArrow(lambda b: tidy(run(b)), schema), "middles")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
c AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, coalesce(array_to_string(units[1:least(a, b)], ''), '') AS pre, coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS mid,
    coalesce(array_to_string(units[greatest(a, b) + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
