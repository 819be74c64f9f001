"""Texts that can hold no finding aren't searched: nothing is lost by it."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from veilspark.functions.text import Pattern, located
from veilspark.operators import recognizers as r
from veilspark.plans.detection import AS_OF, docs

from .conftest import SF


def texts() -> list[str]:
    dice = random.Random(11)
    shapes = ["0812-3456-789", "+62 812 3456 789", "(021) 555-123", "021-555 123", "3171012345670001", "31.71.01 234567-0001", "01.234.567.8-901.000", "0001234567890", "4111111111111111", "4111 1111 1111 1111", "555-123-4567", "a@b.co", "http://x.id/a", "HTTPS://X",
              "1:2:3:4:5:6:7:8", "10.0.0.1", "Nama: Budi Santoso", "name = Siti", "] Budi |", '"nama": "Siti Rahayu"', "pasien Budi", "1234567", "12 34 5x", "٠٨١٢٣٤٥٦٧٨٩", "०८१२-३४५६-७८९", "0812 3456 789", "é", "BPJS", "x" * 30, "\n"]
    return [dice.choice(["", " ", ", ", "\n"]).join(dice.choice(shapes) for _ in range(dice.randrange(5))) for _ in range(500)] + shapes


def test_nothing_is_lost_by_what_a_match_needs(spark):
    df = spark.createDataFrame(list(enumerate([*texts(), "", None])), "id int, text string")
    text = F.col("text")
    plain = lambda p: located(text, Pattern(p.entity, p.regex, p.score, p.recognizer, p.group))
    patterns = [p for p in [*r.GENERAL, *r.PERSONS] if p.needs]
    assert len(patterns) == 6
    for row in df.select(*[located(text, p).alias(f"a{n}") for n, p in enumerate(patterns)], *[plain(p).alias(f"b{n}") for n, p in enumerate(patterns)]).collect():
        assert row[: len(patterns)] == row[len(patterns) :]
    every = F.concat(*[r.REGISTRY[name](text, AS_OF) for name in r.BY_NUMBER], *[r.scored(located(text, p), p) for p in r.LONG_NUMBERS])
    guarded = F.concat(r.found_by(text, AS_OF, r.BY_NUMBER), r.general_found(text, r.LONG_NUMBERS))
    got = df.select(every.alias("a"), guarded.alias("b"), text.rlike(r.EIGHT_DIGITS).alias("c")).collect()
    assert all(x.a == x.b for x in got) and sum(len(x.a) for x in got) > 300 and sum(not x.c for x in got if x.c is not None) > 50


def test_counts_of_the_whole_scan_by_plain_search(spark):
    """Counts of general findings in documents are those of Python's own expressions."""
    df = docs(spark, SF)
    (name,) = [c for c in df.columns if c == "text"]
    got = Counter({x.entity_type: x.n for x in r.scan(df, AS_OF, only=["general"]).groupBy("entity_type").agg(F.count("*").alias("n")).collect()})
    want: Counter = Counter()
    whole = [x[0] or "" for x in df.select(name).collect()]
    for p in r.GENERAL:
        flags = re.IGNORECASE if p.regex.startswith("(?iu") else 0
        found = re.compile(re.sub(r"^\(\?[iuU]+\)", "", p.regex), flags)
        want[p.entity] += sum(1 for t in whole for _ in found.finditer(t))
    assert got == Counter({k: n for k, n in want.items() if n}) and sum(want.values()) > 0
