"""Cases of the fourth round's findings: matching without shuffles, values of their own scope, leaks of files with many originals, exact round trips."""

import hashlib
import hmac
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.operators import matching, protect, protection
from veilspark.plans import QUERIES
from veilspark.plans.inputs import KEY

#: Bounds of an automaton and of a broadcast table, so that each way is taken.
WAYS = {"automaton": (10_000, 10_000), "table": (0, 10_000), "join": (0, 0)}


@pytest.mark.parametrize("way", WAYS)
def test_values_of_a_scope(spark, way):
    """A value counts in texts of its own scope, whichever way it is looked for; empty texts and ones longer than others lie between."""
    most, table = WAYS[way]
    r = random.Random(2)
    texts = [(i, r.choice(["a", "b", "", None]), "".join(r.choices(["Budi", "budi", "é", "É", "😀", "x", " ", "ana"], k=r.randint(0, 30)))) for i in range(150)]
    values = [("a", "budi"), ("b", "BUDI"), ("b", "ana"), ("", "é"), ("a", "é😀"), (None, "x"), ("c", "ana"), ("a", "anaana"), ("a", ""), ("a", None), ("a", "budi")]
    want = Counter()
    for i, scope, text in texts:
        for s, v in {(s, v) for s, v in values if v and s is not None and s == scope}:
            want.update((i, v, at, at + len(v)) for at in range(len(text) - len(v) + 1) if matching.fold(text[at : at + len(v)]) == matching.fold(v))
    df = spark.createDataFrame(texts, "id int, project string, text string").repartition(2)
    known = spark.createDataFrame(values, "project string, value string")
    got = matching.literal_matches(df, "id", known, most=most, table=table, scope="project")
    assert Counter(map(tuple, got.select("id", "value", "start_pos", "end_pos").collect())) == want and len(want) > 50
    once = matching.literal_matches(df, "id", known, most=most, table=table, scope="project", places=False)
    assert Counter(map(tuple, once.collect())) == Counter({k[:2] for k in want})


@pytest.mark.parametrize("hyphens", [True, False])
def test_terms_without_shuffle(spark, hyphens):
    """a table of terms gives the same rows broadcast and joined; broadcast, nothing of the texts is shuffled. One term may have two types, and rows of one key are texts apart."""
    parts = ["Budi", "budi", "ana", "anana", "-", "_", " ", "é", "é", "٣", "😀", "\n"]
    r = random.Random(3)
    texts = [(i, "".join(r.choices(parts, k=r.randint(0, 40)))) for i in range(100)] + [(200, "budi\n"), (201, "BUDI\r\n"), (202, "budi\n\n"), (203, "Budi"), (204, None), (205, "")]
    terms = [("budi", "word", "A", False), ("budi", "word", "B", False), ("Budi", "exact", "C", True), ("BUDI", "exact", "D", None), ("anana", "contains", "E", False), ("é", "word", "F", False), ("-", "word", "G", False)]
    df = spark.createDataFrame(texts, "id int, text string")
    known = spark.createDataFrame(terms, "term string, kind string, entity_type string, case_sensitive boolean")
    ways = [matching.term_matches(df, "id", known, hyphens=hyphens, table=table) for table in (matching.TABLE_SIZE, 0)]
    found = [Counter(map(tuple, w.collect())) for w in ways]
    assert found[0] == found[1] and {k[1] for k in found[0]} >= set("ABCDEF")
    assert {k[0] for k in found[0] if k[1] == "D"} >= {200, 201, 203} and (202, "D") not in {k[:2] for k in found[0]}
    assert "Exchange" not in ways[0]._jdf.queryExecution().executedPlan().toString()
    twice = matching.term_matches(spark.createDataFrame([(1, "budi"), (1, "budi")], "id int, text string"), "id", known.where("entity_type = 'A'"))
    assert twice.count() == 2


def test_leaks_of_crowded_files(spark):
    """files with many originals are matched, not compared pair by pair; both ways give what plain comparison gives."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abAB é[]", k=r.randint(0, 4)))
    own = [(r.choice([1, 2, 3, None]), "P", r.choice([word(), word(), word(), None])) for _ in range(120)] + [(4, "P", ""), (4, "P", "x"), (4, "P", "xyz")]
    found = [(r.choice([1, 2, 3, 9, None]), "P", r.choice([word(), word() + word(), "<" + word() + ">", None])) for _ in range(300)] + [(4, "P", v) for v in ("", "q", "x", "Y", None)]

    def kind(file, value, partial):
        originals = {o.lower() for f, _, o in own if f == file and f is not None and o is not None}
        low = None if value is None else value.lower()
        if low in originals:
            return "RESIDUAL"
        if partial and low is not None and any(o != low and (o in low or low in o) for o in originals):
            return "INCOMPLETE"
        return "INTRODUCED" if value and (value[0] + value[-1] in ("[]", "<>") or "_MASKED" in value.upper()) else "MISSED"

    columns = "file int, entity_type string, value string"
    protected, original = spark.createDataFrame(found, columns).repartition(3), spark.createDataFrame(own, columns)
    for partial in (True, False):
        want = Counter((f, v, kind(f, v, partial)) for f, _, v in found)
        for few in (1_000, 0):
            got = protect.leaks(protected, original, "file", partial, few)
            assert Counter((x.file, x.value, x.leak) for x in got.collect()) == want
        assert len({k[2] for k in want}) == 3 + partial
    crowded = spark.range(70).select(F.lit(1).alias("file"), F.lit("P").alias("entity_type"), F.concat(F.lit("Name "), "id").alias("value"))
    plan = protect.leaks(protected, crowded, "file")._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan  # matched, not compared one by one


def test_rescan_of_a_scope_once(spark):
    """the scope is part of the search, not of a join of all findings behind it; a text that stands in two projects is named once for each value."""
    texts = spark.createDataFrame([(1, "a", "to budi"), (1, "b", "budi again"), (2, "b", "budi"), (3, "c", "budi")], "id int, project string, text string")
    values = spark.createDataFrame([("a", "Budi"), ("b", "Budi")], "project string, value string")
    found = protection.rescan(texts, "id", "2024-06-15", values, scope="project", only=["general"]).where("leakage_type = 'untokenized_value'").select("id", "value")
    assert Counter(map(tuple, found.collect())) == Counter({(1, "Budi"): 1, (2, "Budi"): 1})
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_short_texts_are_searched_together():
    """a thousand short texts are one search, not a thousand; no place lies over a seam, and each has its text's row."""
    texts = [f"to name-{i:04d}" for i in range(1_000)] + ["", "n", "ame-0001"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.nulls(len(texts), pa.string())], ["id", "text", "_scope"])
    ((keys, run),) = matching._runs_of(batch, False)
    values = ["NAME-0007", "name-0999", "name-0001", "9999"]
    starts, ends, rows = matching.Table(values, [None] * len(values), False).places(run)
    found = sorted(zip(keys.take(pa.array(run.rows(starts))).to_pylist(), [values[r] for r in rows], (starts - run.begins[run.rows(starts)]).tolist(), strict=True))
    assert found == [(1, "name-0001", 3), (7, "NAME-0007", 3), (999, "name-0999", 3)] and np.all(ends - starts == 9)


def test_exact_round_trip(spark, tmp_path):
    """F8: a mail address comes back as it was written, though ones that differ in case share a token; ones whose tokens begin alike are told apart (F7)."""
    seen, pair = {}, None
    for name in (f"u{i}@x.id" for i in range(1_000_000)):
        six = hmac.new(KEY, f"EMAIL|{name}".encode(), hashlib.sha256).hexdigest()[:6]
        if six in seen:
            pair = seen[six], name
            break
        seen[six] = name
    texts = ["ke Ana@x.id, ana@X.ID \U0001f600 dan ANA@x.id", "ana@x.id", f"{pair[0]} dan {pair[1].upper()}", f"{pair[1]}, {pair[0]}", "tanpa", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    back = {x.id: (x.text, x.restored, x.unresolved) for x in QUERIES["rs03_round_trip"](spark, str(tmp_path)).collect()}
    assert back == {i: (x or "", (x or "").count("@"), 0) for i, x in enumerate(texts)}
    tokens = Counter(x.token for x in QUERIES["rs01_token_spans"](spark, str(tmp_path)).collect())
    assert sorted(tokens.values()) == [2, 2, 4]
