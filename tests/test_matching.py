"""Many values in many texts, by an automaton and by hashes, against plain search; terms of a table against the expressions of listed ones."""

import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilspark.operators import matching, protect, protection, terms

WAYS = [matching.AUTOMATON_CHARS, 0]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    parts = ["Budi", "budi santoso", "ANNA", "ana", "é", "É", "ß", "SS", "😀", " ", "-", "x", "\n", "İ", "ananas"]
    rows = [(i, "".join(r.choices(parts, k=r.randint(0, 40)))) for i in range(120)]
    return [*rows, (200, None), (201, ""), (7, "Budi again, of a repeated key"), (None, "anana")]


VALUES = ["budi", "Budi Santoso", "ana", "anana", "ANA", "é", "😀x", "ss", "x -", "i", "İ", "ananas", "", None, "never there"]


@pytest.mark.parametrize("most", WAYS)
@pytest.mark.parametrize("sensitive", [True, False])
def test_literal_matches(spark, texts, most, sensitive):
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    values = spark.createDataFrame([(v,) for v in VALUES], "value string")
    same = (lambda t: t) if sensitive else matching.fold
    want = Counter()
    for i, t in texts:
        for v in {v for v in VALUES if v} if t else ():
            for s in range(len(t) - len(v) + 1):
                if same(t[s : s + len(v)]) == same(v):
                    e = s + len(v)
                    want[i, v, s, e, t[s:e], t[s - 1 : s] if s else "", t[e : e + 2], len(t) - e] += 1
    got = matching.literal_matches(df, "id", values, case_sensitive=sensitive, most=most)
    assert got.columns == ["id", "value", "start_pos", "end_pos", "match", "before", "behind", "rest"] and Counter(map(tuple, got.collect())) == want
    once = matching.literal_matches(df, "id", values, case_sensitive=sensitive, places=False, most=most).collect()
    assert Counter(map(tuple, once)) == Counter({(k[0], k[1]) for k in want})
    nothing = matching.literal_matches(df, "id", values.where("false"), case_sensitive=sensitive, most=most)
    assert nothing.count() == 0 and matching.literal_matches(df.where("false"), "id", values, most=most).count() == 0


def test_values_across_stretches(spark):
    """A text of several stretches: values lie over their seams, one longer than the others by far."""
    long = "".join(random.Random(1).choices("abcd", k=5_000))
    text = "z" * (matching.STRETCH - 3) + "needle" + "z" * (matching.STRETCH - 2_000) + long + "z" * 700_000 + "needle"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    values = spark.createDataFrame([("needle",), (long,), ("zneedle",), ("absent",)], "value string")
    found = [Counter((x.value[:9], x.start_pos) for x in matching.literal_matches(df, "id", values, most=most).collect()) for most in WAYS]
    first = matching.STRETCH - 3
    assert found[0] == found[1] == Counter({("needle", first): 1, ("needle", len(text) - 6): 1, ("zneedle", first - 1): 1, ("zneedle", len(text) - 7): 1, (long[:9], text.index(long)): 1})


def test_hundred_thousand_terms(spark):
    """One pass, whatever the number of terms."""
    names = spark.range(100_000).select(F.concat(F.lit("name-"), F.col("id"), F.lit("!")).alias("value"))
    docs = spark.range(2_000).select("id", F.concat(F.lit("to NAME-"), F.col("id") * 50, F.lit("! and name-"), F.col("id") * 7 + 90_000, F.lit("!")).alias("text"))
    for most in (matching.AUTOMATON_CHARS, 0):
        got = matching.literal_matches(docs, "id", names, places=False, most=most)
        assert got.agg(F.count("*"), F.count_distinct("id")).first() == (2_000 + sum(i * 7 + 90_000 < 100_000 and i * 7 + 90_000 != i * 50 for i in range(2_000)), 2_000)


@pytest.mark.parametrize("hyphens", [True, False])
def test_terms_of_a_table(spark, texts, hyphens):
    """A table of terms gives what the same terms give as expressions."""
    listed = [
        {"term": t, "kind": k, "entity_type": f"T{n}", "case_sensitive": n % 3 == 0}
        for n, (t, k) in enumerate([("budi", "word"), ("ana", "contains"), ("anana", "contains"), ("Budi", "exact"), ("é", "word"), ("-x", "word"), ("x", "word"), ("ANNA", "exact"), ("😀", "contains"), ("ß", "word")])
    ]
    more = [(300, "Budi"), (301, "budi\n"), (302, "Budi x-budi budi-x budi"), (303, "x -x- x"), (304, "ananananana"), (305, "Budi\r\n"), (306, "BUDI_ budié ébudi é")]
    df = spark.createDataFrame([x for x in texts + more if x[0] != 7], "id long, text string")
    table = spark.createDataFrame([(x["term"], x["kind"], x["entity_type"], x["case_sensitive"]) for x in listed], "term string, kind string, entity_type string, case_sensitive boolean")
    names = ["id", "entity_type", "start_pos", "end_pos", "value"]
    want = terms.rows_of(df, "text", terms.terms_found(F.col("text"), listed, hyphens=hyphens)).select(*names).collect()
    got = matching.term_matches(df, "id", table.unionByName(table), hyphens=hyphens).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and len(want) > 100
    with pytest.raises(PySparkException, match="can't hold kind regex"):
        matching.term_matches(df, "id", table.withColumn("kind", F.lit("regex"))).collect()


def test_excluded_by_terms(spark):
    found = spark.createDataFrame([(i, v) for i, v in enumerate(["Jakarta", "JAKARTA", "Jakarta Pusat", "é", "#x", "", None])], "id int, value string")
    unwanted = spark.createDataFrame([("jakarta", "word"), ("É", "exact"), ("#X", "word"), ("pusat", "contains")], "term string, kind string")
    assert {x.id for x in matching.excluded_by_terms(found, unwanted).collect()} == {2, 4, 5, 6}
    listed = [{"term": t.term, "kind": t.kind} for t in unwanted.collect()]
    assert {x.id for x in terms.never_protected(found.where("value <> ''"), listed).collect()} == {2, 4}


def test_rescan_of_every_value(spark):
    """A value protected in one document is a leak in any other; with a scope, in those of its project."""
    texts = spark.createDataFrame([(1, "a", "to BUDI santoso"), (2, "b", "Budi Santoso and Siti"), (3, "b", "[[PERSON_AB12CD]] clean"), (4, None, "siti")], "id int, project string, text string")
    values = spark.createDataFrame([("a", "Budi Santoso"), ("b", "siti"), ("b", "siti"), ("b", None), (None, "siti")], "project string, value string")
    pick = lambda **how: Counter((x.id, x.value) for x in protection.rescan(texts, "id", "2024-06-15", values, only=["general"], **how).collect() if x.leakage_type == "untokenized_value")
    assert pick() == Counter({(1, "Budi Santoso"): 1, (2, "Budi Santoso"): 1, (2, "siti"): 1, (4, "siti"): 1})
    assert pick(scope="project") == Counter({(1, "Budi Santoso"): 1, (2, "siti"): 1})
    result = protection.rescan_result(texts, protection.rescan(texts, "id", "2024-06-15", values, only=["general"]), "id").collect()
    assert {x.id for x in result if x.is_clean} == {3}


def test_severity_of_leaks(spark):
    """Original values in protected text are critical, missed and partial ones high, those that the protection made medium."""
    original = spark.createDataFrame([(1, "PERSON", "Budi Santoso"), (1, "PERSON", "Siti")], "file int, entity_type string, value string")
    cases = {"BUDI santoso": ("RESIDUAL", "CRITICAL"), "Santoso": ("INCOMPLETE", "HIGH"), "Siti Rahayu": ("INCOMPLETE", "HIGH"), "<PERSON>": ("INTRODUCED", "MEDIUM"), "token_9": ("INTRODUCED", "MEDIUM"), "Agus": ("MISSED", "HIGH")}
    found = spark.createDataFrame([(1, "PERSON", v) for v in cases], "file int, entity_type string, value string")
    leaks = protect.leaks(found, original, "file").withColumn("severity", protect.leak_severity(F.col("leak"))).collect()
    assert {x.value: (x.leak, x.severity) for x in leaks} == cases
    of_texts = {x.value: x.leak for x in protect.leaks(found, original, "file", partial=False).collect()}
    assert of_texts["Santoso"] == of_texts["Siti Rahayu"] == "MISSED" and of_texts["BUDI santoso"] == "RESIDUAL"


def test_composed(spark):
    """Letters and marks in any order that counts as the same, characters that stand for others, and marks that nothing takes."""
    import unicodedata

    from veilspark.functions.text import composed, value_hmac

    r = random.Random(5)
    every = [c for c in map(chr, range(0xC0, 0x2000)) if unicodedata.normalize("NFC", c) == c and len(d := unicodedata.normalize("NFD", c)) > 1 and unicodedata.category(d[0])[0] != "M"]
    texts = ["", "plain", "José", "Việt Việt Việt", "Å Ω K 豈", "q́ x̣́", "́ alone", "日本", *["".join(unicodedata.normalize(r.choice(["NFC", "NFD"]), c) for c in r.sample(every, 20)) for _ in range(60)]]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for x in df.select("t", composed(F.col("t")).alias("got")).collect():
        assert x.got == (None if x.t is None else unicodedata.normalize("NFC", x.t))
    two = spark.createDataFrame([("José Núñez",), ("José NÚÑEZ",)], "v string").select(value_hmac(F.lit("PERSON"), F.col("v"), b"k" * 32).alias("h"))
    assert two.distinct().count() == 1


def test_person_filter(spark):
    """Default terms and the address rule: only where the label lies within the window, never for names known by their context."""
    from veilspark.operators import engine

    texts = [(1, "Alamat: Kebon Jeruk"), (2, "alamat" + " x" * 30 + " Kebon Jeruk"), (3, "Alamat: Budi Santoso"), (4, "Kebon Jeruk"), (5, "Laki Laki dan Rawat Inap"), (6, None), (7, "JL. Agus " + "é" * 9000 + " kota Dewi")]
    found = [(1, "ner", 8, "Kebon Jeruk"), (2, "ner", 67, "Kebon Jeruk"), (3, "id_person", 8, "Budi Santoso"), (4, "ner", 0, "Kebon Jeruk"), (5, "ner", 0, "Laki Laki"), (5, "ner", 14, "Rawat Inap"), (6, "ner", 3, "Joko Wibowo"), (7, "ner", 4, "Agus"), (7, "ner", 9015, "Dewi")]
    df = spark.createDataFrame([(i, "PERSON", r, s, v) for i, r, s, v in found] + [(5, "EMAIL_ADDRESS", "general", 3, "a@b.id")], "id int, entity_type string, recognizer string, start_pos long, value string")
    kept = engine.person_filter(df, spark.createDataFrame(texts, "id int, text string"), "id").collect()
    assert {(x.id, x.value) for x in kept} == {(2, "Kebon Jeruk"), (3, "Budi Santoso"), (4, "Kebon Jeruk"), (6, "Joko Wibowo"), (5, "a@b.id")}
    mine = engine.person_filter(df, spark.createDataFrame(texts, "id int, text string"), "id", common=["kebon jeruk"]).collect()
    assert {(x.id, x.value) for x in mine} == {(3, "Budi Santoso"), (6, "Joko Wibowo"), (5, "a@b.id"), (5, "Laki Laki")}
