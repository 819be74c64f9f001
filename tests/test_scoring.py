"""Literal cases of context scoring."""

from veilspark.operators import scoring


def test_label_boost_sets_the_band_anew(spark):
    rows = [(1, "ID_NIK", 0.75, "MEDIUM", ["NIK"]), (2, "ID_NIK", 0.65, "MEDIUM", ["npwp"]), (3, "ID_NIK", 0.75, "MEDIUM", ["apa saja"]), (4, "ID_NIK", 0.95, "HIGH", ["nik"]), (5, "ID_NIK", 0.3, "odd", None)]
    df = spark.createDataFrame(rows, "id int, entity_type string, score double, band string, labels array<string>")
    got = {x.id: (x.context, x.score, x.band) for x in scoring.label_boost(df).collect()}
    up, down = scoring.MATCH_BOOST, scoring.MISMATCH_PENALTY
    assert got[1] == ("match", round(0.75 + up, 6), "HIGH") and got[4] == ("match", 1.0, "HIGH")
    assert got[2] == ("mismatch", round(0.65 - down, 6), "LOW") and got[3] == (None, 0.75, "MEDIUM") and got[5] == (None, 0.3, "odd")
    lenient = {x.id: (x.context, x.score, x.band) for x in scoring.label_boost(df, balanced=False).collect()}
    assert lenient[2] == (None, 0.65, "MEDIUM")
    assert "band" not in scoring.label_boost(df.drop("band")).columns


def test_judged_texts(spark):
    """Risk, labels, size limit and buckets of single texts."""
    from veilspark.streaming import guard

    big = "é" * (guard.HARD_LIMIT // 2)
    cases = {
        1: ("surel a@b.co.id saja", ("scanned", "MEDIUM", 1, "surel [EMAIL_REDACTED] saja", "<100")),
        2: ("a@b.co.id dan c@d.org", ("scanned", "HIGH", 2, "[EMAIL_REDACTED] dan [EMAIL_REDACTED]", "<100")),
        3: ("", ("scanned", "LOW", 0, "", "0")),
        4: ("halo dunia", ("scanned", "LOW", 0, "halo dunia", "<100")),
        5: (big + "x", ("refused", None, 0, None, "<512k")),
        6: (big, ("scanned", "LOW", 0, big, "<512k")),
        7: ("lihat 10.1.2.3 ya", ("scanned", "LOW", 1, "lihat [IP_REDACTED] ya", "<100")),
        8: ("x" * 200 + " a@b.id", ("scanned", "MEDIUM", 1, "x" * 200 + " [EMAIL_REDACTED]", "<1k")),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "id int, text string")
    got = {x.id: (x.status, x.risk, x.findings, x.redacted, x.bucket) for x in guard.judge(df, "2024-06-15").collect()}
    assert got == {k: want for k, (_, want) in cases.items()}


def test_keywords_of_runs_are_those_of_the_text(spark):
    """Keywords looked for in the runs of a text, by branching patterns, are those that a plain alternation finds in all of it."""
    import random
    import re

    from pyspark.sql import functions as F

    tables = [scoring.POSITIVE, scoring.NEGATIVE, *scoring.ENTITY_WORDS.values(), *scoring.DOCUMENT_WORDS.values()]
    words = sorted({w for t in tables for w in t})
    assert all(re.fullmatch(r"\w(.*\w)?", w) and not re.sub(r"[\w .-]", "", w) for w in words)
    dice = random.Random(7)
    others = ["budi", "xnama", "nama_lengkap", "namá", "KTP9", "é", "😀", "Karyawan\nbaru", "e", "mail", "no.", "po", "\t", ""]
    mixed = lambda w: "".join(x.upper() if dice.random() < 0.3 else x for x in w)
    texts = [dice.choice(["", " ", "-"]).join(mixed(dice.choice(words if dice.random() < 0.7 else others)) + dice.choice([" ", "  ", ", ", "-", ". ", ""]) for _ in range(dice.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate([*texts, "", None])), "id int, text string")
    plain = lambda t: F.transform(F.regexp_extract_all("text", F.lit(r"(?iU)\b(" + "|".join(re.escape(w) for w in sorted(t, key=len, reverse=True)) + r")\b"), F.lit(1)), F.lower)
    runs = scoring.keyword_runs(F.col("text"), tables)
    got = df.select(*[scoring.words_met(runs, t).alias(f"a{n}") for n, t in enumerate(tables)], *[plain(t).alias(f"b{n}") for n, t in enumerate(tables)]).collect()
    assert sum(len(row[0] or []) for row in got) > 300
    for row in got:
        assert row[: len(tables)] == row[len(tables) :]
