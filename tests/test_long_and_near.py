"""Long texts, many findings, and spans and boxes that lie together: against plain Python, and in time that grows with the input."""

import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilspark.functions.text import BLOCK, PART, Pattern, blocks, find_spans, piece, splice
from veilspark.operators import entities, resolve, segments, tables
from veilspark.operators.intervals import overlap_join


def test_pieces_of_blocks(spark):
    r = random.Random(2)
    text = "".join(r.choices("aé漢😀 \n", k=3 * BLOCK + 17))
    n = len(text)
    cuts = [(0, 0), (0, n), (n, 5), (n - 3, 10), (BLOCK, BLOCK), (BLOCK - 1, 2), (2 * BLOCK, 0), *[(r.randrange(n), r.randrange(BLOCK * 2)) for _ in range(60)]]
    df = spark.createDataFrame([(text, s, k) for s, k in cuts] + [(text[:40], s, k) for s, k in ((0, 40), (10, 100), (40, 1))], "t string, s long, k long")
    assert all(x.got == x.t[x.s : x.s + x.k] for x in df.select("*", piece(blocks(F.col("t")), F.col("s"), F.col("k")).alias("got")).collect())


def test_contexts_of_many_matches(spark):
    """Places and contexts of more matches than a part holds, in a text of many blocks."""
    r = random.Random(3)
    text = "".join(r.choice(["é", "12", " ", "abc", "7", "😀"]) for _ in range(12 * PART))
    got = find_spans(spark.createDataFrame([(text,)], "text string"), "text", [Pattern("N", r"\d+", 1.0)], 5, 9).collect()
    want = Counter((m.start(), m.end(), m.group(), text[max(0, m.start() - 5) : m.end() + 9]) for m in re.finditer(r"\d+", text))
    assert len(got) > 2 * PART and Counter((x.start_pos, x.end_pos, x.value, x.context) for x in got) == want


def test_splice(spark):
    r = random.Random(6)
    cases = []
    for n in (0, 1, 30, 3 * BLOCK):
        for _ in range(6):
            text, edits, at = "".join(r.choices("ab é😀", k=n)), [], 0
            while at < n and r.random() < 0.98:
                start = at + r.randrange(5)
                end = start + 1 + r.randrange(9)
                edits.append((start, end, r.choice(["", "[X]", "é"])))
                at = end
            cases.append((text, r.sample([*edits, (5, 5, "no"), (-1, 2, "no"), (n - 1, n + 4, "no")], len(edits) + 3)))
    cases += [("abc", [(0, 1, None)]), ("abc", []), ("abc", None), (None, [(0, 1, "x")])]
    df = spark.createDataFrame(cases, "t string, e array<struct<start_pos:long,end_pos:long,replacement:string>>")
    for x in df.select("*", splice(F.col("t"), F.col("e")).alias("got")).collect():
        want = x.t
        if x.e is None or x.t is None or any(e.replacement is None for e in x.e):
            want = None
        else:
            for e in sorted(x.e, reverse=True):
                want = want[: e.start_pos] + e.replacement + want[e.end_pos :] if 0 <= e.start_pos < e.end_pos <= len(x.t) else want
        assert x.got == want


def plain_chunks(text, most, overlap):
    out, at, n = [], 0, len(text)
    if n <= most:
        return [(0, text)]
    while True:
        end = min(at + most, n)
        if end < n:
            space = text[at:end].rfind(" ")
            end = at + space + 1 if space > most // 2 else end
        out.append((at, text[at:end]))
        if end >= n:
            return out
        at = end - overlap


@pytest.mark.parametrize(("most", "overlap"), [(512, 50), (40, 5)])
def test_chunks(spark, most, overlap):
    r = random.Random(8)
    texts = ["", "x" * 2_000, *["".join(r.choices("ab é😀", k=n)) for n in (1, 39, 40, 41, 500, 513, 3_000, 30_000)], "word " * 9_000]
    got = defaultdict(list)
    for x in entities.chunks(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", most, overlap).orderBy("id", "chunk").collect():
        got[x.id].append((x.start_pos, x.text))
    assert [got[i] for i in range(len(texts))] == [plain_chunks(t, most, overlap) for t in texts]


def test_cost_grows_with_the_text(spark):
    """Eight times the text takes eight times as long, give or take what every job takes."""
    unit = "nama Budi, surel a.b@contoh.co.id pada 12 Mei; nomor 3171234567890123. " * 1_000
    numbers = [Pattern("N", r"\d+", 1.0)]

    def seconds(times: int) -> float:
        df = spark.createDataFrame([(1, unit * times)], "id int, text string").cache()
        df.count()
        began = time.time()
        entities.chunks(df, "id").write.format("noop").mode("overwrite").save()
        find_spans(df, "text", numbers, 20, 20).write.format("noop").mode("overwrite").save()
        edits = F.transform(F.sequence(F.lit(0), F.lit(1_000 * times - 1)), lambda i: F.struct((i * 70).cast("long").alias("start_pos"), (i * 70 + 4).cast("long").alias("end_pos"), F.lit("##").alias("replacement")))
        df.select(splice(F.col("text"), edits)).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(1)
    few = seconds(8)
    assert seconds(64) < 16 * max(few, 1.0)


def whole_fold(rows, rule):
    """The rule over all findings of a segment, as one list."""
    acc = []
    overlaps = lambda a, b: a[0] < b[1] and b[0] < a[1]
    length = lambda a: a[1] - a[0]
    for x in rows:
        hit = next((y for y in acc if overlaps(x, y)), None)
        if hit is None:
            acc.append(x)
        elif rule == "margin" and (x[2] > hit[2] + 0.05 or (not hit[2] > x[2] + 0.05 and length(x) > length(hit))):
            acc.remove(hit)
            acc.append(x)
    return set(acc)


def test_islands_give_what_whole_segments_give(spark):
    r = random.Random(9)
    rows = {(s, start, start + r.choice([0, 1, 3, 8, 40]), round(r.random(), 2), r.choice("PQ")) for s in range(40) for start in [r.randrange(300) for _ in range(60)]}
    df = spark.createDataFrame(sorted(rows), "segment_id int, start_pos long, end_pos long, score double, entity_type string").repartition(3)
    for rule, order, name in ((resolve.by_margin, lambda x: (x[0], -x[1], x[3], x[1]), "margin"), (resolve.first_wins, lambda x: (x[0], -x[2], x[0] - x[1], x[3], x[1]), "first"), (resolve.greedy_by_score, lambda x: (-x[2], x[0], x[3], x[1]), "first")):
        got = defaultdict(set)
        for x in rule(df).collect():
            got[x.segment_id].add((x.start_pos, x.end_pos, x.score, x.entity_type))
        for s in range(40):
            own = sorted((x[1:] for x in rows if x[0] == s), key=lambda x: (*order(x), x))
            assert got[s] == whole_fold(own, name), rule


def test_a_segment_of_many_findings(spark):
    """300,000 findings of one segment, in islands of three."""
    df = spark.range(300_000).select(F.lit(1).alias("segment_id"), (F.col("id") * 4 - F.col("id") % 3 * 3).alias("start_pos"), (F.col("id") * 4 - F.col("id") % 3 * 3 + 5).alias("end_pos"), F.lit(0.5).alias("score"), F.lit("P").alias("entity_type"))
    rows = sorted((k * 4 - k % 3 * 3, k * 4 - k % 3 * 3 + 5) for k in range(300_000))
    kept, last = 0, -1
    for start, end in rows:
        if start >= last:
            kept, last = kept + 1, end
    assert resolve.first_wins(df).count() == kept
    pairs = resolve.overlapping_pairs(df.withColumn("finding_id", F.col("start_pos"))).count()
    assert pairs == sum(1 for k, (_, end) in enumerate(rows) for j in range(k + 1, min(k + 8, len(rows))) if rows[j][0] < end)


@pytest.mark.parametrize("dimensions", [1, 2])
def test_overlap_join(spark, dimensions):
    r = random.Random(dimensions)

    def box():
        wide = r.choice([0, 1, 10, 64, 65, 700, 40_000])
        return [x for _ in range(dimensions) for s in [r.randrange(-2_000, 50_000)] for x in (s, s + r.randrange(wide + 1))]

    left, right = ([(i, r.choice([1, 1, 1, 2, None]), *box()) for i in range(500)] for _ in range(2))
    right += [(900, 1, *[0, None] * dimensions)]
    names = lambda p: [(f"{p}{d}0", f"{p}{d}1") for d in range(dimensions)]
    frame = lambda rows, p: spark.createDataFrame(rows, f"{p}_id int, k int, " + ", ".join(f"{a} long, {b} long" for a, b in names(p)))
    met = overlap_join(frame(left, "l"), frame(right, "r"), ["k"], names("l"), names("r"))
    got = Counter((x.l_id, x.r_id) for x in met.collect())
    cross = lambda a, b: all(a[2 + 2 * d] < b[3 + 2 * d] and b[2 + 2 * d] < a[3 + 2 * d] for d in range(dimensions))
    assert got == Counter((a[0], b[0]) for a in left for b in right if a[1] is not None and a[1] == b[1] and b[3] is not None and cross(a, b)) and len(got) > 200


def test_source_ranges_of_many_runs(spark):
    """Spans of a paragraph of very many runs, with long and short spans."""
    r = random.Random(4)
    texts = ["".join(r.choices("ab", k=r.choice([0, 1, 5, 300]))) for _ in range(3_000)]
    total = sum(map(len, texts))
    spans = [(s, min(total, s + r.choice([1, 4, 900, 20_000]))) for s in (r.randrange(total) for _ in range(200))]
    runs = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "par int, run int, text string")
    asked = spark.createDataFrame([(1, *s) for s in set(spans)], "par int, start_pos long, end_pos long")
    got = {(x.start_pos, x.end_pos, x.run, x.source_start, x.source_end) for x in segments.source_ranges(segments.runs_map(runs, "par"), asked, "par").collect()}
    want, at = set(), 0
    for i, t in enumerate(texts):
        want |= {(s, e, i, max(s, at) - at, min(e, at + len(t)) - at) for s, e in spans if t and s < at + len(t) and at < e}
        at += len(t)
    assert got == want


@pytest.mark.parametrize("mode", ["exact", "overlap", "partial", "contained"])
def test_matches_of_predictions(spark, mode):
    r = random.Random(12)
    span = lambda: (s := r.randrange(60), s + r.choice([0, 1, 2, 5, 12]))
    tables_ = [{(doc, *span()) for doc in range(30) for _ in range(12)} for _ in range(2)]
    frames = [spark.createDataFrame([(d, "memo", "PERSON", s, e) for d, s, e in rows], "id int, doc_type string, entity_type string, start_pos long, end_pos long") for rows in tables_]
    got = tables.matched(*frames, "id", mode).agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first()

    def fits(p, g):
        shared, short = max(0, min(p[1], g[1]) - max(p[0], g[0])), min(p[1] - p[0], g[1] - g[0])
        return {"exact": p == g, "overlap": min(p[1], g[1]) > max(p[0], g[0]), "partial": short > 0 and shared / short >= 0.5, "contained": p[0] >= g[0] and p[1] <= g[1]}[mode]

    tp = fn = 0
    for doc in range(30):
        free = sorted(x[1:] for x in tables_[1] if x[0] == doc)
        for p in sorted(x[1:] for x in tables_[0] if x[0] == doc):
            hit = next((g for g in free if fits(p, g)), None)
            if hit:
                free.remove(hit)
                tp += 1
        fn += len(free)
    assert tuple(got) == (tp, len(tables_[0]) - tp, fn) and tp > 5


def test_compared_types(spark):
    df = spark.createDataFrame([(x,) for x in ("per", "PHONE", "Email", "nik", "OTHER")], "t string")
    assert [x[0] for x in df.select(tables.compared_type(F.col("t"))).collect()] == ["PERSON", "ID_PHONE", "EMAIL_ADDRESS", "ID_NIK", "OTHER"]
