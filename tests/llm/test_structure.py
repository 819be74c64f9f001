"""Sharding, fill-in-middle and conversation repair against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("veilspark.llm")

from veilspark.llm import conversations, fill_in_middle, sharding  # noqa: E402

SCHEMA = "doc_id long, text string, shard string, slot int, size string, row string, part int, place string, n string, key string, form int, output string, start int, first int"


def frame(spark, rows):
    """Documents with further columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "r", 2, "p", "n", "k", 3, "o", 4, 5) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(7)
    words = ["ab", "é", "漢字", "😀", "c,d", "x" * 30]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", "\n\t", "  ", " ", " "]) for _ in range(r.randint(0, 30)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "no id"), (None, None), (203, "a <S> b"), (204, "a<P"), (205, "<" * 9), (206, "tail  "), (207, "word " * 40_000)]
    return rows + [(5, rows[5][1]), (5, "other text of a repeated id"), (208, rows[6][1])] + [(9, "hot row")] * 60


def test_shards(spark, odd):
    got = sharding.assign_shards(frame(spark, odd)).collect()
    assert got[0].__fields__ == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want and {r.law for r in got} == {"key"}
    by_id, slots = {}, defaultdict(list)
    for r in got:
        assert by_id.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard) and r.grown_shard in (r.shard, 8)
        slots[r.shard].append((r.slot, (r.doc_id is None, r.doc_id, r.text_crc32, r.size)))
        draws = [(int(hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}|{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for k in range(9)]
        best = lambda n, draws=draws: max(range(n), key=lambda k: -1 / math.log(draws[k]))
        assert (r.shard, r.grown_shard) == (best(8), best(9))
    for own in slots.values():
        assert [s for s, _ in sorted(own)] == list(range(len(own)))
        order = [o for _, o in sorted(own)]
        assert order == sorted(order, key=lambda o: (o[0], o[1] or 0, *o[2:]))
    assert sharding.assign_shards(frame(spark, [])).count() == 0
    put = sharding.sharded_documents(frame(spark, odd))
    assert put.columns == frame(spark, odd).columns and {(r.doc_id, r.shard) for r in put.collect()} == {(i, s) for i, (s, _) in by_id.items()}


def test_weighted_shards(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    weights = (1.0, 3.0, 0.0, 4.0)
    n = Counter(r[0] for r in keys.select(sharding.best_shard(F.col("k"), weights)).collect())
    assert 2 not in n and all(abs(n[k] / 20_000 - w / 8) < 0.02 for k, w in enumerate(weights))
    # less weight for one shard moves only rows of that shard
    moved = keys.select(sharding.best_shard(F.col("k"), weights).alias("a"), sharding.best_shard(F.col("k"), (1.0, 3.0, 0.0, 3.0)).alias("b")).where("a <> b")
    assert {r.a for r in moved.collect()} == {3}
    with pytest.raises(ValueError, match="weights"):
        sharding.best_shard(F.col("k"), (0.0, 0.0))


def test_a_hot_key_is_spread(spark, monkeypatch):
    """A third of all rows has one id: its shard takes them all, but no part of the sort does."""
    docs = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text")).repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    tables, write = {}, sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df, tag: tables.setdefault(tag, write(df, tag)))
    try:
        out = sharding.assign_shards(docs)
        checked = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("d")).collect()
        assert all(r.n == r.d == r.m + 1 for r in checked) and sum(r.n for r in checked) == 9_000
        parts = sorted(r[0] for r in tables["shard-placed"].groupBy("part").count().select("count").collect())
        assert len(parts) >= 12 and parts[-1] <= 4 * parts[len(parts) // 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_fill_in_middle(spark, odd):
    whole = {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_in_middle.fill_in_middle(frame(spark, odd)).collect()}
    digests = fill_in_middle.middle_digests(frame(spark, odd)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want, plain = [], Counter()
    for i, t in odd:
        t = t or ""
        units = UNITS.findall(t)
        h = sha(f"42:{'' if i is None else i}")
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        pre, mid, suf = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
            row = (i, len(units), "plain", None, None, t)
        elif h4 % 100 < 80:
            row = (i, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
        else:
            row = (i, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")
        assert row in whole and fill_in_middle.restore(row[5], row[2]) == t
        want.append((*row[:5], sha(row[5]), sha(t)))
        plain[row[2]] += 1
    assert Counter(map(tuple, digests)) == Counter(want) and min(plain.values()) > 3 and len(plain) == 3
    assert fill_in_middle.middle_digests(frame(spark, [])).count() == 0


def test_runs_find_every_cut():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("ab \n漢") for _ in range(r.randint(0, 25)))
        runs, units = fill_in_middle.Runs.of(text), UNITS.findall(text)
        assert [runs.offset(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]
        # with unspaced scripts: each of their characters ends a unit
        singles = re.findall(r"[ \n]*漢|[ \n]*[ab]+|[ \n]+$", text)
        runs = fill_in_middle.Runs.of(text, singles=True)
        assert [runs.offset(k) for k in range(runs.count() + 1)] == [len("".join(singles[:k])) for k in range(len(singles) + 1)]
    for bad, form in (("no sentinel", "psm"), ("<P>a<S>b", "psm")):
        with pytest.raises(ValueError):
            fill_in_middle.restore(bad, form)


def brute_repair(rows):
    """Cheapest edits and the least of them by dynamic programming over all rows, with whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    strip = lambda t: t.strip(" \t\n\v\f\r")
    faults = ["blank" if not strip(t) else "duplicate" if (role, t) in [x[1:] for x in rows[:k]] else "truncated" if strip(t)[-1] not in ".!?" else "" for k, (_, role, t) in enumerate(rows)]
    best = {"": (0, "")}  # the end of the role initials: what was emitted, cut to its last sign
    kinds = {"": [("u", "u")], "s": [("u", "u")], "u": [("a", "a")], "a": [("u", "u")]}

    def put(to, state, cost, edits):
        if state not in to or (cost, edits) < to[state]:
            to[state] = (cost, edits)

    def insertions(states):
        for _ in range(2):
            for s, (c, e) in list(states.items()):
                for nxt, _ in kinds[s]:
                    put(states, nxt, c + 5, e + "I")
        return states

    for (_, role, _), fault in zip(rows, faults, strict=True):
        now = {}
        for s, (c, e) in insertions(best).items():
            put(now, s, c + 2, e + "D")
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                if s + role[:1] in ("s", "u", "su", "ua", "au") and role:
                    put(now, role[:1], c + extra, e + "K")
                put(now, kinds[s][0][0], c + 1 + extra, e + "R")
        best = now
    ends = [v for k, v in insertions(best).items() if k in ("", "a")]
    cost, edits = min(ends)
    turns = {r[0] for r in rows if r[0] is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    lines, i, last = [], 0, ""
    for e in edits:
        if e == "D":
            i += 1
            continue
        role = "assistant" if last == "u" else "user"
        role = rows[i][1] if e == "K" else role
        lines.append(f"{role}:{'' if e == 'I' else rows[i][2]}")
        i, last = i + (e != "I"), role[0]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", "u2"]
TEXTS = ["Yes.", "No!", "cut off", " ", "", "Why?", "é 漢", "end. \n", "one more", "two."]


@pytest.fixture(scope="module")
def talks():
    r = random.Random(11)
    rows = []
    for conv in range(120):
        for turn in range(r.randint(1, 14)):
            text = r.choice(TEXTS) if r.random() < 0.5 else f"line {r.random()}" + r.choice(".!? ,")
            role = ["user", "assistant"][turn % 2] if r.random() < 0.7 else r.choice(ROLES)
            rows.append((conv, None if r.random() < 0.05 else turn + (r.random() < 0.1) * 3, role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (500, None, None, None), (501, 1, "user", "x" * 100_000), (502, 1, "user", "Same."), (502, 1, "user", "Same.")]
    return rows


TALK = "conv_id long, turn long, role string, text string, copies string, part int, place int, n int, piece string, entry int"


def talk_frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, 3, "p", 4) for r in rows], TALK).repartition(3)


def expected(rows, damage):
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        out = of[conv]
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return {(c, *brute_repair(x)) for c, x in of.items()}


@pytest.mark.parametrize("damage", [True, False])
@pytest.mark.parametrize("pieces", [None, 3])
def test_conversations(spark, talks, damage, pieces, monkeypatch):
    """Short conversations in one row, and the same ones sorted over tasks and joined from pieces of three rows."""
    if pieces:
        monkeypatch.setattr(conversations, "SHORT_ROWS", 3)
        monkeypatch.setattr(conversations, "PIECE_ROWS", pieces)
    got = conversations.repair_conversations(talk_frame(spark, talks), damage).collect()
    assert len(got) == len({r[0] for r in talks}) and {tuple(r) for r in got} == expected(talks, damage)
    assert conversations.repair_conversations(talk_frame(spark, []), damage).count() == 0


def test_a_conversation_of_many_rows(spark):
    """A third of all rows in one conversation: pieces give what the dynamic program over all of it gives."""
    r = random.Random(5)
    rows = [(1, k, r.choice(["user", "assistant", "system"]), f"line {k % 900}" + r.choice(".!, ")) for k in range(2_500)]
    rows += [(2 + k // 4, k % 4, r.choice(["user", "assistant"]), f"line {k}.") for k in range(5_000)]
    got = {x.conv_id: tuple(x) for x in conversations.repair_conversations(talk_frame(spark, rows)).collect()}
    assert len(got) == 1251 and got[1] == (1, *brute_repair([x[1:] for x in rows if x[0] == 1]))
    assert {got[c] for c in (2, 3, 900)} == {(c, *brute_repair([x[1:] for x in rows if x[0] == c])) for c in (2, 3, 900)}


def test_search_against_all_edits():
    """Every list of edits of up to three rows, two insertions at most at each place."""
    legal = re.compile(r"(s?(ua)+)?")
    for n in range(4):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product(range(4), repeat=n) if n < 3 else [(0, 0, 3), (3, 0, 0), (1, 3, 0), (0, 2, 0)]:
                options = []
                for i in range(n):
                    own = [(2, "D", "")] if faults[i] in (1, 2) else [(2, "D", ""), (5 * (faults[i] == 3), "K", initials[i]), *[(1 + 5 * (faults[i] == 3), "R", x) for x in "ua"]]
                    options += [[(0, "", ""), (5, "I", "u"), (5, "I", "a"), (10, "II", "ua"), (10, "II", "au")], own]
                options.append([(0, "", ""), (5, "I", "u"), (5, "I", "a"), (10, "II", "ua"), (10, "II", "au")])
                best = min((sum(x[0] for x in way), "".join(x[1] for x in way)) for way in itertools.product(*options) if legal.fullmatch("".join(x[2] for x in way)))
                assert min(conversations.search("".join(initials), list(faults)).values()) == best
