"""The guard's live rules: a stream with late and repeated deliveries gives what the batch gives, and the batch what plain Python does."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilspark.streaming import guard, live

BEGIN = datetime(2024, 1, 1)
END = BEGIN + timedelta(days=1)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def delivered(spark, folder, df, seed, late=8.0):
    """``df`` as files in an order in which rows come up to ``late`` seconds after later ones; at the end each source goes past all of them."""
    r = random.Random(seed)
    time = "ts" if "ts" in df.columns else "seen"
    rows = sorted(df.collect(), key=lambda x: x[time].timestamp() + r.random() * late)
    for at in range(0, len(rows), 40):
        spark.createDataFrame(rows[at : at + 40], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in")


def ran(spark, folder, out):
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    assert query.awaitTermination(300) and query.exception() is None
    return spark.read.parquet(f"{folder}/out")


def at(seconds):
    return BEGIN + timedelta(milliseconds=round(seconds * 1000))


def texts_of(seed, n=160, sources="abc", longest=0.9):
    r, rows, now = random.Random(seed), [], 0.0
    for k in range(n):
        now += r.choice([0.0, 0.05, 0.1, 0.25, 0.3, longest])
        rows.append((r.choice(sources), at(now), f"text {r.randrange(6)}", k))
    rows += [rows[5], rows[9]]  # delivered twice
    return rows + [(s, END, "end", -1) for s in sources]


TEXTS = "source string, ts timestamp, text string, no int"


def plain_coalescer(rows, quiet, interval):
    out = []
    of = defaultdict(list)
    for x in rows:
        of[x[0]].append(x)
    for own in of.values():
        own, last = sorted(own, key=lambda x: (x[1], x[2], str(x[3]))), None
        for k, x in enumerate(own):
            due = x[1] + timedelta(seconds=quiet)
            due = due if last is None else max(due, last + timedelta(seconds=interval))
            if k + 1 == len(own) or due < own[k + 1][1]:
                out.append((*x, due))
                last = due
    return Counter(out)


@pytest.mark.parametrize(("quiet", "interval"), [(0.25, 0.25), (0.1, 0.7)])
def test_coalesced(spark, tmp_path, quiet, interval):
    rows = texts_of(1)
    df = spark.createDataFrame(rows, TEXTS).repartition(3)
    want = plain_coalescer(rows, quiet, interval)
    assert Counter(map(tuple, live.coalesced(df, quiet=quiet, interval=interval).collect())) == want and len(want) > 20
    got = ran(spark, tmp_path, live.coalesced(delivered(spark, tmp_path, df, 2), quiet=quiet, interval=interval))
    assert Counter(map(tuple, got.where("no >= 0").collect())) == Counter({k: n for k, n in want.items() if k[3] >= 0})
    assert live.coalesced(df.where("false")).count() == 0


def test_own_writes_are_consumed_once(spark, tmp_path):
    rows = texts_of(3, longest=1.5)
    df = spark.createDataFrame(rows, TEXTS)
    r = random.Random(4)
    writes = spark.createDataFrame([(s, t - timedelta(milliseconds=r.choice([0, 100, 1_900, 2_000, 2_100])), text) for s, t, text, no in rows if no >= 0 and r.random() < 0.4] + [(s, END, "never") for s in "abc"], "source string, ts timestamp, text string")
    want = Counter(map(tuple, guard.without_own_writes(df, writes).where("no >= 0").collect()))
    (tmp_path / "t").mkdir()
    (tmp_path / "w").mkdir()
    stream = live.without_echoes(delivered(spark, tmp_path / "t", df, 5), delivered(spark, tmp_path / "w", writes, 6), late="30 seconds")
    got = Counter(map(tuple, ran(spark, tmp_path, stream).where("no >= 0").collect()))
    assert got == want and 0 < len(want) < len(rows) - 10


def test_results_that_expire(spark, tmp_path):
    r = random.Random(7)
    current = [(s, at(k * 3 + r.random()), g := r.randrange(3), f"f{g}") for k in range(30) for s in "ab"]
    results = [(k, s, t + timedelta(seconds=r.choice([0, 0.5, 2])), t + timedelta(seconds=r.choice([-40, -6, -5, -4, -1, 0])), r.choice([g, g, 9]), r.choice([f, f, f, "other"])) for k, (s, t, g, f) in enumerate(current)]
    told = spark.createDataFrame([*current, ("a", END, 0, "z"), ("b", END, 0, "z")], "source string, seen timestamp, generation int, fingerprint string")
    made = spark.createDataFrame([*results, (-1, "a", END, END, 7, "z"), (-1, "b", END, END, 7, "z")], "no int, source string, seen timestamp, created timestamp, generation int, fingerprint string")
    want = set()
    for no, s, seen, created, g, f in results:
        now = max(((t, cg, cf) for cs, t, cg, cf in current if cs == s and t <= seen), default=(0, None, None))
        if now[1:] == (g, f) and (seen - created).total_seconds() <= 5:
            want.add(no)
    got = live.shown_results(made, told).where("no >= 0").collect()
    assert {x.no for x in got} == want and len(got) == len(want) > 8
    (tmp_path / "r").mkdir()
    (tmp_path / "c").mkdir()
    stream = live.shown_results(delivered(spark, tmp_path / "r", made, 8), delivered(spark, tmp_path / "c", told, 9), late="60 seconds")
    assert Counter(map(tuple, ran(spark, tmp_path, stream).where("no >= 0").collect())) == Counter(map(tuple, got))


def test_a_source_with_most_texts(spark):
    """Many texts of one source fall into runs, so no list holds them all."""
    df = spark.range(200_000).select(F.lit("a").alias("source"), (F.lit(BEGIN) + F.make_dt_interval(secs=F.floor(F.col("id") / 4) * 2 + F.col("id") % 4 * 0.1)).alias("ts"), F.col("id").cast("string").alias("text"))
    got = live.coalesced(df).agg(F.count("*"), F.min(F.col("text").cast("long") % 4)).first()
    assert tuple(got) == (50_000, 3)
