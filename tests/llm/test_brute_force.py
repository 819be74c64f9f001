"""Whole operators and the pipeline against plain Python that does the same work another way."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("veilspark.llm")

import corpus_pipeline  # noqa: E402
from veilspark.llm import fingerprints, mixing, near_dedup, passages, quality, toxicity  # noqa: E402
from veilspark.llm.common import batches_of, key_map  # noqa: E402

M = (1 << 64) - 1


def mix(x):
    """The finaliser that the operators use, for one number."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def rows_of(texts, sources=("a", "b")):
    return [(i, t, "en", sources[i % len(sources)] if i is not None else None, len(t or "")) for i, t in texts]


def test_fingerprints_by_hand(spark):
    import xxhash

    r = random.Random(2)
    words = [f"k{i}" for i in range(400)]
    texts = [(i, " ".join(r.choices(words, k=r.randint(1, 200)))) for i in range(80)] + [(90, None), (91, ""), (92, "..."), (93, "Einmal nie"), (None, "k1 k2 k3")]
    texts += [(94, texts[0][1]), (95, texts[1][1] + " k7")]
    terms = lambda t: {xxhash.xxh3_64_intdigest(w.strip(b".,;:!?\"'()|#*%&$")) for w in set((t or "").lower().encode().split())}
    counts = Counter(x for _, t in texts for x in terms(t))
    few = {x: n for x, n in counts.items() if n <= max(1, fingerprints.COMMONEST * len(texts))}
    least = max(fingerprints.RAREST * len(texts), sum(few.values()) / fingerprints.MOST_TERMS)
    lexicon = {x for x, n in few.items() if n >= least}

    def fingerprint(t):
        own = sorted(terms(t) & lexicon)
        if not own:
            return "=" + hashlib.sha256((t or "").encode()).hexdigest()
        out = ""
        for k in range(fingerprints.LEVELS * fingerprints.SUBSETS):
            part = [x for x in own if mix((x + 0x9E3779B97F4A7C15 * (k + 1)) & M) >> (64 - 2 * (k // fingerprints.SUBSETS + 1)) == 0]
            h = sum(mix(x ^ 0xD6E8FEB86659FD93) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, x in enumerate(part)) & M
            out += f"{mix(h) % (16**fingerprints.DIGITS - 1) + 1:0{fingerprints.DIGITS}x}" if part else fingerprints.NONE
        return out

    def likeness(a, b):
        if a == b or a[0] == "=" or b[0] == "=":
            return float(a == b)
        d, best = fingerprints.DIGITS, 0.0
        for level in reversed(range(fingerprints.LEVELS)):
            pairs = [(a[i : i + d], b[i : i + d]) for i in range(level * fingerprints.SUBSETS * d, (level + 1) * fingerprints.SUBSETS * d, d)]
            filled = [p for p in pairs if p != (fingerprints.NONE,) * 2]
            if filled:
                best = sum(x == y for x, y in filled) / len(filled)
            if len(filled) >= fingerprints.FILLED:
                break
        return best

    order = sorted(texts, key=lambda x: -(1 << 63) if x[0] is None else x[0], reverse=True)
    got = {x.doc_id: x for x in fingerprints.fingerprints(docs_of(spark, rows_of(texts))).collect()}
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        x, own, other = got[i], fingerprint(t), fingerprint(changed)
        assert (x.n_chars, x.fingerprint, x.edited_fingerprint) == (len(t), own, other)
        assert x.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert abs(x.near_edited - likeness(own, other)) < 1e-12 and abs(x.near_next - likeness(own, fingerprint(following))) < 1e-12


def test_context_vectors_by_hand(spark):
    r = random.Random(3)
    texts = [(i, " ".join(r.choice(["Kata", "kata,", "x1", "9-9", "zz", "A!", "Kata"]) for _ in range(r.randint(0, 25)))) for i in range(60)] + [(99, None), (None, "kata lepas")]
    place, sign = quality._index_vectors()
    total = np.zeros((quality.TERMS, quality.DIMENSIONS))
    for _, t in texts:
        for part in quality.terms_of(t or ""):
            for at, term in enumerate(part):
                for near in (at - 2, at - 1, at + 1, at + 2):
                    if 0 <= near < len(part):
                        for k in range(quality.ENTRIES):
                            total[term, place[part[near], k]] += sign[part[near], k]
    got = quality.context_vectors(docs_of(spark, rows_of(texts)))
    assert np.allclose(got, total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9), atol=1e-6)


def test_context_vectors_in_pieces(spark, monkeypatch):
    """Neighbours on either side of a piece's end are counted, and none twice."""
    monkeypatch.setattr(quality, "PIECE", 7)
    test_context_vectors_by_hand(spark)


def plain_terms(words):
    """Packed buckets word by word and letter by letter."""
    out = []
    for word in words:
        kinds = ["X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word]
        shape = "".join(c for k, c in enumerate(kinds) if not k or c != kinds[k - 1] or not (c in "Xx9" or re.match(r"\W", c)))
        w = zlib.crc32(word.lower().strip(".,;:!?").encode()) % quality.WORDS
        out.append(w << 16 | quality.WORDS + zlib.crc32(shape.encode()) % (quality.SHAPES - 1))
    return np.array(out, np.int64)


def test_terms_of_words_never_met():
    """Words of all kinds of letters, in texts longer than a piece and with more words than are remembered, as by hand."""
    r = random.Random(5)
    letters = "AaBbΣσςİıßǅé__½²٣.,!?#--\u0301漢😀Xx99"
    words = ["".join(r.choice(letters) * r.choice([1, 1, 2, 5]) for _ in range(r.randint(1, 9))) for _ in range(3_000)]
    words += [f"w{i}" for i in range(1_000)] * 3
    words = [x for w in words for x in w.split()]
    r.shuffle(words)
    want = plain_terms(words)
    memo = quality._Terms(500)
    for at in range(0, len(words), 400):
        part = words[at : at + 400]
        assert np.array_equal(memo.of(part), want[at : at + 400]) and len(memo) <= 500
    long = words * (quality.PIECE // len(words) + 2)
    assert np.array_equal(memo.of(long)[-len(words) :], want)


def test_new_words_cost_no_call_a_letter():
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += 1

    new = " ".join(f"Neuwörtlich{'abcdefghij'[i % 10]}{i}" for i in range(2_000))
    quality.terms_of(new.replace("N", "M"))
    sys.setprofile(count)
    try:
        quality.terms_of(new)
    finally:
        sys.setprofile(None)
    assert calls < 3 * 2_000  # letter by letter there were over a hundred calls and returns a word


def test_pooled_by_hand():
    vectors = np.random.default_rng(2).normal(size=(quality.TERMS, quality.DIMENSIONS)).astype(np.float32)
    scorer = quality.Scorer(vectors, None, 0.5)
    texts = ["Kata kata, kata x1 x1 x1 A!", "", "eins"]
    for text, got in zip(texts, scorer.features(texts), strict=True):
        w, s = quality.terms_of(text)
        want = [np.mean([t[i] for i in at], 0) if len(at) else np.zeros(quality.DIMENSIONS) for t, at in ((vectors, w), (vectors, s), (scorer.index, s))]
        assert np.allclose(got, np.concatenate(want), atol=1e-6)


def repeats(texts):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: -(1 << 63) if x[0] is None else x[0]):
        w, gone = (t or "").encode().split(), set()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone.update(range(s, s + 20))
            seen.add(key)
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("lengthen", [False, True])
def test_dense_repeats(spark, monkeypatch, lengthen):
    """Few words, so that windows, anchors and their ties repeat everywhere; with short prefixes and with all of them lengthened to 20 words."""
    if lengthen:
        monkeypatch.setattr(passages, "marked_bits", lambda *a: None)
    r = random.Random(7)
    line = " ".join(r.choices(["p", "q", "s"], k=45))
    texts = [(i, " ".join(r.choices(["a", "b"], k=r.choice([0, 19, 20, 21, 40, 150])))) for i in range(40)] + [(50 + i, f"{'x' * i} {line} y{i}") for i in range(25)]
    texts += [(80, "w " * 300), (81, None), (None, "v " + line), (82, " ".join(f"u{i}" for i in range(20_000)) + " " + line)]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in passages.remove_repeats(docs_of(spark, rows_of(texts))).collect()}
    assert got == repeats(texts)


def test_key_map(spark):
    keys = spark.range(0, 5000, 7)
    kept = {x.id for x in spark.range(20_000).where(key_map(keys, "id")(__import__("pyspark").sql.functions.xxhash64("id"))).collect()}
    assert set(range(0, 5000, 7)) <= kept and len(kept) < 6000


def test_batches_leave_the_session_alone(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with batches_of(spark, 7):
        assert spark.conf.get(name) == "7"
    assert spark.conf.get(name) == before


def test_conflicting_labels(spark):
    """An id with several labels is learnt from once; copies of a labelled id don't double."""
    rows = rows_of([(i, ("good plain words here " if i % 2 else "BAD!!! BAD!!! ") * 5) for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2, int(i % 2 == 0)) for i in range(200)] + [(i, 1 - i % 2, None) for i in range(0, 200, 50)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.predicted for x in quality.score_quality(docs_of(spark, rows), labels).collect()}
    assert np.mean([p == i % 2 for i, p in got.items()]) > 0.95
    tox = {x.doc_id: x.predicted for x in toxicity.score_toxicity(docs_of(spark, rows), labels).collect()}
    assert len(tox) == 200


def test_long_text(spark):
    """A text of ten megabytes beside short ones."""
    long = " ".join(f"n{i % 70_001}" for i in range(1_500_000))
    texts = [(1, long), (2, long + " tail"), (3, "short one")]
    assert len(long) > 8_000_000
    near = {x.doc_id: x.component_id for x in near_dedup.near_groups(docs_of(spark, rows_of(texts)), 3, 85).collect()}
    assert near == {1: 1, 2: 1, 3: 3}
    gone = {x.doc_id: x.n_removed for x in passages.remove_repeats(docs_of(spark, rows_of(texts))).collect()}
    assert gone[2] == 1_500_000 and gone[3] == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus of good and bad texts, exact and near copies, null and empty rows, and its labels."""
    r = random.Random(9)
    good = lambda: " ".join(r.choices([f"word{i}" for i in range(300)], k=r.randint(30, 60))) + "."
    bad = lambda: " ".join(r.choices(["###", "$$$", "XX", "!!!", "9999"], k=r.randint(30, 60)))
    texts = [(i, bad() if i % 5 == 0 else good()) for i in range(300)]
    by = dict(texts)
    texts += [(400 + i, by[i] + " ") for i in range(1, 40, 5)]
    texts += [(500 + i, by[i] + " extra") for i in range(2, 80, 5)]
    texts += [(600, None), (601, ""), (None, by[3]), (None, None), (7, by[7])]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows_of(texts, ("a", "b", "c")), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, corpus):
    """Each stage on what the one before kept, against plain Python."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "mixing", "SentencePiece"]
    stages = dict(corpus_pipeline.STAGES)

    scores = {(x.doc_id, x.score) for x in quality.score_quality(docs, spark.read.parquet(f"{corpus}/labels.parquet")).collect()}
    kept = stages["quality classifier"](spark, docs, corpus)
    assert kept.schema == docs.schema
    rows = kept.collect()
    low = {i for i, s in scores if s < 0.5}
    assert {x.doc_id for x in rows if x.doc_id is not None} == {i for i, _ in scores if i is not None} - low
    clean = [x for x in docs.collect() if x.doc_id is not None and x.doc_id < 300 and x.doc_id % 5]
    assert {x.doc_id for x in clean} <= {x.doc_id for x in rows} and not any(x.doc_id is not None and x.doc_id % 5 == 0 and x.doc_id < 300 for x in rows)

    kept = spark.createDataFrame(rows, docs.schema)
    exact = stages["exact dedup"](spark, kept, corpus).collect()
    squeezed = lambda t: "".join((t or "").split())
    groups = defaultdict(list)
    for x in rows:
        groups[squeezed(x.text)].append((-len(x.text or ""), x.doc_id is None, x.doc_id or 0))
    assert sorted((squeezed(x.text), -len(x.text or ""), x.doc_id is None, x.doc_id or 0) for x in exact) == sorted((k, *min(v)) for k, v in groups.items())

    near = stages["near dedup"](spark, spark.createDataFrame(exact, docs.schema), corpus).collect()
    sets = {}
    for x in exact:
        w = (x.text or "").lower().split()
        if w and x.doc_id is not None:
            sets[x.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if x == old else x for i, x in root.items()}
    assert {x.doc_id for x in near if x.doc_id in sets} == {i for i, x in root.items() if x == i}
    assert sum(x.doc_id is None or x.doc_id not in sets for x in near) == sum(x.doc_id is None or x.doc_id not in sets for x in exact)

    before = spark.createDataFrame(near, docs.schema)
    mixed = stages["mixing"](spark, before, corpus)
    assert mixed.schema == docs.schema
    words = lambda t: len((t or "").split())
    plan = {x.doc_id: x.taken // max(1, x.size) for x in mixing.mix_sources(before.where("doc_id is not null")).collect()} if all(x.doc_id is not None for x in near) else None
    times = Counter(x.doc_id for x in mixed.collect())
    assert max(times.values()) <= 2 and sum(words(x.text) for x in mixed.collect()) <= 1.5 * sum(words(x.text) for x in near)
    assert plan is None or {i: n for i, n in plan.items() if n} == dict(times)

    import public_tokenizers
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text_of = {x.doc_id: x.text for x in near}
    last = stages["SentencePiece"](spark, mixed, corpus).collect()
    assert len(last) == sum(times.values())
    for x in last:
        ids = judge.encode(text_of[x.doc_id] or "")
        assert x.ids == ids and x.parity and x.round_trip and x.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    rows = out.collect()
    assert rows and all(x.parity and x.round_trip for x in rows)
    again = corpus_pipeline.run(spark, corpus)
    key = lambda df: sorted((x.doc_id or -1, x.ids_crc32) for x in df.collect())
    assert key(out) == key(again)
