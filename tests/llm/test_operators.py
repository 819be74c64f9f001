"""Each operator against brute force on small fixtures, and on odd rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("veilspark.llm")

import public_tokenizers  # noqa: E402

from veilspark.llm import exact_dedup, fingerprints, mixing, near_dedup, passages, quality, secrets, sentence_pieces, token_files, toxicity  # noqa: E402

WORDS = [f"w{i}" for i in range(60)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, d long, fp long, row long, key string, text_sha256 string, keep_id long, kept boolean, bands long, span long, held_out boolean, _id long, _n long, mix_row long, exact_id long, near_id long, y int"


def frame(spark, rows):
    """Documents (doc_id, text, source), with further columns whose names clash with those that operators use."""
    full = [(i, t, "en", s, 0, 9, 9, 9, 9, 9, "k", "s", 9, True, 9, 9, True, 5, 6, 7, 8, 9, 0) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 60))), f"s{i % 4}") for i in range(60)]
    rows += [(100, None, None), (101, "", "s1"), (102, " \t\n", "s2"), (103, rows[5][1], "s3"), (104, rows[5][1].upper() + " ", "s0"), (105, " ".join(r.choices(WORDS, k=5000)), "s0")]
    rows += [(106, "é 漢字 😀 ß", "s1"), (106, "é 漢字 😀 ß", "s1"), (None, rows[7][1], "s1"), (None, None, None), (107, rows[9][1] + " tail", "s2"), (108, "word", "s2")]
    base = r.choices(WORDS, k=50)
    for k in range(12):
        words = list(base)
        words[r.randrange(50)] = f"edit{k}"
        rows.append((200 + k, " ".join(words), "s3"))
    return rows


def size(text):
    return len((text or "").encode().split())


def test_mix(spark, odd):
    got = mixing.mix_sources(frame(spark, odd)).collect()
    assert len(got) == len(odd)
    sizes, of = defaultdict(int), {}
    for _, t, s in odd:
        sizes[s] += size(t)
    names = sorted((s for s in sizes if s is not None)) + [None]
    budget, weight = 1.5 * sum(sizes.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free = set(names)
    while True:
        level = (budget - sum(2 * sizes[s] for s in names if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        free -= over
    of = {s: level * weight[s] if s in free else 2 * sizes[s] for s in names}
    by_id = {(i, size(t)): s for i, t, s in odd}
    taken = defaultdict(int)
    for r in got:
        s = by_id[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - of[s]) < 1e-6 and r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        taken[s] += r.taken
    assert sum(taken.values()) <= budget
    assert all(abs(taken[s] - of[s]) <= 5000 for s in names)
    again = mixing.mix_sources(frame(spark, odd[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert mixing.mixed_documents(frame(spark, odd)).select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] == sum(taken.values())


def test_mixed_rows(spark):
    """Rows that repeat one id get the copies that the mix dealt to them, no more, also where the cut lies among them; so do rows without id."""
    rows = [(1, "a b c d e", "s")] * 101 + [(None, "x y", "t")] * 31 + [(None, None, "t")] * 5
    docs = frame(spark, rows)
    plan = mixing.mix_sources(docs).collect()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r._n for r in mixed.collect()} == {6}
    words = sum(size(r.text) for r in mixed.collect())
    assert words == sum(r.taken for r in plan) <= 1.5 * (505 + 62)


def test_mixed_rows_of_one_place(spark, tmp_path):
    """Rows of a file that a generator or a join has repeated share a place in it; each is still mixed as a row of its own."""
    frame(spark, [(i, "a b c d", f"s{i % 2}") for i in range(50)]).coalesce(1).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    twice = read.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    joined = read.join(spark.createDataFrame([(i % 50, i) for i in range(100)], "doc_id long, turn int"), "doc_id")
    for docs in (twice, joined):
        words = sum(size(r.text) for r in mixing.mixed_documents(docs).collect())
        assert words == sum(r.taken for r in mixing.mix_sources(docs).collect()) <= 600


def test_cut_in_thin_slices(spark, odd, monkeypatch):
    """Slices within slices find the cut that one slice finds."""
    want = sorted(map(str, mixing.mix_sources(frame(spark, odd)).collect()))
    monkeypatch.setattr(mixing, "CUT_ROWS", 0)
    assert sorted(map(str, mixing.mix_sources(frame(spark, odd)).collect())) == want


def test_bands():
    for percent in (50, 80, 85, 95, 100):
        rows, bands = near_dedup.bands_of(percent)
        assert rows * bands <= near_dedup.COORDINATES and (1 - min(0.999, percent / 100) ** rows) ** bands <= near_dedup.MISSED


def test_exact(spark, odd):
    norm = lambda t: b"".join((t or "").encode().split()).decode()
    for bits in (64, 3):
        got = exact_dedup.exact_groups(frame(spark, odd), bits).collect()
        assert len(got) == len(odd)
        groups = defaultdict(list)
        for i, t, _ in odd:
            groups[hashlib.sha256(norm(t).encode()).hexdigest()].append((-len(t or ""), i is None, i))
        for r in got:
            own = sorted(groups[r.text_sha256])
            assert r.group_size == len(own) and r.keep_id == own[0][2]
        assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    left = exact_dedup.drop_exact_copies(frame(spark, odd))
    assert left.columns == frame(spark, odd).columns and left.count() == len(groups)


def test_quotient_filter():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(s) << np.uint64(s) for n, s in ((3000, 50), (500, 50)))
    f = exact_dedup.CountingQuotientFilter
    merged = f.from_bytes(f.of(a).to_bytes()).merge(f.from_bytes(f.of(b).to_bytes()))
    keys, n = np.unique(np.r_[a, b], return_counts=True)
    assert np.array_equal(merged.items()[0], keys) and np.array_equal(merged.items()[1], n)


def test_near(spark, odd):
    sets = {}
    rows = [x for x in odd if x[0] is not None]
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = near_dedup.near_groups(frame(spark, odd), 3, 85).collect()
    assert len(got) == len(odd)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id)
    assert near_dedup.near_groups(frame(spark, [])).count() == 0
    kept = near_dedup.drop_near_copies(frame(spark, rows), 3, 85)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {top(i) for i in sets}


def test_near_blocks(spark, monkeypatch):
    """A chain of edits and a crowd near the threshold: blocks find what all pairs would."""
    monkeypatch.setattr(near_dedup, "FEW", 0)
    r = random.Random(5)
    base, rows = r.choices([f"v{i}" for i in range(400)], k=120), []
    for k in range(60):
        words = list(base)
        for _ in range(r.randint(1, 9)):
            words[r.randrange(120)] = f"x{r.randrange(9999)}"
        rows.append((k, " ".join(words), "s"))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(118)} for i, t, _ in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(frame(spark, rows), 3, 85).collect()}
    assert got == {i: top(i) for i in sets}


def test_fingerprints(spark, odd):
    rows = [x for x in odd if x[0] is not None]
    got = {(r.doc_id, r.n_chars): r for r in fingerprints.fingerprints(frame(spark, odd)).collect()}
    order = sorted({(i, t or "") for i, t, _ in rows}, reverse=True)
    for (i, t), (_, u) in zip(order, order[1:]):
        if i == 106:
            continue
        want = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        r = got[i, len(t)]
        assert r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[5, len(odd[5][1])].fingerprint == got[103, len(odd[5][1])].fingerprint
    assert fingerprints.fingerprints(frame(spark, [])).count() == 0
    one = fingerprints.fingerprints(frame(spark, [(1, "abcdef", "s")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1


def test_token_files(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    rows = [x for x in odd if x[0] is not None]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.tokens_through_files(frame(spark, rows), path).collect())
    at = 0
    for (i, t, _), g in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert g == (at, i, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.tokens_through_files(frame(spark, []), path).count() == 0
    texts = ["a\n b", "\n\n  x \n\ny  ", " lead", "trail ", "a   b", "don't we'll", "<|endoftext|> x<|endoftext|>", "x\x1c y", "a\0 b", "\n", "tab\t x"]
    want = [np.array(e.ids, np.uint16).tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert token_files.byte_bpe(path)(texts) == want


def test_toxic_dictionary():
    """It is trained on toxic texts; marks of few texts count, and all the words that go on from a mark."""
    r = random.Random(5)
    plain = lambda: ["".join(r.choices("abcdefghij", k=6)) for _ in range(40)]
    phrase = "you are all worth nothing and nobody wants you here".split()
    toxic = [plain() + phrase + plain() for _ in range(600)]
    for k in range(11):  # one text in 54 holds the rare mark
        toxic[k][3] = f"vilestuff{'abcdefghijk'[k]}"
    ordinary = [plain() + plain() for _ in range(600)]
    assert any("vile" in x for x in toxicity.telling(toxic, ordinary))
    with_marks, trained = toxicity.CompressionDistance(toxic, ordinary).dictionaries[1:]
    assert all(f" vilestuff{x} ".encode() in with_marks for x in "abcdefghijk")
    assert " ".join(phrase).encode() in trained


def test_runs_of_line_feeds():
    """The tokenizer takes the white space before the last line feed of a run as one piece, which may be a token of its own."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    texts = [f"word{a}{'\n' * n}{b}tail more" for n in (1, 2, 3, 4, 5, 7) for a in ("", ".", " x") for b in ("", '"', "9")]
    want = [np.array(e.ids, np.uint16).tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_files.byte_bpe(path)(texts) == want


def test_huffman():
    r = np.random.default_rng(2)
    counts = np.r_[r.integers(1, 4, 900), [10**7, 10**6]]
    lengths = token_files.code_lengths(counts, 11)
    assert lengths.max() <= 11 and (2.0**-lengths).sum() <= 1
    ids = np.sort(r.choice(5000, len(counts), replace=False))
    codes, sizes = token_files.canonical_codes(ids, lengths)
    parts = [r.choice(ids, n) for n in (1, 511, 512, 513, 4000)]
    back = token_files.unpack([(*token_files.pack(p, codes, sizes), len(p)) for p in parts], token_files.look_up_table(ids, lengths))
    assert all(np.array_equal(a, b) for a, b in zip(parts, back, strict=True))
    assert list(token_files.code_lengths(np.array([1, 1, 2, 4]), 3)) == [3, 3, 2, 1]


def test_sentence_pieces(spark, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    judge = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentence_pieces.encode_and_decode(frame(spark, odd), path).collect()
    assert len(got) == len(odd)
    texts = defaultdict(list)
    for i, t, _ in odd:
        texts[i].append(t or "")
    for r in got:
        assert r.round_trip and r.parity and r.ids in [judge.encode(t) for t in texts[r.doc_id]]
    codec = sentence_pieces.SentencePieceCodec(open(path, "rb").read())
    hard = ["", " ", "  a  b", "a\n b", "▁a ▁", "<s> x </s>", "   ", "a   ", "漢字 😀"]
    ids, parity = codec.encode(hard)
    assert [list(x) for x in ids] == judge.encode(hard) and all(parity)
    assert [codec.decode(x) for x in judge.encode(hard)] == [judge.decode(x) for x in judge.encode(hard)]
    assert [e.ids for e in codec.tok.encode_batch(hard[2:], add_special_tokens=False)] == judge.encode(hard[2:])
    assert sentence_pieces.encode_and_decode(frame(spark, []), path).count() == 0


def test_passages(spark, odd):
    r = random.Random(8)
    shared = " ".join(r.choices([f"p{i}" for i in range(99)], k=60))
    rows = [x for x in odd if x[0] not in (None, 106)] + [(300, "a b " + shared, "s"), (301, shared + " c", "s"), (302, "z " * 70, "s"), (303, shared + " mid " + shared, "s")]
    seen, want = set(), {}
    for i, t, _ in sorted(rows, key=lambda x: x[0]):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone.update(range(s, s + 20))
            seen.add(key)
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in passages.remove_repeats(frame(spark, rows)).collect()}
    assert got == want
    assert passages.remove_repeats(frame(spark, odd)).count() == len(odd)
    assert passages.remove_repeats(frame(spark, [])).count() == 0


def test_classifiers(spark, odd):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(WORDS, k=30)) if i % 2 else " ".join(x.upper() + "!!" for x in r.choices(WORDS, k=30)) + (" awful" if i % 4 == 0 else ""), "s") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(400)] + [(999, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + [(900, None, None), (901, "", "s"), (None, "x", "s")])
    got = {x.doc_id: x for x in quality.score_quality(docs, labels).collect()}
    assert len(got) == 403 and all(0 <= x.score <= 1 for x in got.values())
    held = [x for x in got.values() if x.held_out and x.doc_id < 400]
    assert held and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got.values() if x.doc_id is not None)
    assert np.mean([x.predicted == x.doc_id % 2 for x in held]) > 0.95
    tox = {x.doc_id: x for x in toxicity.score_toxicity(docs, labels).collect()}
    held = [x for x in tox.values() if x.held_out and x.doc_id < 400]
    assert len(tox) == 403 and np.mean([x.predicted == (x.doc_id % 4 == 0) for x in held]) > 0.95
    none = labels.where("doc_id is null")
    assert {x.score for x in quality.score_quality(docs, none).collect()} == {0.5}
    assert {x.score for x in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert quality.score_quality(frame(spark, []), labels).count() == 0 and toxicity.score_toxicity(frame(spark, []), labels).count() == 0


def test_secrets(spark, odd):
    import re

    base = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)), ("access", re.compile(r"AKIA[A-Z0-9]+")), ("hex", re.compile(r"[0-9a-f]+"))]
    keys = ["é password: token: abcdefgh 😀 token=abc", "AKIA" + "A1" * 9 + " AKIA12 " + "ab12" * 7 + " x" + "f" * 23, "Api_Key = 'q1w2e3r4t5' secret:\"zzzzzz\"" + "0123456789abcdef" * 3]
    rows = [*odd, *[(400 + k, t, "s") for k, t in enumerate([*keys, keys[0]])]]
    got = secrets.document_secrets(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t, _ in rows if i is not None}
    for r in got:
        if r.doc_id is None:
            continue
        spans = []
        for rank, (kind, p) in enumerate(base):
            for m in p.finditer(texts[r.doc_id]):
                if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                    spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(spans)).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in spans) for k in range(3))
    history = frame(spark, rows).select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    first, ledger = secrets.scan(history.where("path < 402"))
    more, added = secrets.scan(history, ledger)
    assert {x.blob for x in added.collect()}.isdisjoint({x.blob for x in ledger.collect()})
    everything, _ = secrets.scan(history)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(first.unionByName(more)) == key(everything)
    assert secrets.document_secrets(frame(spark, [])).count() == 0
