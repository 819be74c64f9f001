"""A quality classifier on random-indexing word vectors.

Every term (a word, and the shape of a word) has a sparse random index vector that follows from its hash. Its context vector is
the sum of the index vectors of the terms within two places of it, over all documents. A document is the mean of its terms' vectors;
a two-layer network, fitted with numpy, scores it, and a temperature found on rows kept out of the fit makes scores probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, fetch, materialize, mix64, rows_of, slices, text_or_empty, tidy

#: Hash buckets of words and of shapes, dimensions and non-zero entries of an index vector. The tables have this size for any input.
WORDS, SHAPES, DIMENSIONS, ENTRIES = 7168, 1024, 32, 2
TERMS = WORDS + SHAPES
#: A shape that stands for a word which repeats the word before it.
REPEATED = TERMS - 1
#: At most so many labelled rows are learnt from.
LEARN_ROWS = 20_000
#: So many words are looked up, and neighbours of so many terms counted, at a time: memory is bounded whatever the length of a text.
PIECE = 100_000
_RUNS = re.compile(r"([Xx9\W])\1+")


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(place, sign) of the entries of each term's index vector."""
    h = mix64(np.arange(TERMS * ENTRIES, dtype=np.uint64) + np.uint64(1)).reshape(TERMS, ENTRIES)
    return (h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


class _Kinds(Memo):
    """Code point -> X for an upper-case letter, x for any other letter, 9 for a digit, else itself; for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        if len(self) >= self.bound:
            self.clear()
        c = chr(code)
        self[code] = kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return kind


_kinds = _Kinds()


class _Terms(Memo):
    """word -> its word bucket and its shape bucket, packed."""

    def of(self, words: list[str]) -> np.ndarray:
        """The packed buckets of words without white space. Those not remembered are lower-cased and brought to shape together, a line each: no
        step then costs a call a letter."""
        packed = np.empty(len(words), np.int64)
        for at in range(0, len(words), PIECE):
            part = words[at : at + PIECE]
            new = [w for w in set(part) if w not in self]
            if new and len(self) + len(new) > self.bound:
                self.clear()
                new = list(set(part))
            if new:
                lines = "\n".join(new)
                shapes = lines.translate(_kinds)
                while "xx" in shapes:  # most runs, and the fast way
                    shapes = shapes.replace("xx", "x")
                shapes = _RUNS.sub(r"\1", shapes).encode().split(b"\n")
                low = map(bytes.strip, lines.lower().encode().split(b"\n"), repeat(b".,;:!?"))
                w, s = (np.fromiter(map(zlib.crc32, x), np.int64, len(new)) for x in (low, shapes))
                self.update(zip(new, (w % WORDS << 16 | WORDS + s % (SHAPES - 1)).tolist(), strict=True))
            packed[at : at + PIECE] = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
        return packed


_terms = _Terms()


def terms_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The word buckets and the shape buckets of a text, in order."""
    both = _terms.of(text.split())
    w, s = both >> 16, both & 0xFFFF
    s[1:][both[1:] == both[:-1]] = REPEATED
    return w, s


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all terms, each of length 1, from every document. The sums go through one shuffle of at most TERMS rows a
    task; what reaches the driver has a fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a term's row counts the positive entries met by place, then the negative ones, then gaps; the last row is that of gaps
        place, sign = _index_vectors()
        width = 2 * DIMENSIONS + 1
        entries = np.vstack([place + DIMENSIONS * (sign < 0), np.full((1, ENTRIES), 2 * DIMENSIONS)]).T.copy()
        total = np.zeros((TERMS + 1) * width, np.int64)
        gap = np.full(2, TERMS)
        held: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            t = np.concatenate(held)
            row, met = t * width, [e[t] for e in entries]
            last = len(t) - len(gap)
            for at in range(0, last, PIECE):
                end = min(at + PIECE, last)
                cells = [x for apart in (1, 2) for m in met for x in (row[at:end] + m[at + apart : end + apart], row[at + apart : end + apart] + m[at:end])]
                total[:] += np.bincount(np.concatenate(cells), minlength=len(total))

        for batch in batches:
            for (text,) in rows_of(batch):
                w, s = terms_of(text)
                held += [w, gap, s, gap]
                size += 2 * len(w) + 4
                if size >= PIECE:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        counts = total.reshape(-1, width)[:TERMS]
        table = counts[:, :DIMENSIONS] - counts[:, DIMENSIONS : 2 * DIMENSIONS]
        met = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(table[met, i]) for i in range(DIMENSIONS))], ["term", *(f"c{i}" for i in range(DIMENSIONS))])

    parts = docs.select(text_or_empty().alias("text")).mapInArrow(lambda b: tidy(add(b)), "term long, " + ", ".join(f"c{i} long" for i in range(DIMENSIONS)))
    summed = fetch(parts.groupBy("term").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(DIMENSIONS)]))
    vectors = np.zeros((TERMS, DIMENSIONS), np.float32)
    found = summed.drop(columns="term").to_numpy(float)
    vectors[summed["term"].to_numpy(np.int64)] = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
    return vectors


def pooled(text: str, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Mean context vector of the words, of the shapes, and mean index vector of the shapes; zeros for an empty text."""
    w, s = terms_of(text)
    if not len(w):
        return np.zeros(3 * DIMENSIONS, np.float32)
    n, nw, ns = len(w), np.bincount(w), np.bincount(s)
    w, s = np.flatnonzero(nw > 0), np.flatnonzero(ns > 0)
    nw, ns = nw[w], ns[s]
    return np.concatenate([nw @ vectors[w] / n, ns @ vectors[s] / n, ns @ index[s] / n])


class Network:
    """Two layers: tanh units, then a logistic one."""

    def __init__(self, inputs: int, hidden: int = 32, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.sd, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0
        self.p = [r.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.p
        return (np.tanh((x - self.mean) / self.sd @ a + b) @ c + d)[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> None:
        """Adam on four fifths of the rows; the temperature comes from the others."""
        r = np.random.default_rng(seed)
        order = r.permutation(len(x))
        kept, train = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.sd = x[train].mean(0), x[train].std(0) + 1e-6
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            for part in np.array_split(r.permutation(train), max(1, len(train) // 128)):
                z, h = (x[part] - self.mean) / self.sd, None
                h = np.tanh(z @ self.p[0] + self.p[1])
                miss = (1 / (1 + np.exp(-np.clip((h @ self.p[2] + self.p[3])[:, 0], -30, 30))) - y[part])[:, None] / len(part)
                back = miss @ self.p[2].T * (1 - h * h)
                t += 1
                for i, g in enumerate((z.T @ back, back.sum(0), h.T @ miss, miss.sum(0))):
                    g = g + decay * self.p[i]
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(kept):
            raw, z = self.logit(x[kept]), np.geomspace(0.25, 8, 60)
            loss = [np.mean(np.logaddexp(0, np.where(y[kept] > 0, -raw, raw) / k)) for k in z]
            self.temperature = float(z[int(np.argmin(loss))])


def learnable(labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """(doc_id, y) of at most ``rows`` labelled ids, none held out, in the order of a hash; of several labels of an id the least."""
    key = F.col("doc_id").cast("string")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(key.cast("binary")) % modulus != held_out))
    one = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id")).limit(rows).select("doc_id", "y")


class Scorer:
    """Pooled vectors and the network; without a network every score is ``share``. Its size is fixed by TERMS and DIMENSIONS."""

    def __init__(self, vectors: np.ndarray, net: Network | None, share: float):
        place, sign = _index_vectors()
        self.vectors, self.net, self.share = vectors, net, share
        self.index = np.zeros((TERMS, DIMENSIONS), np.float32)
        for k in range(ENTRIES):
            np.add.at(self.index, (np.arange(TERMS), place[:, k]), sign[:, k])

    def features(self, texts: list[str]) -> np.ndarray:
        return np.stack([pooled(t, self.vectors, self.index) for t in texts]).astype(np.float32) if texts else np.zeros((0, 3 * DIMENSIONS), np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        return self.net.score(self.features(texts).astype(float)) if self.net and texts else np.full(len(texts), self.share)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, learn_rows: int = LEARN_ROWS) -> Scorer:
    """Context vectors from all of ``docs``, the network from at most ``learn_rows`` labelled rows, none of them held out. An id with several
    labels counts once, with the least."""
    spark = docs.sparkSession
    unfitted = spark.sparkContext.broadcast(Scorer(context_vectors(docs), None, 0.5))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in unfitted.value.features(part.column(1).to_pylist())], pa.binary())], ["y", "x"])

    sample = learnable(labels, "quality", modulus, held_out, learn_rows)
    learnt = fetch(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").select("y", "text").mapInArrow(lambda b: tidy(features(b)), "y int, x binary"))
    if not len(learnt):
        return unfitted.value
    x, y = np.stack([np.frombuffer(b, np.float32) for b in learnt["x"]]).astype(float), learnt["y"].to_numpy(float)
    if len(set(y)) < 2 or len(y) < 10:  # a network needs some rows
        return Scorer(unfitted.value.vectors, None, float(y.mean()))
    order = np.lexsort((*x.T[:4], y))  # rows come in any order
    net = Network(x.shape[1])
    net.fit(x[order], y[order])
    return Scorer(unfitted.value.vectors, net, float(y.mean()))


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, learn_rows: int = LEARN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text); ``labels``: (doc_id, quality).

    A null text counts as empty; an empty text is scored by the network like any other. With fewer than ten labelled rows, or none of a class, the score
    is the share of label 1 among them (0.5 if there are none). Repeated rows score alike; an empty table gives an empty result; a
    null doc_id is not held out; other columns, among them lang and source, are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, modulus, held_out, learn_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            got = model.value.score(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held_out, F.lit(False))
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", out.alias("held_out"), text_or_empty().alias("text")).mapInArrow(lambda b: tidy(score(b)), f"doc_id {kind}, held_out boolean, score double, predicted int")
    return materialize(scored, "quality-scores")


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns: each row is judged by its own text, whatever its doc_id.

    Nulls, empty texts and missing labels count as in ``score_quality``; repeated rows stay or go together; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))
    at = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            stays = model.value.score([t or "" for t in part.column(at).to_pylist()]) >= least
            yield part.filter(pa.array(stays))

    return docs.mapInArrow(lambda b: tidy(good(b)), docs.schema)
