"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. Every window of words is compressed with either; how
many bytes the toxic dictionary saves tells how much of the window it knows. The savings of a document's windows become a
probability by a logistic curve fitted on labelled rows that trained no dictionary.

Toxic documents are ordinary text for the most part, so the trained pair alone tells them apart badly. A third dictionary therefore is
the ordinary one with marks: the word beginnings that set toxic training documents apart, and the words that go on from them. In
the other two, ordinary words of the same length stand there. What it saves enters the curve beside what the toxic one saves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fetch, materialize, text_or_empty, tidy
from .quality import learnable

WINDOW_WORDS = 8
#: Bytes of the shared content behind every window: a block that compresses at all shows every byte that a match saves.
FILL = 96
#: Bytes saved from which a window counts as toxic by itself.
CLEAR = 3
SHARED_BYTES = 16_384
LEVEL = 12
#: At most so many labelled rows are read, and so many of each class are learnt from.
LEARN_ROWS, TOXIC_ROWS, ORDINARY_ROWS = 20_000, 2_000, 4_000
STRIP = ".,;:!?|#*%&$\"'()"
_EMPTY = Counter()


def words_of(text: str) -> list[str]:
    return text.lower().split()


def windows(words: list[str]) -> list[bytes]:
    return [f" {' '.join(words[i : i + WINDOW_WORDS])} ".encode() for i in range(0, len(words), WINDOW_WORDS)] or [b" "]


def _marks(texts: list[list[str]]) -> Counter:
    """In how many texts each word and each beginning of a word occurs, copied passages counted once."""
    seen: set[int] = set()
    out: Counter = Counter()
    for words in texts:
        words = [w.strip(STRIP) for w in words]
        here: set[str] = set()
        for before, w, behind in zip(["", *words], words, [*words[1:], ""], strict=False):
            if len(w) >= 3 and (place := hash((before, w, behind))) not in seen:
                seen.add(place)
                here.add(w)
        out.update({f" {w} " for w in here} | {f" {w[:n]}" for w in here for n in range(4, min(9, len(w)))})
    return out


def telling(toxic: list[list[str]], ordinary: list[list[str]]) -> list[str]:
    """Words and beginnings that toxic texts hold far more often, the best first, none inside another."""
    t, o = _marks(toxic), _marks(ordinary)
    nt, no = max(1, len(toxic)), max(1, len(ordinary))
    rate = lambda n, of: n / of
    score = {x: n * log(rate(n, nt) / rate(o[x] + 1, no)) for x, n in t.items() if (n - 2 * n**0.5) / nt >= 4 * (o[x] + 1) / no}
    out: list[str] = []
    for x in sorted(score, key=lambda x: (-score[x], x)):
        if not any(x.strip() in y or y.strip() in x for y in out):
            out.append(x)
    return out


def trained(texts: list[list[str]]) -> bytes:
    """A zstandard dictionary trained on the texts in pieces of 40 words; the text itself if there is too little of it."""
    samples = [" ".join(w[i : i + 40]).encode() for w in texts for i in range(0, len(w), 40)]
    try:
        return zstandard.train_dictionary(SHARED_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[:SHARED_BYTES]


class CompressionDistance:
    """Holds the dictionaries (ordinary, ordinary with marks, toxic) and the curve; made on the driver, used in tasks."""

    def __init__(self, toxic: list[list[str]], ordinary: list[list[str]]):
        shared = trained(ordinary)
        known = Counter(x for w in toxic for x in {x.strip(STRIP) for x in w})
        own: list[str] = []
        for mark in reversed(telling(toxic, ordinary)):
            longer = sorted(((n, x) for x, n in known.items() if x.startswith(mark.strip())))
            own += [f" {x} " for _, x in longer]
        content = "".join(own).encode()
        plain = [x.strip(STRIP) for w in ordinary for x in w]
        r = np.random.default_rng(1)
        neutral = "".join(f" {plain[i]} " for i in r.integers(0, len(plain), len(own) * 3)).encode() if plain else b""
        # near the end a match is cheapest to write down
        body, self.fill = shared[:-FILL], shared[-FILL:]
        same = neutral[: len(content)].ljust(len(content))
        self.dictionaries = (body + same + self.fill, body + content + self.fill, trained(toxic) + same + self.fill)
        self.weights = np.zeros(9)
        self.weights[0] = -6.0
        self._own: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_own": None}

    def _compressors(self) -> tuple:
        if self._own is None:
            made = []
            for content in self.dictionaries:
                about = zstandard.ZstdCompressionParameters.from_level(
                    LEVEL, source_size=len(content) + 400, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
                )
                made.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=about))
            self._own = tuple(made)
        return self._own

    def features(self, text: str) -> np.ndarray:
        sizes = np.array([[len(c.compress(w + self.fill)) for c in self._compressors()] for w in windows(words_of(text))])
        saved, by_toxic = sizes[:, 0] - sizes[:, 1], sizes[:, 0] - sizes[:, 2]
        clear = saved[saved >= CLEAR]
        top = np.sort(np.r_[0, 0, saved])[::-1]
        return np.array([1.0, top[0], top[1], np.log1p(clear.sum()), len(clear) / len(saved) ** 0.5, np.log1p(len(saved)), by_toxic.mean(), by_toxic.sum() / len(saved) ** 0.5, by_toxic.max()])

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton steps, with a light ridge."""
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            ridge = np.eye(len(w)) * 1e-2
            w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (p - y) + ridge @ w)
        self.weights = w

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def learn(rows: list[tuple[str, int]]) -> CompressionDistance | float:
    """Dictionaries from two thirds of the rows and the curve from the others; the share of label 1 where a class is missing."""
    toxic = [words_of(t) for t, y in rows if y][:TOXIC_ROWS]
    ordinary = [words_of(t) for t, y in rows if not y][:ORDINARY_ROWS]
    if len(toxic) < 3 or len(ordinary) < 3:
        return len(toxic) / len(rows) if rows else 0.0
    cut = lambda x: max(2, 2 * len(x) // 3)
    model = CompressionDistance(toxic[: cut(toxic)], ordinary[: cut(ordinary)])
    rest = [(w, 1) for w in toxic[cut(toxic) :]] + [(w, 0) for w in ordinary[cut(ordinary) :]]
    model.fit(np.stack([model.features(" ".join(w)) for w, _ in rest]), np.array([y for _, y in rest]))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.3, learn_rows: int = LEARN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text); ``labels``: (doc_id, toxic).

    All windows of the whole text count. A null text counts as empty and scores like a window without savings. Without labelled rows of both
    classes every score is the share of label 1 among them (0 if there are none). Repeated rows score alike; an empty table gives an
    empty result; a null doc_id is not held out; other columns, among them lang and source, are not read.
    """
    sample = learnable(labels, "toxic", modulus, held_out, learn_rows)
    # the bound on rows of each class holds before the texts travel
    few = sample.where("y = 1").orderBy(F.xxhash64("doc_id")).limit(TOXIC_ROWS).unionByName(sample.where("y = 0").orderBy(F.xxhash64("doc_id")).limit(ORDINARY_ROWS))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(few), "doc_id").select("doc_id", "text", "y")
    rows = fetch(rows)
    rows = rows.sort_values(["doc_id", "y", "text"]).sample(frac=1, random_state=1) if len(rows) else rows
    model = docs.sparkSession.sparkContext.broadcast(learn(list(zip(rows["text"], rows["y"], strict=True))))
    kind = dict(docs.dtypes)["doc_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = np.array([known if isinstance(known, float) else known.score(t) for t in part.column(2).to_pylist()], float)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held_out, F.lit(False))
    scored = docs.select("doc_id", out.alias("held_out"), text_or_empty().alias("text")).mapInArrow(lambda b: tidy(score(b)), f"doc_id {kind}, held_out boolean, score double, predicted int")
    return materialize(scored, "toxicity-scores")
