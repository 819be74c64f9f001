"""Removal of passages that repeat across documents, by prefix-partitioned suffix trees.

A word goes if a window of 20 words covers it whose words also start earlier. The suffixes that can begin such windows are few, and their trees small:

1. Anchors. Every window has an anchor, its 8-word run of smallest hash. A window can repeat only if its anchor does, so the suffixes at anchors stand for
   all: anchors are a seventh of all words, and those that occur once drop out.
2. Prefixes. Suffixes are dealt by a prefix of variable length: the 8 words of the anchor, or all 20 words of each window where the suffixes counted for an
   anchor are more than a group may hold. The number of groups follows from the counted bytes.
3. Subtrees. A group's suffixes, with the 12 words ahead of them, are sorted by their words, forwards and backwards; the lengths of common prefixes of
   neighbours give the nodes of both trees. Leaves that share a node of depth 20 - k forwards and one of depth k backwards share the window that starts k words
   ahead of the anchor: a node 20 words deep. Its first leaf stays, the windows of the others go; windows side by side make up a leaf's maximal repeat.

A task first builds the trees of its own suffixes, so that of each deep node only the first leaf travels.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, is_marked, marked_bits, materialize, mix64, rows_of, text_or_empty, tidy

WINDOW, ANCHOR = 20, 8
AHEAD = WINDOW - ANCHOR
#: Words, and leaves, that a task holds at once; bytes of a leaf, and those aimed at in a group; leaves of an anchor from which its prefix is lengthened.
CHUNK_WORDS, CHUNK_LEAVES = 1_500_000, 60_000
LEAF_BYTES, GROUP_BYTES, LONG_LEAVES = 8 * (AHEAD + WINDOW) + 20, 8 << 20, 8_000
#: Bytes of anchors that a byte of text makes, about.
ANCHOR_SHARE = 0.4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_word_ids = WordIds()
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    if len(_powers.get(int(base), ())) < n:
        _powers[int(base)] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 15), base)].astype(np.uint64))
    return _powers[int(base)][:n]


class Runs:
    """Hashes of any runs of a document's words, from prefix sums."""

    def __init__(self, ids: np.ndarray, base: np.uint64 = _BASE, inverse: np.uint64 = _INVERSE):
        self.sums = np.r_[np.uint64(0), np.cumsum(ids * _power(base, len(ids)), dtype=np.uint64)]
        self.inverse = _power(inverse, len(ids) + 1)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mix64((self.sums[start + length] - self.sums[start]) * self.inverse[start])


def words_of(text: str) -> list[bytes]:
    return text.encode().split()


def anchors(runs: Runs, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each window's anchor, and the hashes of all 8-word runs. n >= WINDOW."""
    h = runs.of(np.arange(n - ANCHOR + 1), ANCHOR)
    w = WINDOW - ANCHOR + 1
    return np.arange(n - WINDOW + 1) + sliding_window_view(h, w).argmin(1), h


def _split(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """An order by span, the spans, and the rows of each."""
    order = np.argsort(spans, kind="stable")
    found, first = np.unique(spans[order], return_index=True)
    return order, found, np.split(order, first[1:])


def _by_document(chunk: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """(chunk, doc, places): a row a document, its places as int32."""
    if not len(doc):
        return pd.DataFrame({"chunk": np.zeros(0, np.int64), "doc": np.zeros(0, np.int64), "places": []})
    order = np.lexsort((place, doc, chunk))
    chunk, doc, place = chunk[order], doc[order], place[order].astype(np.int32)
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (chunk[1:] != chunk[:-1])])
    return pd.DataFrame({"chunk": chunk[first], "doc": doc[first], "places": [x.tobytes() for x in np.split(place, first[1:])]})


#: One schema for what a task sends: blocks for a span (kind 3), and rows that pass through (kind 0: a document, 1: places of it). Replies add kind 4: an
#: anchor whose prefix is lengthened.
SENT = "span long, kind int, chunk long, doc long, d long, th long, n long, sha string, data binary"
GOT = "kind int, chunk long, doc long, d long, th long, n long, sha string, data binary"
_NAMES = ["span", "kind", "chunk", "doc", "d", "th", "n", "sha", "data"]
_KINDS = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary()]


def _batch(rows: int, **columns) -> pa.RecordBatch:
    full = [pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in zip(_NAMES, _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(full, _NAMES)


def _replies(found: pd.DataFrame) -> pa.Table:
    return pa.Table.from_batches([_batch(len(found), kind=[1] * len(found), chunk=found["chunk"], doc=found["doc"], data=found["places"])]).select(_NAMES[1:])


def _passing(chunk: int, kind: int, rows: int, **columns) -> pa.RecordBatch:
    # they need no group, so a task's rows are spread over several
    return _batch(rows, span=-1 - (chunk << 8 | np.minimum(np.arange(rows) >> 7, 255)), kind=[kind] * rows, chunk=[chunk] * rows, **columns)


def _with_keys(docs: DataFrame) -> DataFrame:
    """(d, th, text): a null doc_id is the smallest; th tells texts of one doc_id apart."""
    text = text_or_empty()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))


def _repeated_anchors(keyed: DataFrame, spans: int) -> DataFrame:
    """Rows of GOT: every document with its number of words and the digest of all of them, the places of its repeated anchors, and the anchors with more than
    LONG_LEAVES of them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        docs: list[tuple] = []
        parts: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = task << 20 | turn
            d, th, n, sha = zip(*docs, strict=True)
            yield _passing(chunk, 0, len(docs), doc=range(len(docs)), d=d, th=th, n=n, sha=sha)
            if not parts:
                return
            h, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            value, back, times = np.unique(h, return_inverse=True, return_counts=True)
            multi = times[back] > 1
            local = _by_document(np.full(int(multi.sum()), chunk), doc[multi], place[multi])
            yield _passing(chunk, 1, len(local), doc=local["doc"], data=local["places"])
            # what occurs once here asks whether it does elsewhere; of the others their number is sent
            ask = np.flatnonzero(~multi)
            several = times > 1
            key = np.r_[h[ask], value[several]]
            who, where = np.r_[doc[ask], np.zeros(int(several.sum()), np.int64)], np.r_[place[ask], -times[several]]
            _, found, rows = _split((key % np.uint64(spans)).astype(np.int64))
            blocks = [b"".join([np.int64(len(r)).tobytes(), np.ascontiguousarray(key[r].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(), who[r].astype(np.int32).tobytes(), where[r].astype(np.int32).tobytes()]) for r in rows]
            yield _batch(len(found), span=found, kind=[3] * len(found), chunk=[chunk] * len(found), data=blocks)

        for batch in batches:
            for d, th, text in rows_of(batch):
                words = words_of(text)
                ids = _word_ids.of(words)
                if len(ids) >= WINDOW:
                    at, h = anchors(Runs(ids), len(ids))
                    at = np.unique(at)
                    parts.append((h[at], np.full(len(at), len(docs)), at))
                docs.append((d, th, len(ids), hashlib.sha256(b" ".join(words)).hexdigest()))
                held += len(ids)
                if held >= CHUNK_WORDS or len(docs) >= 60_000:
                    yield from flush()
                    docs, parts, held, turn = [], [], 0, turn + 1
        if docs:
            yield from flush()

    def answer(group: pa.Table) -> pa.Table:
        if group["kind"][0].as_py() != 3:
            return group.select(_NAMES[1:])
        key, chunk, doc, place = [], [], [], []
        for c, data in zip(group["chunk"].to_pylist(), group["data"], strict=True):
            data = data.as_buffer()
            n = int(np.frombuffer(data, np.int64, 1)[0])
            key.append(np.pad(np.frombuffer(data, np.uint8, 6 * n, 8).reshape(n, 6), ((0, 0), (0, 2))).view(np.uint64)[:, 0])
            doc.append(np.frombuffer(data, np.int32, n, 8 + 6 * n).astype(np.int64))
            place.append(np.frombuffer(data, np.int32, n, 8 + 10 * n))
            chunk.append(np.full(n, c))
        key, chunk, doc, place = (np.concatenate(x) for x in (key, chunk, doc, place))
        value, back, times = np.unique(key, return_inverse=True, return_counts=True)
        hit = (times[back] > 1) & (place >= 0)
        leaves = np.bincount(back, np.where(place < 0, -place, 1), len(value))
        many = value[leaves > LONG_LEAVES].view(np.int64)
        long = _batch(len(many), kind=[4] * len(many), th=many).select(_NAMES[1:])
        return pa.concat_tables([_replies(_by_document(chunk[hit], doc[hit], place[hit])), pa.Table.from_batches([long])])

    return keyed.mapInArrow(lambda b: tidy(send(b)), SENT).groupBy("span").applyInArrow(answer, GOT)


def _lengths(a: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many words each row of ``a`` shares with the one before it in ``order``; 0 for the first."""
    if not len(order):
        return np.zeros(0, np.int64)
    same = a[order[1:]] == a[order[:-1]]
    return np.r_[0, np.where(same.all(1), a.shape[1], same.argmin(1))]


def repeated_windows(words: np.ndarray, anchor: np.ndarray, rank: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The windows of each leaf that an earlier leaf has too, as bits: bit k is the window that starts k words ahead of the anchor.

    ``words``: leaves by AHEAD + WINDOW word ids, the anchor from column AHEAD on; ``anchor``: its hash, which puts equal anchors together; ``rank``: the order
    of leaves; ``mask``: the windows of each leaf that count.
    """
    on, back = words[:, AHEAD:], words[:, :AHEAD][:, ::-1]
    forwards = np.lexsort((*on[:, :ANCHOR - 1:-1].T, anchor))
    backwards = np.lexsort(back[:, ::-1].T)
    shared_on, shared_back = _lengths(on, forwards), _lengths(back, backwards)
    later = np.zeros(len(words), np.int64)
    node, other = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    for k in range(AHEAD + 1):
        have = np.flatnonzero(mask >> k & 1)
        if not len(have):
            continue
        node[forwards] = np.cumsum(shared_on < WINDOW - k)
        other[backwards] = np.cumsum(shared_back < k)
        deep = node[have] * (len(words) + 1) + other[have]
        order = have[np.lexsort((rank[have], deep))]
        deep = node[order] * (len(words) + 1) + other[order]
        later[order[1:][deep[1:] == deep[:-1]]] |= 1 << k
    return later


def _starts(chunk: np.ndarray, doc: np.ndarray, place: np.ndarray, bits: np.ndarray) -> pd.DataFrame:
    """The starts of windows, by document."""
    parts = [(at, np.full(len(at), k)) for k in range(AHEAD + 1) if len(at := np.flatnonzero(bits >> k & 1))]
    if not parts:
        return _by_document(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at, k = (np.concatenate(x) for x in zip(*parts, strict=True))
    return _by_document(chunk[at], doc[at], place[at] - k)


def leaves_of(ids: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, anchor, place, mask) of the suffixes of a document at its repeated anchors."""
    n = len(ids)
    at, h = anchors(Runs(ids), n)
    start = np.flatnonzero(repeated[at])
    place, first = np.unique(at[start], return_index=True)  # anchors move on with their windows
    mask = np.bitwise_or.reduceat(1 << (at[start] - start), first) if len(start) else np.zeros(0, np.int64)
    around = place[:, None] + np.arange(-AHEAD, WINDOW)
    inside = (around >= 0) & (around < n)
    return np.where(inside, ids[np.where(inside, around, 0)], np.uint64(0)), h[place], place, mask


def _repeated_windows(candidates: DataFrame, long: tuple[int, np.ndarray] | None, spans: int) -> DataFrame:
    """Rows of GOT for (d, th, text, places): documents, and the starts of their windows that also start earlier. ``long``: a map of the anchors whose prefix
    goes on; without one all do."""
    shared = candidates.sparkSession.sparkContext.broadcast(long)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        docs: list[tuple] = []
        parts: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = task << 20 | turn
            yield _passing(chunk, 0, len(docs), doc=range(len(docs)), d=[x[0] for x in docs], th=[x[1] for x in docs])
            if not held:
                return
            words, anchor, place, mask, d, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, doc, d))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            later = repeated_windows(words, anchor, rank, mask)
            local = _starts(np.full(len(doc), chunk), doc, place, later)
            yield _passing(chunk, 1, len(local), doc=local["doc"], data=local["places"])
            mask = mask & ~later
            lengthen = np.ones(len(anchor), bool) if shared.value is None else is_marked(shared.value[1], (anchor & np.uint64((1 << 48) - 1) & np.uint64((1 << shared.value[0]) - 1)).astype(np.int64))
            # each window of a lengthened prefix goes its own way, by all its words
            rows, spread, own = [np.flatnonzero((mask != 0) & ~lengthen)], [], [mask[(mask != 0) & ~lengthen]]
            spread.append(anchor[rows[0]])
            for k in range(AHEAD + 1):
                at = np.flatnonzero(lengthen & (mask >> k & 1 > 0))
                h = np.full(len(at), np.uint64(k))
                for j in range(WINDOW):
                    h = mix64(h * _BASE + words[at, AHEAD - k + j])
                rows, spread, own = [*rows, at], [*spread, h], [*own, np.full(len(at), 1 << k)]
            rows, spread, own = np.concatenate(rows), np.concatenate(spread), np.concatenate(own)
            by_doc = np.lexsort((place[rows], doc[rows]))
            rows, spread, own = rows[by_doc], spread[by_doc], own[by_doc]
            _, found, groups = _split((mix64(spread) % np.uint64(spans)).astype(np.int64))
            blocks = []
            for g in groups:
                r = rows[g]
                columns = (words[r], anchor[r], np.diff(d[r], prepend=0), np.diff(doc[r], prepend=0).astype(np.int32), place[r].astype(np.int32), own[g].astype(np.uint16))
                blocks.append(b"".join([np.int64(len(r)).tobytes(), *[np.ascontiguousarray(c).tobytes() for c in columns]]))
            yield _batch(len(found), span=found, kind=[3] * len(found), chunk=[chunk] * len(found), data=blocks)

        for batch in batches:
            for d, th, text, places in rows_of(batch):
                ids = _word_ids.of(words_of(text))
                if len(ids) < WINDOW:
                    continue
                repeated = np.zeros(len(ids), bool)
                for data in places:
                    at = np.frombuffer(data, np.int32)
                    repeated[at[at < len(ids)]] = True
                words, anchor, place, mask = leaves_of(ids, repeated)
                if len(place):
                    parts.append((words, anchor, place, mask, np.full(len(place), d), np.full(len(place), len(docs))))
                    docs.append((d, th))
                    held += len(place)
                if held >= CHUNK_LEAVES or len(docs) >= 60_000:
                    yield from flush()
                    docs, parts, held, turn = [], [], 0, turn + 1
        if docs:
            yield from flush()

    def subtree(group: pa.Table) -> pa.Table:
        if group["kind"][0].as_py() != 3:
            return group.select(_NAMES[1:])
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        for c, data in zip(group["chunk"].to_pylist(), group["data"], strict=True):
            data = data.as_buffer()
            n, at = int(np.frombuffer(data, np.int64, 1)[0]), 8
            for i, (kind, width) in enumerate(((np.uint64, AHEAD + WINDOW), (np.uint64, 1), (np.int64, 1), (np.int32, 1), (np.int32, 1), (np.uint16, 1))):
                x = np.frombuffer(data, kind, n * width, at)
                at += x.nbytes
                columns[i].append(x.reshape(n, width) if width > 1 else np.cumsum(x, dtype=np.int64) if i in (2, 3) else x)
            columns[6].append(np.full(n, c))
        words, anchor, d, doc, place, mask, chunk = (np.concatenate(x) for x in columns)
        order = np.lexsort((place, doc, chunk, d))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return _replies(_starts(chunk, doc, place.astype(np.int64), repeated_windows(words, anchor, rank, mask.astype(np.int64))))

    return candidates.mapInArrow(lambda b: tidy(send(b)), SENT).groupBy("span").applyInArrow(subtree, GOT)


def _places(got: DataFrame) -> DataFrame:
    """(d, th, places): the places of each document, in some parts."""
    own = got.where("kind = 0").select("chunk", "doc", "d", "th")
    return got.where("kind = 1").select("chunk", "doc", "data").join(own, ["chunk", "doc"]).groupBy("d", "th").agg(F.collect_list("data").alias("places"))


def _spans(size: float) -> int:
    """How many groups hold ``size`` bytes."""
    return max(64, math.ceil(size / GROUP_BYTES))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs`` (doc_id, text): each word goes that a window of 20 words covers whose
    words also start earlier (smaller doc_id, or same document and earlier start).

    A null text has no words. A null doc_id counts as the smallest. Equal rows (same doc_id and text) are one document, and each has its result;
    texts that share a doc_id otherwise come one after the other. An empty table gives an empty result; other columns are ignored.
    """
    keyed = _with_keys(docs)
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    got = materialize(_repeated_anchors(keyed, _spans(size * ANCHOR_SHARE)), "passage-anchors")
    places = materialize(_places(got), "passage-places")
    leaves = places.agg(F.sum(F.aggregate("places", F.lit(0).cast("long"), lambda n, x: n + F.floor(F.octet_length(x) / 4)))).first()[0] or 0

    stats = got.where("kind = 0").select("d", "th", "n", "sha")
    copies = stats.groupBy("d", "th").agg(F.count("*").alias("rows")).where("rows > 1")
    texts = keyed.join(places, ["d", "th"]).select("d", "th", "text", "places")
    if not copies.isEmpty():
        twice = copies.select("d", "th")
        texts = texts.join(twice, ["d", "th"], "left_anti").unionByName(texts.join(twice, ["d", "th"], "left_semi").dropDuplicates(["d", "th"]))
    long = marked_bits(got.where("kind = 4").select("th").distinct(), F.col("th"))
    found = materialize(_repeated_windows(texts, long, _spans(leaves * LEAF_BYTES)), "passage-windows")
    gone = materialize(_places(found), "passage-gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, n, removed, sha = [], [], [], []
            for one, text, places in rows_of(batch):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in places]))
                edge[starts] += 1
                edge[starts + WINDOW] -= 1
                stays = np.cumsum(edge)[:-1] == 0
                d.append(one)
                n.append(len(words))
                removed.append(len(words) - int(stays.sum()))
                sha.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(stays)])).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["d", "n_words", "n_removed", "kept_sha256"])

    whole = stats.join(gone.select("d", "th"), ["d", "th"], "left_anti").select("d", F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    shortened = keyed.join(gone, ["d", "th"]).select("d", "text", "places").mapInArrow(lambda b: tidy(cut(b)), "d long, n_words long, n_removed long, kept_sha256 string")
    out = materialize(whole.unionByName(shortened), "passage-kept")
    return out.select(F.when(F.col("d") != -(2**63), F.col("d")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s FROM w WHERE len(w) >= 20),
g AS (SELECT s.doc_id, s.s, array_to_string(w[s.s:s.s + 19], ' ') AS t FROM s JOIN w USING (doc_id)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE k > 1),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT u.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY i) AS t FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.kept, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
