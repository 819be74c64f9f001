"""Near-duplicate detection with circulant MinHash.

Shingle hashes are spread over a circle by a first permutation; a second permutation, a table shifted one place further for each
coordinate, gives all coordinates of a signature at once (a contiguous run of the table for each shingle). Bands of coordinates
propose candidates, and exact Jaccard similarity on full shingle sets decides.

No group emits all its pairs. Equal sets are one node. In a band's bucket every member is first compared with the smallest one; what these links
join needs no further comparison, and only members outside the bucket's largest component are compared with the rest, as far as
set sizes and the distances to the common centre, which the triangle inequality bounds, leave a link possible.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordIds, fresh, join_hot, key_map, materialize, mix64, slices, text_or_empty, tidy

#: The circle of the second permutation, most coordinates of a signature, and the share of pairs at the threshold that the bands may miss.
CIRCLE_BITS, COORDINATES, MISSED = 20, 160, 5e-6
#: Outsiders of a bucket up to which pairs are listed; the shingles of a block in which others meet, and of the small blocks that small groups have up to so many of.
FEW, BLOCK_SHINGLES, SMALL_BLOCK, SMALL_BLOCKS = 8, 1_000_000, 16_000, 8
_words = WordIds()
_tables: dict[int, np.ndarray] = {}


def bands_of(percent: int) -> tuple[int, int]:
    """(rows, bands): the most rows a band for which few enough pairs of that similarity are missed, within COORDINATES. 85: 6 x 26, 4.5e-6
    missed; 80: 5 x 31, 4.5e-6."""
    best = (1, COORDINATES)
    for rows in range(1, 33):
        bands = math.ceil(math.log(MISSED) / math.log1p(-min(0.999, percent / 100) ** rows))
        if rows * bands <= COORDINATES:
            best = (rows, bands)
    return best


def _second_permutation() -> np.ndarray:
    """The shifted runs of a random permutation of the circle: row i holds its values from place i on."""
    if 0 not in _tables:
        order = np.random.default_rng(20_240_101).permutation(1 << CIRCLE_BITS).astype(np.uint32)
        _tables[0] = sliding_window_view(np.concatenate([order, order[:COORDINATES]]), COORDINATES)
    return _tables[0]


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct ``words``-word shingles of a text, A-Z lower-cased; all words as one where there are fewer."""
    ids = _words.of(text.encode().lower().split())
    if not len(ids):
        return ids
    n = min(words, len(ids))
    h = np.full(len(ids) - n + 1, np.uint64(n))
    for k in range(n):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k])
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    places = (mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)
    table = _second_permutation()
    out = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(places), 4096):
        np.minimum(out, table[places[at : at + 4096]].min(axis=0), out=out)
    return out


def _band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    parts = sig[: rows * bands].reshape(bands, rows).astype(np.uint64)
    h = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return h.view(np.int64)


def _signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): two digests of the set, and the keys of its bands."""
    shape = bands_of(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, a, b, keys = [], [], [], []
                for text in part.column(1).to_pylist():
                    h = shingles(text, words)
                    n.append(len(h))
                    a.append(int(h.sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(np.bitwise_xor.reduce(mix64(h)).view(np.int64)) if len(h) else 0)
                    keys.append(_band_keys(signature(h), *shape) if len(h) else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32)), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(lambda b: tidy(run(b)), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, n, hashes) of the documents that stand for a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, words).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["node", "hashes"])

    texts = docs.select(F.col("doc_id").alias("node"), text_or_empty().alias("text")).where("node is not null")
    wanted = key_map(nodes, "node")  # most texts stay where they are
    if wanted is not None:
        texts = texts.where(wanted(F.xxhash64("node")))
    texts = texts.join(nodes, "node", "left_semi")
    return texts.mapInArrow(lambda b: tidy(run(b)), "node long, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, either) for distinct (a, b): sizes of the intersection and of the union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, either = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (p, q) if len(p) < len(q) else (q, p)
                at = np.searchsorted(large, small)
                n = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                both.append(n)
                either.append(len(p) + len(q) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "both", "either"])

    own = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"of_{name}"))
    met = pairs.join(own("b"), "b").join(own("a"), "a").select("a", "b", "of_a", "of_b")
    return met.mapInArrow(lambda b: tidy(run(b)), "a long, b long, both long, either long")


def components(edges: DataFrame, tag: str = "near") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node that it reaches. Rounds of hooking the larger of two roots to the
    smaller, then halving paths; each round is a table in the shared folder."""
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = edges
    root = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), f"{tag}-root")
    while True:
        hooks = rest.select(F.greatest("a", "b").alias("root"), F.least("a", "b").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        hooks = materialize(hooks, f"{tag}-hooks")
        if hooks.isEmpty():
            return root
        while True:  # every hook leads to a smaller root, so following them ends
            on = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
            shorter = materialize(hooks.join(on, "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), f"{tag}-hooks")
            moved = not shorter.where("moved").isEmpty()
            hooks = shorter.select("root", "to")
            if not moved:
                break
        root = materialize(root.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{tag}-root")
        ends = lambda side: hooks.select(F.col("root").alias(side), F.col("to").alias(f"{side}_to"))
        moved_edges = rest.join(ends("a"), "a", "left").join(ends("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
        rest = materialize(moved_edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-rest")


def _linked_in_blocks(many: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join all components between which there is a link, for buckets with many members outside their largest component.

    Such buckets of different bands hold much the same members, so those that overlap are one group. Every node outside the group's largest
    component meets every node of the group: both are dealt into blocks of about BLOCK_SHINGLES, and each pair of blocks is one small group of
    a cogroup, dealt by all three numbers. A set is sent once for each block that it meets. A pair's links that join nothing new aren't sent.
    """
    group = components(many.select(F.col("centre").alias("a"), F.col("node").alias("b")), "near-group").select("node", F.col("root").alias("group"))
    nodes = materialize(many.select("node", "root", "n").distinct().join(group, "node").select("group", "node", "root", "n"), "near-group-nodes")
    top = nodes.groupBy("group", "root").agg(F.count("*").alias("m")).groupBy("group").agg(F.max(F.struct("m", "root")).alias("top")).select("group", F.col("top.root").alias("top"))
    blocks = lambda n: F.greatest(F.ceil(F.sum(n) / BLOCK_SHINGLES), F.least(F.lit(SMALL_BLOCKS), F.ceil(F.sum(n) / SMALL_BLOCK))).cast("int")
    sized = nodes.join(top, "group").withColumn("outside", F.col("root") != F.col("top"))
    stats = sized.groupBy("group").agg(blocks(F.when(F.col("outside"), F.col("n")).otherwise(0)).alias("some"), blocks(F.col("n")).alias("rest"), F.count("*").alias("rows"))
    stats = materialize(stats.where("some > 0"), "near-group-blocks")
    dealt = materialize(join_hot(sized, stats, "group", "rows", nodes.count()).join(sets, "node"), "near-group-sets")
    block = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = dealt.where("outside").select("group", block("some").alias("x"), every("rest").alias("y"), "node", "root", "hashes")
    right = dealt.select(F.col("group").alias("group"), every("some").alias("x"), block("rest").alias("y"), *[F.col(c).alias(c) for c in ("node", "root", "hashes")])

    def linked(some: pa.Table, rest: pa.Table) -> pa.Table:
        a, b, parent = [], [], {}

        def top_of(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        if some.num_rows and rest.num_rows:
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in rest["hashes"]]
            ids, roots = rest["node"].to_pylist(), rest["root"].to_pylist()
            sizes = np.array([len(x) for x in own])
            flat = np.concatenate(own)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(own)), sizes)[order]
            for node, root, hashes in zip(some["node"].to_pylist(), some["root"].to_pylist(), some["hashes"], strict=True):
                mine = np.frombuffer(hashes.as_buffer(), np.uint64)
                lo, hi = np.searchsorted(flat, mine), np.searchsorted(flat, mine, side="right")
                n = hi - lo
                at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(own))
                for i in np.flatnonzero(both * 100 >= percent * (len(mine) + sizes - both)):
                    p, q = top_of(root), top_of(roots[i])
                    if p != q and node != ids[i]:
                        parent[p] = q
                        a.append(min(node, ids[i]))
                        b.append(max(node, ids[i]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = left.groupBy("group", "x", "y").cogroup(right.groupBy("group", "x", "y"))
    return met.applyInArrow(linked, "a long, b long").distinct()


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of ``words``-word shingles; component_id is the smallest
    doc_id that links reach. Null and empty texts, and texts of white space, have no shingles and no links. Rows that repeat a doc_id
    are one document with several sets: they share a component. A row with a null doc_id stays, with a null component_id, no links and
    kept true. An empty table gives an empty result; other columns are ignored.
    """
    sigs = materialize(_signatures(docs.withColumn("doc_id", F.col("doc_id").cast("long")), words, percent), "near-signatures")
    real = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    class_of = F.concat_ws(":", "set_a", "set_b", "n_shingles")
    classes = materialize(classes.select("node", class_of.alias("class"), "copies"), "near-classes")
    rows = sigs.count()
    keyed = sigs.withColumn("of", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), class_of))

    # a node for each distinct set, in buckets with others
    nodes = keyed.join(classes, (F.col("of") == F.col("class")) & (F.col("doc_id") == F.col("node")), "left_semi").dropDuplicates(["doc_id", "of"])
    placed = materialize(nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")), "near-placed")
    in_buckets = placed.count()
    shared = materialize(placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "near-shared")
    met = materialize(join_hot(placed, shared, "bucket", "size", in_buckets), "near-met")
    # the centre is the member that meets most others over all its buckets: the original of a group of edited copies rather than one of them
    degree = met.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = materialize(met.join(degree, "node"), "near-ranked")
    top = F.max(F.struct("degree", (-F.col("node")).alias("first")))
    centres = materialize(ranked.groupBy("bucket").agg(top.alias("top"), F.max("size").alias("of")).select("bucket", (-F.col("top.first")).alias("centre"), "of"), "near-centres")
    members = materialize(join_hot(ranked, centres, "bucket", "of", in_buckets).select("bucket", "node", "n", "centre", "size"), "near-members")

    link = F.col("both") * 100 >= F.col("either") * percent
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    sizes = materialize(members.groupBy("node").agg(F.min("n").alias("n")), "near-sizes")
    sets = materialize(_sets(docs.withColumn("doc_id", F.col("doc_id").cast("long")), sizes.select("node"), words), "near-sets")
    stars = members.where("node <> centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    of = lambda x: sizes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"))
    stars = stars.join(of("a"), "a").join(of("b"), "b").where(fits(F.col("na"), F.col("nb"))).select("a", "b")
    measured = materialize(_verified(stars, sets), "near-stars", rows=256)
    edges = measured.where(link).select("a", "b")
    # texts that share a doc_id are one document: their classes are linked
    several = real.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").select("doc_id")
    twice = keyed.join(several, "doc_id").join(classes, F.col("of") == F.col("class")).groupBy("doc_id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    edges = materialize(edges.unionByName(twice.select(F.col("nodes")[0].alias("a"), F.explode(F.slice("nodes", 2, 1 << 30)).alias("b"))), "near-edges")

    # nodes that their buckets' centres haven't joined
    root = components(edges)
    rooted = members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    count = rooted.groupBy("bucket", "root").agg(F.count("*").alias("m"), F.max("size").alias("of"))
    largest = materialize(count.groupBy("bucket").agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("parts"), F.max("of").alias("of")).where("parts > 1"), "near-largest")
    open_ = join_hot(rooted, largest, "bucket", "of", in_buckets)
    known = measured.select("a", "b", (1 - F.col("both") / F.col("either")).alias("far"))
    open_ = open_.withColumn("a", F.least("centre", "node")).withColumn("b", F.greatest("centre", "node")).join(known, ["a", "b"], "left")
    open_ = materialize(open_.select("bucket", "node", "n", "centre", "size", "root", (F.col("root") == F.col("top.root")).alias("inside"), "far"), "near-open")
    # few outsiders: their pairs with the bucket, as far as a link is possible; many: blocks of outsiders against blocks of members
    count = materialize(open_.groupBy("bucket").agg(F.count_if(~F.col("inside")).alias("outsiders"), F.max("size").alias("of")), "near-outsiders")
    left = open_.where("not inside and node <> centre").join(count.where(F.col("outsiders") <= FEW), "bucket")
    left = materialize(left.select("bucket", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), F.col("far").alias("fx"), "of"), "near-few")
    right = open_.where("node <> centre").select("bucket", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("root").alias("ry"), F.col("inside").alias("iy"), F.col("far").alias("fy"))
    reach = 1 - percent / 100 + 1e-9
    possible: Column = (F.col("rx") != F.col("ry")) & fits(F.col("nx"), F.col("ny")) & (F.col("iy") | (F.col("x") < F.col("y")))
    possible = possible & (F.col("fx").isNull() | F.col("fy").isNull() | (F.abs(F.col("fx") - F.col("fy")) <= reach))
    more = join_hot(right, left, "bucket", "of", in_buckets).where(possible).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = materialize(more.join(measured.select("a", "b"), ["a", "b"], "left_anti"), "near-more")
    found = _verified(more, sets).where(link).select("a", "b")
    many = join_hot(open_, count.where(F.col("outsiders") > FEW), "bucket", "of", in_buckets)
    if not many.isEmpty():
        found = found.unionByName(_linked_in_blocks(materialize(many, "near-many"), sets, percent))
    found = materialize(found, "near-found", rows=256)
    if not found.isEmpty():
        root = components(edges.unionByName(found), "near-all")

    joined = join_hot(keyed, classes, "of", "copies", rows, "left", to="class").join(root.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"), "left")
    component = F.coalesce("root", "node", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id; all columns stay.

    Rows of one doc_id are one document: they stay or go together. Rows without doc_id, and texts without words, stay. An empty table gives an empty
    result.
    """
    groups = near_groups(docs, words, percent)
    (ident,) = fresh(docs, "near_id")
    gone = materialize(groups.where("not kept").select(F.col("doc_id").alias(ident)).distinct(), "near-gone")
    return docs.join(gone, F.col("doc_id") == F.col(ident), "left_anti")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM w UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON c.node = w.doc_id LEFT JOIN n USING (doc_id)
"""
