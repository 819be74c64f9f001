"""Repair of conversation structure by A* on the edit lattice.

A node of the lattice is (rows behind, state of the role pattern); its edges keep, re-role or delete the next row or insert one. Keys are (cost so far plus
heuristic, edits so far); the heuristic is a suffix sum of what every path still pays: a deletion for each blank or duplicate row, and for each truncated one
the lesser of deletion and the charge for staying. It never falls by more than an edge costs, so the first key that closes a node is its best, and
the first that closes an end is the cheapest list of edits, the least one of equal cost.

Most conversations are one row of one task. One with many rows or bytes is sorted over tasks and cut into pieces; A* runs in each piece from each state, and
the best ways are joined state by state. That is exact: lists of edits of equal cost over the same rows are never one the beginning of the other,
since every edit that one of them has more would cost something, so the least whole consists of least parts.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of, tidy

#: Costs of the result contract, and its white space and sentence ends.
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 1, 2, 5, 5
BLANKS, ENDS = " \t\n\v\f\r", ".!?"
#: Rows and bytes up to which a conversation is one row; above, it is cut into pieces of so many rows.
SHORT_ROWS, SHORT_BYTES, PIECE_ROWS = 1_000, 4 << 20, 512
#: First faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
#: States of the pattern (s?(ua)+)?: nothing yet, behind s, behind u, behind a; what each initial leads to, and the one role that an edit may give.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FOLLOWING = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ACCEPTING = (START, ASSISTANT)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) for every row: the damage that the digest of ``conv_id:turn`` decides. ``copies`` is 0 for a dropped row, 2 for one repeated."""
    one_space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    turn = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")).cast("binary")) % 20
    text = F.when(turn == 1, "").when(turn == 2, F.regexp_replace(one_space("text"), "[.!?]", "")).otherwise(one_space("text"))
    return conversations.select(
        "conv_id", "turn", F.when(turn == 4, "user").otherwise(one_space("role")).alias("role"), text.alias("text"), F.when(turn == 0, 0).when(turn == 3, 2).otherwise(1).alias("copies")
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """Rows as they are, in the form of ``damaged``; nulls of role and text are one space."""
    return conversations.select("conv_id", "turn", *[F.coalesce(name, F.lit(" ")).alias(name) for name in ("role", "text")], F.lit(1).alias("copies"))


def search(initials: str, faults: list[int], entry: int = START, goals: tuple[int, ...] = ACCEPTING) -> dict[int, tuple[int, str]]:
    """A* over rows of these initials and first faults: for each state in ``goals`` that the end can be reached in, the cost and the edits.

    With the goals of a whole conversation it stops at the first end; with those of a piece, at the last of them.
    """
    n, whole = len(faults), goals == ACCEPTING
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if faults[i] in (BLANK, DUPLICATE) else min(DELETE, STAYS_TRUNCATED) if faults[i] == TRUNCATED else 0)
    heap, closed, found = [(rest[0], "", 0, entry)], set(), {}
    while heap:
        key, audit, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n and state in goals:
            found[state] = (key, audit)
            if whole or len(found) == len(goals):
                break
        spent = key - rest[i]
        role_state = FOLLOWING[state][1]
        edges = [(INSERT, "I", i, role_state)]
        if i < n:
            edges.append((DELETE, "D", i + 1, state))
            if faults[i] in (SOUND, TRUNCATED):
                charge = STAYS_TRUNCATED if faults[i] == TRUNCATED else 0
                kept = NEXT.get(initials[i], {}).get(state)
                if kept is not None:
                    edges.append((charge, "K", i + 1, kept))
                edges.append((charge + REROLE, "R", i + 1, role_state))
        for cost, edit, j, to in edges:
            if (j, to) not in closed:
                heapq.heappush(heap, (spent + cost + rest[j], audit + edit, j, to))
    return found


def applied(audit: str, roles: list[str], entry: int = START) -> list[tuple[list[str], str | None]]:
    """For each row the roles of the rows inserted before it and its own role (None: deleted); last, the roles inserted at the end."""
    out, inserted, state, i = [], [], entry, 0
    for edit in audit:
        if edit == "I":
            role, state = FOLLOWING[state]
            inserted.append(role)
            continue
        role = None
        if edit == "K":
            role, state = roles[i], NEXT[roles[i][0]][state]
        elif edit == "R":
            role, state = FOLLOWING[state]
        out.append((inserted, role))
        inserted, i = [], i + 1
    return [*out, (inserted, None)]


def first_faults(rows: list[tuple]) -> list[int]:
    """The first fault of each row (turn, role, text) of a whole conversation in its order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANKS)
        faults.append(BLANK if not bare else DUPLICATE if (role, text) in seen else TRUNCATED if bare[-1] not in ENDS else SOUND)
        seen.add((role, text))
    return faults


def illegal_pairs(initials: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:], strict=False)))


def initials_of(roles: list[str]) -> str:
    """One character a role; an empty role has none, so a space stands for it, which no edit keeps."""
    return "".join(role[:1] or " " for role in roles)


def repaired(rows: list[tuple]) -> tuple[int, int, int, int, int, int, str, str]:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, text) of one whole conversation of rows (turn, role, text), in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    turns, roles = {r[0] for r in rows if r[0] is not None}, [r[1] for r in rows]
    initials, faults = initials_of(roles), first_faults(rows)
    cost, audit = min(search(initials, faults).values())
    lines = []
    for (inserted, role), row in zip(applied(audit, roles), [*rows, None], strict=True):
        lines += [f"{x}:" for x in inserted] + ([] if role is None else [f"{role}:{row[2]}"])
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal_pairs(initials), cost, audit, "\n".join(lines)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _schema(kind: str, last: str) -> str:
    return f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, {last} string"


def repair_conversations(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """One row for every conv_id of ``conversations`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    With ``damage`` rows are damaged first; a conversation that loses all its rows has zeros, no edits and the digest of an empty text. A null conv_id
    is a conversation of its own; null roles and texts are one space; rows without a turn come first, and rows of one turn by role, then by the MD5 digest of the
    text. An empty role can't be kept. An empty table gives an empty result; other columns are ignored. No conversation's texts are held whole by a task unless
    they are short: a long one is sorted over tasks, and only its digest, which is sequential, reads them one after the other.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    rows = (damaged if damage else undamaged)(conversations)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    long = materialize(sizes.where((F.col("rows") > SHORT_ROWS) | (F.col("bytes") > SHORT_BYTES)).select(F.col("conv_id").alias("long_id")), "conversations-long")
    if long.isEmpty():
        return _short(rows, kind)
    is_long = rows["conv_id"].eqNullSafe(long["long_id"])
    return _short(rows.join(long, is_long, "left_anti"), kind).unionByName(_long(materialize(rows.join(long, is_long, "left_semi"), "conversations-rows"), kind))


def _short(rows: DataFrame, kind: str) -> DataFrame:
    """Each conversation's rows, bounded in number and bytes, meet in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, found in rows_of(batch):
                *counts, text = repaired([(r["turn"], r["role"], r["text"]) for r in found for _ in range(r["copies"])])
                out.append((conv_id, *counts, hashlib.sha256(text.encode()).hexdigest()))
            names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
            kinds = [batch.schema.field(0).type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    met = rows.groupBy("conv_id").agg(F.collect_list(F.when(F.col("copies") > 0, F.struct("turn", "role", "text", "copies"))).alias("rows"))
    return materialize(met.mapInArrow(lambda b: tidy(run(b)), _schema(kind, "repaired_sha256")), "conversations-short")


def _piece(place: Column) -> Column:
    return F.floor(place / PIECE_ROWS).cast("long")


def _long(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations of many rows: sorted over tasks, where (part, place) is a row's rank; searched piece by piece; joined; spelt out."""
    counted = F.explode(F.sequence(F.lit(1), F.col("copies")))
    spaced = lambda text: F.regexp_replace(text, r"[\x20\x09-\x0D]+$", "")
    each = materialize(rows.where("copies > 0").withColumn("copy", counted).withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.md5(F.col("text").cast("binary"))), "conversations-each")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("row")]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(each.count() / 100_000))
    ranked = each.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranked = materialize(ranked.withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "conversations-ranked")

    # the first of equal rows: equal ones meet as one key after each task has found its own first
    first = ranked.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("part", "place")).alias("at")).select("at.*", F.lit(True).alias("first"))
    bare = spaced(F.col("text"))
    slim = ranked.select("conv_id", "part", "place", "role", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(*ENDS)).alias("truncated"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("truncated"), TRUNCATED).otherwise(SOUND)
    flagged = slim.join(first, ["part", "place"], "left").select("conv_id", "part", "place", _piece(F.col("place")).alias("piece"), "role", fault.alias("fault"))
    pieces = flagged.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("place", "role", "fault"))).alias("rows"))
    ways = "array<struct<entry:int,exit:int,cost:long,audit:string>>"
    searched = pieces.mapInArrow(lambda b: tidy(_searched(b)), f"conv_id {kind}, part int, piece long, n array<long>, ends string, ways {ways}")
    searched = materialize(searched, "conversations-pieces")
    chosen = searched.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "piece")
    chosen = materialize(chosen.mapInArrow(lambda b: tidy(_chosen(b)), f"conv_id {kind}, part int, piece long, n array<long>, entry int, audit string"), "conversations-chosen")

    spelt = pieces.join(chosen.select(F.col("part").alias("_part"), F.col("piece").alias("_piece"), F.col("conv_id").alias("_conv"), "entry", "audit"), (F.col("part") == F.col("_part")) & (F.col("piece") == F.col("_piece")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
    edits = spelt.select("conv_id", "part", "rows", "entry", "audit").mapInArrow(lambda b: tidy(_edits(b)), "part int, place long, before array<string>, new_role string, after array<string>")
    lines = ranked.select("conv_id", "part", "place", "text").join(edits, ["part", "place"])
    headed = lambda a: F.transform(a, lambda role: F.concat(role, F.lit(":")))
    own = F.when(F.col("new_role").isNotNull(), F.array(F.concat("new_role", F.lit(":"), "text"))).otherwise(F.array().cast("array<string>"))
    lines = lines.select("conv_id", "part", "place", F.array_join(F.concat(headed("before"), own, headed("after")), "\n").alias("text"), (F.size("before") + F.size("after") + F.size(own)).alias("lines"))
    lines = lines.where("lines > 0").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "place")
    digests = lines.select("conv_id", "text").mapInArrow(lambda b: tidy(_digests(b)), f"conv_id {kind}, repaired_sha256 string")
    digests = digests.select(F.col("conv_id").alias("_conv"), "repaired_sha256")

    turns = ranked.groupBy("conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("first"), F.count_distinct("turn").alias("own"))
    turns = turns.select(F.col("conv_id").alias("_turns_of"), F.coalesce(F.col("last") - F.col("first") + 1 - F.col("own"), F.lit(0)).alias("gaps"))
    total = chosen.groupBy("conv_id").agg(
        *[F.sum(F.element_at("n", k + 1)).alias(c) for k, c in enumerate(COUNTS[1:])],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "piece", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    gone = rows.groupBy("conv_id").agg(F.sum("copies").alias("copies")).where("copies = 0")
    empty = gone.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256"))
    out = total.join(turns, F.col("conv_id").eqNullSafe(F.col("_turns_of"))).join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    sha = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return out.select("conv_id", *[F.col(c).cast("long").alias(c) for c in COUNTS], "audit", sha).unionByName(empty)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece: its counts, first and last initial, and the best way from each state to each other."""
    for batch in batches:
        out = []
        for conv_id, part, piece, rows in rows_of(batch):
            initials, faults = initials_of([r["role"] for r in rows]), [r["fault"] for r in rows]
            ways = [{"entry": e, "exit": x, "cost": c, "audit": a} for e in range(4) for x, (c, a) in search(initials, faults, e, tuple(range(4))).items()]
            out.append((conv_id, part, piece, [*(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal_pairs(initials), 0], initials[0] + initials[-1], ways))
        way = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.list_(way)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "part", "piece", "n", "ends", "ways"])


def _less(a, b) -> bool:
    """Whether the edits of chain ``a`` come before those of ``b``; chains (edits, chain before) are of one length and share what lies before their fork."""
    left, right = [], []
    while a is not b:
        left.append(a[0])
        right.append(b[0])
        a, b = a[1], b[1]
    return "".join(reversed(left)) < "".join(reversed(right))


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece, in the order of its conversation, the state that the best whole list of edits enters it in, and its edits there; counts take in the cost and the pair at the seam."""
    kept: list[tuple] = []
    best: dict[int, tuple[int, tuple | None]] = {}
    last = " "
    kind = None

    def ended() -> pa.RecordBatch:
        cost, chain = None, None
        for state in ACCEPTING:
            if state in best and (cost is None or best[state][0] < cost or best[state][0] == cost and _less(best[state][1], chain)):
                cost, chain = best[state]
        links = []
        while chain is not None:
            links.append((chain[2], chain[0]))
            chain = chain[1]
        kept[0][3][4] = cost
        columns = [*zip(*kept, strict=True), *zip(*reversed(links), strict=True)]
        kinds = [kind, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "part", "piece", "n", "entry", "audit"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv_id, part, piece, n, ends, ways in rows_of(batch):
            if not kept or kept[-1][0] != conv_id:
                if kept:
                    yield ended()
                kept, best = [], {START: (0, None)}
            elif last + ends[0] not in ("su", "ua", "au"):
                n[3] += 1
            kept.append((conv_id, part, piece, n))
            last, onward = ends[1], {}
            for way in ways:
                if way["entry"] in best:
                    spent, chain = best[way["entry"]]
                    cost, link = spent + way["cost"], (way["audit"], chain, way["entry"])
                    old = onward.get(way["exit"])
                    if old is None or cost < old[0] or cost == old[0] and _less(link, old[1]):
                        onward[way["exit"]] = (cost, link)
            best = onward
    if kept:
        yield ended()


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the edits of a piece make of each of its rows."""
    for batch in batches:
        out = []
        for _, part, rows, entry, audit in rows_of(batch):
            *each, (after, _) = applied(audit, [r["role"] for r in rows], entry)
            out += [(part, r["place"], before, role, after if k == len(rows) - 1 else []) for k, (r, (before, role)) in enumerate(zip(rows, each, strict=True))]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "place", "before", "new_role", "after"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order; one line is held at a time."""
    now, digest, kind, begun = None, None, None, False
    done = lambda: pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv_id, text in rows_of(batch):
            if begun and conv_id == now:
                digest.update(b"\n")
            else:
                if begun:
                    yield done()
                now, digest, begun = conv_id, hashlib.sha256(), True
            digest.update(text.encode())
    if begun:
        yield done()


#: For DuckDB: the same lattice walked row by row, the best key (cost, edits) of each state kept. Two insertions in a row are as many as any best list has.
SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS fault
  FROM conversations, tab),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(2) c(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM hurt),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM placed),
judged AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS ini,
    CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault,
    left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM ranked),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
ins(a, b, cost, edits) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'),
    (0, 3, 10, 'II'), (1, 3, 10, 'II'), (2, 2, 10, 'II'), (3, 3, 10, 'II')),
edge(edit, ini, a, b, cost) AS (
  VALUES ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0),
    ('D', '', 0, 0, 2), ('D', '', 1, 1, 2), ('D', '', 2, 2, 2), ('D', '', 3, 3, 2), ('R', '', 0, 2, 1), ('R', '', 1, 2, 1), ('R', '', 2, 3, 1), ('R', '', 3, 2, 1)),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS st, '00000000' AS way FROM facts
  UNION ALL
  SELECT w.conv_id, j.i, e.b, min(printf('%08d', left(w.way, 8)::INT + n.cost + e.cost + CASE WHEN e.edit <> 'D' AND j.fault = 'truncated' THEN 5 ELSE 0 END)
                                  || substr(w.way, 9) || n.edits || e.edit)
  FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 JOIN ins n ON n.a = w.st JOIN edge e ON e.a = n.b
  WHERE e.edit = 'D' OR (j.fault IN ('sound', 'truncated') AND (e.edit = 'R' OR e.ini = j.ini))
  GROUP BY w.conv_id, j.i, e.b),
best AS (
  SELECT f.conv_id, min(printf('%08d', left(w.way, 8)::INT + n.cost) || substr(w.way, 9) || n.edits) AS way
  FROM facts f JOIN walk w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.n JOIN ins n ON n.a = w.st AND n.b IN (0, 3) GROUP BY f.conv_id),
steps AS (
  SELECT conv_id, k, substr(way, 8 + k, 1) AS edit, len(regexp_replace(substr(way, 9, k), 'I', '', 'g')) AS i,
    len(regexp_replace(substr(way, 9, k), 'D', '', 'g')) AS shown
  FROM (SELECT conv_id, way, unnest(range(1, len(way) - 7)) AS k FROM best)),
said AS (
  SELECT s.conv_id, s.k, s.edit, s.shown, CASE WHEN edit <> 'I' THEN j.text ELSE '' END AS text, j.role,
    coalesce(bool_or(s.edit = 'K' AND s.shown = 1 AND j.ini = 's') OVER (PARTITION BY s.conv_id), false) AS has_system
  FROM steps s LEFT JOIN judged j ON s.edit <> 'I' AND j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i WHERE s.edit <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (shown - has_system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS repaired
  FROM said GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(way, 8)::BIGINT, 0) AS cost,
       coalesce(substr(way, 9), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""
