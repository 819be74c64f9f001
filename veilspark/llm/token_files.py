"""Token ids as compact binary blocks: canonical, length-limited Huffman codes made from global counts.

Documents are encoded once with the tokenizer, their ids are counted over all data, and the counts give one code table. Sorted by
doc_id, runs of whole documents become blocks: a bit stream, and checkpoints that hold the bit offset of every
512th id. A block decodes by itself, and within it all stretches between checkpoints decode side by side, by table look-up.

A written set is a folder with two Parquet tables, so that any store which Spark can reach holds it:
``code`` (id, length) and ``blocks`` (shard, block, first_id, doc_ids, lengths, checkpoints, bits).
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import materialize, shared_dir, text_or_empty, tidy

CHECKPOINT_IDS = 512
BLOCK_IDS = 65_536
#: A shard is what one task writes; its size in ids.
SHARD_IDS = 8_000_000
#: Marks that may follow a word and make tokens of their own with it (an apostrophe may not).
MARKS = ".,;:!?#*%&$()|\""
#: White space besides the space and the line feed, for RE2.
OTHER_SPACES = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_encoders: dict[tuple, ChunkEncoder] = {}


class _ByteBpe(ChunkEncoder):
    """Runs the tokenizer's own pre-tokeniser and model on each new chunk, without the offsets that whole encodings carry. A word with
    nothing but letters and marks is a token run of its letters and one of its marks, as byte-level pre-tokenisation has it."""

    def __init__(self, tok, odd, cut, specials: list[str]):
        super().__init__(lambda texts: [tok.encode(t, add_special_tokens=False).ids for t in texts], tok.get_vocab_size() > 65_536, odd, cut, lines=True, bound=1_300_000)
        self.tok, self.specials, self.pieces = tok, specials, {"": b""}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from 256 on
        hidden = [b for b in range(256) if b not in visible]
        self.letters = dict(zip(hidden, map(chr, range(256, 256 + len(hidden))), strict=True))

    def piece(self, mapped: str) -> bytes:
        return self.as_bytes([t.id for t in self.tok.model.tokenize(mapped)])

    def short(self, mapped: str) -> bytes:
        """Marks and line feeds, which come again and again."""
        if mapped not in self.pieces:
            self.pieces[mapped] = self.piece(mapped)
        return self.pieces[mapped]

    def learn(self, chunks: list[str]) -> list[bytes]:
        out = []
        for chunk in chunks:
            stem = chunk.rstrip(MARKS)
            if stem[1:].isalpha() and stem[0] in " \n":
                key = stem[1:] if stem[0] == " " else stem
                head = self.known.get(key)
                if head is None:  # with and without marks a word is looked up once
                    mapped = "\u0120" + key if key is not stem and key.isascii() else stem.encode().decode("latin-1").translate(self.letters)
                    head = self.known[key] = self.piece(mapped) if stem[0] == " " else self.short(mapped[0]) + self.piece(mapped[1:])
                out.append(head + self.short(chunk[len(stem) :]))
            elif any(x in chunk for x in self.specials):
                out += super().learn([chunk])
            else:
                out.append(b"".join([self.piece(mapped) for mapped, _ in self.tok.pre_tokenizer.pre_tokenize_str(chunk)]))
        return out


def byte_bpe(path: str, specials_as_text: bool = False) -> ChunkEncoder:
    """An encoder for a tokenizers file with byte-level pre-tokenisation, kept by the Python worker."""
    if (path, specials_as_text) not in _encoders:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = specials_as_text
        # no token holds a space after a non-space; a special token in the text could, so such texts stay whole
        specials = [t.content for t in tok.get_added_tokens_decoder().values() if not specials_as_text]

        # of three line feeds or more, all but the last are one piece
        odd = "|".join([r"  |\n | \n|\n\n\n|^[ \n]|[ \n]$", OTHER_SPACES, *map(re.escape, specials)])
        cut = re.compile(r"(?<=\S)(?= )" if not any(" " in x for x in specials) else r"(?!)")
        _encoders[path, specials_as_text] = _ByteBpe(tok, odd, cut, specials)
    return _encoders[path, specials_as_text]


def tokenised(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, wide, ids): the ids of each text with ``end_id`` behind them, two bytes each or four (``wide``)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(path)
        end = np.array([end_id], np.uint32 if encoder.wide else np.uint16).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2_500):
                part = batch.slice(at, 2_500)
                ids = [x + end for x in encoder(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encoder.wide] * len(ids)), pa.array(ids, pa.binary())], ["doc_id", "wide", "ids"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(lambda b: tidy(encode(b)), f"doc_id {dict(docs.dtypes)['doc_id']}, wide boolean, ids binary")


def ids_of(data: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if wide else np.uint16)


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents; summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:  # the width is that of the vocabulary, the same in all rows
                n = np.bincount(ids_of(b"".join(batch.column(1).to_pylist()), batch.column(0)[0].as_py()))
                if len(n) > len(total):
                    total = np.r_[total, np.zeros(len(n) - len(total), np.int64)]
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["id", "n"])

    return tokens.select("wide", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << most:
        raise ValueError(f"{n} symbols don't fit codes of {most} bits")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.int64)
    lists: list[np.ndarray] = []  # of each level: which items, in order, are packages
    weights = leaf
    lists.append(np.zeros(n, bool))
    for _ in range(most - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both, is_package = np.r_[leaf, pairs], np.r_[np.zeros(n, bool), np.ones(len(pairs), bool)]
        by = np.argsort(both, kind="stable")
        weights = both[by]
        lists.append(is_package[by])
    lengths, take = np.zeros(n, np.int64), 2 * (n - 1)
    for is_package in reversed(lists):
        packages = int(is_package[:take].sum())
        lengths[: take - packages] += 1
        take = 2 * packages
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by id: codes ascend by length, then by id."""
    order = np.lexsort((ids, lengths))
    code, codes, last = 0, np.zeros(len(ids), np.int64), int(lengths[order[0]]) if len(ids) else 0
    for k in order:
        code <<= int(lengths[k]) - last
        last = int(lengths[k])
        codes[k] = code
        code += 1
    by_code, by_length = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint64), np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint64)
    by_code[ids], by_length[ids] = codes, lengths
    return by_code, by_length


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream, most significant bit first, and the bit offset of every 512th id."""
    size = lengths[ids]
    ends = np.cumsum(size)
    starts = ends - size
    word, shift = (starts >> np.uint64(5)).astype(np.int64), np.uint64(64) - (starts & np.uint64(31)) - size
    value = codes[ids] << shift
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(ids) else np.zeros(0, np.int64)
    out = np.zeros(int(ends[-1] + np.uint64(31) >> np.uint64(5)) + 1 if len(ids) else 0, np.uint64)
    if len(ids):
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes(), starts[::CHECKPOINT_IDS].astype(np.uint32)


def look_up_table(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) by the next ``bits`` bits, and ``bits``."""
    bits = int(lengths.max()) if len(lengths) else 1
    order = np.lexsort((ids, lengths))
    span = (1 << (bits - lengths[order])).astype(np.int64)
    fill = lambda x: np.resize(np.repeat(x[order], span), 1 << bits) if len(x) else np.zeros(1 << bits, np.int64)
    return fill(ids).astype(np.uint32), fill(lengths).astype(np.int64), bits


def unpack(blocks: list[tuple[bytes, np.ndarray, int]], table: tuple[np.ndarray, np.ndarray, int]) -> list[np.ndarray]:
    """The ids of each (bits, checkpoints, number of ids); all stretches of all blocks advance together."""
    symbol, step, bits = table
    lane_at, lane_n, out_at, base, ids_before = [], [], [], 0, 0
    for data, checkpoints, n in blocks:
        k = len(checkpoints)
        lane_at.append(checkpoints.astype(np.int64) + 8 * base)
        lane_n.append(np.minimum(CHECKPOINT_IDS, n - CHECKPOINT_IDS * np.arange(k)))
        out_at.append(ids_before + CHECKPOINT_IDS * np.arange(k))
        base += len(data)
        ids_before += n
    raw = np.frombuffer(b"".join(b for b, _, _ in blocks) + b"\0" * 8, np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, n, to = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lane_at, lane_n, out_at))
    by = np.argsort(-n, kind="stable")
    at, n, to = at[by], n[by], to[by]
    live = np.searchsorted(-n, -np.arange(CHECKPOINT_IDS), side="left")  # lanes with more than k ids
    out = np.zeros(ids_before, np.uint32)
    for k in range(int(n[0]) if len(n) else 0):
        m = live[k]
        here = at[:m]
        key = (window[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - bits)
        out[to[:m] + k] = symbol[key]
        at[:m] += step[key]
    return np.split(out, np.cumsum([x[2] for x in blocks])[:-1]) if blocks else []


def write_token_files(tokens: DataFrame, path: str, most_bits: int = 16) -> None:
    """Encode ``tokens`` (doc_id, wide, ids) into ``path``, in ascending order of doc_id (null first).

    ``most_bits`` limits code lengths, and grows where more ids are in use than such codes can tell apart. The counts that reach the
    driver are one row for each id of the vocabulary at most.
    """
    spark = tokens.sparkSession
    counts = id_counts(tokens).toPandas().sort_values("id")
    ids = counts["id"].to_numpy(np.int64)
    most = max(most_bits, int(len(ids)).bit_length())
    lengths = code_lengths(counts["n"].to_numpy(np.int64), most)
    spark.createDataFrame(pd.DataFrame({"id": ids, "length": lengths}), "id long, length long").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(canonical_codes(ids, lengths))
    shards = max(1, round(int(counts["n"].sum()) / SHARD_IDS), spark.sparkContext.defaultParallelism)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes = shared.value
        shard, block, held, many = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            parts = [x for _, x in held]
            bits, checkpoints = pack(np.concatenate(parts), codes, sizes)
            values = [[shard], [block], [many], [[d for d, _ in held]], [[len(x) for x in parts]], [checkpoints], [bits]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, wide, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((doc_id, ids_of(data, wide)))
                many += len(held[-1][1])
                if many >= BLOCK_IDS:
                    yield flush()
                    held, many, block = [], 0, block + 1
        if held:
            yield flush()

    kind = dict(tokens.dtypes)["doc_id"]
    names = ["shard", "block", "n_ids", "doc_ids", "lengths", "checkpoints", "bits"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32() if kind == "int" else pa.string() if kind == "string" else pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    ordered = tokens.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.crc32("ids"))
    ordered.mapInArrow(encode, f"shard long, block long, n_ids long, doc_ids array<{kind}>, lengths array<long>, checkpoints array<long>, bits binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, per_document) -> DataFrame:
    """Decode ``path``; ``per_document``: ids -> int, kept beside doc_id, start (ids before it in the set) and n_tokens."""
    blocks = spark.read.parquet(f"{path}/blocks")
    code = spark.read.parquet(f"{path}/code").toPandas()  # as many rows as the vocabulary at most
    shared = spark.sparkContext.broadcast(look_up_table(code["id"].to_numpy(np.int64), code["length"].to_numpy(np.int64)))

    sizes = blocks.select("shard", "block", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_shard = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))  # one row a written file
    shard_start = of_shard.select("shard", before(Window.orderBy("shard")).alias("shard_start"))
    starts = sizes.withColumn("block_start", before(Window.partitionBy("shard").orderBy("block"))).join(shard_start, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("start"))
    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[dict]) -> pa.RecordBatch:
            docs, at, n, value = [], [], [], []
            found = unpack([(r["bits"], np.array(r["checkpoints"], np.int64), r["n_ids"]) for r in rows], shared.value)
            for r, ids in zip(rows, found, strict=True):
                ends = np.cumsum(r["lengths"])
                docs += r["doc_ids"]
                n += r["lengths"]
                at += (r["start"] + ends - np.array(r["lengths"])).tolist()
                value += [per_document(ids[e - k : e]) for e, k in zip(ends, r["lengths"], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(docs, out_kind), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(value, pa.int64())], ["doc_id", "start", "n_tokens", "value"])

        out_kind = pa.int32() if kind == "int" else pa.string() if kind == "string" else pa.int64()
        held, many = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                held.append(batch.slice(at, 1).to_pylist()[0])
                many += held[-1]["n_ids"]
                if many >= 16 * BLOCK_IDS:
                    yield flush(held)
                    held, many = [], 0
        if held:
            yield flush(held)

    placed = blocks.join(starts, ["shard", "block"])
    return placed.mapInArrow(lambda b: tidy(decode(b)), f"doc_id {kind}, start long, n_tokens long, value long")


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokens_through_files(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of ``docs``, read back from token files written for them.

    A null text is an empty one: its only id is the end id. Repeated rows are documents of their own, side by side. An empty
    table gives empty files and an empty result; a null doc_id comes first. Other columns are ignored.
    """
    tokens = materialize(tokenised(docs, path), "tokens")
    out = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(tokens, out)
    return read_token_files(docs.sparkSession, out, crc_of_ids).withColumnRenamed("value", "ids_crc32")
