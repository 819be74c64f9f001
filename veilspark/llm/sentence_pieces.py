"""SentencePiece models run by the tokenizers library.

The model file is read as a protobuf message; its normaliser, meta-space marker, scores and byte fallback are rebuilt as a
tokenizers pipeline (Unigram, or BPE with the merges that the scores imply). The driver rebuilds it once, and workers load the result.
Ids are compared with those of the SentencePiece library itself for every chunk, so parity is known for each text.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import slices, text_or_empty, tidy

SPACE_MARK = "▁"
#: Kinds of pieces and of models in the message.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: Chunks that a worker remembers; others are encoded again when they are met again.
REMEMBERED = 60_000
#: New chunks that go to the libraries as one line.
LINE_WORDS = 250


def _message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; length-delimited and fixed fields as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        match key & 7:
            case 0:
                yield key >> 3, varint()
            case 1 | 5 as kind:
                size = 8 if kind == 1 else 4
                yield key >> 3, data[at : (at := at + size)]
            case 2:
                size = varint()
                yield key >> 3, data[at : (at := at + size)]
            case kind:
                raise ValueError(f"wire type {kind} isn't known")


@dataclass
class SentencePieceModel:
    """What the message says. Field numbers are those of the public message definition."""

    pieces: list[tuple[str, float, int]]
    trainer: dict[int, int | bytes]
    normaliser: dict[int, int | bytes]

    @classmethod
    def read(cls, data: bytes) -> SentencePieceModel:
        pieces, trainer, normaliser = [], {}, {}
        for field, value in _message(data):
            if field == 1:
                piece = dict(_message(value))
                pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_message(value))
            elif field == 3:
                normaliser = dict(_message(value))
        return cls(pieces, trainer, normaliser)

    @property
    def kind(self) -> int:
        return self.trainer.get(3, UNIGRAM)

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @cached_property
    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that join into a piece, the best score first."""
        known = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        pairs = [(-score, i, p[:k], p[k:]) for i, (p, score, kind) in enumerate(self.pieces) if kind == NORMAL for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        return [(a, b) for _, _, a, b in sorted(pairs, key=lambda x: x[:2])]

    def tokenizer(self):
        from tokenizers import Tokenizer, decoders, models, normalizers
        from tokenizers import Regex

        fallback = bool(self.trainer.get(35, 0))
        if self.kind == UNIGRAM:
            tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, fallback))
        elif self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            tok = Tokenizer(models.BPE(vocab, self.merges, unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=fallback))
        else:
            raise ValueError(f"models of kind {self.kind} aren't supported")
        steps = [normalizers.Precompiled(chars)] if (chars := self.normaliser.get(2, b"")) else []
        if self.normaliser.get(4, 1):
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.normaliser.get(3, 1):
            steps.append(normalizers.Prepend(SPACE_MARK))
        if self.normaliser.get(5, 1):
            steps.append(normalizers.Replace(" ", SPACE_MARK))
        tok.normalizer = normalizers.Sequence(steps)
        tok.decoder = decoders.Sequence([decoders.Replace(SPACE_MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
        return tok

    @cached_property
    def cuts_at_spaces(self) -> bool:
        """No piece goes on behind a space, and a chunk is normalised like a text: texts may be cut before a space."""
        whole = all(SPACE_MARK not in p.lstrip(SPACE_MARK) for p, _, _ in self.pieces)
        plain = not self.normaliser.get(2, b"") and not self.normaliser.get(4, 1) and self.normaliser.get(3, 1) and self.normaliser.get(5, 1)
        return bool(whole and plain)

    @cached_property
    def surface(self) -> list[bytes]:
        """The bytes of each id as it decodes."""
        odd = {UNKNOWN: " ⁇ ".encode(), CONTROL: b""}
        return [bytes([int(p[3:5], 16)]) if kind == BYTE else odd.get(kind, p.replace(SPACE_MARK, " ").encode()) for p, _, kind in self.pieces]


def rebuilt(data: bytes) -> str:
    """The tokenizers library's JSON of a model file."""
    return SentencePieceModel.read(data).tokenizer().to_str()


class SentencePieceCodec:
    """Encodes and decodes batches with the tokenizers library in ``threads`` threads. ``odd``: chunks remembered whose ids differ from the
    SentencePiece library's."""

    def __init__(self, data: bytes, json: str | None = None, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))  # read when the library first encodes a batch
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece
        from tokenizers import Tokenizer

        self.model = SentencePieceModel.read(data)
        self.tok = Tokenizer.from_str(json) if json else self.model.tokenizer()
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.odd: set[str] = set()
        never, space = re.compile(r"(?!)"), re.compile(r"(?<=[^ ])(?= )")
        self.cuts = self.model.cuts_at_spaces
        self.mark = self.tok.encode("a ").ids[-1:]
        self.begins = np.array([p.startswith(SPACE_MARK) for p, _, _ in self.model.pieces])
        self.chunks = ChunkEncoder(self._encode, len(self.model.pieces) > 65_536, "  |^ " if self.cuts else "", space if self.cuts else never, bound=REMEMBERED)

    def _encode(self, chunks: list[str]) -> list[Sequence[int]]:
        """Chunks behind a first one begin with a space, which stands for the mark that the normaliser prepends."""
        texts = [c[1:] if c[:1] == " " and self.cuts else c for c in chunks]
        if not self.cuts:
            return self._one_by_one(chunks, texts)
        # chunks without spaces of their own go to both libraries as lines of many words: each begins where a piece begins with the mark
        plain = [i for i, t in enumerate(texts) if t and " " not in t and SPACE_MARK not in t]
        lines = [plain[at : at + LINE_WORDS] for at in range(0, len(plain), LINE_WORDS)]
        joined = [" ".join(map(texts.__getitem__, line)) for line in lines]
        out: list = [None] * len(chunks)
        for line, got, want in zip(lines, self.tok.encode_batch_fast(joined, add_special_tokens=False), self.judge.encode(joined, num_threads=1), strict=True):
            ids = np.array(got.ids, np.uint32)
            first = np.flatnonzero(self.begins[ids])
            if len(first) == len(line) and got.ids == want:
                for i, part in zip(line, np.split(ids.astype(self.chunks.dtype), first[1:]), strict=True):
                    out[i] = part
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._one_by_one([chunks[i] for i in rest], [texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _one_by_one(self, chunks: list[str], texts: list[str]) -> list[list[int]]:
        ids = [e.ids if t else (self.mark if c else []) for c, t, e in zip(chunks, texts, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
        want = self.judge.encode(texts, num_threads=1)
        self.odd.update(c for c, t, got, wanted in zip(chunks, texts, ids, want, strict=True) if t and got != wanted)
        return ids

    def encode(self, texts: list[str]) -> tuple[list[array], list[bool]]:
        """The ids of whole texts, and whether the SentencePiece library gives the same for each. A text that begins with a space has it as a
        chunk's own second space."""
        given = [" " + t if t[:1] == " " and self.cuts else t for t in texts]
        out = []
        for data in self.chunks(given):
            ids = array("I" if self.chunks.wide else "H")
            ids.frombytes(data)
            out.append(ids)
        parity = [self.judge.encode(t) == ids.tolist() for t, ids in zip(texts, out, strict=True)] if self.odd else [True] * len(texts)
        return out, parity

    def forget(self) -> None:
        """What a task leaves in a worker that outlives it: the model and its short chunks."""
        self.chunks.trim()
        if self.odd:
            self.chunks.known, self.odd = {}, set()

    def decode(self, ids) -> str:
        text = b"".join(map(self.model.surface.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text[:1] == " " and self.model.normaliser.get(3, 1) else text


_codecs: dict[int, SentencePieceCodec] = {}


def encode_and_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, ids, decoded_chars, round_trip, parity) for every row of ``docs`` (doc_id, text).

    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers; ``round_trip``: the decoded ids are the text;
    ``parity``: the SentencePiece library gives the same ids. A null text is an empty one and has no ids. The mark itself (U+2581) in a text
    decodes as a space. Repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    data = open(model_path, "rb").read()
    key = zlib.crc32(data)
    shared = docs.sparkSession.sparkContext.broadcast((data, rebuilt(data)))  # the model file: its size is that of the vocabulary
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _codecs:
            _codecs[key] = SentencePieceCodec(*shared.value)
        codec = _codecs[key]
        for part in (x for batch in batches for x in slices(batch, 500)):
            texts = part.column(1).to_pylist()
            ids, parity = codec.encode(texts)
            back = [codec.decode(x) for x in ids]
            wide = [np.frombuffer(x, np.uint32 if codec.chunks.wide else np.uint16).astype("<i4") for x in ids]
            ends = np.cumsum([0, *map(len, wide)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(wide) if wide else np.zeros(0, "<i4")))
            columns = [part.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array([zlib.crc32(x.tobytes()) for x in wide], pa.int64()), lists]
            columns += [pa.array(list(map(len, back)), pa.int64()), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()), pa.array(parity, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "ids_crc32", "ids", "decoded_chars", "round_trip", "parity"])
        codec.forget()

    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, ids array<int>, decoded_chars long, round_trip boolean, parity boolean"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(lambda b: tidy(run(b)), schema)
