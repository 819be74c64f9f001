"""Token ids of whole texts from the ids of their chunks, each met once.

A chunk starts at a space that follows a non-space; where the tokenizer never merges across such a place, the ids of a text are
those of its chunks in order. Texts are cut, and equal chunks of a batch are found, by Arrow; new chunks go to the tokenizer
together; ids are put in place by numpy.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Encode = Callable[[Sequence[str]], list[Sequence[int]]]
#: Stands before the first chunk of a text, which has no space to start with.
START = "\0"


class ChunkEncoder:
    """``encode``: chunks, in full, to ids. ``odd``: an RE2 pattern of texts that need ``cut``; others are cut at every space, and before
    every line feed if ``lines``. ``bound`` limits the chunks remembered, not the texts; beyond it the short ones, which are met most, stay."""

    def __init__(self, encode: Encode, wide: bool, odd: str, cut: re.Pattern, lines: bool = False, bound: int = 800_000):
        self.encode, self.wide, self.odd, self.cut, self.lines, self.bound = encode, wide, odd, cut, lines, bound
        self.known: dict[str, bytes] = {}  # by the chunk without its leading space; a chunk that starts with a line feed has none

    @property
    def dtype(self):
        return np.uint32 if self.wide else np.uint16

    def as_bytes(self, ids: Sequence[int]) -> bytes:
        return ids.tobytes() if isinstance(ids, np.ndarray) else array("I" if self.wide else "H", ids).tobytes()

    def learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of new chunks, in full."""
        return [self.as_bytes(ids) for ids in self.encode(chunks)]

    def trim(self) -> None:
        """Keep the short chunks only, and none where even these are many."""
        self.known = {k: v for k, v in self.known.items() if len(k) <= 6}
        if len(self.known) > self.bound // 2:
            self.known = {}

    def _bytes_of(self, keys: list[str]) -> list[bytes]:
        if len(self.known) > self.bound:
            self.trim()
        found = list(map(self.known.get, keys))
        new = [i for i, x in enumerate(found) if x is None]
        for at in range(0, len(new), 8_000):
            part = new[at : at + 8_000]
            full = lambda k: k[1:] if k[:1] == START else k if self.lines and k[:1] == "\n" else f" {k}"
            for i, data in zip(part, self.learn([full(keys[i]) for i in part]), strict=True):
                found[i] = self.known[keys[i]] = data
        return found

    def _plain(self, column: pa.Array) -> list[bytes]:
        column = pc.binary_join_element_wise(pa.scalar(START, pa.large_string()), column, pa.scalar("", pa.large_string()))
        if self.lines:
            column = pc.replace_substring(column, "\n", " \n")
        lists = pc.split_pattern(column, " ")
        chunks = lists.values.dictionary_encode()
        parts = self._bytes_of(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = self.dtype().itemsize
        n = np.fromiter(map(len, parts), np.int64, len(parts)) // size
        flat, first = np.frombuffer(b"".join(parts), self.dtype), np.cumsum(n) - n
        at = chunks.indices.to_numpy()
        length = n[at]
        end = np.cumsum(length)
        shift = (end - length - first[at]).astype(np.int32)
        ids = flat[np.arange(end[-1] if len(end) else 0, dtype=np.int32) - np.repeat(shift, length)].tobytes()
        stops = np.r_[0, end][lists.offsets.to_numpy()] * size
        return [ids[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]

    def __call__(self, texts: Sequence[str] | pa.Array) -> list[bytes]:
        """The ids of each text, four bytes each if ``wide``, else two."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        odd = pc.match_substring_regex(column, f"{self.odd}|\\x00")
        plain = iter(self._plain(column.filter(pc.invert(odd))))
        whole = iter(column.filter(odd).to_pylist())
        return [self._odd(next(whole)) if x else next(plain) for x in odd.to_pylist()]

    def _odd(self, text: str) -> bytes:
        chunks = self.cut.split(text)
        return b"".join(self.learn(chunks) if START in text else self._bytes_of([START + c for c in chunks]))
