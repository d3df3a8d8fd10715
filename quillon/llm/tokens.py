"""Whole-text encoding with the tokenizers library, each distinct piece being encoded once.

Both vocabularies split a text at spaces whatever stands around them, so a text's ids are the ids of
its space-separated pieces in order.  ``LibraryEncoder`` remembers the ids that the library gives for
a piece; the memory is two generations of bounded size, so common pieces stay and rare ones go.
Where a piece is not independent of its neighbours (it is empty, or starts or ends with white space),
the library encodes the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from operator import attrgetter

import numpy as np

#: How the two vocabularies split texts (fixed values, as their files have them).
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
UNSPACED = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Characters on whose kind regular expression libraries may differ.
FOREIGN = re.compile("[^\x00-\u012f\u0132-\u02ff]|<\\|").search
ID = attrgetter("id")
CONTROL = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0]").search

#: Pieces in one generation of the memory.
GENERATION = 500_000
#: Pieces longer than this are encoded anew each time.
PIECE = 64


class Memory(dict):
    """Piece -> ids as little-endian bytes; fills itself from ``make``, which gives None where it can't tell."""

    def __init__(self, make=lambda piece: None, size: int = GENERATION):
        self.make, self.limit, self.old = make, size, {}

    def __missing__(self, piece):
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if found is not None:
            self.put(piece, found)
        return found

    def put(self, piece, ids):
        if len(piece) <= PIECE:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = ids


class Words(Memory):
    """Memory of words; a word with one mark behind it, and words across a line end, are put together each time."""

    def __init__(self, make, size: int, mark):
        super().__init__(make, size)
        self.marks = {c: mark(c) for c in ".,!?;:"}

    def __missing__(self, piece):
        mark = self.marks.get(piece[-1:])
        # The one Latin letter whose lower case ends in a mark of its own would join the mark behind it.
        if mark is not None and piece[:-1].isalpha() and "\u0130" not in piece:
            return self[piece[:-1]] + mark
        return self.make(piece) if "\n" in piece else super().__missing__(piece)


class LibraryEncoder:
    """ids(text) -> array of unsigned 32-bit ids, equal to the library's with add_special_tokens=False."""

    def __init__(self, path: str, memory: int = GENERATION):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        # In the byte-level vocabulary a space belongs to the word behind it; else it is dropped.
        self.spaced = self.library.normalizer is None
        self.split = regex.compile(SPACED if self.spaced else UNSPACED).findall
        self.letter = {b: c for c, b in byte_letters().items()}
        self.space = self.letter[32]
        self.words = Memory(self._word, memory // 5)
        self.head = Memory(self._encode, memory // 10)
        self.rest = Words(self._behind_space if self.spaced else self._encode, memory, self._encode)

    def _word(self, word: str) -> bytes:
        """Ids that the library's model gives for one pre-token."""
        if word.isascii() and word[-1].isalpha():
            letters = word.replace(" ", self.space, 1)  # ASCII letters stand for themselves
        else:
            letters = word.encode().decode("latin-1").translate(self.letter)
        return array("I", map(ID, self.model.tokenize(letters))).tobytes()

    def _encode(self, text: str) -> bytes:
        low = text if self.spaced else text.lower()
        if low.isalpha() and max(low) < "\u0300" and max(text) < "\u0300":
            return self._word(low)
        # Plain Latin text is normalised and split here; all else, and special tokens, by the library.
        if text and max(text) < "\u0300" and "<|" not in text and not CONTROL(text):
            return b"".join(map(self.words.__getitem__, self.split(low)))
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _behind_space(self, piece: str) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if "\n" in piece and len(parts := piece.split("\n")) == 2 and _plain(parts[0]) and _plain(parts[1]):
            return self.rest[parts[0]] + self.head["\n"] + self.head[parts[1]]
        if piece.isalpha() and max(piece) < "\u0300":
            return self._word(" " + piece)
        return self._encode(" " + piece)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.spaced:
            first, *others = text.split(" ")
            if first and not first[-1].isspace():
                try:
                    return np.frombuffer(self.head[first] + b"".join(map(self.rest.__getitem__, others)), "<u4")
                except TypeError:  # a piece that needs its neighbours
                    pass
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        if not FOREIGN(text):  # these have one lower case, whatever stands around them
            text = text.lower()
        return np.frombuffer(b"".join(map(self.rest.__getitem__, text.replace("\n", " ").split(" "))), "<u4")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def _plain(part: str) -> bool:
    return bool(part) and not part[0].isspace() and not part[-1].isspace()


@lru_cache(maxsize=4)
def encoder(path: str) -> LibraryEncoder:
    """One encoder per worker process and vocabulary; its memory serves all tasks of the worker."""
    return LibraryEncoder(path)


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
