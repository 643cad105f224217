"""Whole-text token ids with the ``tokenizers`` library, at memo speed.

A byte-level BPE splits a text into pre-tokens before it merges.  Wherever one
plain space stands between two characters that are not white space, a pre-token
starts at that space whatever surrounds it, so the text can be cut there and
each unit encoded alone.  Natural text repeats its units, so a bounded memo
answers most of them.  Of the others, a word of Latin letters, with or without
marks after it, is known to be one pre-token (and one for the marks) and goes
straight to the library's model; anything else goes through its whole pipeline.
Texts in which a space touches other white space, or that hold an added token
which the library cuts out, are encoded whole.  Ids are those of
``encode(text, add_special_tokens=False)`` in every case: of the library as it is
loaded, or with ``literal`` of one whose ``encode_special_tokens`` is set, for which
strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import os
from array import array
from codecs import charmap_decode
from functools import lru_cache

import numpy as np

from .common import claim

#: Units in one generation of a worker's memo; it holds two generations at most.
MEMO_ENTRIES = 700_000
#: Longer units are encoded but not kept.
MEMO_UNIT_CHARS = 40
#: Marks that form one pre-token when they end a unit (no apostrophe: it may
#: begin a contraction).
MARKS = '.,;:!?"()*#$%&|-'
#: Characters on which Unicode versions differ as to white space.
ODD_SPACES = "\u180e\u200b\u2060\ufeff"


class _Touching(Exception):
    """A space touches other white space, or a text holds an added token."""


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(other)}


def _spacelike(c: str) -> bool:
    return c.isspace() or c in ODD_SPACES


class _Memo(dict):
    """Ids of units that follow a space; the least used generation goes first."""

    def __init__(self, encoder: "Encoder") -> None:
        super().__init__()
        self._encoder = encoder
        self._old: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        ids = self._old.get(unit)
        if ids is None:
            ids = self._encoder.unit(unit)
            if len(unit) > MEMO_UNIT_CHARS:
                return ids
        self[unit] = ids
        return ids

    def turn(self) -> None:
        if len(self) > MEMO_ENTRIES:
            self._old = dict(self)
            self.clear()


class Encoder:
    """Encodes texts into little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, literal: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        if literal:
            self._tok.encode_special_tokens = True
        self._added = [t.content for t in self._tok.get_added_tokens_decoder().values() if not (literal and t.special)]
        self._model = self._tok.model
        self._letters = "".join(chr(c) for _, c in sorted(_byte_letters().items()))
        self._space = self._letters[32]
        pre, norm = self._tok.pre_tokenizer, self._tok.normalizer
        self._direct = norm is None and "ByteLevel(add_prefix_space=False" in str(pre) and "use_regex=True" in str(pre)
        self._memo = _Memo(self)
        self._marks: dict[str, bytes] = {}
        self._break = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return array("I", self._tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _pretoken(self, piece: str) -> bytes:
        """Ids of one pre-token, given by the stand-ins of its bytes."""
        return array("I", [t.id for t in self._model.tokenize(piece)]).tobytes()

    def _piece(self, word: str) -> str | None:
        """The stand-ins of a word's bytes, if it is of Latin letters."""
        if word.isascii():
            return word if word.isalpha() else None
        if word.isalpha() and max(word) <= "\u024f":
            return charmap_decode(word.encode(), "strict", self._letters)[0]
        return None

    def _mark_ids(self, marks: str) -> bytes:
        if (ids := self._marks.get(marks)) is None:
            ids = self._pretoken(marks)
            if len(self._marks) < MEMO_ENTRIES:
                self._marks[marks] = ids
        return ids

    def unit(self, unit: str) -> bytes:
        """Ids of a space and ``unit``, which holds no space."""
        if (piece := self._piece(unit)) is not None:
            return self._pretoken(self._space + piece)
        if not unit or _spacelike(unit[0]) or _spacelike(unit[-1]):
            raise _Touching
        word = unit.rstrip(MARKS)
        if len(word) < len(unit) and word.isalpha() and max(word) <= "\u024f":
            return self._memo[word] + self._mark_ids(unit[len(word):])
        if "\n" in unit:
            # A line break between other characters is a pre-token, and what
            # follows it starts one without a space.
            first, *rest = unit.split("\n")
            if first and all(rest) and not any(_spacelike(c) for p in (first, *rest) for c in (p[0], p[-1])):
                return self._memo[first] + b"".join([self._break + self._line(p) for p in rest])
        return self._whole(" " + unit)

    def _line(self, text: str) -> bytes:
        """Ids of what follows a line break, kept under a name with the break."""
        key = "\n" + text
        if (ids := self._memo.get(key)) is None:
            ids = self.head(text)
            if len(text) <= MEMO_UNIT_CHARS:
                self._memo[key] = ids
        return ids

    def head(self, text: str) -> bytes:
        """Ids of a text without a space before it."""
        if (piece := self._piece(text)) is not None:
            return self._pretoken(piece)
        word = text.rstrip(MARKS)
        if len(word) < len(text) and (piece := self._piece(word)) is not None:
            return self._pretoken(piece) + self._mark_ids(text[len(word):])
        return self._whole(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One bytes object of ids for each text; a null text has none."""
        memo, out = self._memo, []
        memo.turn()
        for text in texts:
            if not text:
                out.append(b"")
                continue
            head, *units = text.split(" ")
            try:
                if not self._direct or not head or _spacelike(head[-1]) or any(t in text for t in self._added):
                    raise _Touching
                out.append(self.head(head) + b"".join(map(memo.__getitem__, units)))
            except _Touching:
                out.append(self._whole(text))
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, literal: bool) -> Encoder:
    return Encoder(path, literal)


def encoder(path: str, literal: bool = False) -> Encoder:
    """The encoder of this process; its memo outlives the task that made it."""
    claim("tokens", _encoder.cache_clear)
    return _encoder(path, literal)


def ids_of(raw: bytes) -> np.ndarray:
    """The ids in ``raw`` as an array that shares its memory."""
    return np.frombuffer(raw, dtype="<u4")
