"""Whole texts to token ids with the tokenizers library, each distinct piece encoded once per worker.

Both vocabularies used here split a text into words before they merge, and a word never crosses a
space (U+0020) that a non-space character follows, a single line feed between two such characters,
nor the border of a run of letters (but for contractions, which begin with an apostrophe).  So a
text is cut at those spaces, a piece not seen before at its line feed and its runs of letters, every
part is encoded by the library, and the ids of pieces seen before come from a table of two
generations, whose number of entries is bounded.  Texts that hold a special-token string are encoded
whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_CUT = re.compile(r" (?=\S)")
_PARTS = regex.compile(r"\p{L}+|\P{L}+")
_encoders: dict[str, PieceEncoder] = {}


class _Joined(Exception):
    """A piece that begins with white space belongs to what stands before it."""


class _Known(dict):
    """ids by piece; two generations of at most ``entries`` pieces, used ones move to the younger.

    ``prefix`` stands before every piece: a space, or nothing at the start of a text or a line.
    ``inner`` is the table of what follows inside a piece (itself, where the prefix is empty).
    """

    def __init__(self, plain, word, prefix: str, entries: int, longest: int, inner: _Known | None = None):
        super().__init__()
        self.plain, self.word, self.prefix, self.entries, self.longest, self.older = plain, word, prefix, entries, longest, {}
        self.inner = self if inner is None else inner

    def keep(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= self.longest:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def whole(self, piece: str) -> bytes:
        return self.keep(piece, self.plain(self.prefix + piece))

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is not None:
            return self.keep(piece, ids)
        if piece.isalpha():
            if self.word and (piece.isascii() or _safe(max(piece)) and "İ" not in piece):
                return self.keep(piece, self.word(self.prefix, piece))
            return self.whole(piece)
        if not piece or piece[0].isspace():
            if self.prefix:
                raise _Joined
            return self.whole(piece)
        if piece.count("\n") == 1:
            before, _, after = piece.partition("\n")
            if after and not before[-1].isspace() and not after[0].isspace():
                return self[before] + self.inner["\n"] + self.inner[after]
        parts = _PARTS.findall(piece)
        if len(parts) == 1:
            return self.whole(piece)
        for n, part in enumerate(parts):
            last = n == len(parts) - 1
            if part[0].isalpha():
                if not last and not _safe(part[-1]):
                    return self.whole(piece)
            elif not part.isascii() or not last and (part[-1] == "'" or len(part) > 1 and part[-2:].isspace()):
                return self.whole(piece)
        inner = self.inner
        return self.keep(piece, self[parts[0]] + b"".join([inner[x] for x in parts[1:]]))


def _safe(letter: str) -> bool:
    """A letter that normalising and lower-casing leave one letter."""
    return "" < letter < "ɐ" and letter != "İ"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(0x100 + n) for n, b in enumerate(others)}


class _Words:
    """The library's merges alone, for words of plain letters: normalising and splitting would leave them whole."""

    def __init__(self, tokenizer, code: str):
        self._merge, self._letters, self._code = tokenizer.model.tokenize, _byte_letters(), code
        self._lower = tokenizer.encode("QA", add_special_tokens=False).ids == tokenizer.encode("qa", add_special_tokens=False).ids
        self._prefixes = {p: self._letters[ord(p)] if p and tokenizer.encode(p, add_special_tokens=False).ids else "" for p in ("", " ")}
        probes = ("word", "Anblewh", "ererinning", "Éléâtre", "ciónñz", "größeß", "ÅÄÖ", "i", "xqzkj")
        self.usable = all(array(code, tokenizer.encode(p + x, add_special_tokens=False).ids).tobytes() == self.ids(p, x) for x in probes for p in ("", " "))

    def ids(self, prefix: str, word: str) -> bytes:
        if self._lower:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self._letters)
        return array(self._code, [t.id for t in self._merge(self._prefixes[prefix] + word)]).tobytes()


class PieceEncoder:
    """ids of a text as little-endian integers of type ``item`` (16 bits where the vocabulary allows), without special tokens."""

    def __init__(self, path: str, entries: int = 450_000, longest: int = 40):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self._tokenizer.get_vocab_size()
        self._code, self.item = ("H", "<u2") if self.vocabulary <= 1 << 16 else ("I", "<u4")
        words = _Words(self._tokenizer, self._code)
        word = words.ids if words.usable else None
        self._first = _Known(self._plain, word, "", entries // 4, longest)
        self._known = _Known(self._plain, word, " ", entries, longest, self._first)
        added = [str(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None

    def _plain(self, text: str) -> bytes:
        return array(self._code, self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text and self._special(text):
            return self._plain(text)
        known, cut = self._known, text.split(" ")
        try:
            return self._first[cut[0]] + b"".join([known[x] for x in cut[1:]])
        except _Joined:
            pass
        cut = _CUT.split(text)
        return self._first[cut[0]] + b"".join([known[x] for x in cut[1:]])

    def forget(self) -> None:
        for table in (self._first, self._known):
            table.clear()
            table.older = {}

    def encode_u32(self, text: str) -> bytes:
        """The same as unsigned 32-bit integers."""
        return np.frombuffer(self.encode(text), self.item).astype("<u4").tobytes()


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


@contextmanager
def encoding(path: str) -> Iterator[PieceEncoder]:
    """The encoder for one task, whose table of pieces goes when the task ends: workers live on and serve other stages."""
    one = encoder(path)
    try:
        yield one
    finally:
        one.forget()
