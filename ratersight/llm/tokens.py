"""Token ids of whole texts by the tokenizers library, with the ids of repeated words kept."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import regex

#: A text is cut at spaces that a non-space follows; elsewhere the whole text goes to the library.
_UNSAFE = re.compile(r" (?=\s)|<\|")
#: Beyond these, lower case and normal forms are left to the library; up to U+024F no letter changes with those around it.
_OTHER = re.compile("[^ -~\\n\u00c0-\u024f]")
#: Kept words of each generation; the older of two generations is dropped when the newer is full.
KEPT = 300_000


#: The pattern of byte-level tokenizers that name none.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How byte-level models show bytes: printable ones as themselves, the others from U+0100 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - _PLAIN))}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Both supported kinds of tokenizer cut a text before each space that a non-space follows, whatever stands around, so
    such units are encoded apart and their ids joined; this one, for words, leaves white space out, so that it cuts texts of
    common characters at all of it. Tests hold this against the library. specials: strings of special tokens in a text
    become these tokens; else a text cannot forge an end of a document."""

    def __init__(self, path: str, pattern: str, specials: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # as the files' own description has it: strings of special tokens in a text are ordinary text
        self.library.encode_special_tokens = not specials
        self.normalizer, self.pre = self.library.normalizer, self.library.pre_tokenizer
        self.model = self.library.model.tokenize
        self.split = regex.compile(pattern).findall
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, shown: str) -> bytes:
        """The ids of one pre-token as the library's model gives them."""
        return array("I", [t.id for t in self.model(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        """A unit of letters only."""
        return self._ids(word.lower()) if word.isascii() else self._mixed(word)

    def _mixed(self, unit: str) -> bytes:
        if _OTHER.search(unit):
            return self._slow(unit)
        unit = unit.lower()
        if unit.isalpha():
            return self._ids(unit if unit.isascii() else unit.encode().decode("latin-1").translate(_SHOWN))
        if unit[:-1].isalpha():  # a word and one mark or digit
            return self[unit[:-1]] + self[unit[-1]]
        return b"".join([self[p] if p.isalpha() else self._ids(p.encode().decode("latin-1").translate(_SHOWN)) for p in self.split(unit)])

    def _slow(self, text: str) -> bytes:
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        return b"".join([self._ids(p) for p, _ in self.pre.pre_tokenize_str(text)])

    def __getitem__(self, unit: str) -> bytes:
        got = self.new.get(unit)
        if got is None:
            got = self.old.get(unit)
            if got is None:
                got = self._word(unit) if unit.isalpha() else self._mixed(unit)
            if len(self.new) >= KEPT:
                self.old, self.new = self.new, {}
            self.new[unit] = got
        return got

    def encode(self, text: str) -> bytes:
        other = _OTHER.search(text)
        if _UNSAFE.search(text) if other else "<|" in text:
            return self._library(text)
        units = text.split(" ") if other else text.lower().split()
        own = self.__getitem__
        return b"".join([own(u) if got is None else got for u, got in zip(units, list(map(self.new.get, units)))])


class Spaced(Encoder):
    """For byte-level tokenizers: a unit stands for itself with a space before it."""

    def _word(self, word: str) -> bytes:
        return self._ids("\u0120" + (word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)))

    def _mixed(self, unit: str) -> bytes:
        return b"".join([self._after(p) for p in self.split(" " + unit)])

    def _after(self, piece: str) -> bytes:
        word = piece[1:]
        if piece[0] == " " and word.isalpha():
            return self[word]
        return self._ids(piece.encode().decode("latin-1").translate(_SHOWN))

    def _head(self, unit: str) -> bytes:
        return b"".join([self._ids(p.encode().decode("latin-1").translate(_SHOWN)) for p in self.split(unit)])

    def encode(self, text: str) -> bytes:
        if _UNSAFE.search(text):
            return self._library(text)
        head, *rest = text.split(" ")
        try:
            ids = list(map(self.new.__getitem__, rest))
        except KeyError:
            own, new = self.__getitem__, self.new
            ids = [new.get(u) or own(u) for u in rest]
        return b"".join([self._head(head), *ids])


@lru_cache(maxsize=4)
def encoder(path: str, specials: bool = False) -> Encoder:
    """The encoder of a tokenizer file, one for each worker process."""
    import json

    with open(path) as f:
        pre = json.load(f)["pre_tokenizer"]
    if pre["type"] == "ByteLevel":
        return Spaced(path, BYTE_LEVEL, specials)
    return Encoder(path, pre["pretokenizers"][0]["pattern"]["Regex"], specials)
