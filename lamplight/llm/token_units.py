"""Encoding by whole units: text is cut where no token can span, and each distinct unit is encoded once per task.

The library's tokenizers work on one text at a time and spend most of their time on
words they have just seen.  Both vocabularies cut text into words before any merge, so
ids of a text are the ids of its units one after another, provided that units end where
the tokenizer's own cut is certain.  A text in which that isn't certain (special strings,
the control characters 1C to 1F, on which libraries disagree) is encoded whole.  Texts are
cut at white space first; a word with signs on it is cut into its units when it is new.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: A run of Latin letters (without İ, whose small form ends in a mark) before white space or an ASCII sign other than the apostrophe; no token spans its end.
LETTERS = r"[A-Za-zÀ-ÖØ-öø-įı-ɏ]++(?=[\s!-&(-/:-@\[-`{-~]|\Z)"
#: Byte-level units: such a run or anything without white space, either with one space before it, or white space but for its last character.
BYTE_UNIT = re.compile(rf" ?{LETTERS}| ?\S+|\s+(?!\S)|\s+")
#: What units are looked up in first: words with the signs on them, white space.
BYTE_WORD = re.compile(r" ?\S+|\s+(?!\S)|\s+")
LATIN = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
#: Characters outside those whose small form is one letter, whatever stands beside them.
CASE_DEPENDS = re.compile("[^\x00-įı-ɏ]")
WORD_UNIT = re.compile(rf"{LETTERS}|\S+")
MAX_UNIT = 64


def vocabulary(name: str, folder: str | None = None) -> str:
    """The place of a vocabulary file; folder overrides the installed one."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def is_odd(text: str) -> bool:
    """Whether a text has a special string or one of the characters on which libraries disagree."""
    return "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


def has_plain_case(text: str) -> bool:
    """Whether every character's small form is one letter, whatever stands beside it."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")  # a quick way to say so of most texts
        return True
    except UnicodeEncodeError:
        return not CASE_DEPENDS.search(text)


class Recent(dict):
    """A bounded table of computed values: when it is full it becomes the old half, from which values are taken over as they are used."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most // 2, {}

    def compute(self, unit: str):
        raise NotImplementedError

    def __missing__(self, unit: str):
        value = self.old.get(unit)
        if value is None:
            value = self.compute(unit)
            if len(unit) > MAX_UNIT:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[unit] = value
        return value


class UnitIds(Recent):
    """unit -> its ids as little-endian bytes.

    A unit of Latin letters alone is one word to either vocabulary and is not changed by
    normalising but for its case, so its ids come from the library's merge model directly;
    all others go through the library's whole pipeline.
    """

    def __init__(self, path: str, dtype: str = "<u4", most: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__(most)
        self.library, self.dtype = Tokenizer.from_file(path), dtype
        self.model, self.width = self.library.model, np.dtype(dtype).itemsize
        self.word_level = bool(self.model.end_of_word_suffix)
        self.symbols = {b: c for c, b in byte_symbols().items()}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def compute(self, unit: str) -> bytes:
        if not LATIN.fullmatch(unit) or self.word_level and unit[0] == " ":
            parts = (WORD_UNIT if self.word_level else BYTE_UNIT).findall(unit)
            return b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else self.whole(unit)
        word = unit.lower() if self.word_level else unit
        if not word.isascii():
            word = "".join([self.symbols[b] for b in word.encode()])
        elif word[0] == " ":
            word = self.symbols[32] + word[1:]
        return b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(word)])


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_ids(memo: UnitIds, text: str) -> bytes:
    """Ids of a text by the byte-level vocabulary."""
    if is_odd(text):
        return memo.whole(text)
    return b"".join(map(memo.__getitem__, BYTE_WORD.findall(text)))


def word_level_ids(memo: UnitIds, text: str) -> bytes:
    """Ids of a text by the vocabulary with word ends, which drops white space and case."""
    if is_odd(text):
        return memo.whole(text)
    if has_plain_case(text):
        text = text.lower()  # fewer distinct units
    return b"".join(map(memo.__getitem__, text.split()))


@lru_cache(maxsize=2)
def unit_ids(path: str, dtype: str, most: int = 400_000) -> UnitIds:
    """One table of units for each worker process, which serves many tasks; a million units take about 200 MB."""
    return UnitIds(path, dtype, most)
