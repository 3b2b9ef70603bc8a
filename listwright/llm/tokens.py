"""Exact token ids and counts at word speed.

Both public vocabularies cut a text before every run of white space that follows a non-blank
character, and nothing of their merging crosses such a cut. A text is therefore the
concatenation of units whose ids depend on the unit alone; the library encodes each distinct
unit once per worker and the rest are look-ups.
"""

from __future__ import annotations

import base64
import re
import string
from collections.abc import Callable
from struct import pack

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Every character that some regular expression library calls white space.
_ANY_BLANK = "\\t-\\r\\x1c- \\x85\\xa0\\u1680\\u180e\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff"
#: A blank that does not follow a plain non-blank character.
_UNSAFE = re.compile(f"[{_ANY_BLANK}] ")
_RARE_BLANKS = [chr(c) for c in (*range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E),
                                 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
#: Units kept by a worker; beyond that it starts afresh, which changes no result.
CACHE_UNITS = 1_000_000
#: Longer units are encoded without being kept.
CACHED_CHARS = 64
#: Marks that may follow a plain word; together they are one piece of their own.
_MARKS = string.punctuation


def _plain(word: str) -> bool:
    """Letters of ASCII and Latin-1 only: one piece under both vocabularies' splitting patterns."""
    return word.isalpha() and (word.isascii() or max(word) <= "ÿ")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


_LETTERS = _byte_letters()


def _spelled(word: str) -> str:
    """A plain word in byte letters; ASCII letters stand for themselves."""
    return word if word.isascii() else "".join([_LETTERS[b] for b in word.encode()])


def load(name: str) -> Tokenizer:
    """A public vocabulary by file name; its files are never copied."""
    return Tokenizer.from_file(public_tokenizers.path(name))


def _cuts_everywhere(text: str) -> bool:
    """Whether every blank of the text follows a non-blank and has something behind it."""
    if text[0] == " " or text[-1] == " " or "  " in text or "\n " in text or "\t " in text:
        return False
    return not (any(c in text for c in _RARE_BLANKS) and _UNSAFE.search(text))


class UnitMemo(dict):
    """unit -> what `encode` makes of it, for units of bounded length."""

    def __init__(self, encode: Callable[[str], object]):
        super().__init__()
        self.encode = encode

    def __missing__(self, unit: str):
        found = self.encode(unit)
        if len(unit) <= CACHED_CHARS:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = found
        return found


class IdEncoder:
    """Byte-level BPE ids of whole texts, equal to the library's without special tokens added.

    `ranks` is the same vocabulary as merge ranks; it serves for plain words, which are one piece,
    because it makes no objects for each token. Everything else goes through the library in full.
    """

    def __init__(self, name: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken"):
        tokenizer = load(name)
        with open(public_tokenizers.path(ranks), "rb") as lines:
            merge_ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        merged = tiktoken.Encoding("one_piece", pat_str=r"[\s\S]+", mergeable_ranks=merge_ranks,
                                   special_tokens={})._encode_single_piece
        packed = [pack("<I", i) for i in range(tokenizer.get_vocab_size())]

        def ids(text: str) -> bytes:
            found = tokenizer.encode(text, add_special_tokens=False).ids
            return pack(f"<{len(found)}I", *found)

        marks, line_end = UnitMemo(ids), ids("\n")

        def unit_ids(blank: str, unit: str) -> bytes:
            word = unit.rstrip(_MARKS)
            if _plain(word):
                merged_ids = b"".join([packed[i] for i in merged(blank + word)])
                return merged_ids if len(word) == len(unit) else merged_ids + marks[unit[len(word):]]
            line, _, rest = unit.partition("\n")
            if line and rest and not line[-1].isspace() and not rest[0].isspace():
                # A line end between two non-blanks is a piece of its own.
                return (self._after_blank if blank else self._first)[line] + line_end + self._first[rest]
            return ids(blank + unit)

        self._first = UnitMemo(lambda unit: unit_ids("", unit))
        self._after_blank = UnitMemo(lambda unit: unit_ids(" ", unit))

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if not _cuts_everywhere(text):
            return b"".join(self._first[unit] if unit[0] != " " else self._after_blank[unit[1:]]
                            for unit in self._units(text))
        first, *rest = text.split(" ")
        return self._first[first] + b"".join(map(self._after_blank.__getitem__, rest))

    @staticmethod
    def _units(text: str) -> list[str]:
        """Cut only at blanks between a plain non-blank character and another one."""
        units, start = [], 0
        for cut in re.finditer(f"(?<=[^{_ANY_BLANK}]) (?=[^{_ANY_BLANK}])", text):
            units.append(text[start:cut.start()])
            start = cut.start()
        return [*units, text[start:]]


class WordCounter:
    """Token counts under a vocabulary that drops white space: the sum over the words."""

    def __init__(self, name: str = "word_bpe_49k.json"):
        self.tokenizer = load(name)

        def count(word: str) -> int:
            return len(self.tokenizer.encode(word, add_special_tokens=False)) if word else 0

        marks, merged = UnitMemo(count), self.tokenizer.model.tokenize

        def plain_count(word: str) -> int:
            """The library's merges on a plain word directly; anything else in full."""
            stem = word.rstrip(_MARKS)
            if not _plain(stem):
                return count(word)
            n = len(merged(_spelled(stem.lower())))
            return n if len(stem) == len(word) else n + marks[word[len(stem):]]

        self._memo = UnitMemo(plain_count)

    def __call__(self, text: str) -> int:
        return sum(map(self._memo.__getitem__, text.replace("\n", " ").split(" ")))
