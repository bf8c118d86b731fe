"""Character classes and the byte alphabet, as data for Spark's regular expressions and for Python helpers."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters with the Unicode property White_Space (fixed values).
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The same as a regular-expression class body, for Java and Python.
SPACE_CLASS = WHITE_SPACE
#: ASCII punctuation together with Unicode punctuation, as a Java class body.
PUNCT_CLASS = r"!-/:-@\[-`{-~\p{P}"
#: Ranges of CJK ideographs that get spaces around them (fixed values).
CJK_RANGES = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
#: The published split pattern of byte-level models (fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def is_space(c: str) -> bool:
    return c in WHITE_SPACE


def is_punctuation(c: str) -> bool:
    return "!" <= c <= "/" or ":" <= c <= "@" or "[" <= c <= "`" or "{" <= c <= "~" or unicodedata.category(c)[0] == "P"


def is_numeric(c: str) -> bool:
    return unicodedata.category(c)[0] == "N"


def is_cjk(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in CJK_RANGES)


@cache
def byte_alphabet() -> tuple[str, ...]:
    """A printable character for each byte: itself where it prints, else the next free one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in set(prints) else chr(next(rest)) for b in range(256))


@cache
def byte_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_alphabet())}


def to_byte_chars(text: str) -> str:
    table = byte_alphabet()
    return "".join(table[b] for b in text.encode())


def byte_chars(text: Column) -> Column:
    """Each UTF-8 byte of the text as its printable character, in the JVM."""
    moved = [b for b, c in enumerate(byte_alphabet()) if chr(b) != c and b]
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    swapped = F.translate(latin, "".join(map(chr, moved)), "".join(byte_alphabet()[b] for b in moved))
    return F.replace(swapped, F.lit("\x00"), F.lit(byte_alphabet()[0]))


def cjk_class() -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_RANGES)


def quoted(text: str) -> str:
    """A literal for Java's and Python's regular expressions."""
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c if c.isprintable() else f"\\x{ord(c):02x}" for c in text)
