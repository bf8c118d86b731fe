"""Normalizers: text to text, as Spark columns and, with alignment, inside Arrow batches.

``column`` is the text-only form and stays in the JVM except for Unicode normal
forms, which Spark has no function for; ``align`` keeps track of the original.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.aligned import Aligned, found_by
from textloom.functions.batches import slices
from textloom.functions.chars import SPACE_CLASS, WHITE_SPACE, byte_chars, cjk_class, is_cjk, is_space, quoted, to_byte_chars
from textloom.functions.patterns import Pattern, _compiled, pattern_from_json


class Normalizer:
    def column(self, text: Column) -> Column:
        """Default: the aligned form's text, batch by batch."""
        align = self.align

        @F.pandas_udf("string")
        def normalized(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else align(Aligned(t)).text)

        return normalized(text)

    def align(self, text: Aligned) -> Aligned:
        raise NotImplementedError

    def normalize_str(self, text: str) -> str:
        return self.align(Aligned(text)).text


@dataclass(frozen=True)
class UnicodeForm(Normalizer):
    """NFC, NFD, NFKC or NFKD."""

    form: str

    def align(self, text: Aligned) -> Aligned:
        return text.normalize(self.form)

    def column(self, text: Column) -> Column:
        form = self.form

        def normalized(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for whole in batches:
                for texts in slices(whole, [whole]):
                    yield pa.array([None if t is None else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

        normalized.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        # plain ASCII is in every normal form already and stays in the JVM
        plain = F.octet_length(text) == F.char_length(text)
        return F.when(plain, text).otherwise(F.arrow_udf(normalized, "string")(F.when(~plain, text)))


@dataclass(frozen=True)
class Lowercase(Normalizer):
    """Every character by itself, so a final sigma is like any other."""

    def align(self, text: Aligned) -> Aligned:
        return text.lower()

    def column(self, text: Column) -> Column:
        return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


@dataclass(frozen=True)
class Strip(Normalizer):
    strip_left: bool = True
    strip_right: bool = True

    def align(self, text: Aligned) -> Aligned:
        return text.strip(self.strip_left, self.strip_right, WHITE_SPACE)

    def column(self, text: Column) -> Column:
        ends = [rf"^[{SPACE_CLASS}]+"] * self.strip_left + [rf"[{SPACE_CLASS}]+\z"] * self.strip_right
        return F.regexp_replace(text, "|".join(ends), "") if ends else text


@dataclass(frozen=True)
class StripAccents(Normalizer):
    """Drops combining marks; decompose first to reach those of composed letters."""

    def align(self, text: Aligned) -> Aligned:
        return text if text.text.isascii() else text.without({c for c in set(text.text) if unicodedata.category(c)[0] == "M"})

    def column(self, text: Column) -> Column:
        return F.regexp_replace(text, r"\p{M}", "")


#: Controls that are dropped, and characters that become a space (fixed values).
NMT_DROPPED = "".join(map(chr, [*range(0x01, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F, 0x8F, 0x9F]))
NMT_SPACED = "".join(map(chr, [0x09, 0x0A, 0x0C, 0x0D, 0x1680, *range(0x200B, 0x2010), 0x2028, 0x2029, 0x2581, 0xFEFF, 0xFFFD]))


@dataclass(frozen=True)
class Nmt(Normalizer):
    def align(self, text: Aligned) -> Aligned:
        return text.filter(lambda c: c not in NMT_DROPPED).map(lambda c: " " if c in NMT_SPACED else c)

    def column(self, text: Column) -> Column:
        return F.translate(text, NMT_SPACED + NMT_DROPPED, " " * len(NMT_SPACED))


@dataclass(frozen=True)
class Replace(Normalizer):
    """Every match becomes ``content``, taken literally."""

    pattern: Pattern
    content: str

    def align(self, text: Aligned) -> Aligned:
        return text.replace(found_by(self.pattern.python, text.text), self.content)

    def column(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern.java, self.content.replace("\\", "\\\\").replace("$", "\\$"))


@dataclass(frozen=True)
class Prepend(Normalizer):
    prepend: str

    def align(self, text: Aligned) -> Aligned:
        return text.prepend(self.prepend)

    def column(self, text: Column) -> Column:
        return F.when(F.length(text) > 0, F.concat(F.lit(self.prepend), text)).otherwise(text)


@dataclass(frozen=True)
class ByteChars(Normalizer):
    """Every byte as its printable character."""

    def align(self, text: Aligned) -> Aligned:
        return text.map(to_byte_chars)

    def column(self, text: Column) -> Column:
        return byte_chars(text)


@dataclass(frozen=True)
class BertNormalizer(Normalizer):
    clean_text: bool = True
    handle_chinese_chars: bool = True
    strip_accents: bool | None = None
    lowercase: bool = True

    @property
    def drops_accents(self) -> bool:
        return self.lowercase if self.strip_accents is None else self.strip_accents

    def align(self, text: Aligned) -> Aligned:
        if self.clean_text:
            text = text.filter(lambda c: c in "\t\n\r" or not (c in "\x00\ufffd" or unicodedata.category(c)[0] == "C")).map(lambda c: " " if is_space(c) else c)
        if self.handle_chinese_chars and not text.text.isascii():
            text = text.map(lambda c: f" {c} " if is_cjk(c) else c)
        if self.drops_accents and not text.text.isascii():
            text = text.normalize("NFD").filter(lambda c: unicodedata.category(c) != "Mn")
        return text.lower() if self.lowercase else text

    def column(self, text: Column) -> Column:
        """Texts of ASCII stay in the JVM, where the classes are finite; the others go through Python once."""
        ascii_only = F.octet_length(text) == F.char_length(text)
        plain = F.translate(F.replace(text, F.lit("\x00"), F.lit("")), "\t\n\r" + _ASCII_CONTROLS, "   ") if self.clean_text else text
        plain = F.lower(plain) if self.lowercase else plain
        maps = (_Mapped(self._cleaned), _Mapped(lambda c: "" if unicodedata.category(c) == "Mn" else c), _Mapped(str.lower))

        def normalized(texts: pa.Array) -> pa.Array:
            cleaned, bare, lowered = maps
            out = []
            for t in texts.to_pylist():
                if t is not None:
                    t = t.translate(cleaned)
                    if self.drops_accents:
                        t = unicodedata.normalize("NFD", t).translate(bare)
                    t = t.translate(lowered) if self.lowercase else t
                out.append(t)
            return pa.array(out, pa.string())

        normalized.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.when(ascii_only, plain).otherwise(F.arrow_udf(normalized, "string")(F.when(~ascii_only, text)))

    def _cleaned(self, c: str) -> str:
        """What clean-up and the spacing of ideographs make of a character."""
        if self.clean_text:
            if c not in "\t\n\r" and (c in "\x00\ufffd" or unicodedata.category(c)[0] == "C"):
                return ""
            c = " " if is_space(c) else c
        return f" {c} " if self.handle_chinese_chars and is_cjk(c) else c


#: ASCII control characters that clean-up drops, but for the null character.
_ASCII_CONTROLS = "".join(chr(i) for i in [*range(1, 32), 127] if chr(i) not in "\t\n\r")


class _Mapped(dict):
    """A table for ``str.translate`` that is filled as characters occur."""

    def __init__(self, of: Callable[[str], str]):
        super().__init__()
        self.of = of

    def __missing__(self, point: int) -> str:
        made = self[point] = self.of(chr(point))
        return made


@dataclass(frozen=True)
class Precompiled(Normalizer):
    """A character map compiled by SentencePiece: a size, a double-array trie, and the replacements it points to."""

    charsmap: bytes

    @cached_property
    def _parts(self) -> tuple[tuple[int, ...], bytes]:
        size = struct.unpack_from("<I", self.charsmap)[0]
        return struct.unpack_from(f"<{size // 4}I", self.charsmap, 4), self.charsmap[4 + size :]

    def lookup(self, chunk: bytes) -> str | None:
        """The replacement of the shortest prefix that the trie holds, if any."""
        units, strings = self._parts
        if not units:
            return None
        at = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for byte in chunk:
            at ^= byte
            if at >= len(units) or units[at] & 0x800000FF != byte:
                return None
            unit = units[at]
            at ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = units[at] & 0x7FFFFFFF
                return strings[start : strings.index(b"\0", start)].decode()
        return None

    def align(self, text: Aligned) -> Aligned:
        pieces = []
        for start, stop in _graphemes(text.text):
            part = text.text[start:stop]
            whole = self.lookup(part.encode()) if len(part.encode()) < 6 else None
            if whole is not None:
                pieces.append((whole, text.span(start)))
            else:
                for i in range(start, stop):
                    found = self.lookup(text.text[i].encode())
                    pieces.append((text.text[i] if found is None else found, text.span(i)))
        return text.replaced(pieces)


def _graphemes(text: str) -> list[tuple[int, int]]:
    """The user-perceived characters of a text, as Unicode's extended grapheme clusters."""
    return [m.span() for m in _compiled(r"\X").finditer(text)]


@dataclass(frozen=True)
class NormalizerSequence(Normalizer):
    normalizers: tuple[Normalizer, ...]

    def align(self, text: Aligned) -> Aligned:
        return reduce(lambda t, n: n.align(t), self.normalizers, text)

    def column(self, text: Column) -> Column:
        return reduce(lambda t, n: n.column(t), self.normalizers, text)


@dataclass(frozen=True)
class CustomNormalizer(Normalizer):
    """A caller's function on aligned texts; it is shipped to the workers but cannot be saved as JSON."""

    function: Callable[[Aligned], Aligned] = field(compare=False)

    def align(self, text: Aligned) -> Aligned:
        return self.function(text)


def normalizer_from_name(name: str) -> Normalizer:
    if name.upper() not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"{name} is not a unicode normalizer; there are nfc, nfd, nfkc and nfkd")
    return UnicodeForm(name.upper())


def normalizer_to_json(n: Normalizer | None) -> dict | None:
    match n:
        case None:
            return None
        case UnicodeForm(form):
            return {"type": form}
        case NormalizerSequence(parts):
            return {"type": "Sequence", "normalizers": [normalizer_to_json(p) for p in parts]}
        case Replace(pattern, content):
            return {"type": "Replace", "pattern": pattern.to_json(), "content": content}
        case Precompiled(charsmap):
            return {"type": "Precompiled", "precompiled_charsmap": base64.b64encode(charsmap).decode()}
        case ByteChars():
            return {"type": "ByteLevel"}
        case CustomNormalizer():
            raise ValueError("a custom normalizer cannot be saved")
    return {"type": type(n).__name__, **vars(n)}


def normalizer_from_json(j: dict | None) -> Normalizer | None:
    if j is None:
        return None
    kind, rest = j["type"], {k: v for k, v in j.items() if k != "type"}
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return UnicodeForm(kind)
    if kind == "Sequence":
        return NormalizerSequence(tuple(normalizer_from_json(p) for p in j["normalizers"]))
    if kind == "Replace":
        return Replace(pattern_from_json(j["pattern"]), j["content"])
    if kind == "Precompiled":
        return Precompiled(base64.b64decode(j["precompiled_charsmap"]))
    simple = {"Lowercase": Lowercase, "Strip": Strip, "StripAccents": StripAccents, "Nmt": Nmt, "Prepend": Prepend, "ByteLevel": ByteChars, "BertNormalizer": BertNormalizer}
    if kind not in simple:
        raise ValueError(f"unknown normalizer {kind}")
    return simple[kind](**rest)
