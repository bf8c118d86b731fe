"""Splitters, which cut a text into the pieces that a model reads.

A splitter is a column expression that gives an array of pieces; where offsets
into the original are wanted it cuts aligned texts inside Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.aligned import Aligned, Span, found_by, tiles
from textloom.functions.chars import BYTE_LEVEL_PATTERN, PUNCT_CLASS, SPACE_CLASS, byte_alphabet, byte_chars, is_punctuation, quoted, to_byte_chars
from textloom.functions.patterns import Pattern, _compiled, pattern_from_json


def pieces_by_regex(text: Column, match: str, other: str, behavior: str) -> Column:
    """Pieces of a text under a delimiter behaviour.

    ``match`` matches one delimiter, ``other`` a maximal run without any."""
    if behavior == "removed":
        # several times faster than collecting matches
        return F.array_remove(F.split(text, match), "")
    forms = {
        "isolated": f"{match}|{other}",
        "contiguous": f"(?:{match})+|{other}",
        "merged_with_previous": f"(?:{other})(?:{match})?|{match}",
        "merged_with_next": f"(?:{match})(?:{other})?|{other}",
    }
    return F.regexp_extract_all(text, F.lit(forms[behavior]), F.lit(0))


class Splitter:
    def column(self, text: Column) -> Column:
        """Default: the aligned form's pieces, batch by batch."""
        align = self.align

        @F.pandas_udf("array<string>")
        def pieces(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else [p.text for p in align([Aligned(t)])])

        return pieces(text)

    def align(self, parts: list[Aligned]) -> list[Aligned]:
        return [p for part in parts for p in self.cut(part) if p.text]

    def cut(self, part: Aligned) -> list[Aligned]:
        spans = self.spans(part.text)
        if spans is None:
            raise NotImplementedError
        return [part.slice(a, b) for a, b in spans]

    def spans(self, text: str) -> list[Span] | None:
        """Where the pieces are, of a splitter that changes nothing in them and looks at nothing but the text; else None."""
        return None

    def gaps(self, codes: np.ndarray) -> np.ndarray | None:
        """Which code points lie between pieces, of a splitter whose pieces are the runs of all others; else None."""
        return None

    def pre_tokenize_str(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return [(p.text, p.to_original(0, len(p.text))) for p in self.align([Aligned(text)])]


def by_predicate(text: str, holds: Callable[[str], bool]) -> list[tuple[int, int]]:
    return [(i, i + 1) for i, c in enumerate(text) if holds(c)]


@dataclass(frozen=True)
class Whitespace(Splitter):
    """Runs of word characters and runs of other characters that are not space."""

    def column(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]+"), F.lit(0))

    def spans(self, text: str) -> list[Span]:
        return found_by(_compiled(r"\w+|[^\w\s]+"), text)


_NOT_SPACE = re.compile(f"[^{SPACE_CLASS}]+")
#: By code point; the last is no space and stands for all beyond.
_IS_SPACE = np.isin(np.arange(max(map(ord, SPACE_CLASS)) + 2), list(map(ord, SPACE_CLASS)))


@dataclass(frozen=True)
class WhitespaceSplit(Splitter):
    def column(self, text: Column) -> Column:
        return F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")

    def spans(self, text: str) -> list[Span]:
        return found_by(_NOT_SPACE, text)

    def gaps(self, codes: np.ndarray) -> np.ndarray:
        return _IS_SPACE[np.minimum(codes, len(_IS_SPACE) - 1)]


@dataclass(frozen=True)
class BertSplitter(Splitter):
    """Space removed, then every punctuation character by itself."""

    def column(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(f"[{PUNCT_CLASS}]|[^{PUNCT_CLASS}{SPACE_CLASS}]+"), F.lit(0))

    def cut(self, part: Aligned) -> list[Aligned]:
        words = [part.slice(a, b) for a, b in found_by(_NOT_SPACE, part.text)]
        return [p for w in words for p in w.split(tiles(by_predicate(w.text, is_punctuation), len(w.text)), "isolated")]


@dataclass(frozen=True)
class Punctuation(Splitter):
    behavior: str = "isolated"

    def column(self, text: Column) -> Column:
        return pieces_by_regex(text, f"[{PUNCT_CLASS}]", f"[^{PUNCT_CLASS}]+", self.behavior)

    def cut(self, part: Aligned) -> list[Aligned]:
        return part.split(tiles(by_predicate(part.text, is_punctuation), len(part.text)), self.behavior)


@dataclass(frozen=True)
class Digits(Splitter):
    individual_digits: bool = False

    def column(self, text: Column) -> Column:
        return pieces_by_regex(text, r"\p{N}", r"\P{N}+", "isolated" if self.individual_digits else "contiguous")

    def cut(self, part: Aligned) -> list[Aligned]:
        found = by_predicate(part.text, lambda c: unicodedata.category(c)[0] == "N")
        return part.split(tiles(found, len(part.text)), "isolated" if self.individual_digits else "contiguous")


@dataclass(frozen=True)
class CharDelimiterSplit(Splitter):
    delimiter: str

    def column(self, text: Column) -> Column:
        return F.filter(F.split(text, quoted(self.delimiter)), lambda p: p != "")

    def cut(self, part: Aligned) -> list[Aligned]:
        return part.split(tiles(by_predicate(part.text, self.delimiter.__eq__), len(part.text)), "removed")


@dataclass(frozen=True)
class Split(Splitter):
    """Splits at a pattern; ``invert`` swaps matches and what lies between them."""

    pattern: Pattern
    behavior: str = "removed"
    invert: bool = False

    def column(self, text: Column) -> Column:
        match, other = f"(?:{self.pattern.java})", f"(?:(?!{self.pattern.java})(?s:.))+"
        # a look-behind of the pattern sees the whole text either way
        return pieces_by_regex(text, other if self.invert else match, match if self.invert else other, self.behavior)

    def cut(self, part: Aligned) -> list[Aligned]:
        parts = tiles(found_by(self.pattern.python, part.text), len(part.text))
        return part.split(((span, match != self.invert) for span, match in parts), self.behavior)


@dataclass(frozen=True)
class Metaspace(Splitter):
    """Spaces become ``replacement``, which may also be put before the text, and pieces start with it."""

    replacement: str = chr(0x2581)
    prepend_scheme: str = "always"
    split: bool = True

    def column(self, text: Column) -> Column:
        r = self.replacement
        spaced = F.replace(text, F.lit(" "), F.lit(r))
        if self.prepend_scheme != "never":
            spaced = F.when(F.length(spaced) == 0, spaced).when(spaced.startswith(r), spaced).otherwise(F.concat(F.lit(r), spaced))
        if not self.split:
            return F.filter(F.array(spaced), lambda p: p != "")
        q = quoted(r)
        return F.regexp_extract_all(spaced, F.lit(f"{q}[^{q}]*|[^{q}]+"), F.lit(0))

    def cut(self, part: Aligned) -> list[Aligned]:
        part = part.replace(found_by(re.compile(" "), part.text), self.replacement)
        first = not part.text or part.to_original(0, 1)[0] == 0
        if not part.text.startswith(self.replacement) and (self.prepend_scheme == "always" or self.prepend_scheme == "first" and first):
            part = part.prepend(self.replacement)
        if not self.split:
            return [part]
        return part.split(tiles(by_predicate(part.text, self.replacement.__eq__), len(part.text)), "merged_with_next")


_ASCII_BYTES = dict(enumerate(byte_alphabet()[:128]))
_byte_chars_of = lru_cache(65_536)(to_byte_chars)


@dataclass(frozen=True)
class ByteLevel(Splitter):
    """The byte-level models' split, each byte as a printable character."""

    add_prefix_space: bool = True
    trim_offsets: bool = True
    use_regex: bool = True

    def column(self, text: Column) -> Column:
        if self.add_prefix_space:
            text = F.when((F.length(text) > 0) & ~text.startswith(" "), F.concat(F.lit(" "), text)).otherwise(text)
        pieces = F.regexp_extract_all(text, F.lit(f"(?U){BYTE_LEVEL_PATTERN}"), F.lit(0)) if self.use_regex else F.filter(F.array(text), lambda p: p != "")
        return F.transform(pieces, byte_chars)

    def cut(self, part: Aligned) -> list[Aligned]:
        if self.add_prefix_space and part.text and not part.text.startswith(" "):
            part = part.prepend(" ")
        pieces = part.split(tiles(found_by(_compiled(BYTE_LEVEL_PATTERN), part.text), len(part.text)), "isolated") if self.use_regex else [part]
        return [p.with_text(p.text.translate(_ASCII_BYTES)) if p.text.isascii() else p.map(_byte_chars_of) for p in pieces]


#: Names of the Unicode standard's scripts, as Java and Python know them (fixed values).
SCRIPTS = (
    "Adlam Ahom Anatolian_Hieroglyphs Arabic Armenian Avestan Balinese Bamum Bassa_Vah Batak Bengali Bhaiksuki Bopomofo Brahmi Braille Buginese Buhid Canadian_Aboriginal Carian "
    "Caucasian_Albanian Chakma Cham Cherokee Common Coptic Cuneiform Cypriot Cyrillic Deseret Devanagari Duployan Egyptian_Hieroglyphs Elbasan Ethiopic Georgian Glagolitic Gothic Grantha Greek "
    "Gujarati Gurmukhi Han Hangul Hanunoo Hatran Hebrew Hiragana Imperial_Aramaic Inherited Inscriptional_Pahlavi Inscriptional_Parthian Javanese Kaithi Kannada Katakana Kayah_Li Kharoshthi "
    "Khmer Khojki Khudawadi Lao Latin Lepcha Limbu Linear_A Linear_B Lisu Lycian Lydian Mahajani Malayalam Mandaic Manichaean Marchen Meetei_Mayek Mende_Kikakui Meroitic_Cursive "
    "Meroitic_Hieroglyphs Miao Modi Mongolian Mro Multani Myanmar Nabataean New_Tai_Lue Newa Nko Ogham Ol_Chiki Old_Hungarian Old_Italic Old_North_Arabian Old_Permic Old_Persian "
    "Old_South_Arabian Old_Turkic Oriya Osage Osmanya Pahawh_Hmong Palmyrene Pau_Cin_Hau Phags_Pa Phoenician Psalter_Pahlavi Rejang Runic Samaritan Saurashtra Sharada Shavian Siddham "
    "SignWriting Sinhala Sora_Sompeng Sundanese Syloti_Nagri Syriac Tagalog Tagbanwa Tai_Le Tai_Tham Tai_Viet Takri Tamil Tangut Telugu Thaana Thai Tibetan Tifinagh Tirhuta Ugaritic Vai "
    "Warang_Citi Yi"
).split()
_HAN = ("Han", "Hiragana", "Katakana")
_LONG_VOWEL = "\u30fc"


@dataclass(frozen=True)
class UnicodeScripts(Splitter):
    """Splits where the script changes; kana and the long-vowel mark count as Han.

    A space joins what stands before it, and so do characters of no script; before the first script they are dropped."""

    def column(self, text: Column) -> Column:
        joined = " " + "".join(rf"[^{''.join(rf'\p{{Is{s}}}' for s in SCRIPTS)}]")
        runs = [rf"[\p{{IsCommon}}&&[^ {_LONG_VOWEL}]][[\p{{IsCommon}}&&[^{_LONG_VOWEL}]]{joined}]*", "".join((f"[{(han := ''.join(rf'\p{{Is{s}}}' for s in _HAN) + _LONG_VOWEL)}]", f"[{han}{joined}]*"))]
        runs += [rf"\p{{Is{s}}}[\p{{Is{s}}}{joined}]*" for s in sorted(SCRIPTS, key=lambda s: s != "Latin") if s not in (*_HAN, "Common")]
        return F.regexp_extract_all(text, F.lit("|".join(runs)), F.lit(0))

    @cached_property
    def _classes(self) -> re.Pattern:
        return _compiled("|".join(rf"(?P<{s}>\p{{Script={s}}})" for s in SCRIPTS))

    def script(self, c: str) -> str | None:
        """A character's script; None for spaces and characters without one."""
        if c == _LONG_VOWEL:
            return "Han"
        found = self._classes.match(c) if c != " " else None
        return found and ("Han" if found.lastgroup in _HAN else found.lastgroup)

    def cut(self, part: Aligned) -> list[Aligned]:
        scripts = [(i, s) for i, c in enumerate(part.text) if (s := self.script(c))]
        edges = [i for k, (i, s) in enumerate(scripts) if not k or scripts[k - 1][1] != s]
        return [part.slice(a, b) for a, b in zip(edges, [*edges[1:], len(part.text)])]


@dataclass(frozen=True)
class FixedLength(Splitter):
    length: int = 5

    def column(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{self.length}}}"), F.lit(0))

    def cut(self, part: Aligned) -> list[Aligned]:
        return [part.slice(i, i + self.length) for i in range(0, len(part.text), self.length)]


@dataclass(frozen=True)
class SplitterSequence(Splitter):
    """Splitters one after the other, each on the pieces of the last."""

    parts: tuple[Splitter, ...]

    def column(self, text: Column) -> Column:
        pieces = F.array(text)
        for s in self.parts:
            pieces = F.flatten(F.transform(pieces, s.column))
        return F.filter(pieces, lambda p: p != "")

    def align(self, parts: list[Aligned]) -> list[Aligned]:
        for s in self.parts:
            parts = s.align(parts)
        return parts


@dataclass(frozen=True)
class CustomSplitter(Splitter):
    """A caller's function from an aligned text to its pieces; it cannot be saved as JSON."""

    function: Callable[[Aligned], list[Aligned]] = field(compare=False)

    def cut(self, part: Aligned) -> list[Aligned]:
        return self.function(part)


_JSON = {
    "Whitespace": Whitespace, "WhitespaceSplit": WhitespaceSplit, "BertPreTokenizer": BertSplitter, "Punctuation": Punctuation, "Digits": Digits,
    "CharDelimiterSplit": CharDelimiterSplit, "Split": Split, "Metaspace": Metaspace, "ByteLevel": ByteLevel, "UnicodeScripts": UnicodeScripts, "FixedLength": FixedLength,
}
_SPELLED = {"removed": "Removed", "isolated": "Isolated", "merged_with_previous": "MergedWithPrevious", "merged_with_next": "MergedWithNext", "contiguous": "Contiguous"}


def splitter_to_json(s: Splitter | None) -> dict | None:
    match s:
        case None:
            return None
        case SplitterSequence(parts):
            return {"type": "Sequence", "pretokenizers": [splitter_to_json(p) for p in parts]}
        case CustomSplitter():
            raise ValueError("a custom pre-tokenizer cannot be saved")
    out = {"type": next(k for k, v in _JSON.items() if v is type(s)), **{k: getattr(s, k) for k in s.__dataclass_fields__}}
    if "pattern" in out:
        out["pattern"] = out["pattern"].to_json()
    if "behavior" in out:
        out["behavior"] = _SPELLED[out["behavior"]]
    return out


def splitter_from_json(j: dict | None) -> Splitter | None:
    if j is None:
        return None
    if j["type"] == "Sequence":
        return SplitterSequence(tuple(splitter_from_json(p) for p in j["pretokenizers"]))
    if j["type"] not in _JSON:
        raise ValueError(f"unknown pre-tokenizer {j['type']}")
    rest = {k: v for k, v in j.items() if k != "type"}
    if "pattern" in rest:
        rest["pattern"] = pattern_from_json(rest["pattern"])
    if "behavior" in rest:
        rest["behavior"] = next((k for k, v in _SPELLED.items() if v.lower() == rest["behavior"].replace("_", "").lower()), rest["behavior"])
    if j["type"] == "Metaspace" and "add_prefix_space" in rest:
        rest.setdefault("prepend_scheme", "always" if rest["add_prefix_space"] else "never")
    cls = _JSON[j["type"]]
    return cls(**{k: v for k, v in rest.items() if k in cls.__dataclass_fields__})
