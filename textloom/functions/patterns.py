"""Patterns that find parts of a text, in Java's dialect for columns and in Python's for Arrow batches."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

from textloom.functions.chars import SPACE_CLASS, quoted

try:
    import regex
except ImportError:  # then \p{..} classes cannot be used inside Arrow batches
    regex = None


@cache
def _compiled(source: str) -> re.Pattern:
    if regex is None:
        return re.compile(source)
    # \s as Unicode White_Space, which leaves out the separators U+001C to U+001F
    out, inside, k = [], False, 0
    while k < len(source):
        c = source[k : k + 2] if source[k] == "\\" else source[k]
        if c == "\\s":
            out.append(SPACE_CLASS if inside else f"[{SPACE_CLASS}]")
        elif c == "\\S" and not inside:
            out.append(f"[^{SPACE_CLASS}]")
        else:
            inside = c == "[" or inside and c != "]"
            out.append(c)
        k += len(c)
    return regex.compile("".join(out), regex.V0)


@dataclass(frozen=True)
class Pattern:
    """A literal text, or a regular expression with Unicode classes.  An empty literal matches nothing."""

    source: str
    is_regex: bool = False

    @property
    def java(self) -> str:
        return f"(?U){self.source}" if self.is_regex else quoted(self.source) if self.source else r"(?!)"

    @property
    def python(self) -> re.Pattern:
        if not self.is_regex:
            return re.compile(re.escape(self.source) if self.source else r"(?!)")
        return _compiled(self.source)

    def to_json(self) -> dict:
        return {"Regex" if self.is_regex else "String": self.source}


def pattern_from_json(j: dict | str) -> Pattern:
    if isinstance(j, str):
        return Pattern(j)
    return Pattern(j["Regex"], True) if "Regex" in j else Pattern(j["String"])
