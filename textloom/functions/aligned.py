"""A text whose characters know which part of the original they came from.

Used inside Arrow batches where offsets into the original are asked for; a
text-only result never needs it.  ``spans`` is None while every character
stands for itself, ``base`` characters further on in the original, so unchanged
texts and their slices cost nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

from pyspark.sql import Column
from pyspark.sql import functions as F

Span = tuple[int, int]
_STOP = itemgetter(1)
BEHAVIORS = ("removed", "isolated", "merged_with_previous", "merged_with_next", "contiguous")


class Aligned:
    __slots__ = ("original", "text", "spans", "base")

    def __init__(self, original: str, text: str | None = None, spans: list[Span] | None = None, base: int = 0):
        self.original, self.text, self.spans, self.base = original, original if text is None else text, spans, base

    def span(self, i: int) -> Span:
        return (self.base + i, self.base + i + 1) if self.spans is None else self.spans[i]

    def all_spans(self) -> list[Span]:
        return [(i, i + 1) for i in range(self.base, self.base + len(self.text))] if self.spans is None else self.spans

    def with_text(self, text: str) -> Aligned:
        """As many other characters, each in the place of one of these."""
        return Aligned(self.original, text, self.spans, self.base)

    def to_original(self, start: int, stop: int) -> Span:
        """Original range of a range of the text; an empty range lies where its neighbour ends."""
        if self.spans is None and (start < stop or not self.base):
            return self.base + start, self.base + (min(stop, len(self.text)) if self.base else stop)
        if start >= stop:
            at = self.span(start - 1)[1] if 0 < start <= len(self.text) else 0
            return at, at
        part = self.spans[start:stop]
        return min(part)[0], max(part, key=_STOP)[1]

    def to_normalized(self, start: int, stop: int) -> Span | None:
        """Range of the text that came from a range of the original, or None."""
        inside = [i for i, (a, b) in enumerate(self.all_spans()) if a >= start and b <= stop and a < b]
        return (inside[0], inside[-1] + 1) if inside else None

    def replaced(self, pieces: Iterable[tuple[str, Span]]) -> Aligned:
        """A new text from (characters, span of each of them)."""
        text, spans = [], []
        for part, span in pieces:
            text.append(part)
            spans += [span] * len(part)
        return Aligned(self.original, "".join(text), spans)

    def filter(self, keep: Callable[[str], bool]) -> Aligned:
        return self.replaced((c, self.span(i)) for i, c in enumerate(self.text) if keep(c))

    def map(self, change: Callable[[str], str]) -> Aligned:
        """Each character becomes any number of characters with its span."""
        changed = [change(c) for c in self.text]
        if all(len(c) == 1 for c in changed):
            return self.with_text("".join(changed))
        return self.replaced((c, self.span(i)) for i, c in enumerate(changed))

    def without(self, chars: set[str]) -> Aligned:
        """The text without some characters."""
        gone = [i for i, c in enumerate(self.text) if c in chars] if chars else []
        if not gone:
            return self
        spans, starts = self.all_spans(), [0, *(i + 1 for i in gone)]
        runs = [(a, b) for a, b in zip(starts, [*gone, len(self.text)]) if a < b]
        return Aligned(self.original, "".join([self.text[a:b] for a, b in runs]), [s for a, b in runs for s in spans[a:b]])

    def lower(self) -> Aligned:
        # only a capital sigma depends on its neighbours, and no character's lower form is empty
        low = self.text.replace("\u03a3", "\u03c3").lower()
        return self.with_text(low) if len(low) == len(self.text) else self.map(str.lower)

    def upper(self) -> Aligned:
        return self.map(str.upper) if not self.text.isascii() else self.with_text(self.text.upper())

    def prepend(self, text: str) -> Aligned:
        if not self.text or not text:
            return self
        first = self.span(0)
        return Aligned(self.original, text + self.text, [first] * len(text) + self.all_spans())

    def append(self, text: str) -> Aligned:
        if not self.text or not text:
            return self
        return Aligned(self.original, self.text + text, self.all_spans() + [self.span(len(self.text) - 1)] * len(text))

    def clear(self) -> Aligned:
        return Aligned(self.original, "", [])

    def slice(self, start: int, stop: int) -> Aligned:
        if self.spans is None and start >= 0:
            return Aligned(self.original, self.text[start:stop], None, self.base + start)
        return Aligned(self.original, self.text[start:stop], self.all_spans()[start:stop])

    def strip(self, left: bool, right: bool, space: str) -> Aligned:
        start = len(self.text) - len(self.text.lstrip(space)) if left else 0
        stop = len(self.text.rstrip(space)) if right else len(self.text)
        return self.slice(start, max(start, stop))

    def replace(self, matches: Iterable[Span], content: str) -> Aligned:
        """Matches become ``content``, whose characters come from the last replaced character."""
        pieces, at = [], 0
        for start, stop in matches:
            pieces += [(c, self.span(i)) for i, c in enumerate(self.text[at:start], at)]
            pieces.append((content, self.span(stop - 1) if stop > start else self.span(max(0, start - 1)) if self.text else (0, 0)))
            at = stop
        pieces += [(c, self.span(i)) for i, c in enumerate(self.text[at:], at)]
        return self.replaced(pieces)

    def normalize(self, form: str) -> Aligned:
        """A Unicode normal form, character by character and mark run by mark run."""
        if unicodedata.is_normalized(form, self.text):
            return self
        text, spans, old, at = [], [], self.all_spans(), 0
        # a cluster of plain ASCII stays as it is
        for run in _NOT_PLAIN.finditer(self.text):
            text.append(self.text[at : run.start()])
            spans += old[at : run.start()]
            for start, stop in _clusters(run[0]):
                part, start, at = run[0][start:stop], run.start() + start, run.start() + stop
                whole = unicodedata.normalize(form, part)
                made = [old[i] for i in range(start, at) for _ in unicodedata.normalize("NFKD" if "K" in form else "NFD", self.text[i])]
                text.append(whole)
                spans += made if len(made) == len(whole) else _composed_spans(whole, made, "K" in form)
        return Aligned(self.original, "".join(text) + self.text[at:], spans + old[at:])

    def split(self, matches: Iterable[tuple[Span, bool]], behavior: str) -> list[Aligned]:
        return [self.slice(a, b) for a, b in split_spans(matches, behavior) if b > a]


_NOT_PLAIN = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")


def _clusters(text: str) -> Iterator[Span]:
    """Runs that normalise on their own: a starter and what may combine with it."""
    start = 0
    for i in range(1, len(text)):
        c = text[i]
        if ord(c) < 0x300 or not (unicodedata.combining(c) or 0x1160 <= ord(c) <= 0x11FF or unicodedata.category(c)[0] == "M"):
            yield start, i
            start = i
    if text:
        yield start, len(text)


def _composed_spans(whole: str, spans: list[Span], compatible: bool) -> list[Span]:
    """Spans of composed characters: each takes the first of the characters it was made from."""
    out, at = [], 0
    for c in whole:
        out.append(spans[min(at, len(spans) - 1)])
        at += len(unicodedata.normalize("NFKD" if compatible else "NFD", c))
    return out


def tiles(found: Iterable[Span], length: int) -> Iterator[tuple[Span, bool]]:
    """Matches and what lies between them, over the whole text."""
    at = 0
    for start, stop in found:
        if start > at:
            yield (at, start), False
        if stop > start:
            yield (start, stop), True
            at = stop
        else:
            at = max(at, start)
    if at < length:
        yield (at, length), False


def split_spans(parts: Iterable[tuple[Span, bool]], behavior: str) -> list[Span]:
    """Pieces of a tiled text under one of the delimiter behaviours."""
    parts = list(parts)
    if behavior == "removed":
        return [span for span, match in parts if not match]
    if behavior == "isolated":
        return [span for span, _ in parts]
    out: list[tuple[Span, bool]] = []
    if behavior == "merged_with_next":
        for (a, b), match in reversed(parts):
            if match and out and not out[-1][1]:
                out[-1] = ((a, out[-1][0][1]), True)
            else:
                out.append(((a, b), match))
        return [span for span, _ in reversed(out)]
    for (a, b), match in parts:
        joins = out and (match == out[-1][1] if behavior == "contiguous" else match and not out[-1][1])
        if joins:
            out[-1] = ((out[-1][0][0], b), match)
        else:
            out.append(((a, b), match))
    return [span for span, _ in out]


def found_by(pattern: re.Pattern, text: str) -> list[Span]:
    return [m.span() for m in pattern.finditer(text)]


def char_slice(text: Column, begin: int, end: int | None = None) -> Column:
    """The characters from ``begin`` to ``end``; negative places count from the text's end."""
    n = F.char_length(text)
    place = lambda i: F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)
    first, stop = place(begin), n if end is None else place(end)
    return text.substr(first + 1, F.greatest(stop - first, F.lit(0)))
