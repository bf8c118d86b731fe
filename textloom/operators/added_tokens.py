"""Added tokens: texts that are tokens of their own, found before the model sees a word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from textloom.functions.aligned import Aligned
from textloom.functions.chars import is_space
from textloom.functions.normalizers import Normalizer
from textloom.operators.models import Model

_WORD = re.compile(r"\w")


@dataclass(frozen=True)
class AddedToken:
    content: str
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = True
    special: bool = False


def special_token(content: str) -> AddedToken:
    return AddedToken(content, normalized=False, special=True)


@dataclass(frozen=True)
class AddedVocabulary:
    """Added tokens with their ids, in order of adding."""

    tokens: tuple[tuple[AddedToken, int], ...] = ()
    encode_special_tokens: bool = False

    def add(self, new: list[AddedToken | str], model: Model) -> AddedVocabulary:
        """With more tokens: one that the model knows keeps its id; empty ones and repeats are left out."""
        held = {t.content: (t, i) for t, i in self.tokens}
        following = max([len(model.vocab), *(i + 1 for _, i in self.tokens)])
        for token in new:
            token = AddedToken(token) if isinstance(token, str) else token
            if not token.content or held.get(token.content, (None,))[0] == token:
                continue
            i = held[token.content][1] if token.content in held else model.token_to_id(token.content)
            if i is None:
                i, following = following, following + 1
            held[token.content] = (token, i)
        return AddedVocabulary(tuple(held.values()), self.encode_special_tokens)

    @cached_property
    def ids(self) -> dict[str, int]:
        return {t.content: i for t, i in self.tokens}

    @cached_property
    def contents(self) -> dict[int, str]:
        return {i: t.content for t, i in self.tokens}

    def decoded_contents(self, normalizer: Normalizer | None) -> dict[int, str]:
        """What each token is decoded as: tokens that are found in normalized text come back normalized."""
        return {i: normalizer.normalize_str(t.content) if t.normalized and normalizer else t.content for t, i in self.tokens}

    @cached_property
    def special_contents(self) -> frozenset[str]:
        return frozenset(t.content for t, _ in self.tokens if t.special)

    @cached_property
    def special_ids(self) -> frozenset[int]:
        return frozenset(i for t, i in self.tokens if t.special)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, *vars(t).values()) for t, i in self.tokens]
        return spark.createDataFrame(rows, "id long, content string, single_word boolean, lstrip boolean, rstrip boolean, normalized boolean, special boolean")

    def _finder(self, normalized: bool, normalizer: Normalizer | None) -> tuple[re.Pattern, dict[str, tuple[AddedToken, int]]] | None:
        known = {}
        for t, i in self.tokens:
            if t.normalized == normalized and not (t.special and self.encode_special_tokens):
                known.setdefault(normalizer.normalize_str(t.content) if normalized and normalizer else t.content, (t, i))
        known.pop("", None)
        if not known:
            return None
        return re.compile("|".join(map(re.escape, sorted(known, key=len, reverse=True)))), known

    def finders(self, normalizer: Normalizer | None) -> list:
        return [self._finder(False, None), self._finder(True, normalizer)]


def found_in(text: str, finder) -> Iterator[tuple[int, int, int]]:
    """Start, end and id of each added token of a text, in order."""
    pattern, known = finder
    at = 0
    for m in pattern.finditer(text):
        (token, i), (start, stop) = known[m[0]], m.span()
        if token.single_word and (start and _WORD.match(text[start - 1]) or stop < len(text) and _WORD.match(text[stop])):
            continue
        if token.lstrip:
            while start > at and is_space(text[start - 1]):
                start -= 1
        if token.rstrip:
            while stop < len(text) and is_space(text[stop]):
                stop += 1
        if start < at:
            continue
        yield start, stop, i
        at = stop


def cut(part: Aligned, finder) -> Iterator[tuple[Aligned, int | None]]:
    """Pieces of a text, those that are added tokens with their id."""
    if finder is None:
        yield part, None
        return
    at = 0
    for start, stop, i in found_in(part.text, finder):
        if start > at:
            yield part.slice(at, start), None
        yield part.slice(start, stop), i
        at = stop
    if at < len(part.text):
        yield part.slice(at, len(part.text)), None
