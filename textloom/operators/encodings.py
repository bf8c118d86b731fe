"""Encodings as columns: truncation, windows, padding, templates and lookups with JVM functions alone.

An encoding is a struct of parallel arrays, see ``ENCODING``; windows cut off
by truncation are kept in ``overflowing``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_INTS = T.ArrayType(T.IntegerType())
PLAIN = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("type_ids", _INTS),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("word_ids", _INTS),
        T.StructField("offsets", T.ArrayType(SPAN)),
        T.StructField("special_tokens_mask", _INTS),
        T.StructField("attention_mask", _INTS),
        T.StructField("sequence_ids", _INTS),
    ]
)
ENCODING = T.StructType([*PLAIN.fields, T.StructField("overflowing", T.ArrayType(PLAIN))])
FIELDS = PLAIN.fieldNames()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed, and written in the plan, once."""
    return F.transform(F.array(value), use)[0]


def _struct(parts: dict[str, Column]) -> Column:
    return F.struct(*[parts[f].cast(PLAIN[f].dataType).alias(f) for f in FIELDS])


def part(encoding: Column, start: Column, length: Column) -> Column:
    """Tokens from ``start`` (from 0) on."""
    return bound(encoding, lambda e: _struct({f: F.slice(e[f], start + 1, length) for f in FIELDS}))


def size(encoding: Column) -> Column:
    return F.size(encoding["ids"])


def windows(n: Column, max_length: int, stride: int = 0, direction: str = "right") -> Column:
    """Start and length of each window over n tokens, the kept one first."""
    if max_length == 0:
        return F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length")), F.struct(F.lit(0).alias("start"), n.alias("length")))
    if stride >= max_length:
        raise ValueError("the stride must be smaller than the length")
    steps = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(max_length - stride))
    steps = F.filter(steps, lambda i: (i == 0) | (i + stride < n))

    def window(i: Column) -> Column:
        length = F.least(n - i, F.lit(max_length))
        start = i if direction == "right" else n - i - length
        return F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"))

    return F.transform(steps, window)


def window_parts(values: Column, max_length: int, stride: int = 0, direction: str = "right") -> Column:
    """The windows of one array, the kept one first; an encoding's other fields need not be built for it."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size(values).cast("int").alias("length")))
    spans = F.when(F.size(values) <= max_length, whole).otherwise(windows(F.size(values), max_length, stride, direction))
    return F.transform(spans, lambda w: F.slice(values, w["start"] + 1, w["length"]))


def truncate(encoding: Column, max_length: int, stride: int = 0, direction: str = "right") -> Column:
    """Keeps ``max_length`` tokens; the other windows become ``overflowing``."""

    def cut(e: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("start"), size(e).cast("int").alias("length")))
        spans = F.when(size(e) <= max_length, whole).otherwise(windows(size(e), max_length, stride, direction))
        return F.transform(spans, lambda w: part(e, w["start"], w["length"]))

    parts = bound(encoding, cut)
    return bound(parts, lambda ws: with_overflow(ws[0], F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0)))))


def with_overflow(encoding: Column, overflowing: Column | None = None) -> Column:
    rest = F.array().cast(T.ArrayType(PLAIN)) if overflowing is None else overflowing
    return bound(encoding, lambda e: F.struct(*[e[f].alias(f) for f in FIELDS], rest.alias("overflowing")))


def pair_lengths(n1: Column, n2: Column, max_length: int, strategy: str = "longest_first") -> tuple[Column, Column]:
    """How many tokens of each of two sequences stay within ``max_length`` together."""
    total, most = n1 + n2, F.lit(max_length)
    over = total - most
    if strategy in ("only_first", "only_second"):
        target = n1 if strategy == "only_first" else n2
        cut = F.when(over <= 0, target).when(target > over, target - over).otherwise(F.raise_error(F.lit("the sequence to truncate is too short")).cast("int"))
        return (cut, n2) if strategy == "only_first" else (n1, cut)
    low, high = F.least(n1, n2), F.greatest(n1, n2)
    high = F.when(low > most, low).otherwise(F.greatest(low, most - low))
    halved = low + high > most
    low2, high2 = F.when(halved, F.lit(max_length // 2)).otherwise(low), F.when(halved, F.lit(max_length // 2 + max_length % 2)).otherwise(high)
    first_low = n1 <= n2
    a, b = F.when(first_low, low2).otherwise(high2), F.when(first_low, high2).otherwise(low2)
    return F.when(over <= 0, n1).otherwise(a), F.when(over <= 0, n2).otherwise(b)


def padded_length(length: Column, multiple_of: int | None) -> Column:
    if not multiple_of:
        return length
    return (F.ceil(length / F.lit(multiple_of)) * multiple_of).cast("int")


def pad(encoding: Column, length: Column, pad_id: int = 0, pad_type_id: int = 0, pad_token: str = "[PAD]", direction: str = "right") -> Column:
    """Fills an encoding, without its overflow, up to ``length``."""
    fill = {
        "ids": F.lit(pad_id),
        "type_ids": F.lit(pad_type_id),
        "tokens": F.lit(pad_token),
        "word_ids": F.lit(None).cast("int"),
        "offsets": F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")),
        "special_tokens_mask": F.lit(1),
        "attention_mask": F.lit(0),
        "sequence_ids": F.lit(None).cast("int"),
    }

    def filled(e: Column, f: str) -> Column:
        more = F.array_repeat(fill[f], F.greatest(length - size(e), F.lit(0))).cast(PLAIN[f].dataType)
        return F.concat(e[f], more) if direction == "right" else F.concat(more, e[f])

    return bound(encoding, lambda e: _struct({f: filled(e, f) for f in FIELDS}))


def pad_all(encoding: Column, length: Column, **how) -> Column:
    """Pads an encoding and the windows in its overflow."""
    return bound(encoding, lambda e: with_overflow(pad(e, length, **how), F.transform(e["overflowing"], lambda w: pad(w, length, **how))))


def pad_table(df: DataFrame, column: str, length: int | None = None, multiple_of: int | None = None, batch_by: list[str] | None = None, **how) -> DataFrame:
    """Pads a column to a fixed length, or to the longest of its batch (all rows without ``batch_by``)."""
    n = size(F.col(column))
    if length is not None:
        target = F.lit(length)
    elif batch_by:
        target = F.max(n).over(Window.partitionBy(*batch_by))
    else:
        # one number, found by partial maxima
        target = F.lit(df.agg(F.max(n)).first()[0] or 0)
    padded = df.withColumn("__length", padded_length(target, multiple_of))
    return padded.withColumn(column, F.when(F.col(column).isNotNull(), pad_all(F.col(column), F.col("__length"), **how))).drop("__length")


@dataclass(frozen=True)
class Piece:
    """A part of a template: a sequence ('A' or 'B') or a special token, with the type of its tokens."""

    what: str
    type_id: int = 0
    special: bool = False


def parse_piece(text: str) -> Piece:
    """``$A``, ``$B``, ``$``, ``$1``, ``$B:2``, ``$:1``, ``[CLS]`` or ``[CLS]:0``."""
    if not text.startswith("$"):
        found = re.fullmatch(r"(.+?)(?::(\d+))?", text, re.S)
        if not found:
            raise ValueError(f"{text!r} is no part of a template")
        return Piece(found[1], int(found[2] or 0), True)
    found = re.fullmatch(r"\$(?:([AaBb])?(?::(\d+))?|(\d+))", text)
    if not found or text.endswith(":"):
        raise ValueError(f"{text!r} is no part of a template")
    return Piece((found[1] or "A").upper(), int(found[2] or found[3] or 0))


@dataclass(frozen=True)
class Template:
    """What surrounds one sequence, or two; ``special_tokens`` gives each special's ids and tokens."""

    single: tuple[Piece, ...]
    pair: tuple[Piece, ...]
    special_tokens: tuple[tuple[str, tuple[int, ...], tuple[str, ...]], ...] = ()

    def __post_init__(self) -> None:
        known = {name for name, _, _ in self.special_tokens}
        for p in (*self.single, *self.pair):
            if p.special and p.what not in known:
                raise ValueError(f"the template needs the special token {p.what}")
        if not {"A", "B"} <= {p.what for p in self.pair if not p.special}:
            raise ValueError("the pair's template must use both sequences")

    def added(self, is_pair: bool) -> int:
        sizes = {name: len(ids) for name, ids, _ in self.special_tokens}
        return sum(sizes[p.what] for p in (self.pair if is_pair else self.single) if p.special)

    def apply(self, first: Column, second: Column | None = None, add_special_tokens: bool = True) -> Column:
        specials = {name: (ids, tokens) for name, ids, tokens in self.special_tokens}
        parts = []
        for p in self.single if second is None else self.pair:
            if not p.special:
                parts.append(sequence(second if p.what == "B" else first, p.type_id, int(p.what == "B")))
            elif add_special_tokens:
                parts.append(special(*specials[p.what], p.type_id))
        return concat(parts)


def template(single: str, pair: str = "$A:0 $B:1", special_tokens: dict[str, int] | None = None) -> Template:
    """From texts such as ``[CLS] $A [SEP]``."""
    known = tuple((t, (i,), (t,)) for t, i in (special_tokens or {}).items())
    return Template(tuple(map(parse_piece, single.split())), tuple(map(parse_piece, pair.split())), known)


def sequence(encoding: Column, type_id: int, sequence_id: int) -> Column:

    def typed(e: Column) -> Column:
        kept = {f: e[f] for f in FIELDS}
        return _struct(kept | {"type_ids": F.array_repeat(F.lit(type_id), size(e)), "sequence_ids": F.array_repeat(F.lit(sequence_id), size(e))})

    return bound(encoding, typed)


def special(ids: tuple[int, ...], tokens: tuple[str, ...], type_id: int) -> Column:
    n = len(ids)
    none, zero = F.lit(None).cast("int"), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    same = lambda c: F.array(*[c] * n)
    return _struct(
        {
            "ids": F.array(*map(F.lit, ids)), "type_ids": same(F.lit(type_id)), "tokens": F.array(*map(F.lit, tokens)), "word_ids": same(none), "offsets": same(zero),
            "special_tokens_mask": same(F.lit(1)), "attention_mask": same(F.lit(1)), "sequence_ids": same(none),
        }
    )


def concat(parts: list[Column]) -> Column:
    return bound(F.array(*parts), lambda all_parts: _struct({f: F.flatten(_field(all_parts, f)) for f in FIELDS}))


def _field(parts: Column, f: str) -> Column:
    return F.transform(parts, lambda p: p[f])


def bert_template(sep: tuple[str, int] = ("[SEP]", 102), cls: tuple[str, int] = ("[CLS]", 101)) -> Template:
    return template(f"{cls[0]} $A {sep[0]}", f"{cls[0]} $A:0 {sep[0]} $B:1 {sep[0]}:1", {cls[0]: cls[1], sep[0]: sep[1]})


def roberta_template(sep: tuple[str, int] = ("</s>", 2), cls: tuple[str, int] = ("<s>", 0)) -> Template:
    return template(f"{cls[0]} $A {sep[0]}", f"{cls[0]} $A {sep[0]} {sep[0]} $B {sep[0]}", {cls[0]: cls[1], sep[0]: sep[1]})


def merge(encodings: list[Column], growing_offsets: bool = True) -> Column:
    """Encodings one after the other; growing offsets go on where the one before ended."""
    if not growing_offsets:
        return concat(encodings)

    # bound, as what a lambda refers to is computed anew for each item
    def moved(given: Column) -> Column:
        out, at = [], F.lit(0)
        for k in range(len(encodings)):
            e = given[f"_{k}"]
            out.append(bound(at, _moved_by(e)))
            at = at + F.coalesce(F.try_element_at(e["offsets"], F.lit(-1))["end"], F.lit(0))
        return concat(out)

    return bound(F.struct(*[e.alias(f"_{k}") for k, e in enumerate(encodings)]), moved)


def _moved_by(encoding: Column) -> Callable[[Column], Column]:
    """The encoding with offsets moved, as a function of how far."""
    return lambda by: _struct({f: _moved(encoding, by) if f == "offsets" else encoding[f] for f in FIELDS})


def merge_overflowing(encodings: list[Column], growing_offsets: bool = True) -> Column:
    """As ``merge``, of encodings with ``overflowing``: each window of one meets the others' kept parts and each of their windows.

    Windows of the earlier encoding come first, each with the later one's kept part and then with its windows; after
    those the earlier one's kept part with the later one's windows."""

    def both(a: Column, b: Column) -> Column:
        joined = lambda x, y: merge([x, y], growing_offsets)
        of_b = lambda x: F.transform(b["overflowing"], lambda y: joined(x, y))
        crossed = F.flatten(F.transform(a["overflowing"], lambda x: F.concat(F.array(joined(x, b)), of_b(x))))
        return with_overflow(joined(a, b), F.concat(crossed, of_b(a)))

    return reduce(lambda x, y: bound(x, lambda a: bound(y, lambda b: both(a, b))), encodings)


def _moved(encoding: Column, by: Column) -> Column:
    return F.transform(encoding["offsets"], lambda o: F.struct((o["start"] + by).alias("start"), (o["end"] + by).alias("end")))


def trim_offsets(encoding: Column, add_prefix_space: bool = True) -> Column:
    """Offsets of byte-level tokens without the space that they start or end with."""
    space = chr(0x0120)

    def trimmed(o: Column, token: Column, i: Column) -> Column:
        lead = F.length(token) - F.length(F.regexp_replace(token, rf"^[{space}\s]+", ""))
        trail = F.length(token) - F.length(F.regexp_replace(token, rf"[{space}\s]+$", ""))
        if add_prefix_space:
            lead = F.when((lead > 0) & ((i == 0) | (o["start"] == 0)), lead - 1).otherwise(lead)
        start = F.least(o["start"] + lead, o["end"])
        return F.struct(start.alias("start"), F.greatest(F.when(o["end"] >= trail, o["end"] - trail).otherwise(0), start).alias("end"))

    def all_trimmed(e: Column) -> Column:
        zipped = F.arrays_zip(e["offsets"].alias("o"), e["tokens"].alias("t"))
        return _struct({f: F.transform(zipped, lambda z, i: trimmed(z["o"], z["t"], i)) if f == "offsets" else e[f] for f in FIELDS})

    return bound(encoding, all_trimmed)


def n_sequences(encoding: Column) -> Column:
    return F.greatest(F.size(F.array_distinct(F.array_compact(encoding["sequence_ids"]))), F.lit(1))


def word_to_tokens(encoding: Column, word: Column | int, sequence_id: int = 0) -> Column:
    """First and last + 1 token of a word, or null."""
    w = word if isinstance(word, Column) else F.lit(word)
    held = F.struct(size(encoding).alias("n"), encoding["word_ids"].alias("words"), encoding["sequence_ids"].alias("sequences"), w.alias("word"))
    own = bound(held, lambda e: F.when(e["n"] > 0, F.filter(F.sequence(F.lit(0), e["n"] - 1), lambda i: (F.get(e["words"], i) == e["word"]) & (F.get(e["sequences"], i) == sequence_id))))
    return bound(own, lambda o: F.when(F.size(o) > 0, F.struct(o[0].alias("start"), (F.element_at(o, -1) + 1).alias("end"))))


def word_to_chars(encoding: Column, word: Column | int, sequence_id: int = 0) -> Column:
    at = word_to_tokens(encoding, word, sequence_id)
    return F.when(at.isNotNull(), F.struct(F.get(encoding["offsets"], at["start"])["start"].alias("start"), F.get(encoding["offsets"], at["end"] - 1)["end"].alias("end")))


def token_to_chars(encoding: Column, token: Column | int) -> Column:
    return F.get(encoding["offsets"], token if isinstance(token, Column) else F.lit(token))


def token_to_word(encoding: Column, token: Column | int) -> Column:
    return F.get(encoding["word_ids"], token if isinstance(token, Column) else F.lit(token))


def words(encoding: Column) -> Column:
    """An older name of the word ids."""
    return encoding["word_ids"]


def token_to_sequence(encoding: Column, token: Column | int) -> Column:
    return F.get(encoding["sequence_ids"], token if isinstance(token, Column) else F.lit(token))


def char_to_token(encoding: Column, char: Column | int, sequence_id: int = 0) -> Column:
    """The first token whose offsets hold a character, or null."""
    c = char if isinstance(char, Column) else F.lit(char)

    # bound, as what a lambda refers to is computed anew for each item
    held = F.struct(encoding["offsets"].alias("offsets"), encoding["sequence_ids"].alias("sequences"), c.alias("c"))

    def first(e: Column) -> Column:
        zipped = F.zip_with(e["offsets"], e["sequences"], lambda o, s: (o["start"] <= e["c"]) & (e["c"] < o["end"]) & (s == sequence_id))
        return F.nullif(F.coalesce(F.array_position(zipped, F.lit(True)), F.lit(0)), F.lit(0))

    return (bound(held, first) - 1).cast("int")


def char_to_word(encoding: Column, char: Column | int, sequence_id: int = 0) -> Column:
    return token_to_word(encoding, char_to_token(encoding, char, sequence_id))


def from_tokens(tokens: Column, type_id: int = 0) -> Column:
    """An encoding of an array of structs (id, value, start, end)."""

    def of(ts: Column) -> Column:
        n = F.size(ts)
        return _struct(
            {
                "ids": ts["id"], "type_ids": F.array_repeat(F.lit(type_id), n), "tokens": ts["value"],
                "word_ids": F.array_repeat(F.lit(None).cast("int"), n), "offsets": F.transform(ts, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))),
                "special_tokens_mask": F.array_repeat(F.lit(0), n), "attention_mask": F.array_repeat(F.lit(1), n), "sequence_ids": F.array_repeat(F.lit(0), n),
            }
        )

    return bound(tokens, of)


def covered(text: Column, encoding: Column) -> Column:
    """What each token's offsets cover of the text, in one pass over it."""

    def each(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        spans = zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist())
        return pa.array([None if t is None or a is None else [t[x:y] for x, y in zip(a, b)] for t, a, b in spans], pa.list_(pa.string()))

    each.__annotations__ = {"texts": pa.Array, "starts": pa.Array, "ends": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "array<string>")(text, encoding["offsets"]["start"], encoding["offsets"]["end"])


def token_rows(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """A row for each token: the kept columns, pos, id, token, word, start, end."""
    e = F.col(column)
    zipped = F.arrays_zip(e["ids"].alias("id"), e["tokens"].alias("token"), e["word_ids"].alias("word"), e["offsets"].alias("span"))
    rows = df.select(*keep, F.posexplode(zipped).alias("pos", "t"))
    return rows.select(*keep, "pos", "t.id", "t.token", "t.word", F.col("t.span.start").alias("start"), F.col("t.span.end").alias("end"))

