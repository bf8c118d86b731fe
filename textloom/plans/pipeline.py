"""Pipelines: a text column to encodings, and ids back to text.

A pipeline is an immutable description.  ``encode`` runs added tokens,
normalizer, split and model once per row in Arrow batches, where offsets need
them together; ``encode_ids`` leaves normalizing and splitting to the JVM.
Truncation, special tokens and padding are column expressions.
"""

from __future__ import annotations

import json
import warnings
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.aligned import Aligned
from textloom.functions.batches import slices
from textloom.functions.normalizers import Normalizer, normalizer_from_json, normalizer_to_json
from textloom.functions.splitters import Splitter, splitter_from_json, splitter_to_json
from textloom.operators import encodings as E
from textloom.operators.added_tokens import AddedToken, AddedVocabulary, cut, found_in
from textloom.operators.decoders import Decoder, decoder_from_json, decoder_to_json
from textloom.operators.models import Bpe, Model, Remembering, Unigram, WordLevel, WordPiece, ids_of_lists
from textloom.operators.processors import Processor, processor_from_json, processor_to_json


@dataclass(frozen=True)
class Truncation:
    max_length: int = 512
    stride: int = 0
    strategy: str = "longest_first"
    direction: str = "right"


@dataclass(frozen=True)
class Padding:
    """To ``length``, or to the longest of a batch if there is none."""

    length: int | None = None
    direction: str = "right"
    pad_to_multiple_of: int | None = None
    pad_id: int = 0
    pad_type_id: int = 0
    pad_token: str = "[PAD]"


#: What the Arrow batches give for one sequence.
_RAW = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("word_ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])
_RAW_ARROW = pa.struct([("ids", pa.list_(pa.int64())), ("tokens", pa.list_(pa.string())), ("word_ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


class _Made:
    """Columns of the tokens of a batch's texts, without an object for each token."""

    def __init__(self):
        self.ids, self.tokens, self.word_ids, self.starts, self.stops, self.ends = array("q"), [], array("i"), array("i"), array("i"), array("i", [0])

    def add(self, id_: int, token: str, word: int, start: int, stop: int) -> None:
        self.ids.append(id_)
        self.tokens.append(token)
        self.word_ids.append(word)
        self.starts.append(start)
        self.stops.append(stop)

    def add_words(self, ids: list[int], tokens: list[str], word: int, starts: list[int], stops: list[int]) -> None:
        """A token for each word."""
        self.ids.extend(ids)
        self.tokens += tokens
        self.word_ids.extend(range(word, word + len(ids)))
        self.starts.extend(starts)
        self.stops.extend(stops)

    def end_row(self) -> None:
        self.ends.append(len(self.ids))

    def array(self, missing: pa.Array) -> pa.Array:
        ends = pa.array(np.frombuffer(self.ends, np.int32))
        values = [pa.array(self.tokens, pa.string()) if isinstance(v, list) else pa.array(np.frombuffer(v, v.typecode)) for v in (self.ids, self.tokens, self.word_ids, self.starts, self.stops)]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, v) for v in values], fields=list(_RAW_ARROW), mask=missing)


@dataclass(frozen=True)
class TextPipeline:
    model: Model
    normalizer: Normalizer | None = None
    splitter: Splitter | None = None
    processor: Processor | None = None
    decoder: Decoder | None = None
    added: AddedVocabulary = field(default_factory=AddedVocabulary)
    truncation: Truncation | None = None
    padding: Padding | None = None

    def __post_init__(self) -> None:
        t = self.truncation
        if t and t.max_length:
            room = t.max_length - self.added_tokens(False)
            if room < 0 or t.stride >= max(room, 1):
                raise ValueError("the stride must be smaller than the length that special tokens leave")

    def with_(self, **parts) -> TextPipeline:
        return replace(self, **parts)

    def with_added_tokens(self, tokens: list[AddedToken | str]) -> TextPipeline:
        return replace(self, added=self.added.add(tokens, self.model))

    def with_special_tokens(self, tokens: list[str]) -> TextPipeline:
        return self.with_added_tokens([AddedToken(t, normalized=False, special=True) for t in tokens])

    # -- vocabulary

    def token_to_id(self, token: str) -> int | None:
        return self.added.ids.get(token, self.model.token_to_id(token))

    def id_to_token(self, i: int) -> str | None:
        return self.added.contents.get(i) or self.model.id_to_token(i)

    def vocab(self, with_added_tokens: bool = True) -> dict[str, int]:
        return {**self.model.vocab, **(self.added.ids if with_added_tokens else {})}

    def vocab_size(self, with_added_tokens: bool = True) -> int:
        return len(self.vocab(with_added_tokens))

    def added_tokens(self, is_pair: bool) -> int:
        return self.processor.added_tokens(is_pair) if self.processor else 0

    # -- encoding

    def _kernel(self) -> Remembering:
        return Remembering(self.model)

    def _parts(self, text: str, finders: list) -> Iterator[tuple[Aligned, int | None]]:
        """Normalized parts that the splitter is to cut, and added tokens with their id, in order."""
        raw, normalized = finders
        for piece, found in cut(Aligned(text), raw):
            if found is not None:
                yield piece, found
            else:
                yield from cut(self.normalizer.align(piece) if self.normalizer else piece, normalized)

    def _words(self, text: str, finders: list) -> Iterator[tuple[Aligned, int | None]]:
        """The words that the model is to read, and added tokens with their id, in order."""
        for part, i in self._parts(text, finders):
            if i is not None:
                yield part, i
            else:
                yield from ((w, None) for w in self._cut(part))

    def _cut(self, part: Aligned) -> list[Aligned]:
        return [w for w in (self.splitter.align([part]) if self.splitter else [part]) if w.text]

    def _add_tokens(self, text: str, made: _Made, model: Remembering, finders: list) -> None:
        """All tokens of one text, put into columns; where a part is as it was in the text, its words are spans of it."""
        tokenize, k = model.tokenize, 0
        for part, i in self._parts(text, finders):
            if i is not None:
                made.add(i, self.added.contents[i], k, *part.to_original(0, len(part.text)))
                k += 1
                continue
            spans = self.splitter.spans(part.text) if self.splitter and part.spans is None else None
            if spans is None:
                for w in self._cut(part):
                    for t in tokenize(w.text):
                        made.add(t.id, t.value, k, *w.to_original(t.start, t.end))
                    k += 1
                continue
            base, whole = part.base, part.text
            if (known := model.model.of_whole_words([whole[a:b] for a, b in spans])) is not None:
                made.add_words(*known, k, [base + a for a, _ in spans], [base + b for _, b in spans])
                k += len(spans)
                continue
            for a, b in spans:
                for id_, value, start, end in tokenize(whole[a:b]):
                    if start < end <= b - a:
                        made.add(id_, value, k, base + a + start, base + a + end)
                    else:
                        made.add(id_, value, k, *part.slice(a, b).to_original(start, end))
                k += 1

    def _in_place(self, text: str, finders: list) -> tuple[str, list[tuple[int, int, int]]] | None:
        """The normalized text, and start, end and id of its added tokens; None if normalizing moves a character."""
        raw, normalized = finders
        parts, tokens, at = [], [], 0
        for start, stop, i in [*(found_in(text, raw) if raw else ()), (len(text), len(text), None)]:
            if start > at or raw is None:
                part = Aligned(text, text[at:start], None, at)
                part = self.normalizer.align(part) if self.normalizer else part
                if part.spans is not None or part.base != at or len(part.text) != start - at:
                    return None
                parts.append(part.text)
                if normalized:
                    tokens += [(at + a, at + b, k) for a, b, k in found_in(part.text, normalized)]
            if i is not None:
                parts.append(text[start:stop])
                tokens.append((start, stop, i))
            at = stop
        return "".join(parts), tokens

    def _texts_at_once(self, texts: pa.Array, model: Model, finders: list) -> tuple[pa.Array, list[int]] | None:
        """All tokens of a batch's texts, whose words are cut in arrays and looked up once each, and the rows left empty
        because normalizing moves characters; None if words are more than runs of characters, or tokens than whole words."""
        if model.of_whole_words([]) is None or self.splitter and self.splitter.gaps(np.zeros(0, np.uint32)) is None:
            return None
        parts, found, left, lengths, base = [], [], [], [], 0
        for row, text in enumerate(texts.to_pylist()):
            made = self._in_place(text, finders) if text is not None else ("", [])
            if made is None:
                left.append(row)
                made = "", []
            parts.append(made[0])
            lengths.append(len(made[0]))
            found += [(base + a, base + b, i) for a, b, i in made[1]]
            base += lengths[-1]
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        text_ends = np.cumsum(lengths, dtype=np.int64)
        text_starts = text_ends - lengths
        added = np.array(found, np.int64).reshape(-1, 3)
        steps = np.zeros(base + 1, np.int8)
        steps[added[:, 0]] += 1
        steps[added[:, 1]] -= 1
        kept = np.cumsum(steps[:-1], dtype=np.int8) == 0
        if self.splitter:
            kept &= ~self.splitter.gaps(codes)
        # a word begins after a gap, an added token or another text
        breaks = np.zeros(base + 1, bool)
        breaks[text_starts] = breaks[text_ends] = True
        starts = np.flatnonzero(kept & (breaks[:-1] | ~np.r_[False, kept[:-1]]))
        stops = np.flatnonzero(kept & (breaks[1:] | ~np.r_[kept[1:], False])) + 1
        chars = codes[kept]
        data, ends = chars.tobytes().decode("utf-32-le").encode(), np.cumsum(stops - starts)
        if len(data) > len(chars):
            ends = np.cumsum(1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF))[ends - 1]
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        ids, tokens = model.of_whole_words(words.dictionary.to_pylist())
        more, which = np.unique(added[:, 2], return_inverse=True)
        which = np.r_[words.indices.to_numpy(zero_copy_only=False), len(ids) + which]
        starts, stops = np.r_[starts, added[:, 0]], np.r_[stops, added[:, 1]]
        order = np.argsort(starts, kind="stable")
        which, starts, stops = which[order], starts[order], stops[order]
        row_ends = np.r_[0, np.searchsorted(starts, text_ends)]
        counts = np.diff(row_ends)
        moved = np.repeat(text_starts, counts)
        values = [
            pa.array(np.r_[np.array(ids, np.int64), more][which]),
            pa.array([*tokens, *(self.added.contents[i] for i in more.tolist())], pa.string()).take(pa.array(which)),
            *(pa.array(v.astype(np.int32)) for v in (np.arange(len(which)) - np.repeat(row_ends[:-1], counts), starts - moved, stops - moved)),
        ]
        row_ends = pa.array(row_ends.astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(row_ends, v) for v in values], fields=list(_RAW_ARROW), mask=texts.is_null()), left

    def _of_texts(self, texts: pa.Array, kernel: Remembering, finders: list) -> pa.Array:
        """The struct of what the model gives for each text of a batch."""

        def one_by_one(some: pa.Array) -> pa.Array:
            made = _Made()
            for text in some.to_pylist():
                if text is not None:
                    self._add_tokens(text, made, kernel, finders)
                made.end_row()
            return made.array(some.is_null())

        if (at_once := self._texts_at_once(texts, kernel.model, finders)) is None:
            return one_by_one(texts)
        made, left = at_once
        if not left:
            return made
        at = np.arange(len(texts))
        at[left] = len(texts) + np.arange(len(left))
        return pa.concat_arrays([made, one_by_one(texts.take(pa.array(left)))]).take(pa.array(at))

    def tokens_of(self, text: str, kernel: Remembering | None = None, finders: list | None = None, most: int | None = None, direction: str = "right") -> list[tuple[int, str, int, int, int]]:
        """(id, token, word, start, end) of one text, in characters of the original.

        With ``most``, words beyond those that give so many tokens are not tokenized; from the end if the direction is left."""
        model = kernel or self._kernel()
        words: Iterable[tuple[Aligned, int | None]] = self._words(text, finders or self.added.finders(self.normalizer))
        if most is not None and direction == "left":
            words = reversed(list(words))
        found, n = [], 0
        for w, i in words:
            if most is not None and n >= most:
                break
            found.append([(i, self.added.contents[i], *w.to_original(0, len(w.text)))] if i is not None else [(t.id, t.value, *w.to_original(t.start, t.end)) for t in model.tokenize(w.text)])
            n += len(found[-1])
        if most is not None and direction == "left":
            found.reverse()
        return [(i, token, k, a, b) for k, word in enumerate(found) for i, token, a, b in word]

    def _ids_of_texts(self) -> Callable[[str], Iterator[Sequence[int]]]:
        """A function from a text to the ids of each of its words and added tokens, in order; frequent words are kept."""
        kernel, finders = self._kernel(), self.added.finders(self.normalizer)
        return lambda text: ((i,) if i is not None else kernel.ids(w.text) for w, i in self._words(text, finders))

    def _raw(self, df: DataFrame, columns: dict[str, str], offset_type: str, limits: dict[str, int | None]) -> DataFrame:
        """Adds, for each column of texts or of words, the struct of what the model gives; of a text no more words than its limit needs."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        given = {c: dict(df.dtypes)[c] for c in columns}
        plain = {c: offset_type == "char" and limits[c] is None and kind == "string" for c, kind in given.items()}

        def rows_of(value, kernel: Remembering, finders: list, most: int | None) -> list[tuple[int, str, int, int, int]]:
            pipe = shared.value
            if isinstance(value, list):  # words: offsets start again in each
                return [(i, t, k, a, b) for k, w in enumerate(value) for i, t, _, a, b in _offsets(pipe.tokens_of(w or "", kernel, finders), w or "", offset_type)]
            return _offsets(pipe.tokens_of(value, kernel, finders, most, pipe.truncation.direction if most is not None else "right"), value, offset_type)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kernel, finders = shared.value._kernel(), shared.value.added.finders(shared.value.normalizer)
            for whole in batches:
                for batch in slices(whole, whole.select(list(columns)).columns):
                    made = [shared.value._of_texts(batch.column(c), kernel, finders) if plain[c] else _raw_array([None if v is None else rows_of(v, kernel, finders, limits[c]) for v in batch.column(c).to_pylist()]) for c in columns]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *columns.values()])

        if bad := [c for c, kind in given.items() if kind not in ("string", "array<string>")]:
            raise ValueError(f"columns {bad} hold neither texts nor words")
        return df.mapInArrow(each, T.StructType([*df.schema.fields, *(T.StructField(n, _RAW) for n in columns.values())]))

    def encode(self, df: DataFrame, text_col: str = "text", pair_col: str | None = None, encoding_col: str = "encoding", add_special_tokens: bool = True, offset_type: str = "char", batch_by: list[str] | None = None, overflow: bool = True) -> DataFrame:
        """Adds an encoding (see ``encodings.ENCODING``).  Select and filter before: only then does the scan profit.

        A null text has a null encoding; a row with a null pair is encoded as a single text.  Without ``overflow`` a
        pipeline that truncates stops tokenizing a text once it has what is kept, and no windows are given."""
        if offset_type not in ("char", "byte", "none"):
            raise ValueError("offsets are in char, byte or none")
        columns = {text_col: "__first"} | ({pair_col: "__second"} if pair_col else {})
        t = self.truncation
        most = t.max_length if t and not overflow else None
        limits = {c: None if name == "__first" and t and t.strategy == "only_second" else most for c, name in columns.items()}
        raw = self._raw(df, columns, offset_type, limits)
        first, second = _encoding(F.col("__first"), 0), _encoding(F.col("__second"), 1) if pair_col else None
        raw = raw.withColumn("__a", first)
        if pair_col:
            raw = raw.withColumn("__b", second)
        single = self._finished(F.col("__a"), None, add_special_tokens)
        made = single if not pair_col else F.when(F.col("__second").isNull(), single).otherwise(self._finished(F.col("__a"), F.col("__b"), add_special_tokens))
        made = made if overflow else E.with_overflow(made)
        out = raw.withColumn(encoding_col, F.when(F.col("__first").isNotNull(), made)).drop("__first", "__second", "__a", "__b")
        p = self.padding
        if p:
            how = {"pad_id": p.pad_id, "pad_type_id": p.pad_type_id, "pad_token": p.pad_token, "direction": p.direction}
            out = E.pad_table(out, encoding_col, p.length, p.pad_to_multiple_of, batch_by, **how)
        return out

    def _finished(self, first: Column, second: Column | None, add_special_tokens: bool) -> Column:
        """Truncates, and puts special tokens around what is kept and around every window cut off."""
        processor, t = self.processor or Processor(), self.truncation
        if not t:
            return E.with_overflow(processor.apply(first, second, add_special_tokens))
        room = t.max_length - (processor.added_tokens(second is not None) if add_special_tokens else 0)
        if room < 0:
            raise ValueError("special tokens need more than the length")
        special = lambda a, b=None: processor.apply(a, b, add_special_tokens)
        if second is None:
            if t.strategy == "only_second":
                raise ValueError("there is no second sequence to truncate")
            cut = E.truncate(first, room, t.stride, t.direction)
            return E.bound(cut, lambda c: E.with_overflow(special(c), F.transform(c["overflowing"], lambda w: special(w))))

        def both(x: Column, y: Column) -> Column:
            n1, n2 = E.pair_lengths(E.size(x), E.size(y), room, t.strategy)
            return E.bound(F.struct(n1.cast("int").alias("x"), n2.cast("int").alias("y")), lambda n: truncated(x, y, n["x"], n["y"]))

        def truncated(x: Column, y: Column, n1: Column, n2: Column) -> Column:
            kept = lambda e, n: E.part(e, F.lit(0) if t.direction == "right" else E.size(e) - n, n)

            def with_rest(a: Column, b: Column) -> Column:
                # windows over what was cut off of either sequence meet the other's kept part
                over = F.concat(F.transform(_windows(x, n1, t), lambda w: special(w, b)), F.transform(_windows(y, n2, t), lambda w: special(a, w)))
                return E.with_overflow(special(a, b), over)

            return E.bound(kept(x, n1), lambda a: E.bound(kept(y, n2), lambda b: with_rest(a, b)))

        return E.bound(first, lambda x: E.bound(second, lambda y: both(x, y)))

    def encode_ids(self, df: DataFrame, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
        """Adds the ids alone, without special tokens: normalized and split in the JVM where there are no added tokens."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        if self.added.tokens:

            def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                ids_of = shared.value._ids_of_texts()
                for whole in batches:
                    for texts in slices(whole, [whole]):
                        flat, ends = array("q"), [0]
                        for text in texts.to_pylist():
                            for ids in ids_of(text or ""):
                                flat.extend(ids)
                            ends.append(len(flat))
                        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int64)), mask=texts.is_null())

            found.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
            return df.withColumn(ids_col, F.arrow_udf(found, "array<long>")(F.col(text_col)))
        text = self.normalizer.column(F.col(text_col)) if self.normalizer else F.col(text_col)
        words = self.splitter.column(text) if self.splitter else F.filter(F.array(text), lambda w: w != "")

        def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            kernel = shared.value._kernel()
            for whole in batches:
                for lists in slices(whole, [whole]):
                    yield ids_of_lists(lists, kernel)

        each.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return df.withColumn(ids_col, F.when(F.col(text_col).isNotNull(), F.arrow_udf(each, "array<long>")(words)))

    # -- decoding

    @cached_property
    def _spoken(self) -> dict[int, str]:
        """The texts that ids are decoded as."""
        return {**self.model._by_id, **self.added.decoded_contents(self.normalizer)}

    @cached_property
    def _spoken_but_special(self) -> dict[int, str]:
        return {i: t for i, t in self._spoken.items() if t not in self.added.special_contents}

    def _names(self, skip_special_tokens: bool) -> dict[int, str]:
        return self._spoken_but_special if skip_special_tokens else self._spoken

    def decode(self, df: DataFrame, ids_col: str = "ids", text_col: str = "text", skip_special_tokens: bool = True) -> DataFrame:
        """Adds the text of an array of ids; ids that are no token are left out."""
        names = self._names(skip_special_tokens)
        shared = df.sparkSession.sparkContext.broadcast((self.decoder, names))

        def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            decoder, known = shared.value
            texts_of = decoder.of_lists(known) if decoder else lambda rows: [None if r is None else " ".join([known[i] for i in r if i in known]) for r in rows.to_pylist()]
            for whole in batches:
                for rows in slices(whole, [whole]):
                    yield pa.array(texts_of(rows), pa.string())

        each.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return df.withColumn(text_col, F.arrow_udf(each, "string")(F.col(ids_col)))

    @cached_property
    def _speakers(self) -> dict[bool, Callable[[list[int]], str]]:
        return {skip: self.decoder.of_ids(self._names(skip)) for skip in (False, True)} if self.decoder else {}

    def decode_local(self, ids: list[int], skip_special_tokens: bool = True) -> str:
        """The text of one list of ids."""
        if self.decoder:
            return self._speakers[skip_special_tokens](ids)
        names = self._names(skip_special_tokens)
        return " ".join([names[i] for i in ids if i in names])

    # -- JSON

    def to_json(self, pretty: bool = False) -> str:
        t, p = self.truncation, self.padding
        spelled = {"longest_first": "LongestFirst", "only_first": "OnlyFirst", "only_second": "OnlySecond"}
        j = {
            "version": "1.0",
            "truncation": t and {"direction": t.direction.title(), "max_length": t.max_length, "strategy": spelled[t.strategy], "stride": t.stride},
            "padding": p and {"strategy": "BatchLongest" if p.length is None else {"Fixed": p.length}, "direction": p.direction.title(), "pad_to_multiple_of": p.pad_to_multiple_of, "pad_id": p.pad_id, "pad_type_id": p.pad_type_id, "pad_token": p.pad_token},
            "added_tokens": [{"id": i, **vars(t)} for t, i in sorted(self.added.tokens, key=lambda x: x[1])],
            "normalizer": normalizer_to_json(self.normalizer),
            "pre_tokenizer": splitter_to_json(self.splitter),
            "post_processor": processor_to_json(self.processor),
            "decoder": decoder_to_json(self.decoder),
            "model": model_to_json(self.model),
        }
        return json.dumps(j, ensure_ascii=False, indent=2 if pretty else None)

    @staticmethod
    def from_json(text: str) -> TextPipeline:
        j = json.loads(text)
        if j.get("version") != "1.0":
            raise ValueError(f"version {j.get('version')} is not known; there is 1.0")
        if not j.get("model"):
            raise ValueError("a pipeline needs a model")
        t, p = j.get("truncation"), j.get("padding")
        spelled = {"LongestFirst": "longest_first", "OnlyFirst": "only_first", "OnlySecond": "only_second"}
        tokens = tuple((AddedToken(**{k: v for k, v in a.items() if k != "id"}), a["id"]) for a in j.get("added_tokens") or [])
        model = model_from_json(j["model"])
        for token, i in tokens:
            if model.token_to_id(token.content) not in (None, i):
                warnings.warn(f"the added token {token.content} has id {i}, but the model knows it by another", stacklevel=2)
        return TextPipeline(
            model,
            normalizer_from_json(j.get("normalizer")),
            splitter_from_json(j.get("pre_tokenizer")),
            processor_from_json(j.get("post_processor")),
            decoder_from_json(j.get("decoder")),
            AddedVocabulary(tokens),
            t and Truncation(t["max_length"], t["stride"], spelled[t["strategy"]], t["direction"].lower()),
            p and Padding(None if p["strategy"] == "BatchLongest" else p["strategy"]["Fixed"], p["direction"].lower(), p["pad_to_multiple_of"], p["pad_id"], p["pad_type_id"], p["pad_token"]),
        )


def _windows(e: Column, n: Column, t: Truncation) -> Column:
    """Windows of at most n tokens over what lies beyond the first n."""
    step = F.greatest(n - t.stride, F.lit(1))
    total = E.size(e)
    starts = F.when((n > 0) & (total > n), F.filter(F.sequence(F.lit(0), total - 1, step), lambda i: (i > 0) & (i + t.stride < total))).otherwise(F.array().cast("array<int>"))
    if t.direction == "right":
        return F.transform(starts, lambda i: E.part(e, i, F.least(n, total - i)))
    return F.transform(starts, lambda i: E.part(e, total - i - F.least(n, total - i), F.least(n, total - i)))


def _offsets(rows: list[tuple[int, str, int, int, int]], text: str, offset_type: str) -> list[tuple[int, str, int, int, int]]:
    if offset_type == "none":
        return [(i, "", None, 0, 0) for i, *_ in rows]
    if offset_type == "char" or text.isascii():
        return rows
    at = list(accumulate((len(c.encode()) for c in text), initial=0))
    return [(i, t, w, at[a], at[b]) for i, t, w, a, b in rows]


def _raw_array(rows: list[list[tuple] | None]) -> pa.Array:
    ends = pa.array(accumulate((len(r or ()) for r in rows), initial=0), pa.int32())
    columns = list(zip(*[x for r in rows if r for x in r])) or [()] * 5
    fields = [pa.ListArray.from_arrays(ends, pa.array(c, f.type.value_type)) for c, f in zip(columns, _RAW_ARROW)]
    return pa.StructArray.from_arrays(fields, fields=list(_RAW_ARROW), mask=pa.array([r is None for r in rows], pa.bool_()))


def _encoding(raw: Column, sequence: int) -> Column:
    n = F.size(raw["ids"])
    same = lambda v: F.array_repeat(F.lit(v), n)
    spans = F.zip_with(raw["starts"], raw["ends"], lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    parts = {"ids": raw["ids"], "type_ids": same(sequence), "tokens": raw["tokens"], "word_ids": raw["word_ids"], "offsets": spans, "special_tokens_mask": same(0), "attention_mask": same(1), "sequence_ids": same(sequence)}
    return E._struct(parts)


def model_to_json(m: Model) -> dict:
    match m:
        case Bpe():
            names = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
            return {"type": "BPE", **{k: getattr(m, k) for k in names}, "vocab": _by_id(m.vocab), "merges": [list(p) for p in m.merges]}
        case WordPiece():
            return {"type": "WordPiece", "unk_token": m.unk_token, "continuing_subword_prefix": m.continuing_subword_prefix, "max_input_chars_per_word": m.max_input_chars_per_word, "vocab": _by_id(m.vocab)}
        case WordLevel():
            return {"type": "WordLevel", "vocab": _by_id(m.vocab), "unk_token": m.unk_token}
        case Unigram():
            return {"type": "Unigram", "unk_id": m.unk_id, "vocab": [list(p) for p in m.pieces], "byte_fallback": m.byte_fallback}
    raise ValueError("unknown model")


def _by_id(vocab: dict[str, int]) -> dict[str, int]:
    return dict(sorted(vocab.items(), key=lambda x: x[1]))


def model_from_json(j: dict) -> Model:
    """Also without ``type``: by the fields, word piece before word level."""
    kind = j.get("type") or ("BPE" if "merges" in j else "Unigram" if isinstance(j["vocab"], list) else "WordPiece" if "max_input_chars_per_word" in j or "continuing_subword_prefix" in j else "WordLevel")
    rest = {k: v for k, v in j.items() if k not in ("type", "vocab", "merges")}
    match kind:
        case "BPE":
            merges = tuple(tuple(m.split(" ") if isinstance(m, str) else m) for m in j["merges"])
            return Bpe(j["vocab"], merges, **{k: v for k, v in rest.items() if k in Bpe.__dataclass_fields__})
        case "WordPiece":
            return WordPiece(j["vocab"], **rest)
        case "WordLevel":
            return WordLevel(j["vocab"], **rest)
        case "Unigram":
            return Unigram(tuple((p, s) for p, s in j["vocab"]), j.get("unk_id"), j.get("byte_fallback", False))
    raise ValueError(f"unknown model {kind}")
