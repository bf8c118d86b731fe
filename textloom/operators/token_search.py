"""Search for very many added tokens as a join.

The tokens are a table.  What travels to the texts is two bitmaps of bounded
size: of the tokens' first ``STEM`` characters and of whole tokens.  A rolling
hash, longer by one character at a time, is taken at all places of a batch of
texts at once; beyond the stem it goes on only where a stem may stand, so the
time depends little on the number of tokens.  Places where a token may stand
meet the table by their characters.  That join settles what stands where; the
bitmaps only spare rows.  A table of up to ``BROADCAST_CHARS`` travels whole, and
then a text's tokens are taken where the text is, and no place is shuffled.

At a place the longest token counts.  Tokens that overlap form clusters, told
apart by the farthest end before a place; within a cluster the leftmost is taken
and the rest skipped.  A rejected token (one within a word that must stand
alone) is skipped whole, and stripped white space is never taken twice.

Null texts and empty tokens have no places.  Rows that repeat key and text give
their places once.  Texts are read whole, however long.  Columns beside the key
and the text are not read.  Empty tables give no places.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.chars import is_space

STEM = 4
#: Bits of a bitmap (a megabyte), of which words of 64 are sent.
BITS = 1 << 23
#: Characters of all tokens up to which their table is sent to the texts; a larger one is dealt by content and salt.
BROADCAST_CHARS, SALTS = 4_000_000, 16
_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: Stands between texts; no character.
_BETWEEN = 0x110000
_SPACES = np.asarray([c for c in range(0x3001) if is_space(chr(c))], np.uint32)
_WORD = re.compile(r"\w")
_FLAGS = ("single_word", "lstrip", "rstrip")


def _bit(h: np.ndarray, length: int) -> np.ndarray:
    return ((h ^ np.uint64(length)) * _SPREAD) >> np.uint64(64 - 23)


def _hash(codes: np.ndarray) -> np.ndarray:
    """One number for each row of code points."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = h * _BASE + codes[:, k].astype(np.uint64)
    return h


def token_bitmaps(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bitmaps of stems and of whole tokens, and the lengths of tokens; of a table with ``content``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[str]] = {}
            for t in batch.column(0).to_pylist():
                if t:
                    by_length.setdefault(len(t), []).append(t)
            for n, texts in by_length.items():
                codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(-1, n)
                bits = [np.unique(_bit(_hash(codes), n)), np.unique(_bit(_hash(codes[:, :STEM]), STEM) if n > STEM else np.zeros(0, np.uint64))]
                for kind, found in enumerate(bits):
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(found), pa.int32()), "length": pa.array([n] * len(found), pa.int32()), "bit": found.astype(np.int64)})

    bits = tokens.select("content").mapInArrow(each, "kind int, length int, bit long")
    words = bits.groupBy("kind", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits"), F.collect_set("length").alias("lengths")).collect()
    maps, lengths = np.zeros((2, BITS // 64), np.uint64), set()
    for r in words:
        maps[r["kind"], r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
        lengths.update(r["lengths"])
    return maps[1], maps[0], sorted(lengths)


def _has(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def possible_places(codes: np.ndarray, stems: np.ndarray, wholes: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) where a token of that length may stand."""
    at, h, wanted = np.arange(len(codes)), np.zeros(len(codes), np.uint64), set(lengths)
    for n in range(1, max(lengths, default=0) + 1):
        inside = at + n <= len(codes)
        at, h = at[inside], h[inside]
        h = h * _BASE + codes[at + n - 1].astype(np.uint64)
        if n in wanted:
            yield n, at[_has(wholes, _bit(h, n))]
        if n == STEM:
            going = _has(stems, _bit(h, STEM))
            at, h = at[going], h[going]
        if n > STEM:  # what runs into the next text ends
            going = codes[at + n - 1] != _BETWEEN
            at, h = at[going], h[going]


def _batch_places(batch: pa.RecordBatch, stems: np.ndarray, wholes: np.ndarray, lengths: list[int], known: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of row, start, stop, content, white space before and after, and whether a word goes on beside; of one length each.

    With ``known`` only its tokens count."""
    texts = batch.column("__chars").to_pylist()
    sizes = np.asarray([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    codes = np.concatenate([x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), np.uint32), np.asarray([_BETWEEN], np.uint32))])
    space, places = np.isin(codes, _SPACES), np.arange(len(codes))
    last_other = np.maximum.accumulate(np.where(space, -1, places))
    next_other = np.minimum.accumulate(np.where(space, len(codes), places)[::-1])[::-1]
    for n, at in possible_places(codes, stems, wholes, lengths):
        row = np.searchsorted(begin, at, "right") - 1
        fits = at + n < begin[row] + sizes[row]
        at, row = at[fits], row[fits]
        start = at - begin[row]
        content = np.empty(len(at), object)
        content[:] = [texts[r][s : s + n] for r, s in zip(row.tolist(), start.tolist())]
        if known is not None:
            fits = np.fromiter((c in known for c in content), bool, len(content))
            at, row, start, content = at[fits], row[fits], start[fits], content[fits]
        if not len(at):
            continue
        beside = [bool(s and _WORD.match(texts[r][s - 1]) or s + n < len(texts[r]) and _WORD.match(texts[r][s + n])) for r, s in zip(row.tolist(), start.tolist())]
        before = np.where(start > 0, np.minimum(at - 1 - last_other[np.maximum(at - 1, 0)], start), 0)
        after = next_other[at + n] - (at + n)
        yield row, start, start + n, content, before, after, np.asarray(beside, bool)


def _rows_of(texts: DataFrame, key: list[str], text_col: str) -> tuple[DataFrame, list[str], str]:
    """The texts that are not null with a hash, the columns that tell them apart, and these columns' schema."""
    rows = texts.select(*key, F.xxhash64(text_col).alias("__text"), F.col(text_col).alias("__chars")).where(F.col("__chars").isNotNull())
    kept = [*key, "__text"]
    return rows, kept, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)


def _candidates(texts: DataFrame, tokens: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """Places where a token may stand, with what it would be and what is beside it."""
    shared = texts.sparkSession.sparkContext.broadcast(token_bitmaps(tokens))
    rows, kept, schema = _rows_of(texts, key, text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                for row, start, stop, content, before, after, beside in _batch_places(batch, *shared.value):
                    columns = [*[batch.column(c).take(pa.array(row)) for c in kept], pa.array(content, pa.string()), *[pa.array(v, pa.int32()) for v in (start, stop, before, after)], pa.array(beside)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, "content", "start", "stop", "before", "after", "beside"])

    return rows.mapInArrow(each, f"{schema}, content string, start int, stop int, before int, after int, beside boolean")


def _found_in_place(texts: DataFrame, known: DataFrame, key: list[str], text_col: str, distinct: bool) -> DataFrame:
    """``found_tokens`` with a small table: each text's tokens are taken where the text is."""
    rows, kept, schema = _rows_of(texts, key, text_col)
    if not distinct and rows.groupBy(*kept).count().where("count > 1").take(1):
        rows = rows.dropDuplicates([*kept, "__chars"])
    table = known.toArrow()
    places = {c: k for k, c in enumerate(table.column("content").to_pylist())}
    facts = [table.column(c).to_numpy() for c in ("id", *_FLAGS)]
    shared = texts.sparkSession.sparkContext.broadcast((token_bitmaps(known), places, facts))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps, places, (ids, single, lstrip, rstrip) = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                found = list(_batch_places(batch, *bitmaps, places))
                if not found:
                    continue
                row, start, stop, content, before, after, beside = map(np.concatenate, zip(*found))
                # the longest at each place
                order = np.lexsort((stop, start, row))
                order = order[np.r_[(np.diff(row[order]) != 0) | (np.diff(start[order]) != 0), True]]
                token = np.fromiter((places[c] for c in content[order]), np.int64, len(order))
                row, start, stop = row[order], start[order], stop[order]
                left, right = start - np.where(lstrip[token], before[order], 0), stop + np.where(rstrip[token], after[order], 0)
                taken, begins = _taken_in_order(row, start, stop, left, right, single[token] & beside[order])
                columns = [*[batch.column(c).take(pa.array(row[taken])) for c in key], pa.array(begins, pa.int32()), pa.array(right[taken], pa.int32()), pa.array(ids[token[taken]]), pa.array(content[order][taken], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*key, "start", "stop", "id", "content"])

    of_key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    return rows.mapInArrow(each, f"{of_key}, start int, stop int, id long, content string")


def _taken_in_order(row: np.ndarray, start: np.ndarray, stop: np.ndarray, left: np.ndarray, right: np.ndarray, rejected: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Which of the places, sorted by row and start, are taken, and where each begins: not before the end of the last one."""
    taken, begins, last, at, past = [], [], -1, 0, 0
    for k, (r, s, e, a, b, bad) in enumerate(zip(*(x.tolist() for x in (row, start, stop, left, right, rejected)))):
        if r != last:
            last, at, past = r, 0, 0
        if s < past:
            continue
        past = e
        if bad or s < at:
            continue
        taken.append(k)
        begins.append(max(at, a))
        at = b
    return np.asarray(taken, np.int64), begins


def found_tokens(texts: DataFrame, tokens: DataFrame, key: list[str], text_col: str = "text", distinct: bool = False) -> DataFrame:
    """Rows (key, start, stop, id, content) of the tokens found in each text, in one pass over it.

    ``tokens`` has id, content, and may have single_word, lstrip and rstrip.  With ``distinct`` no row repeats key and text."""
    flags = [F.coalesce(F.col(f), F.lit(False)).alias(f) if f in tokens.columns else F.lit(False).alias(f) for f in _FLAGS]
    known = tokens.where(F.length("content") > 0).select(F.col("id").cast("long").alias("id"), "content", *flags).groupBy("content").agg(F.first(F.struct("id", *_FLAGS)).alias("token")).select("content", "token.*")
    if (known.agg(F.sum(F.length("content"))).first()[0] or 0) <= BROADCAST_CHARS:
        return _found_in_place(texts, known, key, text_col, distinct)
    places = _candidates(texts, known, key, text_col)
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    dealt = places.withColumn("__salt", F.pmod(F.xxhash64("__text", "start"), F.lit(SALTS)).cast("int"))
    met = dealt.join(known.withColumn("__salt", F.explode(salts)), ["content", "__salt"])
    of_text = [*key, "__text"]
    token = F.struct("start", "stop", "id", "content", (F.col("single_word") & F.col("beside")).alias("rejected"), F.when(F.col("lstrip"), F.col("before")).otherwise(0).alias("before"), F.when(F.col("rstrip"), F.col("after")).otherwise(0).alias("after"))
    # dealt by text once: the longest tokens, their order and their clusters all stay there
    longest = met.repartition(*of_text).groupBy(*of_text, "start").agg(F.max_by(token, "stop").alias("x"))
    order = Window.partitionBy(*of_text).orderBy("start")
    reach = F.max(F.col("x.stop") + F.col("x.after")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("x.start") - F.col("x.before") >= reach).cast("int")
    clusters = longest.withColumn("opens", F.coalesce(opens, F.lit(1))).withColumn("cluster", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    taken = clusters.groupBy(*of_text, "cluster").agg(_taken(F.array_sort(F.collect_list("x"))).alias("taken"))
    return taken.select(*key, F.explode("taken").alias("x")).select(*key, "x.*")


def _taken(sorted_tokens: Column) -> Column:
    """The tokens of a cluster that are taken, from left to right."""
    kind = "struct<start:int,stop:int,id:bigint,content:string>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("past"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        behind = x["start"] < s["past"]
        lost = behind | x["rejected"] | (x["start"] < s["at"])
        stop = x["stop"] + x["after"]
        one = F.struct(F.greatest(s["at"], x["start"] - x["before"]).alias("start"), stop.alias("stop"), x["id"].alias("id"), x["content"].alias("content"))
        return F.struct(F.when(lost, s["at"]).otherwise(stop).alias("at"), F.when(behind, s["past"]).otherwise(x["stop"]).alias("past"), F.when(lost, s["out"]).otherwise(F.array_append(s["out"], one)).alias("out"))

    return F.aggregate(sorted_tokens, zero, step, lambda s: s["out"])


def pieces_between(texts: DataFrame, found: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """Rows (key, piece, text): what is left of each text between the tokens found, and where it starts."""
    rows = texts.where(F.col(text_col).isNotNull()).dropDuplicates([*key, text_col]).select(*key, F.col(text_col).alias("__chars"))
    spans = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    met = rows.join(spans, key, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")))
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["stop"]))
    stops = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.char_length("__chars")))
    gaps = F.filter(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("piece"), b.alias("stop"))), lambda g: g["piece"] < g["stop"])
    return met.select(*key, "__chars", F.explode(gaps).alias("g")).select(*key, "g.piece", F.substring(F.col("__chars"), F.col("g.piece") + 1, F.col("g.stop") - F.col("g.piece")).alias("text"))


def added_token_places(texts: DataFrame, tokens: DataFrame, key: list[str], text_col: str = "text", normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """Both passes: tokens that are not ``normalized`` in the texts, then the others in the normalized pieces between.

    Rows (key, normalized, piece, start, stop, id, content): raw tokens stand at start to stop of the text; the others at
    start to stop of the normalized piece that begins at ``piece``.  ``key`` must tell the texts apart."""
    raw = found_tokens(texts, tokens.where(~F.col("normalized")), key, text_col)
    pieces = pieces_between(texts, raw, key, text_col)
    later = tokens.where("normalized")
    if normalize is not None:
        pieces, later = pieces.withColumn("text", normalize(F.col("text"))), later.withColumn("content", normalize(F.col("content")))
    second = found_tokens(pieces, later, [*key, "piece"], distinct=True)
    columns = [*key, "normalized", "piece", "start", "stop", "id", "content"]
    return raw.withColumn("normalized", F.lit(False)).withColumn("piece", F.lit(0)).select(*columns).unionByName(second.withColumn("normalized", F.lit(True)).select(*columns))
