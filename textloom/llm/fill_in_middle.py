"""Fill-in-middle transformation by a parallel automaton scan.

A unit is a run of other characters with the white space (U+0020, U+0009 to
U+000D) before it; white space at the end is a unit of its own.  A unit starts
where white space follows another character, so an automaton with few states
counts units and finds sentinels in one scan:

    0  at the start or after white space      2  after "<"
    1  after another character                3  after "<P", "<S" or "<M"

Texts beyond ``LONG`` characters are cut into chunks that are scanned in
parallel.  A chunk does not know the state in which it is entered, so it emits
a function: for each of the four states the state at its end, the unit starts
and the sentinels met on the way.  Such functions compose associatively; their
composition gives the units of the whole text, and for each chunk the state in
which it is entered and the units before it.  The cuts are drawn from the number
of units; a cut lies in the chunk whose range of unit numbers holds it, and
that chunk alone is scanned again to find the place.  A text has at most 2**31
bytes, hence at most 65,536 chunks, whose functions meet in one task.

Draws come from the sha256 of seed and document id, so they depend neither on
partitions nor on retries.  A text that is null is empty; empty texts and those
that hold a sentinel stay plain.  A null id counts as an empty one.  Rows that
repeat get the same result each.  Columns of the names of new ones are replaced;
all others pass through, whatever their names.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import Scratch, packed, salted_join

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
#: Texts beyond this many characters are scanned in chunks of as many.
LONG = 32_768
#: Chunks of all long texts together up to which what is known of them is broadcast (a megabyte); beyond, a join deals it.
BROADCAST_CHUNKS = 65_536
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
STATES = 4
_LESS, _MORE, _MARKS = ord("<"), ord(">"), tuple(ord(x[1]) for x in (PREFIX, SUFFIX, MIDDLE))
_MADE = (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _is_space(codes: np.ndarray) -> np.ndarray:
    return (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))


def unit_starts(codes: np.ndarray, state: int) -> np.ndarray:
    """Places where white space follows another character, if the chunk is entered in ``state``."""
    space = _is_space(codes)
    before = np.empty_like(space)
    before[1:], before[:1] = space[:-1], state == 0
    return np.flatnonzero(space & ~before)


def chunk_function(codes: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """For each entry state: the state at the end, the unit starts, the sentinels."""
    if not len(codes):
        return list(range(STATES)), [0] * STATES, [0] * STATES
    space, less, mark = _is_space(codes), codes == _LESS, np.isin(codes, _MARKS)
    inner = int((space[1:] & ~space[:-1]).sum())
    found = int((less[:-2] & mark[1:-1] & (codes[2:] == _MORE)).sum())
    starts = [inner + int(space[0] and s != 0) for s in range(STATES)]
    # a sentinel that began in the chunk before ends at the first or second character of this one
    ends = [0, 0, int(len(codes) > 1 and mark[0] and codes[1] == _MORE), int(codes[0] == _MORE)]
    last = 0 if space[-1] else 2 if less[-1] else 3 if len(codes) > 1 and mark[-1] and less[-2] else 1
    exits = [3 if len(codes) == 1 and s == 2 and mark[0] else last for s in range(STATES)]
    return exits, starts, [found + e for e in ends]


def compose(first: tuple, then: tuple) -> tuple:
    """The function of two neighbouring chunks; associative."""
    exits, starts, marks = zip(*[(then[0][e], s + then[1][e], m + then[2][e]) for e, s, m in zip(*first)])
    return list(exits), list(starts), list(marks)


def draws(doc_id: str, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def restore(output: str, form: str) -> str:
    """The text that was transformed."""
    if form == "plain":
        return output
    rest, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = rest[len(PREFIX) :].split(SUFFIX)
    else:
        suffix, prefix = rest[len(SUFFIX) :].split(PREFIX)
    return prefix + middle + suffix


def restored(output: Column, form: Column) -> Column:
    """As ``restore``, on columns: each sentinel stands in an output exactly once."""
    after = lambda mark: F.substring_index(output, mark, -1)
    piece = lambda mark, end: F.substring_index(after(mark), end, 1)
    psm = F.concat(piece(PREFIX, SUFFIX), after(MIDDLE), piece(SUFFIX, MIDDLE))
    spm = F.concat(piece(PREFIX, MIDDLE), after(MIDDLE), piece(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


class _Cutter:
    """Forms and cuts of texts whose units are counted, chunk by chunk."""

    def __init__(self, seed: int, fim_percent: int, spm_percent: int, size: int):
        self.seed, self.fim, self.spm, self.size = seed, fim_percent, spm_percent, size

    def place(self, text: str, units: int, n: int, before: list[int], entry: list[int]) -> int:
        """Where ``units`` units end: at the start of the next, which the chunk that holds its number shows."""
        if not units:
            return 0
        if units == n:
            return len(text)
        k = int(np.searchsorted(before, units, side="left")) - 1
        starts = unit_starts(code_points(text[k * self.size : (k + 1) * self.size]), entry[k])
        return k * self.size + int(starts[units - before[k] - 1])

    def row(self, doc_id: str | None, text: str, scan: dict | None) -> tuple:
        if scan is None:
            exits, starts, marks = chunk_function(code_points(text))
            scan = {"units": (starts[0] + 1) if text else 0, "marked": marks[0] > 0, "before": [0], "entry": [0]}
        n = scan["units"]
        h1, h2, h3, h4 = draws(doc_id or "", self.seed)
        if not text or scan["marked"] or h3 % 100 >= self.fim:
            return n, "plain", None, None, text
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, q = (self.place(text, units, n, scan["before"], scan["entry"]) for units in (a, b))
        prefix, middle, suffix = text[:p], text[p:q], text[q:]
        if h4 % 100 < self.spm:
            return n, "spm", p, q - p, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return n, "psm", p, q - p, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _slices(batches: Iterator[pa.RecordBatch], texts: Callable[[pa.RecordBatch], pa.Array], most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of at most ``most`` bytes of text, or one row, and their texts."""
    for batch in batches:
        column = texts(batch)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for k, size in enumerate(sizes.tolist()):
            if total and total + size > most:
                yield batch.slice(start, k - start), column.slice(start, k - start).to_pylist()
                start, total = k, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start), column.slice(start).to_pylist()


def _scans(long: DataFrame, size: int) -> DataFrame:
    """For each distinct long text: units, whether it holds a sentinel, and units before and entry state of each chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches, lambda b: b.column("text")):
            for key, text in zip(batch.column("key").to_pylist(), texts):
                for first in range(0, len(text), 64 * size):
                    held = [text[at : at + size] for at in range(first, min(first + 64 * size, len(text)), size)]
                    yield pa.RecordBatch.from_pydict({"key": [key] * len(held), "at": pa.array(range(first // size, first // size + len(held)), pa.int32()), "chunk": held})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch, texts in _slices(batches, lambda b: b.column("chunk")):
            made = [chunk_function(code_points(c)) for c in texts]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), *[pa.array([m[k] for m in made], ints) for k in range(3)]], names=["key", "at", "exits", "starts", "marks"])

    def composed(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at")
        state, before, entry, units, marks = 0, [], [], 0, 0
        for exits, starts, found in zip(*(rows[c].to_pylist() for c in ("exits", "starts", "marks"))):
            before.append(units)
            entry.append(state)
            units, marks, state = units + starts[state], marks + found[state], exits[state]
        copies = rows["copies"][:1]
        return pa.table({"key": table["key"][:1], "copies": copies, "units": pa.array([units + 1], pa.int64()), "marked": [marks > 0], "before": pa.array([before], pa.list_(pa.int64())), "entry": pa.array([entry], pa.list_(pa.int32()))})

    # chunks are dealt evenly, so one giant text is scanned by many tasks; functions are small, and copies of a text give them once
    chunks = long.select("key", "text").mapInArrow(cut, "key string, at int, chunk string").hint("rebalance")
    functions = chunks.mapInArrow(scan, "key string, at int, exits array<int>, starts array<int>, marks array<int>")
    distinct = functions.groupBy("key", "at").agg(*[F.first(c).alias(c) for c in ("exits", "starts", "marks")], F.count("*").alias("copies"))
    made = distinct.groupBy("key").applyInArrow(composed, "key string, copies long, units long, marked boolean, before array<long>, entry array<int>")
    return made.select("key", F.col("copies").alias("n"), F.struct("units", "marked", "before", "entry").alias("scan"))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, long: int = LONG) -> DataFrame:
    """Adds n (units), form, prefix_chars, middle_chars and output to each document."""
    cutter, kept = _Cutter(seed, fim_percent, spm_percent, long), docs.drop(*[c for c, _ in _MADE])
    text, place = F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), kept.columns.index(text_col)
    rows = packed(kept).select("row", F.col(f"row.`{id_col}`").cast("string").alias("id"))
    is_long = F.char_length(text) > long
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, kind) for c, kind in _MADE]])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches, lambda b: b.column("row").field(place)):
            scans = batch.column("scan").to_pylist() if "scan" in batch.schema.names else [None] * batch.num_rows
            made = [cutter.row(i, t or "", s) for i, t, s in zip(batch.column("id").to_pylist(), texts, scans)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(v, kind) for v, kind in zip(zip(*made), kinds)]], names=schema.names)

    whole = rows.where(is_long).withColumn("key", F.sha2(text, 256))
    scans = Scratch(docs.sparkSession, "fill_in_middle").table(_scans(whole.select("key", text.alias("text")), long))
    chunks, copies = scans.agg(F.coalesce(F.sum(F.size("scan.before")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if chunks <= BROADCAST_CHUNKS:
        met = whole.join(F.broadcast(scans), "key")
    else:
        met = salted_join(whole, scans, ["key"], ["id"], copies)
    made = rows.where(~is_long).mapInArrow(each, schema).unionByName(met.select("row", "id", "scan").mapInArrow(each, schema))
    return made.select(*[F.col(f"row.`{c}`") for c in kept.columns], *[c for c, _ in _MADE])


def digests(docs: DataFrame, **parameters: int) -> DataFrame:
    """One row per document: its units, form, cuts, and hashes of the output and of the text rebuilt from it."""
    made = transform(docs.select("doc_id", "text"), **parameters)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
