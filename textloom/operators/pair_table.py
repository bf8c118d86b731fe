"""Byte-pair merges in rounds over distinct words.

Distinct words are rows of symbol ids with a count.  A round takes the most
frequent pairs as joints and cuts the words wherever no joint is.  A token that
the round makes stands on joints all through, for a pair of tokens is never more
frequent than the pair of symbols at its seam; so all that may be merged before
the first pair beyond the joints lies within these segments.  Equal segments are
added up, and the driver merges them one by one, in exact order, until the next
pair may be beyond the joints.  Then all words are merged with that list, and
their pairs counted again.

What reaches the driver are a round's joints and segments, of at most ``SYMBOLS``
symbols (else it takes fewer joints; one alone always makes a merge), and the
vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.batches import gathered

#: Symbols of a round's segments that the driver takes at most.
SYMBOLS = 1 << 20
#: Joints of the first round, and of any.
FIRST_JOINTS, MOST_JOINTS = 64, 1 << 16
#: Words that are worked on together.
TOGETHER = 1 << 16
#: Symbols are 32-bit numbers, one after another.
WORD_COLUMNS = "count long, symbols binary"
_ROWS = f"{WORD_COLUMNS}, pair long, n long"


def every_other(at: np.ndarray) -> np.ndarray:
    """Of neighbouring places every other one: a run of equal symbols is merged from the left."""
    starts = np.r_[True, np.diff(at) != 1]
    first = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - first) % 2 == 0]


@dataclass
class Words:
    """A batch of words: counts, and their symbols one after another."""

    counts: np.ndarray
    flat: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch | pa.Table) -> Words:
        symbols = batch.column("symbols")
        symbols = (symbols.combine_chunks() if isinstance(symbols, pa.ChunkedArray) else symbols).cast(pa.large_binary())
        ends = np.frombuffer(symbols.buffers()[1], np.int64)[symbols.offset : symbols.offset + len(symbols) + 1] if len(symbols) else np.zeros(1, np.int64)
        data = np.frombuffer(symbols.buffers()[2] or b"", np.int32)[ends[0] // 4 : ends[-1] // 4] if ends[-1] else np.zeros(0, np.int32)
        return Words(batch.column("count").to_numpy(), data, np.diff(ends) // 4)

    @property
    def word_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.lengths)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of neighbouring symbols, and which of them stand within one word."""
        word = self.word_of
        return (self.flat[:-1].astype(np.int64) << 32) | self.flat[1:], word[:-1] == word[1:]

    def some(self, wanted: np.ndarray) -> Words:
        return Words(self.counts[wanted], self.flat[np.repeat(wanted, self.lengths)], self.lengths[wanted])

    def segments(self, joints: np.ndarray) -> Words:
        """The words cut wherever no joint (sorted keys) is; single symbols are left out."""
        if len(self.flat) < 2:
            return self.some(np.zeros(len(self.counts), bool))
        pairs, within = self.pairs()
        first = np.flatnonzero(np.r_[True, ~(within & (joints[_place(joints, pairs)] == pairs))])
        made = Words(self.counts[self.word_of[first]], self.flat, np.diff(np.r_[first, len(self.flat)]))
        return made.some(made.lengths > 1)

    def merged(self, merges: list[tuple[int, int, int]]) -> Words:
        """With the merges (a, b, new) in order, each from left to right; words may change places.

        No merge gives rise to a pair of an earlier one, so a word's merges are found one by one, of all words at once."""
        keys = np.asarray([(a << 32) | b for a, b, _ in merges], np.int64)
        order = np.argsort(keys)
        keys, new = keys[order], np.asarray([m[2] for m in merges], np.int32)[order]
        done, held = [], self.some(self.lengths > 0)
        while len(held.flat) > 1:
            pairs, within = held.pairs()
            which = _place(keys, pairs)
            rank = np.r_[np.where(within & (keys[which] == pairs), order[which], len(keys)), len(keys)]
            next_of = np.minimum.reduceat(rank, np.cumsum(held.lengths) - held.lengths)
            going, word = next_of < len(keys), held.word_of
            at = np.flatnonzero((rank < len(keys)) & (rank == next_of[word]))
            if not len(at):
                break
            done.append(held.some(~going))
            at = every_other(at)
            flat, keep = held.flat.copy(), going[word]
            flat[at] = new[which[at]]
            keep[at + 1] = False
            held = Words(held.counts[going], flat[keep], np.bincount(word[keep], minlength=len(going))[going])
        done.append(held)
        return Words(*(np.concatenate([getattr(w, f) for w in done]) for f in ("counts", "flat", "lengths")))

    def table(self) -> pa.RecordBatch:
        ends = np.r_[0, 4 * np.cumsum(self.lengths)].astype(np.int64)
        symbols = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.flat, np.int32))])
        return pa.RecordBatch.from_arrays([pa.array(self.counts, pa.int64()), symbols.cast(pa.binary())], names=["count", "symbols"])


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values, first)


def pair_sums(words: Words) -> tuple[np.ndarray, np.ndarray]:
    if len(words.flat) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, within = words.pairs()
    return summed(keys[within], words.counts[words.word_of[:-1][within]])


def first_pairs(words: DataFrame) -> DataFrame:
    """Rows (pair, n) of all words: counted within each batch, then over all."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, TOGETHER):
            pair, n = pair_sums(Words.of(batch))
            yield pa.RecordBatch.from_pydict({"pair": pair, "n": n})

    return words.mapInArrow(each, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def segments(words: DataFrame, joints: list[int]) -> DataFrame:
    """The words' segments, equal ones added up; segments may be cut again at fewer joints."""
    shared = words.sparkSession.sparkContext.broadcast(np.sort(np.asarray(joints, np.int64)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, TOGETHER):
            made = pa.Table.from_batches([Words.of(batch).segments(shared.value).table()]).group_by("symbols").aggregate([("count", "sum")])
            yield from made.select(["count_sum", "symbols"]).rename_columns(["count", "symbols"]).to_batches()

    return words.mapInArrow(each, WORD_COLUMNS).groupBy("symbols").agg(F.sum("count").alias("count")).select("count", "symbols")


def merges_in_order(held: Words, last: tuple[int, int], admissible: Callable[[int, int], bool], make: Callable[[int, int], tuple[int, bool] | None]) -> list[tuple[int, int, int]]:
    """The merges (a, b, new) of all segments, the most frequent pair first and ties by ids, up to the pair ``last`` (-n, key).

    ``make`` gives the token of a pair and whether there was one before, or None where no more are wanted.  A token
    that was there before may stand on no joint, so what its pairs count is not known here: the round ends behind it."""
    # symbols with a gap before each segment and one at the end
    ends = np.cumsum(held.lengths + 1)
    flat, weight = np.full(int(ends[-1]) + 1 if len(ends) else 1, -1, np.int32), np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    inside = np.ones(len(flat), bool)
    inside[np.r_[0, ends]] = False
    flat[inside], weight[inside] = held.flat, np.repeat(held.counts, held.lengths)

    def counted(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = flat[near], flat[near + 1]
        real = (a >= 0) & (b >= 0)
        return (a[real].astype(np.int64) << 32) | b[real], weight[near[real]]

    keys, n = summed(*counted(np.arange(len(flat) - 1)))
    sums = dict(zip(keys.tolist(), n.tolist()))
    heap = [(-n, k) for k, n in sums.items() if admissible(k >> 32, k & 0xFFFFFFFF)]
    heapify(heap)
    out: list[tuple[int, int, int]] = []
    while heap:
        n, key = heappop(heap)
        if sums[key] != -n:
            continue
        if (n, key) > last:
            break
        a, b = key >> 32, key & 0xFFFFFFFF
        made = make(a, b)
        if made is None:
            break
        out.append((a, b, made[0]))
        if made[1]:
            break
        at = every_other(np.flatnonzero((flat[:-1] == a) & (flat[1:] == b)))
        near = np.zeros(len(flat), bool)
        near[at - 1] = near[at] = near[at + 1] = True
        gone, less = counted(np.flatnonzero(near))
        flat[at] = made[0]
        keep = np.ones(len(flat), bool)
        keep[at + 1] = False
        flat, weight = flat[keep], weight[keep]
        at = at - np.arange(len(at))
        near = np.zeros(len(flat), bool)
        near[at - 1] = near[at] = True
        new, more = counted(np.flatnonzero(near))
        for k, d in zip(*(x.tolist() for x in summed(np.concatenate([gone, new]), np.concatenate([-less, more])))):
            if d:
                sums[k] = sums.get(k, 0) + d
                if sums[k] > 0 and admissible(k >> 32, k & 0xFFFFFFFF):
                    heappush(heap, (-sums[k], k))
    return out


def certain_merges(pairs: list[tuple[int, int, int]], floor: int, most: np.ndarray, overlaps: dict[tuple[int, int], int], token_of: Callable[[int, int], tuple[object, int | None]]) -> list[int]:
    """Which of the pairs (a, b, n), given by falling n and rising ids, are certainly merged next, in order.

    A merge takes the overlapping places from its neighbours: that bounds their counts from both sides.  Pairs that
    arise are at most as frequent as the neighbour they arise from, and where the merge makes a token that exists
    already, its pairs gain as much at most.  A pair is certain where no other, bounded so, nor any that arose, nor any
    beyond the candidates (``floor``) can come before it.  ``token_of`` names a merge's token, and its id if it exists."""
    n = np.asarray([p[2] for p in pairs], np.int64)
    first, second = (np.asarray([p[k] for p in pairs]) for k in (0, 1))
    low, high, gain, taken = n.copy(), n.copy(), np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    by_ids = np.argsort(np.lexsort((second, first)))
    beside: dict[int, list[tuple[int, int]]] = {}
    for (i, j), k in overlaps.items():
        beside.setdefault(i, []).append((j, k))
        beside.setdefault(j, []).append((i, k))
    out: list[int] = []
    made: dict[object, int] = {}
    arisen = 0
    while not taken.all():
        top = low[~taken].max()
        tied = np.flatnonzero(~taken & (low == top))
        c = int(tied[np.argmin(by_ids[tied])])
        if out:
            others = ~taken & (np.arange(len(n)) != c)
            if top < 1 or top <= max(arisen, floor) or gain[c] or (others & ((high > top) | (high == top) & (by_ids < by_ids[c]))).any():
                break
        out.append(c)
        taken[c] = True
        token, known = token_of(int(first[c]), int(second[c]))
        made[token] = made.get(token, 0) + int(most[c])
        arisen = max(arisen, made[token])
        if known is not None:
            of_token = (first == known) | (second == known)
            gain[of_token] += most[c]
            high[of_token] += most[c]
            arisen = max(arisen, floor + made[token])
        # of a run of equal symbols a merge takes every other one: what its neighbours lose at least is open then
        slack = int(n[c] - low[c]) if first[c] != second[c] else int(n[c])
        for j, k in beside.get(c, []):
            low[j] -= k
            high[j] = min(high[j], n[j] + gain[j] - max(0, k - slack))
    return out


def merge_round(words: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """Rows of the words after the merges (count, symbols), and of the pairs in them (pair, n), counted within each batch."""
    shared = words.sparkSession.sparkContext.broadcast(merges)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, TOGETHER):
            after = Words.of(batch).merged(shared.value)
            rows, (pair, n) = after.table(), pair_sums(after)
            nothing = pa.nulls(rows.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*rows.columns, nothing, nothing], names=["count", "symbols", "pair", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pair), pa.int64()), pa.nulls(len(pair), pa.binary()), pa.array(pair), pa.array(n)], names=["count", "symbols", "pair", "n"])

    return words.mapInArrow(each, _ROWS)
