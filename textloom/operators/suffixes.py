"""Repeated substrings of words through a suffix array that is sorted in ranges.

Each suffix of each distinct word, cut to one character more than the longest
piece, is counted once; the suffixes are sorted by ranges, so each task holds a
stretch of the suffix array.  Walking it, the longest common prefix with the
suffix before tells which prefixes end there and which branch: a prefix that is
followed by two different characters (or an end) is a node, and its count is
the number of suffixes in its interval.  Prefixes that reach over a stretch's
edge are given out by their following characters, and added up over stretches.

What is shuffled are suffixes, never the substrings in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NODE = "piece string, next string, n long, nexts long"


class _Stretch:
    """The prefixes of the last suffix seen, each with the characters that followed it and how often."""

    def __init__(self, longest: int):
        self.longest = longest
        self.first: str | None = None
        self.last = ""
        self.followed: list[tuple[list[str], list[int]]] = []  # by the prefix's length, from 2
        self.shared_with_first = 0

    def _closed(self, down_to: int) -> Iterator[tuple[str, str | None, int, int]]:
        """The prefixes of the last suffix that are longer than ``down_to``, which no later suffix has."""
        for length in range(min(len(self.last), self.longest), max(down_to, 1), -1):
            names, counts = self.followed[length - 2]
            if length <= self.shared_with_first:  # it may go on in the stretch before
                yield from ((self.last[:length], c, n, 0) for c, n in zip(names, counts))
            elif len(names) > 1:
                yield self.last[:length], None, sum(counts), len(names)

    def add(self, suffix: str, n: int) -> Iterator[tuple[str, str | None, int, int]]:
        same = 0
        for a, b in zip(suffix, self.last):
            if a != b:
                break
            same += 1
        yield from self._closed(same)
        if self.first is None:
            self.first, self.shared_with_first = suffix, len(suffix)
        else:
            self.shared_with_first = min(self.shared_with_first, same)
        del self.followed[max(same - 1, 0) :]
        for length in range(2, min(same, self.longest) + 1):
            names, counts = self.followed[length - 2]
            if length == same:
                names.append(suffix[length : length + 1])
                counts.append(n)
            else:
                counts[-1] += n
        for length in range(max(same + 1, 2), min(len(suffix), self.longest) + 1):
            self.followed.append(([suffix[length : length + 1]], [n]))
        self.last = suffix

    def end(self) -> Iterator[tuple[str, str | None, int, int]]:
        """What may go on in the stretch behind."""
        for length in range(2, min(len(self.last), self.longest) + 1):
            names, counts = self.followed[length - 2]
            yield from ((self.last[:length], c, n, 0) for c, n in zip(names, counts))


def repeated_substrings(words: DataFrame, longest: int, stretches: int | None = None) -> DataFrame:
    """Rows (piece, n): substrings of 2 to ``longest`` characters of the distinct words in ``word`` that occur with at least two
    different characters, or an end, behind them, and how often they occur."""
    at = F.sequence(F.lit(1), F.length("word") - 1)
    starts = words.where(F.length("word") > 1).select("word", F.explode(at).alias("at"))
    suffixes = starts.select(F.substring(F.col("word"), F.col("at"), F.lit(longest + 1)).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"))
    ranged = suffixes.repartitionByRange(stretches, "suffix") if stretches else suffixes.repartitionByRange("suffix")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch = _Stretch(longest)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["piece", "next", "n", "nexts"])

        for batch in batches:
            found: list[tuple] = []
            for suffix, n in zip(batch.column("suffix").to_pylist(), batch.column("n").to_pylist()):
                found += stretch.add(suffix, n)
            yield rows(found)
        yield rows(list(stretch.end()))

    nodes = ranged.sortWithinPartitions("suffix").mapInArrow(each, _NODE)
    # of prefixes at the edges each following character counts once; all others are whole
    edges = nodes.where("nexts = 0").groupBy("piece", "next").agg(F.sum("n").alias("n")).groupBy("piece").agg(F.sum("n").alias("n"), F.count("*").alias("nexts"))
    return nodes.where("nexts > 1").select("piece", "n").unionByName(edges.where("nexts > 1").select("piece", "n"))
