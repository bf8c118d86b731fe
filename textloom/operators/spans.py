"""Joins of character spans: which tokens do given stretches of a text meet?

Spans and tokens are put into bins of ``BIN`` characters of their text, a span
that reaches over several bins into each of them; those that share a bin are
compared, and a pair counts in the first bin it shares.  Bins of one long text
are different keys, so it is dealt over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 256


def pieces_with_spans(texts: DataFrame, key: list[str], text_col: str, pattern: str, kept: str | None = None) -> DataFrame:
    """Rows (key, pos, piece, start, end): the matches of a pattern that covers the text; with ``kept`` only those it matches."""

    def ends(lengths: pa.Array) -> pa.Array:
        n = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False))]
        sums = np.r_[0, np.cumsum(lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64))]
        own = sums[1:] - np.repeat(sums[n[:-1]], np.diff(n))
        return pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(own.astype(np.int32)), mask=lengths.is_null())

    ends.__annotations__ = {"lengths": pa.Array, "return": pa.Array}
    # where a piece ends is the length of all up to it: a running sum within its text's row, so no rows are sorted for it
    listed = texts.select(*key, F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)).alias("__pieces"))
    listed = listed.withColumn("__ends", F.arrow_udf(ends, "array<int>")(F.transform("__pieces", F.char_length)))
    pieces = listed.select(*key, F.posexplode(F.arrays_zip(F.col("__pieces").alias("piece"), F.col("__ends").alias("end"))).alias("at", "x")).select(*key, "at", "x.piece", "x.end")
    placed = pieces.withColumn("start", F.col("end") - F.char_length("piece"))
    if kept is not None:
        placed = placed.where(F.col("piece").rlike(kept))
    return placed.select(*key, F.col("at").alias("pos"), "piece", "start", "end")


def overlapping(tokens: DataFrame, spans: DataFrame, key: list[str], bin_chars: int = BIN) -> DataFrame:
    """Rows (key, span, pos): the tokens (key, pos, start, end) that share a character with a span (key, span, start, end).

    Empty tokens and spans share none."""

    def binned(rows: DataFrame, name: str) -> DataFrame:
        cells = F.sequence(F.expr(f"start div {bin_chars}"), F.expr(f"(end - 1) div {bin_chars}"))
        kept = rows.where("end > start").select(*key, name, "start", "end", F.explode(cells).alias("cell"))
        return kept.select(*key, "cell", name, F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"))

    met = binned(tokens, "pos").join(binned(spans, "span"), [*key, "cell"])
    later = F.greatest("pos_start", "span_start")
    return met.where((later < F.least("pos_end", "span_end")) & (F.expr(f"greatest(pos_start, span_start) div {bin_chars}") == F.col("cell"))).select(*key, "span", "pos")


def token_ranges(tokens: DataFrame, spans: DataFrame, key: list[str], bin_chars: int = BIN) -> DataFrame:
    """Rows (key, span, first_token, last_token) of the spans that meet a token."""
    return overlapping(tokens, spans, key, bin_chars).groupBy(*key, "span").agg(F.min("pos").alias("first_token"), F.max("pos").alias("last_token"))
