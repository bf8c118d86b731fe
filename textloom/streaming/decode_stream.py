"""Decoding of token streams: text is given out as soon as its tokens make whole characters.

``decode_steps`` works on a table, ``decode_streams`` on a stream, where each
key's state is the tokens that may still change the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.plans.pipeline import TextPipeline

_REPLACEMENT = chr(0xFFFD)


class DecodeStream:
    """One stream: ``step`` takes an id, or several, and gives the text that became certain, or None."""

    def __init__(self, pipeline: TextPipeline, skip_special_tokens: bool = False, ids: list[int] | None = None):
        self.pipeline, self.skip = pipeline, skip_special_tokens
        self.ids: list[int] = list(ids or [])
        self.prefix, self.prefix_index = "", 0
        if self.ids:
            self._settle(self._text())

    def _text(self) -> str:
        return self.pipeline.decode_local(self.ids, self.skip)

    def _settle(self, text: str) -> None:
        """Forgets tokens that later ones cannot change."""
        if text.endswith(_REPLACEMENT):
            return
        self.ids = self.ids[self.prefix_index :]
        self.prefix, self.prefix_index = self._text(), len(self.ids)

    def step(self, new: int | list[int]) -> str | None:
        self.ids += new if isinstance(new, list) else [new]
        text = self._text()
        if len(text) <= len(self.prefix) or text.endswith(_REPLACEMENT):
            return None
        if not text.startswith(self.prefix):
            raise ValueError("the decoded text does not go on from what was given out")
        out = text[len(self.prefix) :]
        self._settle(text)
        return out

    @property
    def state(self) -> tuple[list[int], str, int]:
        return self.ids, self.prefix, self.prefix_index

    @state.setter
    def state(self, value: tuple[list[int], str, int]) -> None:
        self.ids, self.prefix, self.prefix_index = list(value[0]), value[1], value[2]


def decode_steps(tokens: DataFrame, pipeline: TextPipeline, skip_special_tokens: bool = False) -> DataFrame:
    """Rows (stream_id, pos, id) with the text that each step gave out, or null."""
    shared = tokens.sparkSession.sparkContext.broadcast(pipeline)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stream = None, None
        for rows in batches:
            out = []
            for k, i in zip(rows.column("stream_id").to_pylist(), rows.column("id").to_pylist()):
                if stream is None or k != key:
                    key, stream = k, DecodeStream(shared.value, skip_special_tokens)
                out.append(stream.step(i))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.string())], names=[*rows.schema.names, "text"])

    # a stream's rows follow one another in one partition, batch by batch, so a long one need not fit in memory
    rows = tokens.select(F.col("stream_id").cast("long"), F.col("pos").cast("long"), F.col("id").cast("long"))
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "pos").mapInArrow(steps, "stream_id long, pos long, id long, text string")


def decode_streams(tokens: DataFrame, pipeline: TextPipeline, skip_special_tokens: bool = False) -> DataFrame:
    """The same on a stream; within a micro-batch, tokens are taken by pos."""
    shared = tokens.sparkSession.sparkContext.broadcast(pipeline)

    def steps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stream = DecodeStream(shared.value, skip_special_tokens)
        if state.exists:
            stream.state = state.get
        rows = pd.concat(list(batches)).sort_values("pos")
        out = rows.assign(stream_id=key[0], text=[stream.step(int(i)) for i in rows["id"]])[["stream_id", "pos", "id", "text"]]
        state.update(stream.state)
        yield out

    grouped = tokens.select("stream_id", "pos", "id").groupBy("stream_id")
    return grouped.applyInPandasWithState(steps, "stream_id long, pos long, id long, text string", "ids array<long>, prefix string, prefix_index int", "append", GroupStateTimeout.NoTimeout)


_STATE = "ids array<long>, prefix string, prefix_index int"


def decode_streams_from(tokens: DataFrame, pipeline: TextPipeline, prefills: DataFrame | None = None, skip_special_tokens: bool = False, idle_ms: int | None = None) -> DataFrame:
    """As ``decode_streams``, where streams may begin with ids that were given before: rows (stream_id, ids) of ``prefills``.

    These ids are context and give no text themselves.  A stream that is idle for ``idle_ms`` is forgotten: a later
    token of it begins anew.  Needs the RocksDB state store."""

    # the processor is also made once on the driver, where broadcasts are not loaded: it carries the pipeline itself
    class Steps(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.held = handle.getValueState("stream", _STATE, idle_ms)

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
            stream = DecodeStream(pipeline, skip_special_tokens)
            if self.held.exists():
                ids, prefix, index = self.held.get()
                stream.state = [int(i) for i in ids], prefix, index
            batch = pd.concat(list(rows)).sort_values("pos")
            batch = batch.assign(stream_id=key[0], text=[stream.step(int(i)) for i in batch["id"]])
            self._keep(stream)
            yield batch[["stream_id", "pos", "id", "text"]]

        def handleInitialState(self, key: tuple, row: pd.DataFrame, timers: object) -> None:
            self._keep(DecodeStream(pipeline, skip_special_tokens, [int(i) for i in row["ids"].iloc[0]]))

        def _keep(self, stream: DecodeStream) -> None:
            ids, prefix, index = stream.state
            self.held.update(([int(i) for i in ids], prefix, index))

        def close(self) -> None:
            pass

    grouped = tokens.select("stream_id", "pos", "id").groupBy("stream_id")
    first = prefills.select("stream_id", "ids").groupBy("stream_id") if prefills is not None else None
    mode = "ProcessingTime" if idle_ms else "None"
    return grouped.transformWithStateInPandas(Steps(), "stream_id long, pos long, id long, text string", "Append", mode, first)


def encode_stream(texts: DataFrame, pipeline: TextPipeline, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Encoding has no state: a stream's rows are encoded as a table's are."""
    return pipeline.encode_ids(texts, text_col, ids_col)
