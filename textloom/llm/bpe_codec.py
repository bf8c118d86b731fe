"""Byte-pair encoding and decoding of whole texts, long ones by tree concatenation.

A text beyond ``long_chars`` is halved until the pieces fit, the pieces are
encoded in parallel, and neighbours are joined again as a tree.  At a join a
window of tokens from either side is encoded anew; it doubles until its first
tokens equal those of the left side and its last tokens those of the right
side.  From there on both sides are what one pass over the text would give,
for the split pattern looks ahead by few characters, and a token sequence of a
rank-ordered merge list is right exactly if each neighbouring pair of it is.

Null and empty texts have no tokens.  A long text that occurs in many documents
is encoded once, piece by piece, and its pieces are joined in one task, which
holds one text.  All other columns pass through unchanged, whatever their
names; one with the name of a new column is replaced.  An empty table gives an
empty result, and rows that repeat get the same result each.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import packed, split_pattern, vocabulary

#: Texts beyond this many characters are cut into halves.
LONG_CHARS = 32_768
#: Tokens at either end of a window that must agree.
AGREE = 4
#: Tokens first taken from either side of a join.
WINDOW = 16
#: Tokens that are Python numbers at a time while a text is decoded.
DECODED = 65_536
END_OF_TEXT = "<|endoftext|>"


def default_ranks() -> str:
    return vocabulary("byte_bpe_50k.tiktoken")


@functools.cache
def codec(path: str):
    """The encoding of a rank file, loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    end = max(ranks.values()) + 1
    return tiktoken.Encoding("ranks", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={END_OF_TEXT: end})


def encode_text(path: str, text: str) -> np.ndarray:
    return np.asarray(codec(path).encode_to_numpy(text, allowed_special="all"), dtype=np.int32)


def decode_ids(path: str, ids: np.ndarray) -> str:
    """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
    parts = (codec(path).decode_bytes(ids[at : at + DECODED].tolist()) for at in range(0, len(ids), DECODED))
    return b"".join(parts).decode(errors="replace")


def _aligned(data: bytes, at: int) -> bool:
    return at >= len(data) or data[at] & 0xC0 != 0x80


def join_encodings(path: str, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray], window: int = WINDOW) -> tuple[bytes, np.ndarray]:
    """Encoding of the concatenation of two encoded texts."""
    (a, x), (b, y) = left, right
    if not len(x) or not len(y):
        return a + b, x if len(x) else y
    sizes = codec(path).decode_tokens_bytes
    take = window
    while True:
        i, j = max(0, len(x) - take), min(len(y), take)
        head, tail = len(a) - sum(map(len, sizes(x[i:].tolist()))), sum(map(len, sizes(y[:j].tolist())))
        while i and not _aligned(a, head):
            i -= 1
            head -= len(sizes([int(x[i])])[0])
        while j < len(y) and not _aligned(b, tail):
            tail += len(sizes([int(y[j])])[0])
            j += 1
        middle = encode_text(path, (a[head:] + b[:tail]).decode())
        fits_left = i == 0 or (len(a) - head > 16 and np.array_equal(middle[:AGREE], x[i : i + AGREE]))
        fits_right = j == len(y) or (tail > 16 and np.array_equal(middle[-AGREE:], y[j - AGREE : j]))
        if fits_left and fits_right:
            return a + b, np.concatenate([x[:i], middle, y[j:]])
        take *= 2


def join_tree(path: str, parts: list[tuple[bytes, np.ndarray]], window: int = WINDOW) -> np.ndarray:
    """Joins encoded neighbours pairwise, level by level."""
    while len(parts) > 1:
        parts = [join_encodings(path, *parts[k : k + 2], window) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0][1] if parts else np.zeros(0, np.int32)


def halves(text: str, most: int) -> list[str]:
    """The text in order, halved until no piece has more than ``most`` characters."""
    if len(text) <= max(most, 1):
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], most) + halves(text[middle:], most)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def _small_batches(batches: Iterator[pa.RecordBatch], column: str, length: Callable[[pa.Array], pa.Array] = pc.binary_length, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of text (or whatever ``length`` counts), or one row."""
    for batch in batches:
        sizes = pc.fill_null(length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for k, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", ranks: str | None = None, long_chars: int = LONG_CHARS, decoded_col: str | None = None) -> DataFrame:
    """Adds ``ids_col``: the token ids of the whole text.

    With ``decoded_col`` the ids are decoded as well, in the task that made them, so that one Python worker does both."""
    path, docs = ranks or default_ranks(), docs.drop(ids_col, *([decoded_col] if decoded_col else []))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small_batches(batches, text_col):
            ids = [encode_text(path, t or "") for t in batch.column(text_col).to_pylist()]
            made = _with_column(batch, ids_col, _lists(ids))
            yield _with_column(made, decoded_col, pa.array([decode_ids(path, i) for i in ids], pa.string())) if decoded_col else made

    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])]
    schema = T.StructType([*docs.schema.fields, *added])
    text, length = F.col(f"`{text_col}`"), F.char_length(F.col(f"`{text_col}`"))
    is_long = F.coalesce(length > long_chars, F.lit(False))
    short = docs.where(~is_long).mapInArrow(each, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, whole in zip(batch.column("key"), batch.column("whole")):
                pieces = halves(whole.as_py(), long_chars)
                yield pa.RecordBatch.from_pydict({"key": pa.array([key.as_py()] * len(pieces)), "part": pa.array(range(len(pieces)), pa.int32()), "piece": pieces})

    def each_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small_batches(batches, "piece"):
            yield _with_column(batch, "ids", _lists([encode_text(path, t) for t in batch.column("piece").to_pylist()]))

    def whole(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["piece"].to_pylist(), (v.values.to_numpy() for v in table["ids"])), key=lambda r: r[0])
        ids = join_tree(path, [(piece.encode(), part) for _, piece, part in rows])
        return pa.table({"key": table["key"][:1], "ids": _lists([ids])})

    long = packed(docs.where(is_long)).withColumn("key", F.sha2(F.col(f"row.`{text_col}`"), 256))
    pieces = long.select("key", F.col(f"row.`{text_col}`").alias("whole")).mapInArrow(cut, "key string, part int, piece string")
    # one copy of each piece; it is also dealt by piece, so that the halves of one text are encoded in many tasks
    pieces = pieces.groupBy("key", "part").agg(F.first("piece").alias("piece"))
    joined = pieces.mapInArrow(each_piece, "key string, part int, piece string, ids array<int>").groupBy("key").applyInArrow(whole, "key string, ids array<int>")
    long = long.join(joined, "key").select(*[F.col(f"row.`{c}`") for c in docs.columns], F.col("ids").alias(ids_col))
    return short.unionByName(decode(long, ids_col, decoded_col, path) if decoded_col else long)


def decode(encoded: DataFrame, ids_col: str = "token_ids", text_col: str = "decoded", ranks: str | None = None) -> DataFrame:
    """Adds ``text_col``: the text of the token ids; bytes that are no UTF-8 become U+FFFD."""
    path, encoded = ranks or default_ranks(), encoded.drop(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small_batches(batches, ids_col, pc.list_value_length, 1 << 19):
            texts = [decode_ids(path, v.values.to_numpy()) if v.is_valid else "" for v in batch.column(ids_col)]
            yield _with_column(batch, text_col, pa.array(texts, pa.string()))

    return encoded.mapInArrow(each, T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())]))


def digests(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """One row per document: number of tokens, and hashes of the ids and of the decoded text."""
    made = encode(docs.select("doc_id", "text"), ranks=ranks, decoded_col="decoded")
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return made.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
