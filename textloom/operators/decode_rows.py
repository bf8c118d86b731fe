"""Decoding as joins: a row for each id, a table of the vocabulary, and no Python.

Ids meet the vocabulary; those without a token, and special ones if they are to
be skipped, are left out.  What is left of a row's tokens is joined in order, by
stretches first, so rows of single tokens are shuffled once and sorted as short
lists.  Neighbouring byte tokens (``<0xNN>``) are runs; they travel as a mark
and their digits, and in the joined text a run becomes its text, or a U+FFFD for
each byte if it is no UTF-8.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a vocabulary up to which it is broadcast, of at most so many characters in all.
BROADCAST_TOKENS, BROADCAST_CHARS = 1_000_000, 16_000_000
#: Places whose tokens are joined at once.
STRETCH = 1 << 12
_BYTE = "^<0x[0-9A-Fa-f]{2}>$"


def id_rows(rows: DataFrame, key: list[str], ids_col: str = "ids") -> DataFrame:
    """Rows (key, pos, id) of arrays of ids."""
    return rows.select(*key, F.posexplode(ids_col).alias("pos", "id"))


def token_of_ids(ids: DataFrame, vocabulary: DataFrame, key: list[str], skip_special_tokens: bool = True) -> DataFrame:
    """Rows (key, pos, token): ``vocabulary`` has id, token and may have special."""
    if skip_special_tokens and "special" in vocabulary.columns:
        vocabulary = vocabulary.where(~F.coalesce(F.col("special"), F.lit(False)))
    known = vocabulary.select("id", "token")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("token")), F.lit(0)).alias("chars")).first()
    if size["n"] <= BROADCAST_TOKENS and size["chars"] <= BROADCAST_CHARS:
        known = F.broadcast(known)
    return ids.select(*key, "pos", "id").join(known, "id").select(*key, "pos", "token")


def byte_runs(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, pos, token) in which each run of byte tokens is one text; neighbours are those left, by pos."""
    byte = tokens.withColumn("is_byte", F.col("token").rlike(_BYTE))
    order = Window.partitionBy(*key).orderBy("pos")
    numbered = byte.withColumn("among_all", F.row_number().over(order)).withColumn("bytes_before", F.sum(F.col("is_byte").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # other tokens are runs of their own; a run of bytes is known by what is not a byte before it
    run = F.when(F.col("is_byte"), F.col("among_all") - F.col("bytes_before")).otherwise(-F.col("among_all"))
    held = numbered.withColumn("run", run).groupBy(*key, "run").agg(F.min("pos").alias("pos"), F.first("is_byte").alias("is_byte"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("parts"))
    data = F.unhex(F.array_join(F.transform("parts", lambda p: F.substring(p["token"], 4, 2)), ""))
    text = F.when(~F.col("is_byte"), F.col("parts")[0]["token"]).otherwise(F.coalesce(F.try_validate_utf8(data.cast("string")), F.repeat(F.lit(chr(0xFFFD)), F.size("parts"))))
    return held.select(*key, "pos", text.alias("token"))


def _marked(token: Column, apart: bool) -> Column:
    """A vocabulary's token as it travels: bytes as a mark and two digits, others without that mark in them, and behind one if they must stay ``apart`` or are empty."""
    plain = F.replace(F.replace(token, F.lit("\x01"), F.lit("\x01Y")), F.lit("\x00"), F.lit("\x01Z"))
    return F.when(token.rlike(_BYTE), F.concat(F.lit("\x00B"), F.substring(token, 4, 2))).when(F.lit(apart) | (token == ""), F.concat(F.lit("\x00S"), plain)).otherwise(plain)


def _spelled(piece: Column) -> Column:
    """A run of bytes, or what stands between runs, without marks."""
    text = F.try_validate_utf8(F.unhex(F.replace(piece, F.lit("\x00B"), F.lit(""))).cast("string"))
    plain = F.replace(F.replace(F.replace(piece, F.lit("\x00S"), F.lit("")), F.lit("\x01Z"), F.lit("\x00")), F.lit("\x01Y"), F.lit("\x01"))
    return F.when(piece.startswith("\x00B"), F.coalesce(text, F.repeat(F.lit(chr(0xFFFD)), (F.length(piece) / 4).cast("int")))).otherwise(plain)


def decoded_rows(ids: DataFrame, vocabulary: DataFrame, key: list[str], skip_special_tokens: bool = True, spoken: Callable[[Column], Column] | None = None, separator: str = "") -> DataFrame:
    """Rows (key, text) of rows (key, pos, id); ``spoken`` changes each token, as in a replacement of a space sign.

    Keys without a known token have no row."""
    apart = spoken is not None or separator != ""
    tokens = token_of_ids(ids, vocabulary.withColumn("token", _marked(F.col("token"), apart)), key, skip_special_tokens)

    def joined(rows: DataFrame, by: list[str]) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("pos", "token")))
        return rows.groupBy(*by).agg(parts.alias("parts")).select(*by, F.array_join(F.transform("parts", lambda p: p["token"]), "").alias("token"))

    # a long text is joined by stretches first: a list of single tokens takes many times the room of their text
    stretches = joined(tokens.withColumn("__stretch", F.expr(f"pos div {STRETCH}")), [*key, "__stretch"])
    whole = joined(stretches.withColumnRenamed("__stretch", "pos"), key)
    pieces = F.regexp_extract_all("token", F.lit(r"(?:\x00B[0-9A-Fa-f]{2})++|\x00S[^\x00]*+|[^\x00]++"), F.lit(0))
    return whole.select(*key, F.array_join(F.transform(pieces, lambda p: spoken(_spelled(p)) if spoken else _spelled(p)), separator).alias("text"))
