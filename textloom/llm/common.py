"""Helpers shared by the pipeline operators: words, document keys and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words: all of ASCII but letters and digits.
BETWEEN_WORDS = r"[\x00-/:-@\[-`{-\x7f]+"


def lowered(text: Column) -> Column:
    """Text with A-Z lower-cased and no other character changed."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """Words (runs of ASCII letters and digits and of all characters beyond ASCII), A-Z lower-cased; null text has none."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def text_key(text: Column) -> Column:
    """64 bits that, beside the document id, name one version of a document."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def vocabulary(name: str) -> str:
    """The file of a public tokenizer's vocabulary; only this function and the next know where these are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The pattern by which those vocabularies split texts."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share.  A local one is made only where none is set and Spark is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="textloom-")
    return f"file://{_local}"


_local: str | None = None


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    As a context it removes its tables at the end, so nothing that is returned may read them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/textloom/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def write(self, df: DataFrame) -> str:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def table(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and returns what was written."""
        return self.spark.read.schema(df.schema).parquet(self.write(df))

    def drop(self, path: str | None = None) -> None:
        """Removes a table, or all of them, that nothing reads any longer."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path or self.root)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of (id, key) that may be broadcast; they take a few megabytes.
BROADCAST_ROWS = 65_536


def small_side(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has few; else the join shuffles."""
    return F.broadcast(table) if table.count() <= rows else table


#: A key with more than this share of all rows is hot; there are at most as many such keys as shares.
HOT_SHARE = 1 / 1024
#: Parts that the rows of a hot key are dealt into.
SALTS = 32


def is_hot(n: Column, total: int) -> Column:
    return n > total * HOT_SHARE


def salted_join(rows: DataFrame, side: DataFrame, keys: list[str], spread: list[str], total: int | None = None, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Joins ``rows`` with a table of keys and ``n``, the number of rows that each key has.

    The rows of hot keys are dealt into ``SALTS`` parts by the columns ``spread``, and the side's rows of these keys
    are repeated for each part.  At most 1 / ``HOT_SHARE`` keys can be hot, so these alone are broadcast; the join
    itself is a merge join at every size.  The side's ``n`` does not stay; ``total`` is the number of rows, if it is
    known; ``counts`` holds keys and ``n`` alone, where that is cheaper to read than the side."""
    counts = side if counts is None else counts
    if total is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
    hot, salt = free_name(rows, "hot"), free_name(rows, "salt")
    wanted = is_hot(F.col("n"), total)
    marks = F.broadcast(counts.where(wanted).select(*keys, F.lit(True).alias(hot)).distinct())
    dealt = rows.join(marks, keys, "left").withColumn(salt, F.when(F.col(hot), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0)).drop(hot)
    parts = F.when(wanted, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    repeated = side.withColumn(salt, F.explode(parts)).drop("n")
    return dealt.join(repeated.hint("merge"), [*keys, salt], how).drop(salt)


#: 64-bit words of a filter of keys: a broadcast of a few megabytes at most, whatever the number of keys.
FILTER_WORDS = 1 << 18


def key_filter(keys: DataFrame, *columns: str) -> DataFrame:
    """A bitmap of bounded size, (word, bits), in which each key's hash sets a bit."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(FILTER_WORDS * 64))
    return keys.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 AS int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def may_hold(rows: DataFrame, bitmap: DataFrame, name: str, *columns: Column) -> DataFrame:
    """Adds ``name``: false only for rows whose key is not in the bitmap.  The fuller the bitmap, the more others pass."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(FILTER_WORDS * 64))
    word, bits = free_name(rows, "word"), free_name(rows, "bits")
    known = F.broadcast(bitmap.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    at = free_name(rows, "bit")
    met = rows.withColumn(at, bit).withColumn(word, F.shiftright(at, 6)).join(known, word, "left")
    return met.withColumn(name, F.coalesce(F.bit_get(F.col(bits), (F.col(at) % 64).cast("int")) == 1, F.lit(False))).drop(at, word, bits)


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns as one struct, beside which new columns cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
