"""Two-pass external shuffle into shards.

Pass one scatters the records by a seeded hash of key and row number into
buckets that fit in a task's memory, and writes them with their bucket; equal
records part like others.  Pass two shuffles each bucket by Fisher-Yates and
gives every record its place.  Buckets follow one another, so a record's place
in the whole order is its bucket's offset, a running sum over the buckets'
counts, plus its place in the bucket, and shards are equal ranges of that
order: their row counts differ by one at most.

As row numbers depend on how the input is split, another split gives another
order.  Null ids and null texts are records like any other, a very long text
is one record of its bucket, and rows that repeat are records of their own.
Columns named shard or slot are replaced; any other names may occur.  An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import Scratch, packed

#: Bytes of records that a bucket holds, about.
BUCKET_BYTES = 16 << 20
#: Buckets that a task of the second pass takes one after the other, about.
BUCKETS_A_TASK = 8


def record_size(text: str = "text"):
    """UTF-8 bytes of the text, none if it is null, plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation: place i changes with a random place from i on."""
    at = np.arange(n)
    picks = np.random.default_rng(seed).integers(np.arange(n), n) if n else []
    for i, j in enumerate(picks):
        at[i], at[j] = at[j], at[i]
    return at


def external_shuffle(records: DataFrame, shards: int = 8, seed: int = 17, key_cols: tuple[str, ...] = ("doc_id", "text"), text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Adds ``shard`` and ``slot`` (from 0, without gaps) to shuffled records."""
    spark, records = records.sparkSession, records.drop("shard", "slot")
    scratch = Scratch(spark, "sharding")
    total = records.agg(F.sum(record_size(f"`{text_col}`"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    keys = [*(F.col(f"row.`{c}`") for c in key_cols), F.monotonically_increasing_id()]
    bucket = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(buckets)).alias("bucket")
    # written, for row numbers hold for one reading of the input only
    dealt = scratch.table(packed(records).select("row", bucket, F.xxhash64(F.lit(seed + 1), *keys).alias("order")))
    rows = dealt.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // BUCKETS_A_TASK)
    met = dealt.repartition(tasks, "bucket").join(_offsets(dealt).hint("merge"), "bucket")

    def shuffle_bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending")])
        table = table.take(pa.array(fisher_yates(table.num_rows, [seed, key[0].as_py()])))
        place = table["before"].to_numpy() + np.arange(table.num_rows)
        # the first rows % shards shards hold one row more
        least, more = divmod(rows, shards)
        edge = more * (least + 1)
        shard = np.where(place < edge, place // (least + 1), more + (place - edge) // max(least, 1))
        slot = place - (shard * least + np.minimum(shard, more))
        return pa.table({"row": table["row"], "shard": pa.array(shard, pa.int32()), "slot": pa.array(slot, pa.int64())})

    schema = T.StructType([dealt.schema["row"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    placed = met.groupBy("bucket").applyInArrow(shuffle_bucket, schema)
    return placed.select(*[F.col(f"row.`{c}`") for c in records.columns], "shard", "slot")


def _offsets(dealt: DataFrame, span: int = 1024) -> DataFrame:
    """How many rows the buckets before each bucket hold, summed within spans of buckets and over the spans."""
    counts = dealt.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("bucket") / F.lit(span)))
    earlier = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.groupBy("span").agg(F.sum("n").alias("n")).select("span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(spans, "span").select("bucket", (F.col("start") + F.col("inside")).alias("before"))


def write_shards(shuffled: DataFrame, path: str, order_cols: tuple[str, ...] = ("shard", "slot")) -> None:
    """Writes shuffled records below ``path``, a folder for each shard, in the order of their slots."""
    shuffled.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols).write.partitionBy("shard").parquet(path)


def places(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its text's crc32, and its place under the law ``rows``."""
    out = external_shuffle(docs.select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    return out.select("doc_id", record_size().alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
