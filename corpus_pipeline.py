"""The corpus pipeline: each stage's result is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe_codec, decontaminate, language_id, line_dedup, near_dedup
from textloom.llm.common import Scratch, packed, small_side, text_key


#: Of texts, or whatever else a row holds, that go to a Python worker at once.  A batch is there in the worker and, beside
#: the heap, in the JVM, for each task; a worker is used again and keeps the memory of its largest batch.
BATCH_BYTES = "2m"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by their bytes (Spark's own bound is 64 MB), unless the session says something else."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    small_batches(spark)
    return language_id.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated lines; those of which nothing is left go."""
    made = line_dedup.deduplicate(docs)
    made = made.where((F.col("n_deleted") == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return near_dedup.deduplicate(docs).select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    keys = small_side(decontaminate.contaminated_keys(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    own = packed(docs).withColumn("own_id", F.col("row.doc_id")).withColumn("own_key", text_key(F.col("row.text")))
    kept = own.join(keys, own["own_id"].eqNullSafe(keys["doc_id"]) & (own["own_key"] == keys["key"]), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, and whether they decode to the text."""
    small_batches(spark)
    made = bpe_codec.encode(docs.select("doc_id", "lang", "source", "text"), decoded_col="decoded")
    text = F.coalesce("text", F.lit(""))
    return made.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), (F.col("decoded") == text).alias("round_trip"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmarks", benchmarks), ("tokens", tokens)]
#: SQL can express neither the language model nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
