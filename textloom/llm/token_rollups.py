"""Token counts as delta-maintained rollups.

A change is a signed row: an insert adds a document and its tokens, a delete
takes them away, and a revision adds the difference of new and old count.  A
batch of changes is summed by source, language and tokenizer version and
written as an attempt into a folder of a ledger, named by the batch's id.  Of
the attempts that were written whole the last counts, so a retry or a replay
changes nothing, one that breaks off leaves what was committed, and a reader
never finds a batch missing meanwhile.  Totals are the sums over the ledger,
whose rows do not grow with the documents, and ``compact`` folds committed
batches into one.

Null sources and languages are groups of their own.  Null counts are 0.  An
empty batch leaves the totals as they are, and replaces what its id held.
Long texts are counted whole, repeated rows count each time, and columns
beside those named here are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.bpe_codec import encode_text
from textloom.llm.common import Scratch, vocabulary

KEYS = ["source", "lang", "tokenizer"]
_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, batch_id string"


def default_versions() -> dict[str, str]:
    return {v: vocabulary(f"{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}


def token_counts(docs: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """A row for each document and tokenizer version: doc_id, source, lang, bytes, tokenizer, tokens."""
    paths = versions or default_versions()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(4).to_pylist()]
            for name, path in paths.items():
                sizes = [len(encode_text(path, t)) for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([name] * len(sizes)), pa.array(sizes, pa.int64())], names=["doc_id", "source", "lang", "bytes", "tokenizer", "tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")
    return docs.select("doc_id", "source", "lang", size, "text").mapInArrow(count, "doc_id long, source string, lang string, bytes long, tokenizer string, tokens long")


class TokenLedger:
    """Committed batches of signed changes in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commit(self, batch_id: str, changes: DataFrame) -> None:
        """Commits a batch of rows (op, source, lang, tokenizer, tokens, old_tokens).

        ``op`` is insert, delete or revise; ``old_tokens`` matters for revise alone."""
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
        new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        tokens = F.when(F.col("op") == "revise", new - old).otherwise(sign * new)
        sums = changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))
        self._write(batch_id, sums)

    def _folders(self, path: str, start: str) -> list[str]:
        """Names of the folders in a folder that start so."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in files.listStatus(place) if s.getPath().getName().startswith(start)) if files.exists(place) else []

    def _attempts(self, batch: str, whole: bool) -> list[str]:
        """The paths of a batch's attempts in order; ``whole``: only those that were written to their end."""
        paths = [f"{self.path}/{batch}/{a}" for a in self._folders(f"{self.path}/{batch}", "attempt=")]
        return [p for p in paths if not whole or self._folders(p, "_SUCCESS")]

    def _write(self, batch_id: str, sums: DataFrame) -> None:
        """Adds an attempt to the batch's folder; an empty batch leaves a file without rows in it."""
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError("a batch's id is made of letters, digits, dots and hyphens")
        batch = f"batch_id={batch_id}"
        last = max((int(p.rpartition("=")[2]) for p in self._attempts(batch, whole=False)), default=0)
        sums.coalesce(1).write.parquet(f"{self.path}/{batch}/attempt={last + 1:06d}")
        # the one before stays for those who read it now
        whole = self._attempts(batch, whole=True)
        for path in whole[:-2]:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def batches(self) -> DataFrame:
        """The sums of all committed batches."""
        committed = [attempts[-1] for batch in self._folders(self.path, "batch_id=") if (attempts := self._attempts(batch, whole=True))]
        if not committed:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).option("basePath", self.path).parquet(*committed)

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version; groups without documents and tokens are left out."""
        sums = self.batches().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0))

    def compact(self, path: str, batch_id: str) -> TokenLedger:
        """A ledger at ``path`` with all batches folded into one."""
        out = TokenLedger(self.spark, path)
        out._write(batch_id, self.totals().select(*KEYS, "docs", "tokens"))
        return out


#: Bytes that a token is taken to have until it is counted.
PROVISIONAL_BYTES = 4


def maintained_totals(docs: DataFrame) -> DataFrame:
    """Totals of the documents that have tokens, kept up to date by four batches.

    Documents come with estimates.  Those of the first version are deleted and inserted with their counts, those of
    the second are revised to counts; documents without tokens are deleted; and the first batch is committed once
    more, which changes nothing."""
    scratch = Scratch(docs.sparkSession, "token-rollups")
    _, second = default_versions()
    counts = scratch.table(token_counts(docs))
    estimate = F.floor(F.col("bytes") / PROVISIONAL_BYTES).cast("long")
    is_second, none = F.col("tokenizer") == second, F.lit(0).cast("long")

    def change(rows: DataFrame, op: str, tokens: Column, old: Column = none) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), *KEYS, tokens.alias("tokens"), old.alias("old_tokens"))

    ledger = TokenLedger(docs.sparkSession, f"{scratch.root}/ledger")
    arrived = change(counts, "insert", estimate)
    ledger.commit("arrived", arrived)
    first = counts.where(~is_second)
    ledger.commit("replaced", change(first, "delete", estimate).unionByName(change(first, "insert", F.col("tokens"))))
    ledger.commit("counted", change(counts.where(is_second), "revise", F.col("tokens"), estimate))
    ledger.commit("withdrawn", change(counts.where("tokens = 0"), "delete", F.col("tokens")))
    ledger.commit("arrived", arrived)
    return ledger.totals()
