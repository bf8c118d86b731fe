"""Text sources and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: str | None = None


def tasks(spark: SparkSession) -> int:
    """How many parts a table is dealt into that costs much time for its size."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Checkpoints:
    """Tables written to the folder in ``spark.checkpoint.dir``, which all machines share; they cut lineage."""

    def __init__(self, spark: SparkSession):
        global _local
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            master = spark.sparkContext.master
            if not master.startswith("local[") and master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            _local = _local or tempfile.mkdtemp(prefix="textloom-")
            root = f"file://{_local}"
        self.root = f"{root.rstrip('/')}/textloom/{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def spread(self, df: DataFrame, key: str) -> DataFrame:
        """The same, dealt by a key among all cores and not put together where it is small, for work in rounds."""
        return self.table(df.repartition(tasks(self.spark), key))

    def drop(self) -> None:
        """Removes the tables, which nothing may read any longer."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row (text) for each line of the files, with its line end; the last line of a file may have none.

    Files are split among tasks like any text.  Whether a file ends within a line shows in its size."""
    file = F.col("_metadata")
    lines = spark.read.text(paths, lineSep="\n").select("value", file["file_path"].alias("path"), file["file_size"].alias("size"), F.struct(file["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
    with_ends = F.sum(F.octet_length("value") + 1)
    cut = lines.groupBy("path").agg(with_ends.alias("bytes"), F.first("size").alias("size"), F.max("at").alias("at")).where("bytes > size").select("path", "at", F.lit("").alias("end"))
    return lines.join(cut, ["path", "at"], "left").select(F.concat("value", F.coalesce("end", F.lit("\n"))).alias("text"))


def batches_of_texts(df: DataFrame, column: str) -> DataFrame:
    """Rows (text) of a column that holds texts or arrays of texts."""
    kind = dict(df.dtypes)[column]
    return df.select((F.explode(column) if kind.startswith("array") else F.col(column)).alias("text"))
