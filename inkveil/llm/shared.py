"""Shared folders, inputs and small column helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that
    is unset and everything runs in one process (local tests) a folder of this machine is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        if not root and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = root or "file://" + tempfile.mkdtemp(prefix="inkveil-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Bytes of the Arrow batches that small_batches asks for, and Spark's name of that limit.
BATCH_BYTES = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts that are written inside go to Python workers in batches of about BATCH_BYTES, unless the session has a limit of its own.
    Spark's default lets 10,000 rows into one; for each task an executor holds a batch, and the bytes that it sends of it, outside its heap."""
    own = spark.conf.get(BATCH_LIMIT, None)
    if own is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(BATCH_LIMIT)


class Scratch:
    """Written tables of one operator run under the shared folder.

    A table that is written once and read again cuts lineage: a lost executor costs at
    most the tasks that read it, and ids given while writing never change afterwards.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.table(name, df)

    def table(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no returned DataFrame reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z only; null counts as empty. Pure-ASCII strings take the JVM's fast path."""
    body = F.coalesce(text, F.lit(""))
    plain = F.octet_length(body) == F.char_length(body)
    return F.when(plain, F.lower(body)).otherwise(F.translate(body, UPPER, LOWER))


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def unique_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether no id is null or occurs twice; reads only the id column."""
    return docs.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty()
