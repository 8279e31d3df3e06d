"""Detection on streams of documents. Each document is a row and is tagged by itself, so the stream keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators.detect import document_word_categories, tagged_tokens


def read_documents(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of document files as they arrive in a folder."""
    return spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tag_stream(docs: DataFrame) -> DataFrame:
    """doc_id, pos, token, category, as for a table."""
    return tagged_tokens(docs)


def write_reports(docs: DataFrame, path: str, checkpoint: str):
    """Writes each batch's tagged words (split dates included) as Parquet. A batch that is run again replaces its own folder."""

    def batch(rows: DataFrame, n: int) -> None:
        document_word_categories(rows).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type) per window and type, with a watermark; an addition of this package."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), "event_type", "n")
