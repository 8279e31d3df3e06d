"""Grouped reports of redacted documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions import text as T


def word_frequencies(redacted: DataFrame) -> DataFrame:
    """Per document: trimmed texts with n and first_index; the order is n descending, first_index ascending."""
    rows = redacted.withColumn("text", T.wide_trim(F.col("text"))).filter("text != ''")
    return rows.groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.min("word_index").alias("first_index"))


def ranked_words(redacted: DataFrame) -> DataFrame:
    """word_frequencies with their rank in the document, from 1."""
    order = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "first_index")
    return word_frequencies(redacted).withColumn("rank", F.row_number().over(order))


def export_report(words: DataFrame, regions: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """export_stats with the document's type, its colour by name, and the redacted words in order (an array of trimmed texts, with repeats)."""
    some = words.filter("redacted").select("doc_id", "word_index", T.wide_trim(F.col("text")).alias("text")).filter("text != ''")
    listed = some.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "text"))), lambda x: x["text"]).alias("redacted_words"))
    named = documents.select("doc_id", "document_type", T.colour_name(F.col("colour")).alias("colour"))
    out = export_stats(words, regions, pages).join(named, "doc_id", "left").join(listed, "doc_id", "left")
    return out.withColumn("redacted_words", F.coalesce("redacted_words", F.array().cast("array<string>")))


def export_stats(words: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Per document of pages: n_pages, n_words, n_redacted, n_faces and n_manual. words has redacted, regions has kind."""
    p = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    w = words.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count_if("redacted").alias("n_redacted"))
    r = regions.groupBy("doc_id").agg(F.count_if(F.col("kind") == "face").alias("n_faces"), F.count_if(F.col("kind") == "manual").alias("n_manual"))
    counts = ["n_words", "n_redacted", "n_faces", "n_manual"]
    return p.join(w, "doc_id", "left").join(r, "doc_id", "left").select("doc_id", "n_pages", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def page_extent(pages: DataFrame, gap: int = 24, rim: int = 160) -> DataFrame:
    """Layout of a document's pages: max_width, and total_height with gaps and rim. Missing sizes are 800 x 1000."""
    width = F.coalesce(F.when(F.col("width") != 0, F.col("width")), F.lit(800))
    height = F.coalesce(F.when(F.col("height") != 0, F.col("height")), F.lit(1000))
    return pages.groupBy("doc_id").agg(F.max(width).alias("max_width"), (F.sum(height) + gap * (F.count("*") - 1) + rim).alias("total_height"))


def original_size(pages: DataFrame, content: str = "content") -> DataFrame:
    return pages.groupBy("doc_id").agg(F.sum(F.octet_length(content)).alias("n_bytes"))
