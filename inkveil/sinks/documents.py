"""Redacted text and rectangles of text documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import text as T
from inkveil.operators import detect
from inkveil.operators.geometry import to_points


def scrub_documents(docs: DataFrame, text_col: str = "text", secrets: Column | None = None) -> DataFrame:
    """docs with the sensitive words of each text (or the row's own array of secrets) blanked wherever they occur in it. Found and blanked
    within the row, whatever its id; texts without any are not touched."""
    text = F.col(text_col)
    blanked = T.let(detect.secrets(text) if secrets is None else secrets, lambda s: F.when(F.size(s) > 0, T.scrub(text, s)))
    return docs.withColumn(text_col, F.coalesce(blanked, text))


def redaction_rects(words: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Rectangles in points of effective words (with margin) and of regions (without): doc_id, page_index, kind, pdf_x, pdf_y, pdf_w, pdf_h."""
    sizes = pages.select("doc_id", "page_index", F.col("width").alias("page_w"), F.col("height").alias("page_h"))
    out = ["doc_id", "page_index", "kind", "pdf_x", "pdf_y", "pdf_w", "pdf_h"]
    placed = lambda rows: rows.withColumn("page_index", T.page_or_first(F.col("page_index"))).join(sizes, ["doc_id", "page_index"])
    w = to_points(placed(words.filter("effective")).withColumn("kind", F.lit("word")), F.col("page_w"), F.col("page_h")).select(*out)
    boxes = placed(regions.withColumnsRenamed({"w": "width", "h": "height"}))
    return w.unionByName(to_points(boxes, F.col("page_w"), F.col("page_h"), margin=False).select(*out))
