"""Binary ingestion, routing and page assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.functions import text as T
from inkveil.operators.geometry import default_score, filter_ocr_words, pad_faces, plausible_face, suppress_duplicates

# Limits of the inspection and page defaults.
SAMPLED_PAGES = 5
ITEMS_PER_PAGE = 8
DEFAULT_WIDTH, DEFAULT_HEIGHT = 800, 1000

#: Leading bytes of the accepted formats, in hex.
MAGIC = {"pdf": "255044462D", "jpeg": "FFD8FF", "png": "89504E470D0A1A0A", "webp": "52494646"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path with their kind (pdf, jpeg, png, webp) by content; others are left out."""
    head = F.hex(F.substring("content", 1, 12))
    kind = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        kind = F.when(head.startswith(magic) & ((F.lit(name) != "webp") | (F.substring(head, 17, 8) == "57454250")), name).otherwise(kind)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("kind", kind).filter("kind is not null").select("path", "length", "modificationTime", "kind", "content")


def route(files: DataFrame, inspected: DataFrame, choice: str = "auto") -> DataFrame:
    """document_type of each file: images as image; PDFs as text-pdf or image-pdf, by inspection or by choice ("text", "ocr")."""
    by_text = F.coalesce(F.col("is_text_dominant"), F.lit(False)) if choice == "auto" else F.lit(choice == "text")
    kind = F.when(F.col("kind") != "pdf", "image").when(by_text, "text-pdf").otherwise("image-pdf")
    return files.join(inspected, "doc_id", "left").withColumn("document_type", kind)


def inspect(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: total_pages, total_text_items (non-blank, of the first five pages), has_images and is_text_dominant (at least eight items per
    sampled page). pages: doc_id, page_num, has_image; items: doc_id, page_num, str."""
    first = pages.filter(F.col("page_num") <= SAMPLED_PAGES)
    some = items.filter((F.col("page_num") <= SAMPLED_PAGES) & (T.wide_trim(F.col("str")) != "")).groupBy("doc_id").agg(F.count("*").alias("n"))
    sampled = first.groupBy("doc_id").agg(F.count("*").alias("sampled"), F.bool_or("has_image").alias("has_images"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"))
    n = F.coalesce("n", F.lit(0))
    return total.join(sampled, "doc_id", "left").join(some, "doc_id", "left").select("doc_id", "total_pages", n.alias("total_text_items"), F.coalesce("has_images", F.lit(False)).alias("has_images"), F.coalesce(n / F.col("sampled") >= ITEMS_PER_PAGE, F.lit(False)).alias("is_text_dominant"))


def with_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Page dimensions; missing and zero ones are 800 x 1000."""
    known = lambda c, d: F.coalesce(F.when(c != 0, c), F.lit(d))
    return known(width, DEFAULT_WIDTH), known(height, DEFAULT_HEIGHT)


def image_pages(images: DataFrame) -> DataFrame:
    """One page per image of a batch (batch_id, file_order, name, width, height): page_index from 1, and its label."""
    batch = Window.partitionBy("batch_id")
    n = F.row_number().over(batch.orderBy("file_order", "name"))
    w, h = with_size(F.col("width"), F.col("height"))
    label = F.when(F.count("*").over(batch) > 1, F.concat(F.lit("Image "), n.cast("string"), F.lit(" ("), F.col("name"), F.lit(")"))).otherwise(F.col("name"))
    return images.select("batch_id", n.alias("page_index"), "name", label.alias("label"), w.alias("width"), h.alias("height"), F.lit(0).alias("rotation"))


def pages_with_words(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Page rows with their words as an array in word order; pages without words keep an empty one."""
    word = F.struct("word_index", "text", "x", "y", "width", "height", "confidence")
    held = words.withColumn("page_index", T.page_or_first(F.col("page_index"))).groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(word)).alias("words"))
    return pages.join(held, ["doc_id", "page_index"], "left").withColumn("words", F.coalesce("words", F.array().cast(held.schema["words"].dataType)))


def recognised_words(raw: DataFrame) -> DataFrame:
    """Word rows of recognised pages (doc_id, page_index, word_index, text, confidence, x0, y0, x1, y1): valid words only, pages numbered from 1."""
    return filter_ocr_words(raw.withColumn("page_index", T.page_or_first(F.col("page_index"))))


def detected_faces(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Face regions of pages from the candidates of all scans (doc_id, page_index, cand_index, scan, x, y, w, h, score): default scores, plausible sizes,
    without duplicates, padded within the page: doc_id, page_index, region_index, kind, x, y, w, h."""
    keys = ["doc_id", "page_index"]
    sized = candidates.join(pages.select(*keys, F.col("width").alias("img_w"), F.col("height").alias("img_h")), keys)
    scored = sized.withColumn("score", default_score(F.col("score"), F.col("scan"))).filter(plausible_face(F.col("img_w"), F.col("img_h")))
    kept = suppress_duplicates(scored, keys).join(pages.select(*keys, F.col("width").alias("img_w"), F.col("height").alias("img_h")), keys)
    padded = pad_faces(kept, F.col("img_w"), F.col("img_h"))
    return padded.select(*keys, F.col("cand_index").alias("region_index"), F.lit("face").alias("kind"), "x", "y", "w", "h")


def pages_without_faces(pages: DataFrame, faces: DataFrame) -> DataFrame:
    """Pages of documents that have no face regions yet: those that switching detection on scans."""
    return pages.join(faces.select("doc_id").distinct(), "doc_id", "left_anti")
