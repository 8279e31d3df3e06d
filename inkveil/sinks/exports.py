"""Redacted files of whole documents, by document type and export choice.

Documents are independent: pages, text items, words and regions of a document meet by its doc_id, and each document is written by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import text as T
from inkveil.operators import geometry
from inkveil.sinks import archives, rasters
from inkveil.sinks.documents import redaction_rects

#: Page scales of word boxes in text PDFs and recognised pages.
TEXT_SCALE, SCAN_SCALE = geometry.TEXT_SCALE, 2.0


def boxes_of(words: DataFrame, regions: DataFrame) -> DataFrame:
    """What a raster export fills, in page pixels: effective words, then regions: doc_id, page_index, x, y, width, height."""
    page = T.page_or_first(F.col("page_index")).alias("page_index")
    w = words.filter("effective").select("doc_id", page, "x", "y", "width", "height")
    return w.unionByName(regions.select("doc_id", page, "x", "y", F.col("w").alias("width"), F.col("h").alias("height")))


def scrubbed_items(items: DataFrame, words: DataFrame) -> DataFrame:
    """Text items (doc_id, page_index, str and more) with every effective word of the document blanked."""
    secret = F.array_distinct(F.collect_list(T.wide_trim(F.col("text")))).alias("secrets")
    found = words.filter("effective").groupBy(F.col("doc_id").alias("s_id")).agg(secret)
    rows = items.join(found, F.col("doc_id").eqNullSafe(F.col("s_id")), "left")
    return rows.withColumn("str", F.when(F.col("secrets").isNull(), F.col("str")).otherwise(T.scrub(F.col("str"), F.col("secrets")))).drop("s_id", "secrets")


def text_pdf(pages: list[tuple[float, float, list, list]]) -> bytes:
    """A PDF of drawn text: per page width and height in points, items (text, x, y, size; origin at the bottom left) and black rectangles (x, y, w, h)."""
    if not pages:
        raise ValueError("a PDF needs a page")
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for width, height, items, rects in pages:
        drawn = []
        for text, x, y, size in items:
            body = text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            drawn.append(b"BT /F %.4f Tf %.4f %.4f Td (%s) Tj ET" % (size, x, y, body))
        drawn += [b"0 0 0 rg"] + [b"%.4f %.4f %.4f %.4f re f" % tuple(r) for r in rects]
        body = zlib.compress(b"\n".join(drawn))
        n = len(objects) + 1
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.4f %.4f] /Resources << /Font << /F 3 0 R >> >> /Contents %d 0 R >>" % (width, height, n + 1))
        objects.append(b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
        kids.append(b"%d 0 R" % n)
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    return rasters.pdf_file(objects)


def redact_text_pdfs(pages: DataFrame, items: DataFrame, words: DataFrame, regions: DataFrame) -> DataFrame:
    """One PDF per document of text PDFs: its items without the effective words, and rectangles over words and regions: doc_id, content.

    pages: doc_id, page_index, width, height in points; items as of a text decoder (str, tx, ty, height); words and regions in pixels at 1.5.
    """
    rects = redaction_rects(words, regions, pages).groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(F.array("pdf_x", "pdf_y", "pdf_w", "pdf_h"))).alias("rects"))
    drawn = F.struct("item_index", "str", "tx", "ty", "height")
    held = scrubbed_items(items, words).groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(drawn)).alias("items"))
    rows = pages.join(held, ["doc_id", "page_index"], "left").join(rects, ["doc_id", "page_index"], "left").select("doc_id", "page_index", "width", "height", "items", "rects")

    def make(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in f.sort_values("page_index").itertuples(index=False):
            drawn = [(x["str"], x["tx"], x["ty"], x["height"]) for x in (r.items if r.items is not None else [])]
            out.append((r.width, r.height, drawn, [list(x) for x in (r.rects if r.rects is not None else [])]))
        return pd.DataFrame({"doc_id": [f["doc_id"].iloc[0]], "content": [text_pdf(out)]})

    return rows.groupBy("doc_id").applyInPandas(make, "doc_id long, content binary")


def filled_rasters(pages: DataFrame, words: DataFrame, regions: DataFrame, colour: tuple[int, int, int] = (0, 0, 0), scale: float = 1.0) -> DataFrame:
    """pages (doc_id, page_index, width, height, data) with the boxes of words and regions filled; scale is that of the raster against the boxes."""
    held = boxes_of(words, regions).groupBy("doc_id", "page_index").agg(F.collect_list(F.array("x", "y", "width", "height")).alias("boxes"))
    rows = pages.join(held, ["doc_id", "page_index"], "left").select("doc_id", "page_index", "width", "height", "data", "boxes")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for r in f.itertuples(index=False):
                raster = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
                made.append(rasters.fill(raster, [] if r.boxes is None else list(r.boxes), colour, scale).tobytes())
            yield f.drop(columns=["boxes"]).assign(data=made)

    return rows.mapInPandas(run, "doc_id long, page_index int, width int, height int, data binary")


def _png_pages(pages: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [rasters.png(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)) for r in f.itertuples(index=False)]
            yield pd.DataFrame({"doc_id": f["doc_id"], "page_index": f["page_index"], "content": made})

    return pages.select("doc_id", "page_index", "width", "height", "data").mapInPandas(run, "doc_id long, page_index int, content binary")


def redact_scanned_pdfs(pages: DataFrame, words: DataFrame, regions: DataFrame, colour: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """One flat PDF per document from rasters at the output scale, with boxes in recognition pixels filled: doc_id, content."""
    return rasters.merge_pdf(filled_rasters(pages, words, regions, colour, rasters.OUTPUT_SCALE / SCAN_SCALE), rasters.OUTPUT_SCALE)


def redact_images(pages: DataFrame, words: DataFrame, regions: DataFrame, choice: str = "image-max", colour: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """One file per document of images: a PNG of its only page, a merged PDF, or a ZIP of PNGs, by export choice: doc_id, content.

    Without an encoder for JPEG here, images are PNG whatever the choice of quality.
    """
    filled = filled_rasters(pages, words, regions, colour)
    kind = rasters.export_extension(choice)
    if kind == ".pdf":
        return rasters.merge_pdf(filled)
    files = _png_pages(filled)
    if kind == ".zip":
        number = F.col("page_index").cast("string")
        named = files.select("doc_id", "page_index", F.concat(F.lit("redacted-image-"), number, F.lit(".png")).alias("name"), "content")
        return archives.archives(named, "doc_id", "page_index")
    return files.groupBy("doc_id").agg(F.min_by("content", "page_index").alias("content"))


def export_name(name: Column, document_type: Column, pages: Column, choice: str | None = None) -> Column:
    """The file name of an export; images that several pages merge take the extension of the choice."""
    custom = None if choice is None else F.when(document_type == "image", F.lit({".jpg": ".png"}.get(rasters.export_extension(choice), rasters.export_extension(choice)))).otherwise(".pdf")
    return T.final_name(name, document_type, pages, custom)


def export_documents(documents: DataFrame, pages: DataFrame, items: DataFrame, words: DataFrame, regions: DataFrame, image_choice: str | None = None) -> DataFrame:
    """The redacted file of every document, by its type: doc_id, document_type, filename, n_pages, n_bytes, content.

    documents: doc_id, name, document_type ("text-pdf", "image-pdf", "image"). pages: doc_id, page_index, width, height, data (rasters; null for text PDFs, whose
    sizes are in points). Images of one page are a file by themselves, of several a merged PDF, unless image_choice says otherwise.
    """
    counts = pages.groupBy(F.col("doc_id").alias("p_id")).agg(F.count("*").alias("n_pages"))
    typed = documents.join(counts, F.col("doc_id") == F.col("p_id")).drop("p_id")
    of = lambda rows, kind, more="true": rows.join(typed.filter(F.col("document_type") == kind).filter(more).select("doc_id"), "doc_id", "left_semi")
    sizes = of(pages, "text-pdf").select("doc_id", "page_index", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    text = redact_text_pdfs(sizes, of(items, "text-pdf"), of(words, "text-pdf"), of(regions, "text-pdf"))
    scanned = redact_scanned_pdfs(of(pages, "image-pdf"), of(words, "image-pdf"), of(regions, "image-pdf"))
    made = text.unionByName(scanned)
    if image_choice:
        made = made.unionByName(redact_images(of(pages, "image"), words, regions, image_choice))
        name = export_name(F.col("name"), F.col("document_type"), F.col("n_pages"), image_choice)
    else:
        for more, choice in (("n_pages = 1", "image-max"), ("n_pages > 1", "multi-pdf-optimal")):
            made = made.unionByName(redact_images(of(pages, "image", more), words, regions, choice))
        extension = F.when((F.col("document_type") == "image") & (F.col("n_pages") == 1), ".png").otherwise(".pdf")
        name = T.final_name(F.col("name"), F.col("document_type"), F.col("n_pages"), extension)
    out = typed.join(made, "doc_id")
    return out.select("doc_id", "document_type", name.alias("filename"), "n_pages", F.octet_length("content").cast("long").alias("n_bytes"), "content")


def save(files: DataFrame, folder: str) -> None:
    """Writes each file below the folder, which all executors share, under doc_id and its name. A task that runs again replaces its files."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for f in frames:
            for r in f.itertuples(index=False):
                store.create_dir(f"{base}/{r.doc_id}", recursive=True)
                with store.open_output_stream(f"{base}/{r.doc_id}/{r.filename}") as out:
                    out.write(r.content)
            yield f[["doc_id"]]

    files.select("doc_id", "filename", "content").mapInPandas(write, "doc_id long").write.format("noop").mode("overwrite").save()
