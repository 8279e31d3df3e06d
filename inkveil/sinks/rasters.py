"""Pixel work in Arrow batches: preprocessing for recognition, filling of boxes, PNG and PDF files.

Files are made with the standard library: PNG, and PDF pages that hold deflated RGB rasters.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JPEG qualities by preset and sink, zoom of scanned pages, millimetres per point.
QUALITY = {
    "image": {"max": 0.98, "compact": 0.78, "optimal": 0.89},
    "scanned": {"max": 0.95, "compact": 0.75, "optimal": 0.86},
    "merge": {"max": 0.96, "compact": 0.76, "optimal": 0.88},
}
OUTPUT_SCALE = 1.8
CONTRAST, BRIGHTNESS = 1.35, 1.05
EXPORTS = ["image-optimal", "image-max", "single-pdf-optimal", "multi-pdf-optimal", "multi-pdf-max", "multi-zip", "scanned-pdf-optimal", "scanned-pdf-max"]


def export_extension(option: str) -> str:
    """The file type of an export choice."""
    if option not in EXPORTS:
        raise ValueError(f"no such export: {option}")
    return {"image-optimal": ".jpg", "image-max": ".png", "multi-zip": ".zip"}.get(option, ".pdf")


def enhance(pixels: np.ndarray) -> np.ndarray:
    """Grey, with contrast and brightness raised; height x width x 3 to height x width."""
    grey = pixels[..., :3].astype(np.float64) @ np.array([0.2126, 0.7152, 0.0722])
    return np.clip(((grey - 127.5) * CONTRAST + 127.5) * BRIGHTNESS, 0, 255).astype(np.uint8)


def fill(pixels: np.ndarray, boxes: list, colour: tuple[int, int, int], scale: float = 1.0) -> np.ndarray:
    """A copy with the boxes (x, y, width, height) filled, cut at the edges."""
    out = pixels.copy()
    for x, y, w, h in boxes:
        x0, y0 = max(0, int(np.floor(x * scale))), max(0, int(np.floor(y * scale)))
        x1, y1 = max(0, int(np.ceil((x + w) * scale))), max(0, int(np.ceil((y + h) * scale)))
        out[y0:y1, x0:x1] = colour
    return out


def png(pixels: np.ndarray) -> bytes:
    """An RGB or grey raster as a PNG file."""
    h, w = pixels.shape[:2]
    grey = pixels.ndim == 2
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if grey else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def page_box(width: Column, height: Column, scale: float = 1.0) -> tuple[Column, Column, Column]:
    """Page size in millimetres and orientation of a raster of the given scale."""
    return width / scale / 72 * 25.4, height / scale / 72 * 25.4, F.when(width > height, "landscape").otherwise("portrait")


def pdf_file(objects: list[bytes]) -> bytes:
    """Numbered objects, the first of them the catalogue, as a file with its table of places."""
    out, at = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    xref = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, xref))


def pdf(pages: list[np.ndarray], scale: float = 1.0) -> bytes:
    """A PDF with one raster per page; no pages are an error."""
    if not pages:
        raise ValueError("a PDF needs a page")
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    for pixels in pages:
        h, w = pixels.shape[:2]
        body = zlib.compress(np.ascontiguousarray(pixels[..., :3]).tobytes())
        n = len(objects) + 1
        draw = f"q {w / scale:.4f} 0 0 {h / scale:.4f} 0 0 cm /I Do Q".encode()
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w / scale:.4f} {h / scale:.4f}] /Resources << /XObject << /I {n + 2} 0 R >> >> /Contents {n + 1} 0 R >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw))
        objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (w, h, len(body), body))
        kids.append(f"{n} 0 R")
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(kids)}] >>".encode()
    return pdf_file(objects)


def redact_rasters(pages: DataFrame, boxes: DataFrame, colour: tuple[int, int, int] = (0, 0, 0), scale: float = 1.0) -> DataFrame:
    """pages (doc_id, page_index, width, height, data: RGB bytes) with boxes (doc_id, page_index, x, y, width, height) filled, as PNG: doc_id,
    page_index, content. Words and regions of a page meet it by a grouped join, not by a collection on the driver."""
    held = boxes.groupBy("doc_id", "page_index").agg(F.collect_list(F.array("x", "y", "width", "height")).alias("boxes"))
    rows = pages.join(held, ["doc_id", "page_index"], "left").select("doc_id", "page_index", "width", "height", "data", "boxes")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for r in f.itertuples(index=False):
                raster = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
                made.append(png(fill(raster, [] if r.boxes is None else list(r.boxes), colour, scale)))
            yield pd.DataFrame({"doc_id": f["doc_id"], "page_index": f["page_index"], "content": made})

    return rows.mapInPandas(run, "doc_id long, page_index int, content binary")


def merge_pdf(pages: DataFrame, scale: float = 1.0) -> DataFrame:
    """One PDF per document from its rasters (doc_id, page_index, width, height, data) in page order: doc_id, content."""

    def make(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("page_index")
        rasters = [np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in f.itertuples(index=False)]
        return pd.DataFrame({"doc_id": [f["doc_id"].iloc[0]], "content": [pdf(rasters, scale)]})

    return pages.groupBy("doc_id").applyInPandas(make, "doc_id long, content binary")
