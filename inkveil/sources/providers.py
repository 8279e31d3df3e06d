"""Decoders behind one interface: PDF text and raster, text recognition, faces.

A provider maps Arrow batches of pages to batches of rows; it is created once per worker process. None of the media
libraries is part of this package, so the default provider is a table of rows that were extracted elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

Decoder = Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]

SCHEMAS = {
    "text_items": "doc_id long, page_index int, item_index int, str string, a double, b double, tx double, ty double, width double, height double",
    "ocr_words": "doc_id long, page_index int, word_index int, text string, confidence double, x0 double, y0 double, x1 double, y1 double",
    "rasters": "doc_id long, page_index int, width int, height int, content binary",
    "faces": "doc_id long, page_index int, cand_index int, scan string, x double, y double, w double, h double, score double",
}
_made: dict[str, Decoder] = {}


def _decoder(name: str, make: Callable[[], Decoder]) -> Decoder:
    if name not in _made:
        _made[name] = make()
    return _made[name]


def from_decoder(pages: DataFrame, kind: str, name: str, make: Callable[[], Decoder]) -> DataFrame:
    """Rows of a kind by a decoder, with a column `error`. Pages (doc_id, page_index and more) are independent, so nothing is shuffled. A page that the
    decoder cannot read gives one row with its keys and the error only; see readable and unreadable."""
    schema = f"{SCHEMAS[kind]}, error string"
    names = [x.split()[0] for x in SCHEMAS[kind].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(name, make)
        for batch in batches:
            for k in range(batch.num_rows):
                page = batch.slice(k, 1)
                try:
                    rows = [r for part in decode(page) for r in part.to_pylist()]
                except Exception as e:  # whatever a media library raises for a broken page
                    rows = [{"doc_id": page.column("doc_id")[0].as_py(), "page_index": page.column("page_index")[0].as_py(), "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(_parse(schema)))

    return pages.mapInArrow(run, schema).select(*names, "error")


def _parse(schema: str) -> StructType:
    kinds = {"long": LongType(), "int": IntegerType(), "string": StringType(), "double": DoubleType(), "binary": BinaryType()}
    return StructType([StructField(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def readable(rows: DataFrame) -> DataFrame:
    return rows.filter("error is null").drop("error")


def unreadable(rows: DataFrame) -> DataFrame:
    """doc_id, page_index and error of the pages that could not be read."""
    return rows.filter("error is not null").select("doc_id", "page_index", "error")


def from_table(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows extracted elsewhere, for the pages at hand."""
    return rows.join(pages.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_semi")
