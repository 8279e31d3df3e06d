"""Stored (uncompressed) ZIP archives and their directory as a relation."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOCAL_HEAD, CENTRAL_HEAD, END_RECORD = 30, 46, 22

# Limits of the format without its 64-bit extension.
MOST_ENTRIES, MOST_BYTES = 0xFFFF, 0xFFFFFFFF


def zip_entries(files: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Directory of one archive per key: name, crc32, n_bytes and offset of each entry, without making the bytes."""
    size = LOCAL_HEAD + F.octet_length("name") + F.octet_length("content")
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return files.select(*keys, order, "name", F.crc32("content").alias("crc32"), F.octet_length("content").cast("long").alias("n_bytes"), F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias("offset"))


def stored_zip(entries: list[tuple[str, bytes]]) -> bytes:
    """An archive of stored entries with zero times and no flags. More than the format can hold is an error: split such files into several archives."""
    size = sum(LOCAL_HEAD + CENTRAL_HEAD + 2 * len(name.encode()) + len(content) for name, content in entries)
    if len(entries) > MOST_ENTRIES or size > MOST_BYTES:
        raise ValueError(f"{len(entries)} entries of {size} bytes are too many for one archive")
    body, directory = bytearray(), bytearray()
    for name, content in entries:
        raw, crc, n = name.encode(), zlib.crc32(content), len(content)
        directory += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 20, 20, 0, 0, 0, 0, crc, n, n, len(raw), 0, 0, 0, 0, 0, len(body)) + raw
        body += struct.pack("<IHHHHHIIIHH", 0x04034B50, 20, 0, 0, 0, 0, crc, n, n, len(raw), 0) + raw + content
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, len(entries), len(entries), len(directory), len(body), 0)
    return bytes(body + directory + end)


def archives(files: DataFrame, key: str, order: str) -> DataFrame:
    """One archive per key from name and content, in the given order: key, content."""
    kind = files.schema[key].dataType.simpleString()

    def make(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order)
        return pd.DataFrame({key: [f[key].iloc[0]], "content": [stored_zip(list(zip(f["name"], f["content"], strict=True)))]})

    return files.select(key, order, "name", "content").groupBy(key).applyInPandas(make, f"{key} {kind}, content binary")
