"""Best-fit packing by minimum bin slack over the exact histogram of piece lengths.

Documents are encoded, closed with an end id and cut into pieces of at most the capacity. Which
pieces share a bin depends on their lengths alone, so the search runs on the histogram, which
has at most `capacity` entries whatever the corpus size: for each bin pattern, bitset
subset-sum dynamic programming over the available lengths finds the fullest feasible
combination; the pattern is then taken as often as the counts allow and removed. Each pattern
exhausts a length, so their number is bounded by the capacity too.

Pieces get their slots by rank within their length. Ranks are counted in salted buckets, so no
task sees all pieces of a hot length; the slot table (a few bounded arrays) is shipped with the task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.encode import default_tokenizer, encoder
from inkveil.llm.shared import Scratch, small_batches

CAPACITY = 4096
END_ID = 1

#: Pieces that one bucket of a length holds on average, at most.
BUCKET_ROWS = 20_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers) and, if asked for, the ids themselves. Null text is empty, which leaves the end id."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, j, coded, at in coder.column(batch.column(1)):
                coded = coded.astype("<u4")
                for row in range(i, j):
                    whole = np.concatenate([coded[at[row - i] : at[row - i + 1]], end])
                    for k, begin in enumerate(range(0, len(whole), capacity)):
                        part = whole[begin : begin + capacity]
                        owner.append(row)
                        piece.append(k)
                        start.append(begin)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(cut, schema)


def _fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths, longest first, of a combination with the least slack that holds the longest length left.

    reach[k] has bit s if some choice among the first k lengths (each up to its count) has sum s.
    """
    lengths = sorted(counts, reverse=True)
    first = lengths[0]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach = [1]
    used = []
    for x in lengths:
        if x > room:
            continue
        have = min(counts[x] - (x == first), room // x)
        bits = reach[-1]
        step = 1
        while have > 0:  # binary splitting of the multiplicity
            take = min(step, have)
            bits |= (bits << (take * x)) & mask
            have -= take
            step *= 2
        used.append(x)
        reach.append(bits)
        if bits >> room & 1:
            break
    best = reach[-1].bit_length() - 1
    chosen = [first]
    for k in range(len(used) - 1, -1, -1):
        x = used[k]
        while best >= 0 and not reach[k] >> best & 1:
            best -= x
            chosen.append(x)
    return sorted(chosen, reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bin patterns (lengths, longest first) and how often each is used; together they use up the histogram."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    patterns = []
    while counts:
        lengths = _fullest(counts, capacity)
        need = {x: lengths.count(x) for x in set(lengths)}
        times = min(counts[x] // n for x, n in need.items())
        patterns.append((lengths, times))
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return patterns


class SlotTable:
    """Sequence and offset of the r-th piece of a length, from bin patterns."""

    def __init__(self, patterns: list[tuple[list[int], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        given: dict[int, int] = {}
        first_bin = 0
        for lengths, times in patterns:
            offset = 0
            for x in dict.fromkeys(lengths):
                n = lengths.count(x)
                at = given.get(x, 0)
                rows.setdefault(x, []).append((at, first_bin, n, offset))
                given[x] = at + n * times
                offset += n * x
            first_bin += times
        self.sequences = first_bin
        self.tables = {x: np.array(r, np.int64).T for x, r in rows.items()}

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, first_bin, n, offset = self.tables[length]
        i = np.searchsorted(at, rank, "right") - 1
        over = rank - at[i]
        return first_bin[i] + over // n[i], offset[i] + over % n[i] * length


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (doc_id, piece, length and more)."""
    spark = rows.sparkSession
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most capacity rows
    total = sum(histogram.values())
    if not total:
        return rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    slots = spark.sparkContext.broadcast(SlotTable(plan_bins(histogram, capacity)))
    buckets = max(256, -(-total // BUCKET_ROWS))
    salted = rows.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    sizes = salted.groupBy("length", "__bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    scratch = Scratch(spark, "pack")
    sizes = scratch.keep(sizes.select("length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")), "bases")
    rank = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("__rank", rank).join(sizes, ["length", "__bucket"])
    names = rows.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__slot").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for part in np.split(order, edges) if len(order) else []:
                sequence[part], offset[part] = table.place(int(length[part[0]]), rank[part])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    slot = (F.col("__rank") + F.col("__base")).cast("long").alias("__slot")
    return ranked.select(*names, slot).mapInArrow(place, f"{_ddl(rows)}, sequence_id long, offset long")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places. Sequences have offsets from 0 without gaps."""
    cut = pieces(docs, tokenizer or default_tokenizer(), end_id, capacity, id_col, text_col, keep_ids)
    with small_batches(docs.sparkSession):
        rows = Scratch(docs.sparkSession, "pieces").keep(cut, "pieces")
    return pack_pieces(rows, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed id sequences of best_fit_pack(..., keep_ids=True); each has at most capacity ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("input_ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
