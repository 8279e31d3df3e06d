"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (runs of `window` consecutive words; a shorter item is one window) are sets of
word shingles that a document must hold completely. So one shingle per window is a necessary
prefix: the rarest one, by counts over all documents. Documents are probed for
prefix shingles only; a match fixes where the window would lie (positional bound), which
must be inside the document (length bound); then the words themselves are compared.

Both passes over the documents are narrow: no document text is shuffled. The benchmark's
windows go with the tasks in blocks of at most BLOCK_WINDOWS, one block at a time; a larger benchmark takes
more passes over the documents, never a larger broadcast, and gives the same rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm import bytetext as B
from inkveil.llm.shared import Scratch

WINDOW = 10
SHINGLE = 5

#: Windows of one pass; a pass ships about 200 bytes for each. The windows of a long item may lie in several blocks.
BLOCK_WINDOWS = 200_000


@dataclass
class Windows:
    """Windows of one block of items: owner ids, texts (words joined by a space), word digests (zero-padded), lengths."""

    owner: list[str]
    text: list[bytes]
    word: np.ndarray
    length: np.ndarray

    def sizes(self) -> np.ndarray:
        """Words of the shingles of each window."""
        return np.minimum(self.length, SHINGLE)

    def shingles(self) -> np.ndarray:
        """Digests, windows x up to window - SHINGLE + 1; zero where a window has fewer."""
        out = np.zeros((len(self.length), max(1, self.word.shape[1] - SHINGLE + 1)), np.uint64)
        for i, n in enumerate(self.length):
            s = B.shingles(self.word[i, :n], SHINGLE)
            out[i, : len(s)] = s
        return out


def item_windows(content: str | None, window: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Of one item's text: each window's words (joined by a space) and their digests."""
    low = B.LOWER[np.frombuffer((content or "").encode(), np.uint8)]
    starts, ends, _ = B.words(low, np.array([0, len(low)], np.int64), B.ALNUM)
    digest = B.digests(low, starts, ends)
    n = min(window, len(starts))
    for a in range(len(starts) - n + 1 if n else 0):
        yield b" ".join(low[starts[k] : ends[k]].tobytes() for k in range(a, a + n)), digest[a : a + n]


def _block(rows: list[tuple[str, bytes, np.ndarray]], window: int) -> Windows:
    padded = np.zeros((len(rows), window), np.uint64)
    for i, (_, _, w) in enumerate(rows):
        padded[i, : len(w)] = w
    return Windows([r[0] for r in rows], [r[1] for r in rows], padded, np.array([len(r[2]) for r in rows], np.int64))


def _run_shingles(digest: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all runs of size words inside one text, and the place of each run's first word."""
    if len(digest) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    all_runs = B.shingles(digest, size)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[: len(all_runs)] == text[size - 1 :]
    at = np.flatnonzero(inside)
    return all_runs[at], at


def _matches(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values are in wanted (sorted, distinct), and where there."""
    bits = np.zeros(1 << 20, bool)
    bits[(wanted >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(values >> np.uint64(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(wanted, values[maybe]), len(wanted) - 1)
    ok = wanted[place] == values[maybe]
    return maybe[ok], place[ok]


def _tokenised(data: np.ndarray, offsets: np.ndarray):
    low = B.LOWER[data]
    starts, ends, first = B.words(low, offsets, B.ALNUM)
    return low, starts, ends, first, B.digests(low, starts, ends)


def shingle_counts(docs: DataFrame, shingles: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Occurrences in all documents of each of the benchmark's shingles (sorted, distinct)."""
    shipped = docs.sparkSession.sparkContext.broadcast(shingles)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shipped.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            data, offsets = B.column_bytes(batch.column(0))
            for i, j in B.runs(offsets):
                _, _, _, first, digest = _tokenised(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for size in sizes:
                    values, _ = _run_shingles(digest, first, size)
                    if len(values):
                        total += np.bincount(_matches(values, wanted)[1], minlength=len(wanted))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["k", "n"])

    rows = docs.select("text").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # at most one row per shingle
    out = np.zeros(len(shingles), np.int64)
    for r in rows:
        out[r["k"]] = r["n"]
    return out


@dataclass
class Index:
    """Prefix shingles (sorted) and, for each, the windows that it stands for: a range of `window` and `place`."""

    prefix: np.ndarray
    edges: np.ndarray
    window: np.ndarray
    place: np.ndarray
    sizes: list[int]
    windows: Windows


def build_index(docs: DataFrame, windows: Windows) -> Index:
    """Orders each window's shingles by rarity over docs and indexes the rarest one."""
    if not windows.owner:
        return Index(np.zeros(1, np.uint64), np.zeros(2, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], windows)
    table, lengths, sizes = windows.shingles(), windows.length, windows.sizes()
    valid = np.arange(table.shape[1])[None, :] <= (lengths - sizes)[:, None]
    known = np.unique(table[valid])
    kinds = sorted(set(sizes.tolist()))
    counts = shingle_counts(docs, known, kinds)
    rank = np.where(valid, counts[np.minimum(np.searchsorted(known, table), len(known) - 1)], np.iinfo(np.int64).max)
    place = rank.argmin(1)  # the first of equally rare ones
    prefix = table[np.arange(len(table)), place]
    order = np.argsort(prefix, kind="stable")
    distinct, begin = np.unique(prefix[order], return_index=True)
    return Index(distinct, np.r_[begin, len(order)], order, place[order], kinds, windows)


def find(index: Index, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; the verified occurrences: places of their first words in all words, and windows."""
    low, starts, ends, first, digest = _tokenised(data, offsets)
    begin, which = [], []
    for size in index.sizes:
        values, at = _run_shingles(digest, first, size)
        if not len(values):
            continue
        hit, entry = _matches(values, index.prefix)
        many = index.edges[entry + 1] - index.edges[entry]
        row = np.repeat(np.arange(len(hit)), many)
        k = index.edges[entry][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        window = index.window[k]
        same = index.windows.sizes()[window] == size
        start = at[hit][row] - index.place[k]
        text = np.searchsorted(first, at[hit][row], "right") - 1
        stop = start + index.windows.length[window]
        ok = same & (start >= first[text]) & (stop <= first[text + 1])
        begin.append(start[ok])
        which.append(window[ok])
    if not begin:
        return np.diff(first), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, window = np.concatenate(begin), np.concatenate(which)
    good = np.ones(len(start), bool)
    for k in range(index.windows.word.shape[1]):
        inside = k < index.windows.length[window]
        good[inside] &= digest[start[inside] + k] == index.windows.word[window[inside], k]
    start, window = start[good], window[good]
    exact = [b" ".join(low[starts[k] : ends[k]].tobytes() for k in range(s, s + index.windows.length[w])) == index.windows.text[w] for s, w in zip(start.tolist(), window.tolist(), strict=True)]
    exact = np.array(exact, bool)
    return np.diff(first), start[exact], window[exact]


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _scan(docs: DataFrame, shipped: Broadcast) -> DataFrame:
    """Per row of docs (text last): its other columns, n_words, spans of hit words (begin, end; merged, ascending) and item ids found."""
    others = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        owner = np.array(table.windows.owner, object)
        for batch in batches:
            data, offsets = B.column_bytes(batch.column(len(others)))
            for i, j in B.runs(offsets):
                n_words, start, window = find(table, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                first = np.r_[0, np.cumsum(n_words)]
                text = np.searchsorted(first, start, "right") - 1
                spans: list[list] = [[] for _ in range(j - i)]
                items: list[list] = [[] for _ in range(j - i)]
                order = np.lexsort((start, text))
                edges = np.searchsorted(text[order], np.arange(j - i + 1))
                for d in np.unique(text).tolist():
                    own = order[edges[d] : edges[d + 1]]
                    s = start[own] - first[d]
                    e = np.maximum.accumulate(s + table.windows.length[window[own]])
                    fresh = np.r_[True, s[1:] > e[:-1]]
                    spans[d] = [{"begin": int(x), "end": int(y)} for x, y in zip(s[fresh], e[np.r_[np.flatnonzero(fresh)[1:] - 1, len(e) - 1]], strict=True)]
                    items[d] = sorted(set(owner[window[own]]))
                found = [pa.array(n_words.astype(np.int64)), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(others))), *found], [*others, "n_words", "spans", "items"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    return docs.mapInArrow(run, f"{kinds}n_words long, spans array<struct<begin:long,end:long>>, items array<string>")


def _blocks(items: DataFrame, window: int) -> Iterator[Windows]:
    """The benchmark's windows in blocks, at least one; the driver makes one at a time."""
    rows: list[tuple[str, bytes, np.ndarray]] = []
    any_yet = False
    for r in items.toLocalIterator():
        for text, digest in item_windows(r["text"], window):
            if len(rows) == BLOCK_WINDOWS:
                yield _block(rows, window)
                rows, any_yet = [], True
            rows.append(("" if r["item_id"] is None else str(r["item_id"]), text, digest))
    if rows or not any_yet:
        yield _block(rows, window)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (word ranges covered by occurrences of windows) and items (ids as sorted strings).

    Null and empty texts have no words and no hits; items without words have no windows; repeated items
    count once; a null item id is written as the empty string. Every row of docs gives one row, also where ids repeat or are
    null, however many blocks the benchmark takes: with more than one, rows are numbered in a written table and what the blocks find is
    put together by that number. Empty tables give no rows, or rows without hits. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    blocks = _blocks(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), window)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _scan(source, context.broadcast(build_index(source, block)))
    scratch = Scratch(docs.sparkSession, "decontaminate")
    numbered = scratch.keep(source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
    found: list[DataFrame] = []
    for k, windows in enumerate(itertools.chain([block, following], blocks)):
        shipped = context.broadcast(build_index(numbered, windows))
        rows = _scan(numbered, shipped)
        found.append(scratch.keep(rows if k == 0 else rows.filter("size(spans) > 0"), f"block-{k}"))
        shipped.destroy()
    scratch.drop("numbered")
    hits = found[0].filter("size(spans) > 0")
    for x in found[1:]:
        hits = hits.unionByName(x)
    merged = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.select(F.col("row").alias("m_row"), _merge_spans().alias("spans"), "items")
    rows = found[0].select("row", "doc_id", "n_words").join(merged, F.col("row") == F.col("m_row"), "left")
    none = [F.coalesce(c, F.array().cast(merged.schema[c].dataType)).alias(c) for c in ("spans", "items")]
    return rows.select("doc_id", "n_words", *none)


def _merge_spans():
    """Overlapping and adjoining spans as one, in DataFrame functions."""
    return F.aggregate(
        F.array_sort("spans"),
        F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["begin"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["begin"].alias("begin"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def report(found: DataFrame) -> DataFrame:
    """The digest columns: n_words, n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["begin"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark window occurs. Rows are dropped where they
    are read; nothing is shuffled but counts. What a block leaves is written, and the next block reads it. Null and empty texts stay, and
    repeated rows are judged one by one; empty tables give no rows, or all of docs."""
    place = docs.columns.index(text_col)
    context, schema = docs.sparkSession.sparkContext, docs.schema

    def without(rows: DataFrame, shipped: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = B.column_bytes(batch.column(place))
                for i, j in B.runs(offsets):
                    n_words, start, _ = find(shipped.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    keep = np.ones(j - i, bool)
                    keep[np.searchsorted(np.r_[0, np.cumsum(n_words)], start, "right") - 1] = False
                    yield batch.slice(i, j - i).filter(pa.array(keep))

        return rows.mapInArrow(run, schema)

    blocks = _blocks(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), window)
    block, scratch, k = next(blocks), Scratch(docs.sparkSession, "decontaminate"), 0
    for following in blocks:
        shipped = context.broadcast(build_index(docs.select(F.col(text_col).alias("text")), block))
        docs = scratch.keep(without(docs, shipped), f"left-{k}")
        shipped.destroy()
        if k:
            scratch.drop(f"left-{k - 1}")
        block, k = following, k + 1
    return without(docs, context.broadcast(build_index(docs.select(F.col(text_col).alias("text")), block))) if block.owner else docs
