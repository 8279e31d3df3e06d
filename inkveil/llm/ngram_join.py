"""Set-similarity self-join on word n-grams by token-combination prefixes.

A document's set is its distinct word shingles. Two sets x, y (x the smaller) with Jaccard
similarity of at least NUM / DEN overlap in at least NUM (|x| + |y|) / (NUM + DEN) shingles, so, in
one global order of shingles, their prefixes of length |x| - a + k, |y| - b + k share k of them
(a, b: the least overlap that x as the smaller, y as the larger set can have).

Order and index:
- Shingles fall into classes by the upper half of their digest; class frequencies are counted exactly
  over all documents that stand for a set. Rare classes come first, frequent ones last, by
  frequency.
- Rare shingles of the plain prefix (k = 1) are indexed one by one.
- Frequent ones would collect unrelated documents. For them the prefix is extended to
  k = GROUPS + 1 and pairs of frequent shingles in the same one of GROUPS hash groups are indexed:
  if no rare shingle is shared, k frequent ones are, two of them in one group.
- Sets under SMALL shingles, which cannot share k, are indexed one by one throughout; sets up to SMALL * DEN / NUM
  are in both indexes, so any two sets that can link meet in one of them.

Then the documents that share keys are compared. Each index bucket has a hub, and the members of all buckets of a hub are a
group: documents that can link meet in one. First each document is compared with the hub that it meets most often. Then, in groups
whose members are in different components, pivots are drawn from the members outside the hub's component and compared with all
members in one pass over the group; pivots leave the group afterwards, and the next round goes on with what is still
apart. A round moves a member once and a pivot once for every PIVOTS members, so rows stay in proportion to members however large
a group is; what a comparison finds is a spanning forest of its links.

A comparison has two steps. Sizes and parity bitmaps of the sets (whose distance is at most the symmetric difference) rule out most
documents exactly; of those left, the texts themselves are cut into shingles and counted. Equality there is that of
words: shingles are digests under a key drawn for each run, and a task confirms that in its texts equal digests have equal words.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm import bytetext as B
from inkveil.llm.components import connected_components, id_filter, passes
from inkveil.llm.shared import Scratch

SHINGLE = 5
NUM, DEN = 4, 5
GROUPS = 8
SMALL = 10

#: A class is frequent above this count, or above the count that keeps the table of frequent classes
#: within MOST_CLASSES entries (12 bytes each).
FREQUENT = 50
MOST_CLASSES = 1 << 21

#: Class occurrences that one merge task counts, about.
MERGE = 1_000_000

#: The class bitmap has up to 2**MOST_BITS bits (64 MB).
MOST_BITS = 29

#: Binary logarithms of the least and most bits of a set's parity bitmap.
LEAST_BITS, MOST_PARITY = 9, 16

#: Members of a group that are drawn to be compared with all others in a round, about; and members in one cell of the comparison.
PIVOTS = 1024

#: Shingles of the pivots of a group in a round, about.
PIVOT_SHINGLES = 4_000_000

#: Pairs, counts and bytes of text that a task works on at once.
PAIRS, COUNTS, TEXT = 1 << 18, 1 << 21, 1 << 22


def _ceil(a, b: int):
    return -(-a // b)


@dataclass(frozen=True)
class Shingling:
    """Words of a shingle, and the key of the words' digests."""

    size: int = SHINGLE
    key: int = 1

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The sorted distinct shingle digests of each text."""
        low = B.LOWER[data]
        starts, ends, first = B.words(low, offsets, B.NOT_SPACE)
        yield from self._of_words(B.digests(low, starts, ends, self.key), first)

    def _of_words(self, digest: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        if not len(digest):
            yield from (digest for _ in first[1:])
            return
        runs, many = B.shingles(digest, self.size), np.diff(first)
        for i, n in enumerate(many):
            yield np.unique(runs[first[i] : first[i + 1] - self.size + 1] if n >= self.size else B.shingles(digest[first[i] : first[i + 1]], self.size))

    def column_sets(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        data, offsets = B.column_bytes(batch.column(1))
        for i, j in B.runs(offsets):
            for k, s in enumerate(self.sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
                yield i + k, s

    def exact_sets(self, column: pa.Array) -> list[np.ndarray]:
        """Of texts that are to be compared with each other: sets whose elements are equal only if the words are."""
        data, offsets = B.column_bytes(column)
        low = B.LOWER[data]
        starts, ends, first = B.words(low, offsets, B.NOT_SPACE)
        digest = B.digests(low, starts, ends, self.key)
        if not B.faithful(low, starts, ends, digest):
            raw, number = low.tobytes(), {}
            digest = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
        sets = list(self._of_words(digest, first))
        if _distinct_runs(digest, first, self.size) == len(np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]))):
            return sets
        number = {}
        words = [digest[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        runs = [{tuple(w[k : k + self.size]) for k in range(max(1, len(w) - self.size + 1))} if w else set() for w in words]
        return [np.sort(np.array([number.setdefault(r, len(number)) for r in x], np.uint64)) for x in runs]


def _distinct_runs(word: np.ndarray, first: np.ndarray, size: int) -> int:
    """How many different runs of size words (or whole shorter sequences) the texts have, counted on the words."""
    _, rank = np.unique(word, return_inverse=True)
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[own + 1] - np.arange(len(word))  # words from each one to the end of its text
    begin = np.flatnonzero((left >= size) | (np.arange(len(word)) == first[own]))
    code = np.zeros(len(begin), np.int64)
    for k in range(size):
        at = begin + k
        inside = at < first[own[begin] + 1]
        step = np.where(inside, rank[np.minimum(at, len(rank) - 1)] + 1, 0)
        code = np.unique(code * (len(rank) + 2) + step, return_inverse=True)[1].astype(np.int64)
    return int(code.max()) + 1 if len(code) else 0


def _signatures(docs: DataFrame, cut: Shingling) -> DataFrame:
    """doc_id, n, a 128-bit digest of the set (s1, s2) and its parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, bits = [], [], [], []
            for _, s in cut.column_sets(batch):
                a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
                n.append(len(s))
                s1.append(a)
                s2.append(b)
                bits.append(parity(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "n", "s1", "s2", "bits"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bits binary")


def parity(s: np.ndarray) -> bytes:
    """Bit k tells whether an odd number of elements falls on k; about two bits for each element."""
    size = 1 << min(max(int(2 * len(s)).bit_length(), LEAST_BITS), MOST_PARITY)
    return np.packbits(np.bincount((B.mix(s) % np.uint64(size)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """A parity bitmap (64-bit words in the last axis) at a smaller size."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def most_distance(na, nb):
    """The largest symmetric difference of linking sets of these sizes."""
    return na + nb - 2 * _ceil(NUM * (na + nb), NUM + DEN)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint32 values as 16-bit steps; a step of 65535 only moves on."""
    step = np.diff(values.astype(np.int64), prepend=0)
    skip = step // 65535
    out = np.full(len(values) + int(skip.sum()), 65535, "<u2")
    out[np.arange(len(values)) + np.cumsum(skip)] = step % 65535
    return out.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    step = np.frombuffer(blob, "<u2").astype(np.int64)
    return np.cumsum(step)[step != 65535].astype(np.uint32)


@dataclass
class Classes:
    """What tasks need to know of class frequencies: the frequent classes (ascending) with their counts, and a bitmap over the classes'
    upper bits that has a zero only where no class occurs twice."""

    often: np.ndarray
    counts: np.ndarray
    seen: np.ndarray
    shift: int

    def count(self, s: np.ndarray) -> np.ndarray:
        """Of each shingle of a set: its class's count if frequent, else 0."""
        if not len(self.often):
            return np.zeros(len(s), np.int64)
        own = (s >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.often, own), len(self.often) - 1)
        return np.where(self.often[at] == own, self.counts[at], 0)

    def shared(self, s: np.ndarray) -> np.ndarray:
        """Whether another set can have the shingle."""
        bit = (s >> np.uint64(32 + self.shift)).astype(np.int64)
        return (self.seen[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def class_frequencies(docs: DataFrame, wanted: np.ndarray, total: int, cut: Shingling) -> Classes:
    """Counts the classes of all documents that pass `wanted`.

    Tasks send sorted class values as 16-bit steps, dealt by range; a merge task counts one range. The bitmap has as many bits as
    there are occurrences, up to 2**MOST_BITS, so with very large inputs it keeps fewer single shingles out of the index.
    """
    bound = max(FREQUENT, _ceil(total, MOST_CLASSES))
    bits = max(8, int(np.ceil(np.log2(max(1, total) / MERGE))))
    width = max(bits + 3, min(MOST_BITS, int(np.ceil(np.log2(max(2, total))))))
    shipped = docs.sparkSession.sparkContext.broadcast(wanted)

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        values = np.sort(np.concatenate(parts))
        ranges = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32 - bits)
        edges = np.searchsorted(values, ranges)
        used = np.flatnonzero(np.diff(edges))
        blobs = [pack_sorted(values[edges[k] : edges[k + 1]] - np.uint32(int(k) << (32 - bits))) for k in used]
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "steps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            keep = passes(shipped.value, batch.column(0).to_numpy())
            for i, s in cut.column_sets(batch):
                if keep[i] and len(s):
                    parts.append((s >> np.uint64(32)).astype(np.uint32))
                    held += len(s)
                    if held > MERGE:
                        yield flush(parts)
                        parts, held = [], 0
        if parts:
            yield flush(parts)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate([unpack_sorted(x) for x in pdf["steps"]]), return_counts=True)
        often, twice = counts > bound, counts > 1
        seen = np.zeros(1 << (width - bits), bool)
        seen[values[twice] >> (32 - width)] = True
        classes = (values[often].astype(np.int64) + (int(key[0]) << (32 - bits))).astype("<u4")
        return pd.DataFrame({"part": [key[0]], "often": [classes.tobytes()], "n": [counts[often].astype("<i8").tobytes()], "seen": [np.packbits(seen).tobytes()]})

    found = docs.mapInArrow(run, "part int, steps binary").groupBy("part").applyInPandas(merge, "part int, often binary, n binary, seen binary").toArrow()
    seen = np.zeros(1 << (width - 3), np.uint8)
    often, counts = [np.zeros(0, "<u4")], [np.zeros(0, "<i8")]
    for r in sorted(found.to_pylist(), key=lambda r: r["part"]):
        often.append(np.frombuffer(r["often"], "<u4"))
        counts.append(np.frombuffer(r["n"], "<i8"))
        own = np.frombuffer(r["seen"], np.uint8)
        seen[r["part"] * len(own) : (r["part"] + 1) * len(own)] = own
    return Classes(np.concatenate(often), np.concatenate(counts), seen, 32 - width)


def prefix_keys(s: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, and whether each is in the (shorter) prefix that holds when the set is the smaller one."""
    n = len(s)
    as_larger = n - _ceil(NUM * n, DEN) + 1
    as_smaller = n - _ceil(2 * NUM * n, NUM + DEN) + 1
    count = classes.count(s)
    often = count > 0
    if often.any():
        order = np.lexsort((s, count))
        s, often = s[order], often[order]
    single = np.arange(as_larger)
    single = single[classes.shared(s[:as_larger]) & (n <= SMALL * DEN // NUM or ~often[:as_larger])]
    keys, small = [s[single]], [single < as_smaller]
    if n >= SMALL:
        extended = np.flatnonzero(often[: min(n, as_larger + GROUPS)])
        group = (B.mix(s[extended]) % np.uint64(GROUPS)).astype(np.int64)
        for g in np.unique(group):
            own = extended[group == g]
            i, j = np.triu_indices(len(own), 1)
            keys.append(B.mix(s[own[i]] + B.mix(s[own[j]] + np.uint64(1))))
            small.append(own[j] < as_smaller + GROUPS)
    return np.concatenate(keys), np.concatenate(small)


def _index_rows(docs: DataFrame, wanted: np.ndarray, classes: Classes, cut: Shingling) -> DataFrame:
    """key, doc_id, n, small: the index entries of the documents that pass `wanted`."""
    context = docs.sparkSession.sparkContext
    shipped = context.broadcast((wanted, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, classes = shipped.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            keep = passes(some, ids)
            held, parts = 0, []

            def out() -> pa.RecordBatch:
                many = [len(p[1]) for p in parts]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([p[1] for p in parts]).view(np.int64)),
                        pa.array(np.repeat(ids[[p[0] for p in parts]], many)),
                        pa.array(np.repeat([p[3] for p in parts], many).astype(np.int64)),
                        pa.array(np.concatenate([p[2] for p in parts])),
                    ],
                    ["key", "doc_id", "n", "small"],
                )

            for i, s in cut.column_sets(batch):
                if keep[i] and len(s):
                    keys, small = prefix_keys(s, classes)
                    parts.append((i, keys, small, len(s)))
                    held += len(keys)
                    if held > 200_000:
                        yield out()
                        held, parts = 0, []
            if parts:
                yield out()

    return docs.mapInArrow(run, "key long, doc_id long, n long, small boolean")


def _texts(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """The documents (doc_id, text) that pass `wanted`."""
    shipped = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(shipped.value, batch.column(0).to_numpy())))

    return docs.mapInArrow(run, "doc_id long, text string")


#: What a row of a cell is: a member; a pivot, in its own cell and in the group's others.
MEMBER, PIVOT_ELSEWHERE, PIVOT = 0, 1, 2
CELL = "hub long, salt int, role int, doc_id long, label long"


def _cells(groups: DataFrame) -> DataFrame:
    """groups (hub, doc_id, label, pivot, salts) dealt into cells: every member in one, and every pivot in all cells of its group."""
    own = F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")
    salts = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(own))
    rows = groups.withColumn("own", own).withColumn("salt", F.explode(salts))
    role = F.when(~F.col("pivot"), MEMBER).when(F.col("salt") == F.col("own"), PIVOT).otherwise(PIVOT_ELSEWHERE)
    return rows.select("hub", "salt", role.alias("role"), "doc_id", "label")


def _by_cell(rows: DataFrame) -> DataFrame:
    """Pivots first in every cell."""
    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("role").desc(), "doc_id")


class Stream:
    """Rows of cells that come in batches. A cell may go on in the next batch, so the pivots of the last one are kept."""

    def __init__(self):
        self.rest: pa.Table | None = None

    def take(self, batch: pa.RecordBatch) -> tuple[pa.Table, np.ndarray, np.ndarray, int]:
        """The kept pivots and the batch as one table; each row's cell and role; and how many were kept, thus compared with each other."""
        rows = pa.Table.from_batches([batch])
        kept = 0
        if self.rest is not None:
            kept = self.rest.num_rows
            rows = pa.concat_tables([self.rest, rows])
        role = rows.column("role").to_numpy()
        key = np.stack([rows.column("hub").to_numpy(), rows.column("salt").to_numpy()])
        cell = np.r_[0, np.cumsum((key[:, 1:] != key[:, :-1]).any(0))]
        at = np.flatnonzero((cell == cell[-1]) & (role != MEMBER))
        self.rest = rows.take(pa.array(at)).combine_chunks() if len(at) else None
        return rows, cell, role, kept


def _pairs(cell: np.ndarray, role: np.ndarray, kept: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pivot and later row of the same cell, some PAIRS at a time; without pairs of kept rows, and of pivots that meet elsewhere."""
    first = np.searchsorted(cell, cell)
    pivots = np.cumsum(np.r_[0, role != MEMBER])
    many = np.minimum(pivots[np.searchsorted(cell, cell, "right")] - pivots[first], np.arange(len(cell)) - first)
    many[:kept] = 0
    total = np.cumsum(many)
    a = 0
    while a < len(cell):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
        n = many[a:b]
        row = np.repeat(np.arange(a, b), n)
        pivot = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        ok = (role[row] != PIVOT_ELSEWHERE) | (role[pivot] == PIVOT)
        yield pivot[ok], row[ok]
        a = b


def _possible(cells: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Of the rows of cells, those that their sizes and bitmaps do not keep from linking with a pivot, or a pivot with a row, of
    another component."""
    held = bitmaps.select(F.col("doc_id").alias("b_id"), "n", "bits")
    rows = _by_cell(cells.join(held, F.col("doc_id") == F.col("b_id")).select("hub", "salt", "role", "doc_id", "label", "n", "bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream()
        for batch in batches:
            if not batch.num_rows:
                continue
            table, cell, role, kept = stream.take(batch)
            label, n = table.column("label").to_numpy(), table.column("n").to_numpy()
            bits = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("bits")]
            words = np.array([len(x) for x in bits])
            left = np.zeros(len(cell), bool)
            for p, r in _pairs(cell, role, kept):
                ok = (label[p] != label[r]) & (DEN * np.minimum(n[p], n[r]) >= NUM * np.maximum(n[p], n[r]))
                p, r = p[ok], r[ok]
                for size in np.unique(np.minimum(words[p], words[r])):
                    at = np.flatnonzero(np.minimum(words[p], words[r]) == size)
                    used = np.unique(np.r_[p[at], r[at]])
                    folded = np.stack([fold(bits[k], size) for k in used])
                    step = max(1, PAIRS // int(size))
                    for c in range(0, len(at), step):
                        u, v = p[at[c : c + step]], r[at[c : c + step]]
                        distance = np.bitwise_count(folded[np.searchsorted(used, u)] ^ folded[np.searchsorted(used, v)]).sum(1, dtype=np.int64)
                        near = distance <= most_distance(n[u], n[v])
                        left[u[near]] = left[v[near]] = True
            yield from table.select(["hub", "salt", "role", "doc_id", "label"]).filter(pa.array(left)).combine_chunks().to_batches()

    return rows.mapInArrow(run, CELL)


def _linked(cells: DataFrame, texts: DataFrame, cut: Shingling) -> DataFrame:
    """a, b: a spanning forest of the links between pivots and rows of each cell, by the words of their texts."""
    held = texts.select(F.col("doc_id").alias("t_id"), "text")
    rows = _by_cell(cells.join(held, F.col("doc_id") == F.col("t_id")).select("hub", "salt", "role", "doc_id", "label", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream()
        for batch in batches:
            _, offsets = B.column_bytes(batch.column("text"))
            i = 0
            while i < batch.num_rows:
                room = max(TEXT, stream.rest.nbytes if stream.rest is not None else 0)
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + room, "right")) - 1)
                table, cell, role, kept = stream.take(batch.slice(i, j - i))
                i = j
                doc, label = table.column("doc_id").to_numpy(), table.column("label").to_numpy()
                sets = cut.exact_sets(table.column("text").combine_chunks())
                edges = np.flatnonzero(np.diff(cell, prepend=-1, append=cell[-1] + 1))
                found = [x for a, b in zip(edges[:-1], edges[1:], strict=True) for x in _forest(sets[a:b], label[a:b], role[a:b], a, max(0, kept - a))]
                if found:
                    p, r = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[p], doc[r])), pa.array(np.maximum(doc[p], doc[r]))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _forest(sets: list[np.ndarray], label: np.ndarray, role: np.ndarray, base: int, kept: int) -> Iterator[tuple[int, int]]:
    """Links (pivot, row from the kept-th on) in one cell that connect components, with base added to their places."""
    k = int(np.count_nonzero(role != MEMBER))
    if not k or (label == label[0]).all():
        return
    names, own = np.unique(label, return_inverse=True)
    root = np.arange(len(names))  # the component of each label, as far as links are known
    n = np.array([len(x) for x in sets])
    element, owner = np.concatenate(sets[:k]), np.repeat(np.arange(k), n[:k])
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    a = kept
    while a < len(sets):
        b, counted = a, 0
        parts = []
        while b < len(sets) and (b == a or ((b - a) * k < COUNTS and counted < COUNTS)):
            lo, hi = np.searchsorted(element, sets[b]), np.searchsorted(element, sets[b], "right")
            parts.append((lo, hi - lo))
            counted += int((hi - lo).sum())
            b += 1
        many = np.concatenate([x[1] for x in parts])
        before = np.cumsum(many) - many
        row = np.repeat(np.repeat(np.arange(b - a), [len(x[1]) for x in parts]), many)
        at = np.repeat(np.concatenate([x[0] for x in parts]) - before, many) + np.arange(len(row))
        both = np.bincount(row * k + owner[at], minlength=(b - a) * k).reshape(b - a, k)
        size = n[:k][None, :] + n[a:b][:, None]
        linked = (both > 0) & ((NUM + DEN) * both >= NUM * size)
        linked &= (np.arange(k)[None, :] < np.arange(a, b)[:, None]) & ((role[a:b, None] != PIVOT_ELSEWHERE) | (role[None, :k] == PIVOT))
        for r in np.flatnonzero(linked.any(1)):
            p = np.flatnonzero(linked[r])
            met, first = np.unique(root[own[p]], return_index=True)
            mine = root[own[a + r]]
            fresh = met != mine
            for q in p[first[fresh]].tolist():
                yield base + q, base + a + int(r)
            if fresh.any():
                root[np.isin(root, met)] = mine
        a = b


def _compared(cells: DataFrame, docs: DataFrame, bitmaps: DataFrame, scratch: Scratch, step: int, cut: Shingling) -> DataFrame:
    """The links that a comparison of cells finds, written."""
    left = scratch.keep(_possible(cells, bitmaps).distinct(), f"possible-{step}")
    texts = _texts(docs, id_filter(left.select("doc_id").distinct()))
    links = scratch.keep(_linked(left, texts, cut).distinct(), f"links-{step}")
    scratch.drop(f"possible-{step}")
    return links


def _labelled(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    return connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch, name)


def _links(docs: DataFrame, nodes: DataFrame, bitmaps: DataFrame, total: int, scratch: Scratch, cut: Shingling) -> DataFrame:
    """node and component of the nodes that link with another."""
    wanted = id_filter(nodes)
    rows = scratch.keep(_index_rows(docs, wanted, class_frequencies(docs, wanted, total, cut), cut), "index")
    # A bucket's hub is its first document that can be the smaller one of a pair. Without any, nothing links there.
    hub = F.min(F.when(F.col("small"), F.col("doc_id"))).alias("hub")
    keys = rows.groupBy("key").agg(hub, F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("hub is not null and a != b").select("key", "hub")
    keys = scratch.keep(keys, "keys")
    met = rows.join(keys, "key").groupBy("hub", "doc_id").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    met = scratch.keep(met, "met")
    scratch.drop("index", "keys")
    # First each document with the hub that it meets in most buckets: that joins most of a large group.
    best = met.filter("doc_id != hub").groupBy("doc_id").agg(F.max(F.struct("c", (-F.col("hub")).alias("h"))).alias("best"))
    best = best.select((-F.col("best.h")).alias("hub"), "doc_id")
    members = best.select("hub", "doc_id", F.lit(False).alias("pivot"))
    stars = members.unionByName(best.select("hub", F.col("hub").alias("doc_id"), F.lit(True).alias("pivot")).distinct())
    sizes = best.groupBy("hub").agg(F.ceil(F.count("*") / PIVOTS).cast("int").alias("salts"))
    stars = stars.join(sizes, "hub").withColumn("label", F.col("doc_id"))
    links = _compared(_cells(stars), docs, bitmaps, scratch, 0, cut)
    # Then, in groups that are still apart, pivots with all members, until the members left are in one component.
    labels = _labelled(links, scratch, "labels-0")
    step = 0
    while True:
        step += 1
        groups = _apart(met, labels, step)
        groups = scratch.keep(groups, f"groups-{step}")
        scratch.drop("met" if step == 1 else f"groups-{step - 1}")
        if groups.isEmpty():
            scratch.drop(f"groups-{step}")
            return labels
        links = links.unionByName(_compared(_cells(groups), docs, bitmaps, scratch, step, cut))
        met = groups.filter("not pivot").select("hub", "doc_id", "n")
        labels = _labelled(links, scratch, f"labels-{step}")


def _apart(met: DataFrame, labels: DataFrame, step: int) -> DataFrame:
    """The members (hub, doc_id, n) of groups in different components, with label, pivot and the group's number of cells.

    Members outside the hub's component are drawn as pivots: all of them, or about as many as PIVOTS and PIVOT_SHINGLES allow.
    """
    tagged = met.join(labels, met["doc_id"] == labels["node"], "left").select("hub", "doc_id", "n", F.coalesce("component", "doc_id").alias("label"))
    named = labels.select(F.col("node").alias("h_node"), F.col("component").alias("h_component"))
    tagged = tagged.join(named, F.col("hub") == F.col("h_node"), "left").withColumn("out", F.col("label") != F.coalesce("h_component", "hub"))
    sizes = tagged.groupBy(F.col("hub").alias("g_hub")).agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), F.count_if("out").alias("u"), F.sum(F.when(F.col("out"), F.col("n"))).alias("un")
    )
    share = F.least(F.lit(1.0), F.greatest(1 / F.col("u"), F.least(PIVOTS / F.col("u"), PIVOT_SHINGLES / F.col("un"))))
    sizes = sizes.filter("lo != hi").select("g_hub", share.alias("share"), F.ceil(F.col("m") / PIVOTS).cast("int").alias("salts"))
    draw = F.pmod(F.xxhash64(F.lit(step), "hub", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = tagged.join(sizes, F.col("hub") == F.col("g_hub"))
    return rows.select("hub", "doc_id", "n", "label", (F.col("out") & (draw < F.col("share"))).alias("pivot"), "salts")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and class_id (smallest doc_id with
    the same set).

    Texts without words have empty sets, which link with nothing. Rows with the same doc_id are one
    document for reachability; a null doc_id has null component and class, and no links. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    cut = Shingling(size, secrets.randbits(64))  # words that share digests cannot be prepared
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = source.filter("doc_id is not null")
    unknown = source.filter("doc_id is null")
    signed = scratch.keep(_signatures(known, cut), "signatures")
    classes = signed.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("class_id"))
    classes = scratch.keep(classes, "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    rows = signed.join(classes, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"))
    if total:
        labels = _links(known, classes.select("class_id"), signed.select("doc_id", "n", "bits").filter("n > 0"), total, scratch, cut)
        # An id with several rows joins the classes of all of them.
        several = rows.groupBy("doc_id").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).filter("lo != hi")
        if not several.isEmpty():
            ties = rows.select(F.col("doc_id").alias("u"), F.col("class_id").alias("v")).filter("u != v")
            edges = labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(ties)
            labels = scratch.keep(connected_components(edges, scratch, "cc-rows"), "labels-rows")
        out = rows.join(labels, F.col("class_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id")
    else:
        out = rows.select("doc_id", "n_shingles", F.col("class_id").alias("component_id"), "class_id")
    if unknown.isEmpty():
        return out
    nothing = F.lit(None).cast("long")
    extra = _signatures(unknown, cut).select("doc_id", F.col("n").alias("n_shingles"), nothing.alias("component_id"), nothing.alias("class_id"))
    return out.unionByName(extra)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id. Rows with null ids stay; so do all documents without words, each its own
    component. Where ids repeat, rows are judged by their own texts, so unrelated texts of one id stay, and of near copies
    with one id the first in the written table."""
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    known = docs.filter(F.col(id_col).isNotNull())
    if known.groupBy(id_col).count().filter("count > 1").isEmpty():
        groups = near_duplicate_groups(known, id_col, text_col)
        gone = scratch.keep(groups.filter("doc_id != component_id").select(F.col("doc_id").alias("__gone")), "gone")
        return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
    names = docs.columns
    numbered = scratch.keep(docs.select(F.monotonically_increasing_id().alias("__row"), *names), "docs")
    rows = numbered.filter(F.col(id_col).isNotNull()).select(F.col("__row").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    groups = near_duplicate_groups(rows.select("row", "body"), "row", "body").select("doc_id", "component_id")
    placed = scratch.keep(groups.join(rows.select("row", "id"), F.col("doc_id") == F.col("row")).select("component_id", "id", "row"), "placed")
    first = placed.groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first")).select(F.col("component_id").alias("c"), F.col("first.row").alias("kept"))
    gone = placed.join(first, F.col("component_id") == F.col("c")).filter("row != kept").select(F.col("row").alias("__gone"))
    return numbered.join(gone, F.col("__row") == F.col("__gone"), "left_anti").select(*names)
