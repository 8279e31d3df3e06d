"""Token-id shards with a minimal perfect hash index.

Documents are range-partitioned by doc_id, and each task writes one shard:

    IKTS0001 | item bytes u32 | raw ids | doc_ids i64 | null flags u8 | lengths u64 | documents u64 | ids u64

The index maps a document key to its place. Keys are dealt to index buckets by hash; each bucket
is one file with a minimal perfect hash (seeds of a hash-and-displace construction), and for
each slot a stored fingerprint, the first shard, the record and id offset there, the last
shard and the number of records with that key. A lookup is one bucket, one seed, one slot;
the fingerprint and then the shard's own key tell an absent key from a present one.

Files are written under a temporary name and renamed, so a retried task replaces a whole file by the same
bytes. All paths are in the shared folder and reached by Arrow's file systems.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.encode import default_tokenizer, encoder
from inkveil.llm.shared import Scratch

MAGIC = b"IKTS0001"
HEAD, TAIL = "<8sI", "<QQ"
HEAD_BYTES, TAIL_BYTES = struct.calcsize(HEAD), struct.calcsize(TAIL)
END_ID = 2

#: Keys that one index bucket holds on average.
BUCKET_KEYS = 8192

#: Keys that share a seed on average.
SEED_LOAD = 4

SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("last", "<u4"), ("n", "<u8"), ("record", "<u8"), ("offset", "<u8")])


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def put(uri: str, parts: Iterable[bytes]) -> None:
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        for x in parts:
            f.write(x)
    store.move(own, path)


def shard_uri(base: str, shard: int) -> str:
    return f"{base}/shard-{shard:06d}.ids"


def write_shards(docs: DataFrame, base: str, tokenizer: str, end_id: int, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards; one row per run of records with one key in a shard: doc_id, shard, record, offset (in ids), n.

    Rows go in ascending doc_id order, null first; rows with equal ids by a digest of their text.
    """
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = ordered.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        width = coder.dtype.itemsize
        first_batch = next((x for x in batches if x.num_rows), None)
        if first_batch is None:
            return
        shard = first_batch.column(2)[0].as_py()
        keys, nulls, lengths, found = [], [], [], {}

        def content() -> Iterator[bytes]:
            yield struct.pack(HEAD, MAGIC, width)
            for batch in itertools.chain([first_batch], batches):
                keys.append(batch.column(0).fill_null(0).to_numpy())
                nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
                for _, _, ids, at in coder.column(batch.column(1)):
                    lengths.append(np.diff(at) + 1)
                    yield np.insert(ids, at[1:], end_id).tobytes()
            found["key"], found["null"] = np.concatenate(keys).astype("<i8"), np.concatenate(nulls).astype(np.uint8)
            found["length"] = np.concatenate(lengths).astype("<u8")
            yield from (found["key"].tobytes(), found["null"].tobytes(), found["length"].tobytes(), struct.pack(TAIL, len(found["length"]), int(found["length"].sum())))

        put(shard_uri(base, shard), content())
        key, null, length = found["key"], found["null"], found["length"]
        offset = np.cumsum(length, dtype=np.int64) - length.astype(np.int64)
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (null[1:] != null[:-1])])
        n = np.diff(np.r_[first, len(key)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[first], mask=null[first].astype(bool)), pa.array(np.full(len(first), shard, np.int32)), pa.array(first.astype(np.int64)), pa.array(offset[first]), pa.array(n.astype(np.int64)), pa.array(np.add.reduceat(length, first).astype(np.int64))],
            ["doc_id", "shard", "record", "offset", "n", "ids"],
        )

    return ordered.mapInArrow(write, "doc_id long, shard int, record long, offset long, n long, ids long")


def _hash(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    from inkveil.llm.bytetext import mix

    return mix(mix(keys.astype(np.uint64)) + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and each key's slot, for distinct keys: a bijection onto 0 .. len(keys) - 1.

    Keys are grouped by a first hash. Largest group first, each takes the least seed that sends all its
    keys to free slots.
    """
    n = len(keys)
    groups = max(1, -(-n // SEED_LOAD))
    group = (_hash(keys, 0) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[order], np.arange(groups + 1))
    seeds, taken, slots = np.zeros(groups, "<u4"), np.zeros(n, bool), np.zeros(n, np.int64)
    for g in np.argsort(-np.diff(edges), kind="stable"):
        rows = order[edges[g] : edges[g + 1]]
        if not len(rows):
            break
        seed = 1
        while True:  # a block of seeds at once
            trial = np.arange(seed, seed + 32, dtype=np.uint64)
            at = (_hash(keys[rows][None, :], trial[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~taken[at].any(1)
            if len(rows) > 1:
                ordered = np.sort(at, 1)
                free &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
            if free.any():
                k = int(np.argmax(free))
                seeds[g], slots[rows] = seed + k, at[k]
                taken[at[k]] = True
                break
            seed += 32
    return seeds, slots


def find_slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    group = (_hash(keys, 0) % np.uint64(len(seeds))).astype(np.int64)
    return (_hash(keys, seeds[group]) % np.uint64(n)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 0xF1F1F1F1) >> np.uint64(32)).astype("<u4")


def index_uri(base: str, bucket: int) -> str:
    return f"{base}/index-{bucket:06d}.mph"


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def write_index(places: DataFrame, base: str, buckets: int) -> DataFrame:
    """Index files from the runs that write_shards returned; one row per bucket: bucket, keys."""
    first = F.min(F.struct("shard", "record", "offset")).alias("first")
    keyed = places.filter("doc_id is not null").groupBy("doc_id").agg(first, F.max("shard").alias("last"), F.sum("n").alias("n"))
    keyed = keyed.select("doc_id", "first.*", "last", "n").withColumn("bucket", bucket_of(buckets))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = [x for x in batches if x.num_rows]
        if not full:
            return
        table = pa.Table.from_batches(full)
        got = {c: table.column(c).to_numpy() for c in table.column_names}
        for bucket in np.unique(got["bucket"]):
            rows = np.flatnonzero(got["bucket"] == bucket)
            keys = got["doc_id"][rows]
            seeds, slots = build_mph(keys)
            entry = np.zeros(len(keys), SLOT)
            entry["print"][slots] = fingerprints(keys)
            for name, column in (("shard", "shard"), ("last", "last"), ("n", "n"), ("record", "record"), ("offset", "offset")):
                entry[name][slots] = got[column][rows]
            put(index_uri(base, int(bucket)), [struct.pack("<QQ", len(seeds), len(keys)), seeds.tobytes(), entry.tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket)], pa.int32()), pa.array([len(keys)], pa.int64())], ["bucket", "keys"])

    return keyed.repartition(buckets, "bucket").mapInArrow(build, "bucket int, keys long")


def read_index(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and entries of a bucket; a bucket without keys has no file."""
    store, path = open_store(uri)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return np.zeros(0, "<u4"), np.zeros(0, SLOT)
    with store.open_input_file(path) as f:
        groups, n = struct.unpack("<QQ", f.read(16))
        return np.frombuffer(f.read(groups * 4), "<u4"), np.frombuffer(f.read(n * SLOT.itemsize), SLOT)


class Shard:
    """One shard opened for reading: its keys, null flags and lengths, and payloads by place."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        _, self.width = struct.unpack(HEAD, self.file.read(HEAD_BYTES))
        self.file.seek(self.file.size() - TAIL_BYTES)
        self.n, total = struct.unpack(TAIL, self.file.read(TAIL_BYTES))
        self.file.seek(HEAD_BYTES + total * self.width)
        self.keys = np.frombuffer(self.file.read(8 * self.n), "<i8")
        self.null = np.frombuffer(self.file.read(self.n), np.uint8)
        self.lengths = np.frombuffer(self.file.read(8 * self.n), "<u8").astype(np.int64)

    def payload(self, record: int, offset: int) -> bytes:
        self.file.seek(HEAD_BYTES + offset * self.width)
        return self.file.read(int(self.lengths[record]) * self.width)


class TokenStore:
    """Shards and index of one corpus."""

    def __init__(self, spark: SparkSession, base: str, buckets: int, bases: DataFrame):
        self.spark, self.base, self.buckets, self.bases = spark, base, buckets, bases

    def lookup(self, keys: DataFrame) -> DataFrame:
        """keys: doc_id (distinct). Per key that the index has: doc_id, shard, last, n, record, offset."""
        base = self.base

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened: dict[int, tuple] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                doc, bucket = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for b in np.unique(bucket):
                    if b not in opened:
                        opened.clear()  # rows come sorted by bucket
                        opened[b] = read_index(index_uri(base, int(b)))
                    seeds, entry = opened[b]
                    own = doc[bucket == b]
                    if not len(entry):
                        continue
                    hit = entry[find_slots(own, seeds, len(entry))]
                    ok = hit["print"] == fingerprints(own)
                    hit, own = hit[ok], own[ok]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own), *[pa.array(hit[c].astype(t)) for c, t in (("shard", np.int32), ("last", np.int32), ("n", np.int64), ("record", np.int64), ("offset", np.int64))]],
                        ["doc_id", "shard", "last", "n", "record", "offset"],
                    )

        dealt = keys.select(F.col("doc_id").cast("long").alias("doc_id"), bucket_of(self.buckets).alias("bucket")).filter("doc_id is not null")
        dealt = dealt.repartition(self.buckets, "bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(find, "doc_id long, shard int, last int, n long, record long, offset long")

    def read(self, places: DataFrame, digests: bool = False) -> DataFrame:
        """Per record of the looked-up keys, read from the shards: doc_id, start (ids before it in the corpus), n_tokens,
        ids (little-endian payload) and width (bytes of an id); or, instead of the last two, ids_crc32 (of the ids as
        little-endian unsigned 32-bit integers).

        Requests are dealt by shard and sorted by record, so each shard is read once, forwards.
        """
        base = self.base
        asked = places.select("doc_id", "shard", "last", "n", "record", "offset").withColumn("at", F.explode(F.sequence("shard", "last")))
        asked = asked.join(self.bases.select(F.col("shard").alias("at"), F.col("base")), "at")
        asked = asked.repartition("at").sortWithinPartitions("at", "record").select("at", "base", "doc_id", "shard", "n", "record", "offset")

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, shard = None, None
            for batch in batches:
                at, before, doc, home, many, record, offset = (x.to_pylist() for x in batch.columns)
                out: list[tuple] = []
                size = 0
                for k in range(len(at)):
                    if at[k] != number:
                        if shard is not None:
                            shard.file.close()
                        number, shard = at[k], Shard(shard_uri(base, at[k]))
                    if home[k] == number:
                        r, o = record[k], offset[k]
                    else:  # the key's records run on from the shards before
                        r = int(shard.null.sum())
                        o = int(shard.lengths[:r].sum())
                    left = many[k]
                    while left and r < shard.n and shard.keys[r] == doc[k] and not shard.null[r]:
                        out.append(_record(doc[k], before[k] + o, shard, r, o, digests))
                        size += int(shard.lengths[r]) * shard.width
                        o += int(shard.lengths[r])
                        r += 1
                        left -= 1
                        if size > 1 << 22:
                            yield _records(out, digests)
                            out, size = [], 0
                yield _records(out, digests)

        return asked.mapInArrow(fetch, _schema(digests))

    def read_unkeyed(self, digests: bool = False) -> DataFrame:
        """Records whose doc_id is null; they precede all others in the shards that have them."""
        base = self.base

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    shard, o = Shard(shard_uri(base, number)), 0
                    for r in range(int(shard.null.sum())):
                        yield _records([_record(None, before + o, shard, r, o, digests)], digests)
                        o += int(shard.lengths[r])
                    shard.file.close()

        return self.bases.filter("unkeyed > 0").select("shard", "base").repartition(8).mapInArrow(fetch, _schema(digests))


def _schema(digests: bool) -> str:
    return "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids binary, width int")


def _record(doc: int | None, start: int, shard: Shard, r: int, o: int, digests: bool) -> tuple:
    payload, n = shard.payload(r, o), int(shard.lengths[r])
    if digests:
        return doc, start, n, zlib.crc32(np.frombuffer(payload, f"<u{shard.width}").astype("<u4"))
    return doc, start, n, payload, shard.width


def _records(rows: list[tuple], digests: bool) -> pa.RecordBatch:
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]
    fields += [("ids_crc32", pa.int64())] if digests else [("ids", pa.binary()), ("width", pa.int32())]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], [x for x, _ in fields])


def write_store(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 8_000) -> TokenStore:
    """Encodes every whole text (null: empty), closes it with end_id and writes shards and index.

    A document key that several rows share leads to all of them. Null keys are stored but not indexed.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-store")
    total = docs.count()
    shards = max(8, -(-total // shard_docs))
    base = scratch.path("files")
    runs = scratch.keep(write_shards(docs, base, tokenizer or default_tokenizer(), end_id, shards, id_col, text_col), "runs")
    sizes = runs.groupBy("shard").agg(F.sum("ids").alias("ids"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unkeyed"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.keep(sizes.select("shard", "ids", "unkeyed", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")), "bases")
    buckets = max(4, -(-total // BUCKET_KEYS))
    scratch.keep(write_index(runs, base, buckets), "buckets")
    return TokenStore(spark, base, buckets, bases)


def records(store: TokenStore, keys: DataFrame, digests: bool = False) -> DataFrame:
    """All records of the keys, and those with null keys if there are any, read back from the files by the index."""
    return store.read(store.lookup(keys), digests).unionByName(store.read_unkeyed(digests))
