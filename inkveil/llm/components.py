"""Connected components and id filters of bounded size, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.bytetext import mix
from inkveil.llm.shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str, rounds: int | None = None) -> DataFrame:
    """node and component (the smallest node it reaches) of every node of edges (u, v: long).

    Each round gives a node the least label among its own and its neighbours', then the label of that label's
    node, until no label changes. Labels are pre-aggregated minima, and joins read written tables on both sides, so a node with
    very many neighbours is split by AQE. Nothing goes to the driver but a flag per round.

    With `rounds`, it ends after so many: nodes with one label are then connected, but connected nodes may still
    have different labels.
    """
    plain = edges.filter("u is not null and v is not null and u != v")
    both = scratch.keep(plain.unionByName(plain.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{label}-edges")
    least = F.least("u", "m")
    labels = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), least.alias("component"), least.alias("was")), f"{label}-0")
    step = 0
    while True:
        step += 1
        none = F.lit(None).cast("long")
        near = both.join(labels, both["u"] == labels["node"]).select(F.col("v").alias("node"), "component", none.alias("was"))
        own = labels.select("node", "component", F.col("component").alias("was"))
        lower = near.unionByName(own).groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was"))
        lower = scratch.keep(lower, f"{label}-near-{step}")
        far = lower.select(F.col("node").alias("f_node"), F.col("component").alias("f_component"))
        jumped = lower.join(far, lower["component"] == far["f_node"]).select("node", F.col("f_component").alias("component"), "was")
        jumped = scratch.keep(jumped, f"{label}-{step}")
        scratch.drop(f"{label}-near-{step}", f"{label}-{step - 1}")
        labels = jumped
        if step == rounds or jumped.filter("component != was").isEmpty():
            scratch.drop(f"{label}-edges")
            return labels.select("node", "component")


#: Binary logarithms of the least and most bits of a filter (64 MB), and bits for each id in between.
LEAST_BITS, MOST_BITS, BITS_EACH = 20, 29, 16


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B))
    last = np.uint64((1 << bits) - 1)
    return (h & last).astype(np.int64), ((h >> np.uint64(32)) & last).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the first column (long) of a written table. It grows with the ids up to 2**MOST_BITS bits.

    It lets all ids pass and keeps most others out; beyond some 10^8 ids it keeps fewer out, so what
    passes may only be wanted, never decided, by it.
    """
    one = ids.filter(F.col(ids.columns[0]).isNotNull()).select(F.col(ids.columns[0]).cast("long"))
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * one.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(words)
        for a in range(0, len(used), 65536):
            part = used[a : a + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(words[part].view(np.int64))], ["word", "bits"])

    marked = one.mapInArrow(mark, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[marked.column("word").to_numpy()] = marked.column("bits").to_numpy().view(np.uint64)
    return words


def passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for at in _places(ids, len(words).bit_length() + 5):
        out &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out
