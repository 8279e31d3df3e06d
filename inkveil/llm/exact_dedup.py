"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Every normalised text (A-Z lower-cased, null as empty) is cut into blocks of fixed size.
Distinct blocks are sorted and numbered; then adjacent names are paired, the distinct
pairs are numbered in turn, and so on until each document has one name. Two documents
have the same (level, name) exactly if their normalised bytes are equal: names are given
to distinct block contents and distinct pairs, never to hashes.

Only the first numbering sees text. Block rows are then joined with the names by a pair of 64-bit
digests whose injectivity over the distinct blocks is verified first; on a clash
another seed is taken. So texts are shuffled once, already deduplicated on the map side,
and every later level moves integers. Hot groups are pre-aggregated, and joins
back onto rows read written tables on both sides, which lets AQE split a skewed key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.shared import Scratch, ascii_lower, unique_ids

BLOCK_BYTES = 4096


def _blocks(source: DataFrame, block_bytes: int, seed: int) -> DataFrame:
    last = F.greatest(F.lit(0), F.ceil(F.length("body") / F.lit(block_bytes)).cast("int") - 1)
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr("body", i * block_bytes + 1, F.lit(block_bytes)))
    return (
        source.withColumn("n", last + 1)
        .withColumn("cut", cut)
        .select("rid", "doc_id", "n", "sha", F.posexplode("cut").alias("pos", "block"))
        .withColumn("h1", F.xxhash64(F.lit(seed), "block"))
        .withColumn("h2", F.xxhash64("block", F.lit(seed + 1)))
    )


def name_documents(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: rid, doc_id, sha, level, name. (level, name) is the
    collision-free identity of the normalised text; rid numbers the rows of docs."""
    body = ascii_lower(F.col(text_col))
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), body.cast("binary").alias("body"))
    source = source.withColumn("sha", F.sha2("body", 256))
    seed = 17
    while True:
        named = _blocks(source.withColumn("sha", F.lit(None).cast("string")), block_bytes, seed).select("h1", "h2", "block").distinct()
        named = named.sortWithinPartitions("block").select("h1", "h2", F.monotonically_increasing_id().alias("name"))
        names = scratch.keep(named, f"names-{seed}")
        if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            break
        scratch.drop(f"names-{seed}")
        seed += 2
    rows = scratch.keep(_blocks(source, block_bytes, seed).drop("block"), "blocks")
    level, current = 0, scratch.keep(rows.join(names, ["h1", "h2"]).select("rid", "doc_id", "sha", "n", "pos", "name"), "level-0")
    scratch.drop("blocks", f"names-{seed}")
    finished = []
    while True:
        finished.append(current.filter("n = 1").select("rid", "doc_id", "sha", F.lit(level).alias("level"), "name"))
        open_rows = current.filter("n > 1")
        if open_rows.isEmpty():
            break
        pairs = open_rows.groupBy("rid", "doc_id", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.shiftright("pos", 1).alias("pos")).agg(
            F.max("sha").alias("sha"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b"),
        )
        pairs = scratch.keep(pairs, f"pairs-{level}")
        names = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name"))
        names = scratch.keep(names, f"pair-names-{level}")
        level += 1
        current = scratch.keep(pairs.join(names, ["a", "b"]).select("rid", "doc_id", "sha", "n", "pos", "name"), f"level-{level}")
        scratch.drop(f"pairs-{level - 1}", f"pair-names-{level - 1}")
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: rid, doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised text, the one with the largest doc_id is kept (a null id is
    the smallest; of repeated rows with the same id, exactly one). Null and empty texts
    are equal. An empty table gives an empty result. Other columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = name_documents(docs, scratch, id_col, text_col, block_bytes)
    best = F.max(F.struct("doc_id", "rid"))
    groups = scratch.keep(rows.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["level", "name"]).select(
        "rid",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops; all columns stay as they are, whatever their names."""
    if unique_ids(docs, id_col):
        gone = exact_groups(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
        return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
    # Ids repeat or are null: rows are told apart by a number written beside them, which all plans read.
    scratch = Scratch(docs.sparkSession, "numbered")
    names = docs.columns
    numbered = scratch.keep(docs.select(F.monotonically_increasing_id().alias("__row"), *names), "docs")
    # The number, which goes with the id, decides between rows of one id; a null id is the smallest.
    key = F.struct(F.col(id_col).alias("id"), F.col("__row").alias("row"))
    rows = numbered.select(key.alias("key"), F.col(text_col).alias("body"))
    gone = exact_groups(rows, "key", "body").filter(~F.col("kept")).select(F.col("doc_id.row").alias("__gone"))
    return numbered.join(gone, F.col("__row") == F.col("__gone"), "left_anti").select(*names)
