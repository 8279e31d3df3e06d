"""Token counts by an exact length histogram.

Documents are aggregated by encoded length (pre-aggregated before the shuffle, so a hot
length costs one row per task). Suffix sums over the histogram then answer, for every
context limit, how many documents are longer and how many tokens truncation leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.encode import default_tokenizer, encoder
from inkveil.llm.shared import Scratch

#: Distinct lengths whose suffix sums one task computes.
BLOCK = 64


def encoded_lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of each whole text; null and empty texts have 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for i, j, _, at in coder.column(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at))], ["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(count, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and n_docs. The number of rows is that of distinct lengths."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_table(histogram: DataFrame) -> DataFrame:
    """One row per distinct length L, which stands for every context limit from the previous
    length up to L: n_docs of that length, docs_at_least and tokens_at_least (of documents with
    L tokens or more), docs_total, tokens_total, and truncated_total, the tokens that remain if
    each document is cut after L tokens. Empty input, no rows.

    Suffix sums run in two steps, within blocks of lengths and over block totals, so no
    task sorts the whole histogram.
    """
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("bd").over(everything).alias("docs_total"),
        F.sum("bt").over(everything).alias("tokens_total"),
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(totals, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("docs_after")).alias("docs_at_least"),
        (F.sum("tokens").over(within) + F.col("tokens_after")).alias("tokens_at_least"),
        "docs_total",
        "tokens_total",
    )
    below = F.col("tokens_total") - F.col("tokens_at_least")
    return out.withColumn("truncated_total", below + F.col("n_tokens") * F.col("docs_at_least"))


def totals_for_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit (a short list of parameters): documents longer than it, and the tokens left
    after cutting at it; answered from the suffix table alone."""
    picks: list[Column] = [F.struct(F.lit(x).cast("long").alias("context_limit"), *_at(x)) for x in limits]
    row = table.agg(F.max("docs_total").alias("d"), F.max("tokens_total").alias("t"), *[_first_at_least(x) for x in limits])
    return row.select(F.explode(F.array(*picks)).alias("x")).select("x.*")


def _first_at_least(limit: int) -> Column:
    longer = F.col("n_tokens") > limit
    return F.min(F.when(longer, F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias(f"m{limit}")


def _at(limit: int) -> list[Column]:
    docs = F.coalesce(F.col(f"m{limit}.docs_at_least"), F.lit(0))
    tokens = F.coalesce(F.col(f"m{limit}.tokens_at_least"), F.lit(0))
    left = F.coalesce(F.col("t"), F.lit(0)) - tokens + limit * docs
    return [docs.alias("docs_longer"), left.alias("tokens_left")]


def quantiles(table: DataFrame, probabilities: list[float]) -> DataFrame:
    """Exact lower quantiles of document length: the smallest length whose share of documents up to
    it reaches the probability."""
    up_to = F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")
    row = table.agg(*[F.min(F.when(up_to >= F.col("docs_total") * F.lit(p), F.col("n_tokens"))).alias(f"q{i}") for i, p in enumerate(probabilities)])
    pairs = [F.struct(F.lit(p).alias("probability"), F.col(f"q{i}").alias("n_tokens")) for i, p in enumerate(probabilities)]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def token_counts(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    histogram = length_histogram(encoded_lengths(docs, tokenizer or default_tokenizer(), id_col, text_col))
    return suffix_table(Scratch(docs.sparkSession, "token-counts").keep(histogram, "histogram"))
