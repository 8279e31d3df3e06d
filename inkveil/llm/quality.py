"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text is reduced to a short vector of transformed statistics. Shares of short texts are drawn to those of prose, which
are learned from the training rows of label 1. Class means and covariances come from sums over all training rows; covariances are
shrunk towards their own diagonal and a floor, factored once (Cholesky), and a score is the posterior from
the difference of Mahalanobis log-densities, divided by a temperature that training rows kept out of the moments set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm import bytetext as B
from inkveil.llm.components import id_filter, passes
from inkveil.llm.shared import Scratch

#: Statistics counted of a text.
RAW = ("bytes", "words", "letters", "upper", "exclaim", "symbols", "bars", "digits", "newline", "distinct", "repeats", "top", "marked", "entropy")
_AT = {name: k for k, name in enumerate(RAW)}

FEATURES = ("words", "word_length", "upper", "exclaim", "symbols", "bars", "digits", "newline", "distinct", "repeats", "top", "entropy", "marked")

#: Parameters: how many bytes and words of prose a text is drawn to; shrinkage of covariances and their floor; the share of training
#: rows (one in so many) that sets the temperature, and the temperatures tried.
MORE_BYTES, MORE_WORDS = 100, 20
SHRINK, FLOOR = 0.1, 2e-3
KEPT_OUT = 5
TEMPERATURES = np.geomspace(1, 1000, 61)

_CLASS = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "exclaim": np.isin(np.arange(256), [33]),
    "symbols": np.isin(np.arange(256), [ord(c) for c in "#$%&*+/<=>@^_~\\`{}[]"]),
    "bars": np.isin(np.arange(256), [124]),
    "digits": np.isin(np.arange(256), np.arange(48, 58)),
    "newline": np.isin(np.arange(256), [10]),
    "letters": B.ALNUM & ~np.isin(np.arange(256), np.arange(48, 58)) | np.isin(np.arange(256), np.arange(65, 91)),
}
_ODD = np.isin(np.arange(256), [ord(c) for c in "!#$%&*+/<=>@^_~|\\`{}[]"])


def _counts(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask[data], out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of raw statistics per text."""
    n = len(offsets) - 1
    low = B.LOWER[data]
    starts, ends, first = B.words(low, offsets, B.NOT_SPACE)
    digest = B.digests(low, starts, ends)
    length = np.diff(offsets)
    out = np.zeros((n, len(RAW)))
    out[:, 0], out[:, 1] = length, np.diff(first)
    for name, mask in _CLASS.items():
        out[:, _AT[name]] = _counts(data, offsets, mask)
    marks = np.zeros(len(starts) + 1, np.int64)
    if len(starts):
        np.cumsum(_ODD[data[ends - 1]], out=marks[1:])
    out[:, _AT["marked"]] = marks[first[1:]] - marks[first[:-1]]
    for i in np.flatnonzero(out[:, 1]):
        word = digest[first[i] : first[i + 1]]
        _, counts = np.unique(word, return_counts=True)
        share = np.bincount(low[offsets[i] : offsets[i + 1]], minlength=256) / length[i]
        share = share[share > 0]
        out[i, _AT["distinct"] : _AT["top"] + 1] = len(counts), np.count_nonzero(word[1:] == word[:-1]), counts.max()
        out[i, _AT["entropy"]] = -(share * np.log2(share)).sum()
    return out


BYTE_SHARES = ("upper", "exclaim", "symbols", "bars", "digits", "newline")
WORD_SHARES = ("repeats", "top", "marked")


@dataclass
class Prose:
    """What short texts are drawn to: shares, bytes a word, entropy, and the power of a text's length that its distinct words follow."""

    share: dict[str, float]
    word_bytes: float
    entropy: float
    growth: float

    @classmethod
    def of(cls, sums: np.ndarray | None) -> Prose:
        """From sums of prose_terms over texts."""
        if sums is None or not sums[0] or not sums[2]:
            return cls(dict.fromkeys(BYTE_SHARES + WORD_SHARES, 0.0), 0.0, 0.0, 1.0)
        n, raw, (x, y, xx, xy) = sums[0], sums[1 : 1 + len(RAW)], sums[1 + len(RAW) :]
        share = {c: raw[_AT[c]] / raw[_AT["bytes"]] for c in BYTE_SHARES} | {c: raw[_AT[c]] / raw[_AT["words"]] for c in WORD_SHARES}
        spread = n * xx - x * x
        return cls(share, raw[_AT["bytes"]] / raw[_AT["words"]], raw[_AT["entropy"]] / n, (n * xy - x * y) / spread if spread > 1e-9 else 1.0)

    def features(self, raw: np.ndarray) -> np.ndarray:
        """Transformed statistics; shares as angles, which evens out their spread."""
        r = {name: raw[:, k] for name, k in _AT.items()}
        out = {"words": np.log1p(r["words"]), "word_length": np.log1p((r["bytes"] + MORE_WORDS * self.word_bytes) / (r["words"] + MORE_WORDS))}
        for names, total, more in ((BYTE_SHARES, r["bytes"], MORE_BYTES), (WORD_SHARES, r["words"], MORE_WORDS)):
            out |= {c: np.arcsin(np.sqrt(np.clip((r[c] + more * self.share[c]) / (total + more), 0, 1))) for c in names}
        out["distinct"] = np.log(r["distinct"] + MORE_WORDS) - self.growth * np.log(r["words"] + MORE_WORDS)
        out["entropy"] = (r["entropy"] * r["bytes"] + self.entropy * MORE_BYTES) / (r["bytes"] + MORE_BYTES)
        return np.stack([out[c] for c in FEATURES], axis=1)


def prose_terms(raw: np.ndarray) -> np.ndarray:
    """Of one text per row what Prose.of sums."""
    x, y = np.log(raw[:, _AT["words"]] + MORE_WORDS), np.log(raw[:, _AT["distinct"]] + MORE_WORDS)
    return np.column_stack([np.ones(len(raw)), raw, x, y, x * x, x * y])


@dataclass
class Discriminant:
    """Two Gaussians: means, inverse Cholesky factors, half log-determinants and log-priors of classes 0 and 1."""

    means: np.ndarray
    inverse: np.ndarray
    half_logdet: np.ndarray
    log_prior: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of class 1 against class 0."""
        density = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.inverse[c].T
            density.append(self.log_prior[c] - self.half_logdet[c] - 0.5 * (z * z).sum(1))
        return density[1] - density[0]


def fit(sums: dict[int, np.ndarray], shrink: float = SHRINK, floor: float = FLOOR) -> Discriminant:
    """From each class's moment_terms. A class with too few rows for a covariance takes the pooled one, a class without rows also the pooled
    mean with a small prior, so that scores stay defined."""
    d = len(FEATURES)
    parts = [(p[0], p[1 : 1 + d], p[1 + d :].reshape(d, d)) for p in (sums.get(c, np.zeros(1 + d + d * d)) for c in (0, 1))]
    n_all = sum(p[0] for p in parts)
    mean_all = sum(p[1] for p in parts) / max(1, n_all)
    cov_all = sum(p[2] for p in parts) / max(1, n_all) - np.outer(mean_all, mean_all)
    means, inverse, half, prior = [], [], [], []
    for n, s, q in parts:
        mean = s / n if n else mean_all
        cov = q / n - np.outer(mean, mean) if n > d else cov_all
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + floor * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        inverse.append(np.linalg.inv(factor))
        half.append(np.log(np.diag(factor)).sum())
        prior.append(np.log((n + 1) / (n_all + 2)))
    return Discriminant(np.array(means), np.array(inverse), np.array(half), np.array(prior))


def moment_terms(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)])


@dataclass
class Model:
    prose: Prose
    discriminant: Discriminant
    temperature: float
    without_letters: float

    def score(self, raw: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        z = self.discriminant.log_odds(self.prose.features(raw)) / self.temperature
        return np.where(raw[:, _AT["letters"]] > 0, 1 / (1 + np.exp(-np.clip(z, -700, 700))), self.without_letters)


def _sums(rows: DataFrame, of) -> dict[int, np.ndarray]:
    """Sums per label over all rows (label, x) of what `of` makes of them: a row per task and label, then one per label."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            label, raw = batch.column(0).to_numpy(), np.asarray(batch.column(1).flatten()).reshape(-1, len(RAW))
            for a in range(0, len(raw), 1024):
                for c in np.unique(label[a : a + 1024]).tolist():
                    part = raw[a : a + 1024][label[a : a + 1024] == c]
                    total[c] = total.get(c, 0) + of(part, c).sum(0)
        for c, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(v), pa.int32()), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["label", "k", "v"])

    found = rows.select("label", "x").mapInArrow(add, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in sorted(found, key=lambda r: (r["label"], r["k"])):
        out[r["label"]] = np.r_[out.get(r["label"], []), r["v"]]
    return out


def train(labelled: DataFrame) -> Model:
    """From a written table of training rows: label (0 or 1), x (raw statistics) and fold (0 to KEPT_OUT - 1; the rows of fold 0 set the
    temperature only, by the mean log-loss against smoothed labels)."""
    with_letters = labelled.filter(F.get("x", F.lit(_AT["letters"])) > 0)
    moments, kept_out = with_letters.filter("fold != 0"), with_letters.filter("fold = 0")
    prose = Prose.of(_sums(moments, lambda raw, c: prose_terms(raw)).get(1))
    discriminant = fit(_sums(moments, lambda raw, c: moment_terms(prose.features(raw))))
    count = _sums(labelled, lambda raw, c: np.column_stack([np.ones(len(raw)), raw[:, _AT["letters"]] == 0, (raw[:, _AT["letters"]] > 0)]))
    total = [count.get(c, np.zeros(3)) for c in (0, 1)]
    base = (total[1][0] + 1) / (total[0][0] + total[1][0] + 2)
    held = _sums(kept_out, lambda raw, c: np.ones((len(raw), 1)))
    target = {0: 1 / (held.get(0, [0])[0] + 2), 1: (held.get(1, [0])[0] + 1) / (held.get(1, [0])[0] + 2)}

    def losses(raw: np.ndarray, c: int) -> np.ndarray:
        z = np.clip(discriminant.log_odds(prose.features(raw)), -1e6, 1e6)[:, None] / TEMPERATURES[None, :]
        return target[c] * np.logaddexp(0, -z) + (1 - target[c]) * np.logaddexp(0, z)

    loss = sum(_sums(kept_out, losses).values())
    temperature = float(TEMPERATURES[int(np.argmin(loss))]) if np.ndim(loss) else 1.0
    return Model(prose, discriminant, temperature, float((total[1][1] + base) / (total[0][1] + total[1][1] + 1)))


def trained(docs: DataFrame, labels: DataFrame, training: Column, id_col: str, text_col: str) -> Model:
    """Statistics are made only of rows that have a label to learn from."""
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.select(F.col("doc_id").cast("string").alias("l_id"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1) and l_id is not null")
    known = scratch.keep(known.withColumn("h", F.xxhash64("l_id")), "labels")
    shipped = docs.sparkSession.sparkContext.broadcast(id_filter(known.select("h")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(shipped.value, batch.column(1).to_numpy())))
            data, offsets = B.column_bytes(batch.column(2))
            for i, j in B.runs(offsets):
                x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * len(RAW)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), flat], ["d_id", "x"])

    key = F.col(id_col).cast("string")
    some = docs.select(F.col(id_col).alias("doc_id"), key.alias("d_id"), F.xxhash64(key).alias("h"), F.col(text_col).alias("text")).filter(F.coalesce(training, F.lit(False)) & F.col("d_id").isNotNull())
    rows = some.select("d_id", "h", "text").mapInArrow(count, "d_id string, x array<double>")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "d_id"), F.lit(KEPT_OUT)).alias("fold")
    labelled = scratch.keep(rows.join(known, F.col("d_id") == F.col("l_id")).select("label", "x", fold), "statistics")
    model = train(labelled)
    scratch.drop("labels", "statistics")
    return model


def score_quality(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out (not training), score (probability of label 1) and predicted (1 if score >= 0.5) of each row of docs.

    labels has doc_id and quality (0 or 1; null is no label; repeated rows count each). training is a condition on
    doc_id for rows whose labels may be learned; rows with a null id are scored, never learned from. Null and empty texts, and others
    without a letter, take the share of label 1 among training rows of that kind, smoothed by the share among all. Repeated rows are scored each,
    with one result; a text of any length is one row of statistics. Without any label all scores are 0.5; an empty table gives no rows.
    """
    model = trained(docs, labels, training, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.column_bytes(batch.column(2))
            for i, j in B.runs(offsets):
                s = model.score(statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (0, 1)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", (~F.coalesce(training, F.lit(False))).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score_quality predicts 1, with all their columns. Rows are scored where they are; nothing is
    shuffled but the training rows' statistics."""
    model = trained(docs, labels, training, id_col, text_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.column_bytes(batch.column(place))
            for i, j in B.runs(offsets):
                s = model.score(statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield batch.slice(i, j - i).filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)
