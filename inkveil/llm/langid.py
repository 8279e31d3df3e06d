"""Language identification: averaged hashed subword embeddings with a linear softmax.

Byte n-grams of the simplified text (A-Z lower-cased, everything but letters a space) are hashed
into a fixed table; a text is the mean of its n-grams' embeddings, and a linear softmax
gives the classes. Trained by stochastic gradient descent in numpy on a bounded sample
of labelled rows (per_language rows of each language, by a hash of the id). A held-back part of
the sample sets a temperature (calibration) and the score below which a prediction
is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm import bytetext as B

BUCKETS = 1 << 13
ORDERS = (2, 3, 4)
DIMENSION = 16

#: Rows of each language that training sees, about, and rows of all languages: the documented bounds of the sample.
PER_LANGUAGE, ALL_LANGUAGES = 1000, 20_000

#: With fewer sampled rows, all of them both train and calibrate.
FEW = 50

#: Rejection keeps at least this share of right answers among accepted held-back rows.
TARGET_PRECISION = 0.99

UNDETERMINED = "und"

_SIMPLE = np.full(256, 0x20, np.uint8)
_SIMPLE[0x61:0x7B] = np.arange(0x61, 0x7B)
_SIMPLE[0x41:0x5B] = np.arange(0x61, 0x7B)
_SIMPLE[0x80:] = np.arange(0x80, 0x100)


def _grams(data: np.ndarray) -> np.ndarray:
    """Table places of all n-grams of one text's bytes."""
    x = _SIMPLE[data].astype(np.uint32)
    parts = []
    for n in ORDERS:
        m = len(x) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n, np.uint32)
        for k in range(n):
            code = (code ^ x[k : k + m]) * np.uint32(16777619)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        parts.append(code >> np.uint32(32 - 13))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def gram_counts(data: np.ndarray) -> np.ndarray:
    """Counts of a whole text's n-grams by table place, in segments, so memory doesn't follow its length."""
    total = np.zeros(BUCKETS, np.float32)
    for a in range(0, max(1, len(data)), B.SEGMENT):
        part = data[a : a + B.SEGMENT + max(ORDERS) - 1]
        total += np.bincount(_grams(part), minlength=BUCKETS)
        if a + B.SEGMENT < len(data) and len(part) > B.SEGMENT:  # the overlap counts once
            total -= np.bincount(_grams(data[a + B.SEGMENT : a + B.SEGMENT + max(ORDERS) - 1]), minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, mean: np.ndarray) -> np.ndarray:
        return (mean @ self.embedding) @ self.weight + self.bias

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        return softmax(self.logits(mean) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def sample(docs: DataFrame, training: Column, id_col: str, text_col: str, lang_col: str, per_language: int) -> list:
    """Rows (lang, places, counts) of the bounded sample; n-grams are counted on the executors. With many languages each has fewer rows."""
    pool = docs.filter(F.coalesce(training, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = pool.groupBy(F.col(lang_col).alias("lang")).count().collect()  # one row per language
    if not sizes:
        return []
    if len(sizes) > ALL_LANGUAGES // 10:
        raise ValueError(f"{len(sizes)} values of {lang_col} are too many to learn")
    per_language = min(per_language, ALL_LANGUAGES // len(sizes))
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, per_language / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = pool.filter(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("order"), id_col).alias("o"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.column_bytes(batch.column(1))
            where, many = [], []
            for i in range(batch.num_rows):
                c = gram_counts(data[offsets[i] : offsets[i + 1]])
                k = np.flatnonzero(c)
                where.append(k.astype("<u2").tobytes())
                many.append(c[k].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(where, pa.binary()), pa.array(many, pa.binary())], ["lang", "o", "places", "counts"])

    rows = picked.mapInArrow(count, "lang string, o long, places binary, counts binary").collect()
    return sorted(rows, key=lambda r: (r["o"], r["lang"], bytes(r["places"])))


def train(rows: list, epochs: int = 12, batch: int = 32, rate: float = 4.0, seed: int = 7) -> Model | None:
    """Stochastic gradient descent on the mean log-loss; every fifth row is held back for calibration (with under FEW rows, none)."""
    usable = [r for r in rows if len(r["places"])]
    if not usable:
        return None
    languages = sorted({r["lang"] for r in usable})
    target = np.array([languages.index(r["lang"]) for r in usable])
    rng = np.random.default_rng(seed)
    k = len(languages)
    model = Model(languages, rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32), rng.normal(0, 0.1, (DIMENSION, k)).astype(np.float32), np.zeros(k, np.float32))

    def dense(ids: np.ndarray) -> np.ndarray:
        x = np.zeros((len(ids), BUCKETS), np.float32)
        for row, i in enumerate(ids):
            c = np.frombuffer(usable[i]["counts"], "<f4")
            x[row, np.frombuffer(usable[i]["places"], "<u2")] = c / c.sum()
        return x

    every = np.arange(len(usable))
    held = every[every % 5 == 4] if len(usable) >= FEW else every
    fitted = every[every % 5 != 4] if len(usable) >= FEW else every
    steps = epochs * -(-len(fitted) // batch)
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fitted), -(-len(fitted) // batch)):
            x = dense(part)
            h = x @ model.embedding
            p = softmax(h @ model.weight + model.bias)
            p[np.arange(len(part)), target[part]] -= 1
            p /= len(part)
            now = rate * (1 - step / steps)
            back = p @ model.weight.T
            model.weight -= now * (h.T @ p)
            model.bias -= now * 0.1 * p.sum(0)
            used = np.flatnonzero(x.any(0))
            model.embedding[used] -= now * 20 * (x[:, used].T @ back)
            step += 1
    logits = np.concatenate([model.logits(dense(part)) for part in np.array_split(held, -(-len(held) // 256))])
    losses = {t: -np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(held)), target[held]])).mean() for t in np.geomspace(0.05, 20, 60)}
    model.temperature = float(min(losses, key=losses.get))
    top = softmax(logits / model.temperature)
    score, right = top.max(1), top.argmax(1) == target[held]
    order = np.argsort(-score)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= TARGET_PRECISION)
    model.reject_below = float(score[order[good[-1]]]) if len(good) else 1.0
    return model


def identify(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per row of docs: doc_id, held_out (not training), lang_pred, score (calibrated probability) and rejected.

    Predictions read the text alone, the whole of it. A null text and one without a letter give "und" with score 0, rejected; so
    does everything if there is no labelled row to learn from. Rows with a null id are predicted like others; repeated rows give one result each, the
    same. An empty table gives no rows. Of equally likely languages the first by name is given.
    """
    model = train(sample(docs, training, id_col, text_col, lang_col, per_language))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIMENSION floats, whatever the corpus
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            data, offsets = B.column_bytes(batch.column(2))
            n = batch.num_rows
            names, scores, rejected = [UNDETERMINED] * n, np.zeros(n), np.ones(n, bool)
            for a in range(0, n if m else 0, 256):
                rows = [i for i in range(a, min(n, a + 256)) if has_letter(batch.column(2)[i].as_py())]
                if not rows:
                    continue
                counts = np.stack([gram_counts(data[offsets[i] : offsets[i + 1]]) for i in rows])
                p = m.probabilities(counts / np.maximum(1, counts.sum(1, keepdims=True)))
                best = p.argmax(1)
                for i, c, s in zip(rows, best, p.max(1), strict=True):
                    names[i], scores[i], rejected[i] = m.languages[c], s, s < m.reject_below
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(np.clip(scores, 0, 1)), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), (~F.coalesce(training, F.lit(False))).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
