"""Toxicity scores: a linear model on character n-grams scaled by naive Bayes log-count ratios.

Features say which hashed n-grams of 3 to 6 code points (A-Z lower-cased, white space as one blank) occur in a
text. Each is scaled by its log-count ratio, log((p + a) / |p + a|) - log((q + a) / |q + a|) with p and q the
documents of either class that hold it, and a logistic regression is fitted on the scaled features. Score
weights are the products of both, so scoring a text is one lookup for each n-gram that occurs in it.

The model is fitted on the driver on at most ``per_class`` texts a class, of longer ones windows of ``max_chars``
characters together (see ``common.labelled_sample``); the weights are a table of ``2 ** BUCKET_BITS`` floats. With few toxic texts to
learn from (some tens) precision is poor, see the README.

Defined results: a null or empty text has no features and gets the score of the intercept; a very long text is scored whole; repeated rows
are scored alike; without labelled rows of both classes every score is the smoothed base rate; an empty table gives no rows; columns named as the
results are replaced, others kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import held_out, labelled_sample, slices

BUCKET_BITS = 20
SIZES = (3, 4, 5, 6)
PER_CLASS = 3000
MAX_CHARS = 20_000
THRESHOLD = 0.3
SMOOTHING = 1.0
ALPHA = 0.5
#: Standard deviations of a log-count ratio from which it counts.
NOISE = 3.0

_MUL = np.uint32(0x9E3779B1)


def code_points(text: str) -> np.ndarray:
    """uint32 code points between two blanks; A-Z lower-cased, ASCII white space as blanks."""
    x = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    x[(x >= 65) & (x <= 90)] += 32
    x[(x >= 9) & (x <= 13)] = 32
    return x


def present(text: str, sizes: tuple[int, ...] = SIZES, bucket_bits: int = BUCKET_BITS) -> np.ndarray:
    """Sorted buckets of the n-grams that occur in the whole text; empty for an empty text."""
    if not text:
        return np.zeros(0, np.int64)
    x, found = code_points(text), []
    h, made = x * _MUL, 1
    for n in sizes:
        if len(x) < n:
            break
        while made < n:  # each step adds the next code point to all hashes
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + x[made:] * _MUL
            made += 1
        found.append(((h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE3D) + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)) >> np.uint32(32 - bucket_bits))
    if not found:
        return np.zeros(0, np.int64)
    found = np.concatenate(found)
    if len(found) < 1 << (bucket_bits - 4):
        return np.unique(found).astype(np.int64)
    seen = np.zeros(1 << bucket_bits, bool)  # long texts: marking is cheaper than sorting
    seen[found] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    bucket_bits: int = BUCKET_BITS
    sizes: tuple[int, ...] = SIZES

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[present(text or "", self.sizes, self.bucket_bits)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(sample: list[tuple[str, int]], sizes: tuple[int, ...] = SIZES, bucket_bits: int = BUCKET_BITS, epochs: int = 12, rate: float = 0.4, l2: float = 1e-6) -> Model:
    """Log-count ratios, then logistic regression on them by AdaGrad, in a fixed order. The rarer class weighs more, by the root of what would make them even."""
    y = np.asarray([t for _, t in sample], np.float64)
    size = 1 << bucket_bits
    if not len(y) or y.min() == y.max():
        rate_of = (y.sum() + SMOOTHING) / (len(y) + 2 * SMOOTHING)
        return Model(np.zeros(size, np.float32), float(np.log(rate_of / (1 - rate_of))), bucket_bits, sizes)
    counts = [np.full(size, ALPHA, np.float32), np.full(size, ALPHA, np.float32)]
    for text, t in sample:
        counts[t][present(text, sizes, bucket_bits)] += 1
    docs = [np.sum(y == 0), np.sum(y == 1)]
    ratio = (np.log(counts[1] / docs[1]) - np.log(counts[0] / docs[0])).astype(np.float32)
    ratio[(counts[0] + counts[1]) < 3 + 2 * ALPHA] = 0  # an n-gram of a document or two is no evidence
    # a ratio within its sampling noise tells nothing, and over a long text adds up to much of it
    ratio[np.abs(ratio) < NOISE * np.sqrt(1 / counts[0] + 1 / counts[1])] = 0
    rows = []  # features once more, as few of them count
    for text, _ in sample:
        r = present(text, sizes, bucket_bits)
        rows.append(r[ratio[r] != 0].astype(np.int32))
    w, b = np.zeros(size, np.float32), 0.0
    past, past_b = np.full(size, 1.0, np.float32), 1.0
    weigh = {t: np.sqrt(len(y) / (2 * n)) for t, n in enumerate(docs)}
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            r = rows[i]
            x = ratio[r]
            z = float((w[r] * x).sum(dtype=np.float64)) + b
            g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[i]) * weigh[int(y[i])]
            if abs(g) < 1e-4:
                continue
            grad = np.float32(g) * x + np.float32(l2) * w[r]
            past[r] += grad * grad
            w[r] -= np.float32(rate * 0.1) * grad / np.sqrt(past[r])
            past_b += g * g
            b -= rate * 0.1 * g / np.sqrt(past_b)
    return Model(w * ratio, float(b), bucket_bits, sizes)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    return fit(labelled_sample(docs, labels, "toxic", per_class, max_chars, seed=4))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` (text, ...) that aren't named so, with ``toxic_score`` and ``toxic_predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in slices(batches):
            s = np.fromiter((own.score(t) for t in batch.column("text").to_pylist()), np.float64, batch.num_rows)
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, "toxic_score", "toxic_predicted"])

    kept = docs.drop("toxic_score", "toxic_predicted")
    names = kept.columns
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}toxic_score double, toxic_predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
