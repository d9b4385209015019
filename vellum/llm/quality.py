"""Quality scores from a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded, learned filters slide over overlapping windows of ``WIDTH`` bytes every
``STRIDE`` bytes, and their rectified responses are max-pooled over chunks of ``CHUNK`` windows; chunks overlap by
half and cover the whole text, the last one included however short. The mean, the largest and the
smallest pooled response of each filter over the chunks enter one logistic unit, and nothing else does. A text of less than a chunk
has fewer windows to draw its maxima from; what it lacks of a chunk scales its largest responses as further inputs of that unit.

The network is trained by Adam on the driver, on at most ``per_class`` texts a class, of longer ones windows of ``max_chars``
characters together (see ``common.labelled_sample``), with classes weighing alike.

Defined results: a null or empty text has all responses zero; a very long text is scored whole, in blocks; repeated rows are scored alike; without
labelled rows of both classes every score is the smoothed base rate; an empty table gives no rows; columns named as the results are replaced, others kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import held_out, labelled_sample, slices, text_buffers

WIDTH, STRIDE, DEPTH, FILTERS, CHUNK = 8, 4, 8, 32, 64
PER_CLASS = 1500
MAX_CHARS = 12_000
THRESHOLD = 0.7
EPOCHS = 14
#: Inputs of the last unit: mean, maximum and minimum of each filter, and the maximum times what is missing of a chunk.
INPUTS = 4 * FILTERS
#: Windows that pass through the filters at a time.
BLOCK = 1 << 14


@dataclass
class Network:
    table: np.ndarray  # (256, DEPTH)
    filters: np.ndarray  # (WIDTH * DEPTH, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (INPUTS,)
    out_bias: float

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.bias, self.out]


def windows(data: np.ndarray) -> np.ndarray:
    """(n, WIDTH) bytes of every window; zero bytes fill the last one up."""
    n = max(0, -(-(len(data) - (WIDTH - STRIDE)) // STRIDE)) if len(data) > WIDTH - STRIDE else int(len(data) > 0)
    if not n:
        return np.zeros((0, WIDTH), np.uint8)
    padded = np.zeros((n - 1) * STRIDE + WIDTH, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STRIDE]


def chunk_bounds(n: int) -> np.ndarray:
    """(k, 2) ranges of windows; each half chunk is in two of them, but for the ends."""
    half = CHUNK // 2
    starts = np.arange(0, max(1, n - half), half)
    return np.stack([starts, np.minimum(starts + CHUNK, n)], axis=1)


def responses(net: Network, w: np.ndarray) -> np.ndarray:
    """(n, FILTERS) before the rectifier."""
    return net.table[w].reshape(len(w), -1) @ net.filters + net.bias


def half_maxima(net: Network, data: np.ndarray) -> np.ndarray:
    """Largest rectified response of each filter in each run of CHUNK / 2 windows."""
    w, half, out = windows(data), CHUNK // 2, []
    for lo in range(0, len(w), BLOCK):
        r = responses(net, w[lo : lo + BLOCK])
        out.append(np.maximum.reduceat(r, np.arange(0, len(r), half), axis=0))
    return np.maximum(np.concatenate(out), 0) if out else np.zeros((0, FILTERS), np.float32)


def missing_share(n_windows: int) -> float:
    return 1 - min(n_windows, CHUNK) / CHUNK


def unit_inputs(chunks: np.ndarray, missing: float) -> np.ndarray:
    if not len(chunks):
        return np.zeros(INPUTS, np.float32)
    high = chunks.max(0)
    return np.concatenate([chunks.mean(0), high, chunks.min(0), high * np.float32(missing)])


def pooled_features(halves: np.ndarray, n_windows: int) -> np.ndarray:
    """Inputs of the last unit; a chunk is two neighbouring halves."""
    return unit_inputs(np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves, missing_share(n_windows))


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def probability(net: Network, data: np.ndarray) -> float:
    return float(_logistic(float(pooled_features(half_maxima(net, data), len(windows(data))) @ net.out) + net.out_bias))


def _gradients(net: Network, w: np.ndarray, target: float, weight: float):
    """Gradients of the weighted log loss for one text; only the winning window of each pool takes part."""
    r = responses(net, w)
    bounds = chunk_bounds(len(w))
    best = np.stack([r[a:b].argmax(0) + a for a, b in bounds])  # (chunks, FILTERS)
    top = np.take_along_axis(r, best, 0)
    chunks = np.maximum(top, 0)
    k = len(chunks)
    missing = missing_share(len(w))
    feats = unit_inputs(chunks, missing)
    p = _logistic(float(feats @ net.out) + net.out_bias)
    d = weight * (p - target)
    mean, high, low, short = (d * net.out).reshape(4, FILTERS)
    high = high + short * missing
    dc = np.repeat(mean[None] / k, k, 0).astype(np.float32)
    f = np.arange(FILTERS)
    np.add.at(dc, (chunks.argmax(0), f), high)
    np.add.at(dc, (chunks.argmin(0), f), low)
    dc[top <= 0] = 0
    at = best.ravel()
    rows, back = np.unique(at, return_inverse=True)
    dr = np.zeros((len(rows), FILTERS), np.float32)
    np.add.at(dr, (back.ravel(), np.tile(f, k)), dc.ravel())
    x = net.table[w[rows]].reshape(len(rows), -1)
    dx = (dr @ net.filters.T).reshape(-1, DEPTH)
    dt = np.zeros_like(net.table)
    np.add.at(dt, w[rows].ravel(), dx)
    return [dt, x.T @ dr, dr.sum(0), (d * feats).astype(np.float32)], d


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS, batch: int = 16, rate: float = 0.006) -> Network:
    rng = np.random.default_rng(11)
    net = Network(
        rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32), rng.normal(0, (1 / (WIDTH * DEPTH)) ** 0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.05, INPUTS).astype(np.float32), 0.0,
    )
    y = np.asarray([t for _, t in sample], np.float64)
    if not len(y) or y.min() == y.max():
        base = (y.sum() + 1) / (len(y) + 2)
        net.out[:] = 0
        net.out_bias = float(np.log(base / (1 - base)))
        return net
    texts = [windows(np.frombuffer(t.encode("utf-8", "replace"), np.uint8)) for t, _ in sample]
    weigh = {t: len(y) / (2 * np.sum(y == t)) for t in (0, 1)}
    usable = [i for i in range(len(y)) if len(texts[i])]
    first = [np.zeros_like(p) for p in net.parameters()] + [np.zeros(1)]
    second = [np.zeros_like(p) for p in net.parameters()] + [np.zeros(1)]
    steps, total = 0, epochs * -(-len(usable) // batch)
    for _ in range(epochs):
        order = rng.permutation(usable)
        for lo in range(0, len(order), batch):
            sums, bias = None, 0.0
            part = order[lo : lo + batch]
            for i in part:
                g, d = _gradients(net, texts[i], y[i], weigh[int(y[i])])
                sums = g if sums is None else [a + b for a, b in zip(sums, g, strict=True)]
                bias += d
            steps += 1
            step = rate * (1 - steps / (total + 1))
            for j, (p, g) in enumerate(zip([*net.parameters(), None], [*sums, np.asarray([bias])], strict=True)):
                g = g / len(part) + (1e-4 * p if p is not None else 0)
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                move = step * (first[j] / (1 - 0.9**steps)) / (np.sqrt(second[j] / (1 - 0.999**steps)) + 1e-8)
                if p is None:
                    net.out_bias -= float(move[0])
                else:
                    p -= move.astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Network:
    return fit(labelled_sample(docs, labels, "quality", per_class, max_chars, seed=2))


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` (text, ...) that aren't named so, with ``quality_score`` and ``quality_predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        own = shared.value
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column("text"))
            s = np.fromiter((probability(own, data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.float64, batch.num_rows)
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, "quality_score", "quality_predicted"])

    kept = docs.drop("quality_score", "quality_predicted")
    names = kept.columns
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}quality_score double, quality_predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
