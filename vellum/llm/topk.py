"""Exact top-k inner-product search with multi-resolution segment statistics.

Vectors are taken to integers, floor(scale * x). For a cut of the dimensions into segments, each segment
keeps its mean and its deviation from it; by Cauchy-Schwarz the distance of two vectors is at least

    d2 >= sum over segments of width * ((mean_q - mean_x)^2 + (deviation_q - deviation_x)^2)

and an inner product is (|q|^2 + |x|^2 - d2) / 2, so a lower bound on the distance is an upper bound on the score. The cuts go
from coarse to fine (each halves the segments before it); a candidate whose bound is below the query's
k-th best score so far goes no further. Survivors get their exact integer product.

Queries are taken in waves of at most ``wave`` rows; each wave's candidates are stored and its broadcast is freed before the next,
which bounds what is broadcast and what the driver holds whatever the number of queries. The k-th best score of each query among its own wave is a first threshold for every task. Tasks return at
most k candidates a query, those at or above the threshold; one window picks the final ranks.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; a query meets
only vectors of its own length; rows that carry the query's id count as the query's own, and of
several query rows with one id the first in value order asks; a null id takes no part; equal candidates
each keep their rows; fewer candidates than k give fewer ranks. Scores that overflow a long are clipped; an empty table gives no rows; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import materialise

SCALE = 256
K = 5
QUERY_EVERY = 50
WAVE = 4096
#: Candidates by queries that are bounded at a time.
TILE = 1 << 20
#: Share of pairs left under which they are bounded one by one, not by a matrix product.
DENSE = 0.02
#: Above this magnitude float64 products are not exact; such vectors are multiplied as Python integers.
_EXACT = float(1 << 23)


def usable(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): rows that take part, with components as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where((F.size("v") > 0) & finite)


def cuts(dim: int) -> list[np.ndarray]:
    """Segment starts, coarse to fine: 1, 2, 4, ... segments of two dimensions at least."""
    out, n = [], 1
    while n == 1 or dim // n >= 2:
        out.append(np.unique(np.arange(n) * dim // n))
        n *= 2
    return out


class Statistics:
    """Integer vectors of one length, with their norms and the segment statistics of each cut."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.norm = (x * x).sum(1)
        self.levels, self.rests = [], []
        for starts in cuts(x.shape[1]):
            width = np.diff(np.append(starts, x.shape[1])).astype(np.float64)
            mean = np.add.reduceat(x, starts, axis=1) / width
            spread = np.sqrt(np.maximum(np.add.reduceat(x * x, starts, axis=1) / width - mean * mean, 0))
            root = np.sqrt(width)
            level = np.concatenate([mean * root, spread * root], axis=1)
            self.levels.append(level)  # the squared distance of two is the bound
            self.rests.append((self.norm - (level * level).sum(1)) / 2 + 1e-9 * self.norm + 1e-6)  # what a product of two lacks to the upper bound, and rounding

    def take(self, lo: int, hi: int) -> Statistics:
        out = object.__new__(Statistics)
        out.ids, out.x, out.norm, out.levels, out.rests = self.ids[lo:hi], self.x[lo:hi], self.norm[lo:hi], [m[lo:hi] for m in self.levels], [m[lo:hi] for m in self.rests]
        return out


def float_exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sums of products are integers below 2 ** 53 in any order."""
    return max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) * np.sqrt(a.shape[1]) < _EXACT


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise integer products as int64."""
    if float_exact(a, b):
        return (a * b).sum(1).astype(np.int64)
    top = (1 << 63) - 1
    return np.asarray([min(top, max(-top - 1, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for p, q in zip(a, b, strict=True)], np.int64)


def search(queries: Statistics, block: Statistics, floor: np.ndarray, k: int, counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate id, score) of what may be among the k best: at or above ``floor`` and in the block's own k best.

    ``floor`` (float, -inf where unknown) is raised in place by the k-th best score found. ``counts`` gets how many pairs
    reach each level and the exact step.
    """
    out_q, out_c, out_s = [], [], []
    step = max(1, TILE // max(1, len(block.ids)))
    for lo in range(0, len(queries.ids), step):
        q = queries.take(lo, lo + step)
        least = floor[lo : lo + step]
        mask = pair_q = pair_c = None
        for level, (a, b) in enumerate(zip(q.levels, block.levels, strict=True)):
            rest_q, rest_b = q.rests[level], block.rests[level]
            if pair_q is None:
                upper = a @ b.T
                upper += rest_b
                near = upper >= (least - rest_q)[:, None]
                mask = near if mask is None else mask & near
                if np.count_nonzero(mask) < DENSE * mask.size:
                    pair_q, pair_c = np.nonzero(mask)
            else:
                keep = np.zeros(len(pair_q), bool)
                for s in range(0, len(pair_q), 1 << 16):
                    i, j = pair_q[s : s + (1 << 16)], pair_c[s : s + (1 << 16)]
                    keep[s : s + (1 << 16)] = np.einsum("ij,ij->i", a[i], b[j]) + rest_b[j] >= least[i] - rest_q[i]
                pair_q, pair_c = pair_q[keep], pair_c[keep]
            if counts is not None:
                counts[level] += np.count_nonzero(mask) if pair_q is None else len(pair_q)
        if counts is not None:
            counts[-1] += np.count_nonzero(mask) if pair_q is None else len(pair_q)
        if pair_q is None:  # many survivors: their products as one matrix product, which is exact unless the integers are large
            if float_exact(q.x, block.x):
                mask &= q.x @ block.x.T >= least[:, None]
            pair_q, pair_c = np.nonzero(mask)
        other = q.ids[pair_q] != block.ids[pair_c]
        pair_q, pair_c = pair_q[other], pair_c[other]
        scores = np.concatenate([exact(q.x[pair_q[s : s + (1 << 16)]], block.x[pair_c[s : s + (1 << 16)]]) for s in range(0, len(pair_q), 1 << 16)]) if len(pair_q) else np.zeros(0, np.int64)
        order = np.lexsort((block.ids[pair_c], -scores.astype(np.float64), pair_q)) if len(scores) else np.zeros(0, np.int64)
        if len(scores) and np.abs(scores).max() >= 1 << 53:  # floats would tie
            order = np.asarray(sorted(range(len(scores)), key=lambda i: (pair_q[i], -int(scores[i]), block.ids[pair_c[i]])), np.int64)
        pair_q, pair_c, scores = pair_q[order], pair_c[order], scores[order]
        first = np.searchsorted(pair_q, np.arange(len(q.ids)))
        rank = np.arange(len(pair_q)) - first[pair_q] if len(pair_q) else np.zeros(0, np.int64)
        kth = rank == k - 1
        np.maximum.at(least, pair_q[kth], scores[kth].astype(np.float64))  # a view: raises floor
        good = rank < k
        out_q.append(pair_q[good] + lo)
        out_c.append(block.ids[pair_c[good]])
        out_s.append(scores[good])
    return (np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)) if out_q else (np.zeros(0, np.int64),) * 3


def by_length(ids: list[int], vectors: list, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    found: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors, strict=True):
        have = found.setdefault(len(v), ([], []))
        have[0].append(i)
        have[1].append(v)
    return {n: (np.asarray(a, np.int64), np.floor(scale * np.asarray(b, np.float64))) for n, (a, b) in found.items()}


def top_k(df: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, wave: int = WAVE, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each row of ``queries`` with the rows of ``df``, ties to the smaller id."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector)
    asked = usable(queries, id_col, vector).groupBy("id").agg(F.min("v").alias("v"))
    bounds = _wave_bounds(asked, wave)
    out = None
    for lo, hi in bounds:
        part = asked.where((F.col("id") >= lo) & (F.col("id") <= hi)).orderBy("id").collect()  # at most ``wave`` rows
        found, shared = _one_wave(spark, rows, part, k, scale)
        if len(bounds) > 1:  # stored, so that only one wave's queries are held at a time
            found = materialise(found, "wave")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _wave_bounds(asked: DataFrame, wave: int) -> list[tuple[int, int]]:
    """Id ranges of at most ``wave`` queries; only the ranges come to the driver."""
    n = asked.count()
    if n <= wave:
        ends = asked.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
        return [(ends.a, ends.b)] if n else []
    from pyspark.sql.functions import spark_partition_id as pid

    parts = asked.select("id").repartitionByRange(-(-n // max(1, wave // 4)), "id").groupBy(pid().alias("p")).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    out, have = [], 0
    for p in parts:
        if out and have + p.n <= wave:
            out[-1] = (out[-1][0], p.b)
            have += p.n
        else:
            out.append((p.a, p.b))
            have = p.n
    return out


def _one_wave(spark, rows: DataFrame, part: list, k: int, scale: int):
    """(query_id, vec_id, score) of the candidates of one wave, and the broadcast of its queries."""
    asked = {n: Statistics(*x) for n, x in by_length([r.id for r in part], [r.v for r in part], scale).items()}
    floors = {}
    for n, s in asked.items():
        floors[n] = np.full(len(s.ids), -np.inf)
        for lo in range(0, len(s.ids), 1024):
            search(s, s.take(lo, lo + 1024), floors[n], k)
    shared = spark.sparkContext.broadcast((asked, floors))

    def run(batches):
        mine, start = shared.value
        low = {n: f.copy() for n, f in start.items()}
        kept = {n: [] for n in mine}

        def settle(n):
            """Only the k best of each query that the task has seen."""
            q, c, s = (np.concatenate(x) for x in zip(*kept[n], strict=True))
            order = np.lexsort((c, -s.astype(object) if np.abs(s).max(initial=0) >= 1 << 53 else -s, q))
            q, c, s = q[order], c[order], s[order]
            good = np.arange(len(q)) - np.searchsorted(q, q) < k
            kept[n] = [(q[good], c[good], s[good])]

        for batch in batches:
            for n, (ids, x) in by_length(batch.column("id").to_pylist(), batch.column("v").to_pylist(), scale).items():
                if n not in mine:
                    continue
                for lo in range(0, len(ids), 1024):
                    kept[n].append(search(mine[n], Statistics(ids[lo : lo + 1024], x[lo : lo + 1024]), low[n], k))
                if sum(len(q) for q, _, _ in kept[n]) > 4 * k * len(low[n]):
                    settle(n)
        for n in mine:
            if kept[n]:
                settle(n)
                q, c, s = kept[n][0]
                yield pa.RecordBatch.from_arrays([pa.array(mine[n].ids[q]), pa.array(c), pa.array(s)], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long"), shared
