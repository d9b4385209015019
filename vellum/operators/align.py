"""Alignment of the pages of two versions of a document: one-to-one by least total error, or monotone by dynamic time warping."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import labels, markdown

METHODS = ("hungarian", "dtw")


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row, all different, with the least sum, for at least as many columns as rows. Shortest augmenting paths with potentials."""
    n, m = cost.shape
    row_of = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for i in range(n):
        dist, back = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        row, col = i, -1
        shift = 0.0
        while True:
            step = shift + cost[row] - u[row] - v
            better = ~done & (step < dist)
            dist[better], back[better] = step[better], col
            open_dist = np.where(done, np.inf, dist)
            nxt = int(open_dist.argmin())
            shift = open_dist[nxt]
            done[nxt] = True
            col = nxt
            if row_of[col] < 0:
                break
            row = row_of[col]
        seen = np.flatnonzero(done)
        for j in seen:
            if row_of[j] >= 0 and j != col:
                u[row_of[j]] += shift - dist[j]
            v[j] -= shift - dist[j]
        u[i] += shift
        while True:
            before = back[col]
            row_of[col] = i if before < 0 else row_of[before]
            if before < 0:
                break
            col = before
    out = [-1] * n
    for j, r in enumerate(row_of):
        if r >= 0:
            out[r] = j
    return out


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost pairs, one to one; with more rows than columns, cost-1 dummies take the rows left over."""
    n, m = cost.shape
    if not n or not m:
        return []
    padded = np.ones((n, max(n, m)))
    padded[:, :m] = cost
    return [(i, j) for i, j in enumerate(assignment(padded)) if j < m]


def warp(cost: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest monotone path from corner to corner; on the way back the diagonal is preferred, then the row above."""
    n, m = cost.shape
    if not n or not m:
        return []
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    for i in range(n):
        for j in range(m):
            total[i + 1, j + 1] = cost[i, j] + min(total[i, j], total[i, j + 1], total[i + 1, j])
    i, j, path = n, m, []
    while i and j:
        path.append((i - 1, j - 1))
        choices = [(total[i - 1, j - 1], 0, (i - 1, j - 1)), (total[i - 1, j], 1, (i - 1, j)), (total[i, j - 1], 2, (i, j - 1))]
        i, j = min(choices)[2]
    return path[::-1]


def page_costs(pages: DataFrame, key: str) -> DataFrame:
    """(key, i, j, orig_page, render_page, wer) for every page of side 'a' with every page of side 'b' of a document; i and j are the places of the pages on their sides.

    A row is one page of the second side with the list of the first side's, so a document of n pages is n rows that are scored in parallel; the matcher indexes the
    second text once for all of its row.
    """
    words = F.array_join(F.filter(F.split(markdown.normalize_for_comparison(F.col("text")), " "), lambda w: w != ""), " ")
    rows = pages.select(key, "side", F.struct(F.col("page").cast("long").alias("page"), words.alias("words")).alias("p"))
    sides = [F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("p")))).alias(f"_{s}") for s in "ab"]
    met = rows.groupBy(key).agg(*sides).select(key, "_a", F.posexplode("_b").alias("j", "b"))

    @F.pandas_udf("array<double>")
    def errors(many: pd.Series, one: pd.Series) -> pd.Series:
        out = []
        for texts, text in zip(many, one, strict=True):
            b = text.split()
            matcher = SequenceMatcher(None, [], b)
            row = []
            for t in texts:
                a = t.split()
                matcher.set_seq1(a)
                row.append(0.0 if not a and not b else 1.0 if not a or not b else 1 - matcher.ratio())
            out.append(row)
        return pd.Series(out)

    # pages of one document go to many tasks
    met = met.repartition(key, "j").withColumn("_wer", errors(F.transform("_a", lambda x: x["words"]), "b.words"))
    cells = F.transform("_a", lambda x, i: F.struct(i.alias("i"), x["page"].alias("orig_page"), F.get("_wer", i).alias("wer")))
    return met.select(key, "j", F.col("b.page").alias("render_page"), F.explode(cells).alias("c")).select(key, "c.i", "j", "c.orig_page", "render_page", "c.wer")


def align_pages(pages: DataFrame, key: str, method: str = "hungarian") -> DataFrame:
    """(key, pos, orig_page, render_page, wer) from pages (key, side 'a' or 'b', page, text).

    Costs are computed in parallel (``page_costs``); only their numbers, one a pair of pages, come together by document for the pairing.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: {', '.join(METHODS)}")
    pair = hungarian if method == "hungarian" else warp
    costs = page_costs(pages, key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf.i.to_numpy(), pdf.j.to_numpy()
        cost = np.ones((i.max() + 1, j.max() + 1))
        cost[i, j] = pdf.wer
        pages = [dict(zip(at.tolist(), page.tolist(), strict=True)) for at, page in ((i, pdf.orig_page), (j, pdf.render_page))]
        found = pair(cost)
        return pd.DataFrame({"key": [pdf.key.iloc[0]] * len(found), "pos": range(len(found)), "orig_page": [pages[0][a] for a, _ in found], "render_page": [pages[1][b] for _, b in found], "wer": [float(cost[p]) for p in found]})

    kind = pages.schema[key].dataType.simpleString()
    numbers = costs.select(F.col(key).alias("key"), "i", "j", "orig_page", "render_page", "wer")
    return numbers.groupBy("key").applyInPandas(run, f"key {kind}, pos long, orig_page long, render_page long, wer double").withColumnRenamed("key", key)


def monotone(pairs: DataFrame, key: str, pos: str = "pos", b: str = "render_page") -> DataFrame:
    """(key, monotone): no page of the second side comes before one of an earlier pair."""
    before = F.lag(b).over(Window.partitionBy(key).orderBy(pos))
    return pairs.withColumn("_ok", F.coalesce(before <= F.col(b), F.lit(True))).groupBy(key).agg(F.bool_and("_ok").alias("monotone"))


def audit(pages: DataFrame, key: str, method: str = "hungarian", ssim: DataFrame | None = None) -> DataFrame:
    """Aligned pages with flags; ``ssim`` (key, orig_page, render_page, ssim) comes from a renderer outside and may be left out."""
    pairs = align_pages(pages, key, method)
    pairs = pairs.join(ssim, [key, "orig_page", "render_page"], "left") if ssim is not None else pairs.withColumn("ssim", F.lit(None).cast("double"))
    return pairs.withColumn("flags", labels.page_flags(F.col("wer"), F.col("ssim")))


def problem_pages(audited: DataFrame, key: str, most: int = 20) -> DataFrame:
    """The first flagged pairs of each document in order, with how many more there are."""
    w = Window.partitionBy(key)
    flagged = audited.where(F.size("flags") > 0).withColumns({"rank": F.row_number().over(w.orderBy("pos")), "total": F.count("*").over(w)})
    return flagged.where(F.col("rank") <= most).withColumn("more", F.greatest(F.col("total") - most, F.lit(0)))
