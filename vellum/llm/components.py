"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import dimension_join, drop_tables, materialise, written


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """Hang each node's larger (large star) or smaller (small star) neighbours on the least of its neighbourhood.

    The least neighbour comes from an aggregate, which combines before the shuffle. It is joined back by broadcast, or beyond its bound with the
    neighbours of each node dealt over several parts, so that the centre of a big star is never gathered in one task. ``most`` bounds the nodes.
    """
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = dimension_join(near, least, ["u"], "inner", F.col("v"), size=most)
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node that it reaches.

    Each round is written to the shared folder. The rounds end when both stars leave the edges as they
    are; their number grows with the logarithm of the longest chain. Empty edges give no rows.
    """

    def measure(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = materialise(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    seen = measure(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        since, most = written(), 2 * seen[0]
        wide = materialise(_star(now, True, most), "edges")
        fresh = materialise(_star(wide, False, most), "edges")
        then, seen = seen, measure(fresh)
        drop_tables(edges.sparkSession, since - 1, keep=(fresh,))
        now = fresh
        if then == seen:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
