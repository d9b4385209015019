"""Tiered source registry: where a document can be read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids that an error lists.
KNOWN_SHOWN = 100


def resolve(entries: DataFrame, available: DataFrame, prefer_excerpt: Column | bool = False) -> DataFrame:
    """(doc_id, resolved, via): the excerpt if preferred and there, else the tier's path, else the excerpt; null with via 'missing'.

    ``entries``: doc_id, tier, path, inrepo_excerpt; ``available``: path.
    """
    have = available.select(F.col("path").alias("p")).distinct()
    marked = entries.join(have.withColumn("has_path", F.lit(True)), F.col("path") == F.col("p"), "left").drop("p")
    marked = marked.join(have.withColumn("has_excerpt", F.lit(True)), F.col("inrepo_excerpt") == F.col("p"), "left").drop("p")
    prefer = F.lit(prefer_excerpt) if isinstance(prefer_excerpt, bool) else prefer_excerpt
    first = F.when(prefer & F.col("has_excerpt"), "excerpt").when(F.col("has_path"), F.col("tier")).when(F.col("has_excerpt"), "excerpt").otherwise("missing")
    return marked.select("doc_id", F.when(first == "excerpt", F.col("inrepo_excerpt")).when(first != "missing", F.col("path")).alias("resolved"), first.alias("via"))


def lookup(entries: DataFrame, doc_id: str):
    """The entry of one document as a Row; an unknown id raises ``KeyError`` that tells the known ones."""
    found = entries.where(F.col("doc_id") == doc_id).first()
    if found is None:
        known = [str(r.doc_id) for r in entries.select("doc_id").orderBy("doc_id").limit(KNOWN_SHOWN + 1).collect()]
        raise KeyError(f"{doc_id!r}; known: {', '.join(known[:KNOWN_SHOWN])}{', ...' if len(known) > KNOWN_SHOWN else ''}")
    return found


def has_excerpt(entries: DataFrame, available: DataFrame) -> DataFrame:
    """(doc_id, has_excerpt): whether a document's excerpt is declared and there."""
    have = available.select(F.col("path").alias("inrepo_excerpt")).distinct().withColumn("_there", F.lit(True))
    return entries.join(have, "inrepo_excerpt", "left").select("doc_id", F.coalesce("_there", F.lit(False)).alias("has_excerpt"))
