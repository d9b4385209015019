"""Image records: classes, re-encoding decisions, savings, and references in Markdown that follow a rename."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import labels

FORMATS = ("png", "jpg", "jpeg", "svg")


def decide(images: DataFrame) -> DataFrame:
    """Adds kind, decision, dst_bytes and saved_bytes to (src_bytes, n_colors, quant_error, candidate_bytes, error)."""
    kind = F.when(F.col("n_colors").isNotNull(), labels.image_kind(F.col("n_colors"), F.col("quant_error")))
    out = images.withColumn("kind", kind)
    out = out.withColumn("decision", labels.image_decision(F.col("kind"), F.col("candidate_bytes"), F.col("src_bytes"), F.col("error")))
    made = F.startswith(F.col("decision"), F.lit("convert_to_png_"))
    return out.withColumns({"dst_bytes": F.when(made, F.col("candidate_bytes")).otherwise(F.col("src_bytes")), "saved_bytes": F.when(made, F.col("src_bytes") - F.col("candidate_bytes")).otherwise(0)})


def savings(decided: DataFrame) -> DataFrame:
    """Totals and percent saved by decision (the part before a colon); a null decision is the total."""
    by = decided.withColumn("by_decision", F.substring_index("decision", ":", 1))
    agg = [F.count("*").alias("n"), F.sum("src_bytes").cast("long").alias("src_bytes"), F.sum("saved_bytes").cast("long").alias("saved_bytes")]
    return by.rollup("by_decision").agg(*agg).withColumn("saved_pct", F.round(F.col("saved_bytes") * 100 / F.nullif(F.col("src_bytes"), F.lit(0)), 4))


def largest_savings(decided: DataFrame, most: int = 10, tie: str = "image_id") -> DataFrame:
    return decided.where("saved_bytes > 0").orderBy(F.desc("saved_bytes"), tie).limit(most)


def by_format(images: DataFrame, key: str | None = None) -> DataFrame:
    """Each image counted once by its format: count, bytes, largest, smallest, and the mean in whole bytes; the commonest format first, ties by name."""
    n, total = F.count("*"), F.sum("bytes")
    return images.groupBy(*[key] * bool(key), F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).alias("format")).agg(n.alias("n"), total.cast("long").alias("bytes"), F.max("bytes").alias("max_bytes"), F.min("bytes").alias("min_bytes"), F.floor(total / n).cast("long").alias("avg_bytes")).orderBy(*[key] * bool(key), F.desc("n"), "format")


def rename_references(text: Column, renames: Column) -> tuple[Column, Column]:
    """``text`` with the base names of image paths replaced by the map ``renames``, and how many were."""
    pieces = F.split(text, r"(?<=\))|(?=!\[)")

    def base(p: Column) -> Column:
        return F.regexp_extract(p, r"^!\[[^\]]*\]\(((?:[^)]*/)?)([^)/]+)\)$", 2)

    def put(p: Column) -> Column:
        new = F.try_element_at(renames, base(p))
        inside = F.regexp_extract(p, r"^!\[[^\]]*\]\(([^)]+)\)$", 1)
        head = F.substring(p, F.lit(1), F.length(p) - F.length(inside) - 1)
        return F.when(new.isNotNull(), F.concat(head, F.replace(inside, base(p), new), F.lit(")"))).otherwise(p)

    count = F.size(F.filter(pieces, lambda p: F.try_element_at(renames, base(p)).isNotNull()))
    return F.array_join(F.transform(pieces, put), ""), count.cast("long")


def references(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), 1)

