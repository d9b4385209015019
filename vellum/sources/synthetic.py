"""Ground-truth Markdown by construction: eight categories, every choice taken from a checksum, so that runs agree without a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items of each category.
ITEMS = {"prose": 5, "formula_display": 10, "formula_matrix": 8, "formula_multiline": 6, "formula_inline": 6, "table": 15, "diagram": 20, "logo": 5}


def _pick(item: Column, what: str, n: int) -> Column:
    return (F.crc32(F.concat(F.lit(f"{what}:"), item).cast("binary")) % n).cast("int")


def ground_truth(spark: SparkSession, copies: int = 1) -> DataFrame:
    """(category, item, tier, markdown); ``copies`` multiplies the items of each category."""
    kinds = spark.createDataFrame(list(ITEMS.items()), "category string, n int")
    rows = kinds.select("category", F.explode(F.sequence(F.lit(1), F.col("n") * copies)).alias("k")).withColumn("item", F.concat("category", F.lit("_"), F.lpad(F.col("k").cast("string"), 4, "0")))
    item = F.col("item")
    words = F.array(*map(F.lit, ("amber", "basalt", "cobalt", "delta", "ember", "fjord", "granite", "harbor")))
    sentence = F.concat_ws(" ", *[words[_pick(item, f"w{i}", 8)] for i in range(12)])
    a, b = (_pick(item, x, 90).cast("string") for x in "ab")
    tier = F.when(F.col("category") == "table", F.concat(F.lit("T"), ((F.col("k") - 1) % 5 + 1).cast("string")))
    body = (
        F.when(F.col("category") == "prose", F.concat(F.initcap(sentence), F.lit(".")))
        .when(F.col("category") == "formula_display", F.concat(F.lit("$$ \\frac{"), a, F.lit("}{"), b, F.lit("} + x^2 $$")))
        .when(F.col("category") == "formula_matrix", F.concat(F.lit("$$ \\begin{pmatrix} "), a, F.lit(" & 0 \\\\ 0 & "), b, F.lit(" \\end{pmatrix} $$")))
        .when(F.col("category") == "formula_multiline", F.concat(F.lit("$$ x = "), a, F.lit(" \\\\ y = "), b, F.lit(" $$")))
        .when(F.col("category") == "formula_inline", F.concat(F.lit("Let $n = "), a, F.lit("$ in "), sentence, F.lit(".")))
        .when(F.col("category") == "table", F.concat(F.lit("| a | b |\n|---|---|\n| "), a, F.lit(" | "), b, F.lit(" |")))
        .when(F.col("category") == "diagram", F.concat(F.lit("```mermaid\ngraph TD; A"), a, F.lit("-->B"), b, F.lit("\n```")))
        .otherwise(F.concat(F.lit("![logo](images/"), item, F.lit(".png)")))
    )
    return rows.select("category", "item", tier.alias("tier"), F.concat(F.lit("# "), F.replace(item, F.lit("_"), F.lit(" ")), F.lit("\n\n"), body, F.lit("\n")).alias("markdown"))
