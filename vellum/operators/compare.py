"""Token comparison of two texts by the standard library's sequence matcher, in Arrow batches.

The matcher's popularity heuristic stays on by default, as its ratios are what results are compared with; it can be switched off. The
ratio depends on the order of its arguments, which is kept.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import markdown

OPCODES = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>"


def joined(tokens: Column) -> Column:
    """Tokens as one string, which moves to Python and back far cheaper than an array; no token holds a line end."""
    return F.array_join(tokens, "\n")


def split(text: str) -> list[str]:
    return text.split("\n") if text else []


def ratio(a: list[str], b: list[str], autojunk: bool = True) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b, autojunk).ratio()


def ratio_udf(autojunk: bool = True):
    """Ratio of two texts of joined tokens."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else ratio(split(x), split(y), autojunk) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def opcodes_udf(autojunk: bool = True):
    @F.pandas_udf(OPCODES)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            codes = SequenceMatcher(None, split(x), split(y), autojunk).get_opcodes() if x is not None and y is not None and x != y else []
            out.append([{"tag": t, "i1": i, "i2": j, "j1": k, "j2": n} for t, i, j, k, n in codes if t != "equal"])
        return pd.Series(out)

    return run


def token_similarity(a: Column, b: Column, autojunk: bool = True) -> Column:
    """Ratio over the tokens of the normal forms of two Markdown texts."""
    return ratio_udf(autojunk)(joined(markdown.tokens(a)), joined(markdown.tokens(b)))


def word_error_rate(a: Column, b: Column, autojunk: bool = True) -> Column:
    """One minus the ratio over words; 0 for two empty texts, 1 if one is empty."""
    words = [F.filter(F.split(markdown.normalize_for_comparison(x), " "), lambda w: w != "") for x in (a, b)]
    none = [F.size(w) == 0 for w in words]
    return F.when(none[0] & none[1], 0.0).when(none[0] | none[1], 1.0).otherwise(1 - ratio_udf(autojunk)(*map(joined, words)))


def differences(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", autojunk: bool = True) -> DataFrame:
    """(keys, pos, tag, from_tokens, to_tokens, n, category): the edit script over tokens without its equal runs."""
    t = pairs.select(*keys, markdown.tokens(F.col(a)).alias("_a"), markdown.tokens(F.col(b)).alias("_b"))
    ops = t.select(*keys, "_a", "_b", F.posexplode(opcodes_udf(autojunk)(joined(F.col("_a")), joined(F.col("_b")))).alias("pos", "op"))
    left = F.slice("_a", F.col("op.i1") + 1, F.col("op.i2") - F.col("op.i1"))
    right = F.slice("_b", F.col("op.j1") + 1, F.col("op.j2") - F.col("op.j1"))
    cut = ops.select(*keys, "pos", F.col("op.tag").alias("tag"), left.alias("from_tokens"), right.alias("to_tokens"))
    n = F.greatest(F.size("from_tokens"), F.size("to_tokens")).cast("long")
    return cut.withColumns({"n": n, "category": markdown.divergence_category(F.array_join("from_tokens", " "), F.array_join("to_tokens", " "))})


def divergence_counts(found: DataFrame, keys: list[str], sample: int = 6) -> DataFrame:
    """(keys, category, n, tag, from_text, to_text): sums by category, with the first difference of each as an example."""
    first = F.min_by(F.struct("tag", F.array_join(F.slice("from_tokens", 1, sample), " ").alias("a"), F.array_join(F.slice("to_tokens", 1, sample), " ").alias("b")), "pos")
    return found.groupBy(*keys, "category").agg(F.sum("n").alias("n"), first.alias("e")).select(*keys, "category", "n", "e.tag", F.col("e.a").alias("from_text"), F.col("e.b").alias("to_text"))


def first_differences(found: DataFrame, keys: list[str], most: int = 5, sample: int = 8) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    return ranked.where(F.col("rank") <= most).select(*keys, "rank", "tag", F.array_join(F.slice("from_tokens", 1, sample), " ").alias("from_text"), F.array_join(F.slice("to_tokens", 1, sample), " ").alias("to_text"))


def round_trip(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keys, md1_tokens, md2_tokens, similarity, similarity_no_escapes, bloat_ratio); the ratio is null without tokens on the first side."""
    ta, tb = markdown.tokens(F.col(a)), markdown.tokens(F.col(b))
    ea, eb = (F.regexp_extract_all(markdown.normalize_md(F.col(c), True), F.lit(markdown.TOKEN), 0) for c in (a, b))

    @F.pandas_udf("struct<similarity:double,similarity_no_escapes:double>")
    def ratios(x: pd.Series, y: pd.Series, ex: pd.Series, ey: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(x, y, ex, ey, strict=True):
            if any(v is None for v in row):
                out.append((None, None))
                continue
            first = ratio(split(row[0]), split(row[1]))
            # without escapes there is nothing to compare again
            out.append((first, first if row[2:] == row[:2] else ratio(split(row[2]), split(row[3]))))
        return pd.DataFrame(out, columns=["similarity", "similarity_no_escapes"])

    n1, n2 = F.size("_a").cast("long"), F.size("_b").cast("long")
    sized = pairs.select(*keys, ta.alias("_a"), tb.alias("_b"), joined(ea).alias("_ea"), joined(eb).alias("_eb"))
    sized = sized.select(*keys, n1.alias("md1_tokens"), n2.alias("md2_tokens"), ratios(joined(F.col("_a")), joined(F.col("_b")), "_ea", "_eb").alias("r"))
    return sized.select(*keys, "md1_tokens", "md2_tokens", "r.*", F.round(F.col("md2_tokens") / F.nullif("md1_tokens", F.lit(0)), 6).alias("bloat_ratio"))


def iterations(texts: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, i, tokens, sim_to_first, sim_to_prev): each text of a series against the first and the one before it; null for the first."""
    w = Window.partitionBy(key).orderBy(order)
    rows = texts.select(key, order, text, F.first(text).over(w).alias("_first"), F.lag(text).over(w).alias("_prev"), (F.row_number().over(w) - 1).alias("i"))
    later = rows.where("i > 0")
    return later.select(key, F.col("i").cast("long").alias("i"), F.size(markdown.tokens(F.col(text))).cast("long").alias("tokens"), token_similarity(F.col("_first"), F.col(text)).alias("sim_to_first"), F.when(F.col("i") > 1, token_similarity(F.col("_prev"), F.col(text))).alias("sim_to_prev"))
