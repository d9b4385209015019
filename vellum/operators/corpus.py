"""Roll-ups of per-document metrics over folders and whole corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import labels, markdown

SUMS = ("tokens", "words", "size_bytes", "lines", "sentences_estimated", "math_display", "math_inline", "ligature_artifacts", "tables_rough", "code_blocks", "images_referenced")
KINDS = ("livro", "paper", "material", "outro")


def document_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the Markdown metrics."""
    found = markdown.metrics(F.col(text))
    found["headers_total"] = found["h1"] + found["h2"] + found["h3"] + found["h4_plus"]
    return docs.select(*[c for c in docs.columns if c != text], *[c.alias(n) for n, c in found.items()])


def folder_totals(metrics: DataFrame, folder: str) -> DataFrame:
    return metrics.groupBy(folder).agg(F.count("*").alias("chapter_count"), *[F.sum(c).cast("long").alias(c) for c in (*SUMS, "headers_total", "latex_cmd_count")])


def command_ranks(docs: DataFrame, key: str, text: str = "text", most: int = 10) -> DataFrame:
    """(key, command, n, first_pos, rank): the ``most`` frequent LaTeX commands of each document, ties to the first seen."""
    found = docs.select(key, F.posexplode(markdown.latex_commands(F.col(text))).alias("pos", "command"))
    counts = found.groupBy(key, "command").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first_pos")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def top_commands(ranks: DataFrame, most: int = 20) -> DataFrame:
    """Sums of the documents' own top lists, which makes it a heavy-hitter merge; ties by name."""
    return ranks.groupBy("command").agg(F.sum("n").cast("long").alias("n")).orderBy(F.desc("n"), "command").limit(most)


def corpus_totals(docs: DataFrame) -> DataFrame:
    """One row of totals and of similarity statistics over the documents that have one. Null pages count as 0."""
    names = ("pages", "tokens", "words", "size_bytes", "math_display", "math_inline", "images_count", "images_total_bytes")
    return docs.agg(
        F.count("*").alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names],
        F.round(F.avg("similarity"), 6).alias("sim_avg"), F.min("similarity").alias("sim_min"), F.max("similarity").alias("sim_max"), F.count("similarity").alias("sim_n"),
    )


def by_kind(docs: DataFrame) -> DataFrame:
    """Counts and sums for each fixed kind, those without documents included."""
    kinds = docs.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    sums = docs.groupBy("kind").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum("size_bytes").alias("size_bytes"))
    return F.broadcast(kinds).join(sums, "kind", "left").select("kind", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "tokens", "size_bytes")])


def similarity_histogram(docs: DataFrame) -> DataFrame:
    buckets = docs.sparkSession.createDataFrame([("excellent",), ("good",), ("fair",), ("poor",)], "bucket string")
    counts = docs.where(F.col("similarity").isNotNull()).groupBy(labels.similarity_bucket(F.col("similarity")).alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def merged_divergences(docs: DataFrame, categories: str = "divergences") -> DataFrame:
    """Sums of the documents' category maps with their shares, largest first, ties by name."""
    sums = docs.select(F.explode(categories).alias("category", "n")).groupBy("category").agg(F.sum("n").cast("long").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row a category
    return sums.withColumn("share", F.round(F.col("n") / F.nullif(total, F.lit(0)), 6)).orderBy(F.desc("n"), "category")


def transport_ratios(md_bytes: Column, image_bytes: Column, source_bytes: Column) -> dict[str, Column]:
    """Percent of the source's bytes, null without a source."""
    base = F.when(source_bytes > 0, source_bytes)
    return {"md_pct": F.round(md_bytes * 100 / base, 4), "md_images_pct": F.round((md_bytes + image_bytes) * 100 / base, 4)}


def tool_signatures(docs: DataFrame) -> DataFrame:
    sig = [F.coalesce(F.col(c), F.lit(d)).alias(n) for c, d, n in (("tools.marker", "?", "marker"), ("tools.torch", "?", "torch"), ("tools.cuda_device", "CPU", "device"))]
    return docs.groupBy(*sig).agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "marker", "torch", "device")


def outliers(docs: DataFrame) -> DataFrame:
    args = F.col("similarity"), F.col("ligature_artifacts"), F.col("tokens")
    return docs.withColumns({"tier": labels.outlier_tier(*args), "notes": labels.outlier_notes(*args)}).where(F.col("tier").isNotNull())


def drift(iterations: DataFrame, key: str, order: str = "i", similarity: str = "sim_to_first") -> DataFrame:
    """First, last and step of the non-null similarities of each key, with the four-way verdict and the report's three-way one."""
    known = iterations.where(F.col(similarity).isNotNull())
    pair = F.struct(order, similarity)
    agg = known.groupBy(key).agg(F.count("*").alias("n"), F.min(pair).alias("a"), F.max(pair).alias("z"), F.slice(F.reverse(F.array_sort(F.collect_list(pair))), 2, 1).alias("y"))
    first, last, before = F.col(f"a.{similarity}"), F.col(f"z.{similarity}"), F.get("y", F.lit(0))[similarity]
    return agg.select(
        key, "n", F.round((first - last) * 100, 4).alias("drift"), F.round(F.abs(last - before) * 100, 4).alias("last_step"),
        labels.drift_verdict(first, last, before, F.col("n")).alias("verdict"), labels.drift_verdict_overview(first, last, before, F.col("n")).alias("overview_verdict"),
    )


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays as sets; of two empty ones 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def page_pair_summary(pairs: DataFrame, key: str | None = None) -> DataFrame:
    """Exact medians and shares of the pages' error rates and similarities; 0 where there is nothing."""
    share = lambda c: F.avg(c.cast("double"))
    cols = {
        "n": F.count("*"), "wer_median": F.percentile("wer", F.lit(0.5)), "wer_mean": F.avg("wer"), "wer_min": F.min("wer"), "wer_max": F.max("wer"),
        "wer_ok_share": share(F.col("wer") < labels.WER_OK), "wer_tol_share": share(F.col("wer") < labels.WER_TOL),
        "ssim_median": F.percentile("ssim", F.lit(0.5)), "ssim_mean": F.avg("ssim"), "ssim_ok_share": share(F.col("ssim") > labels.SSIM_OK),
    }
    out = (pairs.groupBy(key) if key else pairs.groupBy()).agg(*[c.alias(n) for n, c in cols.items()])
    return out.select(*[key] * bool(key), "n", *[F.round(F.coalesce(F.col(n), F.lit(0.0)), 6).alias(n) for n in cols if n != "n"])


def with_sidecar(docs: DataFrame, sidecar: DataFrame, key: str | list[str]) -> DataFrame:
    """``docs`` with the columns of at most one sidecar row each, null where there is none. Sidecars are keyed by directory, so their keys are unique and spread."""
    return docs.join(sidecar, key, "left")


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``. An aggregate that combines before the shuffle; a popular key sends one row a task."""
    others = [c for c in rows.columns if c not in (*keys, *order)]
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*order, *others), F.struct(*order)).alias("_first"))
    return kept.select(*keys, "_first.*").select(*rows.columns)


def kind_details(docs: DataFrame) -> DataFrame:
    """(kind, rel_path, ...) rows of the kinds that reports list one by one, in order of kind and path; the last kind has no list."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    formulas = (F.col("math_display") + F.col("math_inline")).alias("formulas")
    rows = docs.where(F.col("kind").isin(*KINDS[:-1])).select(
        "kind", "rel_path", "pages", "chapter_count", "tokens", "words", formulas, "images_count", "size_bytes", "similarity", "extraction_seconds",
    )
    return rows.orderBy(place, "rel_path")
