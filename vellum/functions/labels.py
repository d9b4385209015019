"""Threshold labels and verdicts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the labels.
WER_OK, WER_TOL = 0.30, 0.60
SSIM_OK, SSIM_TOL = 0.95, 0.50
PASS2_MATH_PER_KCHAR, PASS2_CHARS_PER_PAGE = 1.0, 800
KINDS = {"livros": "livro", "papers": "paper", "material_aulas": "material"}


def document_kind(path: Column) -> Column:
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    out = None
    for folder, kind in KINDS.items():
        hit = F.array_contains(parts, folder)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("outro")


def page_flags(wer: Column, ssim: Column) -> Column:
    return F.array_compact(F.array(
        F.when(wer >= WER_TOL, "high_wer").when(wer >= WER_OK, "medium_wer"),
        F.when(ssim < SSIM_TOL, "low_ssim").when(ssim < SSIM_OK, "medium_ssim"),
    ))


def bloat_tier(bloat: Column, md_tokens: Column, pages: Column) -> Column:
    """A ratio of tokens that a second extraction invents; an unknown density is never sparse."""
    sparse = F.coalesce(md_tokens / F.nullif(pages, F.lit(0)) < 200, F.lit(False))
    return F.when((bloat > 3.0) | ((bloat > 2.0) & sparse), "strong").when(bloat > 1.5, "abnormal").otherwise("ok")


def stability(similarity: Column) -> Column:
    return F.when(similarity * 100 >= 90, "stable").when(similarity * 100 >= 80, "evaluate").otherwise("investigate")


def escape_flag(similarity: Column, without_escapes: Column) -> Column:
    delta = (without_escapes - similarity) * 100
    return F.when(F.abs(delta) <= 1, "none").when(delta > 5, "dense markup").otherwise("shown")


def similarity_bucket(similarity: Column) -> Column:
    s = similarity * 100
    return F.when(s >= 95, "excellent").when(s >= 90, "good").when(s >= 80, "fair").otherwise("poor")


def pass2(math_hits: Column, chars: Column, pages: Column) -> dict[str, Column]:
    """Whether a first pass is worth a second one; tests use unrounded values."""
    per_k = F.lit(1000.0) * math_hits / F.greatest(chars, F.lit(1))
    per_page = chars / F.greatest(pages, F.lit(1))
    reasons = F.array_compact(F.array(F.when(per_k >= PASS2_MATH_PER_KCHAR, "math"), F.when(per_page < PASS2_CHARS_PER_PAGE, "density")))
    return {"warranted": F.size(reasons) > 0, "math_per_kchar": F.round(per_k, 2), "chars_per_page": F.round(per_page, 1), "reasons": F.array_join(reasons, ";")}


def image_kind(n_colors: Column, quant_error: Column) -> Column:
    return F.when(n_colors <= 2, "bw").when(n_colors <= 16, "palette").when(quant_error < 5.0, "palette_lossy").otherwise("continuous")


def image_decision(kind: Column, candidate_bytes: Column, src_bytes: Column, error: Column) -> Column:
    """Converted only where smaller; an error that came before the image was opened has no kind."""
    return (
        F.when(error.isNotNull() & kind.isNull(), F.concat(F.lit("open_error: "), error))
        .when(kind == "continuous", "keep_jpeg")
        .when(error.isNotNull(), F.concat(F.lit("error: "), error))
        .when(candidate_bytes < src_bytes, F.concat(F.lit("convert_to_png_"), kind))
        .otherwise("keep_jpeg_smaller")
    )


def is_complex(merged_from: Column, cmex: Column, n_lines: Column) -> Column:
    return (merged_from >= 2) | (cmex & (n_lines >= 5))


def drift_verdict(first: Column, last: Column, before_last: Column, n: Column) -> Column:
    drift, step = (first - last) * 100, F.abs(last - before_last) * 100
    return F.when(n >= 2, F.when(F.abs(drift) < 1.0, "stable").when((drift > 0) & (step < 0.5), "logarithmic").when(drift > 0, "continuous").otherwise("unexpected"))


def drift_verdict_overview(first: Column, last: Column, before_last: Column, n: Column) -> Column:
    """As the roll-up report tells it, where a negative drift counts as continuous."""
    v = drift_verdict(first, last, before_last, n)
    return F.when(v == "unexpected", "continuous").otherwise(v)


def outlier_tier(similarity: Column, ligatures: Column, tokens: Column) -> Column:
    s = similarity * 100
    by_similarity = F.when(s < 50, "critical").when(s < 70, "notable")
    return F.when(tokens == 0, "critical").otherwise(F.coalesce(by_similarity, F.when(ligatures > 0, "critical")))


def outlier_notes(similarity: Column, ligatures: Column, tokens: Column) -> Column:
    s = similarity * 100
    return F.array_join(F.array_compact(F.array(
        F.when(s < 50, "round trip critical").when(s < 70, "round trip moderate"),
        F.when(ligatures > 0, F.concat(ligatures.cast("string"), F.lit(" broken ligatures"))),
        F.when(tokens == 0, "no tokens"),
    )), "; ")
