"""The corpus overview as Markdown, from aggregates of a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import markdown
from vellum.operators import corpus

#: Flagged documents that the report lists; it tells how many more there are.
LISTED = 200


def overview(docs: DataFrame) -> str:
    """Totals, kinds, the similarity histogram, divergences, flagged documents and tool versions of overview rows."""
    total = corpus.corpus_totals(docs).withColumn("shown", markdown.byte_size(F.col("size_bytes"))).first()
    if not total.documents:
        return "# Corpus overview\n\nNo documents.\n"
    out = ["# Corpus overview", "", f"{total.documents} documents, {total.pages} pages, {total.tokens} tokens, {total.shown}."]
    if total.sim_n:
        out += ["", f"Round-trip similarity: mean {total.sim_avg:.4f}, least {total.sim_min:.4f}, largest {total.sim_max:.4f}."]

    def rows(title: str, head: list[str], found: list) -> None:
        if found:
            out.extend(["", f"## {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)])
            out.extend("| " + " | ".join(str(v) for v in r) + " |" for r in found)

    rows("Kinds", ["kind", "documents", "tokens", "bytes"], [r for r in corpus.by_kind(docs).collect() if r.documents])
    rows("Similarity", ["bucket", "documents"], corpus.similarity_histogram(docs).collect())
    rows("Divergences", ["category", "n", "share"], corpus.merged_divergences(docs).collect())
    flagged = corpus.outliers(docs)
    n = flagged.count()
    rows("Outliers", ["document", "tier", "notes"], flagged.select("rel_path", "tier", "notes").orderBy("tier", "rel_path").limit(LISTED).collect())
    if n > LISTED:
        out.append(f"\n(+{n - LISTED} more)")
    rows("Tools", ["marker", "torch", "device", "documents"], corpus.tool_signatures(docs).limit(LISTED).collect())
    return "\n".join(out) + "\n"
