"""Provenance stamps: a comment and a quoted line after the first heading, replaced when already there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOOL = "vellum"
_BLOCK = rf"<!-- {TOOL}-provenance v1 [^\n]*-->\n> \*[^\n]*\*\n"
_HEADING = r"(?md)^#+ .*$"


def render(version: Column, date: Column, commit: Column, source: Column, sha256: Column, extractor: Column) -> Column:
    """The block; null parts are left out, the digest is cut to eight digits."""
    part = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c))
    comment = F.concat(F.lit(f"<!-- {TOOL}-provenance v1 version="), version, F.lit(" date="), date, F.coalesce(part(" commit=", commit), F.lit("")), F.coalesce(part(" source=", source), F.lit("")), F.lit(" -->"))
    origin = (
        F.when(sha256.isNotNull(), F.concat(F.lit(" (sha256 `"), F.substring(sha256, 1, 8), F.lit("…`"), F.coalesce(part(", ", extractor), F.lit("")), F.lit(")")))
        .otherwise(F.coalesce(part(" — ", extractor), F.lit("")))
    )
    human = F.concat(
        F.lit(f"> *Converted by **{TOOL}** `"), version, F.lit("`"),
        F.coalesce(F.when(commit.isNotNull(), F.concat(F.lit(" (commit `"), commit, F.lit("`)"))), F.lit("")),
        F.lit(" on "), date, F.coalesce(F.when(source.isNotNull(), F.concat(F.lit(" — source: `"), source, F.lit("`"), origin)), F.lit("")), F.lit(".*"),
    )
    return F.concat(comment, F.lit("\n"), human, F.lit("\n"))


def stamp(text: Column, block: Column) -> Column:
    """Replace the first block; else put one after the first heading, else before the text. Stamping twice is stamping once."""
    old = F.regexp_substr(text, F.lit(_BLOCK))
    at = F.position(old, text)
    replaced = F.concat(F.substring(text, F.lit(1), at - 1), block, F.substring(text, at + F.length(old), F.length(text)))
    heading = F.regexp_substr(text, F.lit(_HEADING))
    end = F.regexp_instr(text, F.lit(_HEADING)) + F.length(heading) - 1
    placed = F.concat(F.substring(text, F.lit(1), end), F.lit("\n"), block, F.substring(text, end + 1, F.length(text)))
    return F.when(old.isNotNull(), replaced).when(heading.isNotNull(), placed).otherwise(F.concat(block, F.lit("\n"), text))
