"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts are lower-cased, ASCII signs are taken out, and tokens are cut at white space. A mask looks at some
positions of a window of tokens and ignores the others, so a window still matches when a token at an ignored position was
substituted; several masks with different gaps leave few substitutions that hide a passage from all. The hashes of all masked windows
of the training texts are joined with those of the test items, and each hit is verified on the alignment of text and item that the hit
fixes: token by token around it, where a token that differs is a substitution. An overlap counts if at least ``MIN_TOKENS`` of the item's tokens
and the share ``MIN_SHARE`` of them are equal at their places, or if of some ``STRETCH`` tokens of the item in a row, part of a longer item, at
least ``MIN_STRETCH`` are. Only verified overlaps count, so hash collisions and chance hits do no harm.

Items shorter than ``MIN_TOKENS`` leave no room for substitutions. Their mask is their own length: all of their tokens must stand in the text in a row, and of
items of fewer than ``SHORT_ALONE`` tokens, which many texts hold by chance, the text must have no other tokens.

The training side is never shuffled or sorted: windows are made, hashed and joined in one narrow stage that carries
nothing but ids, places and hashes. The test side is broadcast if it has at most ``BROADCAST_ROWS`` masked windows, which is
counted first; beyond that the same join is left to a shuffle by hash. The distinct alignments that the hits fix are few; they are
stored as three numbers each and meet the texts again for verification, broadcast likewise if their number allows it, and then the items,
broadcast if they have at most ``BROADCAST_TOKENS`` tokens.

Defined results: null and empty texts or items match nothing; a passage with words put in or left out is two alignments, each of which counts by its own
tokens; very long texts are compared whole; repeated documents are one row of ids; repeated items count each by its id, and of several texts of one item id each
is compared and the best counts; of alignments that are equally good the first in the text is told; null ids are kept as null; an empty table gives no rows, or
takes none away; extra columns, whatever their names, are ignored, or kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialise

#: Positions that count ("1") in each mask.
MASKS = ("1110111", "11011011", "110101011")
MIN_TOKENS = 8
MIN_SHARE = 0.7
STRETCH, MIN_STRETCH = 13, 11
SHORT_ALONE = 5
BROADCAST_ROWS = 1_000_000
BROADCAST_TOKENS = 4_000_000

WHITE = r"[\x20\x09-\x0D]+"
SIGNS = r"\p{Punct}+"


def tokens(text: Column) -> Column:
    """Array of normalised tokens; empty for null."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SIGNS, ""), WHITE), lambda w: w != "")


def seeds(df: DataFrame, key: str, masks: tuple[str, ...] = MASKS, short: tuple[int, ...] = (), items: bool = False) -> DataFrame:
    """A row (key, at, seed) for each masked window of the array ``toks``; ``at`` is the window's first token.

    ``short`` are the lengths of short items, whose windows have no gaps; of ``items`` themselves only those of the length have such a window, and
    others have no other. The window comes from the zipped array and its slices and is hashed in generated code; a window that runs over the
    end of the tokens has null at a looked-at position and is left out.
    """
    span = max([*map(len, masks), *short])
    names = [f"w{i}" for i in range(span)]
    shifted = F.arrays_zip(*[(F.col("toks") if i == 0 else F.slice("toks", i + 1, F.greatest(F.size("toks"), F.lit(1)))).alias(n) for i, n in enumerate(names)])
    windows = df.select(key, F.size("toks").alias("n"), F.posexplode(shifted).alias("at", "w"))

    def seed(m: int, mask: str, when: Column | None = None) -> Column:
        used = [F.col("w")[names[i]] for i, c in enumerate(mask) if c == "1"]
        good = used[-1].isNotNull()
        return F.when(good if when is None else good & when, F.xxhash64(F.lit(m), *used))

    spaced = [seed(m, mask, F.col("n") >= MIN_TOKENS if items else None) for m, mask in enumerate(masks)]
    whole = [seed(-n, "1" * n, F.col("n") == n if items or n < SHORT_ALONE else None) for n in short]
    return windows.select(key, "at", F.explode(F.array(*spaced, *whole)).alias("seed")).where(F.col("seed").isNotNull())


def _is(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_tokens: int = MIN_TOKENS, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, item_id, n_equal, n_tokens, share, stretch, doc_start): the best verified overlap of each document and item.

    ``stretch`` is the most equal tokens among ``STRETCH`` of the item in a row; ``doc_start`` is the token of the document that the item's first
    token stands at, negative if the text starts within the item.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("toks")).where(F.size("toks") > 0)
    items = materialise(items.distinct(), "items")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = tuple(sorted(r.n for r in items.where(F.size("toks") < MIN_TOKENS).select(F.size("toks").alias("n")).distinct().collect()))
    found = materialise(seeds(items, "item_id", masks, short, items=True).select("item_id", F.col("at").alias("item_at"), "seed").distinct(), "seeds")
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    tokenised = texts.select("doc_id", tokens(F.col("text")).alias("toks"))
    hits = seeds(tokenised, "doc_id", masks, short).join(side, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("doc_start"))
    hits = materialise(hits.distinct(), "hits")

    asked = hits.select(F.col("doc_id").alias("_id"), F.col("item_id").alias("_item"), "doc_start")
    asked = F.broadcast(asked) if hits.count() <= BROADCAST_ROWS else asked
    sized = items.select("item_id", F.col("toks").alias("item"))
    sized = F.broadcast(sized) if (items.agg(F.sum(F.size("toks"))).first()[0] or 0) <= BROADCAST_TOKENS else sized
    met = texts.join(asked, _is("doc_id", "_id")).select("doc_id", "_item", "doc_start", tokens(F.col("text")).alias("toks"))
    checked = met.join(sized, _is("_item", "item_id"))

    part = F.slice("toks", F.greatest(F.col("doc_start") + 1, F.lit(1)), F.size("item"))  # the document's side
    # the item's tokens before the text's start stand beside nothing
    skipped = F.greatest(-F.col("doc_start"), F.lit(0))
    other = F.slice("item", skipped + 1, F.greatest(F.size("item"), F.lit(1)))
    same = F.zip_with(part, other, lambda a, b: F.when(a == b, 1).otherwise(0))
    # equal tokens up to each place of the part of the item that stands beside the text
    upto = F.aggregate("same", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    last = F.size("upto") - 1
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last - STRETCH, F.lit(0))), lambda i: F.get("upto", F.least(i + STRETCH, last)) - F.get("upto", i))
    n_tokens = F.size("item").cast("long")
    checked = checked.select("doc_id", "item_id", "doc_start", n_tokens.alias("n_tokens"), F.size("toks").alias("n_text"), same.alias("same"))
    checked = checked.withColumn("upto", upto).withColumns({"n_equal": F.element_at("upto", -1).cast("long"), "stretch": F.array_max(runs).cast("long")})
    enough = (F.col("n_equal") >= min_tokens) & (F.col("n_equal") >= min_share * F.col("n_tokens"))
    dense = (F.col("n_tokens") > STRETCH) & (F.col("stretch") >= MIN_STRETCH)
    exact = (F.col("n_tokens") < MIN_TOKENS) & (F.col("n_equal") == F.col("n_tokens")) & ((F.col("n_tokens") >= SHORT_ALONE) | (F.col("n_text") == F.col("n_tokens")))
    good = checked.where(enough | dense | exact)
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", (-F.col("doc_start")).alias("neg"), "n_tokens", "stretch")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_equal", "b.n_tokens", F.round(F.col("b.n_equal") / F.col("b.n_tokens"), 4).alias("share"), "b.stretch", (-F.col("b.neg")).cast("long").alias("doc_start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a verified overlap. Texts are told apart by hash, so null and repeated ids do no harm."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = materialise(overlaps(texts, benchmark, **options).select(F.col("doc_id").alias("__leak_hash")).distinct(), "leaks")
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return docs.join(side, F.xxhash64(docs["text"]) == F.col("__leak_hash"), "left_anti")
