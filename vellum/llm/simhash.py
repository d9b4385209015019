"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits, one for each bit position of the XXH64 hashes of a document's word shingles:
set if more than half of the hashes have it set. Fingerprints that differ in at most ``bits`` bits agree
on all others, so if the 64 bits are cut into ``bits + 2`` blocks, two such fingerprints share at least two whole
blocks: every pair of blocks with its content is a join key, and fingerprints that meet under a key
are verified by their Hamming distance. Keys of two blocks make the joins far more selective than those of
one block, for ten rows a fingerprint instead of four.

Equal fingerprints are one node from the start, so exact copies never meet each other. Within a key only
a spanning forest of the verified links is passed on, which keeps the classes whole without all the
pairs of a group of near copies. Keys are counted first; one with more than ``LARGEST`` fingerprints is dealt by the
blocks of its other bits instead, as often as needed, so that none is dropped and no task holds an unbounded key.

Defined results: a null or blank text has no words and fingerprint zero, which links like any other;
texts with fewer words than a shingle hash their whole word sequence; very long texts are hashed whole; repeated rows each get a row; a
null id keeps its row and its links, and never names a class unless all ids of the class are null; an empty table gives no rows; extra columns, whatever
their names, are ignored, or kept by ``keep_one``. Of rows that agree in id and text ``keep_one`` keeps one, and which one's other columns stay is open.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import dimension_join, in_runs, materialise, repeated, slices, text_buffers
from vellum.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 3
BITS = 3
#: Fingerprints of one key that are compared in one task; larger keys are dealt again.
LARGEST = 8192
#: Parts that the rows of a class are dealt to.
SALTS = 32
#: Keys up to which a list of rows to drop is broadcast.
BROADCAST_ROWS = 1_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(shingle_hashes: np.ndarray) -> int:
    """Majority bits of uint64 hashes; 0 for none."""
    n = len(shingle_hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        part = shingle_hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def text_fingerprint(raw: bytes, shingle_words: int) -> int:
    """Of UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles joined by one space."""
    import xxhash

    found = raw.translate(_LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= shingle_words:
        return fingerprint(np.asarray([xxhash.xxh64_intdigest(line, SEED)], np.uint64))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hash_of = xxhash.xxh64_intdigest
    hashes = [hash_of(line[a:b], SEED) for a, b in zip(starts[: len(found) - shingle_words + 1].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)]
    return fingerprint(np.asarray(hashes, np.uint64))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, text_hash: bool = False) -> DataFrame:
    """(doc_id, fp) of whole texts, and text_hash if asked for; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column("text"))
            raw = data.tobytes()
            fps = [text_fingerprint(raw[a:b], shingle_words) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            kept = [batch.column(n) for n in names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.asarray(fps, np.uint64).view(np.int64))], names)

    names = ["doc_id", *["text_hash"] * text_hash, "fp"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.xxhash64("text").alias("text_hash")] * text_hash)
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def blocks_of(positions: list[int], n: int) -> list[list[int]]:
    """``positions`` cut into ``n`` runs whose sizes differ by one at most."""
    cut = [len(positions) * i // n for i in range(n + 1)]
    return [positions[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _mask(positions: list[int]) -> int:
    return sum(1 << p for p in positions) - (1 << 64) * (63 in positions)  # as a signed long


def key_masks(bits: int) -> list[int]:
    """Masks of which any two fingerprints within ``bits`` agree on at least one."""
    cut = blocks_of(list(range(64)), bits + 2)
    return [_mask(a + b) for a, b in combinations(cut, 2)]


def finer_masks(mask: int, bits: int) -> list[int]:
    """Under a key that fixes the bits of ``mask``: masks that add a block of the others, one of which such a pair shares."""
    free = [p for p in range(64) if not mask >> p & 1]
    if not free:
        return []
    return [m for m in (_mask([p for p in range(64) if p not in free] + b) for b in blocks_of(free, min(bits + 1, len(free)))) if m != mask]


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join distinct fingerprints (uint64) as all pairs within ``bits`` would; one fewer than nodes at most.

    Breadth first: each node is compared once, with those that no class has yet.
    """
    out, left = [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                found = left[near]
                out += [(int(np.int64(at.view(np.int64))), int(x)) for x in found.view(np.int64)]
                queue += list(found)
                left = left[~near]
    return out


def _linked(dealt: DataFrame, bits: int) -> DataFrame:
    """Links (u, v) among the fingerprints of each key of (mask, key, fp); a key is held in one task."""

    def run(batches):
        def rows(found):
            u, v = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        def close(parts):
            fps = np.unique(np.concatenate(parts))
            return forest(fps.view(np.uint64), bits) if len(fps) > 1 else []

        at, parts, out = None, [], []
        for batch in batches:
            ms, ks, fs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp"))
            if not len(ks):
                continue
            edge = np.flatnonzero((ks[1:] != ks[:-1]) | (ms[1:] != ms[:-1])) + 1
            bounds = np.concatenate(([0], edge, [len(ks)]))
            # runs of one row in the middle of a batch link nothing
            for r in sorted({0, len(bounds) - 2, *np.flatnonzero(np.diff(bounds) > 1).tolist()}):
                a, b = int(bounds[r]), int(bounds[r + 1])
                if (ms[a], ks[a]) != at:
                    out += close(parts) if parts else []
                    at, parts = (ms[a], ks[a]), []
                parts.append(fs[a:b])
                if len(out) > 20_000:
                    yield rows(out)
                    out = []
        out += close(parts) if parts else []
        yield rows(out)

    return in_runs(dealt, ["mask", "key"], "fp").mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, bits: int = BITS, largest: int = LARGEST) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``nodes`` (fp) with the components of all pairs within ``bits``.

    The sizes of keys come from an aggregate; rows of a key over ``largest`` go to the finer masks without ever meeting in one task.
    """
    dealt = nodes.select("fp", F.explode(F.array(*map(F.lit, key_masks(bits)))).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    out = None
    while True:
        wide = materialise(dealt.groupBy("mask", "key").count().where(F.col("count") > largest).select("mask", "key", F.lit(True).alias("wide")), "wide")
        masks = [r.mask for r in wide.select("mask").distinct().collect()]  # a few hundred masks at most
        marked = dimension_join(dealt, wide, ["mask", "key"], "left", F.col("fp")) if masks else dealt.withColumn("wide", F.lit(None).cast("boolean"))
        found = materialise(_linked(marked.where(F.col("wide").isNull()).select("mask", "key", "fp"), bits), "links")
        out = found if out is None else out.union(found)
        if not masks:
            return out
        finer = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*map(F.lit, finer_masks(m, bits))))])
        over = marked.where("wide").select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
        dealt = materialise(over.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct(), "finer")


def classes(marked: DataFrame, bits: int = BITS, largest: int = LARGEST, node_class: str | None = None) -> DataFrame:
    """Adds ``component_id``, the smallest doc_id that a document reaches over links, to (doc_id, fp, ...).

    With ``node_class`` a column of that name tells the class itself, by a fingerprint of it, which null ids don't blur.

    ``marked`` is read more than once, so give a stored table.
    """
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    roots = materialise(connected_components(links(nodes.select("fp"), bits, largest)), "roots")
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = dimension_join(joined, least, ["root"], "inner", F.col("fp"))
    moved = materialise(named.select("fp", "component_id", *[F.col("root").alias(c) for c in (node_class,) if c]), "classes")
    # a fingerprint may be that of a third of all rows
    return dimension_join(marked, moved, ["fp"], "left", F.col("doc_id"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint as 16 lowercase hex digits, component_id) for every row of ``docs`` (doc_id, text)."""
    marked = materialise(fingerprints(docs, shingle_words), "fingerprints")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return classes(marked, bits).select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, bits: int = BITS, similarity: float | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each class: that of the smallest doc_id, nulls last, then of the smallest text hash.

    Classes are those of ``near_duplicates``; with ``similarity`` those of texts whose shingles of ``shingles.SHINGLE_WORDS`` words have that
    Jaccard similarity, to which fingerprints give the first candidates (see ``shingles``).
    """
    if similarity is not None:
        from vellum.llm import shingles

        if (similarity, shingle_words) != (shingles.SIMILARITY, shingles.SHINGLE_WORDS):
            raise ValueError(f"the bands are made for a similarity of {shingles.SIMILARITY} over shingles of {shingles.SHINGLE_WORDS} words")
        return keep_first(docs, shingles.classes(docs, materialise(shingles.mark(docs), "shingles")))
    marked = materialise(fingerprints(docs, shingle_words, text_hash=True), "fingerprints")
    return keep_first(docs, classes(marked, bits, node_class="class").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "class"))


def keep_first(docs: DataFrame, told: DataFrame) -> DataFrame:
    """``docs`` with one row of each class as ``keep_one`` picks it; ``told`` (_id, _hash, class) has a row for each of theirs."""
    key = (F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    order = F.struct(F.col("_id").isNull(), "_id", "_hash")
    # a class may hold a third of all rows: its rows are salted, its first one is found by salt before by class
    told = materialise(told.withColumn("salt", F.pmod(F.xxhash64("_id", "_hash"), F.lit(SALTS))), "classes")
    first = told.groupBy("class", "salt").agg(F.min(order).alias("f")).groupBy("class").agg(F.min("f").alias("f"))
    gone = materialise(told.join(repeated(first, "salt", SALTS), ["class", "salt"]).where(order != F.col("f")).select("_id", "_hash").distinct(), "gone")
    out = docs.withColumns({"__key_id": key[0], "__key_hash": key[1]})

    def by_key(side: DataFrame, how: str, left: DataFrame) -> DataFrame:
        on = left["__key_id"].eqNullSafe(side["_id"]) & (left["__key_hash"] == side["_hash"])
        return left.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side, on, how)

    out = by_key(gone, "left_anti", out)
    again = materialise(told.groupBy("_id", "_hash").agg(F.count("*").alias("n")).where("n > 1").select("_id", "_hash"), "again")
    if again.count():  # rows that agree in id and text, of which one stays
        out = by_key(again, "left_anti", out).union(by_key(again, "left_semi", out).dropDuplicates(["__key_id", "__key_hash"]))
    return out.select(*docs.columns)
