"""Classes of texts whose word shingles have a Jaccard similarity of 0.8 or more: what ``simhash.keep_one`` keeps one of each of.

Links come first from fingerprints of the shingle sets, as ``simhash`` makes and joins them by pigeonhole blocks. Pairs at the similarity asked for
differ in ten bits of 64 on average, which no blocks of 64 bits find, so what fingerprints leave apart is looked for by MinHash bands:
``BANDS`` keys of ``ROWS`` minima each. A pair at a similarity of exactly ``SIMILARITY`` shares no key with a probability of 6e-4, one at 0.85 with 3e-6. Every
candidate of either kind is checked on its whole shingle sets, so nothing is linked by chance.

Equal sets are one node from the start. Only keys whose nodes are of several classes go on. Each node is compared with the least of the least nodes of its keys
first, which joins a group of near copies by one pair a node, then with the others of them that are still of another class. At last all nodes that are still in
different classes are compared where they meet: the whole sets of a key's nodes go to the key's task, which passes on a spanning forest of the links that it finds, so
that pairs are never written out, however many share a passage. A key over ``CELL_NODES`` or ``CELL_SHINGLES`` is cut into parts, any two of which meet in a cell.
Pairs whose set sizes alone keep them under the similarity are left out of all, and so are, but of the first, pairs whose sketches, a bit of each minimum, differ in
more than ``SKETCH_BITS`` places: a pair at the similarity differs in 32 of 320, with a standard deviation of 5.4, so it is lost with a probability of 4e-6, while texts
that share a passage, but not most of their words, are told apart by 40 bytes each. No key is dropped or cut short.

Defined results: words and case are those of ``simhash``; a text with fewer words than a shingle is one shingle; null and blank texts
have the empty set, which equals itself; very long texts are compared whole; repeated rows are of one class; null ids don't matter here; an empty table
gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import byte_blocks, dimension_join, in_runs, materialise, mix64, slices, text_buffers, word_hashes
from vellum.llm.components import connected_components
from vellum.llm.simhash import _LOWER, fingerprint, links

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 8
SKETCH_BITS = 56
#: Nodes, and shingles of nodes, of a part of a key; a task holds two parts at most.
CELL_NODES = 16_384
CELL_SHINGLES = 1 << 20
#: What products of the similarity and a set's size are off by at most, which are whole numbers where it matters.
ROUNDING = 1e-6

_FOLD = np.frombuffer(_LOWER, np.uint8)
_FACTOR = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The distinct shingle hashes (uint64, sorted) of each row of a text buffer."""
    words, first = word_hashes(_FOLD[data], offsets)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        size = min(n, b - a)
        mixed = np.zeros(b - a - size + 1 if size else 0, np.uint64)
        for j in range(size):
            mixed = mix64(mixed + words[a + j : a + j + len(mixed)] + np.uint64(j + 1))
        out.append(np.unique(mixed))
    return out


def _set_id(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes(), 42) if len(shingles) else 0


def band_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``BANDS`` keys (uint64) of each non-empty set, where keys of different bands differ, and its sketch: a bit of each minimum (uint64 words)."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    keys = np.tile(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sets), 1))
    bits = np.zeros((len(sets), BANDS * ROWS), np.uint8)
    for i, factor in enumerate(_FACTOR):
        turned = flat * factor
        turned ^= turned >> np.uint64(32)
        turned *= factor
        least = np.minimum.reduceat(turned, starts)
        keys[:, i // ROWS] = mix64(keys[:, i // ROWS] + least + np.uint64(1))
        bits[:, i] = least & np.uint64(1)
    return keys, np.packbits(bits, axis=1).view(np.uint64)


def mark(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, n, fp, keys, sketch) for every row: ``node`` tells the shingle set, ``n`` is its size, ``fp`` its fingerprint; empty sets have no keys."""

    def run(batches):
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column("text"))
            sets, keys, sketches = [], [], []
            for lo, hi in byte_blocks(offsets):
                part = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                some = [i for i, s in enumerate(part) if len(s)]
                mine: list = [[]] * len(part)
                short: list = [[]] * len(part)
                if some:
                    for i, k, bits in zip(some, *band_keys([part[i] for i in some]), strict=True):
                        mine[i], short[i] = k.view(np.int64), bits.view(np.int64)
                sets += [(_set_id(s), len(s), fingerprint(s)) for s in part]
                keys += mine
                sketches += short
            ids = np.asarray([s[0] for s in sets], np.uint64).view(np.int64)
            sizes, fps = pa.array([s[1] for s in sets], pa.int32()), np.asarray([s[2] for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(ids), sizes, pa.array(fps), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "text_hash", "node", "n", "fp", "keys", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, n int, fp long, keys array<long>, sketch array<long>")


def key_pairs(nodes: np.ndarray, sizes: np.ndarray, roots: np.ndarray, sketches: np.ndarray, similarity: float = SIMILARITY, parts: np.ndarray | None = None):
    """Arrays (u, v) to be checked in one key: the pairs of nodes of different classes, and of different ``parts``, whose sizes and sketches (one row each) allow it."""
    order = np.argsort(roots, kind="stable")
    nodes, sizes, roots, sketches = nodes[order], sizes[order], roots[order], sketches[order]
    parts = None if parts is None else parts[order]
    after = np.searchsorted(roots, roots, "right")  # where the next class begins
    for i in np.flatnonzero(after < len(nodes)).tolist():
        v, n = nodes[after[i] :], sizes[after[i] :]
        near = np.bitwise_count(sketches[after[i] :] ^ sketches[i]).sum(axis=1) <= SKETCH_BITS
        if parts is not None:
            near &= parts[after[i] :] != parts[i]
        v = v[near & (np.minimum(n, sizes[i]) >= similarity * np.maximum(n, sizes[i]) - ROUNDING)]
        yield np.minimum(v, nodes[i]), np.maximum(v, nodes[i])


def _runs(batches, by: tuple[str, ...], columns: tuple[str, ...]):
    """(values of ``by``, the run's ``columns`` as arrays) of each run of two rows or more in sorted record batches; a run may span batches."""
    at, parts = None, []

    def whole():
        return [np.concatenate(c) for c in zip(*parts, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        bounds = np.concatenate(([0], edge, [batch.num_rows]))
        # runs of one row in the middle of a batch pair nothing
        for r in sorted({0, len(bounds) - 2, *np.flatnonzero(np.diff(bounds) > 1).tolist()}):
            a, b = int(bounds[r]), int(bounds[r + 1])
            here = tuple(int(k[a]) for k in keys)
            if here != at:
                if sum(len(p[0]) for p in parts) > 1:
                    yield at, whole()
                at, parts = here, []
            parts.append([v[a:b] for v in values])
    if sum(len(p[0]) for p in parts) > 1:
        yield at, whole()


def _batches(found, names: list[str], most: int = 100_000):
    """Record batches of long columns ``names`` from tuples of arrays, in pieces of about ``most`` rows."""
    out, size = [], 0

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(f[i] for f in out)])) for i in range(len(names))], names)

    for f in found:
        out.append(f)
        size += len(f[0])
        if size > most:
            yield rows()
            out, size = [], 0
    yield rows()


def cells(dealt: DataFrame, weight: Column, most: int) -> DataFrame:
    """``dealt`` (key, node, ...) with (lo, hi, part): a key whose ``weight`` sums up to more than ``most`` is cut into parts by the hash of its nodes.

    A cell (key, lo, hi) holds the nodes of two parts, or of one where both are the same, so that any two nodes of a key meet in one cell and no
    task holds more than two parts. Keys under the bound are one cell.
    """
    wide = dealt.groupBy("key").agg(F.sum(weight).alias("w")).where(F.col("w") > most)
    wide = materialise(wide.select("key", F.ceil(F.col("w") / most).cast("int").alias("parts")), "wide")
    out = dimension_join(dealt, wide, ["key"], "left", F.col("node")).withColumn("parts", F.coalesce("parts", F.lit(1)))
    out = out.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("parts", "other")


def meeting(dealt: DataFrame, most: int = CELL_NODES) -> DataFrame:
    """Distinct (key, node) of ``dealt`` (key, node, n, root, sketch) where some node of another class under the key may be similar enough."""

    def run(batches):
        def found():
            for (key, lo, hi), (part, *columns, sketches) in _runs(batches, ("key", "lo", "hi"), ("part", "node", "n", "root", "sketch")):
                pairs = key_pairs(*columns, np.stack(sketches).view(np.uint64), parts=part if lo != hi else None)
                some = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(np.concatenate(p)) for p in pairs)]))
                yield np.full(len(some), key, np.int64), some

        yield from _batches(found(), ["key", "node"])

    rows = cells(dealt.select("key", "node", "n", "root", "sketch"), F.lit(1), most)
    return in_runs(rows, ["key", "lo", "hi"], "node").mapInArrow(run, "key long, node long").distinct()


def key_links(key: int, nodes, roots, sketches, keys, sets, parts=None, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (u, v) between nodes of different classes in one key: a spanning forest of the pairs whose whole ``sets`` are similar.

    Only pairs whose first common one of ``keys`` (a row each) is ``key`` are compared, so that each pair is compared under one key. With ``parts``,
    pairs of one part are left to that part's own cell.
    """
    roots, sizes, out = roots.copy(), np.asarray([len(s) for s in sets]), []
    starts = np.cumsum([0, *sizes])
    _, ids = np.unique(np.concatenate(list(sets)), return_inverse=True)
    here = np.zeros(len(ids), bool)
    for i in range(len(nodes) - 1):
        rest = np.flatnonzero(roots[i + 1 :] != roots[i]) + i + 1
        if parts is not None:
            rest = rest[parts[rest] != parts[i]]
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]) - ROUNDING]
        rest = rest[np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1) <= SKETCH_BITS]
        rest = rest[keys[i][(keys[rest] == keys[i]).argmax(axis=1)] == key] if len(rest) else rest
        if not len(rest):
            continue
        mine = ids[starts[i] : starts[i + 1]]
        here[mine] = True
        others = here[np.concatenate([ids[starts[j] : starts[j + 1]] for j in rest.tolist()])]
        here[mine] = False
        both = np.add.reduceat(others, np.cumsum([0, *sizes[rest[:-1]]]), dtype=np.int64)
        for j in rest[both >= similarity * (sizes[i] + sizes[rest] - both) - ROUNDING].tolist():
            if roots[j] != roots[i]:
                out.append((int(nodes[i]), int(nodes[j])))
                roots[roots == roots[j]] = roots[i]
    return out


def links_in_keys(dealt: DataFrame, most: int = CELL_SHINGLES) -> DataFrame:
    """Links (u, v) with the classes of all similar pairs under the keys of ``dealt`` (key, node, n, root, sketch, keys, shingles); pairs aren't written out."""

    def run(batches):
        def found():
            for (key, lo, hi), (part, nodes, roots, sketches, keys, sets) in _runs(batches, ("key", "lo", "hi"), ("part", "node", "root", "sketch", "keys", "shingles")):
                pairs = key_links(key, nodes, roots, np.stack(sketches).view(np.uint64), np.stack(keys), sets, part if lo != hi else None)
                yield tuple(np.asarray([p[k] for p in pairs], np.int64) for k in (0, 1))

        yield from _batches(found(), ["u", "v"])

    rows = cells(dealt, F.col("n"), most)
    return in_runs(rows, ["key", "lo", "hi"], "node").mapInArrow(run, "u long, v long")


def shingle_rows(texts: DataFrame) -> DataFrame:
    """(node, shingles) of ``texts`` (node, text)."""

    def run(batches):
        for batch in slices(batches, 128):
            data, offsets = text_buffers(batch.column("text"))
            found = [s.view(np.int64) for lo, hi in byte_blocks(offsets) for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The ``pairs`` (u, v) whose shingle sets are as similar as asked; ``texts`` (node, text) has one text of each node."""
    known = materialise(shingle_rows(texts), "sets")
    a, b = (known.select(F.col("node").alias(k), F.col("shingles").alias(s)) for k, s in (("u", "a"), ("v", "b")))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").where(both >= similarity * (F.size("a") + F.size("b") - both) - ROUNDING).select("u", "v")


def _roots(found: DataFrame) -> DataFrame:
    return materialise(connected_components(found), "roots")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of ``nodes`` (node, n, fp) whose fingerprints are linked or equal; of nodes with one fingerprint, each with the least."""
    least = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    equal = dimension_join(nodes.select("node", "fp"), least, ["fp"], "inner", F.col("node")).where("first < node").select(F.col("first").alias("u"), F.col("node").alias("v"))
    ends = [least.select(F.col("fp").alias(k), F.col("first").alias(f"{k}_node")) for k in ("u", "v")]
    near = links(least.select("fp")).join(ends[0], "u").join(ends[1], "v")
    return equal.union(near.select(F.least("u_node", "v_node"), F.greatest("u_node", "v_node"))).distinct()


def classes(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(_id, _hash, class) for every row of ``marked``, which ``mark`` gave for ``docs``. Reads both more than once, so give stored tables."""
    nodes = marked.groupBy("node").agg(F.min_by(F.struct("n", "fp", "keys", "sketch"), "text_hash").alias("s"), F.min("text_hash").alias("text_hash"))
    nodes = materialise(nodes.select("node", "text_hash", "s.n", "s.fp", "s.keys", "s.sketch"), "nodes")
    once = docs.select("text", F.xxhash64("text").alias("text_hash"))
    known = nodes.select("node", "text_hash")

    def texts_of(asked: DataFrame) -> DataFrame:
        wanted = known.join(asked, "node", "left_semi")
        return dimension_join(once, wanted, ["text_hash"], "inner", F.monotonically_increasing_id()).dropDuplicates(["node"]).select("node", "text")

    def settle(pairs: DataFrame, so_far: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        good = materialise(verified(pairs, texts_of(asked)), "links")
        good = good if so_far is None else so_far.union(good)
        return good, _roots(good)

    # most keys are those of one node and meet nothing
    dealt = nodes.select("node", F.explode("keys").alias("key"))
    shared = materialise(dealt.join(dealt.groupBy("key").count().where(F.col("count") > 1).select("key"), "key"), "shared")
    known_nodes = materialise(nodes.select("node", "n", "sketch").join(shared.select("node").distinct(), "node"), "met")

    def open_keys(roots: DataFrame) -> DataFrame:
        """Rows (key, node, n, root, first) of the keys whose nodes are of several classes; ``first`` is the key's least node with its size."""
        rooted = dimension_join(known_nodes, roots, ["node"], "left", F.col("node")).withColumn("root", F.coalesce("root", "node"))
        told = shared.join(rooted, "node")
        several = told.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct("node", "n", "sketch", "root")).alias("first")).where("lo < hi")
        return told.join(several.select("key", "first"), "key")

    def stars(roots: DataFrame) -> DataFrame:
        """Distinct pairs (u, v) of each node v with the least nodes u of its keys, where these are of other classes."""
        apart = F.aggregate(F.zip_with("sketch", "first.sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
        sized = F.least("n", "first.n") >= SIMILARITY * F.greatest("n", "first.n") - ROUNDING
        other = open_keys(roots).where((F.col("root") != F.col("first.root")) & sized & (apart <= SKETCH_BITS))
        return other.select(F.col("first.node").alias("u"), F.col("node").alias("v")).distinct()

    first = materialise(fingerprint_pairs(nodes), "pairs")
    good, roots = settle(first, None)
    second = materialise(stars(roots).groupBy("v").agg(F.min("u").alias("u")).select("u", "v").join(first, ["u", "v"], "left_anti"), "pairs")
    good, roots = settle(second, good)
    seen = first.union(second)
    third = materialise(stars(roots).join(seen, ["u", "v"], "left_anti"), "pairs")
    good, roots = settle(third, good)
    asked = materialise(meeting(open_keys(roots)), "meeting")
    sets = materialise(shingle_rows(texts_of(asked.select("node").distinct())), "sets")
    known_sets = dimension_join(sets.join(nodes.select("node", "n", "sketch", "keys"), "node"), roots, ["node"], "left", F.col("node"))
    fourth = asked.join(known_sets.withColumn("root", F.coalesce("root", "node")), "node")
    roots = _roots(good.union(materialise(links_in_keys(fourth), "links")))
    out = marked.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "node")
    return dimension_join(out, roots, ["node"], "left", F.col("_id")).select("_id", "_hash", F.coalesce("root", "node").alias("class"))
