"""Removal of repeated passages by fixed-block anchors.

A window is ``WINDOW`` consecutive words of one document. A window whose word sequence also starts in a document with a smaller id
is a repeat, and every word that a repeat covers is removed; windows are judged on the input.

Each document's non-overlapping blocks of ``BLOCK`` words are the index; the hash of every rolling window of ``BLOCK`` words
of every document probes it. As 2 * ``BLOCK`` <= ``WINDOW``, a repeat holds a whole block of the other document, so a
hash that is a block somewhere and occurs in two documents anchors it on both sides. From its anchors each hit is extended word by word
to all windows of ``WINDOW`` words around them, whose smallest document is found; neighbouring repeats merge into maximal exact
repeats. An anchor's hash is a filter only, so 32 bits and the partition number do. What it lets through is decided by 128-bit
hashes of whole windows: each word's XXH3 digest, joined pairwise by a mixing that is not linear, so that no
structure of words or letters makes unequal windows equal, and chance does so once in 10^12 corpora of 10^13 windows.

Texts longer than ``SEGMENT_BYTES`` are cut at words into segments, which repeat ``WINDOW`` - 1 words of their neighbours on either
side, so each segment judges its own words alone. Segments and whole texts are dealt in groups by hash, of about ``GROUP_BYTES`` of text whatever their number,
and everything that leaves a group is made distinct in it first, so a passage that a third of all documents share is sent once by each group.
What travels is a few bytes a word (hashes in fixed order out, one bit each back); the text itself is shuffled once and that
exchange serves all three passes over it.

Defined results: a null or empty text has no words and the digest of no bytes; texts with fewer than ``WINDOW`` words
lose nothing; repeated rows of one id don't repeat each other, and each gets a row; rows with a null id keep all words and take none
from others; a very long text is one row like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import in_runs, materialise, text_buffers

WINDOW = 50
BLOCK = 25
#: Bytes of text of one group, about; of a segment of a long text; and of text whose probes meet in one partition, about.
GROUP_BYTES = 2 << 20
SEGMENT_BYTES = 1 << 19
PART_BYTES = 16 << 20
#: Rows of one group, about, where texts are short.
GROUP_ROWS = 16_384

_PROBES = pa.schema([("p", pa.int32()), ("g", pa.int32()), ("hashes", pa.binary()), ("block", pa.binary()), ("many", pa.binary())])
_FLAGS = pa.schema([("g", pa.int32()), ("p", pa.int32()), ("bits", pa.binary())])
_WINDOWS = pa.schema([("p", pa.int32()), ("g", pa.int32()), ("hashes", pa.binary()), ("least", pa.binary()), ("many", pa.binary())])
_REPEATS = pa.schema([("g", pa.int32()), ("hashes", pa.binary()), ("least", pa.binary())])
_SEGMENTS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("seg", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("text", pa.string())])
_DONE = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("seg", pa.int32()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


# --- hashes


def word_digests(found: list[bytes]) -> np.ndarray:
    """(n, 2) uint64: 128 bits of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), "<u8").reshape(-1, 2)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` words from each place on, from the words' hashes: runs of 1, 2, 4, ... words, and of those the ones that ``width`` is made of."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, level, size = None, 0, h, 1
    while True:
        if width & size:
            piece = level[at : at + n]
            out = piece if out is None else _join(out, piece)
            at += size
        if 2 * size > width:
            return out
        level = _join(level[:-size], level[size:])
        size *= 2


# --- segments of long texts


def segments(raw: bytes, most: int):
    """(first own word, end of the own words, bytes) of the segments of a text: each has about ``most`` bytes of words of its own and ``WINDOW`` - 1 words of context on either side."""
    at, before = 0, b""
    while True:
        end = min(len(raw), at + most)
        while end < len(raw) and raw[end : end + 1].split():  # to the end of the word
            end += 1
        own = raw[at:end]
        after, look = [], 1 << 12
        while end < len(raw):
            ahead = raw[end : end + look]
            after = ahead.split()[:WINDOW]
            if len(after) >= WINDOW or end + look >= len(raw):
                break
            look *= 2
        lo, n = len(before.split()), len(own.split())
        yield lo, lo + n, b" ".join([before, own, *after[: WINDOW - 1]])
        if end >= len(raw):
            return
        before = b" ".join([*before.split(), *own.split()][-(WINDOW - 1) :])
        at = end


def _cut(most: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                data, _ = text_buffers(row.column("text"))
                doc_id, key = row.column("doc_id")[0].as_py(), row.column("key")[0].as_py()
                for seg, (lo, hi, piece) in enumerate(segments(data.tobytes(), most)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((doc_id, key, seg, lo, hi, piece.decode("utf-8", "replace")), _SEGMENTS, strict=True)], schema=_SEGMENTS)

    return run


class Group:
    """The texts of a group with their words and the words' hashes. Of a row, the words from ``lo`` up to ``hi`` are its own; -1 is the end."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").to_pylist()
        data, offsets = text_buffers(table.column("text"))
        raw = data.tobytes()
        self.words = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        self.lanes = word_digests(list(chain.from_iterable(self.words)))
        self.n_words = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.first = np.concatenate(([0], np.cumsum(self.n_words)))
        self.doc = np.repeat(np.arange(len(self.ids)), self.n_words)
        known = np.asarray([i is not None for i in self.ids], bool)
        self.id_of = np.asarray([i if i is not None else 0 for i in self.ids], np.int64)
        self.long = known & (self.n_words >= WINDOW)  # rows that have windows

    def starts(self, width: int) -> np.ndarray:
        """First words of all windows of ``width`` words in rows that have windows."""
        at = np.arange(len(self.doc))
        return at[self.long[self.doc] & (self.first[self.doc + 1] - at >= width)] if len(at) else at

    def anchors(self, parts: int):
        """Windows of ``BLOCK`` words: their starts, and the number of each one's distinct hash; of the distinct ones, in a fixed order, the part, 32 bits, whether a block, whether in two rows."""
        at = self.starts(BLOCK)
        h = window_hashes(self.lanes[:, 0], BLOCK)[at] if len(at) else np.zeros(0, np.uint64)
        part = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((h, part)) if parts > 1 else np.argsort(h, kind="stable")
        s = h[order]
        edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        number = np.empty(len(at), np.int64)
        number[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(s))))
        if not len(edge):
            return at, number, np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool), np.zeros(0, bool)
        docs = self.doc[at][order]
        block = (at - self.first[self.doc[at]]) % BLOCK == 0
        is_block = np.logical_or.reduceat(block[order], edge)
        many = np.minimum.reduceat(docs, edge) != np.maximum.reduceat(docs, edge)
        return at, number, part[order][edge], (s[edge] >> np.uint64(32)).astype(np.uint32), is_block, many

    def window_lanes(self, starts: np.ndarray) -> np.ndarray:
        """(n, 2) uint64: 128 bits of the windows of ``WINDOW`` words at ``starts``."""
        if not len(starts):
            return np.zeros((0, 2), np.uint64)
        return np.stack([window_hashes(self.lanes[:, k], WINDOW)[starts] for k in (0, 1)], axis=1)


def _part_runs(part: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(part):
        return []
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    ends = np.append(edge[1:], len(part))
    return [(int(part[a]), int(a), int(b)) for a, b in zip(edge, ends, strict=True)]


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _bools(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _lanes(column: pa.ChunkedArray) -> tuple[np.ndarray, list[int]]:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u8").reshape(-1, 2), [len(x) // 16 for x in raw]


def _edges(lanes: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    return np.flatnonzero(np.concatenate(([True], (lanes[1:] != lanes[:-1]).any(axis=1)))) if len(lanes) else np.zeros(0, np.int64)


def _probes(parts: int):
    def run(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        _, _, part, bits, block, many = Group(table).anchors(parts)
        return _table([(p, g, bits[a:b].tobytes(), _bits(block[a:b]), _bits(many[a:b])) for p, a, b in _part_runs(part)], _PROBES)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """For each group's probes of a part, which hashes are a block somewhere and occur in two documents."""
    raw = table.column("hashes").to_pylist()
    sizes = [len(x) // 4 for x in raw]
    h = np.frombuffer(b"".join(raw), np.uint32)
    block = np.concatenate([_bools(x, n) for x, n in zip(table.column("block").to_pylist(), sizes, strict=True)])
    many = np.concatenate([_bools(x, n) for x, n in zip(table.column("many").to_pylist(), sizes, strict=True)])
    index = np.unique(h[block])
    flag = np.zeros(len(h), bool)
    if len(index):
        at = np.searchsorted(index, h)
        at[at == len(index)] = 0
        hit = index[at] == h
        seen = np.bincount(at[hit], minlength=len(index)) > 1
        seen |= np.bincount(at[hit & many], minlength=len(index)) > 0
        flag = hit & seen[at]
    ends = np.cumsum(sizes)
    bits = [_bits(flag[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
    return pa.Table.from_arrays([table.column("g").combine_chunks(), table.column("p").combine_chunks(), pa.array(bits, pa.binary())], schema=_FLAGS)


def _windows(parts: int):
    def run(table: pa.Table, flags: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows and flags.num_rows:
            g, group = table.column("g")[0].as_py(), Group(table)
            at, number, part, _, _, _ = group.anchors(parts)
            told = dict(zip(flags.column("p").to_pylist(), flags.column("bits").to_pylist(), strict=True))
            flag = np.concatenate([_bools(told[p], b - a) for p, a, b in _part_runs(part)]) if len(part) else np.zeros(0, bool)
            marks = np.zeros(len(group.doc) + 1, np.int64)
            marks[at[flag[number]] + 1] = 1
            upto = np.cumsum(marks)
            s = group.starts(WINDOW)
            s = s[upto[s + WINDOW - BLOCK + 1] > upto[s]]  # an anchor lies within
            h, ids = group.window_lanes(s), group.id_of[group.doc[s]]
            where = (h[:, 0] % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((ids, h[:, 1], h[:, 0], where))
            h, ids, where = h[order], ids[order], where[order]
            edge = _edges(h)
            if len(edge):
                last = np.append(edge[1:], len(h)) - 1
                least, many, where, h = ids[edge], ids[edge] != ids[last], where[edge], h[edge]
                rows = [(p, g, h[a:b].tobytes(), least[a:b].tobytes(), _bits(many[a:b])) for p, a, b in _part_runs(where)]
        return _table(rows, _WINDOWS)

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """For each group, its windows that a smaller document than one of its own has too, with the smallest document of all."""
    h, sizes = _lanes(table.column("hashes"))
    own = np.frombuffer(b"".join(table.column("least").to_pylist()), np.int64)
    many = np.concatenate([_bools(x, n) for x, n in zip(table.column("many").to_pylist(), sizes, strict=True)])
    order = np.lexsort((h[:, 1], h[:, 0]))
    edge = _edges(h[order])
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(own[order], edge), np.diff(np.append(edge, len(h))))
    good = many | (least < own)
    rows, lo = [], 0
    for g, n in zip(table.column("g").to_pylist(), sizes, strict=True):
        keep = np.flatnonzero(good[lo : lo + n]) + lo
        if len(keep):
            rows.append((g, h[keep].tobytes(), least[keep].tobytes()))
        lo += n
    return _table(rows, _REPEATS)


def _found(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each row of ``h`` in the distinct rows ``keys``, which are sorted by their first and second lane; -1 for none."""
    at = np.searchsorted(keys[:, 0], h[:, 0])
    at[at == len(keys)] = 0
    out = np.where((keys[at] == h).all(axis=1), at, -1)
    if (keys[1:, 0] == keys[:-1, 0]).any():  # half of two keys is equal: all are looked at
        place = {k.tobytes(): i for i, k in enumerate(keys)}
        out = np.asarray([place.get(x.tobytes(), -1) for x in h], np.int64)
    return out


def _removals(keep_text: bool):
    def run(table: pa.Table, repeats: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _DONE.empty_table()
        group = Group(table)
        drop = np.zeros(len(group.doc), bool)
        if repeats.num_rows:
            keys, _ = _lanes(repeats.column("hashes"))
            least = np.frombuffer(b"".join(repeats.column("least").to_pylist()), np.int64)
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            keys, least = keys[order], least[order]
            s = group.starts(WINDOW)
            at = _found(keys, group.window_lanes(s))
            bad = s[(at >= 0) & (least[at] < group.id_of[group.doc[s]])]
            depth = np.zeros(len(drop) + 1, np.int64)
            np.add.at(depth, bad, 1)
            np.add.at(depth, bad + WINDOW, -1)
            drop = np.cumsum(depth[:-1]) > 0
        rows = []
        for k, (found, seg, lo, hi) in enumerate(zip(group.words, *(table.column(c).to_pylist() for c in ("seg", "lo", "hi")), strict=True)):
            own = slice(lo, len(found) if hi < 0 else hi)
            gone = drop[group.first[k] : group.first[k + 1]][own]
            mine = found[own]
            kept = b" ".join(compress(mine, (~gone).tolist()) if gone.any() else mine)
            whole = hi < 0
            rows.append((len(mine), int(gone.sum()), hashlib.sha256(kept).hexdigest() if whole else None, kept.decode("utf-8", "replace") if keep_text or not whole else None))
        cols = [table.column(c).combine_chunks() for c in ("doc_id", "key", "seg")]
        return pa.Table.from_arrays([*cols, *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_DONE)[3:], strict=True))], schema=_DONE)

    return run


def _joined(keep_text: bool):
    """Of the segments in order of (doc_id, key, seg), a row for each text; rows that there are two of each segment of are two texts."""

    def run(batches):
        names = [f.name for f in _DONE]

        def close():
            row = (at[0], at[1], 0, words, removed, digest.hexdigest(), " ".join(texts) if keep_text else None)
            return _table([row] * times, _DONE).to_batches()

        at = last = None
        for batch in batches:
            for doc_id, key, seg, n, gone, _, kept in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (doc_id, key) != at:
                    if at is not None:
                        yield from close()
                    at, last, times, words, removed, digest, texts, begun = (doc_id, key), None, 0, 0, 0, hashlib.sha256(), [], False
                times += seg == 0
                if seg == last:
                    continue
                last, words, removed = seg, words + n, removed + gone
                if kept:
                    digest.update((b" " if begun else b"") + kept.encode("utf-8", "surrogatepass"))
                    begun = True
                    if keep_text:
                        texts.append(kept)
        if at is not None:
            yield from close()

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = False, group_bytes: int = GROUP_BYTES, part_bytes: int = PART_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs`` (doc_id, text), and ``kept_text`` if asked for.

    Groups times parts is the number of rows that carry hashes; beyond some ten TB larger ``group_bytes`` and ``part_bytes`` keep those rows long.
    """
    length = F.octet_length("text")
    size = docs.agg(F.count("*").alias("n"), F.sum(length).alias("b"), F.count_if(length > segment_bytes).alias("cut")).first()
    volume = size.b or 0
    groups, parts = max(1, -(-volume // group_bytes), -(-size.n // GROUP_ROWS)), max(1, -(-volume // part_bytes))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    columns = [f.name for f in _SEGMENTS]
    rows = keyed.where(length.isNull() | (length <= segment_bytes)).withColumns({"seg": F.lit(0), "lo": F.lit(0), "hi": F.lit(-1)}).select(columns)
    if size.cut:
        rows = rows.unionByName(keyed.where(length > segment_bytes).mapInArrow(_cut(segment_bytes), _ddl(_SEGMENTS)))
    # rows of one id and text differ in their place alone
    g = F.pmod(F.xxhash64("doc_id", "key", "seg", F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("g")
    base = rows.select(*columns, g)
    probes = base.groupBy("g").applyInArrow(_probes(parts), _ddl(_PROBES))
    flags = probes.groupBy("p").applyInArrow(_shared, _ddl(_FLAGS))
    windows = base.groupBy("g").cogroup(flags.groupBy("g")).applyInArrow(_windows(parts), _ddl(_WINDOWS))
    repeats = windows.groupBy("p").applyInArrow(_repeats, _ddl(_REPEATS))
    done = base.groupBy("g").cogroup(repeats.groupBy("g")).applyInArrow(_removals(keep_text), _ddl(_DONE))
    if size.cut:
        done = materialise(done, "segments")
        ordered = in_runs(done.where("kept_sha256 IS NULL"), ["doc_id", "key"], "seg")
        done = done.where("kept_sha256 IS NOT NULL").unionByName(ordered.mapInArrow(_joined(keep_text), _ddl(_DONE)))
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text)
