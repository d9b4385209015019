"""Best-fit packing of tokenised documents by exact-complement hashing.

Sequences hold at most ``capacity`` tokens. The packer never looks at single pieces: it plans on the
histogram of piece lengths, which has at most ``capacity`` entries at any corpus size. For the longest
length still available it looks for single lengths, pairs and triples of lengths that fill the gap
exactly (the index is a direct-address table of availability counts, so the complement of a length or
of a pair is one lookup), and consumes as many such combinations as the counts allow. What has no exact
complement goes through best-fit decreasing. The plan is a short list of rank ranges; each piece finds
its place from its rank among the pieces of its length, so placement is one lookup in a bounded table.

Defined results: a null text counts as empty and yields the single id 0; a null id is kept; repeated rows
are packed each on its own; of equal lengths the smaller (doc_id, piece, ids_crc32) comes first in its bucket; a very long text is cut into as many
pieces as it needs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import KEPT, materialise, packed, slices

CAPACITY = 2048
SEPARATOR_ID = 0
#: Entries of one generation of a worker's word cache; two generations are kept, about 200 bytes an entry.
CACHE_WORDS = 250_000
#: Pieces of one rank bucket, about.
BUCKET_ROWS = 8192

#: str.split() cuts at the first ones, which are not white space to the tokenizer; special tokens hold the last.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: A sign after a letter that stays one letter in every normal form.
_SIGN = re.compile(r"[.,;:!?|%$&*#](?<=[a-zA-Z\xe0-\xf6\xf8-\xff].)")

_PLAIN = re.compile(r"[a-zA-Z\xe0-\xf6\xf8-\xff]+")


def _odd(text: str) -> bool:
    return any(x in text for x in _ODD)


def _folded(text: str) -> str:
    """Lower-cased, if all of it is Latin-1, where that is one letter for one whatever stands beside it."""
    try:
        return text.lower() if text.isascii() or text.encode("latin-1") else text
    except UnicodeEncodeError:
        return text


#: The normal form and the cuts of the tokenizers that a word cache is right for.
_NORMAL = [("NFC", None), ("Replace", ("\\s+", " ")), ("Lowercase", None)]
_CUTS = [("Split", ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", "Removed", True)), ("ByteLevel", (False, False))]


def splits_words(spec: str) -> bool:
    """Whether a tokenizer (its JSON) ignores case and white space and cuts between letters and signs, so that the ids of a text are those of its words."""
    spec = json.loads(spec)
    normal = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    found = [(n["type"], (n["pattern"].get("Regex"), n["content"]) if n["type"] == "Replace" else None) for n in normal]
    made = [(c["type"], (c["pattern"].get("Regex"), c["behavior"], c["invert"]) if c["type"] == "Split" else (c.get("add_prefix_space"), c.get("use_regex"))) for c in cuts]
    return found == _NORMAL and made == _CUTS and not spec.get("post_processor") and spec["model"].get("end_of_word_suffix") == "</w>"


class WordCache:
    """Ids of white-space separated words, as little-endian 32-bit bytes, in two bounded generations.

    The tokenizer drops white space before it merges, so a text's ids are those of its words in order. It also
    cuts between a letter and a sign after it, and ignores case; so white space put there and lower-cased
    Latin-1 change no id, and leave far fewer distinct words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.splits = splits_words(self.tokenizer.to_str())
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.fast(texts, add_special_tokens=False)]

    def encode_words(self, found: list[str]) -> list[bytes]:
        """Words of plain letters go through the tokenizer together; its marks of word ends tell their ids apart."""
        out: dict[str, bytes] = {}
        plain = [w for w in found if _PLAIN.fullmatch(w)]
        for lo in range(0, len(plain), 1000):
            part = plain[lo : lo + 1000]
            ids = np.asarray(self.fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, cuts = ids.tobytes(), (ends * 4).tolist()
                out.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
        rest = [w for w in found if w not in out]
        out.update(zip(rest, self.encode(rest), strict=True))
        return [out[w] for w in found]

    def _load(self, missing: list[str]) -> None:
        """Make the young generation hold ``missing`` (distinct), which it doesn't yet."""
        if len(self.young) + len(missing) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        old = self.old
        new = [k for k in missing if k not in old]
        if len(new) < len(missing):
            self.young.update((k, old[k]) for k in missing if k in old)
        self.young.update(zip(new, self.encode_words(new), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 256):  # a bounded number of new words at a time
            part = texts[lo : lo + 256]
            split = [[] if _odd(t) else _SIGN.sub(r" \g<0>", _folded(t)).split() for t in part]
            flat = list(chain.from_iterable(split))
            found = list(map(self.young.get, flat))
            holes = [i for i, x in enumerate(found) if x is None]
            if holes:
                self._load(list(dict.fromkeys(map(flat.__getitem__, holes))))
                get = self.young.__getitem__
                for i in holes:
                    found[i] = get(flat[i])
            at = 0
            for t, ws in zip(part, split, strict=True):
                out.append(b"".join(found[at : at + len(ws)]) if ws or not _odd(t) else self.encode([t])[0])
                at += len(ws)
        return out


def word_cache(path: str) -> WordCache:
    name = f"words of {path}"
    if name not in KEPT:
        KEPT[name] = WordCache(path)
    return KEPT[name]


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, and ids if asked for.

    A document's ids end in ``SEPARATOR_ID``. Where the tokenizer's own description says that a text's ids are those of its
    words (``splits_words``), these are kept in a cache; with any other tokenizer every text is encoded whole.
    """

    def pieces(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = word_cache(tokenizer)
        end = np.asarray([SEPARATOR_ID], "<u4").tobytes()
        for part in slices(batches, keeps=f"words of {tokenizer}"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            out = defaultdict(list)
            for doc_id, raw in zip(part.column("doc_id").to_pylist(), cache.ids(texts) if cache.splits else cache.encode(texts), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    piece = raw[at : at + 4 * capacity]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(piece) // 4)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    if keep_ids:
                        out["ids"].append(np.frombuffer(piece, "<u4").astype(np.int32))
            if out:
                yield pa.RecordBatch.from_pydict(dict(out), schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids)
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, ddl)


def exact_fill(counts: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """Lengths, at most three, that are available together and sum to ``gap``; None only if there are none. Fewer and longer ones are preferred."""
    if counts[gap]:
        return (gap,)
    have = np.flatnonzero(counts[:gap])[::-1]

    def pair(total: int, most: int, left: np.ndarray) -> tuple[int, int] | None:
        """The first pair of ``left`` that sums to ``total``, its larger length at most ``most``."""
        a = have[(have <= most) & (2 * have >= total) & (have < total)]
        a = a[(left[a] > 0) & (left[total - a] > 0) & ((2 * a != total) | (left[a] > 1))]
        return (int(a[0]), total - int(a[0])) if len(a) else None

    if two := pair(gap, gap - 1, counts):
        return two
    left = counts.copy()
    for x in have[have * 3 >= gap].tolist():
        left[x] -= 1  # the other two come from what is left beside it
        if two := pair(gap - x, x, left):
            return (x, *two)
        left[x] += 1
    return None


def plan_packing(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``lengths[n]`` pieces of each length n, as rows (length, first rank, end rank, copies a sequence, first sequence, offset).

    The piece of rank r in a row stands in sequence ``first + (r - lo) // copies`` at
    ``offset + length * ((r - lo) % copies)``. Every step uses up a length or an open gap, so the plan is
    bounded by the capacity, whatever the counts are.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in lengths.items():
        if not 0 < n <= capacity:
            raise ValueError(f"a piece of {n} tokens in sequences of {capacity}")
        counts[n] += c
    done: list[tuple[list[tuple[int, int]], int]] = []  # ([(length, copies)], sequences)
    residual: dict[int, int] = {}
    for n in range(capacity, 0, -1):
        while counts[n]:
            counts[n] -= 1
            fill = exact_fill(counts, capacity - n) if n < capacity else ()
            counts[n] += 1
            if fill is None:
                residual[n] = int(counts[n])
                counts[n] = 0
                break
            use = defaultdict(int)
            for x in (n, *fill):
                use[x] += 1
            m = min(int(counts[x]) // k for x, k in use.items())
            for x, k in use.items():
                counts[x] -= k * m
            done.append((sorted(use.items(), reverse=True), m))
    gaps: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    for n, left in sorted(residual.items(), reverse=True):
        while left:
            gap = min((g for g, bins in gaps.items() if g >= n and bins), default=None)
            if gap is None:
                k = min(capacity // n, left)
                m = left // k
                gaps[capacity - k * n].append(([(n, k)], m))
                left -= k * m
                continue
            made, m = gaps[gap].pop()
            if left < m:
                gaps[gap].append((made, m - left))
                m = left
            k = min(gap // n, left // m)
            gaps[gap - k * n].append(([*made, (n, k)], m))
            left -= k * m
    done += [x for bins in gaps.values() for x in bins]
    rows, rank, base = [], defaultdict(int), 0
    for made, m in done:
        at = 0
        for n, k in made:
            rows.append((n, rank[n], rank[n] + k * m, k, base, at))
            rank[n] += k * m
            at += n * k
        base += m
    return rows


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Adds ``rank``, from 0 among the pieces of a length. No task sees more of a length than its bucket of it."""
    cols = pieces.columns
    dealt = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    own = F.row_number().over(Window.partitionBy("_b", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    sizes = dealt.groupBy("_b", "length").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_b", "length", before.alias("_start"))
    return dealt.withColumn("_own", own).join(starts, ["_b", "length"]).select(*cols, (F.col("_own") + F.col("_start")).alias("rank"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have doc_id, piece, length and ids_crc32.

    ``pieces`` is read more than once, so give a stored table. Only the histogram of lengths, at most
    ``capacity`` rows, comes to the driver.
    """
    hist = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = np.asarray(sorted(plan_packing(hist, capacity)), np.int64).reshape(-1, 6)
    buckets = max(1, -(-sum(hist.values()) // BUCKET_ROWS))
    df, names = ranked(pieces, buckets), pieces.columns
    key = plan[:, 0] * (1 << 40) + plan[:, 1] if sum(hist.values()) < 1 << 40 else None

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            if key is not None:
                row = plan[np.searchsorted(key, n * (1 << 40) + rank, "right") - 1]
            else:
                lo, hi = np.searchsorted(plan[:, 0], n), np.searchsorted(plan[:, 0], n, "right")
                row = plan[[a + int(np.searchsorted(plan[a:b, 1], r, "right")) - 1 for a, b, r in zip(lo, hi, rank, strict=True)]]
            step = rank - row[:, 1]
            out = {c: batch.column(c) for c in names}
            out["sequence_id"] = pa.array(row[:, 4] + step // row[:, 3])
            out["offset"] = pa.array(row[:, 5] + n * (step % row[:, 3]))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return packed(df.mapInArrow(place, f"{fields}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise and pack ``docs`` (doc_id, text); with ``keep_ids`` the rows also hold the ids of each piece."""
    return pack(materialise(tokenise(docs, tokenizer, capacity, keep_ids), "pieces"), capacity)
