"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give it away.

Emails, IP addresses, card and phone numbers are found by pattern in whole texts. Each value is a protected entity, and so is the class that it
belongs to, which pools values that are seen once: an email's domain, the first part of an address, the first two digits of a card or
a phone number. How much a term t tells of an entity e is estimated from the corpus: with N distinct
texts, c(e) and c(t) of which hold either and c(e, t) of which hold both, e has the information IC(e) = -log2 p(e), p(e) = c(e) / N, and t reveals the share

    log2(p(e | t) / p(e)) / IC(e),    p(e | t) = (c(e, t) + PRIOR p(e)) / (c(t) + PRIOR)

of it: near 1 if t occurs only where e does, and shrunk towards nothing where little is seen. Terms that reveal ``REMOVE`` or more are
removed, those that reveal ``GENERALISE`` or more are generalised to the class of their form (a name, an acronym, a word).
A pair counts if ``SUPPORT`` texts hold it, in two different surroundings of the entity at least.

All four counts have one unit, the distinct text, so copies of documents change none. A mention of a term meets the entities before and after it at
any distance, and all within ``CONTEXT_CHARS`` of it, which is linear in the text; if one of them is revealed, every mention of the term in the
text is hidden.

Only slots of hash tables of fixed size come to the driver, to pick the entities and pairs that are counted or spelled out; a slot
shared by chance costs a few rows more and changes no result.

Defined results: a null text is empty and has no spans; repeated rows get the same spans each; a null id is kept; very long texts, runs of digits
and lists of addresses take time in proportion to their length; of equal starts the base span comes first; an empty table gives no rows; extra columns are
ignored, or kept by ``sanitise``. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import dimension_join, materialise, slices

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT_CHARS = 80
SUPPORT = 3
#: Texts without the entity's mark that each term is taken to have been seen in besides, at the entity's base rate.
PRIOR = 8.0
GENERALISE, REMOVE = 0.6, 0.85
SLOTS = 1 << 20
ANY = ""

#: The parts of the patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins at the first digit of a run and takes whole runs, so nothing is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def emails(text: str):
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` from its at signs: the local part is the longest run before one."""
    at, free = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, sorted. Matches that fail their check are dropped and not tried again."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str]]:
    """The protected value of each base span, and its class."""
    out = []
    for a, k, b in spans:
        kind = KINDS[k]
        if k == 0:
            value = text[a:b].lower()
            pooled = value[value.rindex("@") :]
        elif k == 1:
            value = text[a:b]
            pooled = value[: value.index(".") + 1]
        else:
            value = re.sub(r"[^0-9]", "", text[a:b])
            pooled = value[:2] + "*"
        out.append((f"{kind}:{value}", f"{kind}:{pooled}"))
    return out


def mentions(text: str, spans: list[tuple[int, int, int]], chars: int = CONTEXT_CHARS):
    """(term, start, end, numbers of the spans that it meets) of each term outside the base spans."""
    starts = [a for a, _, _ in spans]
    ends = list(starts)  # the furthest end so far, as spans of different kinds may overlap
    far = 0
    for i, (_, _, b) in enumerate(spans):
        far = ends[i] = max(far, b)
    for m in _TERM.finditer(text):
        s, e = m.span()
        i = bisect_left(starts, e)  # the first span that begins at the term's end or later
        if i and ends[i - 1] > s:
            continue
        lo, hi = i - 1, i + 1
        while lo > 0 and ends[lo - 1] >= s - chars:
            lo -= 1
        while hi < len(spans) and starts[hi] <= e + chars:
            hi += 1
        yield m.group().lower(), s, e, range(max(lo, 0), min(hi, len(spans)))


def surroundings(text: str, span: tuple[int, int, int], chars: int = CONTEXT_CHARS) -> int:
    a, _, b = span
    near = f"{text[max(0, a - chars) : a]}\0{text[b : b + chars]}"
    return int.from_bytes(hashlib.blake2b(near.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_SPAN = "struct<start:int,kind:int,end:int>"
_FOUND = f"doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<{_SPAN}>, entities array<string>"


def _find(batches):
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in slices(batches):
        counts, digests, bases, entities = [[], [], [], []], [], [], []
        for text in batch.column("text").to_pylist():
            spans = find_base(text) if text else []
            for k in range(4):
                counts[k].append(sum(s[1] == k for s in spans))
            digests.append(hashlib.sha256(spelled(spans).encode()).hexdigest() if spans else nothing)
            bases.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            entities.append(sorted({e for pair in entities_of(text, spans) for e in pair}) if spans else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(bases, span), pa.array(entities, pa.list_(pa.string()))],
            ["doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities"],
        )


def slot_of(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % SLOTS


def _pair_key(entity: str, term: str) -> str:
    return f"{entity}\0{term}"


class Slots:
    """A set of slots as bits, to be shipped to workers; its size is fixed."""

    def __init__(self, slots: list[int]):
        marks = np.zeros(SLOTS, bool)
        marks[slots] = True
        self.bits = np.packbits(marks).tobytes()

    def __contains__(self, key: str) -> bool:
        s = slot_of(key)
        return bool(self.bits[s >> 3] >> (7 - (s & 7)) & 1)


def _slots(df: DataFrame, key: Column):
    """The slots of ``key`` as a broadcast, ``SLOTS`` rows of the driver at most; None without any."""
    slot = F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(SLOTS)).cast("int")
    found = [r.s for r in df.select(slot.alias("s")).distinct().collect()]
    return df.sparkSession.sparkContext.broadcast(Slots(found)) if found else None


def _counted(tally: Counter, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*[(*k, n) for k, n in tally.items()], strict=True)) if tally else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(term, df): how many distinct texts of ``rows`` (text, copies) hold each term."""
    names, kinds = ["term", "copies", "n"], [pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        seen = Counter()
        for part in slices(batches):
            for text, copies in zip(part.column("text").to_pylist(), part.column("copies").to_pylist(), strict=True):
                seen.update((t, copies) for t in {t.lower() for t in set(_TERM.findall(text or ""))})
            if len(seen) > 100_000:
                yield _counted(seen, names, kinds)
                seen.clear()
        yield _counted(seen, names, kinds)

    found = rows.select("text", "copies").mapInArrow(run, "term string, copies long, n long")
    return _texts(found, ["term"], "df")


def _texts(counted: DataFrame, keys: list[str], name: str, *more: Column) -> DataFrame:
    """Distinct texts by ``keys``: rows of a text that there are ``copies`` of count 1 / copies, and whole texts only ever add up."""
    once = counted.groupBy(*keys, "copies").agg(F.sum("n").alias("n"), *more)
    kept = [F.min("lo").alias("lo"), F.max("hi").alias("hi")] if more else []
    return once.groupBy(*keys).agg(F.sum(F.expr("n div copies")).alias(name), *kept)


def entity_pairs(rows: DataFrame, slots) -> DataFrame:
    """(entity, term, c_et, lo, hi) of entities of one of the ``slots`` in ``rows`` (text, copies); lo and hi are the least and largest hash of the entity's surroundings.

    The entity ``ANY`` stands for all of them: it counts the texts in which a term meets one.
    """

    def run(batches):
        wanted = slots.value
        for batch in slices(batches, 128):
            tally: dict[tuple[str, str, int], list[int]] = {}
            for text, copies in zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                spans = find_base(text) if text else []
                known = [[e for e in both if e in wanted] for both in entities_of(text, spans)] if spans else []
                if not any(known):
                    continue
                near: dict[str, int] = {}
                for span, own in zip(spans, known, strict=True):
                    for e in own:
                        if e not in near:
                            near[e] = surroundings(text, span)
                found = {(e, t) for t, _, _, met in mentions(text, spans) for i in met for e in known[i]}
                near[ANY] = 0
                for e, t in found | {(ANY, t) for _, t in found}:
                    have = tally.setdefault((e, t, copies), [0, near[e], near[e]])
                    have[0] += 1
                    have[1], have[2] = min(have[1], near[e]), max(have[2], near[e])
            cols = list(zip(*[(*k, *v) for k, v in tally.items()], strict=True)) if tally else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), *[pa.int64()] * 4], strict=True)], ["entity", "term", "copies", "n", "lo", "hi"])

    found = rows.select("text", "copies").mapInArrow(run, "entity string, term string, copies long, n long, lo long, hi long")
    return _texts(found, ["entity", "term"], "c_et", F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def share_column(n: int, df: str = "df") -> Column:
    """The share of an entity's information that a term reveals, from c_e, c_et and ``df`` among ``n`` texts. A smaller ``df`` gives no smaller share."""
    p = F.col("c_e") / F.lit(float(max(n, 2)))
    told = (F.col("c_et") + PRIOR * p) / (F.greatest(df, "c_et") + PRIOR)
    return F.when(p < 1, F.log2(told / p) / -F.log2(p))


def rules(rows: DataFrame, found: DataFrame, n: int, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame | None:
    """(entity, term, share): the terms that reveal ``generalise`` or more of an entity; None if no entity or pair has support. ``rows``: text, copies; ``found``: entities, copies; ``n`` distinct texts."""
    held = found.where(F.size("entities") > 0).select("copies", F.explode("entities").alias("entity"))
    single = _texts(held.withColumn("n", F.lit(1)), ["entity"], "c_e").where(F.col("c_e") >= support)
    single = materialise(single, "entities")  # no pair has more support than its entity
    wanted = _slots(single, F.col("entity"))
    if wanted is None:
        return None
    pairs = materialise(entity_pairs(rows, wanted).where((F.col("c_et") >= support) & ((F.col("entity") == ANY) | (F.col("lo") < F.col("hi")))), "pairs")
    least = pairs.where(F.col("entity") == ANY).select("term", F.col("c_et").alias("c_any"))
    joint = pairs.where(F.col("entity") != ANY).select("entity", "term", "c_et").join(single, "entity").join(least, "term")
    # a term is in no fewer texts than those in which it meets an entity: most pairs need no further count
    joint = materialise(joint.where(share_column(n, "c_any") >= generalise).select("entity", "term", "c_et", "c_e"), "candidates")
    if joint.isEmpty():
        return None
    # of every term, so that this grows with the texts and not with the number of pairs in question
    counted = joint.join(document_frequencies(rows), "term").withColumn("share", share_column(n))
    return materialise(counted.where(F.col("share") >= generalise).select("entity", "term", "share"), "rules")


def hidden_mentions(rows: DataFrame, told: DataFrame, remove: float = REMOVE) -> DataFrame:
    """(text_hash, terms) of the texts with terms to be hidden by the rules ``told``."""
    slots = _slots(told, F.concat("entity", F.lit("\0"), "term"))
    if slots is None:
        return rows.sparkSession.createDataFrame([], "text_hash long, terms array<struct<start:int,kind:int,end:int,removed:boolean>>")

    def run(batches):
        wanted, names = slots.value, ["text_hash", "entity", "term", "starts", "ends"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in slices(batches, 128):
            out = []
            for text, key in zip(batch.column("text").to_pylist(), batch.column("text_hash").to_pylist(), strict=True):
                spans = find_base(text) if text else []
                if not spans:
                    continue
                known, places, met = entities_of(text, spans), {}, {}
                for t, s, e, near in mentions(text, spans):
                    places.setdefault(t, []).append((s, e))
                    met.setdefault(t, set()).update(e for i in near for e in known[i])
                for t, es in met.items():
                    good = [e for e in es if _pair_key(e, t) in wanted]
                    if good:
                        a, b = zip(*places[t], strict=True)
                        out += [(key, e, t, a, b) for e in good]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names)

    found = rows.select("text", "text_hash").mapInArrow(run, "text_hash long, entity string, term string, starts array<int>, ends array<int>")
    hit = dimension_join(found, told, ["entity", "term"], "inner", F.col("text_hash"))
    once = hit.groupBy("text_hash", "term").agg(F.max("share").alias("share"), F.min(F.struct("starts", "ends")).alias("at"))
    spans = F.zip_with("at.starts", "at.ends", lambda a, b: F.struct(a.alias("start"), F.lit(4).alias("kind"), b.alias("end"), (F.col("share") >= remove).alias("removed")))
    return materialise(once.groupBy("text_hash").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("terms")), "terms")


def analyse(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame | None]:
    """The base spans of every row of ``docs`` (doc_id, text), and (text_hash, terms) of the texts with terms to be hidden, None without any.

    ``terms`` is an array of (start, kind, end, removed), sorted. Rows of one text share it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    found = materialise(rows.mapInArrow(_find, _FOUND), "spans")
    copies = materialise(found.groupBy("text_hash").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")

    def with_copies(df: DataFrame) -> DataFrame:
        joined = dimension_join(df, copies, ["text_hash"], "left", F.col("doc_id"))
        return joined.withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))

    n = found.count() - (copies.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    told = rules(with_copies(rows), with_copies(found.select("doc_id", "text_hash", "entities")), n, support, generalise)
    return found, None if told is None else hidden_mentions(rows, told, remove)


def spelled_column(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(name[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _with_terms(rows: DataFrame, terms: DataFrame | None, key: str) -> DataFrame:
    """``rows`` with the ``terms`` of their text, whose hash is the column ``key``, as ``__pii_terms``."""
    if terms is None:
        return rows.withColumn("__pii_terms", F.lit(None).cast("array<struct<start:int,kind:int,end:int,removed:boolean>>"))
    named = terms.select(F.col("text_hash").alias(key), F.col("terms").alias("__pii_terms"))
    return dimension_join(rows, named, [key], "left", F.col("doc_id"), F.size("__pii_terms"))


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``."""
    found, terms = analyse(docs, **options)
    joined = _with_terms(found.drop("entities"), terms, "text_hash")
    added = F.coalesce(F.transform("__pii_terms", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))), F.array().cast(f"array<{_SPAN}>"))
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spelled_column(F.concat("base", added)).alias("spans"))


def mask(text: str, hidden: list[tuple[int, int, str]]) -> str:
    """``text`` with each (start, end, replacement) put in; of overlapping spans the first, and of those with one start the longest, gives the replacement, and the others' rest goes too."""
    out, at = [], 0
    for a, b, new in sorted(hidden, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], new]
        at = max(at, b)
    return "".join(out) + text[at:]


def form_class(term: str) -> str:
    """The class that a generalised term is replaced by."""
    return "[ACRONYM]" if term.isupper() else "[NAME]" if term[:1].isupper() else "[WORD]"


def clean_text(text: str, terms: list[tuple[int, int, bool]]) -> str:
    """``text`` with its base spans as their kinds and its ``terms`` (start, end, removed) hidden; what becomes personal data by that, as digits that a removed term kept apart, is replaced too."""
    hidden = [(a, b, "" if removed else form_class(text[a:b])) for a, b, removed in terms]
    while True:
        hidden += [(a, b, f"[{KINDS[k].upper()}]") for a, k, b in find_base(text)]
        if not hidden:
            return text
        text, hidden = mask(text, hidden), []


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with base spans replaced by their kind, as ``[EMAIL]``, generalised terms by the class of their form, as ``[NAME]``, and removed terms gone. ``n_chars``, if there, follows the text."""
    _, terms = analyse(docs, **options)
    joined = _with_terms(docs.withColumn("__pii_hash", F.xxhash64("text")), terms, "__pii_hash").select(*docs.columns, "__pii_terms")
    names, schema = docs.columns, docs.schema
    has_length = "n_chars" in names

    def run(batches):
        for batch in slices(batches):
            texts = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("__pii_terms").to_pylist(), strict=True):
                texts.append(clean_text(text, [(s["start"], s["end"], s["removed"]) for s in found or ()]) if text else text)
            cols = {c: batch.column(c) for c in names}
            cols["text"] = pa.array(texts, pa.string())
            if has_length:
                kind = cols["n_chars"].type
                cols["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, cols["n_chars"].to_pylist(), strict=True)], kind)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return joined.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
