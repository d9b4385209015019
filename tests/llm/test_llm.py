"""The operators on small tables, against brute-force versions, round trips and held-out labels."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import chat, common, components, decontamination, packing, pii, quality, queries, sharding, shingles, simhash, substrings, topk, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = r"[^\x20\x09-\x0D]+"


def docs_of(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCS)


def clashing(df):
    """The same rows with more columns, named as the operators name theirs."""
    return df.withColumns({c: F.lit(1) for c in ("fp", "g", "p", "rank", "toks", "mask", "key", "terms", "component_id", "toxic_score", "_id", "length", "sequence_id", "slot", "mentions")})


EDGE_TEXTS = [None, "", " \t\n", "a", "a b", "same text here for all of them", "same text here for all of them", "é" * 3000, "x " * 30_000]


# --- packing


def brute_pieces(texts, capacity):
    tok = packing.WordCache(queries.word_tokenizer()).tokenizer
    out = []
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((i, k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_packing(spark, extra):
    texts = [*EDGE_TEXTS, "don't 12'ts, co''ll!! \x1cq", "İ! ΣΑΣ. naïve, ÉTÉ", "a<|endoftext|>b"]
    df = docs_of(spark, texts)
    rows = packing.pack_documents(clashing(df) if extra else df, queries.word_tokenizer(), 64).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(brute_pieces(texts, 64))
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(seqs) == -(-sum(r.length for r in rows) // 64)
    kept = packing.pack_documents(df, queries.word_tokenizer(), 64, keep_ids=True).where("doc_id = 5").first()
    assert len(kept.ids) == kept.length and kept.ids[-1] == 0


def test_packing_empty_table(spark):
    assert packing.pack_documents(docs_of(spark, []), queries.word_tokenizer()).count() == 0


def test_plans_hold_every_piece():
    rng = random.Random(5)
    for capacity in (1, 2, 7, 16, 64):
        for _ in range(30):
            lengths = {n: rng.randint(1, 40) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 9)))}
            fill, seen = {}, {}
            for n, lo, hi, k, base, at in packing.plan_packing(lengths, capacity):
                for r in range(lo, hi):
                    s = base + (r - lo) // k
                    o = at + n * ((r - lo) % k)
                    fill.setdefault(s, []).append((o, n))
                    seen.setdefault(n, set()).add(r)
            assert {n: len(x) for n, x in seen.items()} == lengths and all(x == set(range(len(x))) for x in seen.values())
            for parts in fill.values():
                assert [o for o, _ in sorted(parts)] == list(itertools.accumulate([0, *[n for _, n in sorted(parts)]]))[:-1] and sum(n for _, n in parts) <= capacity
    for _ in range(400):  # a single, pair or triple is found whenever there is one
        capacity = rng.randint(3, 30)
        counts = np.zeros(capacity + 1, np.int64)
        for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 6))):
            counts[n] = rng.randint(1, 3)
        pool = [n for n, c in enumerate(counts.tolist()) for _ in range(c)]
        possible = any(sum(x) == capacity for k in (1, 2, 3) for x in itertools.combinations(pool, k))
        got = packing.exact_fill(counts, capacity)
        assert (got is not None) == possible
        assert got is None or (sum(got) == capacity and all(got.count(x) <= counts[x] for x in got))
    assert sorted(packing.exact_fill(np.asarray([0, 0, 1, 1, 1, 1, *[0] * 7]), 12)) == [3, 4, 5]
    exact = packing.plan_packing({60: 5, 4: 3, 3: 2, 1: 2}, 64)
    assert max(r[4] + (r[2] - r[1] - 1) // r[3] for r in exact) == 4  # singles and pairs fill the gaps
    with pytest.raises(ValueError):
        packing.plan_packing({65: 1}, 64)


def test_word_cache_only_where_the_tokenizer_allows_it(spark):
    import public_tokenizers

    assert packing.WordCache(queries.word_tokenizer()).splits
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing.WordCache(other).splits
    texts = ["Cased TEXT,  with   blanks", "x\ny"]
    rows = packing.tokenise(docs_of(spark, texts), other, keep_ids=True).collect()
    tok = packing.WordCache(other).tokenizer
    assert {r.doc_id: r.ids for r in rows} == {i: tok.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}


def test_word_cache_generations(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    cache = packing.WordCache(queries.word_tokenizer())
    texts = [" ".join(f"word{i} w{i % 3}" for i in range(j, j + 9)) for j in range(20)]
    assert cache.ids(texts) == cache.encode(texts)


# --- classifiers


def labelled(spark, n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 60))]
        toxic, good = i % 4 == 0, i % 3 > 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["zzmoron", "zzscum", "zzidiot"])
        text = " ".join(words)
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("run, label, cut", [(toxicity.toxicity, "toxic", 0.3), (quality.quality, "quality", 0.7)])
def test_classifiers(spark, run, label, cut):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    rows = run(docs, labels).collect()
    assert len(rows) == 400
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 60 and sum(r.predicted == truth[r.doc_id] for r in out) >= 0.95 * len(out)


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_classifier_edges(spark, run):
    docs, labels = labelled(spark, 60)
    rows = run(clashing(docs_of(spark, EDGE_TEXTS, [None, *range(1, len(EDGE_TEXTS))])), labels).collect()
    assert len(rows) == len(EDGE_TEXTS) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[5].score == by[6].score and by[None].held_out is False
    none = run(docs, labels.limit(0)).collect()
    assert len(none) == 60 and {r.score for r in none} == {0.5}
    assert run(docs.limit(0), labels).count() == 0
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 1)], labels.schema))
    assert run(docs, odd).count() == 60


@pytest.mark.parametrize("run, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_long_texts_are_learnt_from(spark, run, label):
    docs, labels = labelled(spark, 300)
    long = docs.withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 200))
    assert long.agg(F.min(F.length("text"))).first()[0] > 12_000
    truth = {r.doc_id: r[label] for r in labels.collect()}
    rows = run(long, labels).collect()
    known = [r for r in rows if not r.held_out]
    assert len({r.score for r in rows}) > 2 and sum(r.predicted == truth[r.doc_id] for r in known) >= 0.9 * len(known)


def brute_ngrams(text):
    """The n-grams of a text in the operator's alphabet, as strings."""
    t = " " + re.sub("[\t-\r]", " ", re.sub("[A-Z]", lambda m: m.group().lower(), text)) + " "
    return {t[i : i + n] for n in toxicity.SIZES for i in range(len(t) - n + 1)} if text else set()


def test_toxicity_scores_are_sums_of_ngrams():
    rng = random.Random(4)
    texts = ["", "a", "Ab\tC", "x" * 70_000, *["".join(rng.choice("abCd \n") for _ in range(rng.randint(1, 80))) for _ in range(60)]]
    weights = np.random.default_rng(1).normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32) / 50
    model = toxicity.Model(weights, 0.25)
    bucket = {}
    for t in texts:
        grams = brute_ngrams(t)
        for g in grams:
            if g not in bucket:  # one n-gram alone: of its own text without the blanks around it
                x = np.frombuffer(g.encode("utf-32-le"), np.uint32)
                h = x[:1] * toxicity._MUL
                for c in x[1:]:
                    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + np.uint32(c) * toxicity._MUL
                mixed = (h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE3D) + np.uint32(len(g) * 0x27D4EB2F & 0xFFFFFFFF)
                bucket[g] = int(mixed[0] >> np.uint32(32 - toxicity.BUCKET_BITS))
        held = {bucket[g] for g in grams}
        assert toxicity.present(t).tolist() == sorted(held)
        assert model.score(t) == pytest.approx(1 / (1 + np.exp(-(0.25 + sum(float(weights[b]) for b in held)))), abs=1e-6)


def brute_probability(net, data):
    """The network window by window, in plain loops."""
    n, w, s, half = len(data), quality.WIDTH, quality.STRIDE, quality.CHUNK // 2
    starts = [i for i in range(0, max(n, 1), s) if i == 0 or i + (w - s) < n] if n else []
    rows = []
    for i in starts:
        part = list(data[i : i + w]) + [0] * (w - len(data[i : i + w]))
        x = np.concatenate([net.table[b] for b in part])
        rows.append([max(0.0, float(x @ net.filters[:, f]) + float(net.bias[f])) for f in range(quality.FILTERS)])
    chunks = [rows[a : a + 2 * half] for a in range(0, max(1, len(rows) - half), half)] if rows else []
    pooled = [[max(r[f] for r in c) for f in range(quality.FILTERS)] for c in chunks]
    missing = 1 - min(len(rows), quality.CHUNK) / quality.CHUNK
    z = float(net.out_bias)
    for f in range(quality.FILTERS if pooled else 0):
        col = [p[f] for p in pooled]
        for k, v in enumerate((sum(col) / len(col), max(col), min(col), max(col) * missing)):
            z += v * float(net.out[k * quality.FILTERS + f])
    return 1 / (1 + np.exp(-z))


def test_quality_equals_plain_loops():
    net = quality.fit([("abc def ghi " * 30, 1), ("QQQ!! " * 60, 0)], epochs=2)
    for n in (0, 1, 3, 4, 5, 8, 9, 100, 259, 260, 261, 400, 1500):
        data = np.frombuffer(bytes((i * 37 + i // 7) % 251 for i in range(n)), np.uint8)
        assert quality.probability(net, data) == pytest.approx(brute_probability(net, data), abs=1e-5)


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r.doc_id, r.score) for r in toxicity.toxicity(docs, labels).collect()} == {(r.doc_id, r.score) for r in toxicity.toxicity(docs, flipped).collect()}


def test_windows_cover_the_text():
    for n in range(0, 40):
        w = quality.windows(np.arange(1, n + 1, dtype=np.uint8))
        assert set(w.ravel().tolist()) - {0} == set(range(1, n + 1))
        if len(w):
            covered = {i for a, b in quality.chunk_bounds(len(w)) for i in range(a, b)}
            assert covered == set(range(len(w)))


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    net = quality.fit([("abc def ghi " * 30, 1), ("QQQ!! " * 60, 0)], epochs=1)
    data = np.frombuffer(("some text of bytes " * 40).encode(), np.uint8)
    grads, _ = quality._gradients(net, quality.windows(data), 1.0, 1.0)
    loss = lambda: -np.log(quality.probability(net, data))
    for p, g in zip(net.parameters()[1:], grads[1:], strict=True):
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in p.shape)
            old = p[at].copy()
            p[at] = old + 2e-3
            up = loss()
            p[at] = old - 2e-3
            down = loss()
            p[at] = old
            assert (up - down) / 4e-3 == pytest.approx(float(g[at]), abs=2e-2)


# --- top-k


def brute_topk(rows, every, k):
    ok = [(i, [int(np.floor(256 * x)) for x in np.asarray(v, np.float64)]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(3)
    for dim in (1, 3, 16, 64):
        rows = [(i, (rng.normal(size=dim) * (10 if i % 7 == 0 else 1)).astype(np.float32).tolist()) for i in range(150)]
        rows += [(200 + i, rows[4][1]) for i in range(9)]  # ties
        rows += [(300, None), (310, [None] * dim), (320, [float("nan")] * dim), (330, [float("inf")] * dim), (340, []), (None, rows[0][1]), (350, [1.0] * (dim + 1)), (360, [0.0] * dim)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
        asked = df.where("vec_id % 10 = 0")
        want = brute_topk(rows, 10, 5)
        assert sorted(tuple(r) for r in topk.top_k(df, asked).collect()) == want
        assert sorted(tuple(r) for r in topk.top_k(df, asked, wave=4).collect()) == want
    assert topk.top_k(df.limit(0), asked.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [3e6, -1.5]), (1, [2e6, 7.25]), (2, [-3e6, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(big, big).collect()) == brute_topk([tuple(r) for r in big.collect()], 1, 5)


def test_topk_prunes_by_bounds():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(20, 64)) * 300
    x = np.floor(np.repeat(centre, 50, 0) + rng.normal(size=(1000, 64)) * 5)
    s = topk.Statistics(np.arange(1000), x)
    floor, counts = np.full(20, -np.inf), [0] * (len(s.levels) + 1)
    q = topk.Statistics(np.arange(0, 1000, 50), x[::50])
    topk.search(q, s, floor, 5)
    topk.search(q, s, floor, 5, counts)
    assert counts[-1] < 0.2 * 20_000 and counts == sorted(counts, reverse=True)


# --- repeated passages


def brute_repeats(texts, ids):
    first, out = {}, []
    seqs = [re.findall(WORDS, t or "") for t in texts]
    for i, w in zip(ids, seqs, strict=True):
        if i is not None:
            for s in range(len(w) - 49):
                k = tuple(w[s : s + 50])
                first[k] = min(first.get(k, i), i)
    for i, w in zip(ids, seqs, strict=True):
        gone = [False] * len(w)
        if i is not None:
            for s in range(len(w) - 49):
                if first[tuple(w[s : s + 50])] < i:
                    gone[s : s + 50] = [True] * 50
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def repeated_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 75, 120)]
    texts = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 90))]
        if i % 3:
            w += rng.choice(shared)
        w += [word() for _ in range(rng.randint(0, 40))]
        texts.append((" \t".join(w) + "\n") if i % 2 else "  ".join(w))
    return [*texts, texts[1], "  ".join(shared[4]), "la " * 400, "la " * 300, None, "", "\x0b \x0c"]


@pytest.mark.parametrize("group_bytes, part_bytes, segment_bytes", [(1 << 21, 1 << 24, 1 << 19), (700, 2000, 300), (100, 500, 60), (3000, 1 << 24, 1)])
def test_repeats(spark, group_bytes, part_bytes, segment_bytes):
    texts = repeated_texts()
    ids = random.Random(1).sample(range(1000), len(texts))
    got = substrings.remove_repeats(docs_of(spark, texts, ids), keep_text=True, group_bytes=group_bytes, part_bytes=part_bytes, segment_bytes=segment_bytes).collect()
    want = brute_repeats(texts, ids)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == want
    assert sum(w[2] for w in want) > 500
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_edges(spark):
    long = " ".join(f"w{i}" for i in range(70))
    texts, ids = [long, long, long, long, None, "a"], [5, 5, None, 3, 3, None]
    for size in (500, 20):
        got = substrings.remove_repeats(clashing(docs_of(spark, texts, ids)), group_bytes=200, segment_bytes=size).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_repeats(texts, ids)
    assert substrings.remove_repeats(docs_of(spark, [])).count() == 0


def test_unequal_windows_are_not_repeats(spark):
    """Words whose polynomial hashes modulo 2 ** 64 are equal for every base."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rest = " ".join(f"w{i}" for i in range(49))
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs_of(spark, [f"{rest} {a}", f"{rest} {b}", f"{rest} {b}"], [1, 2, 3])).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_window_hashes_tell_order_and_place():
    h = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for width in (1, 2, 3, 25, 50):
        whole = substrings.window_hashes(h, width)
        assert len(whole) == 200 - width and len(set(whole.tolist())) == len(whole)
        assert all(substrings.window_hashes(h[i : i + width], width)[0] == whole[i] for i in (0, 7, len(whole) - 1))
        if width > 1:
            assert substrings.window_hashes(h[width - 1 :: -1].copy(), width)[0] != whole[0]


def test_segments_hold_every_word_once():
    words = [f"w{i}".encode() for i in range(700)]
    raw = b"  ".join(words) + b"\n"
    for most in (1, 40, 400, 100_000):
        seen = []
        for lo, hi, text in substrings.segments(raw, most):
            own = text.split()
            at = len(seen)
            seen += own[lo:hi]
            assert own == words[max(0, at - 49) : len(seen) + 49]
        assert seen == words
    assert [x[:2] for x in substrings.segments(b"", 10)] == [(0, 0)]


# --- personal data


def brute_spans(text):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub(r"\D", "", m.group())
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m.group().split("."))) or (k == 2 and 14 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(8)
    parts = ["a@b.cd", "a@b", "x.y+z@w-1.q.r", "@@", "1.2.3.4", "256.1.1.1", "01.02.3.004.5", "4539 1488 0343 6467", "4539148803436467", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "+999999999999999999", " ", ".", "-", "é", "7", "%a@b.c.", "a@b@c.d"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))
        assert pii.find_base(text) == brute_spans(text), text
    assert pii.find_base("1" * 5000 + "@" * 3000 + "a" * 3000) == []
    for hard in ("1" * 1_000_000, "1." * 300_000, "+1 (" * 200_000, "9 " * 300_000, "a@" * 300_000):
        began = time.perf_counter()
        pii.find_base(hard)
        assert time.perf_counter() - began < 5
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")


def disclosing(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(200):
        text = " ".join(word() for _ in range(12)) + " common "
        if i % 10 == 0:
            text += f"{word()} Zaphod {word()} mail zb@mail.example.com {word()} common {word()}"
        rows.append(text)
    return rows, docs_of(spark, rows)


def test_disclosing_terms(spark):
    texts, df = disclosing(spark)
    for r in pii.personal_data(df).collect():
        terms = [s.split(":") for s in r.spans.split(",") if s.startswith("term")]
        found = [texts[r.doc_id][int(a) : int(b)] for _, a, b in terms]
        assert found == (["Zaphod", "mail"] if r.doc_id % 10 == 0 else [])
        assert r.n_email == int(r.doc_id % 10 == 0)
    clean = pii.sanitise(df).collect()
    assert all("Zaphod" not in r.text and "@" not in r.text and r.n_chars == len(r.text) for r in clean)
    assert all(r.text == texts[r.doc_id] for r in clean if r.doc_id % 10)
    # five copies of each document change nothing
    five = docs_of(spark, texts * 5)
    assert {(r.doc_id % 200, r.spans) for r in pii.personal_data(five).collect()} == {(r.doc_id, r.spans) for r in pii.personal_data(df).collect()}
    # copies of one document are one piece of evidence
    copies = docs_of(spark, [texts[0]] * 30 + [t for t in texts if "@" not in t])
    assert not any("term" in r.spans for r in pii.personal_data(copies).collect())


def brute_shares(texts, support=3):
    """{(entity, term): share} by the definition, in plain loops over the distinct texts."""
    texts = sorted(set(texts))
    with_entity, with_term, with_both, near = {}, {}, {}, {}
    for k, text in enumerate(texts):
        spans = brute_spans(text)
        keys = []
        for a, kind, b in spans:
            v = text[a:b].lower() if kind == 0 else text[a:b] if kind == 1 else re.sub(r"\D", "", text[a:b])
            pool = v[v.rindex("@") :] if kind == 0 else v[: v.index(".") + 1] if kind == 1 else v[:2] + "*"
            keys.append([f"{pii.KINDS[kind]}:{x}" for x in (v, pool)])
        for (a, _, b), own in zip(reversed(spans), reversed(keys), strict=True):
            for e in own:
                with_entity.setdefault(e, set()).add(k)
                near[e, k] = text[max(0, a - 80) : a], text[b : b + 80]
        for m in re.finditer(r"[^\W\d_]{3,}", text):
            t, s, z = m.group().lower(), *m.span()
            with_term.setdefault(t, set()).add(k)
            if any(s < b and z > a for a, _, b in spans):
                continue
            before = [i for i, x in enumerate(spans) if x[2] <= s]
            after = [i for i, x in enumerate(spans) if x[0] >= z]
            met = {*before[-1:], *after[:1], *(i for i in before if spans[i][2] >= s - 80), *(i for i in after if spans[i][0] <= z + 80)}
            for e in {e for i in met for e in keys[i]}:
                with_both.setdefault((e, t), set()).add(k)
    out = {}
    for (e, t), both in with_both.items():
        if len(both) >= support and len({near[e, k] for k in both}) > 1:
            p = len(with_entity[e]) / max(2, len(texts))
            told = (len(both) + pii.PRIOR * p) / (max(len(with_term[t]), len(both)) + pii.PRIOR)
            if p < 1:
                out[e, t] = float(np.log2(told / p) / -np.log2(p))
    return out


def test_shares_equal_plain_loops(spark):
    rng = random.Random(12)
    mails = [f"p{i}@mail{i % 2}.example.com" for i in range(4)] + ["10.20.3.4", "10.20.9.9", "+1 (555) 123-4567"]
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    texts = []
    for i in range(150):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            e = rng.randrange(len(mails))
            w[rng.randrange(len(w))] = f"{rng.choice(words)} secret{'abcdefg'[e]} {mails[e]}"
            w[rng.randrange(len(w))] = f"far{'abcdefg'[e]}"
        texts.append(" ".join(w))
    texts += texts[:40] * 3
    df = docs_of(spark, texts)
    want = brute_shares(texts)
    rows = df.select("text", F.xxhash64("text").alias("text_hash"), F.lit(1).cast("long").alias("copies")).dropDuplicates(["text"])
    entities = rows.withColumn("doc_id", F.lit(0).cast("long")).select("doc_id", "text", "text_hash").mapInArrow(pii._find, pii._FOUND).withColumn("copies", F.lit(1).cast("long"))
    got = {(r.entity, r.term): r.share for r in pii.rules(rows, entities, len(set(texts)), generalise=-1e9).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    # what the query hides is what the shares say
    hide = {k for k, v in want.items() if v >= pii.GENERALISE}
    assert any(t.startswith("secret") for _, t in hide)
    for r in pii.personal_data(df).collect():
        text = texts[r.doc_id]
        shown = {text[int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"}
        assert shown <= {t for _, t in hide}


def test_terms_far_from_the_entity_are_hidden(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(30)) for _ in range(60)]
    for i in range(0, 60, 6):
        texts[i] = f"{word()} Quillon {texts[i]} Quillon {' '.join(word() for _ in range(40))} a@b.example.com {word()}"
    out = {r.doc_id: r.text for r in pii.sanitise(docs_of(spark, texts)).collect()}
    assert not any("Quillon" in t for t in out.values()) and "[EMAIL]" in out[0]


def test_many_addresses_take_linear_time():
    text = " ".join(f"name{i} u{i}@h{i % 50}.example.com," for i in range(100_000))
    began = time.perf_counter()
    spans = pii.find_base(text)
    n = sum(1 for _ in pii.mentions(text, spans))
    assert len(spans) == 100_000 and n == 100_000 and time.perf_counter() - began < 20


def test_hidden_text_is_looked_at_again():
    text = "call +1 988 zz 5552485 now"
    at = text.index("zz")
    assert pii.find_base(text) == []
    assert pii.clean_text(text, [(at, at + 2, True)]) == "call [PHONE] now"
    assert pii.clean_text("Ann ANN ann a@b.cd", [(0, 3, False), (4, 7, False), (8, 11, False)]) == "[NAME] [ACRONYM] [WORD] [EMAIL]"


def test_personal_data_edges(spark):
    texts = [*EDGE_TEXTS, "é😀 me@x.yz"]
    df = clashing(docs_of(spark, texts, [None, *range(1, len(texts))]))
    rows = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert len(rows) == len(texts) and rows[None].spans == "" and rows[9].spans == "email:3:10"
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(docs_of(spark, [])).count() == 0
    out = pii.sanitise(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()}[9] == "é😀 [EMAIL]"
    assert pii.mask("abcdef", [(0, 2, "X"), (1, 3, "Y"), (0, 1, "Z")]) == "Xdef"


# --- decontamination


def brute_overlaps(texts, items):
    tok = lambda t: [w for w in re.split(WORDS.replace("[^", "["), re.sub(r"[!-/:-@\[-`{-~]+", "", (t or "").lower())) if w]
    out = set()
    for (i, t), (b, u) in itertools.product(enumerate(texts), enumerate(items)):
        w, x = tok(t), tok(u)
        if len(x) < 8:
            at = next((at for at in range(len(w) - len(x) + 1) if w[at : at + len(x)] == x), None) if x else None
            if at is not None and (len(x) >= 5 or len(w) == len(x)):
                out.add((i, b, len(x), len(x), len(x), at))
            continue
        best = None
        for at in range(-len(x) + 1, len(w)):
            same = [j for j in range(len(x)) if 0 <= at + j < len(w) and w[at + j] == x[j]]
            hit = any(all(j + m in same for m, c in enumerate(mask) if c == "1") for mask in decontamination.MASKS for j in range(len(x)))
            stretch = max(sum(j <= k < j + 13 for k in same) for j in range(len(x)))
            if hit and (len(same) >= max(8, 0.7 * len(x)) or (len(x) > 13 and stretch >= 11)):
                best = max(best or (0, 0, 0), (len(same), -at, stretch))
        if best:
            out.add((i, b, best[0], len(x), best[2], -best[1]))
    return out


def near_overlaps(texts, items):
    """The texts of ``brute_overlaps``, tried only with items that share six tokens with them."""
    words = [set((t or "").lower().split()) for t in items]
    out = set()
    for i, t in enumerate(texts):
        own = set(re.sub(r"[!-/:-@\[-`{-~]+", "", (t or "").lower()).split())
        tried = [items[b] for b, w in enumerate(words) if sum(re.sub(r"[!-/:-@\[-`{-~]+", "", x) in own for x in w) >= min(6, len(w))]
        if brute_overlaps([t], tried):
            out.add(i)
    return out


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    items = [" ".join(word() for _ in range(n)) for n in (7, 8, 15, 30, 59)] + [None, "", "la " * 20]
    texts = [None, "", "la " * 40]
    for i in range(60):
        w = (items[i % 5]).split()
        for _ in range(i % 4 * len(w) // 12):
            w[rng.randrange(len(w))] = word()
        cut = w[: len(w) * 3 // 4] if i % 7 == 0 else w
        texts.append(" ".join([*(word() for _ in range(rng.randint(0, 20))), *cut]).title() + ("." if i % 2 else "") + " ".join([""] + [word() for _ in range(rng.randint(0, 9))]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs_of(spark, texts)
    got = decontamination.overlaps(clashing(df), bench.withColumn("seed", F.lit(1))).collect()
    want = brute_overlaps(texts, items)
    assert {(r.doc_id, r.item_id, r.n_equal, r.n_tokens, r.stretch, r.doc_start) for r in got} == want and len(want) > 20
    kept = {r.doc_id for r in decontamination.decontaminate(df, bench).collect()}
    assert kept == set(range(len(texts))) - {w[0] for w in want}
    assert decontamination.decontaminate(df, bench.limit(0)).count() == len(texts) and decontamination.overlaps(df.limit(0), bench).count() == 0
    leak = texts[min(w[0] for w in want)]
    twice = docs_of(spark, [leak, leak, "clean words"], [None, None, None])
    assert [r.text for r in decontamination.decontaminate(twice, bench).collect()] == ["clean words"]


def test_short_items_and_parts_of_items(spark):
    long = [f"t{i}" for i in range(60)]
    items = ["one", "one two three four", "a b c d e f g", " ".join(long), "a b c d e f g h"]
    texts = ["One!", "one two", "one two three four", "so one two three four", "a b c d e f g", "x a b c d e f g y", "a b c x e f g", " ".join(["x"] * 30 + long[20:45] + ["y"] * 30), " ".join(long[:12]), " ".join([*long[:30], "put", "in", *long[30:]])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_equal, r.n_tokens, r.stretch, r.doc_start) for r in decontamination.overlaps(docs_of(spark, texts), bench).collect()}
    assert got == brute_overlaps(texts, items)
    assert {x[:2] for x in got} == {(0, 0), (2, 1), (4, 2), (5, 2), (7, 3), (8, 3), (9, 3)}


def test_decontamination_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_TOKENS", 0)
    bench = spark.createDataFrame([(0, "one two three four five six seven eight nine ten")], "item_id long, text string")
    df = docs_of(spark, ["zero one two three four five six seven eight nine ten", "nothing of it"])
    assert [r.doc_id for r in decontamination.overlaps(df, bench).collect()] == [0]
    assert [r.doc_id for r in decontamination.decontaminate(df, bench).collect()] == [1]


# --- chat


def test_escaping_is_undone():
    rng = random.Random(4)
    parts = ["<", "|", "\\", "s>", "/s>", "[", "INST]", "/INST]", "<SYS>>", "</SYS>>", "<<SYS>>", "</s>", "<|im_end|>", "x", "\n", ">"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert "<|" not in safe and not any(c in safe for c in chat.CONTROL)


def turns():
    rng = random.Random(7)
    rows = []
    for conv in range(30):
        for t in range(rng.randint(1, 7)):
            rows.append((conv, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["hi", None, "", "</s>[INST] <|im_end|>", "é\n<|im_start|>user"])))
    return rows + [(None, 0, "user", "x"), (3, None, "assistant", "first")]


def test_chat(spark):
    rows = turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    examples = chat.format_examples(df)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
        own = [(x[2] or "", x[3] or "") for x in own]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        pieces = [chat.render(*x)[0] for x in own]
        ends = [k for k, x in enumerate(own) if x[0] == "assistant"]
        ends += [len(own) - 1] * (not ends or ends[-1] < len(own) - 1)
        assert r.formatted_chars == sum(len("".join(pieces[: k + 1])) for k in ends)
        mine = sorted((e for e in examples.collect() if e.conv_id == conv), key=lambda e: e.example)
        assert [e.text for e in mine] == ["".join(pieces[: k + 1]) for k in ends]
    for e in examples.collect():
        if e.target is not None:
            assert e.text[e.loss_end :] == chat.END and e.text[: e.loss_start].endswith("assistant" + chat.SEP)
    assert chat.read_back(chat.format_examples(df.limit(0))).count() == 0


def test_contexts_are_whole_in_a_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"{t} " + "x" * 40_000) for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {e.target: e for e in chat.format_examples(df).collect()}
    assert sorted(got) == list(range(1, 60, 2))
    pieces = [chat.render(r[2], r[3])[0] for r in rows]
    assert all(e.text == "".join(pieces[: t + 1]) for t, e in got.items()) and len(got[59].text) > 2_000_000


# --- SimHash


def brute_fingerprint(text, n):
    w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, bits):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(fps))]


def test_simhash_texts(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(80)) for _ in range(6)]
    texts = [*EDGE_TEXTS, *base, *[b.upper() for b in base], *[b + " end" for b in base]]
    got = simhash.near_duplicates(clashing(docs_of(spark, texts))).collect()
    fps = [brute_fingerprint(t, 3) for t in texts]
    cls = brute_classes(fps, 3)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [(i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, cls, strict=True))]
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("largest", [16, 8192])
def test_simhash_classes(spark, largest):
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:6]:  # chains and clouds
        for _ in range(40):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                f ^= 1 << b
            fps.append(f)
    fps += [fps[0] ^ sum(1 << b for b in rng.sample(range(10), rng.randint(0, 5))) for _ in range(150)]
    fps = list(dict.fromkeys(fps))
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    marked = spark.createDataFrame(rows, "doc_id long, fp long").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.classes(marked, 3, largest).collect()}
    assert got == dict(enumerate(brute_classes(fps, 3)))


def test_masks_meet_the_pigeonhole():
    rng = random.Random(2)
    for bits in (0, 1, 3, 5):
        masks = simhash.key_masks(bits)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), bits):
                b ^= 1 << k
            assert any((a ^ b) & m & ((1 << 64) - 1) == 0 for m in masks)
            shared = next(m for m in masks if (a ^ b) & m & ((1 << 64) - 1) == 0)
            if bits:
                assert any((a ^ b) & m & ((1 << 64) - 1) == 0 for m in simhash.finer_masks(shared, bits))


def test_keep_one(spark):
    texts = ["same words in this text", "Same words in this text", None, "", "another thing", "another thing", "another thing", "alone here now"]
    ids = [4, 2, 9, 7, None, 8, 8, None]
    kept = simhash.keep_one(clashing(docs_of(spark, texts, ids)))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("2", texts[1]), ("7", ""), ("8", "another thing"), ("None", "alone here now")])
    assert "toxic_score" in kept.columns


def salted_broadcasts(df):
    """The salted sides that stand under a broadcast in the plan."""
    below, found = None, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        below = None if below is not None and at <= below else below
        if below is None and "BroadcastExchange" in line:
            below = at
        elif below is not None and "Generate explode" in line and "salt#" in line:
            found.append(line)
    return found


@pytest.fixture
def salted(monkeypatch):
    """What ``salted_broadcasts`` finds in the plans of the tables that are written, where nothing is small enough for ``dimension_join`` to broadcast."""
    found, write = [], common.materialise

    def spy(df, what):
        found.extend((what, line) for line in salted_broadcasts(df))
        return write(df, what)

    for module in (components, shingles, simhash):
        monkeypatch.setattr(module, "materialise", spy)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    return found


def test_simhash_does_not_broadcast_repeated_rows(spark, salted):
    texts = ["some words of a text", "Some words of a text", None, "", "another thing here", "alone here now"]
    out = simhash.near_duplicates(docs_of(spark, texts))
    assert salted + salted_broadcasts(out) == []
    assert {r.doc_id: r.component_id for r in out.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}


def five_word_sets(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_pipeline_links_five_word_shingles(spark):
    import corpus_pipeline as cp

    rng = random.Random(3)
    texts = [None, "", "two words", "Two  words", "two other words"]
    for size in (40, 180, 400):
        for _ in range(4):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(base))
            for edits in (1, 2, size // 60 + 1, size // 20):
                copy = list(base)
                for i in rng.sample(range(size), edits):
                    copy[i] = "edited"
                texts.append(" ".join(copy))
    sets = [five_word_sets(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    narrow = brute_classes([brute_fingerprint(t, 3) for t in texts], 3)
    assert any(a != b for a, b in zip(root, narrow, strict=True))
    kept = cp.drop_near_copies(spark, docs_of(spark, texts), SF)
    assert {r.doc_id for r in kept.collect()} == set(root)


def test_near_dedup_does_not_broadcast_repeated_rows(spark, salted):
    import corpus_pipeline as cp

    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(words).upper(), "alone here now", None, "", "alone here now"]
    kept = cp.drop_near_copies(spark, docs_of(spark, texts), SF)
    assert salted + salted_broadcasts(kept) == []
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4]


def test_pairs_of_a_key_meet_across_classes():
    nodes, sizes, roots = np.arange(6), np.array([10, 10, 10, 10, 10, 30]), np.array([0, 0, 2, 2, 4, 4])
    sketches = np.zeros((6, 5), np.uint64)
    cross = {(int(a), int(b)) for u, v in shingles.key_pairs(nodes, sizes, roots, sketches) for a, b in zip(u, v, strict=True)}
    assert cross == {(a, b) for a in range(5) for b in range(a + 1, 5) if roots[a] != roots[b]}
    sketches[4] = np.uint64(2**64 - 1)  # too far from all
    cross = {(int(a), int(b)) for u, v in shingles.key_pairs(nodes, sizes, roots, sketches) for a, b in zip(u, v, strict=True)}
    assert cross == {(0, 2), (0, 3), (1, 2), (1, 3)}


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_links_in_keys_join_what_all_pairs_join(spark, most):
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(6):  # groups around a base, some members just under the similarity to most others, all with one passage
        base = rng.integers(0, 1 << 62, 60)
        for edits in (0, 3, 6, 7, 9, 12):
            copy = base.copy()
            copy[rng.choice(60, edits, replace=False)] = rng.integers(0, 1 << 62, edits)
            copy[:25] = np.arange(25)
            sets.append(np.unique(copy).astype(np.uint64))
    keys, sketches = shingles.band_keys(sets)
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if both >= 0.8 * (len(a) + len(sets[j]) - both) and set(keys[i]) & set(keys[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    signed = lambda x: [int(v) for v in x.view(np.int64)]
    rows = [(k, i, len(a), i, signed(sketches[i]), signed(keys[i]), signed(a)) for i, a in enumerate(sets) for k in signed(keys[i])]
    dealt = spark.createDataFrame(rows, "key long, node long, n int, root long, sketch array<long>, keys array<long>, shingles array<long>")
    met = {(r.key, r.node) for r in shingles.meeting(dealt, 4 if most == 300 else most).collect()}
    links = shingles.links_in_keys(dealt.join(spark.createDataFrame(sorted(met), "key long, node long"), ["key", "node"]), most).collect()
    got = list(range(len(sets)))
    for u, v in links:
        lo, hi = sorted((got[u], got[v]))
        got = [lo if r == hi else r for r in got]
    assert 1 < len(set(root)) < len(sets)
    assert got == root
    assert shingles.links_in_keys(dealt.limit(0)).count() == shingles.meeting(dealt.limit(0)).count() == 0


def test_sketches_tell_similarity():
    rng = np.random.default_rng(2)
    for same, near in ((0.8, True), (0.4, False)):
        both = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
        rest = int(1000 * (1 / same - 1) / 2)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 62, rest).astype(np.uint64)])) for _ in range(2))
        _, s = shingles.band_keys([a, b])
        assert (int(np.bitwise_count(s[0] ^ s[1]).sum()) <= shingles.SKETCH_BITS) == near


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(5, 5)]
    rng.shuffle(edges)
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == root and len(got) == len(root)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- sharding


def brute_table(shards, size):
    import zlib as z

    order = {s: [(z.crc32(f"offset:{s}".encode()) + j * (z.crc32(f"skip:{s}".encode()) % (size - 1) + 1)) % size for j in range(size)] for s in shards}
    owner, left = {}, size
    while left:
        for s in sorted(shards):
            if left:
                slot = next(x for x in order[s] if x not in owner)
                owner[slot] = s
                left -= 1
    return [owner[i] for i in range(size)]


def test_lookup_table():
    names = [f"n{i}" for i in (3, 1, 2, 9, 5)]
    got = sharding.lookup_table(names, 101)
    assert [names[i] for i in got] == brute_table(names, 101)
    assert max(np.bincount(got)) - min(np.bincount(got)) <= 1
    fewer = sharding.lookup_table(names[1:], 1009)
    before = sharding.lookup_table(names, 1009)
    stay = [i for i in range(1009) if before[i] != 0]
    assert sum(names[before[i]] != names[1:][fewer[i]] for i in stay) < 0.25 * len(stay)
    heavy = np.bincount(sharding.lookup_table(["a", "b"], 1009, {"a": 1, "b": 3}))
    assert heavy[1] / heavy[0] == pytest.approx(3, rel=0.05)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 101)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_assign(spark, tmp_path):
    df = clashing(docs_of(spark, ["a"] * 500, [None, *range(499)]))
    rows = sharding.assign(df, ["x", "y", "z"], size=1009).collect()
    owner = brute_table(["x", "y", "z"], 1009)
    assert len(rows) == 500 and all(r.shard == owner[r.slot] for r in rows)
    for r in rows:
        h = xxhash.xxh64_intdigest(("" if r.doc_id is None else str(r.doc_id)).encode(), 42)
        assert r.slot == (h - (1 << 64) if h >> 63 else h) % 1009
    assert sharding.assign(df.limit(0), ["x"]).count() == 0
    sharding.write(docs_of(spark, ["t"] * 50), str(tmp_path / "s"), ["x", "y"], files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 2


def test_runs_are_whole_after_a_join(spark):
    from vellum.llm import common

    a, b = (spark.range(4000).select((F.col("id") % 50).alias("k"), F.col("id").alias(n)) for n in "xy")
    joined = a.join(b.groupBy("k").agg(F.count("*").alias("n")).where("n > 0"), "k")  # small enough to be broadcast at run time

    def run(batches):
        import pyarrow as pa

        seen = {k for x in batches for k in x.column("k").to_pylist()}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], ["k"])

    assert common.in_runs(joined, ["k"], "x").mapInArrow(run, "k long").count() == 50


# --- tables that cut lineages


def test_tables_go_to_the_shared_folder(spark):
    from vellum.llm import common

    base = spark.conf.get("spark.checkpoint.dir")
    df = common.materialise(spark.range(5).toDF("x"), "numbers")
    path = common._WRITTEN[-1]
    assert path.startswith(base) and df.count() == 5
    common.drop_tables(spark)
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(path)


# --- registered queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_keep_all_rows(spark, name):
    got = queries.QUERIES[name](spark, SF).cache()
    if name in queries.ORACLE_SQL:
        import duckdb

        db = duckdb.connect()
        for t in ("embeddings", "conversations", "documents", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.execute(queries.ORACLE_SQL[name]).fetchall()
        cols = [c[0] for c in db.execute(queries.ORACLE_SQL[name]).description]
        assert sorted(cols) == sorted(got.columns)
        assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(want)
    elif name not in ("op1_best_fit_packing", "op7_decontamination"):
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near-dedup", "decontamination", "personal data", "packing"]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    now = docs
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        now = stage(spark, now, SF).cache()
        after = {r.doc_id: r.text for r in now.collect()}
        assert now.columns == docs.columns
        if name == "toxicity":
            assert set(after) == {i for i, t in rows.items() if model.score(t) < toxicity.THRESHOLD}
        elif name == "near-dedup":
            ids = sorted(before)
            sets = [five_word_sets(before[i]) for i in ids]
            root = list(range(len(ids)))
            for i, j in itertools.combinations(range(len(ids)), 2):
                if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    lo, hi = sorted((root[i], root[j]))
                    root = [lo if r == hi else r for r in root]
            assert set(after) == {ids[r] for r in root}
        elif name == "decontamination":
            bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
            hit = near_overlaps([before[i] for i in sorted(before)], bench)
            assert set(after) == {i for k, i in enumerate(sorted(before)) if k not in hit} and hit
        else:
            assert set(after) == set(before) and not any(brute_spans(t) for t in after.values())
    out = cp.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id for r in out} == set(after)
    ran = cp.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in ran) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in out)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
