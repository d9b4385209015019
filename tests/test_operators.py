"""Operators that SQL can't express, against plain Python; and edge cases of the rest."""

import difflib
import itertools
import json
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import markdown
from vellum.operators import align, chapters, compare, corpus, images, layout, provenance, registry, routing, tables
from vellum.plans import report, structure_queries
from vellum.sources import files, runners, sinks, synthetic
from vellum.streaming import samples

EDGES = ["", " ", "a\r\nb", "x y\u000bz\x1cq", "a\xa0b", "# \n# x", r"\$5 and $x$", "é é İ", "$$a$$ $b$", "|a|\n|b|\n|c|", "```x```", "![a](b/c.png) ![](d)", "A. B! ç? É", "ﬁn “q” – −", "####  z\n## y", "{12} <!-- PAGE 3 -->\n\n\n\nq\\_r"]


def one(spark, column, values, name="t"):
    rows = [(i, v) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, f"i int, {name} string").select("i", column.alias("out")).collect()
    return [r.out for r in sorted(got, key=lambda r: r.i)]


#: What each edge text counts, by hand: lines, tokens, words, sentences, h1, h4 and deeper, display and inline math, tables, code blocks, images, bytes.
COUNTED = ("lines", "tokens", "words", "sentences_estimated", "h1", "h4_plus", "math_display", "math_inline", "tables_rough", "code_blocks", "images_referenced", "size_bytes")
COUNTS = [
    (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1),
    (2, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0, 4),
    (4, 4, 4, 0, 0, 0, 0, 0, 0, 0, 0, 9),
    (1, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0, 4),
    (2, 3, 1, 0, 2, 0, 0, 0, 0, 0, 0, 6),
    (1, 3, 3, 0, 0, 0, 0, 1, 0, 0, 0, 11),
    (1, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 9),
    (1, 2, 2, 0, 0, 0, 1, 2, 0, 0, 0, 9),
    (3, 3, 3, 0, 0, 0, 0, 0, 1, 0, 0, 11),
    (1, 1, 1, 0, 0, 0, 0, 0, 0, 1, 0, 7),
    (1, 2, 5, 0, 0, 0, 0, 0, 0, 0, 2, 20),
    (1, 4, 4, 2, 0, 0, 0, 0, 0, 0, 0, 12),
    (1, 4, 2, 0, 0, 0, 0, 0, 0, 0, 0, 20),
    (2, 4, 2, 0, 0, 1, 0, 0, 0, 0, 0, 12),
    (5, 6, 5, 0, 0, 0, 0, 0, 0, 0, 0, 28),
]


def test_metrics_of_the_edges(spark):
    rows = spark.createDataFrame(list(enumerate(EDGES)), "i int, t string").select("i", *[markdown.metrics(F.col("t"))[n].alias(n) for n in COUNTED]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == COUNTS


def test_math_hits(spark):
    texts = ["", "a = b", "1/2 and 3/4/5 x1/2 1/2y", r"\\alpha_{1} \beta", "^^ ≤α", "٣/٤"]
    assert one(spark, markdown.math_hits(F.col("t")), texts) == [0, 1, 2, 3, 4, 1]


def test_normal_forms(spark):
    assert one(spark, markdown.normalize_md(F.col("t")), ["foo {17} bar", "foo <!-- Page 99 --> bar", "![alt](deep/path/img.png)", "a\t \tb\n\n\n\nc", r"a\_b"]) == ["foo bar", "foo bar", "![alt](img.png)", "a b\n\nc", r"a\_b"]
    assert one(spark, markdown.normalize_md(F.col("t"), True), [r"a\_b \frac"]) == [r"a_b \frac"]
    twice = markdown.normalize_md(markdown.normalize_md(F.col("t")))
    assert one(spark, twice, EDGES) == one(spark, markdown.normalize_md(F.col("t")), EDGES)
    assert one(spark, markdown.fold_characters(F.col("t")), ["ﬃ “x” é"]) == ['ffi "x" é']
    assert one(spark, markdown.join_hyphenation(F.col("t")), ["well-\nknown re- use a - b"]) == ["wellknown reuse a - b"]
    want = [re.sub(r"\s+", " ", re.sub(r"\\([\\`*_{}\[\]()#+\-.!])", r"\1", unicodedata.normalize("NFC", t).lower())).strip() for t in EDGES]
    assert one(spark, markdown.normalize_for_comparison(F.col("t")), EDGES) == want


def test_similarity_keeps_order_and_heuristic(spark):
    random.seed(3)
    a = " ".join(random.choice("abc") for _ in range(300))
    pairs = [(a, "x " + a), ("x " + a, a), ("a b c", "a c"), ("", "")]
    df = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(pairs)], "i int, a string, b string")
    got = [r.s for r in df.select("i", compare.token_similarity(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert got == [difflib.SequenceMatcher(None, p.split(), q.split()).ratio() for p, q in pairs]
    plain = [r.s for r in df.select("i", compare.token_similarity(F.col("a"), F.col("b"), False).alias("s")).orderBy("i").collect()]
    assert plain[0] > 0.99
    wer = [r.s for r in spark.createDataFrame([(0, "", ""), (1, "a", ""), (2, "A b", "a  B")], "i int, a string, b string").select("i", compare.word_error_rate(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert wer == [0.0, 1.0, 0.0]


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, m = int(rng.integers(1, 6)), int(rng.integers(1, 6))
        cost = rng.integers(0, 9, (n, m)) / 8
        pairs = align.hungarian(cost)
        padded = np.ones((n, max(n, m)))
        padded[:, :m] = cost
        best = min(sum(padded[i, p[i]] for i in range(n)) for p in itertools.permutations(range(max(n, m)), n))
        assert sum(cost[i, j] for i, j in pairs) + (n - len(pairs)) == pytest.approx(best)
        path = align.warp(cost)
        assert path[0] == (0, 0) or path[0][0] == 0 or path[0][1] == 0
        assert path[-1] == (n - 1, m - 1)
        assert all(0 <= b[0] - a[0] <= 1 and 0 <= b[1] - a[1] <= 1 and a != b for a, b in itertools.pairwise(path))
    assert align.hungarian(np.zeros((0, 3))) == [] and align.warp(np.zeros((2, 0))) == []


def test_alignment_finds_a_shift(spark):
    texts = [f"page number {w} {w} {w} only here" for w in ("one", "two", "six")]
    rows = [("d", "a", i, t) for i, t in enumerate(texts)] + [("d", "b", i, t) for i, t in enumerate(["cover", *texts])]
    pages = spark.createDataFrame(rows, "doc string, side string, page long, text string")
    assert {(r.orig_page, r.render_page) for r in align.align_pages(pages, "doc").collect()} == {(0, 1), (1, 2), (2, 3)}
    with pytest.raises(ValueError):
        align.align_pages(pages, "doc", "other")


def test_table_scores(spark):
    full = "| a | b |\n|---|---|\n| 1 | 2 |\n"
    rows = [(0, full, full), (1, full, "| a | b |\n|---|---|\n| 1 | 3 |\n"), (2, full, "text"), (3, "text", full), (4, full, "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>")]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, t string, p string").select("i", tables.table_scores(F.col("t"), F.col("p")).alias("s")).collect()}
    assert got[0].teds == got[4].teds == 1.0
    assert 0 < got[1].teds < 1 and got[1].teds_struct == 1.0
    assert got[2].no_table and got[2].teds == 0 and got[3].status == "NoTableInTruth"
    spans = tables.first_table('<table><tr><td rowspan="2">x</td><td>1</td></tr><tr><td>2</td></tr></table>')
    pipe = tables.best_pipe_table(spans)
    assert pipe.split("\n") == ["| x | 1 |", "|---|---|", "| x | 2 |"]
    assert 0.5 < tables.teds(tables.first_pipe_table(pipe), spans) < 1
    wide = tables.first_table('<table><tr><td colspan="2">a</td><td rowspan="3">b</td></tr><tr><td rowspan="2">c</td><td>d</td></tr><tr><td>e</td></tr><tr><td>f</td></tr></table>')
    assert tables.best_pipe_table(wide).split("\n") == ["| a | a | b |", "|---|---|---|", "| c | d | b |", "| c | e | b |", "| f |  |  |"]
    html = spark.createDataFrame([('<p>x</p><TABLE><tr><td colspan="2">a</td></tr></TABLE>',), ("none",)], "h string")
    assert [r.o for r in html.select(tables.best_pipe_html(F.col("h")).alias("o")).collect()] == ["| a | a |\n|---|---|", None]
    assert tables.first_table("<p>none</p>") is None and tables.best_pipe_table([]) == ""


def box(a, b, c, d):
    return (float(a), float(b), float(c), float(d))


def touching(p, q, eps=1.0):
    return p[0] <= q[2] + eps and q[0] <= p[2] + eps and p[1] <= q[3] + eps and q[1] <= p[3] + eps


def test_regions_that_touch_are_one(spark):
    rng = random.Random(2)
    schema = f"page long, ord long, bbox {layout.BBOX}, label string, cmex boolean, density double, n_lines int, block_indices array<int>"
    rows = [(-1, 0, box(0, 0, 2, 2), None, False, 0.0, 2, [0]), (-1, 1, box(10, 0, 12, 2), "7", True, 10.0, 2, [10]), (-1, 2, box(1, 1, 9.5, 2), "8", False, 1.0, 2, [1])]
    for page in range(40):
        for k in range(rng.randint(1, 7)):
            x, y = rng.randint(0, 20), rng.randint(0, 20)
            rows.append((page, k, box(x, y, x + rng.randint(0, 6), y + rng.randint(0, 6)), rng.choice([None, "", f"l{k}"]), rng.random() < 0.3, rng.random(), rng.randint(1, 4), [k, k + 1]))
    got = {}
    for r in layout.merge_regions(spark.createDataFrame(rows, schema), ["page"]).collect():
        got.setdefault(r.page, []).append((r.region, tuple(r.bbox), r.label, r.block_indices, r.cmex, r.density, r.n_lines, r.merged_from, r.is_complex))
    assert got.pop(-1) == [(0, box(0, 0, 12, 2), "7", [0, 1, 10], True, 10.0, 6, 3, True)]
    for page, found in got.items():
        own = [r for r in rows if r[0] == page]
        seen = {}  # reachability by repeated relabelling
        for k in range(len(own)):
            seen[k] = k
        for _ in own:
            for i in seen:
                for j in seen:
                    if touching(own[i][2], own[j][2]):
                        seen[i] = seen[j] = min(seen[i], seen[j])
        want = []
        for root in sorted(set(seen.values())):
            c = [own[k] for k in sorted(seen) if seen[k] == root]
            hull = (min(r[2][0] for r in c), min(r[2][1] for r in c), max(r[2][2] for r in c), max(r[2][3] for r in c))
            label = next((r[3] for r in c if r[3]), None)
            big, n = any(r[4] for r in c), sum(r[6] for r in c)
            want.append((len(want), hull, label, sorted({i for r in c for i in r[7]}), big, max(r[5] for r in c), n, len(c), len(c) > 1 or (big and n >= 5)))
        assert sorted(found) == want


def text_block(text, font, b, *more, type_=0):
    return (type_, b, [([(text, 10.0, font, b), *more],)])


PROSE = text_block("this is a long line of prose that sets the margin of it all", "Times", box(50, 10, 400, 20))


def regions_of(spark, *pages):
    rows = spark.createDataFrame([(i, list(p)) for i, p in enumerate(pages)], f"page long, blocks array<{layout.BLOCK}>")
    out = {}
    for r in layout.formula_regions(rows, ["page"]).orderBy("page", "region").collect():
        out.setdefault(r.page, []).append(r)
    return out


def test_formula_detection(spark):
    number = ("(1.2)", 10.0, "Times", box(390, 50, 410, 60))
    labelled = text_block("x = y + z", "CMMI10", box(150, 50, 250, 60), number)
    thin = text_block("x = y + z", "CMMI10", box(150, 50, 170, 60))
    short = text_block("x=y", "CMMI10", box(150, 50, 250, 60))
    at_margin = text_block("x = y + z", "CMMI10", box(60, 50, 250, 60))
    image = text_block("x = y + z", "CMMI10", box(150, 50, 250, 60), type_=1)
    plain = text_block("words alone here", "Times", box(150, 50, 250, 60))
    mixed = text_block("some text", "Times", box(150, 50, 200, 60), ("x", 10.0, "CMMI10", box(200, 50, 250, 60)))
    empty = (0, box(0, 0, 1, 1), [])
    found = regions_of(spark, [PROSE, labelled], [], [PROSE], [PROSE, thin], [PROSE, short], [PROSE, at_margin], [PROSE, image], [PROSE, plain], [PROSE, mixed], [empty, PROSE, labelled])
    assert set(found) == {0, 9}
    r = found[0][0]
    assert len(found[0]) == 1 and tuple(r.bbox) == box(146, 46, 254, 64) and r.label == "1.2" and r.block_indices == [1] and not r.is_complex and r.density == 1.0 and r.n_lines == 1
    assert found[9][0].block_indices == [2]


def test_bands_grow_until_nothing_stands_in_them(spark):
    eq = text_block("x = y + z", "CMMI10", box(150, 100, 250, 110))
    beside = text_block("where", "Times", box(300, 104, 330, 116))  # in the band, makes it higher
    then = text_block("so", "Times", box(340, 112, 360, 120))  # in the higher band only
    far = text_block("far", "Times", box(340, 300, 360, 310))
    tall = text_block("tall", "Times", box(400, 101, 410, 400))  # would add more than allowed
    prose_beside = text_block("this too is a long line of prose, which no formula takes in", "Times", box(260, 100, 290, 110))
    number = text_block("(3)", "Times", box(420, 102, 440, 108))
    found = regions_of(spark, [PROSE, eq, beside, then, far, tall, prose_beside], [PROSE, then, beside, eq], [PROSE, eq, number], [PROSE, eq, text_block("w + v = u", "CMEX10", box(150, 108, 240, 130))])
    assert [(tuple(r.bbox), r.block_indices) for r in found[0]] == [(box(146, 96, 364, 124), [1, 2, 3])]
    assert [(tuple(r.bbox), r.block_indices) for r in found[1]] == [(box(146, 96, 364, 124), [1, 2, 3])]
    assert [(tuple(r.bbox), r.label, r.block_indices) for r in found[2]] == [(box(146, 96, 418, 114), "3", [1, 2])]
    assert [(r.merged_from, r.cmex, r.is_complex, r.n_lines) for r in found[3]] == [(2, True, True, 2)]


def test_region_text(spark):
    page = spark.createDataFrame([([PROSE, text_block("ﬁne bro-", "Times", box(0, 0, 1, 1)), text_block(" ", "Times", box(0, 0, 1, 1))],)], f"blocks array<{layout.BLOCK}>")
    got = page.select(layout.region_text(F.col("blocks"), F.array(F.lit(1), F.lit(2), F.lit(9), F.lit(0))).alias("t")).first().t
    assert got == "fine bro- " + PROSE[2][0][0][0][0]


def test_chapters_without_number_and_beyond_99(spark):
    toc = [(1, 0, 2, "7 Seven", 1), (1, 1, 2, "100 Hundred More", 5), (1, 2, 1, "Appendix B", 9), (1, 3, 1, "Index", 12)]
    found = {r.id: r for r in chapters.chapter_bounds(spark.createDataFrame(toc, "book_id long, ord long, level int, title string, page long"), spark.createDataFrame([(1, 20)], "book_id long, n_pages long")).collect()}
    assert {k: (r.start, r.end, r.header_re) for k, r in found.items()} == {
        "07_seven": (1, 4, r"^#+\s+7\s+\S"), "100_hundred_more": (5, 8, r"^#+\s+100\s+\S"), "app_appendix_b": (9, 11, r"^#+\s+Appendix\s+?\b"), "app_index": (12, 20, r"^#+\s+Index\s*$"),
    }
    rows = spark.createDataFrame([tuple(r) for r in found.values()], "book_id long, ord string, id string, title string, start long, `end` long, header_re string")
    text = "intro\n# 7 Seven\na\n## 100 Hundred\nb\n# Appendix B\nc\n# Index\nd\n"
    cut = {r.id: (r.start_line, r.chunk) for r in chapters.split_by_headers(spark.createDataFrame([(1, text)], "book_id long, text string"), rows).collect()}
    # the heading of an appendix without a number needs blanks before a word, as the one blank of "# Appendix B" gives
    assert cut == {"07_seven": (1, "# 7 Seven\na\n"), "100_hundred_more": (3, "## 100 Hundred\nb\n"), "app_appendix_b": (5, "# Appendix B\nc\n"), "app_index": (7, "# Index\nd\n")}


def test_comparison_equals_the_library(spark):
    rng = random.Random(6)
    vocabulary = ["the", "cat", r"a\_b", "$x$", "**b**", "end.", "| c |"]
    rows = []
    for i in range(40):
        a = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 60, 260]))]
        b = [w for w in a if rng.random() < 0.9] + [rng.choice(vocabulary)] * (i % 2)
        rows.append((i, " ".join(a), " ".join(b)))
    rows += [(40, None, "x"), (41, "same text", "same text")]
    pairs = spark.createDataFrame(rows, "doc_id long, a string, b string")
    plain = lambda t: re.sub(r"\\([\\`*_{}\[\]()#+\-.!])", r"\1", t)
    got = {r.doc_id: r for r in compare.round_trip(pairs, ["doc_id"]).collect()}
    codes, firsts = {}, {}
    for r in compare.differences(pairs, ["doc_id"]).collect():
        codes.setdefault(r.doc_id, []).append((r.pos, r.tag, r.from_tokens, r.to_tokens))
    for r in compare.first_differences(compare.differences(pairs, ["doc_id"]), ["doc_id"]).collect():
        firsts.setdefault(r.doc_id, []).append((r.rank, r.tag, r.from_text, r.to_text))
    for i, a, b in rows:
        if a is None:
            assert got[i].similarity is None and i not in codes
            continue
        x, y = a.split(), b.split()
        assert got[i].similarity == difflib.SequenceMatcher(None, x, y).ratio() and got[i].similarity_no_escapes == difflib.SequenceMatcher(None, plain(a).split(), plain(b).split()).ratio()
        assert (got[i].md1_tokens, got[i].md2_tokens) == (len(x), len(y))
        want = [(t, x[p:q], y[r:s]) for t, p, q, r, s in difflib.SequenceMatcher(None, x, y).get_opcodes() if t != "equal"]
        assert [c[1:] for c in sorted(codes.get(i, []))] == want
        assert [f[1:] for f in sorted(firsts.get(i, []))] == [(t, " ".join(u[:8]), " ".join(v[:8])) for t, u, v in want[:5]]
    counts = {}
    for r in compare.divergence_counts(compare.differences(pairs, ["doc_id"]), ["doc_id"]).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.n
    assert counts == {i: sum(max(len(c[2]), len(c[3])) for c in cs) for i, cs in codes.items()}


def test_iterations_equal_the_library(spark):
    texts = [(1, t, f"one two three {'x ' * t} end") for t in range(5)] + [(2, 0, "alone")]
    got = {(r.conv_id, r.i): r for r in compare.iterations(spark.createDataFrame(texts, "conv_id long, turn long, text string"), "conv_id", "turn").collect()}
    own = [t[2].split() for t in texts[:5]]
    sim = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert {k: (r.tokens, r.sim_to_first, r.sim_to_prev) for k, r in got.items()} == {(1, i): (len(own[i]), sim(own[0], own[i]), sim(own[i - 1], own[i]) if i > 1 else None) for i in range(1, 5)}


def test_page_costs_equal_the_library(spark):
    rng = random.Random(8)
    rows = [(d, s, p % 4, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 30)))) for d in range(4) for s in "ab" for p in range(rng.randint(1, 6))]
    got = align.page_costs(spark.createDataFrame(rows, "doc long, side string, page long, text string"), "doc").collect()
    for d in range(4):
        a, b = (sorted((p, t) for x, s, p, t in rows if x == d and s == side) for side in "ab")
        mine = {(r.i, r.j): (r.orig_page, r.render_page, r.wer) for r in got if r.doc == d}
        want = {}
        for (i, (p, t)), (j, (q, u)) in itertools.product(enumerate(a), enumerate(b)):
            x, y = t.split(), u.split()
            want[i, j] = (p, q, 0.0 if not x and not y else 1.0 if not x or not y else 1 - difflib.SequenceMatcher(None, x, y).ratio())
        assert mine == want


def test_registry_lookup_and_book_header(spark):
    entries = spark.createDataFrame([("a", "x1"), ("b", None), ("c", "gone")], "doc_id string, inrepo_excerpt string")
    assert registry.lookup(entries, "a").inrepo_excerpt == "x1"
    with pytest.raises(KeyError, match="a, b, c"):
        registry.lookup(entries, "zz")
    got = {r.doc_id: r.has_excerpt for r in registry.has_excerpt(entries, spark.createDataFrame([("x1",), ("x1",)], "path string")).collect()}
    assert got == {"a": True, "b": False, "c": False}
    heads = spark.createDataFrame([(" T ", " An Author ", "x/y.pdf"), (None, None, "p/my_first_book.pdf"), ("", "", "_.pdf")], "t string, a string, p string")
    assert [tuple(r) for r in heads.select(*chapters.book_header(F.col("t"), F.col("a"), F.col("p"))).collect()] == [("T", "**An Author**"), ("my first book", ""), ("_", "")]


def test_pages_to_markdown(spark):
    span = lambda t, s: (t, s, "Times", (0.0, 0.0, 1.0, 1.0))
    block = lambda *spans: (0, (0.0, 0.0, 9.0, 9.0), [([s],) for s in spans])
    pages = spark.createDataFrame([("d", 0, [block(span("4.1 Title here", 10.0)), block(span("big words", 30.0)), block(span("12", 10.0)), block(span("some bro-", 10.0), span("ken prose that is the body", 10.0))]), ("d", 1, [])], f"k string, page long, blocks array<{layout.BLOCK}>")
    got = runners.text_layer(pages, "k").first()
    assert got.md == "### 4.1 Title here\n\n## big words\n\nsome broken prose that is the body\n" and got.n_pages == 2
    assert runners.text_layer(pages, "k", 7, 9).first().md is None


def test_router_statuses(spark):
    hosts = spark.createDataFrame([("none", 1, 1.0, 0, False, False, False, False)], "host string, cpu_cores int, ram_gb double, gpu_vram_mb int, has_ollama boolean, has_marker boolean, has_tesseract boolean, has_pix2tex boolean")
    cap = routing.capabilities(hosts, routing.profiles(spark))
    case = cap.crossJoin(spark.createDataFrame([("fast", True), ("Quality", True), ("auto", False), ("?", True)], "intent string, has_text_layer boolean")).selectExpr("*", "1.0D AS math_density", "0.0D AS matrix_density", "true AS has_raster_logos")
    got = {r.intent: r for r in routing.route(case).collect()}
    assert got["fast"].steps == ["pdftotext"] and not got["fast"].degraded
    assert got["Quality"].degraded and got["Quality"].steps == ["pdftotext", routing.OPTIMIZER] and len(got["Quality"].notes) == 3
    assert got["auto"].status == "ScanNoOCR" and got["?"].status == "UnknownIntent" and got["?"].steps is None


def test_provenance(spark):
    args = [F.lit(x) if x else F.lit(None).cast("string") for x in ("1", "2024-01-01", None, "s.pdf", "a" * 64, None)]
    block = provenance.render(*args)
    once = one(spark, provenance.stamp(F.col("t"), block), ["# H\ntext", "no heading", ""])
    assert once[0].startswith("# H\n<!-- vellum-provenance v1 version=1 ") and once[1].startswith("<!-- ") and "`aaaaaaaa…`" in once[0]
    assert one(spark, provenance.stamp(F.col("t"), block), once) == once


def test_images_and_registry(spark):
    out, n = images.rename_references(F.col("t"), F.create_map(F.lit("a.jpg"), F.lit("a.png")))
    df = spark.createDataFrame([("![x](p/a.jpg) ![y](b.jpg)",), ("",)], "t string").select(out.alias("o"), n.alias("n")).collect()
    assert [tuple(r) for r in df] == [("![x](p/a.png) ![y](b.jpg)", 1), ("", 0)]
    entries = spark.createDataFrame([("a", "inrepo", "p1", "x1"), ("b", "zcache", "p2", None), ("c", "private", "p3", "x1")], "doc_id string, tier string, path string, inrepo_excerpt string")
    got = {r.doc_id: (r.resolved, r.via) for r in registry.resolve(entries, spark.createDataFrame([("p1",), ("x1",)], "path string")).collect()}
    assert got == {"a": ("p1", "inrepo"), "b": (None, "missing"), "c": ("x1", "excerpt")}


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "kind string, similarity double, pages long, tokens long, words long, size_bytes long, math_display long, math_inline long, images_count long, images_total_bytes long")
    assert corpus.corpus_totals(none).first().documents == 0
    assert [r.documents for r in corpus.by_kind(none).collect()] == [0, 0, 0, 0]
    assert "No documents" in report.overview(none)


def test_folders_and_report(spark, tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("book/01_a/01_a.md", "# A\n")
    put("book/01_a/_notes.md", "no")
    put("book/README.md", "no")
    put("paper/x.md", "# X\n")
    put("paper/sub/sub.md", "no")
    assert [r.chapter_id for r in files.markdown_folder(spark, str(tmp_path / "book")).collect()] == ["01_a"]
    assert [r.path for r in files.markdown_folder(spark, str(tmp_path / "paper")).collect()] == ["x.md"]
    stats = {"source": {"pages": 3, "size_bytes": 9}, "output": {"totals": {"tokens": 5, "ligature_artifacts": 0}}, "roundtrip": {"similarity": 0.6, "divergence_categories": {"math": 2}}, "tools": {"marker": "1"}}
    put("corpus/papers/d1/_stats.json", json.dumps(stats))
    put("corpus/papers/d1/_multi_roundtrip.json", json.dumps({"iterations": [{"i": 1, "tokens": 5}]}))
    put("corpus/papers/d2/_stats.json", "{broken")
    rows = files.overview_rows(spark, str(tmp_path / "corpus")).collect()
    assert [(r.kind, r.name, r.pages, r.similarity, len(r.multi_roundtrip)) for r in rows] == [("paper", "d1", 3, 0.6, 1)]
    text = report.overview(files.overview_rows(spark, str(tmp_path / "corpus")))
    assert "round trip moderate" in text and "| math | 2 | 1.0 |" in text
    assert files.stats_tree(spark, str(tmp_path / "corpus")).where("corrupt").count() == 1
    put("img/a.png", "12345")
    put("img/_x/b.png", "1")
    assert [(r.name, r.bytes) for r in files.image_files(spark, str(tmp_path / "img")).collect()] == [("a.png", 5)]
    assert files.file_profile(spark, str(tmp_path / "paper"), "x.md").first().size_bytes == 4


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("a", "line\n\nline")], "id string, md string")
    sinks.write_markdown(df, str(tmp_path / "md"), "id")
    back = spark.read.text(str(tmp_path / "md"), wholetext=True)
    assert [(r.value.rstrip("\n"), r.id) for r in back.collect()] == [("line\n\nline", "a")]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_markdown(df, str(tmp_path / "md"), "id")
    sinks.write_report(spark.createDataFrame([(1.23456, None)], "x double, y string"), str(tmp_path / "r"), digits=3)
    assert spark.read.text(str(tmp_path / "r")).first().value == '{"x":1.235,"y":null}'


def test_runners_isolate_failures(spark):
    def runner(x):
        if x == "bad":
            raise ValueError("no")
        return x + "!"

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "i int, content string")
    done = runners.run_each(df, runner)
    assert {(r.i, r.markdown, r.error) for r in done.collect()} == {(1, "ok!", None), (2, None, "ValueError: no")}
    assert tuple(runners.counts(done).first()) == (1, 1)
    series = runners.round_trips(df.selectExpr("i AS doc", "content AS text"), "doc", runner, 2).collect()
    assert [(r.doc, r.i, r.text) for r in series if r.error] == [(2, 1, None)] and len(series) == 5


def test_synthetic_truth(spark):
    rows = synthetic.ground_truth(spark).collect()
    assert len(rows) == 75 and len({r.item for r in rows}) == 75 and {r.tier for r in rows if r.category == "table"} == {"T1", "T2", "T3", "T4", "T5"}


def test_stream_of_samples(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = samples.windowed_metrics(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(samples) FROM windows").first()[0] == src.count()


def test_text_pairs_hold_every_document(spark, tmp_path):
    long = "the long words of it. " * 500
    spark.createDataFrame([(0, "the short one"), (1, long), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in structure_queries.token_similarity(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2}
    assert got[1].md1_tokens == len(long.split())
    assert {r.doc_id for r in structure_queries.divergence_opcodes(spark, str(tmp_path)).collect()} == {0, 1}
    assert {r.doc_id for r in structure_queries.first_differences(spark, str(tmp_path)).collect()} == {0, 1}


def test_region_merge_reads_every_page(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.l_orderkey for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().collect()}
    assert max(pages) >= 2000
    assert {r.page for r in structure_queries.region_merge(spark, sf).select("page").distinct().collect()} == pages
