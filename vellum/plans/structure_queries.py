"""Queries of chapters, page layout, comparison, alignment and tables, with the SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import labels, markdown
from vellum.operators import align, chapters, compare, corpus, layout, tables
from vellum.plans import text_queries
from vellum.plans.derived import select_list, table
from vellum.sources import runners, synthetic

# A table of contents for each supplier: front matter, chapters by part, an appendix, an index.
_TOC = """
    SELECT s_suppkey AS book_id, o AS ord, CASE WHEN o IN (0, 8, 9) THEN 1 WHEN o = 5 THEN 3 ELSE 2 END AS level,
        CASE WHEN o = 0 THEN 'Preface' WHEN o = 8 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'Index' ELSE 'Appendix 1 Tables' END WHEN o = 9 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'Bibliography' ELSE 'Appendix B' END
            WHEN o = 5 THEN '5.1 Detail' ELSE CAST(o AS STRING) || ' ' || s_name || ' Part ' || CAST(o AS STRING) END AS title, 1 + o * (2 + s_suppkey % 5) AS page
    FROM supplier, ords WHERE s_suppkey % 7 > 0 OR o < 8"""
_TOC_SQL = f"(WITH ords AS (SELECT unnest(range(10)) AS o) {_TOC})"


def _toc(spark, d):
    rows = table(spark, d, "supplier").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(9)).cast("array<long>")))
    select = _TOC[_TOC.index("SELECT") + 6 : _TOC.index("FROM")]
    return rows.where("s_suppkey % 7 > 0 OR o < 8").selectExpr(*[c.strip() for c in select_list(select)])


def _books(spark, d):
    return table(spark, d, "supplier").selectExpr("s_suppkey AS book_id", "10 * (2 + s_suppkey % 5) + 3 AS n_pages")


def chapter_bounds(spark, d):
    return chapters.chapter_bounds(_toc(spark, d), _books(spark, d)).select("book_id", "id", "title", "start", "end", "header_re")


_CHAPTERS = r"""(WITH t AS (SELECT *, regexp_extract(title, '^(\d+)\s+(.+)$', 1) AS num, regexp_extract(title, '^(\d+)\s+(.+)$', 2) AS name, 10 * (2 + book_id % 5) + 3 AS n_pages FROM """ + _TOC_SQL + r""" x),
    e AS (SELECT *, CASE WHEN title LIKE 'Appendix%' THEN 0 ELSE 1 END AS cls FROM t WHERE level = 1 AND (title LIKE 'Appendix%' OR lower(title) IN ('bibliography', 'index'))),
    f AS (SELECT book_id, arg_min(page, cls * 1000 + ord) AS first_extra FROM e GROUP BY book_id),
    m AS (SELECT t.*, lead(page) OVER (PARTITION BY book_id ORDER BY ord) AS nxt FROM t WHERE level = 2 AND num <> ''),
    slugged AS (SELECT m.book_id, 1000 + m.ord AS ord, CASE WHEN length(num) < 2 THEN '0' || num ELSE num END || '_' || substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS id, num || '. ' || name AS title, page AS start, CASE WHEN nxt IS NOT NULL THEN nxt - 1 ELSE coalesce(first_extra - 1, n_pages) END AS "end", '^#+\s+' || num || '\s+\S' AS header_re FROM m LEFT JOIN f USING (book_id)),
    front AS (SELECT book_id, 0 AS ord, '00_front_matter' AS id, 'Front Matter' AS title, 1 AS start, arg_min(page, ord) - 1 AS "end", NULL AS header_re FROM m GROUP BY book_id HAVING arg_min(page, ord) > 1),
    tail AS (SELECT book_id, 2000 + cls * 1000 + ord AS ord, 'app_' || substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS id, title, page AS start, coalesce(lead(page) OVER (PARTITION BY book_id ORDER BY cls, ord) - 1, n_pages) AS "end",
        CASE WHEN cls = 0 THEN '^#+\s+Appendix' || CASE WHEN regexp_extract(title, 'Appendix\s+(\d+)', 1) = '' THEN '\s+?' ELSE '\s+' || regexp_extract(title, 'Appendix\s+(\d+)', 1) END || '\b' ELSE '^#+\s+' || title || '\s*$' END AS header_re FROM e)
    SELECT book_id, ord, id, title, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", header_re FROM (SELECT * FROM front UNION ALL SELECT * FROM slugged UNION ALL SELECT * FROM tail))"""


def book_detector(spark, d):
    return chapters.is_book(_toc(spark, d))


def _images(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_suppkey AS book_id", "'_page_' || l_partkey % 60 || CASE l_linenumber % 3 WHEN 0 THEN '_Picture_' WHEN 1 THEN '_figure_' ELSE '_other_' END || l_linenumber || '.jpeg' AS name")


def image_chapter_join(spark, d):
    return chapters.images_in_chapters(_images(spark, d), chapters.chapter_bounds(_toc(spark, d), _books(spark, d)))


_PLACED = f"""(SELECT c.book_id, c.ord, c.id, c.title, c.start, c."end", count(i.page) AS images FROM {_CHAPTERS} c LEFT JOIN (
    SELECT i.book_id, i.page, arg_min(x.id, x.ord) AS id FROM (SELECT row_number() OVER () AS n, l_suppkey AS book_id, l_partkey % 60 + 1 AS page FROM lineitem WHERE l_linenumber % 3 < 2) i JOIN {_CHAPTERS} x ON x.book_id = i.book_id AND i.page BETWEEN x.start AND x."end" GROUP BY i.n, i.book_id, i.page) i USING (book_id, id) GROUP BY ALL)"""


def index_rows(spark, d):
    found = chapters.chapter_bounds(_toc(spark, d), _books(spark, d))
    return chapters.index_page(found, chapters.images_in_chapters(_images(spark, d), found))


_BOOK_TEXT = "'Front' || chr(10) || '## 1 ' || s_name || ' Part 1' || chr(10) || 'body' || chr(10) || '# 3 ' || s_name || chr(10) || '## 2 Second' || chr(10) || 'end' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN '# Appendix 1 x' || chr(10) ELSE '## Appendix B' || chr(10) END || '#Index' || chr(10) || '# Index  '"


def split_by_header(spark, d):
    texts = table(spark, d, "supplier").selectExpr("s_suppkey AS book_id", f"{_BOOK_TEXT} AS text")
    return chapters.split_by_headers(texts, chapters.chapter_bounds(_toc(spark, d), _books(spark, d)))


_SPLIT = rf"""WITH l AS (SELECT book_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i, len(ls) AS n FROM (SELECT s_suppkey AS book_id, list_filter(list_transform(string_split({_BOOK_TEXT}, chr(10)), lambda x, k: CASE WHEN k < len(string_split({_BOOK_TEXT}, chr(10))) THEN x || chr(10) ELSE x END), lambda x: x <> '') AS ls FROM supplier)),
    a AS (SELECT c.book_id, c.ord, c.id, min(CASE WHEN c.header_re IS NULL OR regexp_matches(l.line, replace(replace(c.header_re, '\s*$', '\s*\z'), '$', '$')) THEN l.i END) AS start_line, max(n) AS n FROM {_CHAPTERS} c JOIN l USING (book_id) GROUP BY ALL HAVING start_line IS NOT NULL),
    z AS (SELECT *, coalesce(lead(start_line) OVER (PARTITION BY book_id ORDER BY start_line, ord), n) AS end_line FROM a)
    SELECT z.book_id, z.id, CAST(z.start_line AS BIGINT) AS start_line, coalesce(string_agg(l.line, '' ORDER BY l.i), '') AS chunk FROM z LEFT JOIN l ON l.book_id = z.book_id AND l.i >= z.start_line AND l.i < z.end_line GROUP BY z.book_id, z.id, z.start_line"""


def book_header(spark, d):
    title = F.when(F.col("s_suppkey") % 3 == 0, F.lit("  ")).when(F.col("s_suppkey") % 3 == 1, F.col("s_name"))
    author = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" A. "), F.col("s_name")))
    header, subtitle = chapters.book_header(title, author, F.concat(F.lit("in/dir.x/my_book_"), F.col("s_suppkey").cast("string"), F.lit(".v1.pdf")))
    return table(spark, d, "supplier").select("s_suppkey", header.alias("header"), subtitle.alias("subtitle"))


def _box(i: int) -> str:
    return f"named_struct('x0', CAST(l_partkey % {40 + i} AS DOUBLE), 'y0', CAST(l_suppkey % {30 + i} AS DOUBLE), 'x1', CAST(l_partkey % {40 + i} + l_linenumber * {i} AS DOUBLE), 'y1', CAST(l_suppkey % {30 + i} + l_linenumber AS DOUBLE))"


def bbox_overlap(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", layout.overlap(F.expr(_box(1)), F.expr(_box(3))).alias("hit"))


def formula_text(spark, d):
    crop = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'crops/a.b/f_' || p_partkey || '.png' END")
    token = layout.formula_token(crop, F.col("p_size"), F.array(F.col("p_partkey") % 9, F.col("p_partkey") % 5))
    block = layout.display_block(layout.clean_latex(F.expr("' $$ x_' || p_partkey || ' = 1$ '")), F.expr("CASE WHEN p_partkey % 2 = 0 THEN '1.' || p_partkey END"), labels.is_complex(F.col("p_size") % 4, F.col("p_partkey") % 3 == 0, F.col("p_size")))
    return table(spark, d, "part").select("p_partkey", token.alias("token"), block.alias("block"))


def label_band_join(spark, d):
    # pages come from the keys, so they stay as small as pages are when the tables grow
    regions = table(spark, d, "orders").selectExpr("o_orderkey DIV 15 AS page", "o_orderkey AS region", "named_struct('x0', CAST(o_custkey % 90 AS DOUBLE), 'y0', CAST(o_custkey % 70 AS DOUBLE), 'x1', CAST(o_custkey % 90 + 200 AS DOUBLE), 'y1', CAST(o_custkey % 70 + 20 AS DOUBLE)) AS bbox", "CASE WHEN o_orderkey % 9 = 0 THEN 'own' END AS label")
    found = table(spark, d, "part").selectExpr("p_partkey DIV 2 AS page", "p_partkey AS ord", "'n' || p_partkey AS label", "named_struct('x0', CAST(p_size * 6 AS DOUBLE), 'y0', CAST(p_partkey * 7 % 70 AS DOUBLE), 'x1', CAST(p_size * 6 + 20 AS DOUBLE), 'y1', CAST(p_partkey * 7 % 70 + 10 AS DOUBLE)) AS bbox")
    out = layout.labels_of_regions(regions, found, ["page"])
    return out.select("page", "region", F.col("bbox.x1").alias("x1"), "label")


def probe_sample(spark, d):
    rows = table(spark, d, "conversations").withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))).selectExpr("conv_id", "turn AS page", "text || ' 1/2 = x^2'  AS text", "turn % 3 AS matrix_regions", "array(CAST(turn * 50 AS INT), 0, 900) AS image_widths")
    return layout.probe(rows, "conv_id", 3).select("conv_id", F.col("n_pages").cast("long").alias("n_pages"), "has_text_layer", "math_density", "matrix_density", "has_raster_logos")


# A page of each document: a block of all lines of its text, and one of its id in large type.
_BOX = "named_struct('x0', 1.0, 'y0', 1.0, 'x1', 2.0, 'y1', 2.0)"
_LINES = f"transform(split(text, '\\n'), t -> named_struct('spans', array(named_struct('text', t, 'size', 9.04 + doc_id % 3, 'font', CASE WHEN doc_id % 4 = 0 THEN 'CMMI10' ELSE 'Times' END, 'bbox', {_BOX}))))"
_TEXT_BLOCK = f"named_struct('type', 0, 'bbox', named_struct('x0', CAST(doc_id % 17 + 5 AS DOUBLE), 'y0', 0.0, 'x1', 90.0, 'y1', 10.0), 'lines', {_LINES})"
_ID_BLOCK = f"named_struct('type', 0, 'bbox', named_struct('x0', CAST(doc_id % 5 AS DOUBLE), 'y0', 0.0, 'x1', 90.0, 'y1', 10.0), 'lines', array(named_struct('spans', array(named_struct('text', CAST(doc_id AS STRING), 'size', 30.0, 'font', 'Times', 'bbox', {_BOX})))))"


def _block_pages(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", "doc_id DIV 5 AS book", "doc_id % 5 AS page", "text").withColumn("blocks", F.array(*[F.expr(b).cast(layout.BLOCK) for b in (_TEXT_BLOCK, _ID_BLOCK)]))
    return rows.select("doc_id", "book", "page", "blocks")


def dominant_size(spark, d):
    return layout.dominant_size(_block_pages(spark, d), "book")


def body_left(spark, d):
    return layout.body_left(_block_pages(spark, d), ["doc_id"])


def page_markdown(spark, d):
    return runners.text_layer(_block_pages(spark, d), "book")


def page_range(spark, d):
    return layout.page_range(table(spark, d, "conversations"), -2, 3, "turn").groupBy("conv_id").agg(F.count("*").alias("n"))


def is_monotonic(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn AS pos", "turn * 10 + (conv_id * turn) % 14 AS render_page")
    return align.monotone(rows, "conv_id")


def first_by_key(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return corpus.first_by_key(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


def _text_pairs(spark, d):
    docs = table(spark, d, "documents").repartition(spark.sparkContext.defaultParallelism * 4, "doc_id")  # long pairs are dealt over all cores
    return docs.select("doc_id", F.col("text").alias("a"), F.regexp_replace(F.regexp_replace("text", r"(\w+) (\w+)\.", "$2 _$1_."), "the", r"the \$x\$").alias("b"))


def token_similarity(spark, d):
    return compare.round_trip(_text_pairs(spark, d), ["doc_id"])


def divergence_opcodes(spark, d):
    return compare.divergence_counts(compare.differences(_text_pairs(spark, d), ["doc_id"]), ["doc_id"])


def first_differences(spark, d):
    return compare.first_differences(compare.differences(_text_pairs(spark, d), ["doc_id"]), ["doc_id"])


def turn_iterations(spark, d):
    return compare.iterations(table(spark, d, "conversations"), "conv_id", "turn")


def _sides(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("page"), "text")
    return turns.withColumn("side", F.lit("a")).unionByName(turns.select("conv_id", ((F.col("page") + 1) % 5).alias("page"), F.regexp_replace("text", "the", "teh").alias("text")).withColumn("side", F.lit("b")))


def page_wer_hungarian(spark, d):
    return align.audit(_sides(spark, d), "conv_id", "hungarian").drop("ssim")


def page_wer_dtw(spark, d):
    return align.audit(_sides(spark, d), "conv_id", "dtw").drop("ssim")


def _flat(regions):
    """Regions with plain columns."""
    box, blocks = [F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")], F.array_join(F.col("block_indices").cast("array<string>"), ",").alias("blocks")
    return regions.select(*[c for c in regions.columns if c not in ("bbox", "block_indices")], *box, blocks)


def region_merge(spark, d):
    # line numbers repeat, so the order on a page is one over all that differs
    rows = table(spark, d, "lineitem").withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_tax")))
    rows = rows.selectExpr("l_orderkey AS page", "CAST(ord AS BIGINT) AS ord", f"{_box(3)} AS bbox", "CASE WHEN l_linenumber = 2 THEN '2' END AS label", "l_partkey % 2 = 0 AS cmex", "l_tax AS density", "CAST(l_linenumber AS INT) AS n_lines", "array(CAST(ord AS INT)) AS block_indices")
    return _flat(layout.merge_regions(rows, ["page"]))


def _span(text: str, font: str, x0: str, y0: str, width: int) -> str:
    box = f"named_struct('x0', CAST({x0} AS DOUBLE), 'y0', CAST({y0} AS DOUBLE), 'x1', CAST({x0} + {width} AS DOUBLE), 'y1', CAST({y0} + 10 AS DOUBLE))"
    return f"named_struct('type', 0, 'bbox', {box}, 'lines', array(named_struct('spans', array(named_struct('text', {text}, 'size', 10.0, 'font', '{font}', 'bbox', {box})))))"


_FORMULA_BLOCKS = f"array({_span('repeat(p_name, 5)', 'Times', '50', '10', 400)}, {_span(chr(39) + 'x + y = ' + chr(39) + ' || p_size', 'CMMI10', '120 + p_size', '100', 80)}, {_span(chr(39) + 'z + w = 1' + chr(39), 'CMEX10', '150', '100 + p_partkey % 40', 60)}, {_span(chr(39) + '(1.' + chr(39) + ' || p_size || ' + chr(39) + ')' + chr(39), 'Times', '400', '101', 20)})"


def formula_regions(spark, d):
    pages = table(spark, d, "part").selectExpr("p_partkey", "p_name", "p_size").withColumn("blocks", F.expr(_FORMULA_BLOCKS).cast(f"array<{layout.BLOCK}>"))
    return _flat(layout.formula_regions(pages, ["p_partkey"]))


def inline_formulas(spark, d):
    texts = table(spark, d, "documents").selectExpr("doc_id", "'before @@p1b2@@ between ' || text || ' @@p3b4@@' AS md")
    rows = table(spark, d, "documents").selectExpr("doc_id", "explode(array(named_struct('ord', 0L, 'token', '@@p1b2@@', 'latex', CASE WHEN doc_id % 2 = 0 THEN '$x$' ELSE '' END, 'raw', 'raw', 'label', CAST(NULL AS STRING), 'is_complex', doc_id % 3 = 0), named_struct('ord', 1L, 'token', '@@p9b9@@', 'latex', 'y', 'raw', '', 'label', '2', 'is_complex', false))) AS f").select("doc_id", "f.*")
    return layout.inline_formulas(texts, rows, "doc_id")


def teds_tables(spark, d):
    md = F.expr("'| a | b |\n|---|---|\n| ' || n_name || ' | ' || n_regionkey || ' |\n'")
    pred = F.expr("CASE n_nationkey % 3 WHEN 0 THEN '| a | b |\n|---|---|\n| ' || n_name || ' | ' || n_regionkey || ' |' WHEN 1 THEN 'none' ELSE '| a |\n|---|\n| ' || lower(n_name) || ' |' END")
    return table(spark, d, "nation").select("n_nationkey", md.alias("t"), pred.alias("p")).select("n_nationkey", tables.table_scores(F.col("t"), F.col("p")).alias("s")).select("n_nationkey", "s.*")


def synthetic_truth(spark, d):
    return synthetic.ground_truth(spark)


def diagram_blocks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(markdown.fenced_diagrams_to_html(F.concat(F.lit("```mermaid\n"), F.col("source"), F.lit("\n```\n"), F.col("lang")))).alias("digest"))


_FLAT = "replace(text, chr(10), '')"
# a text's lines, stripped, joined and folded as the text layer does it
_RAW = text_queries.trimmed(text_queries.FOLD.replace("md", text_queries.HYPHEN.replace("md", "ls")))
_PAGES_SQL = f"""
    WITH l AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {text_queries.trimmed('x')}), lambda x: x <> ''), ' ') AS ls FROM documents),
    r AS (SELECT doc_id, {_RAW} AS raw FROM l),
    b AS (SELECT doc_id, CASE WHEN raw = '' OR regexp_full_match(raw, '\\d{{1,3}}') THEN NULL
        WHEN length(raw) < 70 AND regexp_matches(raw, '^(\\d+)((?:\\.\\d+)*)\\s+[A-Z][a-z]') THEN repeat('#', CAST(least(2 + length(regexp_extract(raw, '^\\d+((?:\\.\\d+)*)', 1)) - length(replace(regexp_extract(raw, '^\\d+((?:\\.\\d+)*)', 1), '.', '')), 6) AS INT)) || ' ' || raw ELSE raw END AS one FROM r),
    p AS (SELECT doc_id // 5 AS book, doc_id % 5 AS page, concat_ws(chr(10) || chr(10), one, CASE WHEN doc_id > 999 THEN CAST(doc_id AS VARCHAR) END) AS md FROM b)
    SELECT book, {text_queries.trimmed("regexp_replace(string_agg(md, chr(10) || chr(10) ORDER BY page), '\\n{3,}', chr(10) || chr(10), 'g')")} || chr(10) AS md, count(*) AS n_pages FROM p GROUP BY book"""
_REGIONS_SQL = """
    WITH RECURSIVE b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_tax) AS ord, CAST(l_partkey % 43 AS DOUBLE) AS x0, CAST(l_suppkey % 33 AS DOUBLE) AS y0, CAST(l_partkey % 43 + l_linenumber * 3 AS DOUBLE) AS x1, CAST(l_suppkey % 33 + l_linenumber AS DOUBLE) AS y1,
        CASE WHEN l_linenumber = 2 THEN '2' END AS label, l_partkey % 2 = 0 AS cmex, l_tax AS density, l_linenumber AS n_lines FROM lineitem),
    t AS (SELECT p.page, p.ord AS a, q.ord AS b FROM b p JOIN b q ON p.page = q.page AND p.x0 <= q.x1 + 1 AND q.x0 <= p.x1 + 1 AND p.y0 <= q.y1 + 1 AND q.y0 <= p.y1 + 1),
    reach AS (SELECT page, a, b FROM t UNION SELECT r.page, r.a, t.b FROM reach r JOIN t ON t.page = r.page AND t.a = r.b),
    c AS (SELECT page, a AS ord, min(b) AS root FROM reach GROUP BY page, a),
    m AS (SELECT c.page, c.root, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_min(label, ord) FILTER (label IS NOT NULL) AS label, bool_or(cmex) AS cmex, max(density) AS density, CAST(sum(n_lines) AS INTEGER) AS n_lines, CAST(count(*) AS INTEGER) AS merged_from, list(CAST(ord AS INTEGER) ORDER BY ord) AS block_indices FROM c JOIN b USING (page, ord) GROUP BY c.page, c.root)
    SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY root) - 1 AS INTEGER) AS region, x0, y0, x1, y1, label, cmex, density, n_lines, merged_from, array_to_string(block_indices, ',') AS blocks, merged_from >= 2 OR (cmex AND n_lines >= 5) AS is_complex FROM m"""
# by hand for the four blocks: k is how much lower the second formula stands
_FORMULAS_SQL = """
    WITH p AS (SELECT p_partkey, p_size AS s, p_partkey % 40 AS k FROM part),
    r AS (SELECT p_partkey, 0 AS region, CASE WHEN k <= 12 THEN least(116 + s, 146) ELSE 116 + s END AS x0, 96 AS y0, 398 AS x1, CASE WHEN k <= 12 THEN greatest(110 + k, 111) ELSE 111 END + 4 AS y1, '1.' || s AS label, k <= 11 AS cmex, CASE WHEN k <= 11 THEN 2 ELSE 1 END AS n_lines, CASE WHEN k <= 11 THEN 2 ELSE 1 END AS merged_from, CASE WHEN k <= 12 THEN '1,2,3' ELSE '1,3' END AS blocks FROM p
        UNION ALL SELECT p_partkey, 1, 146, 96 + k, 214, 114 + k, NULL, true, 1, 1, '2' FROM p WHERE k > 11)
    SELECT p_partkey, region, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, label, cmex, CAST(1 AS DOUBLE) AS density, n_lines, merged_from, blocks, merged_from >= 2 AS is_complex FROM r"""

QUERIES = {f.__name__: f for f in (
    chapter_bounds, book_detector, image_chapter_join, index_rows, split_by_header, book_header, bbox_overlap, formula_text, label_band_join, probe_sample, dominant_size, body_left, page_markdown, page_range, is_monotonic, first_by_key,
    token_similarity, divergence_opcodes, first_differences, turn_iterations, page_wer_hungarian, page_wer_dtw, region_merge, formula_regions, inline_formulas, teds_tables, synthetic_truth, diagram_blocks,
)}

ORACLE_SQL = {
    "chapter_bounds": f'SELECT book_id, id, title, start, "end", header_re FROM {_CHAPTERS}',
    "book_detector": f"SELECT book_id, bool_or(level >= 2) AND count(*) >= 3 AS is_book FROM {_TOC_SQL} GROUP BY book_id",
    "image_chapter_join": f"SELECT book_id, id, images FROM {_PLACED}",
    "index_rows": f"""SELECT book_id, string_agg('| [' || title || '](./' || id || '/' || id || '.md) | ' || start || '-' || "end" || ' | ' || images || ' |', chr(10) ORDER BY ord) || chr(10) || chr(10) || count(*) || ' chapters, ' || CAST(sum(images) AS BIGINT) || ' images' AS index_md FROM {_PLACED} GROUP BY book_id""",
    "split_by_header": _SPLIT,
    "book_header": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN s_name ELSE 'my book ' || s_suppkey || '.v1' END AS header, CASE WHEN s_suppkey % 2 = 0 THEN '**A. ' || s_name || '**' ELSE '' END AS subtitle FROM supplier",
    "bbox_overlap": "SELECT l_orderkey, l_linenumber, NOT (ax1 + 1 < bx0 OR bx1 + 1 < ax0 OR ay1 + 1 < by0 OR by1 + 1 < ay0) AS hit FROM (SELECT l_orderkey, l_linenumber, l_partkey % 41 AS ax0, l_suppkey % 31 AS ay0, l_partkey % 41 + l_linenumber AS ax1, l_suppkey % 31 + l_linenumber AS ay1, l_partkey % 43 AS bx0, l_suppkey % 33 AS by0, l_partkey % 43 + l_linenumber * 3 AS bx1, l_suppkey % 33 + l_linenumber AS by1 FROM lineitem)",
    "formula_text": r"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'f_' || p_partkey ELSE 'p' || p_size || 'b' || least(p_partkey % 9, p_partkey % 5) END AS token, CASE WHEN p_size % 4 >= 2 OR (p_partkey % 3 = 0 AND p_size >= 5) THEN '<!-- matrix or several lines: low confidence -->' || chr(10) ELSE '' END || '$$ x_' || p_partkey || ' = 1' || CASE WHEN p_partkey % 2 = 0 THEN ' \tag{1.' || p_partkey || '}' ELSE '' END || ' $$' AS block FROM part",
    "label_band_join": "WITH r AS (SELECT o_orderkey // 15 AS page, o_orderkey AS region, o_custkey % 90 AS x0, o_custkey % 70 AS y0, CASE WHEN o_orderkey % 9 = 0 THEN 'own' END AS own FROM orders), n AS (SELECT p_partkey // 2 AS page, p_partkey AS ord, p_size * 6 AS x0, p_partkey * 7 % 70 + 5 AS m FROM part) SELECT r.page, r.region, CAST(least(r.x0 + 200, coalesce(min(n.x0) - 2, r.x0 + 200)) AS DOUBLE) AS x1, coalesce(own, 'n' || arg_min(n.ord, n.ord)) AS label FROM r LEFT JOIN n ON n.page = r.page AND n.m BETWEEN r.y0 AND r.y0 + 20 AND n.x0 >= r.x0 GROUP BY r.page, r.region, r.x0, own",
    "probe_sample": r"SELECT conv_id, max(n) AS n_pages, avg(length(trim(t))) > 30 AS has_text_layer, round(avg(len(regexp_extract_all(t, '[=∑∫√≤≥≠αβγδλΣΦΨΩ]|\b\d+/\d+\b|\^|\\[a-zA-Z]+'))), 2) AS math_density, round(avg(turn % 3), 2) AS matrix_density, bool_or(turn * 50 > 0 AND turn * 50 < 200) AS has_raster_logos FROM (SELECT *, text || ' 1/2 = x^2' AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE turn < 3 OR (n > 3 AND (turn = n // 2 OR turn = n - 1)) GROUP BY conv_id",
    "dominant_size": f"SELECT book, CAST(arg_max(size, n * 10 - pos) AS DOUBLE) AS body FROM (SELECT doc_id // 5 AS book, unnest([round(9.04 + doc_id % 3, 1), 30.0]) AS size, unnest([length({_FLAT}), length(CAST(doc_id AS VARCHAR))]) AS n, unnest([0, 1]) AS pos FROM documents WHERE doc_id % 5 = 0) GROUP BY book",
    "body_left": f"SELECT doc_id, CAST(CASE WHEN length({_FLAT}) > 40 AND doc_id % 4 > 0 THEN doc_id % 17 + 5 ELSE least(doc_id % 17 + 5, doc_id % 5) END AS DOUBLE) AS \"left\" FROM documents",
    "page_markdown": _PAGES_SQL,
    "region_merge": _REGIONS_SQL,
    "formula_regions": _FORMULAS_SQL,
    "inline_formulas": r"""SELECT doc_id, 'before ' || CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN '<!-- matrix or several lines: low confidence -->' || chr(10) ELSE '' END || '$$ x $$' ELSE 'raw' END || ' between ' || text || ' @@p3b4@@' || chr(10) || chr(10) || '## Formulas' || chr(10) || chr(10) || '- $$ y \tag{2} $$' || chr(10) AS md, CAST(1 + (doc_id % 2 = 0)::INT AS INTEGER) AS inlined FROM documents""",
    "teds_tables": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE round(1 - (2 + levenshtein(n_name, lower(n_name)) / length(n_name)) / 7, 4) END AS teds, CASE n_nationkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE round(1 - 2 / 7, 4) END AS teds_struct, n_nationkey % 3 = 1 AS no_table, 'ok' AS status FROM nation",
    "page_range": "SELECT conv_id, count(*) AS n FROM conversations WHERE turn BETWEEN 0 AND 3 GROUP BY conv_id",
    "is_monotonic": "SELECT conv_id, bool_and(ok) AS monotone FROM (SELECT conv_id, coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY turn) <= r, true) AS ok FROM (SELECT conv_id, turn, turn * 10 + (conv_id * turn) % 14 AS r FROM conversations)) GROUP BY conv_id",
    "first_by_key": "SELECT l_partkey, l_suppkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1",
    "diagram_blocks": "SELECT doc_id, md5('<pre class=\"mermaid\">' || source || '</pre>' || chr(10) || lang) AS digest FROM documents",
}
