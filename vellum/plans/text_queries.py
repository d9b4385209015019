"""Queries of the text kernel, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import labels, markdown
from vellum.operators import corpus, provenance
from vellum.plans.derived import MD_SQL, md_docs, table

_WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOK = rf"[^{_WS}]+"
_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
_LATEX = r"regexp_extract_all(array_to_string(regexp_extract_all(md, '(?s)(\$\$.*?\$\$|\$[^$\n]+?\$)'), chr(10)), '\\([a-zA-Z]+)', 1)"


def _n(pattern: str, text: str = "md") -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS BIGINT)"


METRICS_SQL = {
    "size_bytes": "CAST(octet_length(encode(md)) AS BIGINT)",
    "lines": f"CAST(CASE WHEN md = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(md, '(?:{_BREAK})\\z', ''), '{_BREAK}')) END AS BIGINT)",
    "tokens": _n(_TOK), "words": _n(r"[\pL\pN_]+"), "sentences_estimated": _n(r"[.!?]\s+[A-ZÁÉÍÓÚÂÊÔÃÕÇ]"),
    "h1": _n("(?m)^# [^#]"), "h2": _n("(?m)^## [^#]"), "h3": _n("(?m)^### [^#]"), "h4_plus": _n("(?m)^####+ "),
    "math_display": "CAST((length(md) - length(replace(md, '$$', ''))) // 2 // 2 AS BIGINT)",
    "math_inline": _n(r"\$[^$\n]+?\$", r"replace(md, '\$', chr(1))"),
    "latex_cmd_count": f"CAST(len({_LATEX}) AS BIGINT)", "latex_cmd_unique": f"CAST(len(list_distinct({_LATEX})) AS BIGINT)",
    "ligature_artifacts": _n("[ﬀ-ﬄ]"), "tables_rough": _n(r"(?m)^\|.*\|$") + " // 2",
    "code_blocks": "CAST((length(md) - length(replace(md, '```', ''))) // 3 // 2 AS BIGINT)", "images_referenced": _n(r"!\[[^\]]*\]\([^)]+\)"),
}
_M = ", ".join(f"{c} AS {n}" for n, c in METRICS_SQL.items())
_METRICS = f"(SELECT doc_id, source, lang, {_M} FROM {MD_SQL})"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{_WS}]+|[{_WS}]+\z', '', 'g')"


def _norm(text: str, escapes: bool = False) -> str:
    x = rf"regexp_replace({text}, '\{{\d+\}}', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)<!--\s*page\s*\d+\s*-->', '', 'g')"
    x = rf"regexp_replace({x}, '!\[([^\]]*)\]\((?:[^)]*/)?([^)/]+)/*\)', '![\1](\2)', 'g')"
    if escapes:
        x = rf"regexp_replace({x}, '\\([\\`*_{{}}\[\]()#+\-.!])', '\1', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return trimmed(x)


FOLD = "nfc_normalize(translate(" + "replace(" * 5 + "md" + "".join(f", '{a}', '{b}')" for a, b in markdown.LIGATURES.items()) + ", '“”‘’–−', '\"\"''''--'))"
_COMPARE = trimmed(rf"regexp_replace(regexp_replace(lower(nfc_normalize(md)), '\\([\\`*_{{}}\[\]()#+\-.!])', '\1', 'g'), '[{_WS}]+', ' ', 'g')")
HYPHEN = r"regexp_replace(regexp_replace(md, '([\pL\pN_])-\n([\pL\pN_])', '\1\2', 'g'), '([\pL\pN_])- ([\pL\pN_])', '\1\2', 'g')"
_SLUG = "substr(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60)"

_PAIRS = [("''", "' '"), ("'see https://x.y'", "'$a$'"), ("'$a$'", "'b'"), ("chr(92) || 'alpha'", "'a'"), ("'# Head'", "'Head'"), ("'**b**'", "'b'"), ("'![x](a.png)'", "''"), ("'| a |'", "'a'"), ("'---'", "'x'"), ("'a.svg'", "'plain'"), ("'plain'", "'other'")]
_A = "CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN {a}" for i, (a, _) in enumerate(_PAIRS)) + " END"
_B = "CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN {b}" for i, (_, b) in enumerate(_PAIRS)) + " END"


def md_metrics(spark, d):
    return corpus.document_metrics(md_docs(spark, d).select("doc_id", "md"), "md").drop("headers_total")


def folder_totals(spark, d):
    return corpus.folder_totals(corpus.document_metrics(md_docs(spark, d).select("doc_id", "source", "md"), "md"), "source")


def corpus_rollup(spark, d):
    """Metrics and the second-pass signal of each document, by source."""
    m = markdown.metrics(F.col("md"))
    signal = labels.pass2(F.col("hits"), F.col("chars"), F.col("n_chars") % 9)
    counts = [m[c].alias(c) for c in ("tokens", "words", "math_inline", "tables_rough")]
    rows = md_docs(spark, d).select("source", "n_chars", *counts, markdown.math_hits(F.col("md")).alias("hits"), F.length("md").alias("chars")).withColumn("w", signal["warranted"])
    return rows.groupBy("source").agg(F.count("*").alias("documents"), *[F.sum(c).alias(c) for c in ("tokens", "words", "math_inline", "tables_rough")], F.count_if("w").alias("second_pass"))


_HITS = r"[=∑∫√≤≥≠αβγδλμνπσφψωΣΦΨΩ∇∂±×·→]|\b\d+/\d+\b|\^|_\{|\\[a-zA-Z]+"


def pass2_signal(spark, d):
    signal = labels.pass2(F.col("hits"), F.col("chars"), F.col("doc_id") % 9)
    counted = md_docs(spark, d).select("doc_id", markdown.math_hits(F.col("md")).alias("hits"), F.length("md").alias("chars"))
    return counted.select("doc_id", *[c.alias(n) for n, c in signal.items()])


def latex_top_per_doc(spark, d):
    return corpus.command_ranks(md_docs(spark, d), "doc_id", "md").select("doc_id", "command", "n", "first_pos", F.col("rank").cast("long").alias("rank"))


_CMDS = f"(SELECT doc_id, unnest({_LATEX}) AS command, generate_subscripts({_LATEX}, 1) - 1 AS pos FROM {MD_SQL})"
_RANKS = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM (SELECT doc_id, command, CAST(count(*) AS BIGINT) AS n, CAST(min(pos) AS BIGINT) AS first_pos FROM {_CMDS} GROUP BY ALL)) WHERE rank <= 10)"


def _over_md(column):
    return lambda spark, d: md_docs(spark, d).select("doc_id", column(F.col("md")).alias("out"))


def tokenize(spark, d):
    t = markdown.tokens(F.col("md"))
    return md_docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, "\n").cast("binary")).alias("digest"))


def categorize_divergence(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{_A} AS a", f"{_B} AS b")
    return rows.select("doc_id", markdown.divergence_category(F.col("a"), F.col("b")).alias("category"))


def classify_kind(spark, d):
    path = "CASE page_id % 4 WHEN 0 THEN 'x/Livros/' WHEN 1 THEN 'papers/' WHEN 2 THEN 'a/material_aulas/b/' ELSE 'papers_old/' END || url"
    return table(spark, d, "pages").selectExpr("page_id", f"{path} AS path").select("page_id", labels.document_kind(F.col("path")).alias("kind"))


def fmt_bytes(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 64 WHEN 2 THEN o_custkey * 131072 WHEN 3 THEN o_custkey * 1073741824 ELSE o_custkey * 1099511627776 END AS n")
    return rows.select("o_orderkey", markdown.byte_size(F.col("n")).alias("shown"))


_N = "CASE o_orderkey % 5 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 64 WHEN 2 THEN o_custkey * 131072 WHEN 3 THEN o_custkey * 1073741824 ELSE o_custkey * 1099511627776 END"
_EVEN = "printf('%.1f', CAST(round_even(n / {0}.0, 1) AS DOUBLE)) || ' {1}'"


def slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", markdown.slug(F.col("text")).alias("slug"))


def heading_levels(spark, d):
    raw = "CASE p_partkey % 6 WHEN 0 THEN '4 ' || p_name WHEN 1 THEN '4.1 Abc ' || p_name WHEN 2 THEN '4.1.2.3.4.5 Abc' WHEN 3 THEN p_name WHEN 4 THEN '12' ELSE ' 7 Word and ' || p_type || p_name || p_name || p_name || p_name END"
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{raw} AS raw", "CAST(p_size AS DOUBLE) AS size")
    return rows.select("p_partkey", markdown.heading_level(F.col("raw"), F.col("size"), F.lit(20.0)).alias("level"), markdown.is_page_number(F.col("raw")).alias("page_number"))


def paragraphs(spark, d):
    p = markdown.paragraphs(F.col("md"))
    hint = F.size(F.filter(p, lambda x: x.rlike("[α-ωΑ-Ω∑∫√=]"))).cast("long")
    return md_docs(spark, d).select("doc_id", F.size(p).cast("long").alias("n"), hint.alias("math_hints"), F.md5(F.array_join(p, "\n").cast("binary")).alias("digest"))


def provenance_stamp(spark, d):
    block = provenance.render(F.lit("1.0"), F.lit("2024-01-02"), F.when(F.col("doc_id") % 2 == 0, F.lit("abc1234")), F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.when(F.col("doc_id") % 3 == 1, F.sha2("source", 256)), F.when(F.col("doc_id") % 5 == 0, F.lit("x 1.0")))
    old = provenance.render(F.lit("0.9"), F.lit("2023-01-02"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    rows = md_docs(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    base = F.when(F.col("doc_id") % 4 == 3, F.col("text")).when(F.col("doc_id") % 4 == 2, provenance.stamp(F.col("md"), old)).otherwise(F.col("md"))
    staged = rows.withColumn("base", base).withColumn("block", block)
    return staged.select("doc_id", F.md5("block").alias("block_md5"), F.md5(provenance.stamp(F.col("base"), F.col("block"))).alias("text_md5"))


_BLOCK = "'<!-- vellum-provenance v1 version=1.0 date=2024-01-02' || CASE WHEN doc_id % 2 = 0 THEN ' commit=abc1234' ELSE '' END || CASE WHEN doc_id % 3 > 0 THEN ' source=' || source ELSE '' END || ' -->' || chr(10) || '> *Converted by **vellum** `1.0`' || CASE WHEN doc_id % 2 = 0 THEN ' (commit `abc1234`)' ELSE '' END || ' on 2024-01-02' || CASE WHEN doc_id % 3 > 0 THEN ' — source: `' || source || '`' || CASE WHEN doc_id % 3 = 1 THEN ' (sha256 `' || substr(sha256(source), 1, 8) || '…`' || CASE WHEN doc_id % 5 = 0 THEN ', x 1.0' ELSE '' END || ')' WHEN doc_id % 5 = 0 THEN ' — x 1.0' ELSE '' END ELSE '' END || '.*' || chr(10)"
_HEAD = "length(regexp_extract(md, '(?m)^#+ .*$'))"

def file_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))


def localise_images(spark, d):
    return md_docs(spark, d).select("doc_id", F.md5(markdown.localise_images(F.col("md"))).alias("digest"))


def _digest(column):
    return lambda spark, d: md_docs(spark, d).select("doc_id", F.length(column(F.col("md"))).cast("long").alias("n"), F.md5(column(F.col("md"))).alias("digest"))


def _digest_sql(x: str) -> str:
    return f"SELECT doc_id, CAST(length(x) AS BIGINT) AS n, md5(x) AS digest FROM (SELECT doc_id, {x} AS x FROM {MD_SQL})"


_JOINED = trimmed(r"regexp_replace(x, '\s*\n\s*', ' ', 'g')")

QUERIES = {
    "md_metrics": md_metrics, "folder_totals": folder_totals, "corpus_rollup": corpus_rollup, "pass2_signal": pass2_signal, "latex_top_per_doc": latex_top_per_doc,
    "latex_top_terms": lambda spark, d: corpus.top_commands(corpus.command_ranks(md_docs(spark, d), "doc_id", "md")),
    "normalize_md": _digest(markdown.normalize_md), "normalize_md_escapes": _digest(lambda c: markdown.normalize_md(c, True)), "normalize_text": _digest(markdown.normalize_for_comparison),
    "fold_characters": _digest(markdown.fold_characters), "dehyphenate": _digest(markdown.join_hyphenation), "tokenize": tokenize, "categorize_divergence": categorize_divergence, "classify_kind": classify_kind, "fmt_bytes": fmt_bytes, "slugify": slugify,
    "heading_levels": heading_levels, "paragraphs": paragraphs, "provenance_stamp": provenance_stamp, "file_digest": file_digest, "localise_images": localise_images,
}

ORACLE_SQL = {
    "md_metrics": f"SELECT doc_id, {_M} FROM {MD_SQL}",
    "folder_totals": f"SELECT source, CAST(count(*) AS BIGINT) AS chapter_count, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in (*corpus.SUMS, 'latex_cmd_count'))}, CAST(sum(h1 + h2 + h3 + h4_plus) AS BIGINT) AS headers_total FROM {_METRICS} GROUP BY source",
    "corpus_rollup": f"SELECT source, CAST(count(*) AS BIGINT) AS documents, {', '.join(f'CAST(sum({METRICS_SQL[c]}) AS BIGINT) AS {c}' for c in ('tokens', 'words', 'math_inline', 'tables_rough'))}, CAST(count(*) FILTER (1000.0 * {_n(_HITS)} / greatest(length(md), 1) >= 1.0 OR length(md) / greatest(n_chars % 9, 1) < 800) AS BIGINT) AS second_pass FROM {MD_SQL} GROUP BY source",
    "pass2_signal": f"SELECT doc_id, m >= 1.0 OR p < 800 AS warranted, round(m, 2) AS math_per_kchar, round(p, 1) AS chars_per_page, concat_ws(';', CASE WHEN m >= 1.0 THEN 'math' END, CASE WHEN p < 800 THEN 'density' END) AS reasons FROM (SELECT doc_id, CAST(1000.0 * {_n(_HITS)} AS DOUBLE) / greatest(length(md), 1) AS m, length(md) / greatest(doc_id % 9, 1) AS p FROM {MD_SQL})",
    "latex_top_per_doc": f"SELECT * FROM {_RANKS}",
    "latex_top_terms": f"SELECT command, CAST(sum(n) AS BIGINT) AS n FROM {_RANKS} GROUP BY command ORDER BY n DESC, command LIMIT 20",
    "normalize_md": _digest_sql(_norm("md")), "normalize_md_escapes": _digest_sql(_norm("md", True)), "normalize_text": _digest_sql(_COMPARE), "fold_characters": _digest_sql(FOLD), "dehyphenate": _digest_sql(HYPHEN),
    "tokenize": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, chr(10))) AS digest FROM (SELECT doc_id, regexp_extract_all({_norm('md')}, '{_TOK}') AS t FROM {MD_SQL})",
    "categorize_divergence": rf"SELECT doc_id, CASE WHEN trim(s) = '' THEN 'whitespace' WHEN regexp_matches(s, 'https?://|ftp://') THEN 'other' WHEN contains(s, '$') OR regexp_matches(s, '\\[a-zA-Z]+') THEN 'math' WHEN regexp_matches(s, '(?:^|\n)#+ ') THEN 'heading' WHEN contains(s, '**') OR contains(s, '_') THEN 'emphasis' WHEN contains(s, '![') OR contains(s, '.jpeg') OR contains(s, '.png') OR contains(s, '.svg') THEN 'image_ref' WHEN contains(s, '|') THEN 'table' WHEN contains(s, '---') THEN 'separator' ELSE 'other' END AS category FROM (SELECT doc_id, {_A} || ' ' || {_B} AS s FROM documents)",
    "classify_kind": "SELECT page_id, CASE WHEN list_contains(p, 'livros') THEN 'livro' WHEN list_contains(p, 'papers') THEN 'paper' WHEN list_contains(p, 'material_aulas') THEN 'material' ELSE 'outro' END AS kind FROM (SELECT page_id, string_split(lower(CASE page_id % 4 WHEN 0 THEN 'x/Livros/' WHEN 1 THEN 'papers/' WHEN 2 THEN 'a/material_aulas/b/' ELSE 'papers_old/' END || url), '/') AS p FROM pages)",
    "fmt_bytes": f"SELECT o_orderkey, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN {_EVEN.format(1024, 'KB')} WHEN n < 1073741824 THEN {_EVEN.format(1048576, 'MB')} WHEN n < 1099511627776 THEN {_EVEN.format(1073741824, 'GB')} ELSE {_EVEN.format(1099511627776, 'TB')} END AS shown FROM (SELECT o_orderkey, {_N} AS n FROM orders)",
    "slugify": f"SELECT doc_id, {_SLUG.format('text')} AS slug FROM documents",
    "heading_levels": r"SELECT p_partkey, CAST(CASE WHEN length(trim(raw)) < 70 AND regexp_matches(trim(raw), '^(\d+)((?:\.\d+)*)\s+[A-Z][a-z]') THEN least(2 + length(d) - length(replace(d, '.', '')), 6) WHEN regexp_matches(raw, '[A-Za-z]{3,}') AND size >= 32 THEN 2 WHEN regexp_matches(raw, '[A-Za-z]{3,}') AND size >= 25 THEN 3 ELSE 0 END AS BIGINT) AS level, regexp_full_match(raw, '\d{1,3}') AS page_number FROM (SELECT *, regexp_extract(trim(raw), '^\d+((?:\.\d+)*)', 1) AS d FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '4 ' || p_name WHEN 1 THEN '4.1 Abc ' || p_name WHEN 2 THEN '4.1.2.3.4.5 Abc' WHEN 3 THEN p_name WHEN 4 THEN '12' ELSE ' 7 Word and ' || p_type || p_name || p_name || p_name || p_name END AS raw, p_size AS size FROM part))",
    "paragraphs": rf"SELECT doc_id, CAST(len(p) AS BIGINT) AS n, CAST(len(list_filter(p, lambda x: regexp_matches(x, '[α-ωΑ-Ω∑∫√=]'))) AS BIGINT) AS math_hints, md5(array_to_string(p, chr(10))) AS digest FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(md, '\n\s*\n'), lambda x: {_JOINED}), lambda x: x <> '') AS p FROM {MD_SQL})",
    "provenance_stamp": f"SELECT doc_id, md5(b) AS block_md5, md5(CASE WHEN doc_id % 4 = 3 THEN b || chr(10) || text ELSE substr(md, 1, h) || chr(10) || b || substr(md, h + 1) END) AS text_md5 FROM (SELECT doc_id, {_BLOCK} AS b, {_HEAD} AS h, md FROM {MD_SQL}) JOIN (SELECT doc_id, text FROM documents) USING (doc_id)",
    "file_digest": "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents",
    "localise_images": rf"SELECT doc_id, md5(regexp_replace(md, '!\[([^\]]*)\]\((?:[^)]*/)?([^)/]+)\)', '![\1](images/\2)', 'g')) AS digest FROM {MD_SQL}",
}
