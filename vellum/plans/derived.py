"""Markup that the tables lack, derived from their rows by expressions that both SQL dialects read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NL, _BS = "chr(10)", "chr(92)"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


#: A Markdown document made of a row of ``documents``.
MD = f"""('# ' || source || {_NL} || {_NL} || text || {_NL} || {_NL} || {_NL} || {_NL} || '## ' || lang || ' {{' || {_s("doc_id % 9")} || '}}' || {_NL}
    || '<!-- Page ' || {_s("doc_id % 40")} || ' -->' || {_NL} || '$$ ' || {_BS} || 'frac{{' || {_s("doc_id")} || '}}{{2}} + ' || {_BS} || 'alpha $$ and $x_' || {_s("doc_id % 7")} || ' = ' || {_BS} || 'beta$' || {_NL} || {_NL}
    || '### part' || chr(9) || '  two' || {_NL} || '#### deep' || {_NL} || '| a | b |' || {_NL} || '| - | - |' || {_NL} || '| ' || {_s("doc_id")} || ' | ' || {_s("n_chars")} || ' |' || {_NL} || {_NL}
    || '![fig](out/deep/_page_' || {_s("doc_id % 50")} || '_Picture_1.jpeg) snake' || {_BS} || '_case' || {_NL} || '```' || {_NL} || 'code' || {_NL} || '```' || {_NL} || 'well-' || {_NL} || 'known re- use ﬁne “quoted” – dash' || {_NL})"""
MD_SQL = f"(SELECT doc_id, source, lang, n_chars, {MD} AS md FROM documents)"

#: The flat facts of a corpus, one row a document: a row of ``documents`` with its metrics stand-ins.
FACTS = f"""
    'root/' || CASE doc_id % 4 WHEN 0 THEN 'Livros' WHEN 1 THEN 'papers' WHEN 2 THEN 'material_aulas' ELSE 'misc' END || '/' || {_s("doc_id")} AS rel_path,
    CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id % 40 END AS pages, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE n_chars END AS tokens, n_chars AS words, n_chars * 2 AS size_bytes, doc_id % 5 AS math_display, doc_id % 11 AS math_inline,
    doc_id % 3 AS images_count, (doc_id % 3) * 1000 AS images_total_bytes, CASE WHEN doc_id % 17 = 0 THEN doc_id % 6 ELSE 0 END AS ligature_artifacts,
    CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars * 3 END AS pdf_size, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE (doc_id % 101) / 100.0 END AS similarity"""
FACTS_SQL = f"(SELECT doc_id, source, lang, {FACTS} FROM documents)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "lang", "n_chars", f"{MD} AS md")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "lang", "n_chars", *[x.strip() for x in select_list(FACTS)])
    return rows.withColumn("similarity", rows["similarity"].cast("double"))


def select_list(text: str) -> list[str]:
    """A select list cut at its outer commas."""
    out, depth, cur, quoted = [], 0, "", False
    for c in text:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]
