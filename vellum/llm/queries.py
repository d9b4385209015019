"""The registered query of each operator: production parameters, whole tables, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import chat, decontamination, packing, pii, quality, sharding, simhash, substrings, topk, toxicity
from vellum.llm.common import table


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where(F.col("vec_id") % topk.QUERY_EVERY == 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_examples(rows.unionByName(extra)))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents").select("doc_id"), [f"shard-{i:05d}" for i in range(sharding.SHARDS)])
    return placed.select("doc_id", "slot", "shard")


_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g')"
_CHAT_SQL = f"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), e AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
            32 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) AS chars
        FROM c
    ), p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e)
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
    FROM p GROUP BY conv_id
"""

_REPEATS_SQL = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, pos, array_to_string(ws[pos + 1 : pos + 50], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS pos FROM w WHERE len(ws) >= 50)),
    bad AS (SELECT s.doc_id, s.pos FROM s JOIN (SELECT k, min(doc_id) AS least FROM s GROUP BY k) m ON s.k = m.k AND m.least < s.doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS i FROM bad),
    words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[[:punct:]]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _seeds_sql(key: str, rows: str, items: bool) -> str:
    """The masked windows of ``rows`` (key, toks), spelled out, with those of the short items' lengths."""
    least, alone = decontamination.MIN_TOKENS, decontamination.SHORT_ALONE
    masks = [(m, mask, f"len(toks) >= {least}" if items else "true") for m, mask in enumerate(decontamination.MASKS)]
    masks += [(-n, "1" * n, f"len(toks) = {n}" if items or n < alone else "true") for n in range(1, least)]
    parts = []
    for m, mask, when in masks:
        used = [f"toks[pos + {i + 1}]" for i, c in enumerate(mask) if c == "1"]
        parts.append(f"SELECT {key}, pos, {m} AS m, {' || chr(10) || '.join(used)} AS seed FROM (SELECT {key}, toks, unnest(range(len(toks))) AS pos FROM {rows} WHERE {when}) WHERE {used[-1]} IS NOT NULL")
    return " UNION ALL ".join(parts)


_WHOLE = f"n_equal >= {decontamination.MIN_TOKENS} AND n_equal >= {decontamination.MIN_SHARE} * n_tokens"
_DENSE = f"n_tokens > {decontamination.STRETCH} AND stretch >= {decontamination.MIN_STRETCH}"
_EXACT = f"n_tokens < {decontamination.MIN_TOKENS} AND n_equal = n_tokens AND (n_tokens >= {decontamination.SHORT_ALONE} OR n_text = n_tokens)"
_OVERLAPS_SQL = f"""
    WITH d AS (SELECT doc_id, {_TOKENS} AS toks FROM documents), i AS (SELECT item_id, {_TOKENS} AS toks FROM benchmark),
    hits AS (SELECT DISTINCT x.doc_id, y.item_id, x.pos - y.pos AS doc_start FROM ({_seeds_sql("doc_id", "d", False)}) x JOIN ({_seeds_sql("item_id", "i", True)}) y USING (m, seed)),
    e AS (SELECT h.*, list_filter(range(len(i.toks)), lambda j: h.doc_start + j >= 0 AND d.toks[greatest(h.doc_start + j, 0) + 1] = i.toks[j + 1]) AS equal, len(i.toks) AS n_tokens, len(d.toks) AS n_text FROM hits h JOIN d USING (doc_id) JOIN i USING (item_id)),
    v AS (SELECT *, len(equal) AS n_equal, list_max(list_transform(range(n_tokens), lambda j: len(list_filter(equal, lambda x: x >= j AND x < j + {decontamination.STRETCH})))) AS stretch FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, doc_start) AS k FROM v WHERE ({_WHOLE}) OR ({_DENSE}) OR ({_EXACT}))
    SELECT doc_id, item_id, CAST(n_equal AS BIGINT) AS n_equal, CAST(n_tokens AS BIGINT) AS n_tokens, round(n_equal / n_tokens, 4) AS share, CAST(stretch AS BIGINT) AS stretch, CAST(doc_start AS BIGINT) AS doc_start FROM r WHERE k = 1
"""

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_classifier, op3_exact_topk, op4_toxicity, op5_substring_dedup, op6_personal_data, op7_decontamination, op8_chat_formatting, op9_simhash_near_dedup, op10_sharding)}
ORACLE_SQL: dict[str, str] = {
    "op3_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op5_substring_dedup": _REPEATS_SQL,
    "op7_decontamination": _OVERLAPS_SQL,
    "op8_chat_formatting": _CHAT_SQL,
}
