"""Queries of labels, joins, roll-ups, routing and telemetry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import labels
from vellum.operators import corpus, images, registry, routing, telemetry
from vellum.plans.derived import FACTS_SQL, facts, table

_KIND = "CASE WHEN rel_path LIKE '%/Livros/%' THEN 'livro' WHEN rel_path LIKE '%/papers/%' THEN 'paper' WHEN rel_path LIKE '%/material_aulas/%' THEN 'material' ELSE 'outro' END"


def _facts(spark, d):
    return facts(spark, d).withColumn("kind", labels.document_kind(F.col("rel_path")))


def _pairs(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey", "CAST((o_orderkey % 101) / 100.0 AS DOUBLE) AS wer", "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST((o_custkey % 103) / 100.0 AS DOUBLE) END AS ssim")


_PAIRS = "(SELECT o_orderkey, o_custkey, CAST((o_orderkey % 101) / 100.0 AS DOUBLE) AS wer, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST((o_custkey % 103) / 100.0 AS DOUBLE) END AS ssim FROM orders)"


def page_flags(spark, d):
    return _pairs(spark, d).select("o_orderkey", F.array_join(labels.page_flags(F.col("wer"), F.col("ssim")), ",").alias("flags"))


def page_pair_agg(spark, d):
    return corpus.page_pair_summary(_pairs(spark, d).withColumn("bucket", F.col("o_custkey") % 50), "bucket")


def problem_pages(spark, d):
    from vellum.operators import align

    rows = _pairs(spark, d).select((F.col("o_custkey") % 50).alias("bucket"), F.col("o_orderkey").alias("pos"), labels.page_flags(F.col("wer"), F.col("ssim")).alias("flags"))
    return align.problem_pages(rows, "bucket").select("bucket", "pos", F.col("rank").cast("long").alias("rank"), F.col("more").cast("long").alias("more"))


def report_labels(spark, d):
    bloat, tokens, pages = F.col("o_totalprice") / 100000, F.col("o_custkey"), F.col("o_orderkey") % 9
    sim, plain = (F.col("o_orderkey") % 101) / 100.0, (F.col("o_orderkey") % 101 + F.col("o_custkey") % 9) / 100.0
    return table(spark, d, "orders").select("o_orderkey", labels.bloat_tier(bloat, tokens, pages).alias("bloat"), labels.stability(sim.cast("double")).alias("verdict"), labels.escape_flag(sim.cast("double"), plain.cast("double")).alias("escapes"))


def _image_rows(spark, d):
    return table(spark, d, "part").selectExpr(
        "p_partkey AS image_id", "p_partkey * 37 % 9001 + 10 AS src_bytes", "p_partkey * 53 % 9001 + 10 AS candidate_bytes",
        "CASE WHEN p_partkey % 50 = 7 THEN NULL ELSE CAST(p_size AS BIGINT) END AS n_colors", "CAST(p_partkey % 11 AS DOUBLE) AS quant_error", "CASE WHEN p_partkey % 50 = 7 OR p_partkey % 41 = 3 THEN 'broken: 1' END AS error",
    )


_IMAGES = """(SELECT *, CASE WHEN made THEN candidate_bytes ELSE src_bytes END AS dst_bytes, CASE WHEN made THEN src_bytes - candidate_bytes ELSE 0 END AS saved_bytes FROM (SELECT *, decision LIKE 'convert%' AS made FROM (
    SELECT *, CASE WHEN error IS NOT NULL AND kind IS NULL THEN 'open_error: ' || error WHEN kind = 'continuous' THEN 'keep_jpeg' WHEN error IS NOT NULL THEN 'error: ' || error WHEN candidate_bytes < src_bytes THEN 'convert_to_png_' || kind ELSE 'keep_jpeg_smaller' END AS decision FROM (
    SELECT *, CASE WHEN n_colors IS NULL THEN NULL WHEN n_colors <= 2 THEN 'bw' WHEN n_colors <= 16 THEN 'palette' WHEN quant_error < 5 THEN 'palette_lossy' ELSE 'continuous' END AS kind FROM (
    SELECT p_partkey AS image_id, p_partkey * 37 % 9001 + 10 AS src_bytes, p_partkey * 53 % 9001 + 10 AS candidate_bytes, CASE WHEN p_partkey % 50 = 7 THEN NULL ELSE p_size END AS n_colors, p_partkey % 11 AS quant_error, CASE WHEN p_partkey % 50 = 7 OR p_partkey % 41 = 3 THEN 'broken: 1' END AS error FROM part)))))"""


def image_decisions(spark, d):
    return images.decide(_image_rows(spark, d)).select("image_id", "kind", "decision", "dst_bytes", "saved_bytes")


def image_savings(spark, d):
    return images.savings(images.decide(_image_rows(spark, d)))


def image_savings_topk(spark, d):
    return images.largest_savings(images.decide(_image_rows(spark, d))).select("image_id", "saved_bytes")


def image_formats(spark, d):
    rows = table(spark, d, "part").selectExpr("p_brand", "'img_' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' ELSE '.svg' END AS name", "p_partkey * 37 % 9001 AS bytes")
    return images.by_format(rows, "p_brand")


def rename_refs(spark, d):
    text = F.expr("'see ![a](x/img_' || o_custkey % 7 || '.jpeg) and ![b c](img_' || o_orderkey % 7 || '.jpeg), ![](other.png) end'")
    names = F.create_map(*[F.lit(x) for i in range(0, 7, 2) for x in (f"img_{i}.jpeg", f"img_{i}.png")])
    out, n = images.rename_references(text, names)
    return table(spark, d, "orders").select("o_orderkey", out.alias("text"), n.alias("n"))


def sidecar_left_join(spark, d):
    docs, side = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels")
    return corpus.with_sidecar(docs, side, "doc_id").select("doc_id", "source", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))


def transport_ratios(spark, d):
    r = corpus.transport_ratios(F.col("size_bytes"), F.col("images_total_bytes"), F.col("pdf_size"))
    return facts(spark, d).select("doc_id", *[c.alias(n) for n, c in r.items()])


def divergence_merge(spark, d):
    m = F.expr("map('math', doc_id % 7, 'other', doc_id % 3, CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE 'heading' END, doc_id % 5)")
    return corpus.merged_divergences(table(spark, d, "documents").select(m.alias("divergences")))


def version_signatures(spark, d):
    tools = F.expr("named_struct('marker', CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END, 'torch', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '2.' || CAST(c_custkey % 2 AS STRING) END, 'cuda_device', CASE WHEN c_custkey % 5 = 0 THEN 'gpu' END)")
    return corpus.tool_signatures(table(spark, d, "customer").select(tools.alias("tools")))


def kind_details(spark, d):
    rows = _facts(spark, d).withColumns({"chapter_count": F.col("doc_id") % 3, "extraction_seconds": F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") / 8)})
    return corpus.kind_details(rows)


def registry_excerpts(spark, d):
    entries = table(spark, d, "part").selectExpr("p_partkey AS doc_id", "CASE WHEN p_partkey % 4 = 0 THEN 'x/' || p_partkey END AS inrepo_excerpt")
    there = table(spark, d, "part").where("p_partkey % 8 = 0").selectExpr("'x/' || p_partkey AS path")
    return registry.has_excerpt(entries, there.unionByName(there))


def profiles_by_role(spark, d):
    return routing.by_role(routing.profiles(spark), "REFINER").select("algo", "unit", "unit_speed_s")


def outlier_tiers(spark, d):
    return corpus.outliers(facts(spark, d)).select("doc_id", "rel_path", "tier", "notes")


def _series(spark, d):
    return table(spark, d, "conversations").selectExpr("conv_id", "turn AS i", "CASE WHEN (conv_id + turn) % 11 = 0 THEN NULL ELSE CAST(1.0 - turn * (conv_id % 7 - 1) / 200.0 + (turn % 2) * (conv_id % 3) / 500.0 AS DOUBLE) END AS sim_to_first")


def drift_verdict(spark, d):
    return corpus.drift(_series(spark, d), "conv_id")


def ok_fail_counts(spark, d):
    from vellum.sources import runners

    return runners.counts(table(spark, d, "events").selectExpr("CASE WHEN event_id % 9 = 0 THEN 'failed' END AS error"))


def telemetry_steps(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("step"), "ts", F.col("event_id").alias("sample_id"), F.col("value").alias("cpu"), (F.col("event_id") % 977).cast("double").alias("rss"), (F.col("event_id") * 3).cast("double").alias("read_bytes"), (F.col("event_id") * 5).cast("double").alias("write_bytes"), (F.col("event_id") / 100).alias("cpu_seconds"), (F.col("event_id") % 17).alias("threads"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 101).cast("double").alias("gpu_util"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 4096).cast("double").alias("gpu_vram"))
    return telemetry.step_metrics(rows)


def bag_similarity(spark, d):
    t = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda w: w != "")
    docs = table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", t.alias("a"))
    other = table(spark, d, "documents").where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), t.alias("b"))
    return docs.join(other, "doc_id").select("doc_id", F.round(corpus.set_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def registry_resolve(spark, d):
    entries = table(spark, d, "part").selectExpr("p_partkey AS doc_id", "CASE p_partkey % 3 WHEN 0 THEN 'inrepo' WHEN 1 THEN 'zcache' ELSE 'private' END AS tier", "'p/' || p_partkey AS path", "CASE WHEN p_partkey % 4 = 0 THEN 'x/' || p_partkey END AS inrepo_excerpt")
    there = table(spark, d, "part").selectExpr("CASE WHEN p_partkey % 5 < 3 THEN 'p/' ELSE 'x/' END || p_partkey AS path").unionByName(table(spark, d, "part").where("p_partkey % 8 = 0").selectExpr("'x/' || p_partkey AS path"))
    return registry.resolve(entries, there, F.col("doc_id") % 2 == 0)


_HOSTS = [("laptop", 8, 16.0, 0, False, False, False, False), ("laptop_ocr", 8, 16.0, 0, False, False, True, True), ("gpu_small", 8, 32.0, 2048, True, True, False, False), ("gpu", 16, 64.0, 12288, True, True, True, True), ("gpu_bare", 16, 64.0, 12288, False, False, False, False), ("server", 64, 256.0, 0, True, True, True, False)]
_HOST_SCHEMA = "host string, cpu_cores int, ram_gb double, gpu_vram_mb int, has_ollama boolean, has_marker boolean, has_tesseract boolean, has_pix2tex boolean"
_INTENTS = ["fast", " Rapido", "quality", "BALANCED", "auto", "indexação", "low_resource", "baixo-recurso", "unknown"]


def _cases(spark, d):
    hosts = spark.createDataFrame(_HOSTS, _HOST_SCHEMA)
    docs = table(spark, d, "documents").selectExpr("doc_id", "doc_id % 4 > 0 AS has_text_layer", "CAST(doc_id % 3 AS DOUBLE) AS math_density", "CAST(doc_id % 2 AS DOUBLE) AS matrix_density", "doc_id % 5 = 0 AS has_raster_logos")
    intents = spark.createDataFrame([(i,) for i in _INTENTS], "intent string")
    dims = routing.capabilities(hosts, routing.profiles(spark)).crossJoin(F.broadcast(intents))  # six hosts by nine intents
    return routing.route(docs.crossJoin(F.broadcast(dims)))


def route_matrix(spark, d):
    r = _cases(spark, d)
    return r.select("doc_id", "host", "intent", "status", F.col("primary_algo"), F.array_join("steps", "+").alias("steps"), "degraded", F.array_join("pass2", "+").alias("pass2"), F.size("notes").cast("long").alias("n_notes"), routing.summary(F.col("canonical"), F.col("steps"), F.col("degraded")).alias("summary"))


def execution(spark, d):
    r = routing.execution(_cases(spark, d).where("status = 'ok'"), F.col("doc_id") % 2 == 0, F.col("math_density") > 1)
    return r.select("doc_id", "host", "intent", F.array_join("ran", "+").alias("ran"), F.size("skipped").cast("long").alias("n_skipped"), "needs_pass2")


def memory_peak(spark, d):
    r = _cases(spark, d).where("status = 'ok'").select(F.concat_ws("/", "doc_id", "host", "intent").alias("case_id"), "steps")
    return routing.memory_peak(r, routing.profiles(spark), "case_id").select("case_id", F.col("ram_mb").cast("long").alias("ram_mb"))


def availability_matrix(spark, d):
    return routing.availability(spark.createDataFrame(_HOSTS, _HOST_SCHEMA), routing.profiles(spark))


def _values(rows) -> str:
    def one(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]" if isinstance(v, list) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_AVAILABLE = f"""(SELECT host, algo, (hardware <> 'gpu-required' OR gpu_vram_mb >= 4096) AND (NOT list_contains(needs, 'marker_bin') OR has_marker) AND (NOT list_contains(needs, 'tesseract_bin') OR has_tesseract)
    AND (NOT list_contains(needs, 'ollama') OR has_ollama) AND (NOT list_contains(needs, 'pix2tex_runtime') OR has_pix2tex) AS available
    FROM ({_values(_HOSTS)}) h(host, cpu_cores, ram_gb, gpu_vram_mb, has_ollama, has_marker, has_tesseract, has_pix2tex), ({_values(routing.PROFILES)}) p(algo, role, hardware, needs, granularity, unit_speed_s, unit, vram_mb, ram_mb, cold_s, scan))"""
_ROUTED = f"""(WITH can AS (SELECT host, bool_or(available) FILTER (algo = 'marker') AS mk, bool_or(available) FILTER (algo = 'tesseract') AS te, bool_or(available) FILTER (algo = 'pix2tex') AS px, bool_or(available) FILTER (algo = 'gemma3-4b-small-image') AS ge FROM {_AVAILABLE} GROUP BY host),
    c AS (SELECT d.doc_id, d.doc_id % 4 > 0 AS txt, d.doc_id % 3 AS math, d.doc_id % 2 AS matrix, d.doc_id % 5 = 0 AS logos, can.*, i.intent,
        CASE replace(lower(trim(i.intent)), '_', '-') WHEN 'fast' THEN 'rapido' WHEN 'rapido' THEN 'rapido' WHEN 'quality' THEN 'qualidade' WHEN 'balanced' THEN 'balanceado' WHEN 'auto' THEN 'auto' WHEN 'indexação' THEN 'indexacao' WHEN 'low-resource' THEN 'low-resource' WHEN 'baixo-recurso' THEN 'low-resource' END AS k
        FROM documents d, can, ({_values([(i,) for i in _INTENTS])}) i(intent)),
    p AS (SELECT *, k IN ('qualidade', 'balanceado', 'auto') AS wq, CASE WHEN k IS NULL THEN NULL WHEN NOT txt THEN CASE WHEN mk THEN 'marker' WHEN te THEN 'tesseract' END WHEN k IN ('qualidade', 'balanceado', 'auto') AND mk THEN 'marker' ELSE 'pdftotext' END AS prim FROM c),
    s AS (SELECT *, txt AND k IN ('qualidade', 'auto') AND math > 0 AND prim <> 'marker' AS m, txt AND k IN ('qualidade', 'auto') AND logos AS l, CASE WHEN k IS NULL THEN 'UnknownIntent' WHEN prim IS NULL THEN 'ScanNoOCR' ELSE 'ok' END AS status FROM p)
    SELECT doc_id, host, intent, status, prim AS primary_algo, math, CASE WHEN status = 'ok' THEN concat_ws('+', prim, CASE WHEN m AND px THEN 'pix2tex' END, CASE WHEN l AND ge THEN 'gemma3-4b-small-image' END, CASE WHEN wq THEN 'image-optimize' END) END AS steps,
        CASE WHEN status = 'ok' THEN k = 'qualidade' AND CASE WHEN txt THEN NOT mk ELSE prim = 'tesseract' END END AS degraded, CASE WHEN status = 'ok' AND txt AND k = 'indexacao' AND mk THEN 'marker+image-optimize' END AS pass2, k,
        CASE WHEN status = 'ok' THEN (txt AND wq AND NOT mk)::BIGINT + (m AND px AND matrix > 0)::BIGINT + (m AND NOT px)::BIGINT + (l AND NOT ge)::BIGINT + (txt AND k = 'low-resource')::BIGINT + (txt AND k = 'indexacao')::BIGINT + (NOT txt)::BIGINT + (NOT txt AND k = 'indexacao')::BIGINT END AS n_notes FROM s)"""

_DRIFT = """SELECT conv_id, n, round((a - z) * 100, 4) AS drift, round(abs(z - y) * 100, 4) AS last_step, v AS verdict, CASE WHEN v = 'unexpected' THEN 'continuous' ELSE v END AS overview_verdict FROM (
    SELECT *, CASE WHEN n >= 2 THEN CASE WHEN abs((a - z) * 100) < 1 THEN 'stable' WHEN a > z AND abs(z - y) * 100 < 0.5 THEN 'logarithmic' WHEN a > z THEN 'continuous' ELSE 'unexpected' END END AS v FROM (
    SELECT conv_id, count(*) AS n, arg_min(s, i) AS a, arg_max(s, i) AS z, list(s ORDER BY i DESC)[2] AS y FROM (SELECT conv_id, turn AS i, CAST(1.0 - turn * (conv_id % 7 - 1) / 200.0 + (turn % 2) * (conv_id % 3) / 500.0 AS DOUBLE) AS s FROM conversations WHERE (conv_id + turn) % 11 <> 0) GROUP BY conv_id))"""

QUERIES = {
    "page_flags": page_flags, "page_pair_agg": page_pair_agg, "problem_pages": problem_pages, "report_labels": report_labels, "image_decisions": image_decisions, "image_savings": image_savings, "image_savings_topk": image_savings_topk, "image_formats": image_formats, "rename_refs": rename_refs,
    "sidecar_left_join": sidecar_left_join, "corpus_totals": lambda s, d: corpus.corpus_totals(facts(s, d)), "overview_by_kind": lambda s, d: corpus.by_kind(_facts(s, d)), "similarity_histogram": lambda s, d: corpus.similarity_histogram(facts(s, d)),
    "divergence_merge": divergence_merge, "transport_ratios": transport_ratios, "version_signatures": version_signatures, "outlier_tiers": outlier_tiers, "drift_verdict": drift_verdict, "ok_fail_counts": ok_fail_counts, "telemetry_steps": telemetry_steps, "bag_similarity": bag_similarity,
    "registry_resolve": registry_resolve, "kind_details": kind_details, "registry_excerpts": registry_excerpts, "profiles_by_role": profiles_by_role, "availability_matrix": availability_matrix, "route_matrix": route_matrix, "execution": execution, "memory_peak": memory_peak,
}

ORACLE_SQL = {
    "page_flags": f"SELECT o_orderkey, concat_ws(',', CASE WHEN wer >= 0.6 THEN 'high_wer' WHEN wer >= 0.3 THEN 'medium_wer' END, CASE WHEN ssim < 0.5 THEN 'low_ssim' WHEN ssim < 0.95 THEN 'medium_ssim' END) AS flags FROM {_PAIRS}",
    "page_pair_agg": f"SELECT o_custkey % 50 AS bucket, count(*) AS n, {', '.join(f'round(coalesce({x}, 0), 6) AS {n}' for n, x in (('wer_median', 'quantile_cont(wer, 0.5)'), ('wer_mean', 'avg(wer)'), ('wer_min', 'min(wer)'), ('wer_max', 'max(wer)'), ('wer_ok_share', 'avg((wer < 0.3)::DOUBLE)'), ('wer_tol_share', 'avg((wer < 0.6)::DOUBLE)'), ('ssim_median', 'quantile_cont(ssim, 0.5)'), ('ssim_mean', 'avg(ssim)'), ('ssim_ok_share', 'avg((ssim > 0.95)::DOUBLE)')))} FROM {_PAIRS} GROUP BY 1",
    "problem_pages": f"SELECT bucket, pos, rank, greatest(total - 20, 0) AS more FROM (SELECT o_custkey % 50 AS bucket, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey % 50) AS total FROM {_PAIRS} WHERE wer >= 0.3 OR ssim < 0.95) WHERE rank <= 20",
    "report_labels": "SELECT o_orderkey, CASE WHEN b > 3 OR (b > 2 AND coalesce(o_custkey / nullif(o_orderkey % 9, 0) < 200, false)) THEN 'strong' WHEN b > 1.5 THEN 'abnormal' ELSE 'ok' END AS bloat, CASE WHEN s * 100 >= 90 THEN 'stable' WHEN s * 100 >= 80 THEN 'evaluate' ELSE 'investigate' END AS verdict, CASE WHEN abs((p - s) * 100) <= 1 THEN 'none' WHEN (p - s) * 100 > 5 THEN 'dense markup' ELSE 'shown' END AS escapes FROM (SELECT *, o_totalprice / 100000 AS b, CAST((o_orderkey % 101) / 100.0 AS DOUBLE) AS s, CAST((o_orderkey % 101 + o_custkey % 9) / 100.0 AS DOUBLE) AS p FROM orders)",
    "image_decisions": f"SELECT image_id, kind, decision, dst_bytes, saved_bytes FROM {_IMAGES}",
    "image_savings": f"SELECT split_part(decision, ':', 1) AS by_decision, count(*) AS n, CAST(sum(src_bytes) AS BIGINT) AS src_bytes, CAST(sum(saved_bytes) AS BIGINT) AS saved_bytes, round(sum(saved_bytes) * 100 / nullif(sum(src_bytes), 0), 4) AS saved_pct FROM {_IMAGES} GROUP BY ROLLUP (split_part(decision, ':', 1))",
    "image_savings_topk": f"SELECT image_id, saved_bytes FROM {_IMAGES} WHERE saved_bytes > 0 ORDER BY saved_bytes DESC, image_id LIMIT 10",
    "image_formats": "SELECT p_brand, CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' ELSE 'svg' END AS format, count(*) AS n, CAST(sum(p_partkey * 37 % 9001) AS BIGINT) AS bytes, max(p_partkey * 37 % 9001) AS max_bytes, min(p_partkey * 37 % 9001) AS min_bytes, CAST(sum(p_partkey * 37 % 9001) // count(*) AS BIGINT) AS avg_bytes FROM part GROUP BY ALL",
    "rename_refs": "SELECT o_orderkey, 'see ![a](x/img_' || o_custkey % 7 || CASE WHEN o_custkey % 7 % 2 = 0 THEN '.png' ELSE '.jpeg' END || ') and ![b c](img_' || o_orderkey % 7 || CASE WHEN o_orderkey % 7 % 2 = 0 THEN '.png' ELSE '.jpeg' END || '), ![](other.png) end' AS text, (o_custkey % 7 % 2 = 0)::BIGINT + (o_orderkey % 7 % 2 = 0)::BIGINT AS n FROM orders",
    "sidecar_left_join": "SELECT doc_id, source, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "corpus_totals": f"SELECT count(*) AS documents, {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in ('pages', 'tokens', 'words', 'size_bytes', 'math_display', 'math_inline', 'images_count', 'images_total_bytes'))}, round(avg(CAST(similarity AS DOUBLE)), 6) AS sim_avg, min(CAST(similarity AS DOUBLE)) AS sim_min, max(CAST(similarity AS DOUBLE)) AS sim_max, count(similarity) AS sim_n FROM {FACTS_SQL}",
    "overview_by_kind": f"SELECT k.kind, CAST(count(f.doc_id) AS BIGINT) AS documents, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS size_bytes FROM (VALUES ('livro'), ('paper'), ('material'), ('outro')) k(kind) LEFT JOIN (SELECT *, {_KIND} AS kind FROM {FACTS_SQL}) f USING (kind) GROUP BY k.kind",
    "similarity_histogram": f"SELECT b.bucket, count(f.doc_id) AS n FROM (VALUES ('excellent'), ('good'), ('fair'), ('poor')) b(bucket) LEFT JOIN (SELECT doc_id, CASE WHEN s >= 95 THEN 'excellent' WHEN s >= 90 THEN 'good' WHEN s >= 80 THEN 'fair' ELSE 'poor' END AS bucket FROM (SELECT doc_id, CAST(similarity AS DOUBLE) * 100 AS s FROM {FACTS_SQL}) WHERE s IS NOT NULL) f USING (bucket) GROUP BY b.bucket",
    "divergence_merge": "SELECT category, n, round(n / nullif(sum(n) OVER (), 0), 6) AS share FROM (SELECT category, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'math' AS category, doc_id % 7 AS n FROM documents UNION ALL SELECT 'other', doc_id % 3 FROM documents UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE 'heading' END, doc_id % 5 FROM documents) GROUP BY category)",
    "transport_ratios": f"SELECT doc_id, round(size_bytes * 100 / CASE WHEN pdf_size > 0 THEN pdf_size END, 4) AS md_pct, round((size_bytes + images_total_bytes) * 100 / CASE WHEN pdf_size > 0 THEN pdf_size END, 4) AS md_images_pct FROM {FACTS_SQL}",
    "version_signatures": "SELECT coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END, '?') AS marker, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '2.' || c_custkey % 2 END, '?') AS torch, CASE WHEN c_custkey % 5 = 0 THEN 'gpu' ELSE 'CPU' END AS device, count(*) AS docs FROM customer GROUP BY ALL",
    "outlier_tiers": f"SELECT * FROM (SELECT doc_id, rel_path, CASE WHEN tokens = 0 THEN 'critical' WHEN s < 50 THEN 'critical' WHEN s < 70 THEN 'notable' WHEN ligature_artifacts > 0 THEN 'critical' END AS tier, concat_ws('; ', CASE WHEN s < 50 THEN 'round trip critical' WHEN s < 70 THEN 'round trip moderate' END, CASE WHEN ligature_artifacts > 0 THEN ligature_artifacts || ' broken ligatures' END, CASE WHEN tokens = 0 THEN 'no tokens' END) AS notes FROM (SELECT *, CAST(similarity AS DOUBLE) * 100 AS s FROM {FACTS_SQL})) WHERE tier IS NOT NULL",
    "kind_details": f"SELECT kind, rel_path, pages, doc_id % 3 AS chapter_count, tokens, words, math_display + math_inline AS formulas, images_count, size_bytes, CAST(similarity AS DOUBLE) AS similarity, CASE WHEN doc_id % 2 = 0 THEN words / 8 END AS extraction_seconds FROM (SELECT *, {_KIND} AS kind FROM {FACTS_SQL}) WHERE kind <> 'outro'",
    "registry_excerpts": "SELECT p_partkey AS doc_id, p_partkey % 8 = 0 AS has_excerpt FROM part",
    "profiles_by_role": "SELECT * FROM (VALUES ('pix2tex', 'formula', 6.5::DOUBLE), ('gemma3-4b-small-image', 'image', 45.9::DOUBLE), ('qwen3-vl-8b-small-image', 'image', 112.0::DOUBLE)) v(algo, unit, unit_speed_s)",
    "drift_verdict": _DRIFT,
    "ok_fail_counts": "SELECT count(*) FILTER (event_id % 9 <> 0) AS ok, count(*) FILTER (event_id % 9 = 0) AS failed FROM events",
    "telemetry_steps": "SELECT step, samples, round(CAST(wall AS DOUBLE), 3) AS wall_s, round(m, 3) AS cpu_mean, round(p, 3) AS cpu_peak, round(a, 3) AS rss_start, round(z, 3) AS rss_peak, round(z - a, 3) AS rss_delta, round(greatest(0, io), 3) AS io_read, round(greatest(0, w), 3) AS io_write, round(c, 3) AS cpu_s, CAST(th AS DOUBLE) AS threads_peak, round(gu, 3) AS gpu_util_mean, vp AS vram_peak, vp - v0 AS vram_delta FROM (SELECT event_type AS step, count(*) AS samples, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS wall, avg(value) AS m, max(value) AS p, CAST(arg_min(event_id % 977, (ts, event_id)) AS DOUBLE) AS a, CAST(max(event_id % 977) AS DOUBLE) AS z, CAST(arg_max(event_id * 3, (ts, event_id)) - arg_min(event_id * 3, (ts, event_id)) AS DOUBLE) AS io, CAST(arg_max(event_id * 5, (ts, event_id)) - arg_min(event_id * 5, (ts, event_id)) AS DOUBLE) AS w, arg_max(event_id / 100, (ts, event_id)) - arg_min(event_id / 100, (ts, event_id)) AS c, max(event_id % 17) AS th, avg(CASE WHEN event_id % 4 > 0 THEN event_id % 101 END) AS gu, CAST(max(CASE WHEN event_id % 4 > 0 THEN event_id % 4096 END) AS DOUBLE) AS vp, CAST(CASE WHEN arg_min(event_id, (ts, event_id)) % 4 > 0 THEN arg_min(event_id, (ts, event_id)) % 4096 END AS DOUBLE) AS v0 FROM events GROUP BY 1)",
    "bag_similarity": "SELECT a.doc_id, round(CASE WHEN len(list_distinct(a.t || b.t)) = 0 THEN 1.0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) END, 6) AS similarity FROM (SELECT doc_id, list_distinct(list_filter(string_split(lower(coalesce(text, '')), ' '), lambda w: w <> '')) AS t FROM documents) a JOIN (SELECT doc_id, list_distinct(list_filter(string_split(lower(coalesce(text, '')), ' '), lambda w: w <> '')) AS t FROM documents) b ON a.doc_id % 2 = 0 AND b.doc_id = a.doc_id + 1",
    "registry_resolve": "WITH av AS (SELECT DISTINCT CASE WHEN p_partkey % 5 < 3 THEN 'p/' ELSE 'x/' END || p_partkey AS path FROM part UNION SELECT 'x/' || p_partkey FROM part WHERE p_partkey % 8 = 0), e AS (SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'inrepo' WHEN 1 THEN 'zcache' ELSE 'private' END AS tier, 'p/' || p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN 'x/' || p_partkey END AS x FROM part), v AS (SELECT *, path IN (SELECT path FROM av) AS hp, coalesce(x IN (SELECT path FROM av), false) AS hx FROM e), w AS (SELECT *, CASE WHEN doc_id % 2 = 0 AND hx THEN 'excerpt' WHEN hp THEN tier WHEN hx THEN 'excerpt' ELSE 'missing' END AS via FROM v) SELECT doc_id, CASE via WHEN 'excerpt' THEN x WHEN 'missing' THEN NULL ELSE path END AS resolved, via FROM w",
    "availability_matrix": f"SELECT * FROM {_AVAILABLE}",
    "route_matrix": f"SELECT doc_id, host, intent, status, primary_algo, steps, degraded, pass2, n_notes, CASE WHEN steps IS NOT NULL THEN k || CASE WHEN degraded THEN ' DEGRADED' ELSE '' END || ': ' || replace(steps, '+', ' + ') END AS summary FROM {_ROUTED}",
    "execution": f"SELECT doc_id, host, intent, array_to_string(list_filter(string_split(steps, '+'), lambda s: CASE WHEN s = 'image-optimize' THEN primary_algo = 'marker' AND doc_id % 2 = 0 ELSE s NOT LIKE '%-small-image' END), '+') AS ran, CAST(len(list_filter(string_split(steps, '+'), lambda s: NOT CASE WHEN s = 'image-optimize' THEN primary_algo = 'marker' AND doc_id % 2 = 0 ELSE s NOT LIKE '%-small-image' END)) AS BIGINT) AS n_skipped, CASE WHEN pass2 IS NOT NULL THEN math > 1 END AS needs_pass2 FROM {_ROUTED} WHERE status = 'ok'",
    "memory_peak": f"SELECT concat_ws('/', doc_id, host, intent) AS case_id, CAST(list_max(list_transform(string_split(steps, '+'), lambda s: CASE s WHEN 'marker' THEN 1500 WHEN 'pdftotext' THEN 63 WHEN 'tesseract' THEN 124 WHEN 'pix2tex' THEN 800 WHEN 'gemma3-4b-small-image' THEN 600 ELSE 100 END)) AS BIGINT) AS ram_mb FROM {_ROUTED} WHERE status = 'ok'",
}
