"""The extraction router: a decision table over intents, hosts, documents and measured profiles, as columns.

Whatever the reference tells by raising, as a scan without any OCR, is a ``status`` here, so one bad row fails no job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The aliases of intents, limits in MB, and the measured profiles.
ALIASES = {
    "fast": "rapido", "rapido": "rapido", "rápido": "rapido",
    "quality": "qualidade", "qualidade": "qualidade",
    "balanced": "balanceado", "balanceado": "balanceado",
    "auto": "auto",
    "indexing": "indexacao", "indexacao": "indexacao", "indexação": "indexacao",
    "low-resource": "low-resource", "baixo-recurso": "low-resource",
}
GPU_MIN_MB, LOW_RESOURCE_MB = 4096, 160
OPTIMIZER = "image-optimize"
#: (algo, role, hardware, needs, granularity, seconds a unit, unit, vram_mb, ram_mb, cold_s, scan)
PROFILES = [
    ("marker", "PRIMARY", "gpu-required", ["marker_bin"], "document", 12.9, "page", 3400, 1500, 30.0, "ocr-gpu"),
    ("pdftotext", "PRIMARY", "cpu", [], "document", 0.0205, "page", 0, 63, 0.1, "none"),
    ("tesseract", "PRIMARY", "cpu", ["tesseract_bin"], "document", 2.74, "page", 0, 124, 0.5, "printed"),
    ("pix2tex", "REFINER", "cpu", ["pix2tex_runtime"], "crop", 6.5, "formula", 0, 800, 11.9, None),
    ("gemma3-4b-small-image", "REFINER", "gpu-optional", ["ollama"], "crop", 45.9, "image", 3500, 600, 5.0, None),
    ("qwen3-vl-8b-small-image", "REFINER", "gpu-optional", ["ollama"], "crop", 112.0, "image", 5500, 700, 5.0, None),
    (OPTIMIZER, "OPTIMIZER", "cpu", [], "crop", 0.12, "image", 0, 100, 0.1, None),
]
PROFILE_SCHEMA = "algo string, role string, hardware string, needs array<string>, granularity string, unit_speed_s double, unit string, vram_mb int, ram_mb int, cold_s double, scan string"
NEEDS = {"marker_bin": "has_marker", "tesseract_bin": "has_tesseract", "ollama": "has_ollama", "pix2tex_runtime": "has_pix2tex"}


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE_SCHEMA)


def by_role(known: DataFrame, role: str) -> DataFrame:
    """The profiles of a role, fastest first."""
    return known.where(F.col("role") == role).orderBy("unit_speed_s", "algo")


def canonical_intent(intent: Column) -> Column:
    """The canonical name of an alias; null for an unknown one."""
    key = F.replace(F.lower(F.trim(F.coalesce(intent, F.lit("")))), F.lit("_"), F.lit("-"))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), key)


def availability(hosts: DataFrame, known: DataFrame) -> DataFrame:
    """(host, algo, available) for every host and profile; both are dimensions, profiles a handful of rows."""
    flags = F.create_map(*[x for need, col in NEEDS.items() for x in (F.lit(need), F.col(col))])
    joined = hosts.crossJoin(F.broadcast(known.select("algo", "hardware", "needs")))  # a handful of profiles
    enough = (F.col("hardware") != "gpu-required") | (F.col("gpu_vram_mb") >= GPU_MIN_MB)
    met = F.forall("needs", lambda n: F.coalesce(F.try_element_at(flags, n), F.lit(True)))
    return joined.select("host", "algo", (enough & met).alias("available"))


def capabilities(hosts: DataFrame, known: DataFrame) -> DataFrame:
    """One row a host: which algorithms it has, for the decision columns."""
    wide = availability(hosts, known).groupBy("host").agg(F.collect_set(F.when(F.col("available"), F.col("algo"))).alias("can"))
    rams = known.agg(*[F.max(F.when(F.col("algo") == a, F.col("ram_mb"))).alias(n) for a, n in ((OPTIMIZER, "opt_ram"), ("pdftotext", "text_ram"))], F.collect_set(F.when(F.col("scan").isin("ocr-gpu", "printed"), F.col("algo"))).alias("scanners"))
    return hosts.select("host", "gpu_vram_mb", "has_marker").join(wide, "host").crossJoin(F.broadcast(rams))  # one row


def route(cases: DataFrame) -> DataFrame:
    """Adds status, canonical, primary_algo, steps, degraded, pass2 and notes to cases (intent, the columns of ``capabilities``, has_text_layer, math_density, matrix_density, has_raster_logos)."""
    can = lambda a: F.array_contains("can", a)
    scans = lambda a: can(a) & F.array_contains("scanners", a)
    df = cases.withColumn("canonical", canonical_intent(F.col("intent")))
    intent = F.col("canonical")
    scan = ~F.col("has_text_layer")
    wants_quality = intent.isin("qualidade", "balanceado", "auto")
    scan_primary = F.when(scans("marker"), "marker").when(scans("tesseract"), "tesseract")
    text_primary = F.when(wants_quality & can("marker"), "marker").otherwise("pdftotext")
    df = df.withColumn("primary_algo", F.when(intent.isNull(), None).when(scan, scan_primary).otherwise(text_primary))
    primary = F.col("primary_algo")
    refine = ~scan & intent.isin("qualidade", "auto")
    math = refine & (F.col("math_density") > 0) & (primary != "marker")
    logo = refine & F.col("has_raster_logos")
    fits = F.when(primary == "pdftotext", F.col("text_ram")).otherwise(0) + F.col("opt_ram") <= LOW_RESOURCE_MB
    optimise = F.when(scan, wants_quality).otherwise(wants_quality | ((intent == "low-resource") & fits))
    steps = F.array_compact(F.array(primary, F.when(math & can("pix2tex"), "pix2tex"), F.when(logo & can("gemma3-4b-small-image"), "gemma3-4b-small-image"), F.when(optimise, OPTIMIZER)))
    lacking = ~scan & wants_quality & ~can("marker")
    notes = F.array_compact(F.array(
        F.when(lacking, F.concat(F.when(intent == "qualidade", "degraded: no marker, ").otherwise("adapted: no marker, "), F.when(F.col("gpu_vram_mb") < GPU_MIN_MB, "too little VRAM").otherwise("not installed"))),
        F.when(math & can("pix2tex") & (F.col("matrix_density") > 0), "matrix: low confidence"),
        F.when(math & ~can("pix2tex"), "math stays raw: no formula runtime"),
        F.when(logo & ~can("gemma3-4b-small-image"), "logos stay: no vision runtime"),
        F.when(~scan & (intent == "low-resource") & ~fits, "no optimizer: over the memory limit"),
        F.when(~scan & (intent == "indexacao"), "first pass is the index, second is queued where warranted"),
        F.when(scan & (primary == "marker"), "scan: GPU OCR"),
        F.when(scan & (primary == "tesseract"), "scan: CPU OCR"),
        F.when(scan & (intent == "indexacao"), "scan: one pass only"),
    ))
    ok = intent.isNotNull() & primary.isNotNull()
    pass2 = F.when(~scan & (intent == "indexacao") & can("marker"), F.array(F.lit("marker"), F.lit(OPTIMIZER)))
    return df.withColumns({
        "status": F.when(intent.isNull(), "UnknownIntent").when(primary.isNull(), "ScanNoOCR").otherwise("ok"),
        "steps": F.when(ok, steps), "degraded": F.when(ok, (intent == "qualidade") & F.when(scan, primary == "tesseract").otherwise(~can("marker"))),
        "pass2": F.when(ok, pass2), "notes": F.when(ok, notes),
    })


def summary(intent: Column, steps: Column, degraded: Column) -> Column:
    return F.concat(intent, F.when(degraded, " DEGRADED").otherwise(""), F.lit(": "), F.array_join(steps, " + "))


def memory_peak(steps: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, ram_mb): the largest step's memory, as steps run one after another; unknown steps need none."""
    return steps.select(key, F.explode_outer("steps").alias("algo")).join(F.broadcast(known.select("algo", "ram_mb")), "algo", "left").groupBy(key).agg(F.coalesce(F.max("ram_mb"), F.lit(0)).alias("ram_mb"))


def execution(routed: DataFrame, has_images: Column, warranted: Column) -> DataFrame:
    """What a run of the pipeline does: steps ran and skipped with reasons, and whether pass 2 is needed (null if not measured)."""
    ran = F.filter("steps", lambda s: F.when(s == OPTIMIZER, (F.col("primary_algo") == "marker") & has_images).otherwise(~F.endswith(s, F.lit("-small-image"))))
    left = F.transform(F.array_except(F.col("steps"), ran), lambda s: F.concat(s, F.when(s == OPTIMIZER, ": nothing to optimise").otherwise(": needs a reviewer")))
    return routed.withColumns({"ran": ran, "skipped": left, "needs_pass2": F.when(F.col("pass2").isNotNull(), warranted)})
