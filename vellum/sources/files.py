"""Readers of folders: Markdown, statistics as JSON, images, and whole files with their digests.

Paths are given to Spark's readers only, so any file system that Spark knows will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATS_SCHEMA = """
    source struct<pages:bigint,size_bytes:bigint,sha256:string>,
    output struct<totals:struct<chapter_count:bigint,tokens:bigint,words:bigint,size_bytes:bigint,math_display:bigint,math_inline:bigint,headers_total:bigint,tables_rough:bigint,images_count:bigint,images_total_bytes:bigint,ligature_artifacts:bigint>>,
    roundtrip struct<similarity:double,divergence_categories:map<string,bigint>>,
    tools struct<marker:string,torch:string,cuda_device:string>,
    extraction_time_seconds double, generated_at string
"""
SERIES_SCHEMA = "iterations array<struct<i:bigint,tokens:bigint,sim_to_md0:double,sim_to_prev:double,seconds:double,md_path:string,error:string>>"


def _relative(root: str) -> Column:
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.regexp_replace(F.col("_metadata.file_path"), rf"^.*?\Q{base}\E/", "")


def markdown_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, chapter_id, text, size_bytes) of content files.

    Files and folders that begin with ``_`` or ``.``, ``index.md`` and ``README.md`` are none. If the root itself has content it is a paper and only
    its own files count; else each folder with a file of its own name is a chapter.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).select(_relative(root).alias("path"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size_bytes"))
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    content = rows.where(~F.col("path").rlike(r"(^|/)[_.]") & ~name.isin("index", "README"))
    flat = content.where(~F.contains("path", F.lit("/")))
    chapters = content.where(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) == name)
    chosen = chapters if flat.isEmpty() else flat
    return chosen.select("path", name.alias("chapter_id"), "text", "size_bytes").orderBy("path")


def sidecars(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, value) of the files ``name`` below ``root``, path relative to it.

    Spark's readers pass over names that begin with ``_``, as sidecar names do, so these are listed and read through the same file system
    API by the driver, in portions that become rows at once. Each is a few kilobytes of metadata a document; texts never go this way.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    prefix = fs.makeQualified(base).toString().rstrip("/") + "/"
    schema, part, out = "path string, value string", [], None

    def flush(out):
        df = spark.createDataFrame(part, schema)
        return df if out is None else out.union(df)

    found = fs.listFiles(base, True)
    while found.hasNext():
        path = found.next().getPath()
        if path.getName() != name:
            continue
        stream = fs.open(path)
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        part.append((path.toString()[len(prefix) :], text))
        if len(part) >= 5000:
            out = flush(out)
            part = []
    return flush(out) if part or out is None else out


def stats_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, stats struct, corrupt) of every ``_stats.json``; a malformed file is a row with ``corrupt`` set, not a failure."""
    raw = sidecars(spark, root, "_stats.json").select(F.regexp_replace("path", r"/?_stats\.json$", "").alias("rel_path"), F.from_json("value", STATS_SCHEMA + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("s"))
    return raw.select("rel_path", "s", F.col("s._corrupt_record").isNotNull().alias("corrupt"))


def series_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, iterations) of the ``_multi_roundtrip.json`` that can be read."""
    raw = sidecars(spark, root, "_multi_roundtrip.json").select(F.regexp_replace("path", r"/?_multi_roundtrip\.json$", "").alias("rel_path"), F.from_json("value", SERIES_SCHEMA).alias("s"))
    return raw.where("s.iterations IS NOT NULL").select("rel_path", "s.iterations")


def overview_rows(spark: SparkSession, root: str) -> DataFrame:
    """The flat fact table of a corpus: one row a readable ``_stats.json``, with its series beside it if there is one."""
    from vellum.functions.labels import document_kind

    good = stats_tree(spark, root).where(~F.col("corrupt")).join(series_tree(spark, root), "rel_path", "left")
    totals = ("chapter_count", "tokens", "words", "size_bytes", "math_display", "math_inline", "headers_total", "tables_rough", "images_count", "images_total_bytes", "ligature_artifacts")
    return good.select(
        document_kind(F.col("rel_path")).alias("kind"), F.element_at(F.split("rel_path", "/"), -1).alias("name"), "rel_path", F.col("s.source.pages").alias("pages"),
        F.coalesce("s.source.size_bytes", F.lit(0)).alias("pdf_size"), *[F.coalesce(f"s.output.totals.{c}", F.lit(0)).alias(c) for c in totals],
        F.col("s.extraction_time_seconds").alias("extraction_seconds"), F.col("s.roundtrip.similarity").alias("similarity"), F.col("s.roundtrip.divergence_categories").alias("divergences"),
        F.col("s.tools").alias("tools"), F.coalesce("s.generated_at", F.lit("?")).alias("generated_at"), F.col("iterations").alias("multi_roundtrip"),
    )


def image_files(spark: SparkSession, root: str, formats: tuple[str, ...] = ("png", "jpg", "jpeg", "svg")) -> DataFrame:
    """(path, name, bytes) of images, without those below a part that begins with ``_``; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", rf"^.*?\Q{root.rstrip('/').split(':', 1)[-1].lstrip('/')}\E/", "").alias("path"), F.col("length").alias("bytes"))
    good = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*formats) & ~F.col("path").rlike("(^|/)_")
    return rows.where(good).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "bytes").distinct()


def file_profile(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size_bytes, sha256) of whole files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
