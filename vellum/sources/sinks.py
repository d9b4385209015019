"""Writers. All refuse to overwrite unless told to, and all go through Spark, so any file system that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _record(text: str):
    """The writer ends each record with a line end, so the text's own last one goes."""
    return F.regexp_replace(text, r"\n\z", "").alias("value")


def write_markdown(df: DataFrame, path: str, key: str, text: str = "md", mode: str = "errorifexists") -> None:
    """One folder a document; a text is one record, ended by one line end."""
    df.select(F.col(key), _record(text)).write.mode(mode).partitionBy(key).text(path)


def write_chapters(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chapters (book_id, id, chunk) as ``book_id=.../id=...``."""
    chunks.select("book_id", "id", _record("chunk")).write.mode(mode).partitionBy("book_id", "id").text(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists", digits: int | None = None) -> None:
    """Rows as JSON lines, nulls kept; doubles rounded if asked."""
    if digits is not None:
        df = df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
