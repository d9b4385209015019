"""Engines that decode, recognise or render stay outside: they are Python callables, run over Arrow batches.

An item whose runner fails becomes a row with ``error`` set; it never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import layout


def run_each(df: DataFrame, runner: Callable[[bytes], str], column: str = "content", result: str = "markdown") -> DataFrame:
    """``df`` without ``column``, with ``result`` (null on failure) and ``error``. For extractors, recognisers and renderers alike."""
    names = [c for c in df.columns if c != column]

    def run(batches):
        for batch in batches:
            out, errors = [], []
            for item in batch.column(column).to_pylist():
                try:
                    out.append(runner(item))
                    errors.append(None)
                except Exception as e:  # one bad item is one bad row
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string()), pa.array(errors, pa.string())], [*names, result, "error"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != column)
    return df.mapInArrow(run, f"{fields}`{result}` string, error string")


def counts(done: DataFrame) -> DataFrame:
    return done.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def text_layer(pages: DataFrame, key: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(key, md, n_pages): Markdown of the text layer, from pages (key, page, blocks); ``n_pages`` counts the whole document. Without any page in range ``md`` is null."""
    total = pages.groupBy(key).agg(F.count("*").alias("n_pages"))
    chosen = layout.page_range(pages, first, last)
    md = layout.assemble(layout.pages_to_markdown(chosen, key, layout.dominant_size(chosen, key)), key)
    return total.join(md, key, "left").select(key, "md", "n_pages")


def round_trips(texts: DataFrame, key: str, render_and_extract: Callable[[str], str], iterations: int = 5, text: str = "text") -> DataFrame:
    """(key, i, text, error) for i from 0: each text is passed through the runner again and again; a series ends at its first failure and keeps what it has."""

    def run(batches):
        for batch in batches:
            keys, steps, out, errors = [], [], [], []
            for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                rows = [(0, t, None)]
                for i in range(1, iterations + 1):
                    try:
                        rows.append((i, render_and_extract(rows[-1][1]), None))
                    except Exception as e:
                        rows.append((i, None, f"{type(e).__name__}: {e}"))
                        break
                for i, t2, err in rows:
                    keys.append(k)
                    steps.append(i)
                    out.append(t2)
                    errors.append(err)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(steps, pa.int32()), pa.array(out, pa.string()), pa.array(errors, pa.string())], [key, "i", "text", "error"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, i int, text string, error string")
