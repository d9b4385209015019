"""Resource samples to step metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that samples may have beside step, ts, cpu, rss and read_bytes.
OPTIONAL = ("cpu_seconds", "threads", "gpu_util", "gpu_vram", "write_bytes")


def step_metrics(samples: DataFrame, step: str = "step") -> DataFrame:
    """One row a step from samples (step, ts, sample_id, cpu, rss, read_bytes, and what there is of ``OPTIONAL``).

    Wall time, processor seconds, mean and peak load, memory at the start, its peak and growth, peak threads, mean load of the graphics
    processor, its peak memory and growth over the first sample, and bytes read and written, never negative. What isn't sampled is null. Rounded to 3 places.
    """
    have = samples.withColumns({c: F.lit(None).cast("double") for c in OPTIONAL if c not in samples.columns})
    place = F.struct("ts", "sample_id")
    first, last = (lambda c: F.min_by(c, place)), (lambda c: F.max_by(c, place))
    wall = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    moved = lambda c: F.when(last(c).isNotNull() & first(c).isNotNull(), F.greatest(F.lit(0.0), last(c) - first(c)))
    cols = {
        "samples": F.count("*"), "wall_s": wall, "cpu_s": last("cpu_seconds") - first("cpu_seconds"), "cpu_mean": F.avg("cpu"), "cpu_peak": F.max("cpu"),
        "rss_start": first("rss"), "rss_peak": F.max("rss"), "rss_delta": F.max("rss") - first("rss"), "threads_peak": F.max("threads"),
        "gpu_util_mean": F.avg("gpu_util"), "vram_peak": F.max("gpu_vram"), "vram_delta": F.max("gpu_vram") - first("gpu_vram"),
        "io_read": moved("read_bytes"), "io_write": moved("write_bytes"),
    }
    out = have.groupBy(step).agg(*[c.alias(n) for n, c in cols.items()])
    return out.select(step, "samples", *[F.round(F.col(n).cast("double"), 3).alias(n) for n in cols if n != "samples"])
