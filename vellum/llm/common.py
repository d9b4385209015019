"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy steps take at a time, so that their 8-byte temporaries stay small.
BLOCK_BYTES = 1 << 20
#: Bytes up to which small partitions are put together.
PACK_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_OWN: list[str] = []
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset: for a master on one machine a folder that goes with this process; on a cluster, whose machines share no local folder, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="vellum-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    _WRITTEN.append(f"{shared_folder(spark).rstrip('/')}/vellum/{what}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written() -> int:
    """How many tables this process has written so far, for ``drop_tables``."""
    return len(_WRITTEN)


def drop_tables(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables that this process has written to cut lineages, from number ``since`` on and but for ``keep``. Results that were not stored yet can't be read afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kept = {getattr(df, "_written_to", None) for df in keep}
    for name in [p for p in _WRITTEN[since:] if p not in kept]:
        _WRITTEN.remove(name)
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def packed(df: DataFrame) -> DataFrame:
    """``df`` with small partitions put together: three tasks a core at least, and no task for less than ``PACK_BYTES`` of what Spark takes the rows for.

    Each written file costs the executors a few processes and the file system an entry. Large inputs stay as they are, as does
    whatever Spark can't size.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(3 * df.sparkSession.sparkContext.defaultParallelism, min(size // PACK_BYTES, 1 << 30) + 1))


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    packed(df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


#: Rows (or what is weighed for them) up to which a side is broadcast by ``dimension_join``, and the parts that a larger side is repeated in.
BROADCAST_ROWS = 200_000
SALTS = 32


def dimension_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread: Column, weight: Column | None = None, size: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each of the ``keys``; a key of ``left`` may hold a third of its rows.

    ``right`` is broadcast if the sum of ``weight`` over it (its rows, by default), or the bound ``size`` of it that the caller knows, is at most ``BROADCAST_ROWS``.
    A larger one is repeated ``SALTS`` times, and the rows of a key of ``left`` are dealt over as many parts by the hash of ``spread``.
    """
    if size is None:
        size = right.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    if size <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    return left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS).cast("long"))).join(repeated(right, "__salt"), [*keys, "__salt"], how).drop("__salt")


def repeated(right: DataFrame, salt: str, salts: int = SALTS) -> DataFrame:
    """``right`` once for each value of a new column ``salt``, as the side of a shuffled join.

    Spark takes the repeated rows for no more than the rows themselves, so by its own bound it would broadcast ``salts`` times what it allows;
    the driver holds all that is broadcast, and the hint keeps it out of there.
    """
    return right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))).hint("merge")


def in_runs(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """``df`` dealt by ``keys`` and sorted by them and ``order``, so that a key's rows follow one another in one partition.

    Where a join dealt the rows by the same keys before, Spark drops a plain repartition, and may then read the join's rows in another
    way that splits keys; the constant keeps the exchange.
    """
    return df.repartition(*keys, F.lit("runs")).sortWithinPartitions(*keys, *order)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets (length + 1); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: What operators keep in a worker from task to task, by name.
KEPT: dict[str, object] = {}


def slices(batches, rows: int = 512, keeps: str | None = None):
    """The record batches in pieces of at most ``rows`` rows, so that what Python makes of them stays small. What was freed is given back after each batch.

    A worker that has gone on to this task from another operator drops what that one kept in it; ``keeps`` is the name of this one's.
    """
    for name in [k for k in KEPT if k != keeps]:
        del KEPT[name]
    give_back()
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        del batch
        give_back()


def give_back() -> None:
    """Return freed memory of Arrow and of the C library to the system: a worker lives on for other tasks, and what it holds counts."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def byte_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each, one row at least; every row is in one range."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        out.append((lo, min(hi, n)))
        lo = out[-1][1]
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads every bit of a uint64 over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, in order, and each row's first word (length + 1)."""
    import xxhash

    raw, hashes, counts = data.tobytes(), [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        found = raw[a:b].split()
        hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))
        counts.append(len(found))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def held_out(doc_id: str = "doc_id"):
    """The rows that no classifier learns labels from: crc32(doc_id as text) mod 4 = 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


#: Windows that a long text is learnt from.
SAMPLE_WINDOWS = 8


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, seed: int) -> list[tuple[str, int]]:
    """At most ``per_class`` texts of either label, from rows that are not held out; of a text beyond ``max_chars`` characters, windows spread over all of it.

    The bounds keep what reaches the driver under ``2 * per_class * max_chars`` characters at any size. Only rows that have a text are drawn, whole
    ones first, and among them by hash order, so the sample is the same on every run and a class of nothing but long texts is learnt from them.
    Null ids, texts and labels take no part; of contradicting labels of one id the larger counts, of several texts of one id the least.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    spark = docs.sparkSession
    sized = docs.where(F.col("text").isNotNull()).select("doc_id", (F.length("text") > max_chars).alias("cut")).join(known, "doc_id")
    ready = materialise(sized.groupBy("doc_id").agg(F.max("cut").alias("cut"), F.max("y").alias("y")), "labelled")
    order = ("cut", F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    drawn = [(r.doc_id, r.y) for y in (0, 1) for r in ready.where(F.col("y") == y).orderBy(*order).limit(per_class).collect()]
    if not drawn:
        return []
    chosen = spark.createDataFrame(drawn, "doc_id long, y int")
    width = max(1, max_chars // SAMPLE_WINDOWS)
    step = (F.length("text") - width) / max(1, SAMPLE_WINDOWS - 1)
    windows = F.concat(*[F.substring(F.col("text"), (F.floor(step * i) + 1).cast("int"), F.lit(width)) for i in range(SAMPLE_WINDOWS)])
    texts = (
        docs.where(F.col("text").isNotNull()).select("doc_id", F.when(F.length("text") <= max_chars, F.col("text")).otherwise(windows).alias("text"))
        .join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    )
    return [(r.text, r.y) for r in sorted(texts.collect(), key=lambda r: r.doc_id)]
