"""Placement of documents on shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: offset + j * skip mod size, from two
hashes of its name. Shards take turns; in its turn a shard claims the first slot of its order that nobody has. So
shards own equal shares, up to one slot, and when a shard leaves or joins, few slots change hands among
the others. A row's slot is the hash of its key modulo the size; the table is broadcast, it has ``size`` rows
whatever the data, and placement is one lookup.

Shards with a weight w claim a slot in a share w of the rounds.

Defined results: a null key is placed like the text of no characters, so all rows without a key go to one shard, whose files ``write`` splits;
repeated rows go to one shard; a very long key is hashed whole; an empty table gives no rows; an existing ``slot`` or ``shard`` column is replaced, other columns are kept.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 65_537
SHARDS = 64
#: Rows of a file of a shard.
ROWS_PER_FILE = 1_000_000


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = SIZE, weights: dict[str, float] | None = None) -> np.ndarray:
    """Index of the owning shard for each slot. Names must differ; they are taken in sorted order, so that the caller's order doesn't matter."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime, and no less than the number of shards")
    names = sorted(shards)
    where = {s: i for i, s in enumerate(shards)}
    offset = [zlib.crc32(f"offset:{s}".encode()) % size for s in names]
    skip = [zlib.crc32(f"skip:{s}".encode()) % (size - 1) + 1 for s in names]
    weight = [(weights or {}).get(s, 1.0) for s in names]
    if min(weight) < 0 or max(weight) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    weight = [w / max(weight) for w in weight]
    owner = np.full(size, -1, np.int32)
    tried, credit, left = [0] * len(names), [0.0] * len(names), size
    while left:
        for i, name in enumerate(names):
            credit[i] += weight[i]
            if credit[i] < 1 - 1e-12 or not left:
                continue
            credit[i] -= 1
            slot = (offset[i] + tried[i] * skip[i]) % size
            while owner[slot] >= 0:
                tried[i] += 1
                slot = (offset[i] + tried[i] * skip[i]) % size
            owner[slot] = where[name]
            tried[i] += 1
            left -= 1
    return owner


def assign(df: DataFrame, shards: list[str], key: str = "doc_id", size: int = SIZE, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``slot`` and ``shard`` (the owner's name) to every row."""
    spark = df.sparkSession
    owner = lookup_table(shards, size, weights)
    places = spark.createDataFrame([(i, shards[o]) for i, o in enumerate(owner.tolist())], "slot int, shard string")
    slot = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(size)).cast("int")
    return df.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(places), "slot").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def write(df: DataFrame, path: str, shards: list[str], key: str = "doc_id", files_per_shard: int | None = None, rows_per_file: int = ROWS_PER_FILE, **options) -> None:
    """Write each shard as its own folder ``shard=...``.

    A shard is split over ``files_per_shard`` tasks, by default as many as give each ``rows_per_file`` rows of an even share; a file ends at
    ``rows_per_file`` rows too. The split is a hash of the row, which a task that runs again repeats.
    """
    placed = assign(df, shards, key, **options)
    files = files_per_shard or max(1, -(-df.count() // (len(shards) * rows_per_file)))
    hashed = [f.name for f in placed.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    salted = placed.withColumn("__salt", F.pmod(F.xxhash64(F.lit(3), *[F.col(f"`{c}`") for c in hashed]), F.lit(files)))
    dealt = salted.repartition(len(shards) * files, "shard", "__salt").drop("__salt")
    dealt.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
