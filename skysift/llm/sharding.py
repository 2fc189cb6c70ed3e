"""Sharding by jump consistent hashing.

A key's shard follows from the key and the number of shards alone; going from n
to n + 1 shards moves about 1 / (n + 1) of the keys, all of them into the new
shard.  No table of ring positions exists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from skysift.llm.common import free, gapless, written

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, by the published generator and jumps, for all keys at once."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    at = np.full(len(key), -1, np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = jump[live]
            key[live] = key[live] * _STEP + np.uint64(1)
            high = (key[live] >> np.uint64(33)).astype(np.float64) + 1
            jump[live] = np.floor((at[live] + 1) * (float(1 << 31) / high)).astype(np.int64)
            live = live[jump[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a long column; keys are mixed first, and a null key counts as the smallest long."""

    @pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64), shards).astype(np.int32))

    return shard(F.xxhash64(F.coalesce(key.cast("long"), F.lit(-(1 << 63)))))


def assign(docs: DataFrame, shards: int = 16, grow_to: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Gives every row its shard and a slot there, gapless from 0.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; null: 1), text_crc32,
    shard, grown_shard (with grow_to shards), slot, and the columns in keep.
    Rows with one doc_id, null included, share a shard and have slots of their
    own, repeated rows too; an empty table gives no row.
    """
    keep = keep or []
    row = free(docs, "_row")
    rows = docs.select(
        "doc_id",
        *keep,
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), grow_to or shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias(row),
    )
    return gapless(written(rows, "shards"), "shard", [row], "slot").drop(row)


def write_sharded(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Writes rows into one folder per shard; within a folder, as many files as tasks had its rows."""
    docs.withColumn("shard", shard_of(F.col("doc_id"), shards)).write.partitionBy("shard").parquet(path)
