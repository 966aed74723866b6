"""Shards by jump consistent hashing: the key and the number of shards decide, and growing moves only what must move.

The hash (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm") needs no ring table: it walks the
pseudo-random jumps of a key until the next one would leave the range. It is vectorised over Arrow batches of 64-bit
keys; sizes, checksums and slots are native columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import gapless, scratch, table, text_of

SHARDS = 16
SALTS = 1024


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard 0..shards-1 of each 64-bit key."""
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    todo = np.arange(len(key))
    ahead = np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while len(todo):
            at[todo] = ahead[todo]
            k = key[todo] * np.uint64(2862933555777941757) + np.uint64(1)
            key[todo] = k
            ahead[todo] = ((at[todo] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            todo = todo[ahead[todo] < shards]
    return at


def shard_of(column, shards: int):
    """The shard of a long column (a hash of the stable key)."""

    @arrow_udf("int")
    def jump(keys: pa.Array) -> pa.Array:
        return pa.array(jump_hash(keys.to_numpy(zero_copy_only=False).view(np.uint64), shards).astype(np.int32))

    return jump(column)


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, *, salts: int = SALTS) -> DataFrame:
    """df and its shard (int), grown_shard (int, with one shard more) and slot (long, gapless from 0 in the shard).

    The shard depends on the key's value and the shard count alone: rows with one key share a shard, a null key is
    one more key, and an empty table stays empty. Within a shard, rows are dealt to parts by a hash of the whole row, so
    that rows with one key share a shard and not a task, and slots follow key order inside a part; wholly equal rows
    are interchangeable. Columns of df named
    shard, grown_shard or slot are replaced.
    """
    df = df.drop("shard", "grown_shard", "slot")
    hashed, own = scratch("key"), scratch("row")
    keyed = df.withColumn(hashed, F.xxhash64(F.col(key)))
    placed = keyed.withColumn("shard", shard_of(F.col(hashed), shards)).withColumn("grown_shard", shard_of(F.col(hashed), shards + 1))
    plain = [c for c, t in df.dtypes if "map" not in t and "variant" not in t]
    placed = placed.withColumn(own, F.xxhash64(*plain))
    return gapless(placed, ["shard"], F.xxhash64(F.col(own), F.lit(1)), [F.col(hashed), F.col(key), F.col(own)], "slot", salts).drop(hashed, own)


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS, tasks_per_shard: int = 64) -> None:
    """Writes df as Parquet under path/shard=K, each shard by several tasks."""
    placed = assign_shards(df, key, shards)
    placed.repartition(shards * tasks_per_shard, "shard", F.pmod("slot", F.lit(tasks_per_shard))).write.partitionBy("shard").parquet(path)


def op9_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by the law `key`; a null text has no bytes and the checksum of the empty text."""
    text = text_of()
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return assign_shards(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
