"""Sharding by jump consistent hashing.

A pseudo-random sequence that the key seeds jumps forward over the shard numbers; the last
number below the shard count is the key's shard. There is no ring table: key and count
decide, and with one more shard a key either stays or goes to the new one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Fixed: the multiplier of the published algorithm's generator.
STEP = 2862933555777941757


def mixed(keys: np.ndarray) -> np.ndarray:
    """Spreads keys that follow each other over all 64 bits (the finaliser of splitmix64)."""
    x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, all keys together until none jumps on."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    x = mixed(np.asarray(keys))
    out = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    while len(live):
        x[live] = x[live] * np.uint64(STEP) + np.uint64(1)
        ahead = ((out[live] + 1) * (2.0**31 / ((x[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live, ahead = live[ahead < shards], ahead[ahead < shards]
        out[live] = ahead
    return out


def shard_of(shards: int):
    """A column function: long key -> int shard. A null key counts as the key 0."""

    @pandas_udf("int")
    def shard(key: pd.Series) -> pd.Series:
        return pd.Series(jump(key.to_numpy(np.int64), shards).astype(np.int32))

    return lambda c: shard(F.coalesce(c, F.lit(0).cast("long")))


def assign_shards(docs: DataFrame, shards: int = 8, parts: int | None = None) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes plus 1 (null text: 1, crc32 0). The law is ``key``: doc_id and shard
    count decide; grown_shard is the shard with one more. slot numbers a shard's rows from 0
    without gaps, by (part, doc_id, text_crc32), where part is a hash of these: rows are
    numbered within (shard, part), and each such cell begins after the rows of those before
    it in its shard. So no task holds a shard; cells are ``parts`` for each shard, by default
    as many as shuffle partitions. Rows that repeat get slots of their own.
    """
    spark = docs.sparkSession
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(shards)(F.col("doc_id")).alias("shard"),
        shard_of(shards + 1)(F.col("doc_id")).alias("grown_shard"),
    ).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)).cast("int"))
    return number_cells(rows, ["shard"], "part", ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def number_cells(rows: DataFrame, group: list[str], part: str, order: list[str], name: str) -> DataFrame:
    """Numbers each group's rows from 0 without gaps, in order of (part, *order).

    The count of each (group, part) cell gives where its numbers begin; a row adds its
    place in the cell. Cells, not groups, are what a task sorts."""
    from pyspark.sql import Window

    cells = rows.groupBy(*group, part).agg(F.count("*").alias("in_cell"))
    up_to = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(*group, part, F.coalesce(F.sum("in_cell").over(up_to), F.lit(0)).alias("cell_start"))
    place = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)) - 1
    return rows.withColumn("in_cell", place).join(starts, [*group, part]).withColumn(name, F.col("cell_start") + F.col("in_cell")).drop("cell_start", "in_cell")
