"""Sharding by jump consistent hashing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_GROUP = 20_000
KEY_BITS = 60


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key (Lamping and Veach): a key moves only when its next jump falls inside."""
    state = keys.astype(np.uint64)
    shard, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    active = np.flatnonzero(ahead < shards)
    while len(active):
        shard[active] = ahead[active]
        state[active] = state[active] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[active] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[active] = ((shard[active] + 1) * (2147483648.0 / draw)).astype(np.int64)
        active = active[ahead[active] < shards]
    return shard


def stable_key(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text; a null id counts as the text ``null``."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards), dtype="int32")

    return F.pandas_udf(jump, "int")(key)


def assign_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Put every row into one of ``shards`` shards and number the rows of each shard.

    Law ``key``: the id and the number of shards decide. ``grown_shard`` is the shard with one
    more shard; it is ``shard`` or the new one. ``slot`` counts a shard's rows from 0 in the
    order of the key, then id, text sum and size; rows equal in these are alike. Rows with a null id share a
    shard, as do repeated ids. An empty table gives no rows.

    Slots need no shard in one task: rows are grouped by shard and leading key bits, a group is
    numbered by itself, and offsets come from the group counts. Rows of one key (a repeated
    id) stay in one group.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        stable_key(F.col("doc_id")).alias("key"),
    )
    expected = docs.count() / (shards * ROWS_PER_GROUP)
    bits = max(0, math.ceil(math.log2(expected))) if expected > 0 else 0
    rows = rows.select(
        "*",
        shard_of(F.col("key"), shards).alias("shard"),
        shard_of(F.col("key"), shards + 1).alias("grown_shard"),
        F.shiftright(F.col("key"), KEY_BITS - bits).alias("part"),
    )
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("key", "doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("at")).cast("long").alias("slot"), "grown_shard",
    )
