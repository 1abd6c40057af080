"""Jump consistent hashing of stable keys to shards, with gapless slots."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from expcurve.llm.common import ship_package, stored, text_or_empty

_MULTIPLIER = np.uint64(2862933555777941757)   # fixed value of the published algorithm


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, without a ring table.

    A key jumps from shard to shard at pseudo-random distances until a jump
    leaves the range; appending a shard therefore moves 1/(n+1) of the keys,
    all of them into the new shard.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64).copy()
    shard = np.zeros(len(state), dtype=np.int64)
    active = np.arange(len(state))
    while len(active):
        with np.errstate(over="ignore"):
            state[active] = state[active] * _MULTIPLIER + np.uint64(1)
        step = ((state[active] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump = ((shard[active] + 1) * (float(1 << 31) / step)).astype(np.int64)
        stays = jump < shards
        active, jump = active[stays], jump[stays]
        shard[active] = jump
    return shard


def jump_shard(key, shards: int):
    """Column: the shard of a long column under ``shards`` shards."""

    @F.pandas_udf("int")
    def run(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return run(key)


def with_slots(rows: DataFrame, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without gaps, in no task alone.

    ``rows`` must be a stored Parquet table: a row is named by its file and
    its place in it, which stay the same when a task is run again.  A file's
    rows are numbered within (file, shard); the counts of the files before it
    are added.  Groups are bounded by a file's rows, whatever the key's skew.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.row_index").alias("_at"))
    counts = placed.groupBy(shard_col, "_file").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard_col).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard_col, "_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_file", shard_col).orderBy("_at")
    return (placed.join(starts, [shard_col, "_file"])
            .withColumn(slot_col, F.col("_start") + F.row_number().over(within) - 1)
            .drop("_file", "_at", "_start"))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    The law is ``key``: the id and the number of shards alone decide the shard;
    with one more shard (grown_shard) a row stays or goes to the new one.  Rows
    with equal ids share a shard; a null id is hashed as the empty key.  size
    is the text's UTF-8 bytes plus 1; a null text counts as empty.  slot runs
    from 0 without gaps in every shard; it follows the order in which the rows
    are stored.  Other columns of ``docs`` are ignored.
    """
    ship_package(docs.sparkSession)
    key = F.xxhash64(F.col(id_col).cast("long"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.octet_length(text_or_empty(text_col)) + 1).cast("long").alias("size"),
                       F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"), key.alias("_key"))
    rows = stored(rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"),
                              jump_shard(F.col("_key"), shards).alias("shard"),
                              jump_shard(F.col("_key"), shards + 1).alias("grown_shard")), "shards")
    return with_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
