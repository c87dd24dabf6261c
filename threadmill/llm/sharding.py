"""Sharding by jump consistent hashing.

A document's stable key decides its shard without any ring or lookup table. When a shard is added, a
key either stays where it is or moves to the new shard, and 1 / (n + 1) of all keys move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import clean_text, cut, table

N_SHARDS = 24
#: Bytes added to each text for its record frame.
FRAME_BYTES = 8
#: The slot offsets have one row for each scan partition and shard; below this many they are broadcast.
MAX_BROADCAST_OFFSETS = 2_000_000
_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys, for a whole array at a time."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.int64)
    open_ = np.arange(len(key))
    while open_.size:
        shard[open_] = jump[open_]
        key[open_] = key[open_] * _STEP + np.uint64(1)
        stretch = float(1 << 31) / ((key[open_] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[open_] = ((shard[open_] + 1).astype(np.float64) * stretch).astype(np.int64)
        open_ = open_[jump[open_] < n_shards]
    return shard


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Only the id and ``n_shards`` decide the shard, so equal ids share one and a null id has a fixed one.
    A null text has no bytes and the checksum of the empty text. Slots count 0, 1, ... in each shard
    over all rows, repeated ones included. An empty table gives no rows; other columns are ignored.

    The text never leaves the JVM. Slots need no sort and no shuffle: each scan partition numbers its
    rows by shard, and the counts by partition and shard give each partition its offset.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(clean_text(F.col(text_col))) + FRAME_BYTES).cast("long").alias("size"),
        F.crc32(clean_text(F.col(text_col))).alias("text_crc32"),
        F.xxhash64(F.col(id_col)).alias("key"),
    )
    schema = T.StructType([
        slim.schema["doc_id"],
        T.StructField("size", T.LongType()),
        T.StructField("text_crc32", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("grown_shard", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("place", T.LongType()),
    ])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(n_shards, np.int64)
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            shard = jump_hash(keys, n_shards)
            grown = jump_hash(keys, n_shards + 1)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=n_shards)
            first = np.cumsum(counts) - counts
            place = np.empty(len(shard), np.int64)
            place[order] = np.arange(len(shard)) - np.repeat(first, counts) + np.repeat(seen, counts)
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(shard, pa.int32()), pa.array(grown, pa.int32()), pa.array(np.full(len(shard), part, np.int32)), pa.array(place)],
                names=["doc_id", "size", "text_crc32", "shard", "grown_shard", "part", "place"],
            )

    placed = cut(slim.mapInArrow(number, schema))
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if placed.rdd.getNumPartitions() * n_shards <= MAX_BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    return placed.join(offsets, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("place")).alias("slot"), "grown_shard"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
