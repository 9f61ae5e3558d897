"""Sharding by longest-processing-time scheduling.

Rows of equal text form a group that stays together. Groups, largest first,
go to the least-loaded shard through a heap.

The heap never sees an unbounded list. A group of at least
``total / (shards * fineness)`` bytes is scheduled on its own; by that bound
there are at most ``shards * fineness`` of them. All smaller groups are first
put together by hash into ``bundles`` bundles, which are scheduled by their
summed size in the same order. The driver so holds at most
``shards * fineness + bundles`` (id, size) pairs at any corpus size, and the
two lookup tables that are broadcast have the same bound.

Nulls and ties: a null text has no bytes, like an empty one (size 1, crc 0),
and both are one group. Equal sizes are ordered by group id,
equal loads by shard number. Repeated rows are rows of their own and get slots
of their own. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.common import land

SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def longest_first(sizes: list[tuple[tuple, int]], shards: int) -> dict[tuple, int]:
    """Group id -> shard: largest group first, to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for group, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[group] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(
    spark: SparkSession,
    docs: DataFrame,
    shards: int = 8,
    bundles: int = 1 << 16,
    fineness: int = 64,
    rows_per_bucket: int = 512,
    max_buckets: int = 1 << 13,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row.

    Slots are numbered by (shard, bucket): the bucket counts of a shard, at
    most ``max_buckets``, are summed up, and rows are numbered within a bucket,
    so no task holds a shard. A text's bytes are read once and never moved.
    """
    blob = F.col("text").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(blob), F.lit(0).cast("long")).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("g"),
        F.monotonically_increasing_id().alias("at"),
    )
    rows = land(spark, rows, "shard-rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    heavy = F.col("s") * (shards * fineness) >= F.lit(total)
    units = (
        rows.groupBy("g").agg(F.sum("size").alias("s"))
        .select(F.when(heavy, F.col("g")).alias("g"), F.when(~heavy, F.pmod("g", F.lit(bundles))).alias("b"), "s")
        .groupBy("g", "b").agg(F.sum("s").alias("s"))
        .collect()
    )  # at most shards * fineness + bundles rows
    sizes = [((0, b) if g is None else (1, g), s) for g, b, s in units]
    placed = longest_first(sizes, shards)
    own = spark.createDataFrame([(k, s) for (kind, k), s in placed.items() if kind], "g long, own int")
    shared = spark.createDataFrame([(k, s) for (kind, k), s in placed.items() if not kind], "b long, bundle int")
    buckets = max(1, min(max_buckets, math.ceil(n / (shards * rows_per_bucket))))
    put = (
        rows.withColumn("b", F.pmod("g", F.lit(bundles)))
        .join(F.broadcast(own), "g", "left")
        .join(F.broadcast(shared), "b", "left")
        .select(
            "doc_id", "size", "text_crc32", F.coalesce("own", "bundle").alias("shard"),
            F.pmod(F.xxhash64("at"), F.lit(buckets)).alias("k"), "at",
        )
    )
    before = Window.partitionBy("shard").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = put.groupBy("shard", "k").agg(F.count(F.lit(1)).alias("c")).select(
        "shard", "k", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start")
    )  # at most shards * max_buckets rows
    within = F.row_number().over(Window.partitionBy("shard", "k").orderBy("at"))
    return (
        put.withColumn("r", within)
        .join(F.broadcast(start), ["shard", "k"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
            (F.col("start") + F.col("r") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )

