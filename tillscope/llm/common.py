"""Helpers shared by the operators: table access, shared-folder tables,
bounded Arrow slices and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.session import scratch_path

#: Rows of Arrow batches are handled in slices of about so many bytes of text.
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def land(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back: the lineage
    is cut and a lost executor costs no recomputation of what came before."""
    path = scratch_path(spark, f"llm-{tag}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.landed_at = path
    return out


def discard(spark: SparkSession, *landed: DataFrame) -> None:
    """Remove the folders of landed tables that no result reads any more.
    Without a JVM at hand (a remote session) they stay."""
    jvm = getattr(spark, "_jvm", None)
    for df in landed:
        if jvm is not None:
            path = jvm.org.apache.hadoop.fs.Path(df.landed_at)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32(doc_id as text) mod 4 = 2.
    A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with at most ``limit`` bytes of ``column``
    (a longer value makes a slice of its own)."""
    col = batch.column(batch.schema.get_field_index(column))
    size = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def released(run: Callable) -> Callable:
    """``run`` (a function of ``mapInArrow``) that gives the memory it took
    back to the system when its task ends: workers are used again, and what
    one stage took would stay beside what the next one needs."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def components(spark: SparkSession, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of ``edges(u, v)``: one row (node, component) per
    node that has an edge to another node; component = its smallest node.

    Alternating large-star and small-star rounds: every round sends each edge
    a constant number of times, minima are combined before the shuffle, and
    the minima are landed so that the joins have an exchange on both sides
    (a hub's partition can then be split by AQE). Null ends are ignored.
    """
    a, b = F.col("u").cast("long"), F.col("v").cast("long")
    e = land(
        spark,
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (a.isNotNull() & b.isNotNull()).alias("ok"))
        .where("ok and u <> v").drop("ok").distinct(),
        tag,
    )
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = land(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), tag)
        large = land(
            spark, both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), tag
        )
        low = land(spark, large.groupBy("u").agg(F.min("v").alias("m")), tag)
        star = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = land(spark, star.union(low.select("u", F.col("m").alias("v"))).distinct(), tag)
        mark, old = _mark(e), mark
        if mark == old:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v"), F.col("v").alias("w")).distinct()
    )


def _mark(e: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table (one row to the driver)."""
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())
